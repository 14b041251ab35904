"""Hashing helpers, SentencePiece codec and compact windows against plain versions."""

import random
import re

import numpy as np
import pytest

from longctx.llm import quality, spm, substrings
from longctx.llm.words import shingle_hashes, text_shingles, word_hashes, word_spans

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", " ", "a", "a b\tc\x0bd\x0ce\rf\ng", "  lead and trail \n", "Ünïcode  wörds\n\n😀 x", "a" * 300 + " " + "b c " * 50,
         "no break stays inside a word", "\x00 nul"]


def as_bytes(t):
    return np.frombuffer(t.encode(), np.uint8)


@pytest.mark.parametrize("text", TEXTS)
def test_words_are_the_runs_outside_white_space(text):
    b = as_bytes(text)
    s, e = word_spans(b)
    assert [b[x:y].tobytes().decode() for x, y in zip(s, e)] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_equal_words_hash_equal_in_any_place_and_block(monkeypatch):
    monkeypatch.setattr("longctx.llm.words._BLOCK", 64)
    words = [f"w{random.Random(i).randrange(40)}" * (1 + i % 5) for i in range(500)]
    b = as_bytes(" ".join(words))
    h = word_hashes(b, *word_spans(b))
    first = {}
    for w, x in zip(words, h.tolist()):
        assert first.setdefault(w, x) == x
    assert len(set(first.values())) == len(first)


def test_shingles_of_short_texts():
    assert len(text_shingles(as_bytes(""))) == 0
    assert len(text_shingles(as_bytes("one two"))) == 1
    assert len(text_shingles(as_bytes("a b c d e f"))) == 2
    assert text_shingles(as_bytes("One TWO")).tolist() == text_shingles(as_bytes("one two")).tolist()


def test_compact_windows_name_the_minimum_of_every_wide_range():
    rng = np.random.default_rng(3)
    for n, kinds in ((60, 1000), (200, 6), (400, 1)):
        h = rng.integers(0, kinds, n).astype(np.uint64)
        nodes = substrings.compact_windows(h, 20)
        for i in range(0, n - 20, 7):
            for j in range(i + 19, n, 11):
                held = [c for l, c, r in nodes if l <= i <= c <= j <= r]
                assert held and all(h[c] == h[i:j + 1].min() for c in held)


def test_repeat_words_counts_covered_words():
    t = "a b c d e f g h x a b c d e f g h y".split()
    h = {w: k for k, w in enumerate(dict.fromkeys(t), 1)}
    assert quality.repeat_words(np.array([h[w] for w in t], np.uint64)) == 16
    assert quality.repeat_words(np.array([1] * 8, np.uint64)) == 0
    assert quality.repeat_words(np.array([1] * 9, np.uint64)) == 9


@pytest.fixture(scope="module")
def vocab():
    return spm.Pieces(open(MODEL, "rb").read())


def test_ids_equal_the_library_on_the_same_scores(vocab):
    """The library's unigram search over a copy of the model, marked as a unigram model.

    Its sums are single precision, so the scores of -1e9 (runs of spaces) are raised to just below the rest.
    """
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        if p.type == 1:
            p.score = max(p.score, -40000)
    lib = sp.SentencePieceProcessor(model_proto=m.SerializeToString())
    import pyarrow.parquet as pq
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    some = [t for t in texts if len(t) < 2500]
    assert len(some) > 50
    for t in some:
        assert vocab.encode(t) == lib.encode(t)


@pytest.mark.parametrize("text", [*TEXTS, "a  b", " ▁ ▁▁ x▁y", "x" * 5000, "日本語テキスト", "▁"])
def test_round_trip_and_streaming(vocab, text):
    ids = vocab.encode(text)
    assert vocab.decode(ids) == text
    if "▁" not in text and text:
        marked = (" " + text).replace(" ", "▁")
        assert list(vocab.stream(iter(marked))) == list(vocab.stream([marked])) == ids


def test_stream_equals_whole_search_without_word_cuts():
    """Random scores and pieces that cross words: the committed ids equal those of a plain Viterbi."""
    rng = random.Random(5)
    v = spm.Pieces(b"")
    v.score = {p: (-float(rng.randint(1, 900)), k) for k, p in enumerate(  # whole numbers: ties stay ties
        {"".join(rng.choices("ab", k=rng.randint(1, 5))) for _ in range(40)} | {"a", "b"})}
    v.max_len = 5
    v.bad = -20000
    v.prefix = {p[:n]: None for p in v.score for n in range(1, len(p))} | v.score
    for _ in range(20):
        t = "".join(rng.choices("ab", k=300))
        best = [(0.0, None, None)] + [(-1e9, None, None)] * len(t)
        for i in range(len(t)):
            for n in range(1, 6):
                hit = v.score.get(t[i:i + n]) if i + n <= len(t) else None
                if hit and best[i][0] + hit[0] > best[i + n][0]:
                    best[i + n] = (best[i][0] + hit[0], i, hit[1])
        path, at = [], len(t)
        while at:
            path.append(best[at][2])
            at = best[at][1]
        assert list(v.stream([t])) == path[::-1]
