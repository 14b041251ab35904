"""Operators 11 to 13 against brute force, on planted and awkward rows; the registered queries on the small tables."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from longctx.llm import align, queries, resample, sharding  # noqa: E402
from longctx.llm.queries import BYTE_BPE_PATH, MODEL_PATH  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, id int, shard string, size string, kept string, rank int, at int, n_a string, pairs string"


@pytest.fixture(scope="module")
def spark():
    from longctx.session import local_session, ship_package
    s = local_session(4, 4, app="longctx-llm-tests")
    ship_package(s)
    yield s


def awkward():
    rng = random.Random(5)
    words = ["the", "The", "naïve", "x1", "日本", "don't", "a-b", "▁mark", "<|endoftext|>", "é", "🙂", " ", "1234567"]
    texts = [None, "", " ", "\x00", "one", "one two", "  lead and trail  ", "a" * 300 + " b", "日本語" * 50, " \n\t \n   x",
             "<|endoftext|> plain <s> text </s> <0x41>", "▁ in the text", "  " * 40 + "y"]
    for k in range(60):
        seps = [" ", "  ", "\n", ", ", ". ", "\t"]
        texts.append("".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(1, 60 + 3 * k))))
    texts += texts[20:30] + ["copy of many words " * 9] * 40 + [" ".join(rng.choices(words, k=9000))]
    rows = [(i, t, "r", 1, "s", "z", "k", 3, 4, "n", "p") for i, t in enumerate(texts)]
    return rows + [rows[30], rows[30], (None, "null id with some words", *rows[0][2:]), (None, None, *[None] * 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


# ------------------------------------------------------------------ 11

def grams(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), w + [a + b" " + b for a, b in zip(w, w[1:])]


def brute_resample(rows, target):
    def count(texts):
        return Counter(zlib.crc32(g) % 10000 for t in texts for g in grams(t)[1])
    s, t = count(x[1] for x in rows), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for i, text in rows:
        n_words, g = grams(text)
        weight = sum(gain(zlib.crc32(x) % 10000) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    fit = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    ranks = {id(x): k + 1 for k, x in enumerate(fit[:25 * len(fit) // 100])}
    return sorted(((x[0], x[1], x[2], x[3], ranks.get(id(x))) for x in out), key=repr)


def test_resampling_equals_brute_force(spark, docs):
    target = spark.createDataFrame([(1, "The naïve x1 the x1 日本"), (2, None), (3, "don't a-b " * 30)], "item_id long, text string")
    out = resample.resample(docs, target)
    assert out.columns == ["row", "n_words", "n_features", "weight", "score", "rank"]
    assert out.select("row.*").columns == [c for c in docs.columns if c != "text"]
    got = sorted(((r.row.doc_id, r.n_features, r.weight, r.score, r.rank) for r in out.collect()), key=repr)
    assert got == brute_resample([r[:2] for r in awkward()], ["The naïve x1 the x1 日本", None, "don't a-b " * 30])


def test_resampling_query_and_empty_tables(spark, docs):
    out = queries.op11_importance_resampling(spark, SF)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in out.collect()), key=repr)
    assert got == brute_resample(rows, target)
    assert [t for _, t in out.dtypes] == ["bigint"] * 6
    none = docs.limit(0)
    assert resample.resample(none, none).count() == 0
    assert resample.resample(docs, none).count() == docs.count()


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_scan_composes_every_feature(monkeypatch, block):
    """Blocks that cut texts, words longer than the dictionary takes, and a dictionary that fills up."""
    monkeypatch.setattr(resample, "BLOCK", block)
    monkeypatch.setattr(resample, "_FIRST", 16)
    monkeypatch.setattr(resample, "MAX_WORDS", 300)
    rng = random.Random(3)
    texts = ["", "a" * 500 + " b " + "c" * 200] + ["".join(rng.choices("ab C-é日9", k=rng.randint(0, 400))) for _ in range(300)]
    words = resample.Dictionary()
    for n in (1, 2, 3):
        got = [[] for _ in texts]
        for _, owner, codes in resample.features([np.frombuffer(t.encode(), np.uint8) for t in texts], words, n):
            for k, c in zip(owner.tolist(), codes.tolist(), strict=True):
                got[k].append(c)
        for t, have in zip(texts, got, strict=True):
            w = grams(t)[1][:grams(t)[0]]
            want = [zlib.crc32(b" ".join(w[i:i + k])) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
            assert sorted(have) == sorted(want)
    assert 0 < len(words.crc) <= 300


# ------------------------------------------------------------------ 12

def brute_partition(sizes, shards):
    """Greedy cuts at the smallest capacity; a group above it is a shard of its own."""
    def run(capacity):
        cuts, i = [], 0
        for _ in range(shards):
            first, have = i, 0
            while i < len(sizes) and (have + sizes[i] <= capacity or i == first):
                have += sizes[i]
                i += 1
                if have > capacity:
                    break
            cuts.append(i)
        return cuts
    return next(c for c in map(run, range(sum(sizes) + 1)) if c[-1] >= len(sizes))


def brute_shards(rows, shards):
    key = {t: int(hashlib.md5(t.encode()).hexdigest()[:16], 16) >> 1 for t in {t or "" for _, t in rows}}
    sizes = Counter()
    for _, t in rows:
        sizes[key[t or ""]] += len((t or "").encode()) + 8
    order = sorted(sizes)
    cuts = brute_partition([sizes[k] for k in order], shards)
    of = {k: sum(c <= i for c in cuts) for i, k in enumerate(order)}
    out, slots = [], Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key[r[1] or ""])):
        s = of[key[t or ""]]
        out.append((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), s, slots[s]))
        slots[s] += 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("cells", [16, 1 << 16])
@pytest.mark.parametrize("shards", [1, 5, 24, 500])
def test_shards_equal_brute_force(docs, shards, cells):
    out = sharding.assign(docs, shards, cells=cells)
    assert out.select("row.*").columns == [c for c in docs.columns if c != "text"]
    got = sorted(((r.row.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out.collect()), key=repr)
    assert got == brute_shards([r[:2] for r in awkward()], shards)


def test_minimax_over_random_sizes():
    rng = random.Random(0)
    for _ in range(300):
        n, shards = rng.randint(0, 40), rng.randint(1, 8)
        order = sorted(rng.sample(range(1 << 20), n))
        sizes = [rng.choice([rng.randint(1, 9), rng.randint(1, 60), 200]) for _ in order]
        known = sharding.Ranges([(k, k, s) for k, s in zip(order, sizes, strict=True)])
        assert not known.open_ranges(shards)
        assert known.borders(shards) == [order[c] for c in brute_partition(sizes, shards) if c < n]
        low = known.least(shards)  # no contiguous partition has a smaller largest shard
        best = max([low, *sizes]) if n else 0
        parts = np.diff([0, *known.cuts(low, shards)])
        assert parts.max(initial=0) <= best


def test_sharding_query_writer_and_empty_table(spark, docs, tmp_path):
    out = queries.op12_sharding(spark, SF)
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
                                "slot": "bigint", "grown_shard": "int"}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in out.collect()), key=repr)
    assert got == brute_shards(rows, 24)
    assert sharding.assign(docs.limit(0)).count() == 0
    folder = str(tmp_path / "shards")
    sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), folder, 24, files=30)
    back = spark.read.parquet(folder)
    want = {i: s for i, _, _, s, _ in got}
    assert {r.doc_id: r.shard for r in back.collect()} == want and back.count() == len(rows)


# ------------------------------------------------------------------ 13

def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(BYTE_BPE_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    spell = {c: bytes([x]) for c, x in align.byte_level_alphabet().items()}
    name = {v: k for k, v in a.get_vocab().items()}
    per, held, most = [], Counter(), Counter()
    for i, t in rows:
        groups = []
        if t:
            x = a.encode(" " + t, add_special_tokens=False).ids
            y = b.encode(t)
            xs = [b"".join(spell[c] for c in name[k]) for k in x]
            ys = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()
                  for k, p in ((k, b.id_to_piece(k)) for k in y)]
            if b"".join(xs) == b"".join(ys) == (" " + t).encode():
                xe, ye = np.cumsum([len(z) for z in xs]).tolist(), np.cumsum([len(z) for z in ys]).tolist()
                p = q = 0
                for e in sorted(set(xe) & set(ye)):
                    p1, q1 = xe.index(e) + 1, ye.index(e) + 1
                    groups.append((x[p:p1], y[q:q1]))
                    p, q = p1, q1
        links = [(u, v) for g in groups for u in g[0] for v in g[1]]
        held.update(set(links))
        per.append((i, groups, links))
    for (u, _), n in held.items():
        most[u] = max(most[u], n)
    out = []
    for i, groups, links in per:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links),
                    sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), text))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_pairs", [1 << 20, 20, 0])
def test_alignment_equals_brute_force(monkeypatch, docs, hot_pairs):
    out = align.aligned(docs, BYTE_BPE_PATH, MODEL_PATH, hot_pairs=hot_pairs)
    assert out.select("row.*").columns == [c for c in docs.columns if c != "text"]
    got = sorted(((r.row.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)
                  for r in out.collect()), key=repr)
    assert got == brute_alignment([r[:2] for r in awkward()])


def test_alignment_query_and_empty_table(spark, docs):
    out = queries.op13_token_alignment(spark, SF)
    assert [t for c, t in out.dtypes if c != "groups_sha256"] == ["bigint"] * 7
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(*x[:7], hashlib.sha256(x[7].encode()).hexdigest() if x[7] else "") for x in brute_alignment(rows)]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert align.aligned(docs.limit(0), BYTE_BPE_PATH, MODEL_PATH).count() == 0


def test_units_encode_like_whole_texts(monkeypatch):
    with open(BYTE_BPE_PATH, "rb") as f, open(MODEL_PATH, "rb") as g:
        tok = align.Tokenizers(f.read(), g.read())
    assert tok.cuttable
    rng = random.Random(2)
    odd = ["a", "B", "9", " ", " ", "  ", "\n", "\t", "\xa0", "\u2009", "\x1c", "'", "'s", "é", "日", "\u0301", "🙂", ".", "\x00", "\u200b", "ß"]
    texts = [t for _, t, *_ in awkward() if t] + ["".join(rng.choices(odd, k=rng.randint(1, 60))) for _ in range(3000)]
    for size, memo in ((7, 1 << 17), (50, 40)):
        monkeypatch.setattr(align, "PART", size)
        monkeypatch.setattr(align, "MEMO", memo)
        for text in texts:
            units = tok.units(text)
            assert " ".join(units) == text
            tok.learn(units)
            whole = tok._encode([text])[0]
            got = [tok.encode(part) for part in align._parts(units)]
            if whole is None:
                assert None in got
                continue
            for k in (0, 1):
                assert np.concatenate([g[k] for g in got]).tolist() == np.frombuffer(whole[k], np.int32).tolist(), text
        assert len(tok.memo) <= memo + 1000


def test_joined_units_encode_like_single_ones():
    with open(BYTE_BPE_PATH, "rb") as f, open(MODEL_PATH, "rb") as g:
        tok = align.Tokenizers(f.read(), g.read())
    rng = random.Random(3)
    parts = ["a", "B", "9", "the", "'s", "é", "日", "\u0301", "🙂", "\x00", "\u200b", "ﬁ", "…", "\t", " ", "\x1c", "<s>", "x" * 40]
    units = ["".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(2000)] + ["", " ", "a ", " a"]
    calls = []
    each, tok._encode_each = tok._encode_each, lambda u: calls.append(len(u)) or each(u)
    got = tok._encode(units)
    assert got == each(units)
    calls.clear()
    plain = [f"word{i}" for i in range(1000)]
    assert tok._encode(plain) == each(plain) and not calls  # all of them joined


def test_huge_group_and_long_stretches(monkeypatch):
    rng = np.random.default_rng(1)
    ends = np.cumsum(rng.integers(1, 9, 5000))
    assert align.align(ends, ends)[0].tolist() == [1] * 5000
    keep = np.sort(rng.choice(4999, 3000, replace=False))
    other = np.concatenate([ends[keep], ends[-1:]])
    a_of, b_of = align.align(ends, other)
    assert np.cumsum(a_of).tolist() == [*(keep + 1).tolist(), 5000] and b_of.tolist() == [1] * 3001
    a, b = rng.integers(0, 5, 40), rng.integers(0, 4, 30)
    want = Counter((u * 10 + v) for u in a.tolist() for v in b.tolist())
    for limit in (1 << 22, 100):  # as links, and as distinct ids
        monkeypatch.setattr(align, "_LINKS", limit)
        p, n = align.linked_pairs(a, b, np.array([40]), np.array([30]), 10)
        assert dict(zip(p.tolist(), n.tolist(), strict=True)) == dict(want)


def test_small_steps_cost_few_tasks(spark):
    """Components of a few edges: rounds read what was written, not a file for each of many shuffle partitions."""
    from longctx.llm.components import connected_components
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    sc, group = spark.sparkContext, "components-tasks"
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long").coalesce(1)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, group)
        found = connected_components(edges)
        seen = sc.statusTracker()
        stages = {s for j in seen.getJobIdsForGroup(group) for s in seen.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(seen.getStageInfo, stages) if i)
        assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(31)}
        assert 0 < tasks <= 1400
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_scratch_tables_are_removed(spark):
    from longctx.session import scratch_tables
    with scratch_tables(spark) as keep:
        frame = keep(spark.range(10).repartition(64))
        files = frame.inputFiles()
        assert len(files) <= 11 and sorted(r.id for r in frame.collect()) == list(range(10))
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_known_units_are_not_aligned_again(monkeypatch):
    with open(BYTE_BPE_PATH, "rb") as f, open(MODEL_PATH, "rb") as g:
        tok = align.Tokenizers(f.read(), g.read())
    units = tok.units("Some unaffordable wörds, naïvely alignable 日本語 wörds and some more")
    tok.learn(units)
    calls, real = [], align.align
    monkeypatch.setattr(align, "align", lambda *x: calls.append(1) or real(*x))
    tok.learn(units)
    row = align._Row("text")
    row.add(tok.encode(units[::-1]), tok)
    assert not calls
    a, b = (np.concatenate([np.frombuffer(tok.memo[u][k], np.int32) for u in units[::-1]]) for k in (0, 1))
    a_of, b_of = real(np.cumsum(tok.a_size[a]), np.cumsum(tok.b_size[b]))
    assert row.out()[2:5] == (len(a_of), int((a_of * b_of).sum()), align.group_text(a, b, a_of, b_of, tok.shown))


def class_rows(rng, side, count):
    """Classes of one key: tokens around the centre, most of them from one of two texts with some changed."""
    from longctx.llm import substrings as m
    reach, rows = m.REACH, []
    base = rng.integers(1, 1 << 32, (2, 2 * reach + 1), dtype=np.uint64).astype(np.uint32)
    for n in range(count):
        left, right = (int(x) for x in rng.choice([reach, reach, 30, 12], 2))
        x = base[rng.integers(2)].copy()
        change = rng.random(len(x)) < rng.choice([0, 0.06, 0.14])
        x[change] = rng.integers(1, 1 << 32, int(change.sum()))
        x[reach] = 5
        x[:reach - left], x[reach + right + 1:] = 0, 0
        d1 = int(rng.integers(0, 2 * count))
        d2 = int(rng.choice([d1, d1 + 1, d1 + 5]))
        rows.append({"side": side, "left": left, "right": right, "same": n, "lo": 0, "hi": 10 ** 6, "d1": d1, "c1": 2 * n, "d2": d2,
                     "c2": 2 * n + (d2 != d1), "k": count, "raw": x.tobytes(), "bi": 0, "bj": 0})
    return sorted(rows, key=lambda r: (r["d1"], r["c1"]))


def least_others(rows):
    """(side, same, p): the first two documents that share the range, where the first is not ``lo``."""
    from longctx.llm import substrings as m
    out = {}
    for r in rows:
        for p in range(m.MIN_TOKENS) if r["d1"] != r["lo"] else ():
            like = []
            for s in rows:
                if s["side"] == r["side"] and min(r["left"], s["left"]) >= m.REACH - p and min(r["right"], s["right"]) >= p:
                    x, y = (np.frombuffer(q["raw"], np.uint32)[p:p + m.MIN_TOKENS] for q in (r, s))
                    if int((x == y).sum()) >= m.MIN_MATCH:
                        like.append(s)
            docs = sorted({s[d] for s in like for d in ("d1", "d2")})
            if docs and docs[0] != r["lo"]:
                out[r["side"], r["same"], p] = (docs[0], docs[1] if len(docs) > 1 else None)
    return out


def test_classes_of_many_keys_are_compared_together(monkeypatch):
    import pyarrow as pa

    from longctx.llm import substrings as m
    rng = np.random.default_rng(4)
    rows = [r for side in range(40) for r in class_rows(rng, side, int(rng.integers(1, 9)))]
    kinds = {"raw": pa.binary(), **{n: pa.int32() for n in ("left", "right", "c1", "c2", "bi", "bj")}}
    table = pa.table({n: pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in rows[0]})
    calls, real = [], m._unmet
    monkeypatch.setattr(m, "_unmet", lambda *x: calls.append(1) or real(*x))
    monkeypatch.setattr(m, "_PAIRS", 50)
    got = set()
    for batch in m._compare(iter(table.to_batches(max_chunksize=60))):
        got |= {(r["side"], r["same"], p, r["o1"], r["o2"]) for r in batch.to_pylist() for p in range(r["pa"], r["pb"] + 1)}
    want = least_others(rows)
    assert want and len(calls) <= len(rows) // 60 + 2
    assert {(*k, *v) for k, v in want.items()} <= got and {k[:2] for k in got} == {k[:2] for k in want}


def test_ranges_that_no_other_class_can_share_are_not_compared(monkeypatch):
    """A phrase of 30 tokens in 600 surroundings: no range of 46 is like another, so none is held against the others."""
    import pyarrow as pa

    from longctx.llm import substrings as m
    rng = np.random.default_rng(6)
    rows = class_rows(rng, 0, 600)
    phrase = rng.integers(1, 1 << 32, 30, dtype=np.uint64).astype(np.uint32)
    for n, r in enumerate(rows):
        x = rng.integers(1, 1 << 32, 2 * m.REACH + 1, dtype=np.uint64).astype(np.uint32)
        x[m.REACH - 12:m.REACH + 18] = phrase
        r |= {"left": m.REACH, "right": m.REACH, "d1": n, "d2": n, "raw": x.tobytes()}
    kinds = {"raw": pa.binary(), **{n: pa.int32() for n in ("left", "right", "c1", "c2", "bi", "bj")}}
    asked, real = [], m._least_others
    monkeypatch.setattr(m, "_least_others", lambda ranges, i, *x: asked.append(len(i)) or real(ranges, i, *x))
    got = []
    for copied in (False, True):
        if copied:
            rows[500]["raw"] = rows[20]["raw"]
        table = pa.table({n: pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in rows[0]})
        got.append([(r["same"], r["o1"], r["o2"]) for b in m._compare(iter(table.to_batches())) for r in b.to_pylist() if r["o2"] is not None])
    assert asked == [0, 2 * m.MIN_TOKENS]
    assert got == [[], [(rows[20]["same"], 20, 500), (rows[500]["same"], 20, 500)]]


def test_minima_of_many_texts_are_their_compact_windows():
    from longctx.llm import substrings as m
    rng = np.random.default_rng(7)
    for kinds in [1, 2, 5, 50, 10000] * 40:
        width, sizes = int(rng.integers(2, 9)), rng.integers(0, 60, int(rng.integers(1, 6)))
        ends = np.cumsum(sizes)
        h = rng.integers(0, kinds, ends[-1] + width).astype(np.uint64)[:ends[-1] if ends[-1] >= width else None]
        ends[-1] = len(h)
        want = {(l + x, c + x, r + x) for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)
                for l, c, r in m.compact_windows(h[x:y], width)}
        assert {tuple(x) for x in m._minima(h, ends, width).tolist()} == want
