"""Operator 13: token alignment between two tokenizers, and corpus counts of the linked ids.

Tokenizer A (a ``tokenizers`` JSON file) encodes space + text, tokenizer B (a SentencePiece model, which adds the space
itself) the text.  Byte offsets where a token of both ends cut the tokens into groups; every A and B token of
a group are linked.

Method (diagonal run skipping): the end offsets of both are compared at the current index shift.  Probes of 8, 16, 32, ... tokens
that agree are skipped as a one-to-one stretch (one comparison of bytes each); after a probe that disagrees, halved
probes and at last single tokens find the end of the stretch.  The irregular group there is resolved token by token, the side that lags
first, until both end together, and the shift becomes the difference of the new places.  Only irregular groups
are recorded; the others follow from their number.

A text is encoded in units cut at single spaces between other characters, where no token of either tokenizer reaches
across (A's pre-tokens begin there; for B it is checked when the model is read, else texts are not cut).  Both sides end where a unit ends,
so new units are aligned in one stretch, and the ids, groups and shown groups of units that come again are remembered in a table of bounded size.  A text is aligned in parts of whole units, so memory follows ``PART``, not the
text.  Both token sequences must spell space + text; otherwise the text has no tokens.

Counts: the count of an id pair is the number of texts that hold it linked.  Encoded rows (narrow: their distinct pairs and how
often each is linked) are written to the shared folder once.  Tasks add up pairs before the shuffle.  The pairs whose
count reaches a power of two T are broadcast, T being the least with at most ``HOT_PAIRS`` such pairs, and every row is
scored against them in place; rarer pairs, each in fewer than T texts, are joined by a shuffle, in which no key is
hot.  Both ways use the same counts.

Nulls and edge cases: null and empty texts and those that a tokenizer does not spell exactly have zeros and an empty
``groups``; equal rows count each for itself; further columns, whatever their names, ride along in ``row``.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longctx.llm.spm import SPACE, load
from longctx.llm.words import pieces
from longctx.session import cut_lineage, shared_table

PART = 1 << 16
PROBE = 8
MEMO = 3 << 16  # units remembered in a generation
SHORT = 32  # characters of a unit that is remembered
RUN = 64  # short units encoded in one call
HOT_PAIRS = 1 << 20
_LINKS = 1 << 22  # links expanded at once


def byte_level_alphabet() -> dict[str, int]:
    """Character to byte of byte-level BPE vocabularies.

    Fixed rule of the format: printable Latin-1 bytes stand for themselves, the others for U+0100 on, in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(shown)]
    return {chr(x): x for x in shown} | {chr(0x100 + k): x for k, x in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_level_alphabet()
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab(with_added_tokens=True).values()))
        for piece, i in self.a.get_vocab(with_added_tokens=True).items():
            known = all(c in alphabet for c in piece)
            self.a_bytes[i] = bytes(alphabet[c] for c in piece) if known else piece.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in names) and plain_spaces(self.b)
        self.n_b = len(names)
        #: Decimal ids followed by each of the three separators.
        self.shown = [f"{i}{sep}" for sep in ",|;" for i in range(max(len(self.a_bytes), len(names)))]
        #: Ids of both, sizes of the groups on both sides, and the shown groups of a unit.
        self.memo: dict[str, tuple[bytes, bytes, bytes, bytes, str] | None] = {}
        self.older: dict[str, tuple[bytes, bytes, bytes, bytes, str] | None] = {}
        self.long: list[str] = []

    def units(self, text: str) -> list[str]:
        """The text without the spaces at which it is cut."""
        return _CUT.split(text) if self.cuttable else [text]

    def _encode(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both tokenizers as int32 bytes; None where the tokens of one do not spell space + unit."""
        if not units:
            return []
        if not self.cuttable:
            return self._encode_each(units)
        runs = list(_runs(units))
        joined = [" ".join(r) for r in runs]
        x = [e.ids for e in self.a.encode_batch_fast([" " + t for t in joined], add_special_tokens=False)]
        y = self.b.encode(joined, num_threads=1)
        out = []
        for run, a, b in zip(runs, x, y, strict=True):
            want = [(" " + t).encode() for t in run]
            ends = np.cumsum([len(t) for t in want])
            a, b = _cut_at(ends, want, a, self.a_bytes, self.a_size), _cut_at(ends, want, b, self.b_bytes, self.b_size)
            out += self._encode_each(run) if a is None or b is None else zip(a, b, strict=True)
        return out

    def _encode_each(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        spaced = [" " + t for t in units]
        want = [t.encode() for t in spaced]
        ends = np.cumsum([len(t) for t in want])
        x = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        y = self.b.encode(units, num_threads=1)
        sides = []
        for ids, names, sizes in ((x, self.a_bytes, self.a_size), (y, self.b_bytes, self.b_size)):
            flat = list(chain.from_iterable(ids))
            codes, stops = np.array(flat, np.int32), np.cumsum([len(i) for i in ids])
            spelled = np.concatenate([[0], np.cumsum(sizes[codes])])[stops]
            cut = _cut_ids(codes, stops)
            if b"".join(map(names.__getitem__, flat)) != b"".join(want) or (spelled != ends).any():  # unit by unit
                cut = [c if b"".join(map(names.__getitem__, i)) == w else None for c, i, w in zip(cut, ids, want, strict=True)]
            sides.append(cut)
        return [None if a is None or b is None else (a, b) for a, b in zip(*sides, strict=True)]

    def learn(self, units: list[str]) -> None:
        """Make the ids of all these units known; those of short ones stay for two generations."""
        for u in self.long:
            del self.memo[u]
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        memo, older, new = self.memo, self.older, []
        for u in set(units).difference(memo):
            if u in older:
                memo[u] = older[u]
            else:
                new.append(u)
        memo.update(zip(new, self._aligned(self._encode(new)), strict=True))
        self.long = [u for u in new if len(u) > SHORT]

    def _aligned(self, ids: list[tuple[bytes, bytes] | None]) -> list[tuple[bytes, bytes, bytes, bytes, str] | None]:
        """The ids of units with their groups: all are aligned in one stretch, since both sides end where a unit ends."""
        known = [x for x in ids if x is not None]
        found = []
        for lo in range(0, len(known), PART):
            part = known[lo:lo + PART]
            raw_a, raw_b = zip(*part, strict=True)
            a, b = np.frombuffer(b"".join(raw_a), np.int32), np.frombuffer(b"".join(raw_b), np.int32)
            a_of, b_of = align(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
            stops = np.searchsorted(np.cumsum(a_of), np.cumsum([len(x) for x in raw_a]) // 4) + 1
            shown = group_text(a, b, a_of, b_of, self.shown, stops - 1).split("\n")
            once: dict[bytes, bytes] = {}  # most units have the same sizes
            of_a, of_b = ([once.setdefault(x, x) for x in _cut_ids(n.astype(np.int32), stops)] for n in (a_of, b_of))
            found += zip(raw_a, raw_b, of_a, of_b, shown, strict=True)
        rest = iter(found)
        return [None if x is None else next(rest) for x in ids]

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str] | None:
        """Ids, sizes of groups and shown groups of a stretch of known units; None if one of them is not spelled exactly."""
        found = list(map(self.memo.__getitem__, units))
        if None in found:
            return None
        *sides, shown = zip(*found, strict=True)
        return *(np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in sides), ";".join(shown)


_kept: dict[tuple, Tokenizers] = {}


def _tokenizers(a_json: bytes, b_model: bytes) -> Tokenizers:
    """The tokenizers of a worker, which stay with the units they know from one task to the next; of one pair at a time."""
    key = (len(a_json), zlib.crc32(a_json), len(b_model), zlib.crc32(b_model))
    if key not in _kept:
        _kept.clear()
        _kept[key] = Tokenizers(a_json, b_model)
    return _kept[key]


_CUT = re.compile(r"(?<=\S) (?=\S)")


def _runs(units: list[str]) -> Iterator[list[str]]:
    """The units in order, up to ``RUN`` short ones together, which can be joined by the spaces at which texts are cut."""
    run = []
    for u in units:
        if u and len(u) <= SHORT and u.strip() == u:
            run.append(u)
            if len(run) == RUN:
                yield run
                run = []
        else:
            if run:
                yield run
                run = []
            yield [u]
    if run:
        yield run


def _cut_at(ends: np.ndarray, want: list[bytes], ids: list[int], names: list[bytes], sizes: np.ndarray) -> list[bytes] | None:
    """The ids of joined units cut where a unit ends; None if they do not spell every unit."""
    codes = np.array(ids, np.int32)
    size = sizes[codes]
    if not len(ids) or not size.all() or b"".join(map(names.__getitem__, ids)) != b"".join(want):
        return None
    token_ends = np.cumsum(size)
    last = np.searchsorted(token_ends, ends)
    return _cut_ids(codes, last + 1) if (token_ends[last] == ends).all() else None


def _cut_ids(codes: np.ndarray, stops: np.ndarray) -> list[bytes]:
    raw, at = codes.tobytes(), (4 * stops).tolist()
    return [raw[a:b] for a, b in zip([0, *at], at)]


def plain_spaces(model) -> bool:
    """Whether the model keeps single spaces as they are and puts one before the text."""
    return [model.id_to_piece(i) for i in model.encode("a")][:1] and all(
        model.decode(model.encode(t)) == t for t in ("a b", "a  b", " a b ", "a\tb"))


def _parts(units: list[str]) -> Iterator[list[str]]:
    """Runs of units of about ``PART`` characters."""
    if 0 < sum(map(len, units)) + len(units) < PART:
        yield units
        return
    part, size = [], 0
    for u in units:
        part.append(u)
        size += len(u) + 1
        if size >= PART:
            yield part
            part, size = [], 0
    if part:
        yield part


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of A and of B tokens of every group; both arrays of ends rise strictly to the same last end."""
    n_a, n_b = len(a_ends), len(b_ends)
    xs, ys = [*a_ends.tolist(), -1], [*b_ends.tolist(), -2]  # the ends differ beyond the last token
    a_raw, b_raw = np.array(xs, "<i8").tobytes(), np.array(ys, "<i8").tobytes()
    i = j = 0
    odd = []  # places where each irregular group begins and ends
    while i < n_a:
        if xs[i] == ys[j]:  # a one-to-one stretch: gallop along the diagonal
            step = 8 * PROBE
            p, q = 8 * i, 8 * j
            while a_raw[p:p + step] == b_raw[q:q + step]:
                p, q, step = p + step, q + step, step * 2
            while step > 8 * PROBE:  # the stretch ends within this probe
                step //= 2
                if a_raw[p:p + step] == b_raw[q:q + step]:
                    p, q = p + step, q + step
            i, j = p // 8, q // 8
            while xs[i] == ys[j]:
                i += 1
                j += 1
        else:
            i0, j0, x, y = i, j, xs[i], ys[j]
            while x != y:
                if x < y:
                    i += 1
                    x = xs[i]
                else:
                    j += 1
                    y = ys[j]
            i, j = i + 1, j + 1
            odd += (i0, j0, i, j)
    starts_a, starts_b, stops_a, stops_b = np.array(odd, np.int64).reshape(-1, 4).T
    a_n, b_n = stops_a - starts_a, stops_b - starts_b
    at = starts_a - np.cumsum(a_n - 1) + (a_n - 1)  # every token before a group is in a group of its own, but for irregular ones
    a_of, b_of = (np.ones(n_a - int((a_n - 1).sum()), np.int64) for _ in range(2))
    a_of[at], b_of[at] = a_n, b_n
    return a_of, b_of


def group_text(a: np.ndarray, b: np.ndarray, a_of: np.ndarray, b_of: np.ndarray, shown: list[str],
               last: np.ndarray | None = None) -> str:
    """``a1,a2|b1;a3|b2,b3``: decimal ids in order.  ``shown``: all ids before a comma, a bar, a semicolon.

    A line ends after each of the groups ``last`` (rising, the last of all among them).
    """
    if not len(a_of):
        return ""
    size = len(shown) // 3
    a_end, b_end = np.cumsum(a_of), np.cumsum(b_of)
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.repeat(b_end - b_of, a_of)] = a
    out[np.arange(len(b)) + np.repeat(a_end, b_of)] = b
    out[a_end - 1 + b_end - b_of] += size
    out[a_end + b_end - 1] += 2 * size
    words = list(map(shown.__getitem__, out.tolist()))
    if last is not None:
        for k in (a_end + b_end - 1)[last[:-1]].tolist():
            words[k] = words[k][:-1] + "\n"
    return "".join(words)[:-1]


def linked_pairs(a: np.ndarray, b: np.ndarray, a_of: np.ndarray, b_of: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs ``a * n_b + b`` of all links, rising, and how many links have each."""
    links = a_of * b_of
    a_at, b_at = np.cumsum(a_of) - a_of, np.cumsum(b_of) - b_of
    one = links == 1
    found = [a[a_at[one]] * n_b + b[b_at[one]]]
    many = np.flatnonzero(~one)
    total = np.cumsum(links[many])
    pairs, times = [], []
    lo = 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _LINKS, "right")))
        g = many[lo:hi]
        if hi == lo + 1 and links[g[0]] > _LINKS:  # one huge group: its distinct ids, never its links
            u, un = np.unique(a[a_at[g[0]]:a_at[g[0]] + a_of[g[0]]], return_counts=True)
            v, vn = np.unique(b[b_at[g[0]]:b_at[g[0]] + b_of[g[0]]], return_counts=True)
            pairs.append((u[:, None] * n_b + v[None, :]).ravel())
            times.append((un[:, None] * vn[None, :]).ravel())
        else:
            k = np.arange(int(links[g].sum())) - np.repeat(np.cumsum(links[g]) - links[g], links[g])
            width = np.repeat(b_of[g], links[g])
            found.append(a[np.repeat(a_at[g], links[g]) + k // width] * n_b + b[np.repeat(b_at[g], links[g]) + k % width])
        lo = hi
    u, n = np.unique(np.concatenate(found), return_counts=True)
    return _merged([u, *pairs], [n, *times])


def _merged(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``times`` by pair, pairs rising."""
    if len(pairs) == 1:
        return pairs[0], times[0].astype(np.int64)
    p, n = np.concatenate(pairs), np.concatenate(times)
    u, at = np.unique(p, return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, at, n)
    return u, total


class _Row:
    """What is known of one text while its parts arrive."""

    def __init__(self, groups: str):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.pairs, self.times, self.fine = [], [], True
        self.text = [] if groups == "text" else None
        self.sha = hashlib.sha256() if groups == "sha256" else None

    def add(self, both, tok: Tokenizers) -> None:
        if both is None or not self.fine:
            self.fine = False
            return
        a, b, a_of, b_of, shown = both
        if self.sha is not None:
            self.sha.update((";" * bool(self.n_groups) + shown).encode())
        else:
            self.text.append(shown)
        self.n_a, self.n_b, self.n_groups = self.n_a + len(a), self.n_b + len(b), self.n_groups + len(a_of)
        self.n_links += int((a_of * b_of).sum())
        p, n = linked_pairs(a, b, a_of, b_of, tok.n_b)
        self.pairs.append(p)
        self.times.append(n)
        if len(self.pairs) >= 16:
            p, n = _merged(self.pairs, self.times)
            self.pairs, self.times = [p], [n]

    def out(self):
        if not self.fine or not self.n_groups:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        shown = self.sha.hexdigest() if self.sha is not None else ";".join(self.text)
        return self.n_a, self.n_b, self.n_groups, self.n_links, shown, *_merged(self.pairs, self.times)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, np.concatenate([*arrays, np.zeros(0, np.int64)]))


def encoded(docs: DataFrame, a_path: str, b_path: str, keep: list[str] | None = None, text: str = "text",
            groups: str = "text") -> DataFrame:
    """Struct ``row`` of ``keep`` (default all but the text), ``n_a, n_b, n_groups, n_links``, ``groups`` (as text, or its
    ``sha256`` in hex), and the distinct linked ``pairs`` (a id * size of B + b id) with the ``times`` each is linked.

    Both tokenizer files are broadcast (a vocabulary, whatever the input).
    """
    if groups not in ("text", "sha256"):
        raise ValueError(f"groups must be text or sha256, not {groups!r}")
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((load(spark, a_path), load(spark, b_path)))
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).cast("string").alias("text"))

    def run(batches):
        tok = _tokenizers(*files.value)
        for batch in pieces(batches, 64):
            found = [_Row(groups) for _ in range(batch.num_rows)]
            cut = [tok.units(t) if t else [] for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(cut):  # some texts at a time, so that a long one is looked up by itself
                upto, size = at, 0
                while upto < len(cut) and (upto == at or size + len(cut[upto]) <= PART):
                    size += len(cut[upto])
                    upto += 1
                tok.learn([u for units in cut[at:upto] for u in units])
                for k in range(at, upto):
                    for part in _parts(cut[k]):
                        found[k].add(tok.encode(part), tok)
                    cut[k] = None
                at = upto
            n_a, n_b, n_groups, n_links, shown, pairs, times = zip(*(r.out() for r in found), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)),
                 pa.array(shown, pa.string()), _lists(pairs), _lists(times)], names=schema.names)

    long = T.LongType()
    schema = T.StructType([rows.schema["row"]] + [T.StructField(c, long) for c in ("n_a", "n_b", "n_groups", "n_links")]
                          + [T.StructField("groups", T.StringType())]
                          + [T.StructField(c, T.ArrayType(long)) for c in ("pairs", "times")])
    return rows.mapInArrow(run, schema)


def _flat(col) -> np.ndarray:
    return np.asarray(col.flatten())


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): texts that hold the pair, and whether no pair of its A id has more.

    A task adds up what it reads in tables of bounded size before anything is shuffled.
    """
    def run(batches):
        pairs, times, size = [], [], 0
        for batch in pieces(batches, 1024):
            u, n = np.unique(_flat(batch.column(0)), return_counts=True)
            pairs.append(u)
            times.append(n)
            size += len(u)
            if size > HOT_PAIRS or len(pairs) >= 64:
                u, n = _merged(pairs, times)
                pairs, times, size = [u], [n], len(u)
                if size > HOT_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["pair", "n"])
                    pairs, times, size = [], [], 0
        if pairs:
            u, n = _merged(pairs, times)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n, pa.int64())], names=["pair", "n"])

    part = rows.select("pairs").mapInArrow(run, "pair long, n long")
    counts = cut_lineage(part.groupBy("pair").agg(F.sum("n").alias("n")))
    a_id = F.floor(F.col("pair") / n_b)
    top = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))  # at most one row an A id
    return counts.withColumn("a_id", a_id).join(F.broadcast(top), "a_id").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def hot_bound(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach."""
    by_size = counts.groupBy(F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    total, bound = 0, 0
    for r in sorted(by_size.collect(), reverse=True):  # at most 64 rows
        total += r["m"]
        if total > most:
            bound = r["k"] + 1
            break
    return 1 << bound


def aligned(docs: DataFrame, a_path: str, b_path: str, keep: list[str] | None = None, text: str = "text",
            groups: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``row, n_a, n_b, n_groups, n_links, groups``, ``n_best`` (links whose pair has the highest count of its A id, ties
    included) and ``count_sum`` (counts summed over links)."""
    spark = docs.sparkSession
    import sentencepiece
    n_b = sentencepiece.SentencePieceProcessor(model_proto=load(spark, b_path)).get_piece_size()
    rows, _ = shared_table(encoded(docs, a_path, b_path, keep, text, groups).withColumn(
        "at", F.monotonically_increasing_id()), "aligned")  # written, so the ids stay
    counts = cut_lineage(pair_counts(rows, n_b))
    bound = hot_bound(counts, hot_pairs)
    hot = counts.where(F.col("n") >= bound).toArrow()  # at most hot_pairs rows
    order = np.argsort(hot["pair"].to_numpy())
    table = spark.sparkContext.broadcast(tuple(hot[c].to_numpy()[order] for c in ("pair", "n", "best")))
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def look_up(pairs):
        known, n, best = table.value
        if not len(known):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool), np.zeros(len(pairs), bool)
        k = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
        hit = known[k] == pairs
        return np.where(hit, n[k], 0), hit & best[k], hit

    def score(batches):
        for batch in pieces(batches, 1024):
            lists = batch.column("pairs")
            pairs, times = _flat(lists), _flat(batch.column("times"))
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            n, best, _ = look_up(pairs)
            n_best, total = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            np.add.at(n_best, owner[best], times[best])
            np.add.at(total, owner, times * n)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ["row", "at", *numbers, "groups"]]
                                             + [pa.array(n_best), pa.array(total)], names=scored_schema.names)

    def rare(batches):
        for batch in pieces(batches, 1024):
            lists = batch.column("pairs")
            pairs, times = _flat(lists), _flat(batch.column("times"))
            owner = np.repeat(np.asarray(batch.column("at")), np.asarray(lists.value_lengths()))
            left = ~look_up(pairs)[2]
            yield pa.RecordBatch.from_arrays([pa.array(x[left]) for x in (owner, pairs, times)], names=["at", "pair", "times"])

    scored_schema = T.StructType([rows.schema["row"], T.StructField("at", T.LongType())]
                                 + [T.StructField(c, T.LongType()) for c in numbers] + [T.StructField("groups", T.StringType())]
                                 + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])
    scored = rows.mapInArrow(score, scored_schema)
    cold = counts.where(F.col("n") < bound)
    more = (rows.select("at", "pairs", "times").mapInArrow(rare, "at long, pair long, times long").join(cold, "pair")
            .groupBy("at").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                               F.sum(F.col("times") * F.col("n")).alias("more_sum")))
    out = scored.join(more, "at", "left")
    return out.select("row", *numbers, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                      (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups")
