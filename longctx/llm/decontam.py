"""Operator 4: benchmark decontamination by SimHash windows, all in DataFrame functions.

1. Words are runs of letters and digits of the lower-cased text.  An item is its word sequence;
   its tokens are the 5-word shingles with their counts (fewer words: the whole sequence).
2. Windows have the length of an item.  A similar window misses at most a seventh of its shingles, so
   shingles of a document are looked up in those of all items of a length, at every ``stride``-th position
   only, with the largest stride up to ``MAX_STRIDE`` for which no similar window can escape (``_stride``).
   Every window in which few enough of the places looked up miss gets a fingerprint, wherever in the item
   the shared shingles stand, so items whose parts are in another order are found too (``_starts``).
3. A window's fingerprint is a 128-bit SimHash of its words.  It is cut in ``BLOCKS`` blocks.
   Two fingerprints that differ in at most ``RADIUS = BLOCKS - 1`` bits agree in some block, so a
   join on (length, block, value) finds all pairs within the radius.  At similarity 0.75 the
   expected distance is 8 (15 words) to 20 (59 words) bits, that of unrelated windows 64.
4. Pairs within the radius are verified: weighted Jaccard similarity (shingle counts: sum of minima
   over sum of maxima) of window and item of at least 0.75.

The benchmark's shingles are broadcast only after they were counted and found to be at most
``BROADCAST_SHINGLES`` (16 bytes each); a larger benchmark is joined by shuffle.

Nulls and edge cases: null or empty documents and items match nothing; items without a word are
ignored; repeated rows give one result row per id pair; null ids are left out of the result and
kept by ``remove_contaminated``; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longctx.llm.prefilter import key_bitmap, may_match
from longctx.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.75
BITS, BLOCKS = 128, 32
RADIUS = BLOCKS - 1
MAX_STRIDE = 4
BROADCAST_SHINGLES = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(w: str, width: int, step: int = 1) -> str:
    """SQL: (place, hash) of every run of ``width`` words of array ``w`` that starts at a multiple of ``step``."""
    run = ", ".join(f"{w}[p + {j}]" for j in range(width))
    return (f"case when size({w}) >= {width} then transform(sequence(0, size({w}) - {width}, {step}), "
            f"p -> struct(p as p, xxhash64({run}) as h)) else array() end")


def _shingles(w: str) -> Column:
    """Tokens of array column ``w``: (place, hash) of its five-word runs, or of the whole of a shorter one."""
    short = " ".join(f"when size({w}) = {k} then {_runs(w, k)}" for k in range(1, SHINGLE))
    return F.expr(f"case {short} else {_runs(w, SHINGLE)} end")


def _simhash(w: str) -> list[Column]:
    """Two longs: bit b is set if more words of ``w`` (with repeats) have it set than not."""
    half = lambda seed: F.expr(f"""aggregate(sequence(0, 63), 0L, (bits, b) -> bits | if(
        aggregate(transform({w}, x -> xxhash64(x, {seed})), 0, (votes, h) ->
        votes + cast(shiftright(h, b) & 1L as int) * 2 - 1) > 0, shiftleft(1L, b), 0L))""")
    return [half(17).alias("f1"), half(91).alias("f2")]


def _blocks() -> Column:
    """(block, value) of each of the BLOCKS blocks of f1 and f2."""
    width, per = BITS // BLOCKS, BLOCKS // 2
    one = lambda f, k: (f"struct({k} as block, shiftrightunsigned({f}, {width * (k % per)}) & {(1 << width) - 1}L as value)")
    return F.expr("array(" + ", ".join(one("f1" if k < per else "f2", k) for k in range(BLOCKS)) + ")")


def _similarity(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles, with their counts as weights."""
    total = lambda how: (f"aggregate(array_union({a}.h, {b}.h), 0, (total, x) -> total + {how}("
                         f"size(filter({a}.h, y -> y = x)), size(filter({b}.h, y -> y = x))))")
    return F.expr(f"{total('least')} / {total('greatest')}")


def _stride(sizes: list[int]) -> int:
    """Largest step g <= MAX_STRIDE such that any similar window shows a shared shingle at a multiple of g.

    A window of n shingles, or of ``a`` of them at an end of the text, is similar to n others only if it
    misses at most (4 a - 3 n) // 7, and at least a // g positions are looked up.
    """
    return max(g for g in range(1, MAX_STRIDE + 1) if g == 1 or all(
        a // g > (4 * a - 3 * n) // 7 for n in sizes for a in range(-(-3 * n // 4), n + 1)))


def _starts(hits: DataFrame, step: int) -> DataFrame:
    """(doc_id, t, n, at): all starts of windows of n words that can be similar to an item of n words.

    ``hits(doc_id, t, size, n, p)`` are the places looked up whose shingle an item of that length has, at
    whatever place.  Of the places looked up in a window at most as many miss as shingles may.
    """
    one = hits.select("doc_id", "t", "n", "p", F.expr(f"greatest(n - {SHINGLE - 1}, 1)").alias("m"), F.expr(
        f"size - least(n, {SHINGLE}) + 1").alias("len"), F.expr(f"if(n >= {SHINGLE}, {step}, 1)").alias("g")).distinct()
    one = one.withColumn("first", F.expr("greatest(p - m + 1, (3 * m + 3) div 4 - m)")).withColumn(
        "last", F.expr("least(p, len - (3 * m + 3) div 4)")).where("first <= last")
    at = one.select("doc_id", "t", "n", "m", "len", "g", F.expr("explode(sequence(int(first), int(last)))").alias("at"))
    many = at.groupBy("doc_id", "t", "n", "m", "len", "g", "at").agg(F.count(F.lit(1)).alias("hits")).withColumn(
        "lo", F.expr("greatest(at, 0)")).withColumn("hi", F.expr("least(at + m, len)"))
    return many.where("(hi + g - 1) div g - (lo + g - 1) div g - hits <= (4 * (hi - lo) - 3 * m) div 7").select("doc_id", "t", "n", "at")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word): the best window of each document and item found.

    ``docs(doc_id, text)``, ``benchmark(item_id, text)``.  start_word counts letter-digit words;
    of equally similar windows the first is given.
    """
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(
        "size(w) > 0").distinct()
    items = cut_lineage(items.select("item_id", F.size("w").alias("n"), _shingles("w").alias("s"), *_simhash("w")))
    shape = items.agg(F.collect_set("n").alias("lengths"), F.sum(F.size("s")).alias("total")).first()
    if not shape["total"]:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start_word int")
    lengths = shape["lengths"]  # as many as items have lengths
    step = _stride([n - SHINGLE + 1 for n in lengths if n >= SHINGLE])
    looks = [_runs("w", k) for k in range(1, SHINGLE) if k in lengths] + [_runs("w", SHINGLE, step)]
    seeds = items.select("n", F.expr("inline(s)")).select("n", "h").distinct()

    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("t"))
    looked = docs.select("doc_id", "t", words(F.col("text")).alias("w")).select(
        "doc_id", "t", F.size("w").alias("size"), F.expr(f"concat({', '.join(looks)})").alias("s"))
    # inline_outer: from a plain inline the optimiser infers a filter on the array and pushes it below the
    # words, which would split the text again for every place; the join drops the null rows anyway
    looked = looked.select("doc_id", "t", "size", F.inline_outer("s"))
    hits = looked.join(F.broadcast(seeds) if shape["total"] <= BROADCAST_SHINGLES else seeds, "h")
    starts = cut_lineage(_starts(hits, step).groupBy("doc_id", "t").agg(F.collect_list(F.struct("n", "at")).alias("starts")))
    held = may_match(docs, "doc_id", key_bitmap(starts, "doc_id")).select("doc_id", "t", words(F.col("text")).alias("w"))
    win = held.join(starts, ["doc_id", "t"]).select("doc_id", "t", F.inline_outer(F.expr(
        "transform(starts, x -> struct(x.n as n, x.at as at, "
        "slice(w, greatest(x.at, 0) + 1, x.n + least(x.at, 0)) as w))")))
    win = win.groupBy("doc_id", "t", "n", "at").agg(F.min("w").alias("w"))
    win = cut_lineage(win.select("doc_id", "t", "n", "at", "w", _shingles("w").alias("s"), *_simhash("w")))

    mine = win.select("doc_id", "t", "at", "n", "f1", "f2", F.inline(_blocks()))
    theirs = items.select("item_id", "n", F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.inline(_blocks()))
    close = F.bit_count(F.col("f1").bitwiseXOR(F.col("g1"))) + F.bit_count(F.col("f2").bitwiseXOR(F.col("g2"))) <= RADIUS
    near = mine.join(theirs, ["n", "block", "value"]).where(close).select("doc_id", "t", "at", "n", "item_id").distinct()
    scored = near.join(win.select("doc_id", "t", "at", "n", "s"), ["doc_id", "t", "at", "n"]).join(
        items.select("item_id", "n", F.col("s").alias("own")), ["item_id", "n"]).select(
        "doc_id", "item_id", "at", _similarity("s", "own").alias("similarity")).where(F.col("similarity") >= SIMILARITY)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.greatest("at", F.lit(0))).alias("at"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.at")).alias("start_word"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay."""
    bad = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
