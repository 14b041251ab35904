"""Operator 10: near-duplicate documents by MinHash.

1. A document's set is its distinct 5-word shingles (A-Z lower-cased), hashed to 64 bits.
   ``NUM_HASHES`` universal hash functions ``(a*x + b) mod 2**64`` give its signature (top 32
   bits of each minimum).
2. Documents with the same set (equal 128-bit digest and size) are one node, its least id.
3. Bands of ``ROWS`` signature values are bucket keys.  ``BANDS`` bands miss a pair at the
   threshold 0.75 with probability ``(1 - 0.75**3)**24`` = 2e-6.
4. Inside a bucket no all-pairs step runs.  Its hub (the document whose buckets hold most
   documents, which is the origin of a group of copies) is compared with every other member, however
   unlike, by both full sets.  So a group of copies costs about one pair per copy.
5. Two members x, y that are still in different components can only be linked if they share a
   shingle that the hub lacks, or if the sizes of what they share with the hub allow it.  The few
   pairs of the second kind come from a join on (hub, size) and are compared.  Members of the
   first kind meet under (hub, added shingle); there, those outside the main component are compared
   with the 1st, then up to the ``STEP``-th, ``STEP**2``-th, ... member, until they join it or have met
   all.  No link that could change a component is left out.  Pairs other than with a hub must agree
   in ``MIN_AGREE`` signature values first (a pair at 0.75 fails this with probability 3e-7).
6. Components by alternating large-star and small-star.

Nulls and edge cases: null or blank text has an empty set and links with nothing.  Fewer than
five words are one shingle.  Rows that repeat a ``doc_id`` are one node.  Rows with a null id
are returned, unlinked, with null ``component_id`` and ``kept`` true.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longctx.llm.components import connected_components
from longctx.llm.pairs import check_against_hubs
from longctx.llm.words import byte_rows, mix, pieces, signed, text_shingles
from longctx.operators.ordinal import ordinal_within
from longctx.session import cut_lineage, free_shuffles, scratch_tables

THRESHOLD = 75  # percent
ROWS, BANDS = 3, 24
NUM_HASHES = ROWS * BANDS
MIN_AGREE = NUM_HASHES // 2
STEP = 16
_BLOCK = 512
Keep = Callable[[DataFrame], DataFrame]  # cuts the lineage of a frame

_seeds = mix(np.arange(1, 2 * NUM_HASHES + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_A, _B = (_seeds[:NUM_HASHES] | np.uint64(1))[:, None], _seeds[NUM_HASHES:][:, None]
_TESTED = "a long, b long, na long, nb long, both long, link boolean, added array<long>"
_SIG_SCHEMA = "doc_id long, n_shingles long, h1 long, h2 long, sig array<int>"


def signature(shingles: np.ndarray) -> np.ndarray:
    """Top 32 bits of the minimum of each universal hash over the set (all ones if empty)."""
    low = np.full(NUM_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        h = _A * shingles[None, at:at + _BLOCK]
        h += _B
        np.minimum(low, h.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sign(batches):
    for batch in pieces(batches):
        n, h1, h2, sigs = [], [], [], []
        for b in byte_rows(batch.column("text")):
            s = np.unique(text_shingles(b))
            m = mix(s)
            n.append(len(s))
            h1.append(m.sum(dtype=np.uint64))
            h2.append(np.bitwise_xor.reduce(mix(m)) if len(m) else np.uint64(0))
            sigs.append(signature(s))
        flat = pa.array(np.concatenate(sigs))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(signed(np.array(h1, np.uint64))),
            pa.array(signed(np.array(h2, np.uint64))),
            pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * NUM_HASHES), flat),
        ], names=["doc_id", "n_shingles", "h1", "h2", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig) of every row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(_sign, _SIG_SCHEMA)


def _confirm(members: pa.Table, hubs: pa.Table) -> pa.Table:
    """Both full sets of each pair: sizes, common size, whether they are linked, and what only the member has.

    An id with several texts is taken with the text that has most in common with the other side.
    """
    rows = {k: [] for k in ("a", "b", "na", "nb", "both", "link", "added")}
    sets = [np.unique(text_shingles(x)) for x in byte_rows(hubs.column("hub_text"))]
    if sets:
        hub = hubs.column("id")[0].as_py()
        for i, x in zip(members.column("mem").to_pylist(), byte_rows(members.column("text")), strict=True):
            s = np.unique(text_shingles(x))
            t = max(sets, key=lambda t: len(np.intersect1d(t, s, assume_unique=True))) if len(sets) > 1 else sets[0]
            extra = np.setdiff1d(s, t, assume_unique=True)
            both = len(s) - len(extra)
            link = both > 0 and 100 * both >= THRESHOLD * (len(s) + len(t) - both)
            for k, v in zip(rows, (hub, i, len(t), len(s), both, link, signed(extra)), strict=True):
                rows[k].append(v)
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int64())]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)})


def _likely(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The ``pairs(hub, mem)`` that agree in ``MIN_AGREE`` signature values."""
    left = sigs.select(F.col("doc_id").alias("hub"), F.col("sig").alias("_sa"))
    right = sigs.select(F.col("doc_id").alias("mem"), F.col("sig").alias("_sb"))
    agree = F.size(F.filter(F.zip_with("_sa", "_sb", lambda x, y: x == y), lambda v: v))
    return pairs.join(right, "mem").join(left, "hub").where(agree >= MIN_AGREE).select("hub", "mem").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, keep: Keep) -> DataFrame:
    """Exact comparison (see ``_confirm``) of the ``pairs(hub, mem)``."""
    with scratch_tables(pairs.sparkSession) as mine:
        done = keep(check_against_hubs(mine(pairs), texts, _confirm, _TESTED, mine))
    free_shuffles(done.sparkSession)
    return done


def _links(tested: DataFrame) -> DataFrame:
    return tested.where("link").select("a", "b")


def _with_component(rows: DataFrame, doc: str, comp: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component so far of column ``doc``: its own id if it is linked to nothing."""
    return rows.join(comp.select(F.col("node").alias(doc), F.col("component").alias("_c")), doc, "left").withColumn(
        name, F.coalesce("_c", doc)).drop("_c")


def _by_size(tested: DataFrame, comp: DataFrame, keep: Keep) -> DataFrame:
    """Pairs of members of one hub that may be linked though they share nothing that the hub lacks.

    Members x and y of hub h that have i_x and i_y shingles in common with it have at most
    min(i_x, i_y) in common with each other, so y has at most ``7/3 i_x - n_x`` shingles.  Sizes are
    matched in steps of 1/32 of the hub's; only pairs within the bound come out.
    """
    t = _with_component(tested.select("a", "b", "na", "nb", "both"), "b", comp, "cb")
    t = keep(_with_component(t, "a", comp, "ca"))
    per = lambda n: F.floor(32 * n / F.col("na")).cast("int")
    late = t.where("ca <> cb").withColumn("most", F.floor(F.col("both") * 175 / 75) - F.col("nb")).where(
        "100 * most >= 75 * nb").select("a", F.col("b").alias("hub"), F.col("nb").alias("n"), F.col("both").alias("i"),
                                        F.col("cb").alias("c"), F.explode(F.sequence(per(F.col("nb") * 0.75), per(
                                            F.col("most")))).alias("step"))
    every = t.select("a", F.col("b").alias("mem"), "nb", "both", "cb", "ca", per(F.col("nb")).alias("step"))
    m = F.least("i", "both")
    return late.join(every, ["a", "step"]).where((F.col("c") != F.col("cb")) & (
        100 * m >= THRESHOLD * (F.col("n") + F.col("nb") - m))).select("hub", "mem").distinct()


def _by_additions(tested: DataFrame, comp: DataFrame, keep: Keep) -> DataFrame:
    """(key, doc): members of one hub that share a shingle the hub lacks, where components still differ.

    A partner of x has at least ``0.75 n_x`` shingles in common with it, so at least ``0.75 n_x - i_x`` of
    those the hub lacks.  Hence x need not be entered under that many (less one) of its shingles, if
    all members leave out the last ones of one order: by how many members share a shingle, so that
    phrases that unrelated documents have in common are left out first.
    """
    mixed = _with_component(_with_component(tested, "b", comp, "cb"), "a", comp, "ca").where("ca <> cb").select("a").distinct()
    rows = keep(_with_component(tested.join(mixed, "a", "left_semi"), "b", comp, "cb").select(
        "a", "b", "cb", (F.size("added") - F.greatest(F.ceil(0.75 * F.col("nb")) - F.col("both"), F.lit(1)) + 1).alias("upto"),
        F.size("added").alias("n"), F.explode(F.transform("added", lambda s: F.xxhash64("a", s))).alias("key")))
    keys = rows.groupBy("key").agg(F.min("cb").alias("lo"), F.max("cb").alias("hi"), F.count(F.lit(1)).alias("times")).where(
        "lo <> hi").select("key", "times")
    useful = rows.join(keys, "key")
    mine = Window.partitionBy("a", "b")  # one document's shingles
    place = F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("times", "key"))
    kept = useful.withColumn("place", place).where("place <= upto").select("key", F.col("b").alias("doc")).distinct()
    kept = keep(kept)
    met = kept.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return kept.join(met, "key", "left_semi")


def _added(links: DataFrame, comp: DataFrame, tested: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """All links and their components after another round of tests."""
    new = _links(tested)
    if new.isEmpty():
        return links, comp
    links = links.union(new)
    return links, connected_components(links, keep)


def _ranked_rounds(ranked: DataFrame, links: DataFrame, comp: DataFrame, test: Callable[[DataFrame], DataFrame],
                   keep: Keep = cut_lineage) -> DataFrame:
    """Components after members of one key in ``ranked(key, doc, rank)`` have joined or met each other.

    All meet the first member; then those outside the key's main component meet the next ones, ``STEP`` times as
    many each round.  The main is chosen once, as the component of a fixed document: it only grows, so of two
    members that are not in it together, one is late whenever the other is a target.
    """
    last, lo, mains = ranked.agg(F.max("rank")).first()[0] or 0, 0, None
    while lo <= last:
        upto = max(1, lo * STEP)
        now = _with_component(ranked, "doc", comp, "comp")
        late = now
        if lo:
            if mains is None:
                mains = keep(now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
                    F.max(F.struct("n", "comp")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select(
                    "key", F.col("m.comp").alias("first")))
            late = now.join(_with_component(mains, "first", comp, "main"), "key").where("comp <> main")
        late = late.select("key", F.col("doc").alias("mem"), F.col("comp").alias("mem_comp"))
        targets = now.where((F.col("rank") >= lo) & (F.col("rank") < upto)).select("key", F.col("doc").alias("hub"), "comp")
        pairs = late.join(targets, "key").where("hub <> mem and comp <> mem_comp").select("hub", "mem").distinct()
        links, comp = _added(links, comp, test(pairs), keep)
        lo = upto
    return comp


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept."""
    with scratch_tables(docs.sparkSession) as keep:
        out = cut_lineage(_near_duplicates(docs, keep))
    free_shuffles(docs.sparkSession)
    return out


def _near_duplicates(docs: DataFrame, keep: Keep) -> DataFrame:
    signed_docs = keep(signatures(docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    sets = signed_docs.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(
        F.min("doc_id").alias("rep"))
    nodes = keep(signed_docs.join(sets.select("h1", "h2", "n_shingles", F.col("rep").alias("doc_id")),
                                  ["h1", "h2", "n_shingles", "doc_id"], "left_semi").select("doc_id", "sig"))
    with scratch_tables(docs.sparkSession) as mine:
        pairs, weight = _bucket_pairs(nodes, keep, mine)
        sigs = keep(nodes.join(weight.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi"))
        tested = _verified(pairs, texts, keep)  # all of them: a member unlike the hub may be like another member
    links = _links(tested)
    comp = connected_components(links, keep)

    links, comp = _added(links, comp, _verified(_likely(_by_size(tested, comp, keep), sigs), texts, keep), keep)
    rest = keep(_by_additions(tested, comp, keep).join(weight, "doc"))
    ranked = keep(ordinal_within(rest, ["key"], ["bad", "doc"], "rank"))
    comp = _ranked_rounds(ranked, links, comp, lambda pairs: _verified(_likely(pairs, sigs), texts, keep), keep)

    found = sets.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("_c"))
    out = signed_docs.join(found, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _bucket_pairs(nodes: DataFrame, keep: Keep, mine: Keep) -> tuple[DataFrame, DataFrame]:
    """The pairs (hub, mem) of all buckets that several nodes share, and (doc, bad): less the sizes of a node's buckets."""
    key = [F.xxhash64(F.lit(k), *[F.col("sig")[ROWS * k + j] for j in range(ROWS)]) for k in range(BANDS)]
    rows = nodes.select(F.col("doc_id").alias("doc"), F.explode(F.array(*key)).alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("doc").alias("lo"),
                                     F.max("doc").alias("hi")).where("lo <> hi").select("key", "size")
    members = mine(rows.join(shared, "key").dropDuplicates(["key", "doc"]))
    weight = keep(members.groupBy("doc").agg((-F.sum("size")).alias("bad")))
    hubs = members.join(weight, "doc").groupBy("key").agg(F.min(F.struct("bad", "doc")).alias("h")).select(
        "key", F.col("h.doc").alias("hub"))
    return members.join(hubs, "key").where("hub <> doc").select("hub", F.col("doc").alias("mem")).distinct(), weight
