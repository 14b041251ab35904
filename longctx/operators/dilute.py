"""Context dilution.

For every (case, ratio) context:

* ``n_filler = bround(n_real * ratio)`` filler pages are drawn with replacement from the
  pool (F2, F3), and ``n_filler`` insertion positions in ``[0, n_real]`` (F4).
* The k-th smallest position is paired with the k-th draw, a filler at position p goes
  before real page p, ties keep draw order (F5, W4).

Spark form, all narrow rows, no per-context arrays:

1. real pages ranked by file name inside their case, skew-safe (W3);
2. draws generated from chunked index ranges, so a context with a huge ``n_filler`` is
   spread over many tasks; each position is a keyed hash (F1), stateless;
3. one skew-safe rank over ``real ∪ draws`` ordered by ``(pos, is_real, k)`` gives every
   page its output ordinal directly; for a draw, ``ordinal - pos`` is its rank among the
   draws, i.e. its slot, and the slot picks the pool page by keyed hash (this is exactly
   the "k-th draw at the k-th smallest position" pairing);
4. slots join the pool on ``pool_ord`` (J5).  A small pool is broadcast by AQE after it
   measures the pool stage; a large pool gets uniform keys, so the sort-merge join is not
   skewed.

Text is never concatenated here.  ``context_pages`` carries an md5 and a length per page;
``context_summary`` folds them into a position-sensitive digest with ``bit_xor`` (an
algebraic aggregate, partial on the map side).  ``context_text`` builds real text and is
meant only for the prompts that are actually sent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longctx.functions.keys import hash64_text, keyed_hash
from longctx.functions.text import filler_form
from longctx.operators.ordinal import ordinal_within

DRAW_CHUNK = 1 << 16


def real_pages(case_pages: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """``(case_uuid, summary_file, page_ord, text_md5, text_len)``, ordinal by file name."""
    narrow = case_pages.select(
        "case_uuid", "summary_file",
        F.md5(F.col("summary_text")).alias("text_md5"),
        F.length("summary_text").cast("bigint").alias("text_len"),
    )
    return ordinal_within(narrow, ["case_uuid"], ["summary_file"], "page_ord", num_partitions, carry=True)


def filler_pool(filler_pages: DataFrame, subdir: str, allowed_forms: list[str] | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """S5 + P3 + dense pool ordinal: ``(subdir_name, file_name, pool_ord, text_md5, text_len)``."""
    pool = filler_pages.where(F.col("subdir_name") == F.lit(subdir))
    if allowed_forms:
        pool = pool.where(filler_form(F.col("file_name")).isin(list(allowed_forms)))
    narrow = pool.select(
        "subdir_name", "file_name",
        F.md5(F.col("ocr_text")).alias("text_md5"),
        F.length("ocr_text").cast("bigint").alias("text_len"),
    )
    return ordinal_within(narrow, ["subdir_name"], ["file_name"], "pool_ord", num_partitions, carry=True)


def contexts(real: DataFrame, ratios: DataFrame, pool_size: DataFrame) -> DataFrame:
    """F2 per (case, ratio): ``n_real``, ``n_filler`` (half-even), ``pool_size``.

    ``pool_size`` is a one-row DataFrame (column ``pool_size``); ``ratios`` the ratio
    dimension.  Both are bounded and broadcast.
    """
    per_case = real.groupBy("case_uuid").agg(F.count(F.lit(1)).alias("n_real"))
    ctx = per_case.crossJoin(F.broadcast(ratios)).crossJoin(F.broadcast(pool_size))
    n_filler = F.when(
        (F.col("ablation_ratio") > 0) & (F.col("n_real") > 0),
        F.bround(F.col("n_real") * F.col("ablation_ratio"), 0),
    ).otherwise(F.lit(0)).cast("bigint")
    return ctx.withColumn("n_filler", F.greatest(n_filler, F.lit(0).cast("bigint")))


def draws(ctx: DataFrame, seed, chunk: int = DRAW_CHUNK, num_partitions: int | None = None) -> DataFrame:
    """F3/F4 raw draws ``(case_uuid, ratio_key, k, pos)``; positions drawn in ``[0, n_real]``.

    The reference records a draw count even when the pool is empty but inserts nothing
    (Q17); here an empty pool yields no draws and is reported by the V2 checks.
    """
    n = num_partitions or int(ctx.sparkSession.conf.get("spark.sql.shuffle.partitions") or 200)
    live = ctx.where((F.col("n_filler") > 0) & (F.col("pool_size") > 0))
    chunks = (
        live.select("case_uuid", "ablation_ratio", "ratio_key", "n_real", "n_filler", "pool_size",
                    F.explode(F.sequence(F.lit(0).cast("bigint"),
                                         F.floor((F.col("n_filler") - 1) / chunk).cast("bigint"))).alias("_chunk"))
        # spread the chunks of a big context over many tasks before expanding them
        .repartition(n, "case_uuid", "ratio_key", "_chunk")
    )
    k = F.explode(F.sequence(F.col("_chunk") * chunk,
                             F.least(F.col("n_filler"), (F.col("_chunk") + 1) * chunk) - 1))
    out = chunks.select("case_uuid", "ablation_ratio", "ratio_key", "n_real", "pool_size", k.alias("k"))
    return out.withColumn(
        "pos", keyed_hash(str(seed), F.col("case_uuid"), F.col("ratio_key"), "pos", F.col("k")) % (F.col("n_real") + 1)
    )


def context_pages(
    case_pages: DataFrame,
    filler_pages: DataFrame,
    ratios: DataFrame,
    *,
    seed,
    filler_subdir: str,
    allowed_forms: list[str] | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """F7/F8 page-level contexts (the stored form).

    Columns: ``case_uuid, ablation_ratio, ratio_key, ord, is_filler, source_file, slot, pos,
    pool_ord, text_md5, text_len``.  ``slot`` is the real page ordinal or the filler's rank
    among the draws; ``pos`` the insertion position (for real pages, their own ordinal).
    """
    real = real_pages(case_pages, num_partitions)
    pool = filler_pool(filler_pages, filler_subdir, allowed_forms, num_partitions)
    pool_size = pool.agg(F.count(F.lit(1)).cast("bigint").alias("pool_size"))
    ctx = contexts(real, ratios, pool_size)
    d = draws(ctx, seed, num_partitions=num_partitions)

    real_rows = real.crossJoin(F.broadcast(ratios.select("ablation_ratio", "ratio_key"))).select(
        "case_uuid", "ablation_ratio", "ratio_key",
        F.col("page_ord").alias("pos"), F.lit(1).alias("is_real"), F.col("page_ord").alias("k"),
        F.lit(None).cast("bigint").alias("pool_size"),
        F.col("summary_file").alias("source_file"), "text_md5", "text_len",
    )
    draw_rows = d.select(
        "case_uuid", "ablation_ratio", "ratio_key", "pos", F.lit(0).alias("is_real"), "k", "pool_size",
        F.lit(None).cast("string").alias("source_file"),
        F.lit(None).cast("string").alias("text_md5"), F.lit(None).cast("bigint").alias("text_len"),
    )
    ranked = ordinal_within(real_rows.unionByName(draw_rows), ["case_uuid", "ratio_key"],
                            ["pos", "is_real", "k"], "ord", num_partitions, carry=True)

    is_filler = F.col("is_real") == 0
    slot = F.when(is_filler, F.col("ord") - F.col("pos")).otherwise(F.col("k"))
    ranked = ranked.withColumn("slot", slot).withColumn(
        "pool_ord",
        F.when(is_filler, keyed_hash(str(seed), F.col("case_uuid"), F.col("ratio_key"), "page", F.col("slot"))
               % F.col("pool_size")),
    )
    fill = ranked.where(is_filler).drop("source_file", "text_md5", "text_len").join(
        pool.select("pool_ord", F.col("file_name").alias("source_file"), "text_md5", "text_len"), "pool_ord")
    reals = ranked.where(~is_filler)
    cols = ["case_uuid", "ablation_ratio", "ratio_key", "ord", "is_filler", "source_file", "slot", "pos",
            "pool_ord", "text_md5", "text_len"]
    return (reals.unionByName(fill)
            .withColumn("is_filler", F.col("is_real") == 0)
            .select(*cols))


def context_summary(pages: DataFrame) -> DataFrame:
    """A14 + digest per context: counts, exact joined length, order-sensitive digest.

    ``n_chars`` is the length of the pages joined by a blank line; ``digest`` is
    ``bit_xor`` of hash(ord ':' md5) over the pages, so any change of page or position
    changes it, and it aggregates partially before the shuffle.
    """
    elem = hash64_text(F.concat(F.col("ord").cast("string"), F.lit(":"), F.col("text_md5")))
    return pages.groupBy("case_uuid", "ratio_key").agg(
        F.count_if(~F.col("is_filler")).alias("n_real"),
        F.count_if(F.col("is_filler")).alias("n_filler"),
        F.count(F.lit(1)).alias("n_pages"),
        (F.sum("text_len") + 2 * (F.count(F.lit(1)) - 1)).cast("bigint").alias("n_chars"),
        F.bit_xor(elem).alias("digest"),
    )


def provenance(pages: DataFrame) -> DataFrame:
    """F8: which filler page went where."""
    return pages.where("is_filler").select(
        "case_uuid", "ratio_key", "slot", "pos", "ord", "pool_ord", F.col("source_file").alias("filler_file"))


def attach_text(pages: DataFrame, case_pages: DataFrame, filler_pages: DataFrame, filler_subdir: str) -> DataFrame:
    """Join the page bodies back (real by (case, file), filler by pool file)."""
    real_txt = case_pages.select("case_uuid", F.col("summary_file").alias("source_file"),
                                 F.col("summary_text").alias("text"))
    fill_txt = filler_pages.where(F.col("subdir_name") == filler_subdir).select(
        F.col("file_name").alias("source_file"), F.col("ocr_text").alias("text"))
    r = pages.where(~F.col("is_filler")).join(real_txt, ["case_uuid", "source_file"])
    f = pages.where("is_filler").join(fill_txt, "source_file")
    return r.unionByName(f)


def context_text(pages_with_text: DataFrame, keys=("case_uuid", "ratio_key")) -> DataFrame:
    """A12/F5 text: pages joined by a blank line in ordinal order.

    One context becomes one value, so call this only on the contexts whose prompts are sent
    (the prompt itself has to exist as one string); digests and counts never need it.
    """
    parts = F.sort_array(F.collect_list(F.struct(F.col("ord"), F.col("text"))))
    return pages_with_text.groupBy(*keys).agg(
        F.array_join(F.transform(parts, lambda s: s["text"]), "\n\n").alias("context_text"))


def image_contexts(case_pages: DataFrame, case_images: DataFrame, ratios: DataFrame) -> DataFrame:
    """Every (case, ratio) of both channels: cases with pages, with images, or with both."""
    cases = case_pages.select("case_uuid").union(case_images.select("case_uuid")).distinct()
    return cases.crossJoin(F.broadcast(ratios.select("ablation_ratio", "ratio_key")))


def image_pages(pages: DataFrame, case_images: DataFrame, image_pool: DataFrame, ratios: DataFrame,
                num_partitions: int | None = None) -> DataFrame:
    """the image channel, interleaved from the draws of the text channel.

    ``pages``: ``context_pages``, whose filler rows hold the one set of draws (slot, position, pool page) that both
    channels use, so modalities are comparable.  ``case_images``: ``(case_uuid, image_file)``; ``image_pool``:
    ``(file_name)`` of the paired image pool, whose i-th file is the image of the i-th text page.  Every case
    image is there at every ratio, also of cases without text pages (no filler: the amount follows the pages) and at ratio 0.  With an
    empty image pool there are case images only.  A position beyond the last image is that of the end (Q16).  A
    draw whose image is missing from a pool that is too small yields no page (V2 reports such a pool).

    Columns: ``case_uuid, ratio_key, ord, is_filler, image_file, slot, pos``.
    """
    imgs = ordinal_within(case_images.select("case_uuid", "image_file"), ["case_uuid"], ["image_file"],
                          "img_ord", num_partitions, carry=True)
    n_img = imgs.groupBy("case_uuid").agg(F.count(F.lit(1)).alias("n_img"))
    pool = ordinal_within(image_pool.select("file_name"), [], ["file_name"], "pool_ord", num_partitions, carry=True)
    fill = (pages.where("is_filler").select("case_uuid", "ratio_key", "slot", "pos", "pool_ord")
            .join(pool, "pool_ord").join(n_img, "case_uuid", "left")
            .select("case_uuid", "ratio_key", F.least("pos", F.coalesce("n_img", F.lit(0))).alias("pos"), F.lit(0).alias("is_real"),
                    F.col("slot").alias("k"), F.col("file_name").alias("image_file")))
    real = imgs.crossJoin(F.broadcast(ratios.select("ratio_key"))).select(
        "case_uuid", "ratio_key", F.col("img_ord").alias("pos"), F.lit(1).alias("is_real"),
        F.col("img_ord").alias("k"), "image_file")
    ranked = ordinal_within(real.unionByName(fill), ["case_uuid", "ratio_key"], ["pos", "is_real", "k"],
                            "ord", num_partitions, carry=True)
    return ranked.select("case_uuid", "ratio_key", "ord", (F.col("is_real") == 0).alias("is_filler"), "image_file",
                         F.col("k").alias("slot"), "pos")


def image_summary(contexts: DataFrame, images: DataFrame) -> DataFrame:
    """Per context of ``image_contexts``: image counts and an order-sensitive digest (0 and null without images)."""
    elem = hash64_text(F.concat(F.col("ord").cast("string"), F.lit(":"), F.col("image_file")))
    per = images.groupBy("case_uuid", "ratio_key").agg(
        F.count_if(~F.col("is_filler")).alias("n_real_images"), F.count_if("is_filler").alias("n_filler_images"),
        F.bit_xor(elem).alias("image_digest"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return contexts.select("case_uuid", "ratio_key").join(per, ["case_uuid", "ratio_key"], "left").select(
        "case_uuid", "ratio_key", zero("n_real_images"), zero("n_filler_images"), "image_digest")


def image_list(images: DataFrame, keys=("case_uuid", "ratio_key")) -> DataFrame:
    """K6: the image files of a context in order, as an array and as JSON text.

    One context becomes one value: only for contexts that are sent, like ``context_text``."""
    parts = F.sort_array(F.collect_list(F.struct("ord", "image_file")))
    files = F.transform(parts, lambda x: x["image_file"])
    return images.groupBy(*keys).agg(files.alias("images")).withColumn("images_json", F.to_json("images"))


def filler_summary(contexts: DataFrame, pages: DataFrame, images: DataFrame) -> DataFrame:
    """P12 without lists: what was inserted into each context of ``image_contexts``, as counts and order-sensitive digests.

    ``text_files`` and ``image_files`` digest slot and file, ``insertion_positions`` slot and position; 0 without filler.
    """
    def digest(value):
        return F.bit_xor(F.when(F.col("is_filler"), hash64_text(F.concat(F.col("slot").cast("string"), F.lit(":"), value))))
    text = pages.groupBy("case_uuid", "ratio_key").agg(
        F.count_if(~F.col("is_filler")).alias("real_page_count"), F.count_if("is_filler").alias("filler_page_count"),
        digest(F.col("source_file")).alias("text_files"), digest(F.col("pos").cast("string")).alias("insertion_positions"))
    image = images.groupBy("case_uuid", "ratio_key").agg(digest(F.col("image_file")).alias("image_files"))
    keys = ["case_uuid", "ratio_key"]
    return (contexts.select(*keys).join(text, keys, "left").join(image, keys, "left")
            .select(*keys, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in (
                "real_page_count", "filler_page_count", "text_files", "image_files", "insertion_positions")]))
