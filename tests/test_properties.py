"""Properties of the dilution operator and the matrix."""

from conftest import SF001
from pyspark.sql import functions as F

from longctx.operators import dilute
from longctx.plans import catalog
from longctx.sources import fixtures as fx
from longctx.spec import fixture_spec


def _pages(spark, parts):
    spec = fixture_spec()
    return dilute.context_pages(fx.case_pages_df(spark, SF001), fx.filler_pages_df(spark, SF001),
                                spec.ratios_df(spark), seed=spec.seed, filler_subdir="web", num_partitions=parts)


def test_deterministic_under_partitioning(spark):
    a = dilute.context_summary(_pages(spark, 2)).collect()
    b = dilute.context_summary(_pages(spark, 7)).collect()
    assert sorted(a) == sorted(b)


def test_page_counts_and_order(spark):
    pages = _pages(spark, 3)
    s = {(r.case_uuid, r.ratio_key): r for r in dilute.context_summary(pages).collect()}
    for r in s.values():
        assert r.n_pages == r.n_real + r.n_filler
        if r.ratio_key == "0":
            assert r.n_filler == 0
    real = pages.where(~F.col("is_filler")).select("case_uuid", "ratio_key", "ord", "source_file").collect()
    by = {}
    for r in real:
        by.setdefault((r.case_uuid, r.ratio_key), []).append((r.ord, r.source_file))
    for rows in by.values():  # real pages keep their file-name order
        files = [f for _, f in sorted(rows)]
        assert files == sorted(files)
    ords = pages.groupBy("case_uuid", "ratio_key").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"),
                                                       F.count("*").alias("n")).collect()
    assert all(r.lo == 0 and r.hi == r.n - 1 for r in ords)  # dense ordinals


def test_ratio_zero_is_plain_concatenation(spark):
    pages = _pages(spark, 3).where("ratio_key = '0'")
    full = dilute.context_text(dilute.attach_text(pages, fx.case_pages_df(spark, SF001),
                                                  fx.filler_pages_df(spark, SF001), "web"))
    got = {r.case_uuid: r.context_text for r in full.collect()}
    cp = fx.case_pages_df(spark, SF001).collect()
    exp = {}
    for r in sorted(cp, key=lambda r: (r.case_uuid, r.summary_file)):
        exp.setdefault(r.case_uuid, []).append(r.summary_text)
    assert got == {k: "\n\n".join(v) for k, v in exp.items()}


def test_matrix_ids_unique_and_ordinals_dense(spark):
    cells = catalog.fixture_matrix(spark, SF001)
    agg = cells.agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"),
                    F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi")).collect()[0]
    assert agg.n == agg.ids == agg.hi and agg.lo == 1
