"""Specification and referential checks (V1, V2, U3) as a violations DataFrame.

Every rule yields ``(check, subject)`` rows; an empty result means the experiment is valid.
``raise_if_invalid`` is the only action, and it fetches at most ``limit`` example rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longctx.operators.forms import available_forms, filter_forms, unknown_forms
from longctx.spec import MODALITIES, THINKING_LEVELS, ExperimentSpec

SCHEMA = "check string, subject string"


def spec_checks(spark: SparkSession, spec: ExperimentSpec) -> DataFrame:
    """V1: checks on the specification itself (a few dozen values, driver-side config)."""
    rows = []
    if not spec.thinking_default:
        rows.append(("empty_levels", "default"))
    for lv in spec.thinking_default:
        if lv not in THINKING_LEVELS:
            rows.append(("unknown_level", lv))
    for mid, levels in spec.thinking_overrides.items():
        if not levels:
            rows.append(("empty_levels", mid))
        rows += [("unknown_level", f"{mid}:{lv}") for lv in levels if lv not in THINKING_LEVELS]
    rows += [("negative_ratio", f"{r:g}") for r in spec.ratios if r < 0]
    if spec.repetitions < 1:
        rows.append(("repetitions", str(spec.repetitions)))
    if spec.filler_subdir not in spec.known_subdirs:
        rows.append(("unknown_subdir", spec.filler_subdir))
    rows += [("unknown_modality", m) for m in spec.modalities if m not in MODALITIES]
    if any(r > 0 for r in spec.ratios) and spec.seed is None:
        rows.append(("seed_required", ""))
    return spark.createDataFrame(rows, SCHEMA)


def data_checks(spark: SparkSession, spec: ExperimentSpec, prompts: DataFrame, case_pages: DataFrame,
                filler_pages: DataFrame, model_ids: list[str] | None = None, case_images: DataFrame | None = None,
                image_pool: DataFrame | None = None) -> DataFrame:
    """V2: references into the data: models, cases with prompts / pages / images, forms, pools.

    The image checks run where the image tables are given: every case needs images if a modality shows them, and the
    image pool must be as large as the text pool that it is paired with."""
    out = []
    known = {m.id for m in spec.models}
    for mid in model_ids or []:
        if mid not in known:
            out.append(spark.createDataFrame([("unknown_model", mid)], SCHEMA))
    if spec.cases is not None:
        cases = spark.createDataFrame([(c,) for c in spec.cases], "case_uuid string")
        out.append(cases.join(prompts.select("case_uuid").distinct(), "case_uuid", "left_anti")
                   .select(F.lit("case_without_prompts").alias("check"), F.col("case_uuid").alias("subject")))
        if any(m in ("text", "both") for m in spec.modalities):
            out.append(cases.join(case_pages.select("case_uuid").distinct(), "case_uuid", "left_anti")
                       .select(F.lit("case_without_pages").alias("check"), F.col("case_uuid").alias("subject")))
        if case_images is not None and any(m in ("image", "both") for m in spec.modalities):
            out.append(cases.join(case_images.select("case_uuid").distinct(), "case_uuid", "left_anti")
                       .select(F.lit("case_without_images").alias("check"), F.col("case_uuid").alias("subject")))
    pool = filler_pages.where(F.col("subdir_name") == spec.filler_subdir)
    if image_pool is not None and any(r > 0 for r in spec.ratios) and any(m in ("image", "both") for m in spec.modalities):
        sizes = filter_forms(pool, spec.allowed_filler_forms).agg(F.count(F.lit(1)).alias("n")).crossJoin(
            image_pool.agg(F.count(F.lit(1)).alias("m")))  # one row
        out.append(sizes.where("m < n").select(F.lit("image_pool_too_small").alias("check"), F.lit(spec.filler_subdir).alias("subject")))
    if spec.allowed_filler_forms:
        out.append(unknown_forms(spark, spec.allowed_filler_forms, available_forms(pool))
                   .select(F.lit("unknown_form").alias("check"), F.col("form").alias("subject")))
    if any(r > 0 for r in spec.ratios):
        kept = filter_forms(pool, spec.allowed_filler_forms)
        out.append(kept.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
                   .select(F.lit("empty_filler_pool").alias("check"), F.lit(spec.filler_subdir).alias("subject")))
    result = spark.createDataFrame([], SCHEMA)
    for d in out:
        result = result.unionByName(d)
    return result


def violations(spark: SparkSession, spec: ExperimentSpec, prompts: DataFrame, case_pages: DataFrame,
               filler_pages: DataFrame, model_ids: list[str] | None = None, case_images: DataFrame | None = None,
               image_pool: DataFrame | None = None) -> DataFrame:
    return spec_checks(spark, spec).unionByName(
        data_checks(spark, spec, prompts, case_pages, filler_pages, model_ids, case_images, image_pool))


def raise_if_invalid(v: DataFrame, limit: int = 20) -> None:
    """Fail with the number of violations and the first ``limit`` of them, in order."""
    n = v.count()
    if n:
        shown = [f"{r['check']}({r['subject']})" for r in v.orderBy("check", "subject").limit(limit).collect()]
        more = f"; and {n - len(shown)} more" if n > len(shown) else ""
        raise ValueError(f"invalid experiment, {n} violations: " + "; ".join(shown) + more)
