"""Filler forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longctx.functions.text import filler_form


def with_form(pages: DataFrame, file_col: str = "file_name") -> DataFrame:
    """P2 per filler file."""
    return pages.withColumn("form", filler_form(F.col(file_col)))


def filter_forms(pages: DataFrame, allowed: list[str] | None, file_col: str = "file_name") -> DataFrame:
    """Keep allowed forms; an empty list means no restriction."""
    if not allowed:
        return pages
    return pages.where(filler_form(F.col(file_col)).isin(list(allowed)))


def available_forms(text_pool: DataFrame, image_pool: DataFrame | None = None, file_col: str = "file_name") -> DataFrame:
    """Distinct forms across the text and image pools."""
    forms = text_pool.select(filler_form(F.col(file_col)).alias("form"))
    if image_pool is not None:
        forms = forms.union(image_pool.select(filler_form(F.col(file_col)).alias("form")))
    return forms.distinct()


def unknown_forms(spark: SparkSession, requested: list[str], available: DataFrame) -> DataFrame:
    """Requested forms that no pool provides."""
    req = spark.createDataFrame([(f,) for f in requested], "form string")
    return req.join(available, "form", "left_anti")
