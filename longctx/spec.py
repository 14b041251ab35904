"""Experiment specification → small dimension DataFrames.

The spec is plain Python on the driver (it is configuration, a few dozen values); every
dimension it yields is a tiny DataFrame that the plans broadcast.  Data never flows
through here.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Fixed values that must equal the reference's (level names, modalities, filler folders).
THINKING_LEVELS = ("none", "minimal", "low", "medium", "high")
MODALITIES = ("text", "image", "both")
FILLER_SUBDIRS = ("empty", "image_gen", "image_gen_1variant", "image_gen_3variants")


def format_ratio(r: float) -> str:
    """P5: ``%g`` rendering (6 significant digits, no trailing zeros)."""
    return f"{float(r):g}"


@dataclass
class ModelSpec:
    id: str
    provider: str
    model: str
    max_output_tokens: int = 4096
    temperature: float = 0.0
    thinking: dict[str, Any] | None = None
    extra: dict[str, Any] = field(default_factory=dict)


@dataclass
class ExperimentSpec:
    name: str
    models: list[ModelSpec]
    modalities: list[str]
    ratios: list[float]
    thinking_default: list[str] = field(default_factory=lambda: ["none"])
    thinking_overrides: dict[str, list[str]] = field(default_factory=dict)
    cases: list[str] | None = None  # None = every case present in the questions table
    prompt_categories: list[str] | None = None
    allowed_filler_forms: list[str] = field(default_factory=list)
    filler_subdir: str = "empty"
    repetitions: int = 1
    seed: int | None = 0
    known_subdirs: tuple[str, ...] = FILLER_SUBDIRS

    # ------------------------------------------------------------------ dimensions
    def models_df(self, spark: SparkSession) -> DataFrame:
        rows = [(m.id, m.provider, m.model, int(m.max_output_tokens), float(m.temperature),
                 json.dumps(m.thinking) if m.thinking else None, json.dumps(m.extra or {}), i)
                for i, m in enumerate(self.models)]
        return spark.createDataFrame(
            rows,
            "model_config_id string, provider string, model string, max_output_tokens int, "
            "temperature double, thinking_config string, extra string, model_ord int",  # settings as JSON text
        )

    def modalities_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(m, i) for i, m in enumerate(self.modalities)],
                                     "modality string, modality_ord int")

    def ratios_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(float(r), format_ratio(r), i) for i, r in enumerate(self.ratios)],
                                     "ablation_ratio double, ratio_key string, ratio_ord int")

    def thinking_default_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(lv, i) for i, lv in enumerate(self.thinking_default)],
                                     "thinking string, level_ord int")

    def thinking_overrides_df(self, spark: SparkSession) -> DataFrame:
        rows = [(mid, levels) for mid, levels in self.thinking_overrides.items()]
        return spark.createDataFrame(rows, "model_config_id string, levels array<string>")

    def repetitions_df(self, spark: SparkSession) -> DataFrame:
        return spark.range(max(self.repetitions, 0)).selectExpr("cast(id as int) as repetition")

    def categories_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c,) for c in (self.prompt_categories or [])], "difficulty string")


def fixture_spec() -> ExperimentSpec:
    """The literal dimensions used over the driver tables (see FIXTURES.md)."""
    return ExperimentSpec(
        name="fixture",
        models=[
            ModelSpec("a1", "google", "gemini-2.5-flash"),
            ModelSpec("a2", "google", "gemini-3-flash-preview"),
            ModelSpec("b1", "anthropic_gcp", "claude-sonnet-4-6", extra={"region": "us-east5"}),
            ModelSpec("c1", "azure_openai", "gpt-5.4"),
            ModelSpec("d1", "fake", "echo"),
        ],
        modalities=["text", "both"],
        ratios=[0.0, 0.5, 1.25],
        thinking_default=["minimal"],
        thinking_overrides={"b1": ["low", "high"]},
        filler_subdir="web",
        repetitions=2,
        seed=42,
        known_subdirs=FILLER_SUBDIRS + ("web", "bench"),
    )
