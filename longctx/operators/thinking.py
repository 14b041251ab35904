"""Abstract thinking level → provider-native settings.

Expressed as column logic over the (model, level) rows, so the mapping rides along the
broadcast model dimension instead of a Python loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: budget-family model prefixes and budgets.
BUDGET_MODEL_PREFIXES = ["gemini-2.5-flash", "gemini-2.5-flash-lite", "gemini-2.0"]
BUDGET_BY_LEVEL = {"minimal": 0, "low": 4096, "medium": 16384, "high": 32768}


def uses_budget(model: Column) -> Column:
    """Model name starts with one of the budget-family prefixes."""
    cond = F.lit(False)
    for p in BUDGET_MODEL_PREFIXES:
        cond = cond | model.startswith(p)
    return cond


def _budget(level: Column) -> Column:
    expr = F.lit(0)
    for lv, b in BUDGET_BY_LEVEL.items():
        expr = F.when(level == lv, F.lit(b)).otherwise(expr)
    return expr.cast("bigint")


def thinking_columns(provider: Column, model: Column, level: Column) -> dict[str, Column]:
    """Flat provider settings: budget, include_thoughts, thinking_level, thinking_type, effort.

    ``none`` disables thinking for every provider; unknown providers ignore the level.
    """
    none = level == "none"
    google = provider == "google"
    budget_fam = google & uses_budget(model)
    budget = _budget(level)
    return {
        "thinking_budget": F.when(~none & budget_fam, budget),
        "include_thoughts": F.when(~none & budget_fam, F.when(budget > 0, F.lit(True)))
        .when(~none & google & ~uses_budget(model), F.lit(True)),
        "thinking_level": F.when(~none & google & ~uses_budget(model), F.upper(level)),
        "thinking_type": F.when(~none & (provider == "anthropic_gcp"), F.lit("adaptive")),
        "effort": F.when(~none & provider.isin("anthropic_gcp", "azure_openai"), level),
    }


def apply_thinking(cells: DataFrame, provider="provider", model="model", level="thinking", extra="extra") -> DataFrame:
    """The settings of each cell's provider, as variants.

    ``thinking_settings``: the nested object for the provider (null with ``none`` and for providers without one).  ``extra``, the
    model's own settings as JSON text, becomes a variant; for anthropic ``output_config.effort`` is set in it and
    everything beside it is kept, also the other keys of ``output_config``.
    """
    c = thinking_columns(F.col(provider), F.col(model), F.col(level))
    fields = F.struct(c["thinking_budget"].alias("thinking_budget"), c["include_thoughts"].alias("include_thoughts"),
                      c["thinking_level"].alias("thinking_level"), c["thinking_type"].alias("type"),
                      F.when(F.col(provider) == "azure_openai", c["effort"]).alias("effort"))
    text = F.to_json(fields)  # null fields are left out
    out = cells.withColumn("thinking_settings", F.when(text != "{}", F.parse_json(text)))
    if extra not in cells.columns:
        return out
    own = F.from_json(F.coalesce(F.col(extra), F.lit("{}")), "map<string,variant>")
    config = F.coalesce(F.try_variant_get(F.try_element_at(own, F.lit("output_config")), "$", "map<string,variant>"),
                        F.create_map().cast("map<string,variant>"))
    effort = F.create_map(F.lit("effort"), _string(F.col(level)))
    config = F.map_concat(F.map_filter(config, lambda k, v: k != "effort"), effort)
    merged = F.map_concat(F.map_filter(own, lambda k, v: k != "output_config"),
                          F.create_map(F.lit("output_config"), F.to_variant_object(config)))
    uses = (F.col(provider) == "anthropic_gcp") & (F.col(level) != "none")
    return out.withColumn(extra, F.to_variant_object(F.when(uses, merged).otherwise(own)))


def _string(text: Column) -> Column:
    """A string as a variant."""
    return F.variant_get(F.to_variant_object(F.struct(text.alias("s"))), "$.s", "variant")
