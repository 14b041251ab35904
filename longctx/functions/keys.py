"""Stable keys and keyed hashes, all JVM-side column expressions.

* ``keyed_hash`` is the deterministic draw generator (F1): a 60-bit non-negative integer
  from the md5 of the ``|``-joined parts.  It is stateless, so a draw depends only on its
  key (seed, case, ratio, tag, index) and never on partitioning or order.
* ``row_id`` (P6) and ``scoring_key`` are sha-256 prefixes of the same key strings the
  reference hashes with blake2b (no blake2b builtin exists; documented deviation).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def keyed_hash(*parts) -> Column:
    """BIGINT in [0, 2**60): md5 of ``concat_ws('|', parts)``, first 15 hex digits."""
    joined = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substr(F.md5(joined), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def hash64_text(c) -> Column:
    """60-bit hash of a string column (used for combinable digests)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.conv(F.substr(F.md5(col), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def row_id(case_uuid, prompt_name, model_id, modality, ratio_key, thinking, filler_subdir, repetition) -> Column:
    """Matrix cell id: 16 hex digits of sha-256 over the cell key; ``|rep=N`` only when N > 0."""
    key = F.concat(
        _s(case_uuid), F.lit("|"), _s(prompt_name), F.lit("|"), _s(model_id), F.lit("|"), _s(modality),
        F.lit("|"), _s(ratio_key), F.lit("|"), _s(thinking), F.lit("|filler_subdir="), _s(filler_subdir),
        F.when(F.col(repetition) > 0 if isinstance(repetition, str) else repetition > 0,
               F.concat(F.lit("|rep="), _s(repetition))).otherwise(F.lit("")),
    )
    return F.substr(F.sha2(key, 256), F.lit(1), F.lit(16))


SCORING_KEY_FIELDS = ["case_uuid", "prompt", "model", "modality", "junk_context_ratio", "thinking", "response"]


def scoring_key(*cols) -> Column:
    """Verdict-cache key: 24 hex digits of sha-256 over the 7 fields joined by ``\\x1f``
    (missing values as empty strings)."""
    cols = cols or SCORING_KEY_FIELDS
    parts = [F.coalesce(_s(c), F.lit("")) for c in cols]
    return F.substr(F.sha2(F.concat_ws("\u001f", *parts), 256), F.lit(1), F.lit(24))


def payload_fingerprint(model, prompt_text, image_paths=None) -> Column:
    """Sha-256 over model + content parts (text, then image paths in order)."""
    parts = [_s(model), F.coalesce(_s(prompt_text), F.lit(""))]
    if image_paths is not None:
        col = F.col(image_paths) if isinstance(image_paths, str) else image_paths
        parts.append(F.coalesce(F.array_join(col, "\u001f"), F.lit("")))
    return F.sha2(F.concat_ws("\u001e", *parts), 256)
