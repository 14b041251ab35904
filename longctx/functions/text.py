"""Text column functions.

Regex facts (checked against Python's ``re`` semantics):
* Python ``\\w`` ≈ ``[\\p{L}\\p{N}_]`` (closest Java class; plain ``\\w`` is ASCII-only).
* Python ``\\s`` = Java ``(?U)[\\s\\x1c-\\x1f]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
ARTICLES = ["a", "an", "the"]
WORD_RE = r"[\p{L}\p{N}_]+"
SPACE_RE = r"(?U)[\s\x1c-\x1f]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c) -> Column:
    """M1+M2: SQuAD normalisation as a token array.

    Lower-case, punctuation (neither word nor space) becomes a separator, whitespace splits,
    the articles a/an/the are dropped.  Splitting on non-word characters is the same as
    collecting maximal word-character runs.
    """
    raw = F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(WORD_RE), 0)
    return F.filter(raw, lambda t: ~t.isin(ARTICLES))


def normalize_text(c) -> Column:
    """M1 as a string: tokens joined by one space (``''`` for null / no tokens)."""
    return F.array_join(tokens(c), " ")


def stripped_len(c) -> Column:
    """Character count with every whitespace character removed."""
    return F.length(F.regexp_replace(F.coalesce(_c(c), F.lit("")), SPACE_RE, "")).cast("bigint")


def path_name(c) -> Column:
    return F.element_at(F.split(_c(c), "/"), -1)


def path_stem(c) -> Column:
    """Stem of a path: file name without its last suffix (a leading dot is not a suffix)."""
    name = path_name(c)
    return F.when(name.rlike(r"^[^.].*\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def prompt_key(c) -> Column:
    """Bare lower-cased, trimmed stem used for difficulty lookup."""
    return F.lower(F.trim(path_stem(c)))


def filler_form(c) -> Column:
    """Form of a filler file: strip a trailing ``-v<d>-<d>``; else text before the first ``_``."""
    stem = path_stem(c)
    return F.when(stem.rlike(r"-v\d+-\d+$"), F.regexp_replace(stem, r"-v\d+-\d+$", "")).otherwise(
        F.split(stem, "_", 2).getItem(0))


def blank_page_parts(c) -> tuple[Column, Column]:
    """(form prefix, page number) of a blank page ``{prefix}_{page}``; page defaults to ``001``."""
    parts = F.split(path_stem(c), "_", 2)
    return parts.getItem(0), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("001"))


def generated_page_name(prefix, variant, page) -> Column:
    """``{prefix}-v{n}-{page}.jpg``."""
    return F.format_string("%s-v%d-%s.jpg", _c(prefix), _c(variant), _c(page))


def progress_key(prefix, variant, page_file) -> Column:
    """``{prefix}::v{n}::{page file}``."""
    return F.format_string("%s::v%d::%s", _c(prefix), _c(variant), _c(page_file))
