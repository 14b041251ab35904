"""Synthetic filler generation as a data job.

Identities are columns of keyed hashes over ``(seed, id, field, position)``: any number of
rows, generated in parallel, identical under any partitioning.  Word lists are small,
self-made lookup tables (not the reference's generator library, which is unavailable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longctx.functions.keys import hash64_text, keyed_hash
from longctx.functions.text import blank_page_parts, generated_page_name, progress_key

FIRST = ["Ada", "Bela", "Caro", "Dario", "Elin", "Femi", "Gala", "Hugo", "Ines", "Joss", "Kira", "Luca",
         "Mina", "Nils", "Oona", "Pavel", "Rhea", "Sami", "Tove", "Ugo"]
LAST = ["Abbot", "Brandt", "Castell", "Dunmore", "Eckart", "Farrow", "Gidley", "Holm", "Ivers", "Jarrow",
        "Kessler", "Lind", "Marsh", "Norrell", "Ostby", "Pryce", "Quill", "Rowan", "Sallow", "Tarrant"]
STREETS = ["Alder", "Birch", "Cedar", "Dove", "Elm", "Fern", "Grove", "Heron", "Iris", "Juniper"]
STREET_KIND = ["St", "Ave", "Rd", "Ln", "Way", "Ct"]
CITIES = ["Northfield", "Lakeside", "Riverton", "Hillcrest", "Fairview", "Millbrook", "Oakdale", "Westport"]
STATES = ["CA", "NY", "TX", "WA", "IL", "OR", "MA", "CO", "GA", "MN"]
COMPANY_KIND = ["Group", "LLC", "Partners", "Holdings", "Labs", "Works"]
DOMAINS = ["example.com", "example.org", "example.net"]

# Fixed value: the generated identity fields, in output order, with their text labels.
PROFILE_LABELS = [
    ("name", "Patient Name"), ("first_name", "First Name"), ("last_name", "Last Name"),
    ("dob", "Date of Birth"), ("address", "Address"), ("city", "City"), ("state", "State"),
    ("zip_code", "ZIP Code"), ("phone", "Phone"), ("email", "Email"), ("company", "Employer / Company"),
    ("ssn", "Social Security Number"), ("date_today", "Date"), ("physician", "Physician / Provider Name"),
    ("insurance_id", "Insurance ID"), ("policy_number", "Policy Number"), ("claim_number", "Claim Number"),
    ("diagnosis_code", "Diagnosis Code"), ("npi", "NPI Number"), ("license_number", "License Number"),
]
# Pattern fields (# digit, ? letter).
PATTERNS = {
    "ssn": "###-##-####", "insurance_id": "??#######", "policy_number": "POL-#######",
    "claim_number": "CLM-########", "diagnosis_code": "?##.#", "npi": "##########",
    "license_number": "??-######", "zip_code": "#####", "phone": "(###) ###-####",
}
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _h(seed, pid: Column, field: str, pos: int = 0) -> Column:
    return keyed_hash(str(seed), pid, field, str(pos))


def _pick(words: list[str], h: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (h % len(words) + 1).cast("int"))


def pattern(seed, pid: Column, field: str, pat: str) -> Column:
    parts = []
    for i, ch in enumerate(pat):
        if ch == "#":
            parts.append((_h(seed, pid, field, i) % 10).cast("string"))
        elif ch == "?":
            parts.append(F.substring(F.lit(LETTERS), (_h(seed, pid, field, i) % len(LETTERS) + 1).cast("int"), 1))
        else:
            parts.append(F.lit(ch))
    return F.concat(*parts)


def profiles(ids: DataFrame, seed: int, id_col: str = "profile_id", as_of: str = "2026-01-01") -> DataFrame:
    """G1: one identity per id (20 string fields)."""
    pid = F.col(id_col).cast("string")
    first, last = _pick(FIRST, _h(seed, pid, "first")), _pick(LAST, _h(seed, pid, "last"))
    cols = {
        "first_name": first, "last_name": last, "name": F.concat_ws(" ", first, last),
        "dob": F.date_format(F.date_sub(F.lit(as_of).cast("date"),
                                        (F.lit(18 * 365) + _h(seed, pid, "dob") % (67 * 365)).cast("int")), "yyyy-MM-dd"),
        "address": F.concat((_h(seed, pid, "num") % 9000 + 100).cast("string"), F.lit(" "),
                            _pick(STREETS, _h(seed, pid, "street")), F.lit(" "), _pick(STREET_KIND, _h(seed, pid, "kind"))),
        "city": _pick(CITIES, _h(seed, pid, "city")), "state": _pick(STATES, _h(seed, pid, "state")),
        "email": F.lower(F.concat(first, F.lit("."), last, F.lit("@"), _pick(DOMAINS, _h(seed, pid, "domain")))),
        "company": F.concat_ws(" ", _pick(LAST, _h(seed, pid, "company")), _pick(COMPANY_KIND, _h(seed, pid, "ckind"))),
        "date_today": F.date_format(F.date_add(F.lit(as_of).cast("date"), (_h(seed, pid, "today") % 365).cast("int")),
                                    "yyyy-MM-dd"),
        "physician": F.concat(F.lit("Dr. "), _pick(LAST, _h(seed, pid, "physician"))),
    }
    for f, pat in PATTERNS.items():
        cols[f] = pattern(seed, pid, f, pat)
    return ids.select(F.col(id_col), *[cols[f].alias(f) for f, _ in PROFILE_LABELS])


def profile_text(df: DataFrame) -> Column:
    """``Label: value`` lines."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.col(f)) for f, label in PROFILE_LABELS])


FILL_TEMPLATE = ("Fill in every empty field of this blank form image with the identity below. Keep the layout, "
                 "fonts and scan look of the original page; write values only where a field exists.\n\n"
                 "{faker_data}")


def fill_request(template: str = FILL_TEMPLATE) -> Column:
    """Request text = template with the identity text inserted."""
    pre, _, post = template.partition("{faker_data}")
    return F.concat(F.lit(pre), F.col("profile_text"), F.lit(post))


def generation_work(blank_pages: DataFrame, variants: int, outputs: DataFrame, approved: DataFrame,
                    profiles_by_variant: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G3 + J12 + J13 (+ P8, P9).

    ``blank_pages``: ``(file_name, prefix)``; ``outputs``: existing ``(file_name, variant)``;
    ``approved``: approved ``(file_name, variant)``; ``profiles_by_variant``: ``(variant, …)``.
    Returns (work list of missing (page, variant) with its profile, triage queue of pages with
    at least one missing variant).  Every variant count is a parameter; all joins are keyed.
    """
    prefix, pnum = blank_page_parts(F.col("file_name"))
    grid = (blank_pages.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))
            .withColumn("page_number", pnum)
            .withColumn("out_name", generated_page_name(F.col("prefix"), F.col("variant"), F.col("page_number")))
            .withColumn("progress_key", progress_key(F.col("prefix"), F.col("variant"), F.col("file_name"))))
    missing = (grid.join(outputs.select("file_name", "variant"), ["file_name", "variant"], "left_anti")
               .join(approved.select("file_name", "variant"), ["file_name", "variant"], "left_anti"))
    work = missing.join(profiles_by_variant, "variant")
    triage = missing.groupBy("file_name", "prefix").agg(F.count(F.lit(1)).alias("n_missing"))
    return work, triage


def generation_progress(blank_pages: DataFrame, variants: int, outputs: DataFrame, approved: DataFrame) -> DataFrame:
    """Done (on disk or approved) over total page × variant items."""
    grid = blank_pages.select("file_name", F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("variant"))
    done = outputs.select("file_name", "variant").unionByName(approved.select("file_name", "variant")).distinct()
    flagged = grid.join(done.withColumn("_d", F.lit(1)), ["file_name", "variant"], "left")
    return flagged.agg(F.count(F.lit(1)).alias("total"), F.count("_d").alias("done"),
                       (F.count("_d") / F.count(F.lit(1))).alias("fraction"))


def blank_pages_from_filler(filler_pages: DataFrame, subdir: str) -> DataFrame:
    """Blank pages of a pool with their form prefix."""
    return (filler_pages.where(F.col("subdir_name") == subdir)
            .select("file_name", blank_page_parts(F.col("file_name"))[0].alias("prefix")))


def blank_forms(blank_pages: DataFrame) -> DataFrame:
    """The forms of a pool: prefix, number of pages, first and last page name, and a digest of the set of names.

    Aggregates without lists, since one form may hold any share of the pages; ``blank_pages`` has the pages themselves."""
    return blank_pages.groupBy("prefix").agg(
        F.count(F.lit(1)).alias("n_pages"), F.min("file_name").alias("first_page"), F.max("file_name").alias("last_page"),
        F.bit_xor(hash64_text(F.col("file_name"))).alias("pages_digest"))
