"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Inputs are the fixture views over the driver tables (``longctx.sources.fixtures``) and the
literal fixture spec.  Each query exposes only scalar columns so its result can be compared
value by value with the DuckDB oracle in ``longctx.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longctx.operators import dilute, matrix
from longctx.operators.thinking import thinking_columns
from longctx.sources import fixtures as fx
from longctx.spec import fixture_spec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ------------------------------------------------------------------ dilution

def _context_pages(spark, sf):
    spec = fixture_spec()
    return dilute.context_pages(fx.case_pages_df(spark, sf), fx.filler_pages_df(spark, sf),
                                spec.ratios_df(spark), seed=spec.seed, filler_subdir=spec.filler_subdir)


@register
def context_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Per (case, ratio) page counts, joined length and page-order digest."""
    return dilute.context_summary(_context_pages(spark, sf))


@register
def context_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Every inserted filler page with its slot, position and output ordinal."""
    return dilute.provenance(_context_pages(spark, sf))


# ------------------------------------------------------------------ matrix

def fixture_prompts(spark, sf):
    q = fx.questions_df(spark, sf)
    return q.select("case_uuid", F.concat(F.col("prompt_id"), F.lit(".txt")).alias("prompt_file"),
                    "question", "answer", "difficulty")


def fixture_difficulties(spark, sf):
    """Difficulty table as written by the case layout writer: only non-blank labels, each after an outdated one."""
    labels = fixture_prompts(spark, sf).where(F.col("difficulty") != "").select(
        "case_uuid", F.col("prompt_file").alias("prompt"), "difficulty")
    both = F.array(F.struct(F.lit(0).alias("seq"), F.lit("Tier 9 · Outdated").alias("difficulty")),
                   F.struct(F.lit(1).alias("seq"), F.col("difficulty")))
    return labels.select("case_uuid", "prompt", F.explode(both).alias("l")).select("case_uuid", "prompt", "l.*")


def fixture_matrix(spark, sf, spec=None, limit=None):
    spec = spec or fixture_spec()
    prompts = fixture_prompts(spark, sf).drop("difficulty")
    return matrix.build_matrix(spark, prompts, spec, fixture_difficulties(spark, sf), limit=limit)


@register
def matrix_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every matrix cell with id and ordinal."""
    cells = fixture_matrix(spark, sf)
    th = thinking_columns(F.col("provider"), F.col("model"), F.col("thinking"))
    return cells.select(*matrix.MATRIX_COLUMNS, *[v.alias(k) for k, v in th.items()])


@register
def matrix_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A1: cache groups (all levels of one cell), members in matrix order."""
    return matrix.cache_groups(fixture_matrix(spark, sf))


@register
def matrix_size(spark: SparkSession, sf: str) -> DataFrame:
    """A15 + P4: cell counts, without and with a difficulty filter."""
    spec = fixture_spec()
    spec.prompt_categories = ["Tier 1 · Easy", "Tier 2 · Medium"]
    prompts, labels = fixture_prompts(spark, sf).drop("difficulty"), fixture_difficulties(spark, sf)
    a = matrix.matrix_counts(prompts, fixture_spec(), labels)
    b = matrix.matrix_counts(prompts, spec, labels).select(F.col("n_cells").alias("n_cells_filtered"),
                                                           F.col("max_ordinal").alias("max_ordinal_filtered"))
    return a.crossJoin(b)


@register
def matrix_preview(spark: SparkSession, sf: str) -> DataFrame:
    """K5: preview lines of every cell of the run."""
    return matrix.matrix_preview_lines(fixture_matrix(spark, sf), fixture_spec().repetitions)


@register
def matrix_first_cells(spark: SparkSession, sf: str) -> DataFrame:
    """L1: the run option that keeps the first N cells; here N is 100."""
    return matrix.matrix_preview_lines(fixture_matrix(spark, sf, limit=100), fixture_spec().repetitions)


# ------------------------------------------------------------------ metrics

RESPONSE_ID = ["case_uuid", "prompt_id", "model"]


def _scored_metrics(spark, sf, with_lcs=False):
    from longctx.operators.metrics import text_metrics
    return text_metrics(fx.responses_df(spark, sf), RESPONSE_ID, with_lcs=with_lcs)


@register
def metric_exact(spark: SparkSession, sf: str) -> DataFrame:
    """M1 M2 M3: normalised token counts and exact match."""
    return _scored_metrics(spark, sf).select(*RESPONSE_ID, "n_ref_tokens", "n_pred_tokens", "exact_match")


@register
def metric_token_f1(spark: SparkSession, sf: str) -> DataFrame:
    """M4: multiset token overlap F1."""
    return _scored_metrics(spark, sf).select(*RESPONSE_ID, "n_ref_tokens", "n_pred_tokens", "ov_1", "token_f1")


@register
def metric_rouge_n(spark: SparkSession, sf: str) -> DataFrame:
    """M5 M6: ROUGE-1 / ROUGE-2 F1 with their n-gram counts."""
    return _scored_metrics(spark, sf).select(*RESPONSE_ID, "ov_1", "ov_2", "ref_2", "pred_2",
                                             "rouge1_f1", "rouge2_f1")


@register
def metric_bleu(spark: SparkSession, sf: str) -> DataFrame:
    """M9: smoothed sentence BLEU (value rounded to 9 decimals for a portable comparison)."""
    m = _scored_metrics(spark, sf)
    return m.select(*RESPONSE_ID, *[f"ov_{n}" for n in range(1, 5)], *[f"pred_{n}" for n in range(1, 5)],
                    F.round(F.col("bleu"), 9).alias("bleu"))


@register
def metric_rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    """M7 M8: LCS length (Arrow UDF, bit-parallel) and ROUGE-L F1."""
    return _scored_metrics(spark, sf, with_lcs=True).select(*RESPONSE_ID, "n_ref_tokens", "n_pred_tokens",
                                                            "lcs", "rougeL_f1")


@register
def conciseness_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whitespace-free lengths and the 3x conciseness gate."""
    from longctx.operators.metrics import conciseness
    return conciseness(fx.responses_df(spark, sf)).select(*RESPONSE_ID, "ref_chars", "response_chars", "concise")


# ------------------------------------------------------------------ verdicts and jury

def _map_text(m: str):
    return F.array_join(F.transform(F.map_entries(F.col(m)), lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("null")))), ",")


@register
def verdict_parse(spark: SparkSession, sf: str) -> DataFrame:
    """V3 V4 V5: tolerant JSON extraction and three-valued coercion of judge output."""
    from longctx.operators.jury import parse_verdicts
    vt = fx.verdict_text_df(spark, sf).select("doc_id", F.col("verdict").alias("verdict_text"),
                                              F.lit("a response").alias("response"))
    return parse_verdicts(vt).select("doc_id", "complete", "accurate", "rationale", "error")


@register
def jury_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Majority vote of three judges per row."""
    from longctx.operators.jury import assemble_votes, jury_verdict as jv
    v = fx.verdicts_df(spark, sf).withColumn("error", F.lit("")).withColumn("rationale", F.lit("ok"))
    out = jv(assemble_votes(v), ["doc_id"])
    return out.select("doc_id", "n_valid", "n_pass", "judge_correct", "judge_complete", "judge_accurate",
                      "judge_error", _map_text("judge_votes").alias("votes"),
                      _map_text("judge_rationales").alias("rationales"))


# ------------------------------------------------------------------ result log

CURRENT_RUN = "run15"


@register
def log_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """Last log entry per row id, placed at its first position."""
    from longctx.operators.results import keep_last
    return keep_last(fx.result_log_df(spark, sf)).select("row_id", "first_seq", "seq", "experiment_uuid", "status")


@register
def reuse_latest_ok(spark: SparkSession, sf: str) -> DataFrame:
    """Newest successful result of another run per row id."""
    from longctx.operators.results import latest_ok
    return latest_ok(fx.run_log_df(spark, sf), CURRENT_RUN).select(
        "row_id", F.col("experiment_uuid").alias("reused_from"), F.col("seq").alias("reused_seq"))


def _planned(spark, sf):
    log = fx.run_log_df(spark, sf)
    return log.select("row_id").distinct(), log


@register
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the current run still to do, and how (reuse or call)."""
    from longctx.operators.results import plan_run
    cells, log = _planned(spark, sf)
    return plan_run(cells, log, CURRENT_RUN).select("row_id", "action", "reused_from", "reused_seq")


@register
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A3: status of every cell after keep-last."""
    from longctx.operators.results import status_counts as sc
    return sc(fx.result_log_df(spark, sf))


@register
def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    """A4: totals of the current run's plan."""
    from longctx.operators.results import plan_run, run_progress as rp
    cells, log = _planned(spark, sf)
    answered = log.where(F.col("experiment_uuid") == CURRENT_RUN).select("row_id")
    return rp(plan_run(cells, log, CURRENT_RUN), answered)


@register
def error_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Transient / permanent and payload-limit classification of an error log."""
    from longctx.functions.errors import is_payload_limit, is_transient
    e = fx.error_log_df(spark, sf)
    return e.select("event_id", "code", "error_class",
                    is_transient(F.col("code"), F.col("error_class"), F.col("message")).alias("transient"),
                    is_payload_limit(F.col("code"), F.col("message")).alias("payload_limit"))


def fixture_results(spark, sf):
    """Results of the fixture matrix: model k answers like responder m{k} of the responses view,
    token usage derived from the texts."""
    cells = fixture_matrix(spark, sf)  # carries the prompt's question and answer text
    ans = F.col("answer")
    resp = (F.when(F.col("model_ord") == 0, ans)
            .when(F.col("model_ord") == 1, F.expr("substr(answer, 1, cast(floor(length(answer) * 2 / 3) as int))"))
            .when(F.col("model_ord") == 2, F.concat(ans, F.lit(" "), F.col("question"), F.lit(" "), ans,
                                                    F.lit(" "), ans))
            .when(F.col("model_ord") == 3, F.col("question")).otherwise(F.lit("")))
    return (cells
            .select("row_id", "case_uuid", "prompt_file", "difficulty", "model", "modality", "ablation_ratio",
                    "thinking", "repetition",
                    F.floor(F.length("question") / 4).cast("bigint").alias("prompt_tokens"),
                    F.lit(None).cast("bigint").alias("cache_creation_input_tokens"),
                    F.when(F.col("repetition") > 0, F.lit(100)).cast("bigint").alias("cache_read_input_tokens"),
                    F.floor(F.length(resp) / 4).cast("bigint").alias("completion_tokens"),
                    F.when(F.col("thinking") == "high", F.lit(64)).cast("bigint").alias("thinking_tokens"),
                    resp.alias("answer")))


@register
def responses_export(spark: SparkSession, sf: str) -> DataFrame:
    """Results with prompt text, validated answer (qNN → aNN) and flat usage."""
    from longctx.operators.results import responses_export as rx
    q = fixture_prompts(spark, sf)
    answers = q.select("case_uuid", F.concat(F.lit("a"), F.substr(F.col("prompt_file"), F.lit(2))).alias("answer_file"),
                       "answer")
    res = fixture_results(spark, sf).drop("row_id")
    return rx(res, q.select("case_uuid", "prompt_file", "question"), answers)


# ------------------------------------------------------------------ reports

def fixture_scored(spark, sf):
    """The rows of the scoring run."""
    return _score(spark, sf, False).select(*RESPONSE_ID, "difficulty", "judge_correct")


@register
def pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Pass rate by model and difficulty with rollup subtotals."""
    from longctx.operators.report import pass_rate as pr
    return pr(fixture_scored(spark, sf), ["model", "difficulty"])


@register
def pass_rate_by_difficulty(spark: SparkSession, sf: str) -> DataFrame:
    """A10: pass rate over grouping sets (model×difficulty, difficulty, all)."""
    from longctx.operators.report import pass_rate_sets
    return pass_rate_sets(fixture_scored(spark, sf), [["model", "difficulty"], ["difficulty"], []])


# ------------------------------------------------------------------ forms and checks

FIXTURE_ALLOWED_FORMS = ["form-1", "form-2", "form-7", "bench", "cms-1"]


@register
def filler_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Forms per pool, file counts and whether the allow-list keeps them."""
    from longctx.operators.forms import with_form
    f = with_form(fx.filler_pages_df(spark, sf))
    return (f.groupBy("subdir_name", "form").agg(F.count(F.lit(1)).alias("n_files"))
            .withColumn("allowed", F.col("form").isin(FIXTURE_ALLOWED_FORMS)))


@register
def spec_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule broken by a faulty spec, checked against the tables."""
    from longctx.operators.validate import violations
    spec = fixture_spec()
    spec.cases = ["src0", "src5", "src19", "src20", "srcX"]
    spec.ratios = [0.0, 0.5, -1.0]
    spec.thinking_overrides = {"b1": ["low", "extreme"], "c1": []}
    spec.allowed_filler_forms = FIXTURE_ALLOWED_FORMS
    spec.modalities = ["text", "audio", "image"]
    images = fx.case_images_df(spark, sf).where(F.col("case_uuid") != "src5")
    return violations(spark, spec, fixture_prompts(spark, sf), fx.case_pages_df(spark, sf),
                      fx.filler_pages_df(spark, sf), model_ids=["a1", "b1", "z9"], case_images=images,
                      image_pool=fx.image_pool_df(spark, sf, "bench").limit(0))


# ------------------------------------------------------------------ prompts and payloads

def _images(spark, sf, pages, spec):
    """(contexts, image pages) of the fixture for text pages that are at hand."""
    images = fx.case_images_df(spark, sf)
    ratios = spec.ratios_df(spark)
    shown = dilute.image_pages(pages, images, fx.image_pool_df(spark, sf, spec.filler_subdir), ratios)
    return dilute.image_contexts(fx.case_pages_df(spark, sf), images, ratios), shown


@register
def image_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Every image of every context in order: case images, filler images at the text channel's positions."""
    _, shown = _images(spark, sf, _context_pages(spark, sf), fixture_spec())
    return shown


@register
def filler_meta(spark: SparkSession, sf: str) -> DataFrame:
    """What was inserted into each context, both channels, image-only cases and ratio 0 included."""
    from longctx.session import cut_lineage
    pages = cut_lineage(_context_pages(spark, sf))
    contexts, shown = _images(spark, sf, pages, fixture_spec())
    return dilute.filler_summary(contexts, pages, shown)


def _payloads(spark, sf, seed=None):
    """Cells of all three modalities with the length and the fingerprint of their request."""
    from longctx.functions.keys import payload_fingerprint
    from longctx.functions.verdict import py_strip
    from longctx.operators.results import PROMPT_SEPARATOR
    from longctx.session import cut_lineage
    spec = fixture_spec()
    spec.modalities = ["text", "image", "both"]
    spec.seed = spec.seed if seed is None else seed
    pages = cut_lineage(dilute.context_pages(
        fx.case_pages_df(spark, sf), fx.filler_pages_df(spark, sf), spec.ratios_df(spark), seed=spec.seed,
        filler_subdir=spec.filler_subdir))
    contexts, shown = _images(spark, sf, pages, spec)
    keys = ["case_uuid", "ratio_key"]
    ctx = dilute.image_summary(contexts, shown).join(
        dilute.context_summary(pages).select(*keys, "n_chars", "digest"), keys, "left")
    prompts = fixture_prompts(spark, sf).drop("difficulty")
    cells = matrix.build_matrix(spark, prompts, spec, fixture_difficulties(spark, sf))
    j = cells.join(ctx, keys, "left")
    text_on, image_on = F.col("modality").isin("text", "both"), F.col("modality").isin("image", "both")
    q = py_strip(F.col("question"))
    chars = F.when(text_on, F.coalesce(F.col("n_chars"), F.lit(0)) + len(PROMPT_SEPARATOR)).otherwise(0) + F.length(q)
    content = F.concat_ws("|", F.when(text_on, F.coalesce(F.col("digest").cast("string"), F.lit(""))), q)
    n_images = F.when(image_on, F.col("n_real_images") + F.col("n_filler_images")).otherwise(0)
    files = F.array(F.when(image_on, F.coalesce(F.col("image_digest").cast("string"), F.lit(""))).otherwise(F.lit("")))
    return j.select("row_id", "ordinal", "case_uuid", "ratio_key", "modality", "model", F.col("model_config_id"),
                    chars.cast("bigint").alias("prompt_chars"), F.coalesce(n_images, F.lit(0)).cast("bigint").alias("n_images"),
                    payload_fingerprint(F.col("model"), content, files).alias("payload_sha"))


@register
def prompt_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell of three modalities, exact prompt length, image count and the request
    fingerprint (channels represented by their page-order digests, so the text is never materialised)."""
    return _payloads(spark, sf).drop("ordinal")


@register
def payload_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Identical request bodies (same model, context, question) and how often they recur."""
    return _payloads(spark, sf).groupBy("payload_sha", "model").agg(F.count(F.lit(1)).alias("n_cells"))


@register
def reuse_by_payload(spark: SparkSession, sf: str) -> DataFrame:
    """A run after a run with the same seed and a newer one with another seed: a result is reused only for an
    equal request, so cells with filler pages go back to the older run, and cells without filler take the newer one."""
    from longctx.operators.results import plan_run
    from longctx.session import cut_lineage
    mine = cut_lineage(_payloads(spark, sf).select("row_id", "ordinal", "ratio_key", "payload_sha"))
    other = _payloads(spark, sf, seed=7).select("row_id", "ordinal", "payload_sha")

    def run(name, day, cells, keep):
        return cells.where(keep).select(
            "row_id", "payload_sha", F.lit(name).alias("experiment_uuid"), F.lit(f"2026-01-0{day} 00:00:00").cast("timestamp")
            .alias("run_ts"), F.lit("ok").alias("status"), F.col("ordinal").alias("seq"))
    log = run("same", 1, mine, F.col("ordinal") % 3 == 0).unionByName(run("other", 2, other, F.col("ordinal") % 2 == 0))
    plan = plan_run(mine, log, "now", payload="payload_sha")
    return plan.select("row_id", "ratio_key", "action", "reused_from", "reused_seq")


# ------------------------------------------------------------------ synthetic filler

GEN_VARIANTS = 3
GEN_SEED = 42


def _gen_inputs(spark, sf):
    from longctx.operators.synth import blank_pages_from_filler
    pages = fx.read_table(spark, sf, "pages").select("page_id")
    fp = fx.filler_pages_df(spark, sf)
    blank = blank_pages_from_filler(fp, "web")
    ids = pages.select("page_id", F.concat(
        F.lit("form-"), (F.col("page_id") % 12).cast("string"),
        F.when(F.col("page_id") % 2 == 0, F.lit("-v1-")).otherwise(F.lit("_")),
        F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit(".txt")).alias("file_name"))
    vs = spark.range(1, GEN_VARIANTS + 1).select(F.col("id").cast("int").alias("variant"))
    outputs = (ids.crossJoin(F.broadcast(vs))
               .where((F.col("page_id") % 4 == 0) | ((F.col("page_id") % 4 == 1) & (F.col("variant") == 1))))
    approved = ids.where(F.col("page_id") % 10 == 2).crossJoin(F.broadcast(vs))
    return blank, outputs, approved


@register
def synthetic_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """One fake identity per web page, rendered as text filler."""
    from longctx.operators.synth import profile_text, profiles
    ids = fx.read_table(spark, sf, "pages").select(F.col("page_id").alias("profile_id"))
    p = profiles(ids, GEN_SEED)
    return p.select("*", profile_text(p).alias("profile_text"))


@register
def blank_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Forms found among the pages of the filler pools."""
    from longctx.operators.synth import blank_forms as forms, blank_pages_from_filler
    pages = fx.filler_pages_df(spark, sf)
    return forms(blank_pages_from_filler(pages, "web").unionByName(blank_pages_from_filler(pages, "bench")))


def _variant_profiles(spark):
    from longctx.operators.synth import fill_request, profile_text, profiles
    p = profiles(spark.range(1, GEN_VARIANTS + 1).select(F.col("id").cast("int").alias("profile_id")), GEN_SEED)
    p = p.withColumn("profile_text", profile_text(p))
    return p.select(F.col("profile_id").alias("variant"), "name", "profile_text",
                    fill_request().alias("fill_request"))


@register
def generation_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with at least one variant neither on disk nor approved."""
    from longctx.operators.synth import generation_work
    blank, outputs, approved = _gen_inputs(spark, sf)
    _, triage = generation_work(blank, GEN_VARIANTS, outputs, approved, _variant_profiles(spark))
    return triage


@register
def generation_work(spark: SparkSession, sf: str) -> DataFrame:
    """Missing (page, variant) items with output name, progress key and request."""
    from longctx.operators.synth import generation_work as gw
    blank, outputs, approved = _gen_inputs(spark, sf)
    work, _ = gw(blank, GEN_VARIANTS, outputs, approved, _variant_profiles(spark))
    return work.select("file_name", "variant", "out_name", "progress_key", "name",
                       F.sha2(F.col("fill_request"), 256).alias("request_sha"))


@register
def generation_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Share of page × variant items done."""
    from longctx.operators.synth import generation_progress as gp
    blank, outputs, approved = _gen_inputs(spark, sf)
    return gp(blank, GEN_VARIANTS, outputs, approved)


# ------------------------------------------------------------------ full scoring run

def _scratch(spark, tag: str) -> str:
    """A new folder in the shared checkpoint folder."""
    import uuid
    from longctx.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def _score(spark, sf, with_lcs: bool, ledger: str | None = None):
    """The scoring run: stored verdicts and the gate first, then the panel through a call ledger."""
    from longctx.operators.jury import score_rows, with_row_key
    from longctx.operators.respond import settle_verdicts
    from longctx.plans.clients import JUDGES, rule_judges
    resp = fx.responses_df(spark, sf)
    # an earlier scoring run stored verdicts of responder m0; a later row of a key replaces an earlier one
    stored = with_row_key(resp.where(F.col("model") == "m0")).select(
        "row_key", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    stored = stored.select("row_key", "seq", F.col("seq").alias("judge_correct"), F.lit("").alias("judge_error"),
                           F.lit(1).alias("judge_concise"))
    judges = spark.createDataFrame([(j,) for j in JUDGES], "judge_id string")
    at = ledger or _scratch(spark, "verdicts")
    return score_rows(resp, RESPONSE_ID, lambda pending: settle_verdicts(pending, judges, rule_judges, at), cache=stored,
                      with_lcs=with_lcs)


@register
def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every response scored: heuristics, stored verdicts, gate 0, parsed jury verdicts."""
    s = _score(spark, sf, True)
    return s.select(*RESPONSE_ID, "row_key", "scored_from", "judge_concise", "judge_correct", "judge_complete",
                    "judge_accurate", F.coalesce(F.col("judge_error"), F.lit("")).alias("judge_error"),
                    _map_text("judge_votes").alias("votes"), _map_text("judge_rationales").alias("rationales"),
                    _map_text("judge_input_tokens").alias("input_tokens"), F.round("rougeL_f1", 9).alias("rougeL_f1"),
                    F.round("bleu", 9).alias("bleu"))


@register
def score_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A5: totals of the scoring run (stored, gate-0 failures, judged, errors, passed)."""
    from longctx.operators.jury import scoring_stats
    return scoring_stats(_score(spark, sf, False))


@register
def judge_calls(spark: SparkSession, sf: str) -> DataFrame:
    """What the scoring run asked its judges, from the ledger: nothing stored, gated or blank."""
    from longctx.operators.ledger import CallLedger
    from longctx.operators.respond import VERDICT_SCHEMA
    at = _scratch(spark, "verdicts")
    _score(spark, sf, False, at)
    asked = CallLedger(spark, at, ["row_key", "judge_id"], VERDICT_SCHEMA).results()
    return asked.select("row_key", "judge_id", "prompt_tokens", "verdict_text")


# ------------------------------------------------------------------ one run with a client

RUN = "now"


def run_spec():
    """Three levels for most models, so that cache groups have several members; the question alone is the prompt."""
    spec = fixture_spec()
    spec.modalities, spec.ratios, spec.thinking_default = ["image"], [0.0], ["minimal", "low", "high"]
    return spec


def _run_cells(spark, sf):
    """Cells with their prompts; every question whose length is a multiple of 13 is taken as blank."""
    from longctx.functions.keys import payload_fingerprint
    from longctx.operators.results import compose_prompt
    cells = fixture_matrix(spark, sf, run_spec())
    question = F.when(F.length("question") % 13 == 0, F.lit(" \n")).otherwise(F.col("question"))
    text, error = compose_prompt(F.lit(None).cast("string"), question, F.col("modality"))
    return cells.select(
        *[c for c in cells.columns if c not in ("question", "answer")], text.alias("prompt_text"), error.alias("prompt_error"),
        payload_fingerprint(F.col("model"), text).alias("payload_sha"))


def _earlier(cells):
    """An older run with equal requests, a newer one with other requests, and the first part of the run itself."""
    from longctx.operators.run import USAGE

    def run(name, day, keep, status, sha):
        n = F.col("ordinal")
        usage = [(n % 40 if c == "completion_tokens" else F.lit(2)).cast("bigint").alias(c) for c in USAGE]
        return cells.where(keep).select(
            "row_id", F.lit(name).alias("experiment_uuid"), F.lit(f"2026-01-0{day} 00:00:00").cast("timestamp").alias("run_ts"),
            n.alias("seq"), F.lit(status).alias("status"), sha.alias("payload_sha"),
            F.concat(F.lit(f"{name} "), n.cast("string")).alias("answer"), F.lit(None).cast("string").alias("thinking_text"),
            (n % 100).cast("bigint").alias("latency_ms"), *usage)
    n, sha = F.col("ordinal"), F.col("payload_sha")
    return (run("older", 1, n % 5 == 0, "ok", sha).unionByName(run("newer", 2, n % 7 == 0, "ok", F.reverse(sha)))
            .unionByName(run(RUN, 3, n % 9 == 0, "ok", sha)).unionByName(run(RUN, 3, n % 9 == 1, "error", sha)))


def _planned_cells(spark, sf):
    """The cells of the run, written once for all runs of a query."""
    from longctx.session import cut_lineage
    return cut_lineage(_run_cells(spark, sf))


def _run(spark, cells, **options):
    from longctx.operators.run import run_cells
    from longctx.plans.clients import MAX_ATTEMPTS, scripted_client
    return run_cells(cells, _earlier(cells), scripted_client, _scratch(spark, "calls"), RUN, per_round=20_000,
                     max_attempts=MAX_ATTEMPTS, initial_backoff=0.0, **options)


@register
def run_results(spark: SparkSession, sf: str) -> DataFrame:
    """A run that is resumed: done cells skipped, equal requests reused, the others called
    with retries, the members of a cache group one after the other in one task (the first one pays for the prompt)."""
    return _run(spark, _planned_cells(spark, sf)).select(
        "row_id", "status", "outcome", "error_type", F.coalesce("error_message", F.lit("")).alias("error_message"), "reused_from",
        "answer", F.coalesce("attempts", F.lit(0)).alias("attempts"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (
            "cache_creation_input_tokens", "cache_read_input_tokens", "completion_tokens", "latency_ms")])


@register
def run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of the resumed run, of a forced run without reuse, and of a dry run."""
    from longctx.operators.run import outcome_counts
    kinds = {"resumed": {}, "forced": {"force": True, "use_previous": False}, "dry": {"dry_run": True}}
    cells, out = _planned_cells(spark, sf), None
    for name, options in kinds.items():
        one = outcome_counts(_run(spark, cells, **options)).withColumn("run", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@register
def result_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The run's nested records written as JSON and read back, with a broken line and a file that is no JSON."""
    from longctx.sources.records import RESULT_SCHEMA, read_records, result_records, write_records
    at = _scratch(spark, "records")
    write_records(result_records(_run(spark, _planned_cells(spark, sf)), RUN, fixture_spec().seed), at)
    folder = f"{at}/results/experiment_uuid={RUN}"
    for broken in ('{"answer": "cut o', '{"answer": "a"} {"answer": "b"}\n\n[1, 2]'):
        spark.createDataFrame([(broken,)], "value string").write.mode("append").text(folder)
    good, bad = read_records(spark, f"{at}/results/*/*", RESULT_SCHEMA)
    rows = good.select(
        F.lit("record").alias("kind"), F.col("metadata.row_id").alias("row_id"), "answer", F.length("question").alias("question_chars"),
        F.col("metadata.status").alias("status"), F.col("metadata.error.type").alias("error_type"),
        F.coalesce("metadata.usage.completion_tokens", F.lit(-1)).alias("completion_tokens"),
        F.col("metadata.reused_from").alias("reused_from"), F.col("metadata.seed").alias("seed"))
    lost = bad.select(F.lit("unreadable").alias("kind"), F.lit(None).cast("string").alias("row_id"), F.col("value").alias("answer"),
                      F.lit(0).alias("question_chars"), *[F.lit(None).cast("string").alias(c) for c in ("status", "error_type")],
                      F.lit(-1).cast("bigint").alias("completion_tokens"), F.lit(None).cast("string").alias("reused_from"),
                      F.lit(0).alias("seed"))
    return rows.unionByName(lost)


@register
def summary_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """The run's log entries appended, then those of a forced run; the summary is rebuilt from the log."""
    from longctx.operators.results import SUMMARY_FIELDS, summary_table
    from longctx.sources.layout import read_csv_strings, write_csv
    from longctx.sources.records import SUMMARY_SCHEMA, append_log, read_records, summary_rows
    at = _scratch(spark, "summary")
    cells = _planned_cells(spark, sf)
    append_log(summary_rows(_run(spark, cells), RUN, "runs/now", 42), f"{at}/log")
    again = _run(spark, cells, force=True, use_previous=False).withColumn("later", F.col("ordinal") + 10_000_000)
    append_log(summary_rows(again.where(F.col("ordinal") % 4 == 0), RUN, "runs/now", 42, seq="later"), f"{at}/log")
    entries, _ = read_records(spark, f"{at}/log/*.json", SUMMARY_SCHEMA)
    write_csv(summary_table(entries), f"{at}/csv")
    return read_csv_strings(spark, f"{at}/csv").select(F.col("first_seq").cast("bigint").alias("first_seq"), *SUMMARY_FIELDS)


@register
def scored_export(spark: SparkSession, sf: str) -> DataFrame:
    """The scored table written twice as versions of one table, rounded, and read back."""
    from longctx.operators.jury import JUDGE_COLS
    from longctx.operators.metrics import HEURISTIC_COLS, round_metrics
    from longctx.session import shared_table
    from longctx.sources.layout import read_scored, write_scored
    at = _scratch(spark, "scored")
    rows = _score(spark, sf, False).select(*RESPONSE_ID, "response", *HEURISTIC_COLS[:4], "bleu", *JUDGE_COLS)
    shown, _ = shared_table(round_metrics(rows), "scores")  # both versions are written from it
    write_scored(shown.limit(5), at, [*RESPONSE_ID, "response"])
    write_scored(shown, at, [*RESPONSE_ID, "response"])
    back = read_scored(spark, at)
    return back.select(*RESPONSE_ID, *[F.col(c).cast("double").alias(c) for c in ("exact_match", "token_f1", "rouge1_f1")],
                       F.col("rougeL_f1").alias("rouge_l_text"), "judge_concise", "judge_correct", "judge_votes", "judge_error")


@register
def progress_current(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of generated pages, written in three updates; the last entry of a key counts."""
    from longctx.operators.synth import generation_work
    from longctx.sources.layout import read_progress, upsert_progress
    at = _scratch(spark, "progress")
    blank, outputs, approved = _gen_inputs(spark, sf)
    work, _ = generation_work(blank, GEN_VARIANTS, outputs, approved, _variant_profiles(spark))
    part = F.col("variant") % 3
    schema = "progress_key string, seq bigint, state string"
    for k, state in enumerate(("queued", "drawn", "approved")):
        upsert_progress(work.where(part >= k).select("progress_key", F.lit(k).cast("bigint").alias("seq"), F.lit(state).alias("state")), at)
    return read_progress(spark, at, schema).select("progress_key", "seq", "state")


@register
def matrix_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Provider settings of every cell, nested as the provider gets them, merged into the model's own."""
    from longctx.operators.thinking import apply_thinking
    spec = run_spec()
    spec.models[0].extra = {"labels": {"team": "x"}}
    spec.models[2].extra = {"region": "us-east5", "output_config": {"format": "json", "effort": "unset"}}
    spec.thinking_default = ["none", "low", "high"]
    cells = apply_thinking(fixture_matrix(spark, sf, spec))
    return cells.select("row_id", "model_config_id", "thinking", F.coalesce(F.to_json("thinking_settings"), F.lit("")).alias("settings"),
                        F.to_json("extra").alias("extra"))


# ------------------------------------------------------------------ ingest counts

@register
def ingest_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A2: rows per case (questions, pages) and per filler subdir, as reported on ingest."""
    q = fx.questions_df(spark, sf).groupBy(F.col("case_uuid").alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    p = fx.case_pages_df(spark, sf).groupBy(F.col("case_uuid").alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    f = fx.filler_pages_df(spark, sf).groupBy(F.col("subdir_name").alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    return (q.withColumn("table", F.lit("questions")).unionByName(p.withColumn("table", F.lit("case_pages")))
            .unionByName(f.withColumn("table", F.lit("filler_pages"))))


# ------------------------------------------------------------------ streaming

@register
def latest_status_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The result log replayed as a file stream through the stateful keep-last; the
    live status table read back (equal to the batch keep-last)."""
    from longctx.streaming.status import read_status, start_status_stream
    root = _scratch(spark, "t1")
    log = fx.result_log_df(spark, sf).drop("run_ts")
    log.repartition(5, "seq").write.parquet(f"{root}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    start_status_stream(stream, f"{root}/status", f"{root}/ck", compact_every=2).awaitTermination()
    return read_status(spark, f"{root}/status").select("row_id", "first_seq", "seq", "experiment_uuid", "status")


@register
def incremental_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Responses arriving per case, scored batch by batch with resume and dedupe."""
    from longctx.streaming.scoring import read_scores, start_incremental_scoring
    root = _scratch(spark, "t2")
    resp = fx.responses_df(spark, sf)
    resp.repartition(4, "case_uuid").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(resp.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    start_incremental_scoring(stream, f"{root}/scored", f"{root}/ck", RESPONSE_ID, with_lcs=False).awaitTermination()
    # the same files again, by a stream that starts anew: nothing is added
    again = spark.readStream.schema(resp.schema).parquet(f"{root}/in")
    start_incremental_scoring(again, f"{root}/scored", f"{root}/ck2", RESPONSE_ID, with_lcs=False).awaitTermination()
    return read_scores(spark, f"{root}/scored").select(*RESPONSE_ID, "n_ref_tokens", "n_pred_tokens", "ov_1",
                                                        "token_f1", "ref_chars", "response_chars", "concise")
