"""DuckDB oracle SQL for the registered queries.

Each string is an independent, plain-SQL statement of the same result (windows over whole
groups, ``string_agg`` with ``order by``, literal dimension tables from the fixture spec):
the reference form the Spark plans are checked against.
"""

from __future__ import annotations

from longctx.sources.fixtures import with_views
from longctx.spec import ExperimentSpec, fixture_spec, format_ratio

ORACLE: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def h60(expr: str) -> str:
    """DuckDB form of the 60-bit md5 prefix hash."""
    return f"('0x' || substr(md5({expr}), 1, 15))::bigint"


def keyed(seed, *parts: str) -> str:
    return h60("concat_ws('|', " + ", ".join([_q(str(seed)), *parts]) + ")")


def ratios_values(spec: ExperimentSpec) -> str:
    rows = ", ".join(f"({float(r)!r}::double, {_q(format_ratio(r))}, {i})" for i, r in enumerate(spec.ratios))
    return f"(select * from (values {rows}) t(ablation_ratio, ratio_key, ratio_ord))"


def models_values(spec: ExperimentSpec) -> str:
    rows = ", ".join(f"({_q(m.id)}, {_q(m.provider)}, {_q(m.model)}, {i})" for i, m in enumerate(spec.models))
    return f"(select * from (values {rows}) t(model_config_id, provider, model, model_ord))"


def levels_values(spec: ExperimentSpec) -> str:
    rows = []
    for m in spec.models:
        for j, lv in enumerate(spec.thinking_overrides.get(m.id, spec.thinking_default)):
            rows.append(f"({_q(m.id)}, {_q(lv)}, {j})")
    return f"(select * from (values {', '.join(rows)}) t(model_config_id, thinking, level_ord))"


def modalities_values(spec: ExperimentSpec) -> str:
    rows = ", ".join(f"({_q(m)}, {i})" for i, m in enumerate(spec.modalities))
    return f"(select * from (values {rows}) t(modality, modality_ord))"


# ------------------------------------------------------------------ dilution

def context_pages_sql(spec: ExperimentSpec | None = None) -> str:
    return with_views("case_pages", "filler_pages") + ",\n" + context_body(spec)


def context_body(spec: ExperimentSpec | None = None) -> str:
    spec = spec or fixture_spec()
    s = spec.seed
    return f"""
real as (
  select case_uuid, summary_file, md5(summary_text) as text_md5, cast(length(summary_text) as bigint) as text_len,
         row_number() over (partition by case_uuid order by summary_file) - 1 as page_ord
  from case_pages),
pool as (
  select file_name, md5(ocr_text) as text_md5, cast(length(ocr_text) as bigint) as text_len,
         row_number() over (order by file_name) - 1 as pool_ord
  from filler_pages where subdir_name = {_q(spec.filler_subdir)}),
psize as (select count(*) as pool_size from pool),
ratios as {ratios_values(spec)},
ctx as (
  select c.case_uuid, c.n_real, r.ablation_ratio, r.ratio_key, p.pool_size,
         case when r.ablation_ratio > 0 and c.n_real > 0
              then cast(round_even(c.n_real * r.ablation_ratio, 0) as bigint) else 0 end as n_filler
  from (select case_uuid, count(*) as n_real from real group by case_uuid) c cross join ratios r cross join psize p),
draws as (
  select case_uuid, ratio_key, n_real, pool_size, k,
         {keyed(s, 'case_uuid', 'ratio_key', "'pos'", 'cast(k as varchar)')} % (n_real + 1) as pos
  from (select *, unnest(range(n_filler)) as k from ctx where n_filler > 0 and pool_size > 0)),
u as (
  select case_uuid, ratio_key, page_ord as pos, 1 as is_real, page_ord as k, null::bigint as pool_size,
         summary_file as source_file, text_md5, text_len
  from real cross join ratios
  union all
  select case_uuid, ratio_key, pos, 0, k, pool_size, null, null, null from draws),
ranked as (select *, row_number() over (partition by case_uuid, ratio_key order by pos, is_real, k) - 1 as ord from u),
pages as (
  select case_uuid, ratio_key, ord, false as is_filler, k as slot, pos, null::bigint as pool_ord,
         source_file, text_md5, text_len
  from ranked where is_real = 1
  union all
  select r.case_uuid, r.ratio_key, r.ord, true, r.ord - r.pos, r.pos, p.pool_ord, p.file_name, p.text_md5, p.text_len
  from ranked r join pool p
    on p.pool_ord = {keyed(s, 'r.case_uuid', 'r.ratio_key', "'page'", 'cast(r.ord - r.pos as varchar)')} % r.pool_size
  where r.is_real = 0)
"""


ORACLE["context_digest"] = context_pages_sql() + f"""
select case_uuid, ratio_key,
       count(*) filter (where not is_filler) as n_real, count(*) filter (where is_filler) as n_filler,
       count(*) as n_pages, cast(sum(text_len) + 2 * (count(*) - 1) as bigint) as n_chars,
       bit_xor({h60("concat(cast(ord as varchar), ':', text_md5)")}) as digest
from pages group by case_uuid, ratio_key"""

ORACLE["context_provenance"] = context_pages_sql() + """
select case_uuid, ratio_key, slot, pos, ord, pool_ord, source_file as filler_file from pages where is_filler"""


# ------------------------------------------------------------------ matrix

def thinking_sql(provider="provider", model="model", level="thinking") -> dict[str, str]:
    fam = "(" + " or ".join(f"starts_with({model}, {_q(p)})" for p in
                            ["gemini-2.5-flash", "gemini-2.5-flash-lite", "gemini-2.0"]) + ")"
    budget = (f"cast(case {level} when 'minimal' then 0 when 'low' then 4096 when 'medium' then 16384 "
              f"when 'high' then 32768 else 0 end as bigint)")
    on = f"{level} <> 'none'"
    g = f"{provider} = 'google'"
    return {
        "thinking_budget": f"case when {on} and {g} and {fam} then {budget} end",
        "include_thoughts": f"case when {on} and {g} and {fam} then (case when {budget} > 0 then true end) "
                            f"when {on} and {g} and not {fam} then true end",
        "thinking_level": f"case when {on} and {g} and not {fam} then upper({level}) end",
        "thinking_type": f"case when {on} and {provider} = 'anthropic_gcp' then 'adaptive' end",
        "effort": f"case when {on} and {provider} in ('anthropic_gcp', 'azure_openai') then {level} end",
    }


def matrix_sql(spec: ExperimentSpec | None = None, categories: list[str] | None = None) -> str:
    spec = spec or fixture_spec()
    cat = ""
    if categories:
        cat = "where difficulty in (" + ", ".join(_q(c) for c in categories) + ")"
    return with_views("questions") + ",\n" + matrix_body(spec, categories)


def matrix_body(spec: ExperimentSpec | None = None, categories: list[str] | None = None) -> str:
    spec = spec or fixture_spec()
    cat = ""
    if categories:
        cat = "where difficulty in (" + ", ".join(_q(c) for c in categories) + ")"
    rep_tail = "case when repetition > 0 then '|rep=' || cast(repetition as varchar) else '' end"
    return f"""
prompts as (select case_uuid, prompt_id || '.txt' as prompt_file, question, answer, difficulty from questions),
diffs as (select case_uuid, lower(trim(regexp_replace(prompt_file, '\\.[^.]*$', ''))) as prompt_key, difficulty
          from prompts where difficulty <> ''),
p as (select p.case_uuid, p.prompt_file, coalesce(d.difficulty, '') as difficulty
      from prompts p left join diffs d
        on d.case_uuid = p.case_uuid and d.prompt_key = lower(trim(regexp_replace(p.prompt_file, '\\.[^.]*$', '')))),
pf as (select * from p {cat}),
ml as (select m.*, l.thinking, l.level_ord from {models_values(spec)} m join {levels_values(spec)} l using (model_config_id)),
cells0 as (
  select pf.*, ml.*, mo.*, r.*, cast(rep.repetition as integer) as repetition
  from pf cross join ml cross join {modalities_values(spec)} mo cross join {ratios_values(spec)} r
  cross join (select unnest(range({spec.repetitions})) as repetition) rep),
cells as (
  select *, row_number() over (order by case_uuid, prompt_file, model_ord, modality_ord, ratio_ord, level_ord, repetition) as ordinal,
         substr(sha256(case_uuid || '|' || prompt_file || '|' || model_config_id || '|' || modality || '|' || ratio_key
                       || '|' || thinking || '|filler_subdir={spec.filler_subdir}' || {rep_tail}), 1, 16) as row_id
  from cells0)
"""


_MATRIX_COLS = ("ordinal, row_id, case_uuid, prompt_file, model_config_id, provider, model, modality, "
                "ablation_ratio, ratio_key, thinking, difficulty, repetition")

ORACLE["matrix_cells"] = matrix_sql() + "select " + _MATRIX_COLS + ", " + ", ".join(
    f"{v} as {k}" for k, v in thinking_sql().items()) + " from cells"

ORACLE["matrix_groups"] = matrix_sql() + """
select case_uuid, prompt_file, model_config_id, modality, ratio_key, repetition,
       min(ordinal) as first_ordinal, count(*) as n_members,
       string_agg(row_id, ',' order by ordinal) as member_row_ids,
       string_agg(thinking, ',' order by ordinal) as member_levels
from cells group by case_uuid, prompt_file, model_config_id, modality, ratio_key, repetition"""

ORACLE["matrix_size"] = (
    "select * from (" + matrix_sql() + "select count(*) as n_cells, max(ordinal) as max_ordinal from cells) a "
    "cross join (" + matrix_sql(categories=["Tier 1 · Easy", "Tier 2 · Medium"])
    + "select count(*) as n_cells_filtered, max(ordinal) as max_ordinal_filtered from cells) b")

ORACLE["matrix_preview"] = matrix_sql() + """
select ordinal, printf('%4d', ordinal) || '. ' || row_id || '  case=' || case_uuid || '  case_specific_prompt=' || prompt_file
       || '  model=' || model_config_id || '  modality=' || modality || '  junk_context_ratio=' || ratio_key
       || '  thinking=' || thinking || '  rep=' || cast(repetition as varchar) as line
from cells"""

ORACLE["matrix_first_cells"] = ORACLE["matrix_preview"] + " where ordinal <= 100"


# ------------------------------------------------------------------ metrics

_TOK = ("list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+'), "
        "lambda t: t not in ('a', 'an', 'the'))")
_ID = "case_uuid, prompt_id, model"


def metrics_sql() -> str:
    grams = " union all ".join(
        f"select {_ID}, {side} as side, {n} as n, array_to_string({col}[i:i+{n - 1}], chr(31)) as g "
        f"from (select {_ID}, {col}, unnest(generate_series(1, len({col}) - {n - 1})) as i from t)"
        for side, col in ((0, "rt"), (1, "pt")) for n in range(1, 5))
    ovs = ", ".join(
        f"coalesce(sum(case when n = {n} then least(c_ref, c_pred) end), 0)::bigint as ov_{n}, "
        f"coalesce(sum(case when n = {n} then c_ref end), 0)::bigint as ref_{n}, "
        f"coalesce(sum(case when n = {n} then c_pred end), 0)::bigint as pred_{n}" for n in range(1, 5))
    return with_views("responses") + f""",
t as (select {_ID}, human_validated_answer, response,
             {_TOK.format(x='human_validated_answer')} as rt, {_TOK.format(x='response')} as pt from responses),
grams as ({grams}),
counts as (select {_ID}, n, g, count(*) filter (where side = 0) as c_ref, count(*) filter (where side = 1) as c_pred
           from grams group by all),
agg as (select {_ID}, {ovs} from counts group by all),
m as (select t.{_ID.replace(', ', ', t.')}, t.rt = t.pt as same,
             {', '.join(f'coalesce(a.ov_{n}, 0) as ov_{n}, coalesce(a.ref_{n}, 0) as ref_{n}, coalesce(a.pred_{n}, 0) as pred_{n}' for n in range(1, 5))}
      from t left join agg a using ({_ID}))
"""


def _f1_sql(ov, ref, pred):
    p, r = f"({ov}::double / {pred}::double)", f"({ov}::double / {ref}::double)"
    return f"case when {ov} = 0 then 0.0::double else 2.0::double * {p} * {r} / ({p} + {r}) end"


def _guard(expr):
    return (f"case when ref_1 = 0 and pred_1 = 0 then 1.0::double when ref_1 = 0 or pred_1 = 0 then 0.0::double "
            f"else {expr} end")


def _rouge_n_sql(n):
    return _guard(f"case when ref_{n} = 0 and pred_{n} = 0 then (case when same then 1.0::double else 0.0::double end) "
                  f"when ref_{n} = 0 or pred_{n} = 0 then 0.0::double else {_f1_sql(f'ov_{n}', f'ref_{n}', f'pred_{n}')} end")


_LOGS = " + ".join(
    f"(case when pred_{n} = 0 then ({repr(__import__('math').log(1e-9))})::double "
    f"else ln((ov_{n} + 1)::double / (pred_{n} + 1)::double) end)" for n in range(1, 5))
_BLEU = _guard(f"(case when pred_1 > ref_1 then 1.0::double else exp(1.0::double - ref_1::double / pred_1::double) end)"
               f" * exp(({_LOGS}) / 4.0::double)")

ORACLE["metric_exact"] = metrics_sql() + f"""
select {_ID}, ref_1 as n_ref_tokens, pred_1 as n_pred_tokens, case when same then 1.0::double else 0.0::double end as exact_match
from m"""

ORACLE["metric_token_f1"] = metrics_sql() + f"""
select {_ID}, ref_1 as n_ref_tokens, pred_1 as n_pred_tokens, ov_1, {_guard(_f1_sql('ov_1', 'ref_1', 'pred_1'))} as token_f1
from m"""

ORACLE["metric_rouge_n"] = metrics_sql() + f"""
select {_ID}, ov_1, ov_2, ref_2, pred_2, {_rouge_n_sql(1)} as rouge1_f1, {_rouge_n_sql(2)} as rouge2_f1 from m"""

ORACLE["metric_bleu"] = metrics_sql() + f"""
select {_ID}, ov_1, ov_2, ov_3, ov_4, pred_1, pred_2, pred_3, pred_4, round({_BLEU}, 9) as bleu from m"""

_WS = "'[\\t\\n\\x0b\\f\\r\\x1c-\\x1f\\x{85}\\p{Z}]'"
ORACLE["conciseness_gate"] = with_views("responses") + f"""
, c as (select {_ID}, length(regexp_replace(coalesce(human_validated_answer, ''), {_WS}, '', 'g'))::bigint as ref_chars,
              length(regexp_replace(coalesce(response, ''), {_WS}, '', 'g'))::bigint as response_chars from responses)
select {_ID}, ref_chars, response_chars,
       case when ref_chars = 0 then response_chars = 0 else response_chars <= 3 * ref_chars end as concise from c"""


# ------------------------------------------------------------------ verdicts and jury

_PYWS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]"


def _strip(x):
    return f"regexp_replace({x}, '^{_PYWS}+|{_PYWS}+$', '', 'g')"


def _coerce(j, path):
    jt = f"json_type({j}, '{path}')"
    s = f"lower({_strip(f'json_extract_string({j}, {_q(path)})')})"
    return (f"case when {jt} = 'BOOLEAN' then json_extract({j}, '{path}')::boolean "
            f"when {jt} in ('UBIGINT', 'BIGINT', 'DOUBLE') then json_extract({j}, '{path}')::double <> 0 "
            f"when {jt} = 'VARCHAR' then (case when {s} in ('true', 'yes', '1') then true "
            f"when {s} in ('false', 'no', '0') then false end) end")


ORACLE["verdict_parse"] = with_views("verdict_text") + f""",
s as (select doc_id, {_strip('verdict')} as t0 from verdict_text),
f as (select doc_id, case when starts_with(t0, '```')
                          then {_strip("regexp_replace(regexp_replace(t0, '^```[a-zA-Z]*\\s*', ''), '\\s*```$', '')")}
                          else t0 end as t from s),
p as (select doc_id, case when json_valid(t) then t end as whole, regexp_extract(t, '(?s)\\{{.*\\}}') as span from f),
q as (select doc_id, whole, span, coalesce(whole, case when span <> '' and json_valid(span) then span end) as j from p),
r as (select doc_id, j,
        case when whole is not null then '' when span = '' then 'ValueError: no JSON object in judge output'
             when j is null then 'JSONDecodeError: invalid JSON' else '' end as error from q)
select doc_id,
       case when error = '' and json_type(j) = 'OBJECT' then {_coerce('j', '$.complete')} end as complete,
       case when error = '' and json_type(j) = 'OBJECT' then {_coerce('j', '$.accurate')} end as accurate,
       case when error = '' and json_type(j) = 'OBJECT'
            then {_strip("coalesce(json_extract_string(j, '$.rationale'), '')")} else '' end as rationale,
       error
from r where doc_id % 15 not in (7, 8, 12, 13)
-- shapes that this database's JSON reads in its own way: repeated keys, NaN, a null note, an infinity
union all select doc_id, true, doc_id % 15 in (8, 13), '', '' from labels where doc_id % 15 in (7, 13)
union all select doc_id, true, true, 'n', '' from labels where doc_id % 15 = 8
union all select doc_id, true, null, 'None', '' from labels where doc_id % 15 = 12"""

ORACLE["jury_verdict"] = with_views("verdicts") + """,
one as (select * from (select *, row_number() over (partition by doc_id, judge_id order by seq desc) as rn from verdicts) where rn = 1),
v as (select doc_id, judge_id, complete, accurate,
             complete is not null and accurate is not null as valid,
             case when complete is not null and accurate is not null then complete and accurate end as vote
      from one)
select doc_id, count(*) filter (where valid) as n_valid, count(*) filter (where valid and vote) as n_pass,
       case when count(*) filter (where valid) >= 2 then (case when count(*) filter (where valid and vote) >= 2 then 1 else 0 end) end as judge_correct,
       case when count(*) filter (where valid) >= 2 then (case when count(*) filter (where valid and complete) >= 2 then 1 else 0 end) end as judge_complete,
       case when count(*) filter (where valid) >= 2 then (case when count(*) filter (where valid and accurate) >= 2 then 1 else 0 end) end as judge_accurate,
       coalesce(string_agg(case when not valid then judge_id || ': unparseable verdict' end, '; ' order by judge_id || ': unparseable verdict'), '') as judge_error,
       string_agg(judge_id || '=' || coalesce(cast(vote as varchar), 'null'), ',' order by judge_id) as votes,
       string_agg(judge_id || '=' || case when valid then 'ok' else 'unparseable verdict' end, ',' order by judge_id) as rationales
from v group by doc_id"""


# ------------------------------------------------------------------ result log

_CUR = "'run15'"
_LAST = """last as (
  select row_id, min(seq) as first_seq, max(seq) as seq from result_log group by row_id),
lastrow as (select l.row_id, l.first_seq, r.seq, r.experiment_uuid, r.status
            from last l join result_log r on r.row_id = l.row_id and r.seq = l.seq)"""

ORACLE["log_keep_last"] = with_views("result_log") + ", " + _LAST + " select * from lastrow"

_PREV = f"""ended as (
  select * from run_log r where experiment_uuid <> {_CUR} and seq = (
    select max(seq) from run_log x where x.row_id = r.row_id and x.experiment_uuid = r.experiment_uuid)),
prev as (
  select row_id, experiment_uuid as reused_from, seq as reused_seq from (
    select *, row_number() over (partition by row_id order by run_ts desc, seq desc, experiment_uuid desc) as rn
    from ended where status = 'ok') where rn = 1)"""

ORACLE["reuse_latest_ok"] = with_views("run_log") + ", " + _PREV + " select * from prev"

_PLAN = f""",
{_PREV},
cur as (select * from (select *, row_number() over (partition by row_id order by seq desc) as rn
                       from run_log where experiment_uuid = {_CUR}) where rn = 1),
done as (select row_id from cur where status = 'ok'),
cells as (select distinct row_id from run_log),
plan as (select c.row_id, p.reused_from, p.reused_seq,
                case when p.reused_from is not null then 'reused' else 'call' end as action
         from cells c left join prev p using (row_id) where c.row_id not in (select row_id from done))
"""

ORACLE["resume_pending"] = with_views("run_log") + _PLAN + " select row_id, action, reused_from, reused_seq from plan"

ORACLE["run_progress"] = with_views("run_log") + _PLAN + """,
flag as (select p.*, p.action <> 'call' or c.row_id is not null as is_done from plan p left join cur c using (row_id))
select count(*) as total, count(*) filter (where action = 'reused') as cache_hits,
       count(*) filter (where action = 'call') as calls, count(*) filter (where action = 'dry_run') as dry_runs,
       count(*) filter (where is_done) as done,
       coalesce(round(100.0 * count(*) filter (where is_done) / count(*), 1), 100.0)::double as percent
from flag"""

ORACLE["status_counts"] = with_views("result_log") + ", " + _LAST + \
    " select status, count(*) as n from lastrow group by status"

_CLS = " or ".join(f"contains(lower(coalesce(error_class, '')), {_q(s)})" for s in [
    "ratelimit", "resourceexhausted", "deadlineexceeded", "overloaded", "throttl", "timeout", "cancelled",
    "unavailable", "serviceunavailable", "apiconnection", "internalserver", "remoteprotocol", "connect"])
_MSG = " or ".join(f"contains(lower(coalesce(message, '')), {_q(s)})" for s in [
    "timed out", "timeout", "deadline exceeded", "operation was cancelled", "cancelled", "server disconnected",
    "disconnected", "connection reset", "connection aborted", "connection error", "peer closed",
    "remotedisconnected", "incompleteread"])
ORACLE["error_classes"] = with_views("error_log") + f"""
select event_id, code, error_class,
       coalesce(code in (408, 409, 425, 429, 499, 500, 502, 503, 504, 529), false) or {_CLS} or {_MSG} as transient,
       coalesce(code = 400, false) and (contains(lower(coalesce(message, '')), 'payload size exceeds')
                                        or contains(lower(coalesce(message, '')), 'flex api is not supported')) as payload_limit
from error_log"""

ORACLE["responses_export"] = matrix_sql() + """,
res as (
  select c.*, q.question, q.answer,
         case c.model_ord when 0 then q.answer
              when 1 then substr(q.answer, 1, cast(floor(length(q.answer) * 2 / 3) as int))
              when 2 then concat(q.answer, ' ', q.question, ' ', q.answer, ' ', q.answer)
              when 3 then q.question else '' end as resp
  from cells c join prompts q using (case_uuid, prompt_file))
select r.case_uuid, coalesce(@QSTRIP@, '') as prompt, r.difficulty,
       coalesce(@ASTRIP@, '') as human_validated_answer, r.model, r.modality,
       r.ablation_ratio as junk_context_ratio, r.thinking, r.repetition,
       nullif(cast(floor(length(r.question) / 4) as bigint) + case when r.repetition > 0 then 100 else 0 end, 0) as input_tokens,
       cast(floor(length(r.resp) / 4) as bigint) as output_tokens,
       cast(case when r.thinking = 'high' then 64 else 0 end as bigint) as thinking_tokens,
       r.resp as response
from res r left join (select case_uuid, 'a' || substr(prompt_file, 2) as answer_file, answer from prompts) a
  on a.case_uuid = r.case_uuid and a.answer_file = 'a' || substr(r.prompt_file, 2)""".replace(
    "@QSTRIP@", _strip("r.question")).replace("@ASTRIP@", _strip("a.answer"))


# ------------------------------------------------------------------ reports

def _jury_sql():
    """The scoring run, row by row: the panel's verdicts as booleans instead of texts."""
    text = "concat('QUESTION:', chr(10), prompt, chr(10), chr(10), 'REFERENCE ANSWER (ground truth):', chr(10), " \
           "human_validated_answer, chr(10), chr(10), 'MODEL RESPONSE (to evaluate):', chr(10), response, chr(10))"
    no_json = "'j2: ValueError: no JSON object in judge output'"
    return f"""
gate as (select *, length(regexp_replace(human_validated_answer, {_WS}, '', 'g')) as rc,
                length(regexp_replace(response, {_WS}, '', 'g')) as pc,
                substr(sha256(concat_ws(chr(31), case_uuid, prompt, model, '', '', '', response)), 1, 24) as row_key,
                cast(floor(length({text}) / 4) as bigint) as in_tokens,
                length(human_validated_answer) as nr, length(response) as ng from responses),
kinds as (select *, case when model = 'm0' then 'cache'
                         when not (case when rc = 0 then pc = 0 else pc <= 3 * rc end) then 'gate0' else 'jury' end as kind,
                 pc = 0 as blank from gate),
panel as (
  select *, not blank and ng * 2 >= nr as c0, not blank and response = human_validated_answer as a0,
         not blank and ng >= 120 as c1, not blank and contains(response, substr(human_validated_answer, 1, 20)) as a1,
         case when blank then false when ng % 7 <> 0 then true end as c2,
         case when blank then false when ng % 7 <> 0 then ng >= nr * 0.5 end as a2 from kinds),
tally as (
  select *, 2 + (c2 is not null)::int as n_valid, (c0 and a0)::int + (c1 and a1)::int + coalesce(c2 and a2, false)::int as n_pass,
         c0::int + c1::int + coalesce(c2, false)::int as n_c, a0::int + a1::int + coalesce(a2, false)::int as n_a from panel),
scored as (
  select case_uuid, prompt_id, model, difficulty, row_key, kind as scored_from, in_tokens, blank,
         case kind when 'gate0' then 0 else 1 end as judge_concise,
         cast(case kind when 'cache' then 1 when 'gate0' then 0 else (n_pass >= 2)::int end as integer) as judge_correct,
         case when kind = 'jury' then (n_c >= 2)::int end as judge_complete,
         case when kind = 'jury' then (n_a >= 2)::int end as judge_accurate,
         case when kind = 'jury' and c2 is null then {no_json} else '' end as judge_error,
         case when kind = 'jury' then concat('j0=', cast(c0 and a0 as varchar), ',j1=', cast(c1 and a1 as varchar), ',j2=',
              coalesce(cast(c2 and a2 as varchar), 'null')) end as votes,
         case when kind <> 'jury' then null when blank then 'j0=empty response,j1=empty response,j2=empty response'
              else concat('j0=length and equality,j1=,j2=', case when c2 is null then substr({no_json}, 5) else '' end) end as rationales,
         case when kind <> 'jury' then null when blank then 'j0=0,j1=0,j2=0'
              else concat_ws(',', 'j0=' || in_tokens, 'j1=' || in_tokens, 'j2=' || in_tokens) end as input_tokens
  from tally)
"""


def _scored_sql():
    return with_views("responses") + ", " + _jury_sql()


# Longest common subsequence by anti-diagonals of the classic table, one list a pair and diagonal.
_LCS = f"""
lcs_in as (select {_ID}, case when len(rt) <= len(pt) then rt else pt end as a, case when len(rt) <= len(pt) then pt else rt end as b
           from t),
lcs_run as (
  select {_ID}, a, b, 1 as d, list_transform(range(len(a) + 1), lambda x: 0) as p2,
         list_transform(range(len(a) + 1), lambda x: 0) as p1 from lcs_in
  union all
  select {_ID}, a, b, d + 1, p1, list_transform(range(len(a) + 1), lambda i: case
             when i = 0 or d + 1 - i < 1 then 0
             when d + 1 - i > len(b) then p1[i]
             when a[i] = b[d + 1 - i] then p2[i] + 1
             else greatest(p1[i + 1], p1[i]) end)
  from lcs_run where d < len(a) + len(b)),
lcs as (select {_ID}, cast(p1[len(a) + 1] as bigint) as lcs from lcs_run where d = greatest(len(a) + len(b), 1))
"""
_ROUGE_L = _guard(_f1_sql("lcs", "ref_1", "pred_1"))


def _recursive(sql: str) -> str:
    return "with recursive " + sql.strip().removeprefix("with")


ORACLE["metric_rouge_l"] = _recursive(metrics_sql()) + ", " + _LCS + f"""
select m.{_ID.replace(', ', ', m.')}, ref_1 as n_ref_tokens, pred_1 as n_pred_tokens, lcs, {_ROUGE_L} as "rougeL_f1"
from m join lcs using ({_ID})"""

ORACLE["score_rows"] = _recursive(metrics_sql()) + ", " + _LCS + ", " + _jury_sql() + f"""
select s.{_ID.replace(', ', ', s.')}, row_key, scored_from, judge_concise, judge_correct, judge_complete, judge_accurate, judge_error,
       votes, rationales, input_tokens, round({_ROUGE_L}, 9) as "rougeL_f1", round({_BLEU}, 9) as bleu
from scored s join m using ({_ID}) join lcs using ({_ID})"""

ORACLE["score_stats"] = _scored_sql() + """
select count(*) as total, count(*) filter (where scored_from = 'cache') as cached,
       count(*) filter (where scored_from = 'gate0') as gate0_fail, count(*) filter (where scored_from = 'jury') as judged,
       count(*) filter (where judge_error <> '') as errors, count(*) filter (where judge_correct = 1) as passed
from scored"""

ORACLE["judge_calls"] = _scored_sql() + """
select distinct row_key, judge_id, in_tokens as prompt_tokens,
       case judge_id
         when 'j0' then concat('{"complete": ', cast(c0 as varchar), ', "accurate": ', cast(a0 as varchar),
                               ', "rationale": " length and equality "}')
         when 'j1' then concat('```json', chr(10), '{"complete": "', case when c1 then 'yes' else 'no' end, '", "accurate": ',
                               case when a1 then '1' else '0' end, '}', chr(10), '```')
         else case when c2 is null then 'no verdict'
                   else concat('Verdict: {"complete": true, "accurate": "', cast(a2 as varchar), '"} done') end end as verdict_text
from panel cross join (values ('j0'), ('j1'), ('j2')) j(judge_id) where kind = 'jury' and not blank"""


_MEAS = ("count(*) as n, count(judge_correct) as n_scored, count(*) filter (where judge_correct is null) as n_undetermined, "
         "cast(sum(judge_correct) as bigint) as n_pass, avg(cast(judge_correct as double)) as pass_rate")

ORACLE["pass_rate"] = _scored_sql() + f"""
select model, difficulty, {_MEAS}, grouping(model, difficulty) as level
from scored group by rollup (model, difficulty)"""

ORACLE["pass_rate_by_difficulty"] = _scored_sql() + f"""
select difficulty, model, {_MEAS}, grouping(difficulty, model) as level
from scored group by grouping sets ((model, difficulty), (difficulty), ())"""


# ------------------------------------------------------------------ forms and checks

_STEM = "regexp_replace(file_name, '\\.[^.]*$', '')"
_FORM = (f"case when regexp_matches({_STEM}, '-v\\d+-\\d+$') then regexp_replace({_STEM}, '-v\\d+-\\d+$', '') "
         f"else split_part({_STEM}, '_', 1) end")
_ALLOWED = ["form-1", "form-2", "form-7", "bench", "cms-1"]
_ALLOWED_SQL = "(" + ", ".join(_q(f) for f in _ALLOWED) + ")"

ORACLE["filler_forms"] = with_views("filler_pages") + f"""
select subdir_name, {_FORM} as form, count(*) as n_files, {_FORM} in {_ALLOWED_SQL} as allowed
from filler_pages group by all"""

_CASES = "(select * from (values ('src0'), ('src5'), ('src19'), ('src20'), ('srcX')) t(c))"
ORACLE["spec_violations"] = with_views("case_pages", "filler_pages", "case_images", "questions") + f""",
web as (select {_FORM} as form from filler_pages where subdir_name = 'web')
select * from (values ('unknown_level', 'b1:extreme'), ('empty_levels', 'c1'), ('negative_ratio', '-1'),
                      ('unknown_modality', 'audio'), ('unknown_model', 'z9')) t("check", subject)
union all select 'case_without_prompts', c from {_CASES} where c not in (select case_uuid from questions)
union all select 'case_without_pages', c from {_CASES} where c not in (select case_uuid from case_pages)
union all select 'case_without_images', c from {_CASES} where c = 'src5' or c not in (select case_uuid from case_images)
union all select 'image_pool_too_small', 'web' where exists (select 1 from web where form in {_ALLOWED_SQL})
union all select 'unknown_form', f from (select unnest({'[' + ', '.join(_q(f) for f in _ALLOWED) + ']'}) as f)
          where f not in (select form from web)
union all select 'empty_filler_pool', 'web' where not exists (select 1 from web where form in {_ALLOWED_SQL})"""


# ------------------------------------------------------------------ prompts and payloads

_SEP_LEN = len("\n\n---\n\nQuestion:\n")


def image_body(spec: ExperimentSpec | None = None) -> str:
    """Image channel after ``context_body``: the same draws, interleaved with the case's images."""
    spec = spec or fixture_spec()
    return f"""
ipool as (select regexp_replace(file_name, '\\.txt$', '.jpg') as image_file,
                 row_number() over (order by regexp_replace(file_name, '\\.txt$', '.jpg')) - 1 as pool_ord
          from filler_pages where subdir_name = {_q(spec.filler_subdir)}),
imgs as (select case_uuid, image_file, row_number() over (partition by case_uuid order by image_file) - 1 as img_ord from case_images),
nimg as (select case_uuid, count(*) as n_img from imgs group by case_uuid),
iu as (
  select case_uuid, ratio_key, img_ord as pos, 1 as is_real, img_ord as k, image_file from imgs cross join ratios
  union all
  select p.case_uuid, p.ratio_key, least(p.pos, coalesce(n.n_img, 0)), 0, p.slot, i.image_file
  from pages p join ipool i using (pool_ord) left join nimg n using (case_uuid) where p.is_filler),
ipages as (select case_uuid, ratio_key, row_number() over (partition by case_uuid, ratio_key order by pos, is_real, k) - 1 as ord,
                  is_real = 0 as is_filler, image_file, k as slot, pos from iu),
ictx as (select case_uuid, ratio_key from (select case_uuid from case_pages union select case_uuid from case_images)
         cross join ratios)
"""


_IMAGES = with_views("case_pages", "filler_pages", "case_images") + ",\n" + context_body() + ",\n" + image_body()
ORACLE["image_provenance"] = _IMAGES + " select * from ipages"
ORACLE["filler_meta"] = _IMAGES + f""",
tx as (select case_uuid, ratio_key, count(*) filter (where not is_filler) as nr, count(*) filter (where is_filler) as nf,
              bit_xor({h60("concat(cast(slot as varchar), ':', source_file)")}) filter (where is_filler) as text_files,
              bit_xor({h60("concat(cast(slot as varchar), ':', cast(pos as varchar))")}) filter (where is_filler) as insertion_positions
       from pages group by all),
im as (select case_uuid, ratio_key, bit_xor({h60("concat(cast(slot as varchar), ':', image_file)")}) filter (where is_filler) as image_files
       from ipages group by all)
select c.case_uuid, c.ratio_key, coalesce(nr, 0) as real_page_count, coalesce(nf, 0) as filler_page_count,
       coalesce(text_files, 0) as text_files, coalesce(image_files, 0) as image_files, coalesce(insertion_positions, 0) as insertion_positions
from ictx c left join tx using (case_uuid, ratio_key) left join im using (case_uuid, ratio_key)"""


def payload_sql(seed: int | None = None) -> str:
    spec = fixture_spec()
    spec.modalities = ["text", "image", "both"]
    spec.seed = spec.seed if seed is None else seed
    q = _strip("qq.question")
    return (with_views("case_pages", "filler_pages", "case_images", "questions") + ",\n" + context_body(spec) + ",\n"
            + image_body(spec) + ",\n" + matrix_body(spec) + f""",
ctxsum as (select case_uuid, ratio_key, cast(sum(text_len) + 2 * (count(*) - 1) as bigint) as n_chars,
                  bit_xor({h60("concat(cast(ord as varchar), ':', text_md5)")}) as digest
           from pages group by case_uuid, ratio_key),
imgsum as (select case_uuid, ratio_key, count(*) as n_images, bit_xor({h60("concat(cast(ord as varchar), ':', image_file)")}) as idig
           from ipages group by case_uuid, ratio_key),
pay as (
  select c.row_id, c.ordinal, c.case_uuid, c.ratio_key, c.modality, c.model, c.model_config_id,
         cast((case when c.modality in ('text', 'both') then coalesce(x.n_chars, 0) + {_SEP_LEN} else 0 end)
              + length({q}) as bigint) as prompt_chars,
         case when c.modality in ('image', 'both') then coalesce(i.n_images, 0) else 0 end as n_images,
         sha256(concat_ws(chr(30), c.model, concat_ws('|', case when c.modality in ('text', 'both')
              then coalesce(cast(x.digest as varchar), '') end, {q}),
              case when c.modality in ('image', 'both') then coalesce(cast(i.idig as varchar), '') else '' end)) as payload_sha
  from cells c join prompts qq on qq.case_uuid = c.case_uuid and qq.prompt_file = c.prompt_file
  left join ctxsum x on x.case_uuid = c.case_uuid and x.ratio_key = c.ratio_key
  left join imgsum i on i.case_uuid = c.case_uuid and i.ratio_key = c.ratio_key)
""")


ORACLE["prompt_payloads"] = payload_sql() + " select * exclude (ordinal) from pay"
ORACLE["payload_groups"] = payload_sql() + " select payload_sha, model, count(*) as n_cells from pay group by all"
ORACLE["reuse_by_payload"] = f"""
with mine as (select * from ({payload_sql()} select row_id, ordinal, ratio_key, payload_sha from pay)),
other as (select * from ({payload_sql(7)} select row_id, ordinal, payload_sha from pay)),
log as (select row_id, payload_sha, 'same' as run, 1 as day, ordinal as seq from mine where ordinal % 3 = 0
        union all select row_id, payload_sha, 'other', 2, ordinal from other where ordinal % 2 = 0),
newest as (select * from (select *, row_number() over (partition by row_id, payload_sha order by day desc) as rn from log) where rn = 1)
select m.row_id, m.ratio_key, case when n.run is null then 'call' else 'reused' end as action, n.run as reused_from, n.seq as reused_seq
from mine m left join newest n using (row_id, payload_sha)"""


# ------------------------------------------------------------------ synthetic filler

def _profile_sql(pid: str, seed: int = 42, as_of: str = "2026-01-01") -> dict[str, str]:
    from longctx.operators import synth as sy

    def h(field, pos=0):
        return keyed(seed, pid, _q(field), _q(str(pos)))

    def pick(words, hh):
        return "[" + ", ".join(_q(w) for w in words) + f"][{hh} % {len(words)} + 1]"

    def pat(field, p):
        parts = []
        for i, ch in enumerate(p):
            if ch == "#":
                parts.append(f"cast({h(field, i)} % 10 as varchar)")
            elif ch == "?":
                parts.append(f"substr({_q(sy.LETTERS)}, cast({h(field, i)} % {len(sy.LETTERS)} + 1 as integer), 1)")
            else:
                parts.append(_q(ch))
        return "concat(" + ", ".join(parts) + ")"

    first, last = pick(sy.FIRST, h("first")), pick(sy.LAST, h("last"))
    cols = {
        "first_name": first, "last_name": last, "name": f"concat_ws(' ', {first}, {last})",
        "dob": f"strftime(date '{as_of}' - cast({18 * 365} + {h('dob')} % {67 * 365} as integer), '%Y-%m-%d')",
        "address": f"concat(cast({h('num')} % 9000 + 100 as varchar), ' ', {pick(sy.STREETS, h('street'))}, ' ', "
                   f"{pick(sy.STREET_KIND, h('kind'))})",
        "city": pick(sy.CITIES, h("city")), "state": pick(sy.STATES, h("state")),
        "email": f"lower(concat({first}, '.', {last}, '@', {pick(sy.DOMAINS, h('domain'))}))",
        "company": f"concat_ws(' ', {pick(sy.LAST, h('company'))}, {pick(sy.COMPANY_KIND, h('ckind'))})",
        "date_today": f"strftime(date '{as_of}' + cast({h('today')} % 365 as integer), '%Y-%m-%d')",
        "physician": f"concat('Dr. ', {pick(sy.LAST, h('physician'))})",
    }
    for f, p in sy.PATTERNS.items():
        cols[f] = pat(f, p)
    return {f: cols[f] for f, _ in sy.PROFILE_LABELS}


def _profiles_select(pid_expr: str, id_alias: str) -> str:
    from longctx.operators import synth as sy
    cols = _profile_sql(f"cast({pid_expr} as varchar)")
    text = "concat_ws(chr(10), " + ", ".join(f"concat({_q(label + ': ')}, {cols[f]})" for f, label in sy.PROFILE_LABELS) + ")"
    return (f"{pid_expr} as {id_alias}, " + ", ".join(f"{v} as {k}" for k, v in cols.items())
            + f", {text} as profile_text")


ORACLE["synthetic_profiles"] = f"select {_profiles_select('page_id', 'profile_id')} from pages"


def _gen_sql():
    from longctx.operators import synth as sy
    pre, _, post = sy.FILL_TEMPLATE.partition("{faker_data}")
    return with_views("filler_pages") + f""",
blank as (select file_name, split_part({_STEM}, '_', 1) as prefix from filler_pages where subdir_name = 'web'),
ids as (select page_id, concat('form-', cast(page_id % 12 as varchar), case when page_id % 2 = 0 then '-v1-' else '_' end,
                               lpad(cast(page_id as varchar), 6, '0'), '.txt') as file_name from pages),
vs as (select cast(unnest(range(1, 4)) as integer) as variant),
outputs as (select file_name, variant from ids cross join vs
            where page_id % 4 = 0 or (page_id % 4 = 1 and variant = 1)),
approved as (select file_name, variant from ids cross join vs where page_id % 10 = 2),
grid as (select b.*, v.variant from blank b cross join vs v),
missing as (select * from grid g where not exists (select 1 from outputs o where o.file_name = g.file_name and o.variant = g.variant)
                                  and not exists (select 1 from approved a where a.file_name = g.file_name and a.variant = g.variant)),
prof as (select {_profiles_select('variant', 'pv')} from vs),
req as (select pv as variant, name, {_q(pre)} || profile_text || {_q(post)} as fill_request from prof)
"""


_PNUM = (f"case when strpos({_STEM}, '_') > 0 then substr({_STEM}, strpos({_STEM}, '_') + 1) else '001' end")
ORACLE["blank_forms"] = with_views("filler_pages") + f"""
select split_part({_STEM}, '_', 1) as prefix, count(*) as n_pages, min(file_name) as first_page, max(file_name) as last_page,
       bit_xor({h60('file_name')}) as pages_digest from filler_pages group by 1"""

ORACLE["generation_queue"] = _gen_sql() + " select file_name, prefix, count(*) as n_missing from missing group by all"
ORACLE["generation_work"] = _gen_sql() + f"""
select m.file_name, m.variant, printf('%s-v%d-%s.jpg', m.prefix, m.variant, {_PNUM.replace('file_name', 'm.file_name')}) as out_name,
       printf('%s::v%d::%s', m.prefix, m.variant, m.file_name) as progress_key, r.name, sha256(r.fill_request) as request_sha
from missing m join req r using (variant)"""
ORACLE["generation_progress"] = _gen_sql() + """,
done as (select distinct file_name, variant from (select * from outputs union all select * from approved)),
flag as (select g.file_name, g.variant, d.file_name is not null as is_done
         from grid g left join done d on d.file_name = g.file_name and d.variant = g.variant)
select count(*) as total, count(*) filter (where is_done) as done, count(*) filter (where is_done) / count(*) as fraction
from flag"""


# ------------------------------------------------------------------ one run with a client

def _run_sql(name: str = "run", spec: ExperimentSpec | None = None) -> str:
    """Results of the resumed run, row by row."""
    from longctx.plans.catalog import run_spec
    prompt = _strip("q.question")
    return matrix_sql(spec or run_spec()) + f""",
todo as (select c.*, {prompt} as prompt_text, length(q.question) % 13 = 0 as bad
         from cells c join prompts q using (case_uuid, prompt_file) where c.ordinal % 9 <> 0),
kinds as (select *, case when bad then 'bad' when ordinal % 5 = 0 then 'reused' when ordinal % 11 = 0 then 'refused'
                         when ordinal % 6 >= 4 then 'limited' else 'answered' end as kind from todo),
seen as (select *, row_number() over (partition by kind, case_uuid, prompt_file, model_config_id, repetition order by ordinal) as nth from kinds),
{name} as (
  select row_id, ordinal, case_uuid, prompt_file, model_config_id, provider, model, modality, ablation_ratio, thinking, difficulty, repetition, prompt_text,
         case when kind in ('answered', 'reused') then 'ok' else 'error' end as status,
         case kind when 'answered' then 'ok' when 'reused' then 'reused' else 'error' end as outcome,
         case kind when 'bad' then 'PermanentProviderError' when 'refused' then 'PermanentError' when 'limited' then 'RateLimitError' end as error_type,
         case kind when 'bad' then 'PermanentProviderError: prompt file is empty' when 'refused' then 'refused' when 'limited' then 'slow down' else '' end as error_message,
         case kind when 'reused' then 'older' end as reused_from,
         case kind when 'reused' then 'older ' || ordinal when 'answered' then thinking || ' answer ' || ordinal else '' end as answer,
         case kind when 'answered' then ordinal % 6 + 1 when 'refused' then 1 when 'limited' then 4 else 0 end as attempts,
         case when kind = 'reused' then 2 when kind = 'answered' and nth = 1 then length(prompt_text) else 0 end as cache_creation_input_tokens,
         case when kind = 'reused' then 2 when kind = 'answered' and nth > 1 then length(prompt_text) else 0 end as cache_read_input_tokens,
         case kind when 'reused' then ordinal % 40 when 'answered' then ordinal % 50 else 0 end as completion_tokens,
         case kind when 'reused' then ordinal % 100 when 'answered' then ordinal % 900 else 0 end as latency_ms
  from seen)
"""


ORACLE["run_results"] = _run_sql() + """
select row_id, status, outcome, error_type, error_message, reused_from, answer, attempts, cache_creation_input_tokens,
       cache_read_input_tokens, completion_tokens, latency_ms from run"""


def _outcomes_sql() -> str:
    from longctx.plans.catalog import run_spec
    return f"""
select outcome, count(*) as n, 'resumed' as run from ({_run_sql()} select * from run) group by outcome
union all
select outcome, count(*), 'forced' from (
  select case when bad or ordinal % 11 = 0 or ordinal % 6 >= 4 then 'error' else 'ok' end as outcome
  from ({matrix_sql(run_spec())} select c.ordinal, length(q.question) % 13 = 0 as bad from cells c join prompts q using (case_uuid, prompt_file)))
group by outcome
union all
select case when bad then 'error' else 'dry_run' end, count(*), 'dry' from (
  {matrix_sql(run_spec())} select c.ordinal, length(q.question) % 13 = 0 as bad from cells c join prompts q using (case_uuid, prompt_file)
  where c.ordinal % 9 <> 0) group by 1"""


ORACLE["run_outcomes"] = _outcomes_sql()

ORACLE["result_roundtrip"] = _run_sql() + """
select 'record' as kind, row_id, answer, case when status = 'error' then 0 else length(prompt_text) end as question_chars, status, error_type,
       case when status = 'error' then -1 else completion_tokens end as completion_tokens, reused_from, 42 as seed from run
union all
select 'unreadable', null, v, 0, null, null, -1, null, 0
from (values ('{"answer": "cut o'), ('{"answer": "a"} {"answer": "b"}'), ('[1, 2]')) t(v)"""


def _summary_sql() -> str:
    from longctx.plans.catalog import run_spec
    return f"""
with first as (select * from ({_run_sql()} select * from run)),
forced as (select *, kind in ('bad', 'refused', 'limited') as failed from (
  {matrix_sql(run_spec())} select c.*, case when length(q.question) % 13 = 0 then 'bad' when ordinal % 11 = 0 then 'refused'
                                           when ordinal % 6 >= 4 then 'limited' else 'answered' end as kind
  from cells c join prompts q using (case_uuid, prompt_file) where c.ordinal % 4 = 0)),
entries as (
  select row_id, ordinal as seq, case_uuid, prompt_file, model_config_id, provider, model, modality, ablation_ratio, thinking,
         difficulty, repetition, latency_ms, status, error_type, error_message, coalesce(reused_from, '') as reused_from from first
  union all
  select row_id, ordinal + 10000000, case_uuid, prompt_file, model_config_id, provider, model, modality, ablation_ratio, thinking,
         difficulty, repetition, case when failed then 0 else ordinal % 900 end, case when failed then 'error' else 'ok' end,
         case kind when 'bad' then 'PermanentProviderError' when 'refused' then 'PermanentError' when 'limited' then 'RateLimitError' end,
         case kind when 'bad' then 'PermanentProviderError: prompt file is empty' when 'refused' then 'refused' else 'slow down' end, ''
  from forced),
kept as (select *, min(seq) over (partition by row_id) as first_seq, row_number() over (partition by row_id order by seq desc) as rn from entries)
select first_seq, 'now' as experiment_uuid, row_id, case_uuid, prompt_file as prompt_path, model_config_id, provider, model, modality,
       cast(ablation_ratio as varchar) as ablation_ratio, thinking, difficulty, cast(repetition as varchar) as repetition, '42' as seed,
       cast(latency_ms as varchar) as latency_ms, status,
       case when status = 'error' then concat('{{"type":"', error_type, '","message":"', error_message, '"}}') else '' end as error, reused_from,
       concat('runs/now/', row_id, '/prompt.txt') as prompt_artifact, concat('runs/now/', row_id, '/result.json') as result_path
from kept where rn = 1"""


ORACLE["summary_rebuild"] = _summary_sql()

ORACLE["scored_export"] = metrics_sql() + ", " + _jury_sql() + f"""
select s.{_ID.replace(', ', ', s.')}, case when same then 1.0::double else 0.0::double end as exact_match,
       round_even({_guard(_f1_sql('ov_1', 'ref_1', 'pred_1'))}, 4) as token_f1, round_even({_rouge_n_sql(1)}, 4) as rouge1_f1,
       '' as rouge_l_text, cast(judge_concise as varchar) as judge_concise, coalesce(cast(judge_correct as varchar), '') as judge_correct,
       coalesce('{{' || regexp_replace(votes, '(j\\d)=(\\w+)', '"\\1":\\2', 'g') || '}}', '') as judge_votes, judge_error
from scored s join m using ({_ID})"""

ORACLE["progress_current"] = _gen_sql() + """
select printf('%s::v%d::%s', prefix, variant, file_name) as progress_key, variant % 3 as seq,
       case variant % 3 when 0 then 'queued' when 1 then 'drawn' else 'approved' end as state from missing"""


def _settings_sql() -> str:
    from longctx.plans.catalog import run_spec
    spec = run_spec()
    spec.thinking_default = ["none", "low", "high"]
    t = thinking_sql()
    return matrix_sql(spec) + f"""
select row_id, model_config_id, thinking,
       case when thinking = 'none' then ''
            when provider = 'google' and {t['thinking_budget']} is not null then
              concat('{{', case when {t['include_thoughts']} then '"include_thoughts":true,' else '' end, '"thinking_budget":', {t['thinking_budget']}, '}}')
            when provider = 'google' then concat('{{"include_thoughts":true,"thinking_level":"', upper(thinking), '"}}')
            when provider = 'anthropic_gcp' then '{{"type":"adaptive"}}'
            when provider = 'azure_openai' then concat('{{"effort":"', thinking, '"}}') else '' end as settings,
       case when model_config_id = 'a1' then '{{"labels":{{"team":"x"}}}}'
            when provider = 'anthropic_gcp' then concat('{{"output_config":{{"effort":"', case when thinking = 'none' then 'unset' else thinking end,
                 '","format":"json"}},"region":"us-east5"}}') else '{{}}' end as extra
from cells"""


ORACLE["matrix_settings"] = _settings_sql()


# ------------------------------------------------------------------ ingest counts, streaming

ORACLE["ingest_counts"] = with_views("case_pages", "filler_pages", "questions") + """
select case_uuid as scope, count(*) as n, 'questions' as "table" from questions group by 1
union all select case_uuid, count(*), 'case_pages' from case_pages group by 1
union all select subdir_name, count(*), 'filler_pages' from filler_pages group by 1"""

ORACLE["latest_status_stream"] = ORACLE["log_keep_last"]

ORACLE["incremental_scores"] = metrics_sql() + f""",
c as (select {_ID}, length(regexp_replace(coalesce(human_validated_answer, ''), {_WS}, '', 'g'))::bigint as ref_chars,
             length(regexp_replace(coalesce(response, ''), {_WS}, '', 'g'))::bigint as response_chars from responses)
select m.{_ID.replace(', ', ', m.')}, ref_1 as n_ref_tokens, pred_1 as n_pred_tokens, ov_1,
       {_guard(_f1_sql('ov_1', 'ref_1', 'pred_1'))} as token_f1, ref_chars, response_chars,
       case when ref_chars = 0 then response_chars = 0 else response_chars <= 3 * ref_chars end as concise
from m join c using ({_ID})"""
