"""Fixture views over the driver tables.

The evaluation pipeline reads questions, case pages, filler pages, responses, judge verdicts
and a result log.  The driver ships TPC-H-ish tables instead, so each of those inputs is a
view over them.  ``VIEW_SQL`` is the SQL form the DuckDB oracle runs; the ``*_df``
functions build the same rows with the DataFrame API (the per-case ordinal of
``questions`` uses the skew-safe ordinal rather than a window over a whole case).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longctx.operators.ordinal import ordinal_within

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed view texts: the oracle prepends them as CTEs over the pre-registered base tables.
VIEW_SQL: dict[str, str] = {
    "case_pages": """
select source as case_uuid, concat(lpad(cast(doc_id as string), 9, '0'), '.txt') as summary_file,
       text as summary_text
from documents""",
    "filler_pages": """
select 'web' as subdir_name,
       concat('form-', cast(page_id % 12 as string), case when page_id % 2 = 0 then '-v1-' else '_' end,
              lpad(cast(page_id as string), 6, '0'), '.txt') as file_name,
       html as ocr_text
from pages
union all
select 'bench', concat('bench_', lpad(cast(item_id as string), 6, '0'), '.txt'), text from benchmark""",
    "case_images": """
select source as case_uuid, concat(lpad(cast(doc_id as string), 9, '0'), '.png') as image_file
from documents where doc_id % 3 <> 0
union all
select concat('scan', cast(page_id % 3 as string)), concat('page_', lpad(cast(page_id as string), 6, '0'), '.jpg')
from pages where page_id % 5 = 0""",
    "questions": """
select case_uuid,
       concat('q', lpad(cast(row_number() over (partition by case_uuid order by conv_id, turn) as string), 5, '0')) as prompt_id,
       text as question, nxt as answer,
       case when length(text) < 100 then 'Tier 1 · Easy' when length(text) < 250 then 'Tier 2 · Medium'
            when length(text) < 400 then 'Tier 3 · Hard' else '' end as difficulty
from (select concat('src', cast(conv_id % 20 as string)) as case_uuid, conv_id, turn, role, text,
             lead(text) over (partition by conv_id order by turn) as nxt,
             lead(role) over (partition by conv_id order by turn) as nxt_role
      from conversations) t
where role = 'user' and nxt_role = 'assistant'""",
    "responses": """
select case_uuid, prompt_id, question as prompt, difficulty, answer as human_validated_answer, model,
       case model when 'm0' then answer
                  when 'm1' then substr(answer, 1, cast(floor(length(answer) * 2 / 3) as int))
                  when 'm2' then concat(answer, ' ', question, ' ', answer, ' ', answer)
                  when 'm3' then question
                  else '' end as response
from questions cross join (select 'm0' as model union all select 'm1' union all select 'm2'
                           union all select 'm3' union all select 'm4') m""",
    "verdicts": """
select doc_id, 'j0' as judge_id, quality = 1 as complete, toxic = 0 as accurate, 1 as seq from labels
union all
select doc_id, 'j1', quality = 1, doc_id % 5 <> 0, 1 from labels
union all
select doc_id, 'j2', case when doc_id % 7 = 0 then null else quality = 1 end, toxic = 0, 1 from labels
union all
select doc_id, 'j0', quality <> 1, toxic = 0, 0 from labels where doc_id % 4 = 0""",
    "verdict_text": """
select doc_id,
       case doc_id % 15
         when 5 then 'no verdict'
         when 6 then '{"complete": true, "accurate": true}] {"x": 1}'
         when 7 then '{"complete": false, "complete": true, "accurate": true, "accurate": false}'
         when 8 then '{"complete": NaN, "accurate": true, "rationale": "n"}'
         when 9 then '{"complete": true, "accurate": true} trailing'
         when 10 then '  '
         when 11 then 'true'
         when 12 then '{"complete": true, "accurate": {"a": 1}, "rationale": null}'
         when 13 then '{"complete": true, "accurate": -Infinity}'
         when 14 then '{"complete": true "accurate": false}'
         when 0 then '{"complete": true, "accurate": false, "rationale": " date differs "}'
         when 1 then concat('```json', chr(10), '{"complete": "yes", "accurate": "no", "rationale": "x"}', chr(10), '```')
         when 2 then 'Verdict: {"complete": 1, "accurate": 0} end'
         when 3 then '{"complete": "2", "accurate": 2}'
         else '[1, 2]' end as verdict
from labels""",
    "result_log": """
select event_id as seq, concat('r', cast(user_id as string)) as row_id,
       concat('run', lpad(cast(day(ts) as string), 2, '0')) as experiment_uuid, ts as run_ts,
       case event_type when 'error' then 'error' when 'view' then 'dry_run' else 'ok' end as status,
       cast(regexp_extract(props, '[0-9]+', 0) as bigint) as prompt_tokens,
       case when event_id % 3 = 0 then 100 end as cache_read_input_tokens,
       cast(round(value * 100) as bigint) as completion_tokens
from events""",
    "run_log": """
select row_id, experiment_uuid, run_ts, status,
       row_number() over (partition by experiment_uuid order by seq) - 1 as seq from result_log""",
    "error_log": """
select event_id, 400 + event_id % 130 as code,
       case event_id % 4 when 0 then 'RateLimitError' when 1 then 'ValueError'
            when 2 then 'APIConnectionError' else 'KeyError' end as error_class,
       case event_id % 3 when 0 then 'request timed out' when 1 then 'Payload size exceeds the limit'
            else 'bad field' end as message
from events where event_type = 'error'""",
}

# Dependency order for CTE prefixes.
VIEW_ORDER = ["case_pages", "filler_pages", "case_images", "questions", "responses", "verdicts", "verdict_text",
              "result_log", "run_log", "error_log"]


def with_views(*names: str) -> str:
    """``WITH`` prefix defining the named fixture views (and what they depend on)."""
    need = set(names)
    if "responses" in need:
        need.add("questions")
    if "run_log" in need:
        need.add("result_log")
    parts = [f"{n} as ({VIEW_SQL[n].strip()})" for n in VIEW_ORDER if n in need]
    return "with " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------- DataFrame forms

def case_pages_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("case_uuid"),
        F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("summary_file"),
        F.col("text").alias("summary_text"),
    )


def filler_pages_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    b = read_table(spark, sf_dir, "benchmark")
    web = p.select(
        F.lit("web").alias("subdir_name"),
        F.concat(
            F.lit("form-"), (F.col("page_id") % 12).cast("string"),
            F.when(F.col("page_id") % 2 == 0, F.lit("-v1-")).otherwise(F.lit("_")),
            F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit(".txt"),
        ).alias("file_name"),
        F.col("html").alias("ocr_text"),
    )
    bench = b.select(
        F.lit("bench").alias("subdir_name"),
        F.concat(F.lit("bench_"), F.lpad(F.col("item_id").cast("string"), 6, "0"), F.lit(".txt")).alias("file_name"),
        F.col("text").alias("ocr_text"),
    )
    return web.unionByName(bench)


def case_images_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of two thirds of the documents, and cases that have images alone."""
    d, p = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages")
    docs = d.where(F.col("doc_id") % 3 != 0).select(
        F.col("source").alias("case_uuid"), F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".png")).alias("image_file"))
    scans = p.where(F.col("page_id") % 5 == 0).select(
        F.concat(F.lit("scan"), (F.col("page_id") % 3).cast("string")).alias("case_uuid"),
        F.concat(F.lit("page_"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit(".jpg")).alias("image_file"))
    return docs.unionAll(scans)


def image_pool_df(spark: SparkSession, sf_dir: str, subdir: str) -> DataFrame:
    """The image of each filler page of a pool."""
    pool = filler_pages_df(spark, sf_dir).where(F.col("subdir_name") == subdir)
    return pool.select(F.regexp_replace("file_name", r"\.txt$", ".jpg").alias("file_name"))


def difficulty_label(text_col) -> F.Column:
    n = F.length(text_col)
    return (F.when(n < 100, "Tier 1 · Easy").when(n < 250, "Tier 2 · Medium")
            .when(n < 400, "Tier 3 · Hard").otherwise(""))


def questions_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")  # one conversation: a handful of turns
    t = (c.select("conv_id", "turn", "role", "text")
         .withColumn("case_uuid", F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")))
         .withColumn("nxt", F.lead("text").over(w))
         .withColumn("nxt_role", F.lead("role").over(w))
         .where((F.col("role") == "user") & (F.col("nxt_role") == "assistant")))
    # A case may hold a third of all questions: rank with the range-partitioned ordinal.
    t = ordinal_within(t, ["case_uuid"], ["conv_id", "turn"], "q_ord")
    return t.select(
        "case_uuid",
        F.concat(F.lit("q"), F.lpad((F.col("q_ord") + 1).cast("string"), 5, "0")).alias("prompt_id"),
        F.col("text").alias("question"),
        F.col("nxt").alias("answer"),
        difficulty_label(F.col("text")).alias("difficulty"),
    )


RESPONSE_MODELS = ["m0", "m1", "m2", "m3", "m4"]


def responses_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions_df(spark, sf_dir)
    models = spark.createDataFrame([(m,) for m in RESPONSE_MODELS], "model string")
    a, qu, m = F.col("answer"), F.col("question"), F.col("model")
    resp = (F.when(m == "m0", a)
            .when(m == "m1", F.expr("substr(answer, 1, cast(floor(length(answer) * 2 / 3) as int))"))
            .when(m == "m2", F.concat(a, F.lit(" "), qu, F.lit(" "), a, F.lit(" "), a))
            .when(m == "m3", qu)
            .otherwise(F.lit("")))
    return q.crossJoin(F.broadcast(models)).select(
        "case_uuid", "prompt_id", F.col("question").alias("prompt"), "difficulty",
        F.col("answer").alias("human_validated_answer"), "model", resp.alias("response"))


def verdicts_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels")
    q, t, d = F.col("quality"), F.col("toxic"), F.col("doc_id")
    j0 = lab.select(d, F.lit("j0").alias("judge_id"), (q == 1).alias("complete"), (t == 0).alias("accurate"))
    j1 = lab.select(d, F.lit("j1").alias("judge_id"), (q == 1).alias("complete"), (d % 5 != 0).alias("accurate"))
    j2 = lab.select(d, F.lit("j2").alias("judge_id"),
                    F.when(d % 7 == 0, F.lit(None).cast("boolean")).otherwise(q == 1).alias("complete"),
                    (t == 0).alias("accurate"))
    last = j0.unionByName(j1).unionByName(j2).withColumn("seq", F.lit(1))
    # an earlier, replaced verdict of the first judge
    first = lab.where(d % 4 == 0).select(d, F.lit("j0").alias("judge_id"), (q != 1).alias("complete"),
                                         (t == 0).alias("accurate"), F.lit(0).alias("seq"))
    return last.unionByName(first)


VERDICT_SHAPES = [
    '{"complete": true, "accurate": false, "rationale": " date differs "}',
    '```json\n{"complete": "yes", "accurate": "no", "rationale": "x"}\n```',
    'Verdict: {"complete": 1, "accurate": 0} end',
    '{"complete": "2", "accurate": 2}',
    '[1, 2]',
    'no verdict',
    '{"complete": true, "accurate": true}] {"x": 1}',
    '{"complete": false, "complete": true, "accurate": true, "accurate": false}',
    '{"complete": NaN, "accurate": true, "rationale": "n"}',
    '{"complete": true, "accurate": true} trailing',
    '  ',
    'true',
    '{"complete": true, "accurate": {"a": 1}, "rationale": null}',
    '{"complete": true, "accurate": -Infinity}',
    '{"complete": true "accurate": false}',
]


def verdict_text_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels")
    shapes = F.array(*[F.lit(v) for v in VERDICT_SHAPES])
    return lab.select("doc_id", F.get(shapes, (F.col("doc_id") % len(VERDICT_SHAPES)).cast("int")).alias("verdict"))


def run_log_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result log with ``seq`` counted anew in every run."""
    log = result_log_df(spark, sf_dir).select("row_id", "experiment_uuid", "run_ts", "status", "seq")
    return ordinal_within(log, ["experiment_uuid"], ["seq"], "run_seq", carry=True).drop("seq").withColumnRenamed("run_seq", "seq")


def result_log_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    et = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("row_id"),
        F.concat(F.lit("run"), F.lpad(F.dayofmonth("ts").cast("string"), 2, "0")).alias("experiment_uuid"),
        F.col("ts").alias("run_ts"),
        F.when(et == "error", "error").when(et == "view", "dry_run").otherwise("ok").alias("status"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("prompt_tokens"),
        F.when(F.col("event_id") % 3 == 0, F.lit(100)).alias("cache_read_input_tokens"),
        F.round(F.col("value") * 100).cast("bigint").alias("completion_tokens"),
    )


def error_log_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    e = F.col("event_id")
    return ev.select(
        e,
        (F.lit(400) + e % 130).alias("code"),
        F.when(e % 4 == 0, "RateLimitError").when(e % 4 == 1, "ValueError")
        .when(e % 4 == 2, "APIConnectionError").otherwise("KeyError").alias("error_class"),
        F.when(e % 3 == 0, "request timed out").when(e % 3 == 1, "Payload size exceeds the limit")
        .otherwise("bad field").alias("message"),
    )
