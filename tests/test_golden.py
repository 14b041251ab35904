"""Golden edge rows (hand-computed from the definitions)."""

import math

from pyspark.sql import functions as F

from longctx.functions.errors import is_payload_limit, is_transient
from longctx.functions.text import filler_form, normalize_text
from longctx.operators.jury import assemble_votes, jury_verdict, parse_verdicts
from longctx.operators.metrics import conciseness, text_metrics
from longctx.operators.ordinal import ordinal_within
from longctx.operators.results import keep_last, usage_columns
from longctx.spec import format_ratio


def test_half_even_filler_count(spark):
    df = spark.createDataFrame([(5, 0.5), (7, 0.5), (3, 1.25)], "n long, r double")
    got = [r[0] for r in df.select(F.bround(F.col("n") * F.col("r"), 0).cast("long")).collect()]
    assert got == [2, 4, 4]


def test_interleave_rule(spark):
    # real [a, b]; draws x, y, z at sorted positions [0, 2, 2] -> x a b y z
    real = [("c", "0", i, 1, i, t) for i, t in enumerate("ab")]
    fill = [("c", "0", p, 0, k, t) for k, (p, t) in enumerate(zip([0, 2, 2], "xyz"))]
    df = spark.createDataFrame(real + fill, "case_uuid string, ratio_key string, pos long, is_real int, k long, t string")
    ranked = ordinal_within(df, ["case_uuid", "ratio_key"], ["pos", "is_real", "k"], "ord")
    assert "".join(r.t for r in ranked.orderBy("ord").collect()) == "xabyz"


def test_filler_form(spark):
    df = spark.createDataFrame([("form-1_003.jpg",), ("cms-10106-v1-001.jpg",), ("plain.txt",)], "f string")
    assert [r[0] for r in df.select(filler_form(F.col("f"))).collect()] == ["form-1", "cms-10106", "plain"]


def test_format_ratio():
    assert [format_ratio(x) for x in (0, 1, 0.5, 1.25)] == ["0", "1", "0.5", "1.25"]


def test_normalize(spark):
    df = spark.createDataFrame([("The  Mild, tear!",), (None,)], "s string")
    assert [r[0] for r in df.select(normalize_text(F.col("s"))).collect()] == ["mild tear", ""]


def _metrics(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)],
                               "id long, human_validated_answer string, response string")
    return {r.id: r for r in text_metrics(df, ["id"]).collect()}


def test_metric_edges(spark):
    m = _metrics(spark, [("", ""), ("x", ""), ("x x y", "x y y"), ("x", "x"), ("x", "y"), ("x", "x y"),
                         ("x y z w", "x z y w")])
    for c in ("exact_match", "token_f1", "rouge1_f1", "rouge2_f1", "rougeL_f1", "bleu"):
        assert m[0][c] == 1.0 and m[1][c] == 0.0
    assert abs(m[2].token_f1 - 2 / 3) < 1e-12
    assert m[3].rouge2_f1 == 1.0 and m[4].rouge2_f1 == 0.0 and m[5].rouge2_f1 == 0.0
    assert m[6].lcs == 3 and abs(m[6].rougeL_f1 - 0.75) < 1e-12
    assert abs(m[3].bleu - math.exp((0 + 3 * math.log(1e-9)) / 4)) < 1e-15


def test_conciseness_gate(spark):
    df = spark.createDataFrame([("ab", "abcdef"), ("ab", "abcdefg"), ("", " "), ("", "a"), ("a b", "a\tb c d e f")],
                               "human_validated_answer string, response string")
    assert [r.concise for r in conciseness(df).collect()] == [True, False, True, False, True]


def test_verdict_coercion(spark):
    texts = ['{"complete": true, "accurate": 0}', '{"complete": 2, "accurate": " YES "}',
             '{"complete": "2", "accurate": null}', '[1, 2]', 'no json', '```json\n{"complete": "no", "accurate": "1"}\n```']
    df = spark.createDataFrame([(i, t, "r", "j") for i, t in enumerate(texts)],
                               "i long, verdict_text string, response string, judge_id string")
    rows = {r.i: r for r in parse_verdicts(df).collect()}
    assert (rows[0].complete, rows[0].accurate) == (True, False)
    assert (rows[1].complete, rows[1].accurate) == (True, True)
    assert (rows[2].complete, rows[2].accurate) == (None, None)
    assert (rows[3].complete, rows[3].error) == (None, "")
    assert rows[4].error.startswith("ValueError")
    assert (rows[5].complete, rows[5].accurate) == (False, True)


def test_blank_response_verdict(spark):
    df = spark.createDataFrame([("whatever", "  ", "j0")], "verdict_text string, response string, judge_id string")
    r = parse_verdicts(df).collect()[0]
    assert (r.complete, r.accurate, r.rationale) == (False, False, "empty response")


def test_jury_majority(spark):
    rows = []
    for key, votes in {"a": [True, True, False], "b": [True, False, None], "c": [True, None, None],
                       "d": [True, True, None]}.items():
        for j, v in enumerate(votes):
            rows.append((key, f"j{j}", v, True if v is not None else None, "", "ok"))
    df = spark.createDataFrame(rows, "k string, judge_id string, complete boolean, accurate boolean, error string, rationale string")
    out = {r.k: r for r in jury_verdict(assemble_votes(df), ["k"]).collect()}
    assert [out[k].judge_correct for k in "abcd"] == [1, 0, None, 1]
    assert out["b"].judge_error == "j2: unparseable verdict"


def test_vote_and(spark):
    df = spark.createDataFrame([("j0", True, False, "", "x")],
                               "judge_id string, complete boolean, accurate boolean, error string, rationale string")
    assert assemble_votes(df).collect()[0].vote is False


def test_error_classes(spark):
    df = spark.createDataFrame([(429, "X", "m"), (None, "ReadTimeout", "m"), (None, "X", "peer closed"),
                                (400, "ValueError", "bad"), (400, "X", "Payload size exceeds the limit")],
                               "code int, cls string, msg string")
    got = df.select(is_transient(F.col("code"), F.col("cls"), F.col("msg")).alias("t"),
                    is_payload_limit(F.col("code"), F.col("msg")).alias("p")).collect()
    assert [r.t for r in got] == [True, True, True, False, False]
    assert [r.p for r in got] == [False, False, False, False, True]


def test_keep_last_first_position(spark):
    df = spark.createDataFrame([(1, "a", "v1"), (2, "b", "v1"), (3, "a", "v2")], "seq long, row_id string, v string")
    got = [(r.row_id, r.v) for r in keep_last(df).orderBy("first_seq").collect()]
    assert got == [("a", "v2"), ("b", "v1")]


def test_usage_flatten(spark):
    df = spark.createDataFrame([(None, None, None, 5, None), (3, 0, 4, None, 2)],
                               "p long, cc long, cr long, c long, t long")
    u = usage_columns(F.col("p"), F.col("cc"), F.col("cr"), F.col("c"), F.col("t"))
    got = df.select(*[v.alias(k) for k, v in u.items()]).collect()
    assert (got[0].input_tokens, got[0].thinking_tokens) == (None, 0)
    assert (got[1].input_tokens, got[1].output_tokens, got[1].thinking_tokens) == (7, None, 2)
