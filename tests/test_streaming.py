"""Stream = batch for the live status view (T1) and incremental scoring (T2), over splits, replays and crashes."""

import os
import random

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from longctx.operators.results import keep_last
from longctx.sources import fixtures as fx
from longctx.sources.versioned import VersionedTable
from longctx.streaming import scoring
from longctx.streaming.scoring import read_scores, score_batch, start_incremental_scoring
from longctx.streaming.status import StatusTable, read_status, start_status_stream

IDS = ["case_uuid", "prompt_id", "model", "repetition"]


def rows_of(df, cols):
    return sorted(map(repr, df.select(*cols).collect()))


@pytest.mark.parametrize("compact_every", [1, 2, 100])
def test_status_stream_equals_batch(spark, scratch, compact_every):
    log = fx.result_log_df(spark, SF001).drop("run_ts")
    src = os.path.join(scratch, "log")
    log.repartition(6, "seq").write.parquet(src)
    at = os.path.join(scratch, "status")

    def run():
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(src)
        start_status_stream(stream, at, os.path.join(scratch, "ck"), compact_every=compact_every).awaitTermination()
    run()
    cols = ["row_id", "seq", "status", "first_seq"]
    assert rows_of(read_status(spark, at), cols) == rows_of(keep_last(log), cols)
    more = log.limit(50).withColumn("seq", F.col("seq") + 10_000_000).withColumn("status", F.lit("late"))
    more.write.mode("append").parquet(src)
    run()
    assert rows_of(read_status(spark, at), cols) == rows_of(keep_last(log.unionByName(more)), cols)
    table = StatusTable(spark, at, compact_every=compact_every)
    if compact_every == 2:  # what is read stays bounded: one row per row id and few batches
        assert len(table.batches()) <= 2 * compact_every
        assert table.base.read().count() <= log.select("row_id").distinct().count()


def test_status_survives_a_broken_merge_and_a_replay(spark, scratch, monkeypatch):
    at = os.path.join(scratch, "status")
    frames = [spark.createDataFrame([("a", k, k, f"s{k}"), (f"r{k}", k, k, "ok")],
                                    "row_id string, first_seq long, seq long, status string") for k in range(5)]
    table = StatusTable(spark, at, compact_every=2)
    for k in (0, 1):
        table.add(frames[k], k)
    assert table.base.version() == 1
    table.add(frames[2], 2)
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.add(frames[3], 3)
    assert {r.row_id: r.status for r in table.read().collect()}["a"] == "s3"  # base 1 and the changes after it
    for k in (3, 3, 4):  # the batch again, twice
        table.add(frames[k], k)
    assert {r.row_id: r.seq for r in table.read().collect()} == {"a": 4, "r0": 0, "r1": 1, "r2": 2, "r3": 3, "r4": 4}


def responses(spark):
    """Equal answers of two repetitions, nulls, and rows that are delivered twice."""
    one = fx.responses_df(spark, SF001).limit(12)
    rows = [r.asDict() for r in one.collect()]
    rows = [r | {"repetition": k} for r in rows for k in (1, 2)]
    rows.append(rows[0] | {"response": None})
    rows.append(rows[0] | {"response": ""})
    return rows, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in one.schema)}, repetition long"


@pytest.mark.parametrize("seed", range(4))
def test_any_split_into_batches_gives_the_same_rows(spark, scratch, seed):
    rows, schema = responses(spark)
    rng = random.Random(seed)
    sent = rows + rng.sample(rows, 8)  # some again
    rng.shuffle(sent)
    src, out, ck = (os.path.join(scratch, x) for x in ("in", "out", "ck"))
    cuts = sorted(rng.sample(range(1, len(sent)), rng.randint(0, 4)))
    for a, b in zip([0, *cuts], [*cuts, len(sent)]):
        spark.createDataFrame(sent[a:b], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        start_incremental_scoring(stream, out, ck, IDS, with_lcs=False).awaitTermination()
    cols = [*IDS, "response", "token_f1", "concise"]
    assert rows_of(read_scores(spark, out), cols) == rows_of(score_batch(spark.createDataFrame(rows, schema), IDS, False), cols)
    stream = spark.readStream.schema(schema).parquet(src)  # another stream adds nothing
    start_incremental_scoring(stream, out, os.path.join(scratch, "ck2"), IDS, with_lcs=False).awaitTermination()
    assert read_scores(spark, out).count() == len(rows)


@pytest.mark.parametrize("broken", [0, 1])
def test_crash_in_a_batch_and_restart(spark, scratch, monkeypatch, broken):
    rows, schema = responses(spark)
    src, out, ck = (os.path.join(scratch, x) for x in ("in", "out", "ck"))
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(src)
    calls = []

    def fail(df):
        calls.append(1)
        if len(calls) == broken + 1:
            return df.withColumn("boom", F.raise_error(F.lit("executor lost")))
        return df

    def run(extra):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        start_incremental_scoring(stream, out, ck, IDS, with_lcs=False, extra=extra).awaitTermination()
    with pytest.raises(Exception, match="executor lost"):
        run(fail)
    run(None)
    cols = [*IDS, "response", "token_f1"]
    assert rows_of(read_scores(spark, out), cols) == rows_of(score_batch(spark.createDataFrame(rows, schema), IDS, False), cols)


def test_identity_is_needed(spark):
    with pytest.raises(ValueError, match="identity"):
        start_incremental_scoring(fx.responses_df(spark, SF001), "x", "y", [])
    a, b = (scoring.with_response_sha(spark.createDataFrame([("r", x)], "id string, t string"), ["id"]).first().response_sha
            for x in (None, ""))
    assert a != b
