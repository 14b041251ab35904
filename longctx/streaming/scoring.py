"""Incremental scoring with checkpoint and resume.

New response files are picked up by a file stream; each micro-batch is scored with the batch operators (heuristics,
gate, optional jury) and written to a folder of its own, named by stream and batch.

Which responses are new is decided by keyed streaming state, not by reading the scored table again: every response
has a ``response_sha`` (its identity columns and its content), and ``dropDuplicates`` on it keeps the first.  So the result is the
same for every split of the input into batches; equal answers of two repetitions are two responses; a file that is delivered
again adds nothing; a response that arrives with other content is kept beside the first.  The state is in RocksDB with Spark's
incremental checkpoints, and a batch costs what its own rows cost, whatever came before.

A batch that Spark runs again finds the state as it was and overwrites its own folder, also when the first attempt broke
off before anything was committed.  A new stream (another checkpoint) that writes to a table with rows of earlier streams leaves
out what those hold: it reads their ``response_sha`` columns, a set that does not grow while it runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from longctx.operators.jury import with_row_key
from longctx.operators.metrics import conciseness, text_metrics
from longctx.sources.versioned import Files

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _finished(spark, path: str, but: str) -> list[str]:
    """Batch folders of other streams that were written to the end."""
    files = Files(spark, path)
    found = []
    for stream in files.names(path):
        if stream.startswith("stream=") and stream != f"stream={but}":
            found += [f"{path}/{stream}/{b}" for b in files.names(f"{path}/{stream}") if b.startswith("batch_id=")
                      and files.exists(f"{path}/{stream}/{b}/_SUCCESS")]
    return found


def with_response_sha(df: DataFrame, identity: list[str]) -> DataFrame:
    """``response_sha``: identity columns, then all others by name; nulls differ from empty strings."""
    rest = sorted(c for c in df.columns if c not in identity)
    told = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate([*identity, *rest])]),
                     {"ignoreNullFields": "false"})
    return df.withColumn("response_sha", F.sha2(told, 256))


def score_batch(batch: DataFrame, id_cols: list[str], with_lcs: bool = True) -> DataFrame:
    """Stateless part of scoring for one batch: heuristic metrics and the gate."""
    return conciseness(text_metrics(with_row_key(batch), id_cols, with_lcs=with_lcs))


def start_incremental_scoring(responses_stream: DataFrame, scored_path: str, checkpoint: str, identity: list[str],
                              with_lcs: bool = True, extra: Callable[[DataFrame], DataFrame] | None = None,
                              available_now: bool = True) -> StreamingQuery:
    """``identity``: the columns that tell responses apart (run, row, repetition, ...); there is no default.

    ``extra`` is applied to each scored batch, e.g. the jury through a ledger."""
    if not identity:
        raise ValueError("identity columns are needed to tell responses apart")
    stream = "s" + hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    path = scored_path.rstrip("/")
    spark = responses_stream.sparkSession
    others = _finished(spark, path, stream)

    def write(batch: DataFrame, batch_id: int) -> None:
        if others:
            seen = batch.sparkSession.read.schema("response_sha string").parquet(*others)
            batch = batch.join(seen.distinct(), "response_sha", "left_anti")
        scored = score_batch(batch, identity, with_lcs)
        if extra is not None:
            scored = extra(scored)
        scored.write.mode("overwrite").parquet(f"{path}/stream={stream}/batch_id={batch_id}")

    new = with_response_sha(responses_stream, identity).dropDuplicates(["response_sha"])
    writer = new.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # the query keeps the settings it was started with
    try:
        return writer.start()
    finally:
        spark.conf.set(_PROVIDER, before)


def read_scores(spark, scored_path: str, schema=None) -> DataFrame:
    """All finished batches of all streams."""
    folders = _finished(spark, scored_path.rstrip("/"), "")
    if not folders and schema is not None:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", scored_path).parquet(*folders)
