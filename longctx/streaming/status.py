"""Live latest-status view over the append-only result log.

A streaming aggregation keeps, per ``row_id``, the entry with the highest ``seq`` (W1) in Spark's checkpointed state
store; every micro-batch emits only the row ids it changed (``update`` mode).  The status table has two parts: a *base*
with one row per row id (a versioned table whose version number is the last batch in it), and *changes*, one folder a
batch, of the batches after it.  Every ``compact_every`` batches base and changes are merged into a new base, so
reading costs the number of row ids and a bounded number of batches, however long the log is.

A batch that runs again overwrites its own changes; a merge that broke off leaves the old base and the changes it needs.
Changes are removed one merge late, and the last two bases stay, so a reader that has just looked up a base still finds its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from longctx.sources.versioned import Files, VersionedTable

COMPACT_EVERY = 16


def latest_entries(log_stream: DataFrame, key: str = "row_id", seq: str = "seq") -> DataFrame:
    payload = [c for c in log_stream.columns if c != key]
    return (log_stream.groupBy(key)
            .agg(F.max_by(F.struct(*payload), F.col(seq)).alias("_last"), F.min(seq).alias("first_seq"))
            .select(key, "first_seq", "_last.*"))


class StatusTable:
    """Base and changes at ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "row_id", compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.key, self.every = spark, path.rstrip("/"), key, compact_every
        self.base = VersionedTable(spark, f"{self.path}/base")
        self.files = Files(spark, self.path)

    def batches(self) -> list[int]:
        """Batches whose changes are written to the end."""
        at = f"{self.path}/changes"
        names = [n for n in self.files.names(at) if n.startswith("batch_id=") and self.files.exists(f"{at}/{n}/_SUCCESS")]
        return sorted(int(n.removeprefix("batch_id=")) for n in names)

    def _changes(self, batches: list[int]) -> DataFrame:
        folders = [f"{self.path}/changes/batch_id={k}" for k in batches]
        return self.spark.read.option("basePath", f"{self.path}/changes").parquet(*folders).withColumn(
            "batch_id", F.col("batch_id").cast("bigint"))

    def _newest(self, rows: DataFrame) -> DataFrame:
        payload = [c for c in rows.columns if c != self.key]
        last = F.max_by(F.struct(*payload), F.struct("seq", "batch_id")).alias("_s")
        return rows.groupBy(self.key).agg(last).select(self.key, "_s.*")

    def _merged(self, upto: int | None = None) -> DataFrame:
        version = self.base.version()
        after = [k for k in self.batches() if (version is None or k > version) and (upto is None or k <= upto)]
        parts = ([self.base.read()] if version is not None else []) + ([self._changes(after)] if after else [])
        if not parts:
            raise FileNotFoundError(f"no status has been written to {self.path}")
        return self._newest(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))

    def add(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/changes/batch_id={batch_id}")
        version = self.base.version()
        if batch_id - (-1 if version is None else version) >= self.every:
            self.base.write(self._merged(batch_id), version=batch_id)
            self.base.vacuum(keep=2)
            for k in self.batches():
                if version is not None and k <= version:
                    self.files.delete(f"{self.path}/changes/batch_id={k}")

    def read(self) -> DataFrame:
        """One row per row id: the newest."""
        return self._merged().drop("batch_id")


def start_status_stream(log_stream: DataFrame, table_path: str, checkpoint: str, available_now: bool = True,
                        key: str = "row_id", compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Start the status stream; each batch adds the row ids it changed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        StatusTable(batch.sparkSession, table_path, key, compact_every).add(batch, batch_id)

    writer = (latest_entries(log_stream, key).writeStream.outputMode("update")
              .option("checkpointLocation", checkpoint).foreachBatch(write))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def read_status(spark: SparkSession, table_path: str, key: str = "row_id") -> DataFrame:
    """Current status table."""
    return StatusTable(spark, table_path, key).read()


def status_counts(status: DataFrame) -> DataFrame:
    """A3 over the live table."""
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
