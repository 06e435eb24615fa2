"""Streaming forms: sessions by time, an idempotent ledger of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """A stream over the Parquet files of a folder whose names match."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(path)


def session_counts(events: DataFrame, *, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """key, start_ts, end_ts (of the last item plus the gap), n per session; rows later than ``late`` behind the newest are dropped by the watermark."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    grouped = timed.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there and returns its result: the last complete table of ``folder``, written by the executors."""
    out = f"{folder}/out"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/v{epoch}")

    query = stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = _versions(stream.sparkSession, out)
    return stream.sparkSession.read.parquet(f"{out}/v{found[-1]}") if found else stream.sparkSession.createDataFrame([], stream.schema)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete tables v0, v1 and so on of a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v")]
    return sorted(int(p.getName()[1:]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def merge_batches(stream: DataFrame, path: str, key: str, seq: str, checkpoint: str) -> None:
    """Folds each micro batch into a keyed table, latest row per key; a batch that is run again changes nothing. Versions of the table lie side by side and the newest complete one counts."""
    from ridgeline.operators.store import merge_latest

    spark = stream.sparkSession

    def fold(batch: DataFrame, epoch: int) -> None:
        before = [v for v in _versions(spark, path) if v < epoch]
        base = spark.read.parquet(f"{path}/v{before[-1]}") if before else batch.limit(0)
        merge_latest(base, batch, key, seq).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a table of :func:`merge_batches`."""
    return spark.read.parquet(f"{path}/v{_versions(spark, path)[-1]}")
