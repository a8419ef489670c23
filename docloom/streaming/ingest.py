"""Streaming: idempotent upserts of micro-batches, and event-time extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Buckets of keys of a streamed table; a batch rewrites those that it touches.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, table: str) -> dict[int, list[int]]:
    """The finished versions that hold each bucket, in order. A row for each bucket and version; old versions are removed."""
    fs, root = _fs(spark, table)
    out: dict[int, list[int]] = {}
    for v in fs.listStatus(root) if fs.exists(root) else []:
        at = v.getPath()
        if at.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
            for b in fs.listStatus(at):
                if b.getPath().getName().startswith("_b="):
                    out.setdefault(int(b.getPath().getName()[3:]), []).append(int(at.getName()[2:]))
    return {b: sorted(v) for b, v in out.items()}


def upsert_batch(spark: SparkSession, table: str, keys: list[str], order: str, buckets: int = BUCKETS):
    """A ``foreachBatch`` function: each bucket of keys that the batch touches gets a version of its own, its last one with the batch's
    latest row of each key. Other buckets are not read or written.

    Versions are folders ``v=<batch>/_b=<bucket>``; a batch that runs again writes the same ones again from the versions before, so
    replays change nothing. Of each bucket the last two versions stay.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        fs, _ = _fs(spark, table)
        rows = batch.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in rows.select("_b").distinct().collect()]
        done = _versions(spark, table)
        before = {b: max((v for v in done.get(b, ()) if v < batch_id), default=None) for b in touched}
        paths = [f"{table}/v={v}/_b={b}" for b, v in before.items() if v is not None]
        old = spark.read.schema(batch.schema).parquet(*paths).withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")) if paths else rows.limit(0)
        latest = rows.unionByName(old).groupBy("_b", *keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("_b", "r.*")
        if touched:
            # rows of a bucket lie in one task's file
            latest.repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(f"{table}/v={batch_id}")
        rows.unpersist()
        for b, versions in _versions(spark, table).items():
            for v in versions[:-2]:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v={v}/_b={b}"), True)

    return run


def stream_upsert(source: DataFrame, table: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, batch after batch, then stop."""
    return source.writeStream.foreachBatch(upsert_batch(source.sparkSession, table, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of every bucket."""
    return spark.read.parquet(*(f"{table}/v={v[-1]}/_b={b}" for b, v in sorted(_versions(spark, table).items())))


def tumbling(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts and sums by window and type; works on streams and tables."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, by: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Extension: sessions of each key with a gap."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dedup(events: DataFrame, keys: list[str], time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Extension: one event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def drained(stream: DataFrame, mode: str, keys: list[str], order: str | None, folder: str) -> DataFrame:
    """The result of a streaming plan over everything that is there now: ``append`` adds each batch's rows to a table, ``update``
    upserts its changed rows by key, ``complete`` replaces them all."""
    spark, table = stream.sparkSession, f"{folder}/table"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(table)
    if mode == "complete":
        # the last batch holds all rows; a batch that runs again replaces itself
        def sink(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(table)

        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(table)
    stream.writeStream.foreachBatch(upsert_batch(spark, table, keys, order)).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return latest_version(spark, table).select(*stream.columns)
