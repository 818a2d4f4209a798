"""Streams of changes to a vector table, and streams of queries against a static one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import ranked
from ..functions.columns import METRICS

CHANGES = "id bigint, embedding array<float>, op string, version bigint"


def apply_batch(table: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (id, embedding, op, version) with op upsert, delete or undelete over ``table`` (id, embedding, deleted, version).

    The highest version of an id counts, so batches may come late or twice.
    """
    new = changes.select("id", "embedding", (F.col("op") == "delete").alias("deleted"), "version")
    every = table.select("id", "embedding", "deleted", "version").unionByName(new)
    last = every.groupBy("id").agg(F.max_by(F.struct("deleted", "version"), "version").alias("s"), F.max_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("version"))).alias("embedding"))
    return last.where(F.col("embedding").isNotNull()).select("id", "embedding", "s.deleted", "s.version")


def follow(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Fold change files from ``source`` into the Parquet table at ``target``, a numbered version per batch; batches that were already written are skipped."""

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = f"{target}/v{number - 1}"
        empty = session.createDataFrame([], "id bigint, embedding array<float>, deleted boolean, version bigint")
        table = session.read.parquet(before) if number else empty
        apply_batch(table, batch).write.mode("overwrite").parquet(f"{target}/v{number}")

    stream = spark.readStream.schema(CHANGES).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer(queries: DataFrame, base: DataFrame, k: int, target: str, checkpoint: str, metric: str = "l2") -> StreamingQuery:
    """Append the ``k`` nearest rows of a static ``base`` for a stream of (query_id, embedding)."""

    def one(batch: DataFrame, number: int) -> None:
        q = batch.select("query_id", F.col("embedding").alias("q"))
        met = base.crossJoin(F.broadcast(q) if batch.count() < 10_000 else q)
        near = ranked(met.select("query_id", "id", METRICS[metric](F.col("embedding"), F.col("q")).alias("dist")), k)
        near.write.mode("overwrite").parquet(f"{target}/b{number}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type, for streams (with a watermark) and tables alike."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
