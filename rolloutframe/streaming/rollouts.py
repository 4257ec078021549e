"""Rollout logs as streams: windowed counts with late data.

Each micro-batch writes the windows it changed; the newest version of a window
is its count. A finished stream equals the batch aggregation of the rows that
were not late: a row whose window closed more than ``late`` before the newest
row of earlier batches is lost (Spark may let the next batch pass). Rows of one
batch are never late.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total) of a stream or a table of (ts, event_type, value)."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return (
        timed.groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


STORE = "spark.sql.streaming.stateStore.providerClass"


def run_to_end(stream: DataFrame, keys: list[str], provider: str | None = None) -> DataFrame:
    """All that is there now, through the stream, as a table: the newest row of each key.

    ``provider``: the state store of this query, where it needs one of its own.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STORE)
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/_b={number}")

    try:
        spark.conf.set(STORE, provider or before)
        query = (
            stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True).foreachBatch(write).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").drop("_b")
    others = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("x"))
    return newest.select(*keys, *[F.col(f"x.{c}").alias(c) for c in others])
