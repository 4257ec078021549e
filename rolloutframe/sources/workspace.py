"""Workspaces and logs as tables: (rollout_id, filename, content) and (rollout_id, message)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..session import ship_package
from .filesystem import entries, listed, opened, written

LISTED, READ_BYTES = 1000, 1 << 24  # names and bytes of files in a batch


def files(spark: SparkSession, path: str, rollout: Column | None = None) -> DataFrame:
    """Files below ``path``; the folder that holds a file names its rollout.

    Each folder right below ``path`` is listed by a task and the names dealt to all
    tasks, so that neither the driver nor Spark's file index holds a row a file.
    Files are read one at a time.
    """
    rollout = F.element_at(F.split("path", "/"), -2) if rollout is None else rollout
    ship_package(spark)
    own, folders = entries(path)

    def listed_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                names = [n for n in listed(path, "", folder) if not n.rsplit("/", 1)[-1].startswith((".", "_"))]
                for i in range(0, len(names), LISTED):
                    yield pa.RecordBatch.from_pydict({"path": names[i : i + LISTED]})

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
        for batch in batches:
            held, size = [], 0
            for name in batch.column(0).to_pylist():
                with opened(path, name) as file:
                    held.append({"path": name, "content": file.read()})
                size += len(held[-1]["content"])
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema)

    parallel = spark.sparkContext.defaultParallelism
    named = spark.createDataFrame([(f,) for f in own], "path string")
    if folders:
        below = spark.createDataFrame([(f,) for f in folders], "path string").repartition(min(len(folders), 4 * parallel))
        named = named.unionByName(below.mapInArrow(listed_below, "path string"))
    found = named.repartition(4 * parallel).mapInArrow(contents, "path string, content binary")
    return found.select(rollout.alias("rollout_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def text_content(rows: DataFrame, text: str = "text") -> DataFrame:
    """Uploads as workspace rows: texts encoded as UTF-8, bytes as they are."""
    raw = rows.schema[text].dataType.typeName() == "binary"
    content = F.col(text) if raw else F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    return rows.select("rollout_id", "filename", content.alias("content"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append (rollout_id, message, ...) rows to a log folder."""
    rows.write.mode("append").parquet(path)


def joined_logs(rows: DataFrame) -> DataFrame:
    """(rollout_id, filename, content): the messages of each file in order of ``seq``."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "message")))
    return rows.groupBy("rollout_id", "filename").agg(
        F.array_join(F.transform(ordered, lambda x: x["message"]), "\n").alias("content")
    )


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder for each value of ``split``."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def download(rows: DataFrame, folder: str) -> DataFrame:
    """Write (rollout_id, filename, content) below a folder that all executors share; (rollout_id, filename, path) of each.

    The folder is a path or a URI of any file system that Arrow reaches. Names
    that would leave the rollout's own folder are errors; a null content is empty.
    """
    ship_package(rows.sparkSession)

    def write(frames):
        for frame in frames:
            paths = [
                written(f"{folder.rstrip('/')}/{rollout}", name, content or b"")
                for rollout, name, content in zip(frame["rollout_id"], frame["filename"], frame["content"], strict=True)
            ]
            yield frame[["rollout_id", "filename"]].assign(path=paths)

    kind = rows.schema["rollout_id"].dataType.simpleString()
    return rows.select("rollout_id", "filename", "content").mapInPandas(write, f"rollout_id {kind}, filename string, path string")


def track(rows: DataFrame, batch: int, path: str, flush_k: int = 30) -> None:
    """Write a batch of log rows as the folder of its number, in files of up to ``flush_k`` rows.

    The folder is replaced as a whole, so a batch that is written again, after a
    failure between its write and its commit, is there once.
    """
    rows.write.mode("overwrite").option("maxRecordsPerFile", flush_k).parquet(f"{path}/batch={batch}")


def track_stream(stream: DataFrame, path: str, flush_k: int = 30) -> DataStreamWriter:
    """A writer that appends a stream of log rows to ``path``, each row once; its checkpoint lies beside the batches."""
    return stream.writeStream.option("checkpointLocation", f"{path}/_checkpoint").foreachBatch(lambda rows, batch: track(rows, batch, path, flush_k))


def tracked(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log, with the ``batch`` that each came in."""
    return spark.read.parquet(path)
