"""Session settings and code shipping."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings under which results are defined.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def builder(app: str = "rolloutframe") -> SparkSession.Builder:
    return SparkSession.builder.appName(app).config(map=SETTINGS)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one on one machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    return (found or tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")).rstrip("/")


def staged(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: computed once, with no lineage to lose."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_rolloutframe_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="spark-package-")) / "rolloutframe.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._rolloutframe_shipped = True
