"""Parquet tables and the logical views that the queries run over.

No view scans more columns than its query selects: all are plain projections,
aggregations and joins that Catalyst prunes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_dataset(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A dataset of examples in any format that Spark reads; an ``id`` column becomes a string.

    JSON is one document that may span lines, unless ``multiLine`` says otherwise.
    """
    options = {"multiLine": "true", **options} if fmt == "json" else options
    found = spark.read.format(fmt).options(**options).load(path)
    return found.withColumn("id", F.col("id").cast("string")) if "id" in found.columns else found


def register(tables: dict[str, DataFrame]) -> None:
    """Temporary views for ad-hoc ``spark.sql`` queries."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)


def drop_null_columns(rows: DataFrame) -> DataFrame:
    """Without the columns that hold no value at all (one aggregation)."""
    if not rows.columns:
        return rows
    counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(rows.columns)]).first()
    return rows.drop(*[c for i, c in enumerate(rows.columns) if not counts[f"n{i}"]])


def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row, n0, n1, …: the values of each column of a Parquet table, counted from its footers.

    The plan is made under settings that push the counts into the scan; it reads no data.
    """
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        rows = spark.read.parquet(path)
        counts = rows.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(rows.columns)])
        counts._jdf.queryExecution().executedPlan()  # planned now, under these settings
        return counts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def load_without_null_columns(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table without the columns that hold no value at all.

    Footers count flat columns; the nested ones are counted from the data.
    """
    rows = spark.read.parquet(path)
    flat = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    if len(flat) < len(rows.columns):
        return drop_null_columns(rows)
    found = footer_counts(spark, path).first() if flat else ()
    return rows.drop(*[c for c, n in zip(rows.columns, found, strict=True) if not n])


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases, each about one of its line items; a case closes when its last line item ships."""
    closed = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    return (
        load(spark, sf_dir, "orders")
        .join(closed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"),
            (F.col("o_custkey") % 20).alias("owner_id"), F.col("o_orderdate").alias("created"), "closed",
            F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("issue_id"),
            (F.col("o_orderkey") * 8 + F.col("o_orderkey") % 3 + 1).alias("order_item_id"),
        )
    )


def case_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of a case's fields: most assign an owner; the old value is the one before."""
    earlier = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("case_id"), F.col("ts").alias("created"),
        F.lag("event_type").over(earlier).alias("old_value"), F.col("event_type").alias("new_value"),
        F.when(F.col("event_id") % 5 == 0, "Status").otherwise("Owner Assignment").alias("field"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("shipping_state"))
    return (
        load(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "shipping_state")
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"),
        F.to_date("o_orderdate").alias("effective_date"), F.col("o_orderstatus").alias("status"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.concat_ws(" ", "p_brand", "p_type").alias("description"),
    )


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("Note "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("publish_status"), F.col("lang").alias("language"), F.col("text").alias("faq_answer"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"),
        F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"),
        F.col("html").alias("extract"),
    )
