"""Positions, splits and shuffles of datasets by keys of any kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crm, datasets, positions
from ..sources import tables as t

SEED = 7


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as examples whose ids are texts, as datasets from files have them."""
    return t.load(spark, sf_dir, "orders").select(F.concat(F.lit("ex-"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("status"))


def split_string_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.split_tail(_examples(spark, sf_dir), "id", 0.15)


def positions_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by price from the dearest on, over ranges of a few thousand rows."""
    keys = ["l_orderkey", "l_linenumber"]
    items = t.load(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.max("l_extendedprice").alias("price"))
    return positions.numbered(items, -F.col("price"), *keys, range_rows=5000)


def shuffle_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.shuffled(_examples(spark, sf_dir), "id", SEED).select("id", "place")


def split_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two splits of other names: joined, shuffled and cut anew."""
    rows = _examples(spark, sf_dir)
    parts = {"done": rows.where("status = 'F'"), "rest": rows.where("status <> 'F'")}
    return datasets.train_and_test(parts, "id", 0.3, SEED).select("id", "status", "split")


def agents_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the number of their cases in each segment."""
    counts = t.load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    customers = t.load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return crm.ranked(customers.select("c_custkey", "c_mktsegment", "n"), "n", "c_mktsegment")


QUERIES = {f.__name__: f for f in (split_string_ids, positions_numbered, shuffle_exact, split_shuffled, agents_ranked)}


def _pass(source: str) -> str:
    """One pass over the grid (a columns, b rows) of the places ``x`` of ``source``."""
    text = f"SELECT p, n, a, b, x % a AS l, x // a AS r FROM {source}"
    for i, (k, m, o) in enumerate(positions.round_keys(SEED)):
        moves, by, side = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        kept = "r" if moves == "l" else "l"
        text = f"""SELECT p, n, a, b, {kept}, ({moves} + ((u * u + {m}) % {positions.PRIME}) * ((u + {o}) % {positions.PRIME}) % {positions.PRIME}) % {side} AS {moves}
FROM (SELECT *, ({by} + {k}) % {positions.PRIME} AS u FROM ({text}))"""
    return f"SELECT p, n, a, b, l + r * a AS x FROM ({text})"


_SHUFFLED = f"""ids AS (SELECT 'ex-' || o_orderkey AS id, o_orderstatus AS status, row_number() OVER (ORDER BY 'ex-' || o_orderkey) - 1 AS p FROM orders),
size AS (SELECT count(*) AS n FROM ids),
tried AS (SELECT n, unnest(range(root, least(root + {positions.CANDIDATES}, 2 * root) + 1)) AS a FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS root FROM size)),
grid AS (SELECT n, a, (n + a - 1) // a AS b FROM tried ORDER BY b * a - n, a LIMIT 1),
walk AS (SELECT * FROM ({_pass('(SELECT p, n, a, b, p AS x FROM ids, grid)')})
  UNION ALL SELECT * FROM ({_pass('(SELECT * FROM walk WHERE x >= n)')})),
placed AS (SELECT id, status, x AS place, walk.n FROM ids JOIN walk USING (p) WHERE x < n)"""
ORACLES = {
    "split_string_ids": """SELECT id, status, CASE WHEN row_number() OVER (ORDER BY id) <= n - ceil(0.15 * n) THEN 'train' ELSE 'test' END AS split
FROM (SELECT 'ex-' || o_orderkey AS id, o_orderstatus AS status FROM orders), (SELECT count(*) AS n FROM orders)""",
    "positions_numbered": """SELECT l_orderkey, l_linenumber, price, row_number() OVER (ORDER BY price DESC, l_orderkey, l_linenumber) - 1 AS position
FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)""",
    "shuffle_exact": f"WITH RECURSIVE {_SHUFFLED} SELECT id, place FROM placed",
    "split_shuffled": f"""WITH RECURSIVE {_SHUFFLED} SELECT id, status, CASE WHEN place < n - ceil(0.3 * n) THEN 'train' ELSE 'test' END AS split FROM placed""",
    "agents_ranked": """SELECT c_custkey, c_mktsegment, n, CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY n DESC NULLS LAST) AS INTEGER) AS rank
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
}
