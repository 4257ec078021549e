"""Questions and tool calls in SQL texts alone, and null columns from file footers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import sql_functions
from ..sources import tables as t
from .crm_queries import CASES, HISTORY, STATES, mean_sql
from .text_queries import ORACLES as TEXT_ORACLES
from .text_queries import call_rows


def _asked(spark: SparkSession, sf_dir: str, text: str, **parameters: object) -> DataFrame:
    sql_functions.register_questions(t.cases(spark, sf_dir), t.case_history(spark, sf_dir), t.accounts(spark, sf_dir))
    return spark.sql(text, args=parameters)


def sql_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of two owners in a year, by status."""
    return _asked(
        spark, sf_dir,
        "SELECT owner_id, count(*) AS n, count(closed) AS n_closed FROM crm_get_cases(CAST(:start AS TIMESTAMP), CAST(:end AS TIMESTAMP), owners => array('3', '7')) GROUP BY owner_id",
        start="1997-01-01", end="1998-01-01",
    )


def sql_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each busy agent handled and passed on."""
    period = "TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03'"
    return _asked(
        spark, sf_dir,
        f"SELECT h.agent, h.n_cases AS handled, coalesce(m.n_cases, 0) AS moved FROM crm_handled_by_agent({period}) h LEFT JOIN crm_transferred_by_agent({period}) m ON h.agent = m.agent"
        f" WHERE h.agent IN (SELECT agent FROM crm_qualified_agents(:least, {period}))",
        least=10,
    )


def sql_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States by closure time, with the owners who have the most cases of all."""
    return _asked(
        spark, sf_dir,
        "SELECT shipping_state, round(seconds, 6) AS seconds, (SELECT min(owner_id) FROM crm_agents_by_cases()) AS busiest FROM crm_closure_seconds_by_region(end => TIMESTAMP '1997-01-01')",
    )


def sql_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(
        spark, sf_dir,
        "SELECT month, m.n_cases, round(minutes, 6) AS minutes FROM crm_month_counts() m, (SELECT minutes FROM crm_average_handle_minutes() WHERE owner_id = :owner)",
        owner=3,
    )


def sql_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of each text, by a lateral join in SQL."""
    sql_functions.register_tool_calls(spark)
    call_rows(spark, sf_dir).createOrReplaceTempView("said")
    return spark.sql("SELECT event_id, c.call, c.name, c.arguments, c.error FROM said, LATERAL tool_calls(said.text) c")


def null_columns_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written table without the columns that hold nothing, as its file footers tell."""
    path = f"{shared_folder(spark)}/sparse-{uuid.uuid4().hex}"
    rows = t.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("nothing"), F.when(F.col("o_orderkey") == 7, F.col("o_orderstatus")).alias("once"),
        F.when(F.col("o_orderkey") < 0, F.col("o_totalprice")).alias("never"),
    )
    rows.write.parquet(path)
    return t.load_without_null_columns(spark, path)


QUERIES = {f.__name__: f for f in (sql_cases, sql_transfers, sql_closure, sql_months, sql_tool_calls, null_columns_footers)}

_DAYS = "created >= TIMESTAMP '2024-01-01' AND created <= TIMESTAMP '2024-01-03'"
ORACLES = {
    "sql_cases": f"""WITH {CASES} SELECT owner_id, count(*) AS n, count(closed) AS n_closed FROM cases
WHERE created >= TIMESTAMP '1997-01-01' AND created < TIMESTAMP '1998-01-01' AND owner_id IN (3, 7) GROUP BY 1""",
    "sql_transfers": f"""WITH {HISTORY}, own AS (SELECT * FROM history WHERE {_DAYS}),
h AS (SELECT new_value AS agent, count(*) AS handled FROM own GROUP BY 1), m AS (SELECT old_value AS agent, count(*) AS moved FROM own GROUP BY 1)
SELECT h.agent, handled, coalesce(moved, 0) AS moved FROM h LEFT JOIN m ON h.agent = m.agent WHERE handled > 10""",
    "sql_closure": f"""WITH {STATES}, n AS (SELECT owner_id, count(*) AS n FROM cases GROUP BY 1)
SELECT shipping_state, round({mean_sql('1e6')}, 6) AS seconds, (SELECT min(owner_id) FROM n WHERE n = (SELECT max(n) FROM n)) AS busiest
FROM states WHERE created < TIMESTAMP '1997-01-01' AND closed IS NOT NULL AND shipping_state <> '' GROUP BY 1""",
    "sql_months": f"""WITH {CASES}, m AS (SELECT round({mean_sql('6e7')}, 6) AS minutes FROM cases WHERE owner_id = 3 AND closed >= created)
SELECT monthname(created) AS month, count(*) AS n_cases, any_value(minutes) AS minutes FROM cases, m GROUP BY 1""",
    "sql_tool_calls": TEXT_ORACLES["tool_calls_parse"],
    "null_columns_footers": "SELECT o_orderkey AS id, CASE WHEN o_orderkey = 7 THEN o_orderstatus END AS once FROM orders",
}
