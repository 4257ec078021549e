"""Questions over cases, history, accounts, orders and periods."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar
from ..operators import crm
from ..sources import tables as t

YEAR = (date(1997, 1, 1), date(1998, 1, 1))
QUARTER = calendar.period("Q2", 1997)
DAYS = (datetime(2024, 1, 1), datetime(2024, 1, 3))

CASES = """cases AS (
  SELECT o_orderkey AS id, o_custkey AS account_id, o_custkey % 20 AS owner_id, o_orderdate AS created, c.closed,
         o_orderstatus AS status, o_orderpriority AS issue_id, o_orderkey * 8 + o_orderkey % 3 + 1 AS order_item_id
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS closed FROM lineitem GROUP BY 1) c ON l_orderkey = o_orderkey)"""
HISTORY = """changes AS (
  SELECT event_id AS id, user_id AS case_id, ts AS created, event_type AS new_value,
         CASE WHEN event_id % 5 = 0 THEN 'Status' ELSE 'Owner Assignment' END AS field,
         lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_value FROM events),
history AS (SELECT * FROM changes WHERE field = 'Owner Assignment')"""
STATES = f"""{CASES},
states AS (SELECT cases.*, n_name AS shipping_state FROM cases
  LEFT JOIN customer ON c_custkey = account_id LEFT JOIN nation ON n_nationkey = c_nationkey)"""
IN_YEAR = "created >= TIMESTAMP '1997-01-01' AND created < TIMESTAMP '1998-01-01'"
IN_YEAR_CLOSED = "created >= TIMESTAMP '1997-01-01' AND created <= TIMESTAMP '1998-01-01'"
IN_QUARTER = "created >= TIMESTAMP '1997-04-01' AND created < TIMESTAMP '1997-07-01'"
IN_DAYS = "created >= TIMESTAMP '2024-01-01' AND created <= TIMESTAMP '2024-01-03'"


def mean_sql(unit: str) -> str:
    return f"CAST(sum(epoch_us(closed) - epoch_us(created)) AS DOUBLE) / (count(*) * {unit})"


def _rounded(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.round(column, 6))


def flagship_region_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state(s) whose cases of a quarter close fastest."""
    cases = crm.created_in(t.cases(spark, sf_dir), *QUARTER)
    rates = _rounded(crm.closure_seconds_by_region(cases, t.accounts(spark, sf_dir)), "seconds")
    return crm.extremes(rates, "seconds", largest=False)


def crm_get_cases_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.get_cases(t.cases(spark, sf_dir), *QUARTER)


def crm_get_cases_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.get_cases(t.cases(spark, sf_dir), *YEAR, owner_id=[3, 7], issue_id=["1-URGENT"], status=["F", "O"])


def crm_get_cases_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases about any item of a brand's products: ids found by one question filter the next."""
    products = t.products(spark, sf_dir).where(F.col("description").startswith("Brand#1")).select("id")
    items = crm.among(t.order_items(spark, sf_dir), "product_id", products).select("id")
    return crm.get_cases(t.cases(spark, sf_dir), *YEAR, order_item_id=items)


def crm_non_transferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.non_transferred(t.case_history(spark, sf_dir), *DAYS)


def crm_handled_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.handled_by_agent(t.case_history(spark, sf_dir), *DAYS)


def crm_transferred_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = t.case_history(spark, sf_dir)
    agents = crm.qualified_agents(crm.handled_by_agent(history, *DAYS), 10)
    return crm.transferred_by_agent(history, *DAYS, agents=agents)


def crm_qualified_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.qualified_agents(crm.handled_by_agent(t.case_history(spark, sf_dir), *DAYS), 100)


def crm_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, products = t.order_items(spark, sf_dir), t.products(spark, sf_dir)
    wanted = crm.among(items, "product_id", products.where(F.col("description").startswith("Brand#1")).select("id"))
    return crm.issue_counts(t.cases(spark, sf_dir), *YEAR, items=wanted.select("id"))


def crm_avg_handle_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(crm.average_handle_minutes(t.cases(spark, sf_dir)), "minutes")


def crm_region_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(crm.closure_seconds_by_region(t.cases(spark, sf_dir), t.accounts(spark, sf_dir)), "seconds")


def crm_month_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.month_counts(t.cases(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, created): the orders' times as texts of records, near midnight in several offsets, some malformed."""
    key = F.col("o_orderkey")
    zone = F.when(key % 3 == 0, "+0000").when(key % 3 == 1, "-0830").otherwise("+05:30")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:59:30.250"), zone)
    return t.load(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 7 == 5, F.substring(text, 1, 19)).otherwise(text).alias("created"))


def crm_record_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    return crm.month_counts(rows.where(calendar.record_timestamp(F.col("created")).isNotNull()))


def cal_record_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    moment = calendar.record_timestamp(F.col("created"))
    return _records(spark, sf_dir).select(
        "id", F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("utc"), F.date_format(F.to_date(F.substring("created", 1, 10)), "yyyy-MM-dd").alias("day")
    )


def crm_case_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumn("owner", F.when(F.col("id") % 9 > 0, F.col("id")))
    found = crm.case_errors(rows.where("id > 5"), ["owner"], F.col("id"), times=["created"])
    return found.select("position", "index", F.concat_ws(",", "missing").alias("missing"), F.concat_ws(",", "malformed").alias("malformed"), "message")


def crm_case_errors_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest closed case, seen from the end, that closed before some day after its creation; no case lacks anything."""
    rows = t.cases(spark, sf_dir).where("closed IS NOT NULL").withColumn("due", F.col("created") + F.expr("INTERVAL 90 DAYS"))
    return crm.case_errors(rows, ["owner_id", "closed"], -F.col("id"), not_before=("closed", "due")).select("position", "index", "message")


def cal_parameter_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters as texts, of which some lack the zone or name a day that is none."""
    key = F.col("o_orderkey")
    text = (
        F.when(key % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(key % 4 == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-31T00:00:00Z")))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return t.load(spark, sf_dir, "orders").select(key.alias("id"), calendar.parameter_error(text, "start_date").alias("error"))


def crm_agents_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.agents_by_cases(t.cases(spark, sf_dir), most=True)


def crm_agents_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.agents_by_cases(t.cases(spark, sf_dir), most=False)


def id_max_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.extremes(t.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


def id_min_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return crm.extremes(rows, "l_quantity", largest=False)


def crm_shipping_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.with_shipping_state(t.cases(spark, sf_dir), t.accounts(spark, sf_dir)).select("id", "account_id", "shipping_state")


def crm_purchase_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.purchase_history(t.order_items(spark, sf_dir), t.orders(spark, sf_dir), 77, status="F")


def crm_purchase_history_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of one brand that an account bought on the day of its first order."""
    orders, products = t.orders(spark, sf_dir), t.products(spark, sf_dir)
    day = orders.where("account_id = 77").agg(F.min("effective_date")).first()[0]
    wanted = products.where(F.col("description").startswith("Brand#")).select("id")
    return crm.purchase_history(t.order_items(spark, sf_dir), orders, 77, on=day or date(1900, 1, 1), products=wanted)


def crm_order_items_by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crm.items_of_product(t.order_items(spark, sf_dir), 17)


def crm_account_by_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    contacts = t.orders(spark, sf_dir).select("id", "account_id")
    return crm.account_of_contact(contacts, 42)


def crm_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")).distinct()


def crm_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = t.load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("text").alias("body"), F.col("turn").alias("end_time")
    )
    return crm.transcript_of_case(talks, 3)


def cal_start_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day, a week, a month and a quarter before every order."""
    day = F.to_date("o_orderdate")
    return t.load(spark, sf_dir, "orders").select(
        "o_orderkey",
        *[F.date_format(calendar.start_date(F.col("o_orderdate"), unit, 1), "yyyy-MM-dd").alias(f"{unit}_before") for unit in calendar.UNITS],
        F.date_format(day, "yyyy-MM-dd").alias("day"),
    )


def cal_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = t.load(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return calendar.bounds(years).select(
        "year", "period_name", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"), F.date_format("end_date", "yyyy-MM-dd").alias("end_date")
    )


QUERIES = {
    f.__name__: f
    for f in (
        flagship_region_closure, crm_get_cases_range, crm_get_cases_lists, crm_get_cases_items, crm_record_months,
        cal_record_times, crm_case_errors, crm_case_errors_late, cal_parameter_errors, crm_non_transferred, crm_handled_by_agent,
        crm_transferred_by_agent, crm_qualified_agents, crm_issue_counts, crm_avg_handle_time, crm_region_closure,
        crm_month_counts, crm_agents_max, crm_agents_min, id_max_value, id_min_value, crm_shipping_state,
        crm_purchase_history, crm_purchase_history_filtered, crm_order_items_by_product, crm_account_by_contact, crm_issues, crm_transcripts,
        cal_start_date, cal_periods,
    )
}
_RECORDS = """records AS (
  SELECT o_orderkey AS id, o_orderdate AS d, o_orderkey % 7 = 5 AS bad, [0, -510, 330][o_orderkey % 3 + 1] AS ahead FROM orders)"""
_NO_DATE = "'Error: start_date must be in format ' || chr(39) || 'YYYY-MM-DDTHH:MM:SSZ' || chr(39)"
_OWNERS = f"WITH {CASES}, n AS (SELECT owner_id, count(*) AS n FROM cases GROUP BY 1)"
_VALUES = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in calendar.PERIODS.items())
ORACLES = {
    "flagship_region_closure": f"""WITH {STATES},
r AS (SELECT shipping_state, round({mean_sql('1e6')}, 6) AS seconds FROM states
      WHERE {IN_QUARTER} AND closed IS NOT NULL AND shipping_state <> '' GROUP BY 1)
SELECT * FROM r WHERE seconds = (SELECT min(seconds) FROM r)""",
    "crm_get_cases_range": f"WITH {CASES} SELECT owner_id, created, closed, account_id FROM cases WHERE {IN_QUARTER}",
    "crm_get_cases_lists": f"""WITH {CASES} SELECT owner_id, created, closed, account_id FROM cases
WHERE {IN_YEAR} AND owner_id IN (3, 7) AND issue_id = '1-URGENT' AND status IN ('F', 'O')""",
    "crm_get_cases_items": f"""WITH {CASES} SELECT owner_id, created, closed, account_id FROM cases
WHERE {IN_YEAR} AND order_item_id IN (SELECT l_orderkey * 8 + l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand LIKE 'Brand#1%')""",
    "crm_record_months": f"WITH {_RECORDS} SELECT monthname(d) AS month, count(*) AS n_cases FROM records WHERE NOT bad GROUP BY 1",
    "cal_record_times": f"""WITH {_RECORDS} SELECT id, strftime(d, '%Y-%m-%d') AS day, CASE WHEN NOT bad THEN
  strftime(date_trunc('day', d) + INTERVAL '23 hours 59 minutes 30 seconds' - to_minutes(ahead), '%Y-%m-%d %H:%M:%S') END AS utc FROM records""",
    "crm_case_errors": f"""WITH {_RECORDS}, numbered AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS index FROM records WHERE id > 5)
SELECT id AS position, index, CASE WHEN id % 9 = 0 THEN 'owner' ELSE '' END AS missing, CASE WHEN bad THEN 'created' ELSE '' END AS malformed,
  CASE WHEN id % 9 = 0 THEN 'Error: ' || chr(39) || 'owner' || chr(39) || ' not found in case record at index ' || index
    ELSE 'Error: Invalid date format at index ' || index || '. Expected format: ' || chr(39) || '%Y-%m-%dT%H:%M:%S.%f%z' || chr(39) END AS message
FROM numbered WHERE bad OR id % 9 = 0 ORDER BY id LIMIT 1""",
    "crm_case_errors_late": f"""WITH {CASES}, numbered AS (SELECT *, row_number() OVER (ORDER BY id DESC) - 1 AS index FROM cases WHERE closed IS NOT NULL)
SELECT -id AS position, index, 'Error: closed is earlier than due at index ' || index AS message FROM numbered
WHERE closed < created + INTERVAL 90 DAYS ORDER BY id DESC LIMIT 1""",
    "cal_parameter_errors": f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 OR (o_orderkey % 4 = 1 AND day(last_day(o_orderdate)) < 31)
  THEN {_NO_DATE} END AS error FROM orders""",
    "crm_non_transferred": f"WITH {HISTORY} SELECT case_id FROM history WHERE {IN_DAYS} GROUP BY 1 HAVING count(*) = 1",
    "crm_handled_by_agent": f"WITH {HISTORY} SELECT new_value AS agent, count(*) AS n_cases FROM history WHERE {IN_DAYS} GROUP BY 1",
    "crm_transferred_by_agent": f"""WITH {HISTORY} SELECT old_value AS agent, count(*) AS n_cases FROM history
WHERE {IN_DAYS} AND old_value IN (SELECT new_value FROM history WHERE {IN_DAYS} GROUP BY 1 HAVING count(*) > 10) GROUP BY 1""",
    "crm_qualified_agents": f"WITH {HISTORY} SELECT new_value AS agent FROM history WHERE {IN_DAYS} GROUP BY 1 HAVING count(*) > 100",
    "crm_issue_counts": f"""WITH {CASES} SELECT issue_id, count(*) AS n_cases FROM cases
WHERE {IN_YEAR_CLOSED} AND order_item_id IN (SELECT l_orderkey * 8 + l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand LIKE 'Brand#1%') GROUP BY 1""",
    "crm_avg_handle_time": f"""WITH {CASES} SELECT owner_id, round({mean_sql('6e7')}, 6) AS minutes FROM cases
WHERE closed >= created GROUP BY 1""",
    "crm_region_closure": f"""WITH {STATES} SELECT shipping_state, round({mean_sql('1e6')}, 6) AS seconds FROM states
WHERE closed IS NOT NULL AND shipping_state <> '' GROUP BY 1""",
    "crm_month_counts": f"WITH {CASES} SELECT monthname(created) AS month, count(*) AS n_cases FROM cases GROUP BY 1",
    "crm_agents_max": f"{_OWNERS} SELECT owner_id FROM n WHERE n = (SELECT max(n) FROM n)",
    "crm_agents_min": f"{_OWNERS} SELECT owner_id FROM n WHERE n = (SELECT min(n) FROM n)",
    "id_max_value": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)",
    "id_min_value": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = (SELECT min(l_quantity) FROM lineitem)",
    "crm_shipping_state": f"WITH {STATES} SELECT id, account_id, shipping_state FROM states",
    "crm_purchase_history": """SELECT l_orderkey AS order_id, l_partkey AS product_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_custkey = 77 AND o_orderstatus = 'F'""",
    "crm_purchase_history_filtered": """SELECT l_orderkey AS order_id, l_partkey AS product_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey
JOIN part ON p_partkey = l_partkey WHERE o_custkey = 77 AND p_brand LIKE 'Brand#%'
AND CAST(o_orderdate AS DATE) = (SELECT min(CAST(o_orderdate AS DATE)) FROM orders WHERE o_custkey = 77)""",
    "crm_order_items_by_product": "SELECT l_orderkey * 8 + l_linenumber AS id FROM lineitem WHERE l_partkey = 17",
    "crm_account_by_contact": "SELECT o_custkey AS account_id FROM orders WHERE o_orderkey = 42 ORDER BY 1 LIMIT 1",
    "crm_issues": "SELECT DISTINCT o_orderpriority AS name FROM orders",
    "crm_transcripts": "SELECT text AS body, turn AS end_time FROM conversations WHERE conv_id = 3",
    "cal_start_date": """SELECT o_orderkey, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS day_before,
  strftime(o_orderdate - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before, strftime(o_orderdate - INTERVAL 1 MONTH, '%Y-%m-%d') AS month_before,
  strftime(o_orderdate - INTERVAL 3 MONTH, '%Y-%m-%d') AS quarter_before, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
    "cal_periods": f"""SELECT CAST(y AS INTEGER) AS year, k AS period_name, strftime(make_date(y, a, 1), '%Y-%m-%d') AS start_date,
  strftime(make_date(y, a, 1) + to_months(n), '%Y-%m-%d') AS end_date
FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) JOIN (VALUES {_VALUES}) p(k, a, n) ON true""",
}
