"""Analytical questions over cases, their history, accounts and orders.

Bad parameters raise ``ValueError``. Lists of ids may be Python lists (an IN
predicate) or one-column DataFrames (a semi-join, so that ids found by one
question filter the next without passing the driver).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.calendar import micros_between, record_month, record_timestamp
from .positions import numbered

Ids = Sequence | DataFrame | None
# Fixed value: the field of a history row that assigns an owner.
OWNER_FIELD = "Owner Assignment"


def among(rows: DataFrame, column: str, ids: Ids) -> DataFrame:
    """Rows whose ``column`` is one of ``ids``; all rows where none are given."""
    if isinstance(ids, DataFrame):
        return rows.join(ids.toDF("_wanted"), F.col(column) == F.col("_wanted"), "left_semi")
    return rows.where(F.col(column).isin(list(ids))) if ids else rows


def created_in(rows: DataFrame, start: date | datetime | None, end: date | datetime | None, closed: bool = False) -> DataFrame:
    """Rows created in [start, end), or in [start, end] where ``closed``."""
    if start is not None and end is not None and start > end:
        raise ValueError("the period ends before it starts")
    if start is not None:
        rows = rows.where(F.col("created") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("created") <= F.lit(end) if closed else F.col("created") < F.lit(end))
    return rows


def get_cases(
    cases: DataFrame, start: date | None = None, end: date | None = None, *,
    owner_id: Ids = None, id: Ids = None, order_item_id: Ids = None, issue_id: Ids = None, status: Ids = None,
) -> DataFrame:
    """The cases that meet every filter given, created in [start, end)."""
    rows = created_in(cases, start, end)
    wanted = {"owner_id": owner_id, "id": id, "order_item_id": order_item_id, "issue_id": issue_id, "status": status}
    for column, ids in wanted.items():
        rows = among(rows, column, ids)
    return rows.select("owner_id", "created", "closed", "account_id")


def owner_assignments(history: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The owner assignments of [start, end]; other fields of a case do not count."""
    return created_in(history.where(F.col("field") == OWNER_FIELD), start, end, closed=True)


def non_transferred(history: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Cases assigned exactly once in the period."""
    counts = owner_assignments(history, start, end).groupBy("case_id").agg(F.count("id").alias("n"))
    return counts.where("n = 1").select("case_id")


def handled_by_agent(history: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return (
        owner_assignments(history, start, end)
        .groupBy(F.col("new_value").alias("agent")).agg(F.count("id").alias("n_cases"))
    )


def transferred_by_agent(history: DataFrame, start: datetime, end: datetime, agents: Ids = None) -> DataFrame:
    moved = owner_assignments(history, start, end).where(F.col("old_value").isNotNull())
    return among(moved, "old_value", agents).groupBy(F.col("old_value").alias("agent")).agg(F.count("id").alias("n_cases"))


def qualified_agents(counts: DataFrame, n_cases: int) -> DataFrame:
    """Agents with more than ``n_cases`` cases."""
    return counts.where(F.col("n_cases") > n_cases).select("agent")


def issue_counts(cases: DataFrame, start: date, end: date, items: Sequence | DataFrame) -> DataFrame:
    """Cases of each issue, the most frequent first: those about one of the order items, created in [start, end]."""
    if not isinstance(items, DataFrame) and not items:
        raise ValueError("issue counts need order items")
    rows = among(created_in(cases, start, end, closed=True), "order_item_id", items)
    return rows.groupBy("issue_id").agg(F.count("id").alias("n_cases")).orderBy(F.desc("n_cases"), "issue_id")


def _mean(rows: DataFrame, key: str, unit_micros: float, name: str) -> DataFrame:
    took = micros_between(F.col("created"), F.col("closed"))
    # exact, and wider than a long, which the micros of some 300,000 years fill
    sums = rows.groupBy(key).agg(F.sum(took.cast("decimal(20,0)")).alias("_sum"), F.count(took).alias("_n"))
    return sums.select(key, (F.col("_sum").cast("double") / (F.col("_n") * F.lit(unit_micros))).alias(name))


def average_handle_minutes(cases: DataFrame, strict: bool = False) -> DataFrame:
    """Mean minutes from creation to closure of each owner.

    ``strict`` raises at run time for an open case or one closed before it was
    created; otherwise those cases are left out.
    """
    good = F.col("closed").isNotNull() & (F.col("closed") >= F.col("created"))
    if strict:
        checked = F.when(good, F.col("closed")).otherwise(
            F.raise_error(F.lit("a case is open or closes before it was created"))
        )
        return _mean(cases.withColumn("closed", checked), "owner_id", 6e7, "minutes")
    return _mean(cases.where(good), "owner_id", 6e7, "minutes")


def with_shipping_state(cases: DataFrame, accounts: DataFrame) -> DataFrame:
    """``cases`` and the state of their accounts, null where there is none."""
    states = accounts.select(F.col("id").alias("_account"), "shipping_state")
    return cases.join(states, F.col("account_id") == F.col("_account"), "left").drop("_account")


def closure_seconds_by_region(cases: DataFrame, accounts: DataFrame) -> DataFrame:
    """Mean seconds from creation to closure of each state; negative ones count."""
    rows = with_shipping_state(cases.where(F.col("closed").isNotNull()), accounts)
    return _mean(rows.where(F.col("shipping_state") != ""), "shipping_state", 1e6, "seconds")


def month_counts(cases: DataFrame) -> DataFrame:
    """Cases of each month's name, of all years together.

    A creation time that is a record's text counts in the month of its own offset.
    """
    own = isinstance(cases.schema["created"].dataType, StringType)
    month = record_month(F.col("created")) if own else F.date_format("created", "MMMM")
    return cases.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n_cases"))


def extremes(values: DataFrame, value: str, largest: bool = True) -> DataFrame:
    """All rows that hold the largest (smallest) value: one scalar, broadcast, and a filter."""
    best = values.agg((F.max if largest else F.min)(value).alias("_best"))
    return values.join(F.broadcast(best), F.col(value) == F.col("_best")).drop("_best")


def agents_by_cases(cases: DataFrame, most: bool = True) -> DataFrame:
    """All owners with the most (fewest) cases."""
    return extremes(cases.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_cases")), "n_cases", most).select("owner_id")


def purchase_history(
    items: DataFrame, orders: DataFrame, account_id: int | str, on: date | None = None, products: Ids = None, status: str | None = None
) -> DataFrame:
    """The products of an account's orders; repeated ones stay."""
    own = orders.where(F.col("account_id") == account_id)
    if on is not None:
        own = own.where(F.col("effective_date") == F.lit(on))
    if status is not None:
        own = own.where(F.col("status") == status)
    found = items.join(own.select(F.col("id").alias("_order")), F.col("order_id") == F.col("_order"))
    return among(found, "product_id", products).select("order_id", "product_id")


def items_of_product(items: DataFrame, product_id: int | str) -> DataFrame:
    return items.where(F.col("product_id") == product_id).select("id")


def account_of_contact(contacts: DataFrame, contact_id: int | str) -> DataFrame:
    """At most one account."""
    return contacts.where(F.col("id") == contact_id).orderBy("account_id").limit(1).select("account_id")


def transcript_of_case(transcripts: DataFrame, case_id: int | str) -> DataFrame:
    return transcripts.where(F.col("case_id") == case_id).select("body", "end_time")


# Fixed value: the layout of record timestamps, as errors name it.
RECORD_LAYOUT = "%Y-%m-%dT%H:%M:%S.%f%z"


def case_errors(
    cases: DataFrame, required: Sequence[str], order: Column, times: Sequence[str] = (), not_before: tuple[str, str] | None = None
) -> DataFrame:
    """The first row, in order, with an error: (position, index, missing, malformed, message); nulls without one.

    ``missing``: required columns that are null; ``malformed``: those of
    ``times``, texts, that are no timestamps of records; an error is also a first
    column of ``not_before`` that is earlier than the second. ``index`` counts the
    rows that sort before, so nothing is sorted for it; ``order`` is unique.
    """
    def listed(marks: dict[str, Column]) -> Column:
        names = F.array(*[F.when(bad, F.lit(c)) for c, bad in marks.items()]).cast("array<string>")
        return F.filter(names, lambda x: x.isNotNull())

    missing = listed({c: F.col(c).isNull() for c in required})
    malformed = listed({c: F.col(c).isNotNull() & record_timestamp(F.col(c)).isNull() for c in times})
    late, soon = (record_timestamp(F.col(c)) if c in times else F.col(c) for c in not_before) if not_before else (F.lit(0), F.lit(0))
    marked = cases.select(order.alias("_order"), missing.alias("missing"), malformed.alias("malformed"), F.coalesce(late < soon, F.lit(False)).alias("early"))
    bad = marked.where((F.size("missing") > 0) | (F.size("malformed") > 0) | F.col("early"))
    first = bad.agg(F.min(F.struct("_order", "missing", "malformed", "early")).alias("m"))
    before = cases.where(order < first.select("m._order").scalar()).agg(F.count(F.lit(1)).alias("n"))
    found = first.select("m.*", before.scalar().alias("index"))
    place = F.col("index").cast("string")
    message = (
        F.when(F.size("missing") > 0, F.concat(F.lit("Error: '"), F.get("missing", F.lit(0)), F.lit("' not found in case record at index "), place))
        .when(F.size("malformed") > 0, F.concat(F.lit("Error: Invalid date format at index "), place, F.lit(f". Expected format: '{RECORD_LAYOUT}'")))
        .when(F.col("early"), F.concat(F.lit("Error: {} is earlier than {} at index ".format(*(not_before or ("", "")))), place))
    )
    return found.select(
        F.col("_order").alias("position"), F.when(F.col("_order").isNotNull(), F.col("index")).alias("index"), "missing", "malformed", message.alias("message")
    )


def ranked(rows: DataFrame, by: str, *keys: str) -> DataFrame:
    """``rows`` with their dense rank by ``by`` within ``keys``.

    The distinct values are ranked, within ranges of their order, and joined
    back: no task holds the rows of a key, nor all values where there is no key.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    values = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(by).alias("_v")).distinct()
    placed = numbered(values, *names, F.col("_v").isNull(), -F.col("_v"), name="_at")
    firsts = placed.groupBy(*names).agg(F.min("_at").alias("_first"))
    if names:
        firsts = firsts.toDF(*[f"_f{n}" for n in names], "_first")
        placed = placed.join(firsts, reduce(and_, [F.col(n).eqNullSafe(F.col(f"_f{n}")) for n in names]))
    else:
        placed = placed.withColumn("_first", F.lit(0))
    ranks = placed.select(*names, "_v", (F.col("_at") - F.col("_first") + 1).cast("int").alias("rank"))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip([*keys, by], [*names, "_v"], strict=True)]
    return rows.join(ranks, reduce(and_, on)).drop(*names, "_v")
