"""Operators on hand-written rows."""

from __future__ import annotations

import asyncio
import io
import json
import math
import os
import subprocess
import sys
import time
import zipfile
from datetime import datetime

import pandas as pd
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rolloutframe.operators import crm, datasets, positions, rewards, rollouts, search, sheets, text_index, toolcalls
from rolloutframe.operators.environments import Environment, Tool
from rolloutframe.sources import sql_functions, tables, workspace, xlsx
from rolloutframe.streaming import rollouts as streams
from rolloutframe.streaming import state


def at(hour, minute=0, month=10):
    return datetime(2023, month, 1, hour, minute)


@pytest.fixture
def cases(spark):
    return spark.createDataFrame(
        [(1, 10, "a", at(0), at(1, 30)), (2, 10, "a", at(0), at(0, 45)), (3, 11, "b", at(0, month=11), at(3, month=11)), (4, 99, "b", at(0), None)],
        "id int, account_id int, owner_id string, created timestamp_ntz, closed timestamp_ntz",
    )


def test_times(spark, cases):
    accounts = spark.createDataFrame([(10, "CA"), (11, "NY")], "id int, shipping_state string")
    assert {r[0]: r[1] for r in crm.average_handle_minutes(cases).collect()} == {"a": 67.5, "b": 180.0}
    assert {r[0]: r[1] for r in crm.closure_seconds_by_region(cases, accounts).collect()} == {"CA": 4050.0, "NY": 10800.0}
    assert {r[0]: r[1] for r in crm.month_counts(cases).collect()} == {"October": 3, "November": 1}
    assert sorted(r["shipping_state"] or "" for r in crm.with_shipping_state(cases, accounts).collect()) == ["", "CA", "CA", "NY"]
    with pytest.raises(Exception, match="open"):
        crm.average_handle_minutes(cases, strict=True).collect()


def test_long_sums_of_times(spark):
    """The micros of 40 cases of 9000 years are no long any more."""
    long = [(i, 10, "a", datetime(500, 1, 1), datetime(9500, 1, 1)) for i in range(40)]
    cases = spark.createDataFrame(long, "id int, account_id int, owner_id string, created timestamp_ntz, closed timestamp_ntz")
    cases = cases.withColumns({c: F.lit("x") for c in ("order_item_id", "issue_id", "status")})
    accounts = spark.createDataFrame([(10, "CA")], "id int, shipping_state string")
    seconds = (datetime(9500, 1, 1) - datetime(500, 1, 1)).total_seconds()
    assert [r[1] for r in crm.average_handle_minutes(cases, strict=True).collect()] == [seconds / 60]
    assert [r[1] for r in crm.closure_seconds_by_region(cases, accounts).collect()] == [seconds]
    history = spark.createDataFrame([], "id int, case_id int, field string, created timestamp_ntz, new_value string, old_value string")
    sql_functions.register_questions(cases, history, accounts, "long")
    assert spark.sql("SELECT minutes FROM long_average_handle_minutes()").first()[0] == seconds / 60
    assert spark.sql("SELECT seconds FROM long_closure_seconds_by_region()").first()[0] == seconds


def test_articles_that_share_a_title(spark):
    articles = spark.createDataFrame([(1, "t", "one"), (2, "t", "two"), (3, "u", None)], "id int, title string, extract string")
    asked = spark.createDataFrame([(1, "t"), (2, "t"), (3, "u"), (4, "t"), (2, "old"), (5, "old")], "id int, title string")
    moved = spark.createDataFrame([(2, "old", "t"), (2, "old", "z"), (5, "old", "t")], "id int, title string, target string")
    found = sorted(tuple(r) for r in search.article_texts(asked, articles, 50, moved, within=("id",)).collect())
    lost = "Error: No pages found for title '{}'".format
    assert found == [(1, "t", "one"), (2, "old", "two"), (2, "t", "two"), (3, "u", "Error: No extract found for 'u'"), (4, "t", lost("t")), (5, "old", lost("old"))]
    assert [r["text"] for r in search.article_texts(asked.where("title = 't'"), articles).collect()] == ["one"] * 3


def test_ties(spark):
    values = spark.createDataFrame([("1", 15.0), ("2", 10.0), ("3", 15.0)], "id string, value double")
    assert sorted(r["id"] for r in crm.extremes(values, "value").collect()) == ["1", "3"]
    assert [r["id"] for r in crm.extremes(values, "value", largest=False).collect()] == ["2"]
    assert crm.extremes(values.where("false"), "value").count() == 0
    counts = spark.createDataFrame([("x", 10), ("y", 5), ("z", 15)], "agent string, n_cases int")
    assert crm.qualified_agents(counts, 7).count() == 2
    assert crm.qualified_agents(counts, 10).count() == 1


def test_filters(spark, cases):
    assert crm.get_cases(cases.withColumns({"issue_id": F.lit(1), "status": F.lit("s")}), at(0), at(0, month=11)).count() == 3
    ids = spark.createDataFrame([(1,), (3,)], "id int")
    assert crm.among(cases, "id", ids).count() == 2
    assert crm.among(cases, "id", []).count() == 4
    with pytest.raises(ValueError):
        crm.created_in(cases, at(2), at(1))
    bad = crm.case_errors(cases, ["closed"], F.col("id")).first()
    assert (bad["position"], bad["missing"], bad["malformed"]) == (4, ["closed"], [])
    texts = spark.createDataFrame([(1, "2024-01-05T00:30:00.000+0000"), (2, "2024-01-32T00:30:00.000+0000"), (3, "soon")], "i int, created string")
    layout = "Error: Invalid date format at index 1. Expected format: '%Y-%m-%dT%H:%M:%S.%f%z'"
    assert tuple(crm.case_errors(texts, [], F.col("i"), times=["created"]).first()) == (2, 1, [], ["created"], layout)
    assert tuple(crm.case_errors(texts.where("i < 2"), ["i"], F.col("i"), times=["created"]).first()) == (None, None, None, None, None)
    assert bad["message"] == "Error: 'closed' not found in case record at index 3"
    early = crm.case_errors(cases, ["id"], -F.col("id"), not_before=("created", "closed")).first()
    assert (early["position"], early["message"]) == (-3, "Error: created is earlier than closed at index 1")
    items = [(1, 5, "Owner Assignment"), (2, 5, "Status")]
    history = spark.createDataFrame([(i, c, f, at(0), "b", "a") for i, c, f in items], "id int, case_id int, field string, created timestamp_ntz, new_value string, old_value string")
    assert [r[0] for r in crm.non_transferred(history, at(0), at(0)).collect()] == [5]
    about = cases.withColumns({"issue_id": F.lit("x"), "order_item_id": F.col("id") * 8})
    assert [tuple(r) for r in crm.issue_counts(about, at(0), at(0, month=11), [8, 24, 99]).collect()] == [("x", 2)]  # both bounds count
    with pytest.raises(ValueError):
        crm.issue_counts(about, at(0), at(1), [])


def test_drop_null_columns(spark):
    rows = spark.createDataFrame([(1, None, None), (2, None, "x")], "a int, b string, c string")
    assert tables.drop_null_columns(rows).columns == ["a", "c"]


def reward(spark, function, *values):
    schema = ", ".join(f"c{i} {'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values))
    frame = spark.createDataFrame([values], schema)
    return frame.select(function(*[F.col(c) for c in frame.columns]).alias("r")).first()["r"]


def test_rewards(spark):
    say = "<answer>{}</answer>".format
    assert reward(spark, rewards.numeric_match, say("4"), "4") == 1
    assert reward(spark, rewards.numeric_match, say("-2.50"), "-2.5") == 1
    assert reward(spark, rewards.numeric_match, say("four"), "4") == 0
    assert reward(spark, rewards.numeric_match, say("nan"), "nan") == 0
    assert reward(spark, rewards.numeric_match, "4", "4") == 0
    assert reward(spark, rewards.text_match, say("Paris"), "PARIS") == 1
    assert reward(spark, rewards.text_match, say("Paris"), " paris") == 0
    assert reward(spark, rewards.token_iou, say("apple banana"), ["apple", "banana, cherry"]) == pytest.approx(2 / 3)
    assert reward(spark, rewards.token_iou, say(""), [""]) == 1
    assert reward(spark, rewards.token_iou, say("x"), [""]) == 0
    assert reward(spark, rewards.token_f1, say("hello world test"), "hello world") == pytest.approx(0.8)
    assert reward(spark, rewards.token_f1, say("x x y"), "x x x") == pytest.approx(2 / 3)
    assert reward(spark, rewards.token_f1, say("a"), "the") == 0
    assert reward(spark, rewards.stripped_match, " a\n", "a") == 1
    assert reward(spark, rewards.by_metric, say("a b"), ["a b"], "fuzzy_match") == 1
    assert reward(spark, rewards.by_metric, say("b"), ["b"], "other") == 0
    assert math.isnan(reward(spark, rewards.by_metric, say("b"), ["b"], None))


def test_message_completions(spark):
    rows = spark.createDataFrame([([("user", "q"), ("assistant", "<answer>4</answer>")],), ([],)], "m array<struct<role:string,content:string>>")
    found = rows.select(rewards.numeric_match(rewards.completion_text(rows, "m"), F.lit("4")).alias("r")).collect()
    assert [r["r"] for r in found] == [1.0, 0.0]


def test_fan_out_and_groups(spark):
    rows = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 2.0), (None, 2.0)], "g string, r double")
    out = rewards.fan_out(rows, {"x": F.col("r"), "y": F.when(F.col("g") == "g", 1.0)}).collect()
    assert sorted(str(r["total_reward"]) for r in out) == ["2.0", "4.0", "nan", "nan"]
    normal = {(r["g"], r["r"]): r["advantage"] for r in rewards.group_normalized(rows, "g", "r").collect()}
    assert normal == {("g", 1.0): -1.0, ("g", 3.0): 1.0, ("h", 2.0): 0.0, (None, 2.0): 0.0}


def test_tool_calls(spark):
    call = "<tool_call>{}</tool_call>".format
    texts = [
        "hi " + call('{"name": "f", "arguments": {"x": 1}}') + call(' {"name": "g"} '), "none", call('{"name": "f"}') + call("{bad"),
        call("[1]"), call('{"arguments": {}}'), call('{"name": "h", "arguments": [1]}'),
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {(r["i"], r["call"]): (r["name"], r["arguments"], r["error"]) for r in toolcalls.calls(rows, "text").collect()}
    assert got[0, 0] == ("f", '{"x":1}', None)
    assert got[0, 1] == ("g", "{}", None)
    assert got[3, 0][2] == toolcalls.NOT_AN_OBJECT
    assert got[4, 0][2] == toolcalls.NO_NAME
    assert got[5, 0][2] == "Error: 'arguments' for h must be a JSON object."
    assert {i for i, _ in got} == {0, 3, 4, 5}


def test_catalogue():
    assert toolcalls.tools_prompt([], "Hi") == "Hi"
    prompt = toolcalls.tools_prompt([("f", "", None)], "Hi")
    assert prompt.startswith("Hi\n\n# Tools") and '"parameters":{"required":[]},"strict":false}}\n</tools>' in prompt


def test_search(spark):
    rows = spark.createDataFrame([(1, "A &amp; B", "<b>cat</b> cat"), (2, "C", "dog cat"), (3, "D", None)], "id int, title string, extract string")
    hits = search.search_articles(rows, "CAT", 5)
    assert [(r["rank"], r["id"], r["title"], r["hits"]) for r in hits.orderBy("rank").collect()] == [(1, 1, "A & B", 2), (2, 2, "C", 1)]
    listed = search.hit_list(hits.withColumn("snippet", F.lit("s"))).first()["text"]
    assert listed == "1. A & B\n   s\n\n2. C\n   s"
    assert search.hit_list(hits.where("false").withColumn("snippet", F.lit("s"))).first()["text"] == "No results found."
    with pytest.raises(ValueError):
        search.search_products(rows, " ")


def test_splits(spark):
    rows = spark.range(11).withColumnRenamed("id", "k")
    found = {r["k"]: r["split"] for r in datasets.split_tail(rows, "k").collect()}
    assert [k for k, s in sorted(found.items()) if s == "test"] == [8, 9, 10]
    assert datasets.split_tail(rows.where("false"), "k").count() == 0
    for kind, prefix in (("string", ""), ("string", "ex-")):
        texts = rows.select(F.concat(F.lit(prefix), F.col("k").cast(kind)).alias("k"))
        found = {r["k"]: r["split"] for r in datasets.split_tail(texts, "k").collect()}
        assert sorted(k for k, s in found.items() if s == "test") == sorted(prefix + str(k) for k in (8, 9, 7))
    mixed = datasets.train_and_test({"a": rows, "b": rows.where("k < 5")}, "k", seed=3)
    assert sorted(r["split"] for r in mixed.collect()) == ["test"] * 4 + ["train"] * 12


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 1009, 5000])
def test_shuffles_are_permutations(spark, n):
    rows = spark.range(n).withColumn("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")))
    found = [r["place"] for r in datasets.shuffled(rows, "id", 5).collect()]
    assert sorted(found) == list(range(n))
    again = positions.permuted(spark.range(n).withColumnRenamed("id", "position"), n, seed=6).orderBy("position").collect()
    places = [r["place"] for r in again]
    assert sorted(places) == list(range(n)) and (n < 100 or places != found)
    if n >= 1000:  # no trace of the order: neighbours lie far apart, and few places stay
        assert sum(abs(a - b) for a, b in zip(places, places[1:], strict=False)) / n > n / 4
        assert sum(i == p for i, p in enumerate(places)) < 15


def test_positions_of_any_order(spark):
    """Nulls, ties, texts and several keys; no range holds more than its share, though one key has most rows."""
    rows = spark.createDataFrame([(None if i % 10 == 0 else "hot" if i % 10 < 8 else f"k{i}", i % 3) for i in range(4000)], "k string, j int").repartition(5)
    placed = positions.numbered(rows, "k", -F.col("j"), name="at", range_rows=300)
    assert [r["at"] for r in placed.orderBy("at").collect()] == list(range(4000))
    keys = [(r["k"] is not None, r["k"] or "", -r["j"]) for r in placed.orderBy("at").collect()]
    assert keys == sorted(keys)
    largest = placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert placed.columns == ["k", "j", "at"] and largest <= 4000


def test_small_ranges_grow_before_they_are_too_many(spark, monkeypatch):
    """The number of ranges, each of which costs the driver memory, is held, and all rows are numbered; large ranges do not grow."""
    rows = spark.range(4000).select((F.col("id") * 7919 % 4001).alias("k"), (F.col("id") % 9).alias("j")).repartition(5)
    monkeypatch.setattr(positions, "MOST_RANGES", 20, raising=False)
    for most, ranges in ((1_000_000, 20), (100, 40), (5, 400)):
        monkeypatch.setattr(positions, "RANGE_ROWS", most)
        placed = positions.numbered(rows, "j", -F.col("k"), name="at", range_rows=10)
        assert ranges / 2 < len(placed.inputFiles()) <= ranges
        found = placed.orderBy("at").collect()
        assert [r["at"] for r in found] == list(range(4000)) and [(r["j"], -r["k"]) for r in found] == sorted((r["j"], -r["k"]) for r in rows.collect())


def test_examples_of_one_workbook_are_judged_apart(spark):
    cell = "workbook string, sheet string, sheet_idx int, row int, col int, value string, value_type string"
    truth = spark.createDataFrame([("w", "S", 0, 1, 1, "5", "number"), ("w", "S", 0, 1, 2, "x", "string"), ("v", "S", 0, 1, 1, "1", "number")], cell)
    output = spark.createDataFrame([("w", "S", 0, 1, 1, "5.0", "number"), ("w", "S", 0, 1, 2, "y", "string"), ("v", "S", 0, 1, 1, "1", "number")], cell)
    asked = [("w", "A1", 1), ("w", "B1", 2), ("w", "A1:B1", 3), ("w", "A1,C9", 4), ("v", "A1", 5), ("u", "A1", 6), ("w", None, 7), ("w", "A1", 8), ("w", "?", 9)]
    found = sheets.spreadsheet_reward(spark.createDataFrame(asked, "workbook string, position string, id int"), truth, output)
    assert {r["id"]: r["reward"] for r in found.collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 1.0, 6: 0.0, 7: 0.0, 8: 1.0, 9: 0.0}


def test_ranges_are_compared_without_their_cells(spark):
    """A whole sheet, of 17 billion cells, costs what its differing cells cost."""
    cell = "workbook string, sheet string, sheet_idx int, row int, col int, value string, value_type string"
    truth = spark.createDataFrame([("w", "S", 0, r, c, str(r * c), "number") for r in (1, 63, 64, 200) for c in (1, 3)], cell)
    output = truth.withColumn("value", F.when((F.col("row") == 200) & (F.col("col") == 3), "x").when((F.col("row") == 64) & (F.col("col") == 3), "192.004").otherwise(F.col("value")))
    output = output.unionByName(spark.createDataFrame([("w", "S", 0, 70, 2, "new", "string"), ("w", "T", 1, 1, 1, "1", "number")], cell))
    asked = ["A1:XFD1048576", "A1:C69", "A71:C300", "S!C200,B70", "T!A1", "A1:B2,?", "C1:A1", "A64:C64"]
    wanted = sheets.split_ranges(spark.createDataFrame([("w", p) for p in asked], "workbook string, position string"), "position")
    found = sheets.compare_cells(wanted, truth, output, by=("workbook", "position")).collect()
    assert {r["position"]: (r["matches"], r["first_mismatch"]) for r in found} == {
        "A1:XFD1048576": (False, "B70"), "A1:C69": (True, None), "A71:C300": (False, "C200"), "S!C200,B70": (False, "C200"),
        "T!A1": (False, None), "A1:B2,?": (False, None), "C1:A1": (True, None), "A64:C64": (True, None),
    }


async def _sleeps(completion, **_):
    await asyncio.sleep(30 if completion == "forever" else 0.2)
    return 1


def _blocks(completion, **_):
    time.sleep(20 if completion == "stuck" else 0.05)
    return 2


def test_rewards_wait_together(spark):
    """1000 rewards of 0.2 s and 0.05 s, on two tasks, in a fraction of their sum; those out of time are NaN."""
    rows = [("forever" if i % 300 == 7 else "stuck" if i % 400 == 9 else "ok",) for i in range(1000)]
    given = spark.createDataFrame(rows, "completion string").withColumn("ground_truth", F.lit("")).repartition(2)
    began = time.perf_counter()
    found = rewards.call_rewards(given, {"sleeps": _sleeps, "blocks": _blocks}, concurrency=100, timeout=3).collect()
    took = time.perf_counter() - began
    assert took < 40  # one after another: 250 s, and 120 s for those that never end
    for r in found:
        assert math.isnan(r["rewards"]["sleeps"]) == (r["completion"] == "forever")
        assert math.isnan(r["rewards"]["blocks"]) == (r["completion"] == "stuck")
    assert sum(r["rewards"]["sleeps"] == 1.0 and r["rewards"]["blocks"] == 2.0 for r in found) == 1000 - 4 - 3


def test_waits_of_batches_overlap(spark):
    """Batches of one row, of which nearly all are out of time: the waits of a task's seven or eight are one."""
    rows = spark.range(60).select(F.when(F.col("id") % 10 != 5, "forever").otherwise("ok").alias("completion"), F.lit("").alias("ground_truth"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        began = time.perf_counter()
        found = rewards.call_rewards(rows.repartition(8), {"sleeps": _sleeps}, timeout=4).collect()
        assert time.perf_counter() - began < 12
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all(math.isnan(r["rewards"]["sleeps"]) == (r["completion"] == "forever") for r in found) and len(found) == 60


CALLS = "rollout_id string, seq int, tool string, name string, value double"
TURNS = [
    [("a", 2, "get_variable", "x", None), ("a", 1, "define_variable", "x", 1.5), ("b", 1, "get_variable", "x", None), ("c", 1, "define_variable", "y", 2.0)],
    [("a", 3, "get_variable", "x", None), ("a", 4, "define_variable", "x", 7.0), ("a", 5, "get_variable", "x", None), ("c", 2, None, None, None)],
    [("a", 6, "get_variable", "2x", None), ("a", 7, "define_variable", "2x", 1.0), ("a", 8, "get_variable", "x", None), ("c", 3, "get_variable", "y", None),
     ("b", 2, "define_variable", "x", None), ("b", 3, "get_variable", "x", None), ("b", 4, "error", None, None), ("b", 5, "get_variable", "x", None)],
]
FOUND = {
    ("a", 2, "x", 1.5, None), ("b", 1, "x", None, "Variable 'x' not defined"), ("a", 3, "x", 1.5, None), ("a", 5, "x", 7.0, None),
    ("a", 6, "2x", None, "Invalid variable name: '2x'"), ("a", 8, "x", 7.0, None), ("b", 3, "x", None, None),
}


def test_variables_at_the_call_in_batch(spark):
    log = spark.createDataFrame([r for turns in TURNS for r in turns], CALLS).repartition(3)
    for chunk in (1, 2, 4096):
        assert {tuple(r) for r in rollouts.variables_at(log, chunk).collect()} == FOUND


def test_variables_at_the_call_as_a_stream(spark, tmp_path):
    """Three micro-batches see what the batch twin sees."""
    for n, turns in enumerate(TURNS):
        spark.createDataFrame(turns, CALLS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        os.utime(next((tmp_path / "in" / str(n)).glob("*.parquet")), (n + 1, n + 1))
    source = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = streams.run_to_end(state.variables_at(source), ["rollout_id", "seq"], state.PROVIDER)
    assert {(r["rollout_id"], r["seq"], r["name"], r["value"], r["error"]) for r in found.collect()} == FOUND


def test_the_processor_needs_no_package_where_it_is_read(spark):
    """The driver's worker for state schemas starts with PySpark alone."""
    state.variables_at(spark.createDataFrame([], CALLS))
    code = "import sys, pickle; print(type(pickle.load(sys.stdin.buffer)).__name__)"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(state.Variables()), cwd="/", env={}, capture_output=True, check=True)
    assert done.stdout.strip() == b"Variables"


class _State:
    """What a state of one key offers."""

    def __init__(self):
        self.held = {}

    def exists(self):
        return bool(self.held)

    def update(self, value):
        self.held = {(): value}

    def clear(self):
        self.held = {}

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = value

    def getValue(self, key):  # noqa: N802
        return self.held[key]

    def containsKey(self, key):  # noqa: N802
        return key in self.held


class _Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):  # noqa: N802
        return _State()

    getValueState = getMapState  # noqa: N815

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, timer):  # noqa: N802
        self.timers.remove(timer)

    def registerTimer(self, timer):  # noqa: N802
        self.timers.add(timer)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 1000


def test_silent_rollouts_lose_their_state():
    processor, handle = state.Variables(idle=50), _Handle()
    processor.init(handle)
    ask = lambda rows: [list(f.itertuples(index=False, name=None)) for f in processor.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["rollout_id", "seq", "tool", "name", "value"])]), handle)]
    assert ask([("a", 2, "get_variable", "x", None), ("a", 1, "define_variable", "x", 3.0)]) == [[("a", 2, "x", 3.0, None)]]
    assert handle.timers == {1050}
    assert list(processor.handleExpiredTimer(("a",), handle, None)) == []
    assert ask([("a", 3, "get_variable", "x", None)]) == [[("a", 3, "x", None, "Variable 'x' not defined")]]
    assert ask([("a", 4, None, None, None)]) == ask([("a", 5, "get_variable", "x", None)]) == [] and len(handle.timers) == 1


def test_an_index_is_searched_without_the_texts(spark, tmp_path):
    rows = [(1, "Red e-mail", "Über alles"), (2, "blue", None), (3, None, "RED redder 2nd"), (4, "", "E mail; red, red"), (5, "reddish", "mail")]
    texts = spark.createDataFrame(rows, "id int, name string, body string")
    text_index.add(texts.where("id < 4"), f"{tmp_path}/i", "id", {"name": F.col("name"), "body": F.col("body")})
    text_index.add(texts.where("id >= 4"), f"{tmp_path}/i", "id", {"name": F.col("name"), "body": F.col("body")})
    index = text_index.read(spark, f"{tmp_path}/i")
    find = lambda text, *fields: {tuple(r) for r in text_index.search(index, text, fields).collect()}
    assert find("red") == {(1, 1), (3, 1), (4, 2)}
    assert find("RED*") == {(1, 1), (3, 2), (4, 2), (5, 1)}
    assert find("e-mail red") == find("red AND E AND mail") == {(1, 3), (4, 4)}
    assert find("über OR 2nd OR BLUE") == {(1, 1), (2, 1), (3, 1)}
    assert find("red", "name") == {(1, 1)} and find("zzz") == set() and find("mail e*", "body") == {(4, 2)}
    for blank in ("", "  ", " OR ", "AND", "*", None):
        with pytest.raises(ValueError, match="cannot be empty"):
            text_index.search(index, blank)
    plan = text_index.search(index, "red ble*")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,ble)" in plan and "EqualTo(term,red)" in plan and plan.count("FileScan") == 1
    objects = text_index.find({"A": index, "B": index}, "blue").collect()
    assert sorted(map(tuple, objects)) == [("A", "2", 1), ("B", "2", 1)]


def test_an_index_is_built_without_moving_its_words(spark, tmp_path):
    """Texts are dealt once, a record each; words are counted where they are, in blocks of any size."""
    texts = spark.range(50).select("id", F.concat_ws(" ", F.lit("all, ALL"), *[F.concat(F.lit(f"w{i}x"), F.col("id")) for i in range(40)]).alias("body"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("index", "index")
    text_index.add(texts, f"{tmp_path}/i", "id", {"body": F.col("body")})
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup("index") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)}
    store = spark.sparkContext._jsc.sc().statusStore()
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) <= 50
    index = text_index.read(spark, f"{tmp_path}/i")
    assert index.count() == 50 * 41 and {tuple(r) for r in text_index.search(index, "all w7x9").collect()} == {(9, 3)}


def test_blocks_of_postings_hold_all_words(monkeypatch):
    texts = ["b a b", "a", "long " * 30 + "a", "b", "c c a b"]
    batch = pa.RecordBatch.from_pydict({"id": [5, 1, None, 2, 9], "field": ["f"] * 5, "text": [t.strip() for t in texts]})
    most = {1000: 1, 12: 2, 1: 5}
    for size, blocks in most.items():
        monkeypatch.setattr(text_index, "BLOCK_BYTES", size)
        assert len(list(text_index._blocks(iter([batch.slice(0, 2), batch.slice(2)])))) == blocks
        for rows in (1, 1000):
            monkeypatch.setattr(text_index, "OUT_ROWS", rows)
            found = [tuple(r.values()) for b in text_index._postings(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
            want = [(w, "f", i, t.split().count(w)) for i, t in zip([5, 1, None, 2, 9], texts, strict=True) for w in set(t.split())]
            assert sorted(map(str, found)) == sorted(map(str, want))
            assert blocks > 1 or [f[0] for f in found] == sorted(f[0] for f in found)


def test_search_texts_always_say_something(spark):
    hits = spark.createDataFrame([(1, None, "s"), (2, "t", None)], "rank int, title string, snippet string")
    assert search.hit_list(hits).first()["text"] == "1. \n   s\n\n2. t\n   "
    articles = spark.createDataFrame([(1, "a", "b")], "id int, title string, extract string")
    for blank in ("", " \t", None):
        assert search.search_text(articles, blank).first()["text"] == "Error: Missing required parameter: 'q'"


def test_counts_come_from_footers(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, None, "x"), (2, None, 3.0, None)], "id int, nothing string, `a.b` double, s string")
    rows.repartition(2).write.parquet(f"{tmp_path}/t")
    counts = tables.footer_counts(spark, f"{tmp_path}/t")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(id)" in plan and tuple(counts.first()) == (2, 0, 1, 1)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    assert tables.load_without_null_columns(spark, f"{tmp_path}/t").columns == ["id", "a.b", "s"]
    rows.withColumn("l", F.array("id")).write.parquet(f"{tmp_path}/u")
    assert tables.load_without_null_columns(spark, f"{tmp_path}/u").columns == ["id", "a.b", "s", "l"]


def test_tool_calls_in_sql(spark):
    sql_functions.register_tool_calls(spark)
    texts = ['<tool_call>{"name": "f", "arguments": {"id": 7, "to": "é", "more": [1, {"a": null}]}}</tool_call> <tool_call>{"name": "g"}</tool_call>',
             '<tool_call>{"name": "f"}</tool_call><tool_call>{</tool_call>', "none", None, "<tool_call>[1]</tool_call>", '<tool_call>{"name": "h", "arguments": 3}</tool_call>']
    spark.createDataFrame(list(enumerate(texts)), "i int, text string").createOrReplaceTempView("model_texts")
    found = spark.sql("SELECT i, c.* FROM model_texts m, LATERAL tool_calls(m.text, 'id, to,more') c ORDER BY i, call").collect()
    assert found[0].asDict() == {"i": 0, "call": 0, "name": "f", "arguments": '{"id":7,"to":"é","more":[1,{"a":null}]}', "error": None, "id": "7", "to": "é", "more": '[1,{"a":null}]'}
    assert [(r["i"], r["name"], r["arguments"], r["error"]) for r in found[1:]] == [
        (0, "g", "{}", None), (4, None, None, toolcalls.NOT_AN_OBJECT), (5, "h", "3", toolcalls.BAD_ARGUMENTS % "h"),
    ]
    plain = toolcalls.calls(spark.table("model_texts"), "text").orderBy("i", "call").collect()
    assert [(r["i"], r["call"], r["name"], r["arguments"], r["error"]) for r in plain] == [(r["i"], r["call"], r["name"], r["arguments"], r["error"]) for r in found]


def test_dense_ranks(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("a", 1.0), ("a", None), (None, 2.0), (None, 5.0), ("b", 0.0)], "k string, v double")
    assert sorted((r["k"] or "", -1.0 if r["v"] is None else r["v"], r["rank"]) for r in crm.ranked(rows, "v", "k").collect()) == [
        ("", 2.0, 2), ("", 5.0, 1), ("a", -1.0, 3), ("a", 1.0, 2), ("a", 3.0, 1), ("a", 3.0, 1), ("b", 0.0, 1),
    ]
    assert sorted((-1.0 if r["v"] is None else r["v"], r["rank"]) for r in crm.ranked(rows, "v").collect()) == [(-1.0, 6), (0.0, 5), (1.0, 4), (2.0, 3), (3.0, 2), (3.0, 2), (5.0, 1)]


def test_prompts(spark):
    row = spark.createDataFrame([("p", "t", None, "q")], "a string, b string, c string, d string")
    assert row.select(datasets.crm_prompt(*[F.col(c) for c in "abcd"]).alias("x")).first()["x"] == "p\nt\nq"


@pytest.fixture
def book(tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Sheet1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>D</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><fonts><font/><font><b/></font></fonts><fills><fill/><fill><patternFill><fgColor rgb="FFFF0000"/></patternFill></fill></fills>'
                   '<cellXfs><xf fontId="0" fillId="0"/><xf fontId="1" fillId="1"/></cellXfs></styleSheet>')  # fmt: skip
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="3"><c r="D3"><v>1</v></c><c r="H3" t="s"><v>0</v></c></row>'
                   '<row r="6"><c r="D6"><f>SUM(D3:D5)</f><v>2</v></c><c r="E6" s="1"/></row></sheetData></worksheet>')  # fmt: skip
    (tmp_path / "w.xlsx").write_bytes(raw.getvalue())
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    return str(tmp_path)


def test_workbooks(spark, book):
    cells = xlsx.read_cells(spark, book)
    cells = cells.where(F.col("workbook") == "w.xlsx")
    assert sheets.render(cells).first()["text"] == "D3: 1\nH3: D\n\nD6: =SUM(D3:D5) -> 2\nE6: null [bg:FFFF0000, bold]\n"
    assert workspace.files(spark, book).count() == 2

    def compare(position, output, styles=False):
        wanted = sheets.expand_ranges(spark.createDataFrame([("w.xlsx", position)], "workbook string, position string"), "position")
        return tuple(sheets.compare_cells(wanted, cells, output, styles).select("matches", "first_mismatch").first())

    other = cells.withColumn("value", F.when(F.col("ref") == "D6", "2.001").when(F.col("ref") == "H3", "E").otherwise(F.col("value")))
    assert compare("D3:H6", cells) == (True, None)
    assert compare("D6", other) == (True, None)
    assert compare("'Sheet1'!D3:H6", other) == (False, "H3")
    assert compare("Other!H3", other) == (False, None)  # neither has the sheet
    assert compare("A:A", cells)[0] is False
    assert compare("H6:D3", other) == (True, None)  # no cells
    first = cells.withColumn("sheet", F.lit("Another"))
    assert compare("D3", first) == (False, None)  # the truth's first sheet counts
    lost = spark.createDataFrame([("w.xlsx", "reason", "unreadable")], "workbook string, value string, value_type string")
    assert compare("A1", cells.where("false").unionByName(lost, allowMissingColumns=True))[0] is False
    nans = cells.withColumn("value", F.lit("nan"))
    wanted = sheets.expand_ranges(spark.createDataFrame([("w.xlsx", "D3")], "workbook string, position string"), "position")
    assert tuple(sheets.compare_cells(wanted, nans, nans).first())[1:3] == (False, "D3")
    plain = cells.withColumn("fill_fg", F.lit(None).cast("string"))
    assert compare("E6", plain) == (True, None) and compare("E6", plain, styles=True) == (False, "E6")
    back = cells.withColumn("fill_bg", F.lit("FF00FF00"))
    assert compare("E6", back) == (True, None) and compare("E6", back, styles=True) == (False, "E6")
    broken = xlsx.read_cells(spark, book).where(F.col("workbook") == "broken.xlsx").collect()
    assert [(r["value_type"], r["sheet"]) for r in broken] == [("unreadable", None)]


def test_workbooks_as_a_data_source(spark, book):
    """A partition for each sheet; filters on workbook and sheet choose partitions and leave the plan."""
    xlsx.register_source(spark)
    cells = spark.read.format("xlsx").load(book)
    assert sorted(map(str, cells.collect())) == sorted(map(str, xlsx.read_cells(spark, book).collect()))
    assert cells.rdd.getNumPartitions() == 2
    one = cells.where("workbook = 'w.xlsx' AND sheet IN ('Sheet1', 'Sheet2') AND row = 6").select("ref", "value")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.rdd.getNumPartitions() == 1 and {tuple(r) for r in one.collect()} == {("D6", "2"), ("E6", None)}
    assert "workbook" not in plan.split("Filter", 1)[1].split("\n")[0] and "row" in plan.split("Filter", 1)[1].split("\n")[0]
    assert cells.where("sheet = 'none'").count() == 0 and cells.where("workbook <> 'w.xlsx'").count() == 1
    few = spark.read.format("xlsx").schema("ref string, value string").load(book)
    assert few.columns == ["ref", "value"] and few.count() == cells.count()


@pytest.mark.parametrize(("spelled", "shown"), [("1E-3", "0.001"), ("10", "10"), ("10.0", "10.0"), ("1e2", "100.0"), ("-0.50", "-0.5"), ("1E+22", "1e+22")])
def test_numbers_of_cells_are_shown_as_python_shows_them(spelled, shown):
    assert xlsx._shown(spelled) == shown


def test_downloads(spark, tmp_path):
    rows = [("a", "x.txt", b"1"), ("a", "sub/y.bin", bytes(range(256))), ("b", "é x.txt", None)]
    files = spark.createDataFrame(rows, "rollout_id string, filename string, content binary")
    for folder in (f"file://{tmp_path}/u", f"{tmp_path}/p"):
        found = {(r["rollout_id"], r["filename"]): r["path"] for r in workspace.download(files, folder).collect()}
        for rollout, name, content in rows:
            with open(found[rollout, name], "rb") as f:
                assert f.read() == (content or b"")
    for bad in ("../z", "/etc/z", "..", "s/../../z"):
        with pytest.raises(Exception, match="no file name"):
            workspace.download(spark.createDataFrame([("a", bad, b"")], files.schema), f"{tmp_path}/u").collect()


def test_a_batch_written_again_is_there_once(spark, tmp_path):
    schema = "rollout_id string, message string"
    spark.createDataFrame([("a", f"m{i}") for i in range(70)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    run = lambda: workspace.track_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    run()
    for name in ("0", ".0.crc"):
        os.remove(tmp_path / "log" / "_checkpoint" / "commits" / name)  # lost between the write and its commit
    run()
    spark.createDataFrame([("b", "last")], schema).write.parquet(f"{tmp_path}/in/2")
    run()
    found = workspace.tracked(spark, f"{tmp_path}/log").collect()
    assert len(found) == 71 and {r["batch"] for r in found} == {0, 1} and len({r["message"] for r in found}) == 71
    assert len(list((tmp_path / "log" / "batch=0").glob("part-*.parquet"))) == 3  # 30 rows a file


def test_rounding_dates_and_times(spark):
    def cell(value, kind):
        return spark.createDataFrame([("w", "S", 0, 1, 1, "A1", value, kind)], "workbook string, sheet string, sheet_idx int, row int, col int, ref string, value string, value_type string")

    wanted = sheets.expand_ranges(spark.createDataFrame([("w", "A1")], "workbook string, position string"), "position")
    cases = [
        (("2.674", "number"), ("2.67", "string"), True), (("2.675", "number"), ("2.68", "number"), False), (("1.005", "number"), ("1.0", "string"), True),
        (("45000.4", "date"), ("45000", "number"), True), (("45000.6", "date"), ("45000", "date"), False), (("0.5", "time"), ("12:00", "string"), True),
        (("0.5003472222", "time"), ("0.5", "time"), True), (("0.51", "time"), ("0.5", "time"), False), (("1", "boolean"), ("1.0", "number"), True),
        ((None, None), ("", "string"), False), (("a", "string"), ("A", "string"), False), (("inf", "string"), ("inf", "string"), True),
    ]
    for a, b, same in cases:
        assert sheets.compare_cells(wanted, cell(*a), cell(*b)).first()["matches"] is same, (a, b)
    shown = sheets.render_books(cell("45000.5", "date").unionByName(cell("0.25", "time").withColumns({"col": F.lit(2), "ref": F.lit("B1")}))
                                .withColumns({**{c: F.lit(None).cast("string") for c in ("formula", "fill_fg", "font_rgb")}, **{c: F.lit(False) for c in ("bold", "italic", "underline")}}))
    assert shown.first()["text"] == "Sheet Name: S\nA1: 2023-03-15 12:00:00\nB1: 06:00:00\n"


def test_columns(spark):
    names = ["A", "Z", "AA", "AZ", "ZZ", "AAA", "XFD"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    number = sheets.column_number(F.col("n"))
    assert [tuple(r) for r in rows.select(number, sheets.column_letters(number)).collect()] == list(zip([1, 26, 27, 52, 702, 703, 16384], names, strict=True))


def test_rollouts(spark):
    log = spark.createDataFrame(
        [(1, 1, "define_variable", "x", 1.0), (1, 2, "define_variable", "x", 2.0), (1, 3, None, None, None), (1, 4, "define_variable", "x", 9.0),
         (2, 1, "evaluate", None, None), (2, 2, "error", None, None), (3, 1, "evaluate", None, None)],
        "rollout_id int, seq int, tool string, name string, value double",
    )
    assert {r[0]: (r[1], r[2]) for r in rollouts.outcomes(log).collect()} == {1: (3, "done"), 2: (2, "failed"), 3: (1, "open")}
    assert {r[0]: (r[1], r[2]) for r in rollouts.outcomes(log, max_turns=2).collect()}[1] == (2, "cut")
    assert [tuple(r) for r in rollouts.variables(log).collect()] == [(1, "x", 2.0)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame(
        [(datetime(2024, 1, 1, h % 24, h), "ab"[h % 2], float(h)) for h in range(40)], "ts timestamp_ntz, event_type string, value double"
    )
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.run_to_end(streams.windowed_counts(stream, late="60 days"), ["window_start", "event_type"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.windowed_counts(rows).collect()))


def failing(completion, **_):
    raise RuntimeError(completion)


async def slow_length(completion, ground_truth, note):
    return len(completion) + len(note)


def test_rewards_by_name(spark):
    rows = spark.createDataFrame([("abc", "abc", "n"), (None, "x", "nn")], "completion string, ground_truth string, note string")
    found = rewards.call_rewards(rows, {"fails": failing, "length": slow_length, "same": lambda completion, ground_truth, **_: completion == ground_truth}, extras=("note",))
    got = [(r["rewards"]["length"], r["rewards"]["same"], math.isnan(r["rewards"]["fails"]), math.isnan(r["total_reward"])) for r in found.collect()]
    assert got == [(4.0, 1.0, True, True), (2.0, 0.0, True, True)]
    with pytest.raises(TypeError):
        rewards.named_rewards("rolloutframe.operators.rewards", "NAN")


def test_rewards_over_state_files_and_groups(spark):
    asked = spark.createDataFrame([(1, "x", 2.0), (2, "x", 2.0), (3, "", 1.0), (4, "x", None)], "rollout_id int, name string, expected double")
    held = spark.createDataFrame([(1, "x", 2.0), (2, "x", 3.0), (3, "", 1.0), (4, "x", None)], "rollout_id int, name string, value double")
    assert {r["rollout_id"]: r["reward"] for r in rewards.variable_reward(asked, held).collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    wanted = spark.createDataFrame([(1, "a", " hi\n"), (2, "a", "hi"), (3, "b", None), (4, "a", "hi")], "rollout_id int, filename string, expected string")
    files = spark.createDataFrame([(1, "a", b"hi"), (2, "a", b"ho"), (3, "b", b" "), (5, "a", b"hi")], "rollout_id int, filename string, content binary")
    assert {r["rollout_id"]: r["reward"] for r in rewards.log_reward(wanted, files).collect()} == {1: 1.0, 2: 0.0, 3: 1.0, 4: 0.0}
    rows = spark.createDataFrame([("g", 1, "a", "t"), ("g", 2, "abc", "t"), ("h", 3, "b", "t")], "g string, rollout_id int, completion string, ground_truth string")
    best = rewards.group_rewards(rows, "g", lambda rollout_ids, completions, ground_truths: [{"best": c == max(completions, key=len)} for c in completions])
    assert {r["rollout_id"]: r["rewards"] for r in best.collect()} == {1: {"best": 0.0}, 2: {"best": 1.0}, 3: {"best": 1.0}}
    assert {tuple(r["rewards"]) for r in rewards.group_rewards(rows, "g").collect()} == {()}


def test_groups_share_a_batch(spark):
    """Many groups meet in one call of Python, and each is given alone, in order of its rollouts; a NaN stays one."""
    rows = spark.createDataFrame([(i % 50 or None, i, str(i), None) for i in range(200)], "g int, rollout_id int, completion string, ground_truth string")
    pids = lambda rollout_ids, completions, ground_truths: [{"at": i, "nan": float('nan')} for i, r in enumerate(rollout_ids) if completions[i] == str(r)]
    found = rewards.group_rewards(rows.coalesce(1), "g", pids).collect()
    at = {r["rollout_id"]: (r["g"], r["rewards"]["at"], math.isnan(r["rewards"]["nan"])) for r in found}
    assert at == {i: (i % 50 or None, i // 50, True) for i in range(200)}
    assert not any("FlatMapGroupsInPandas" in f._jdf.queryExecution().toString() for f in (rewards.group_rewards(rows, "g", pids), rewards.group_rewards(rows, "g")))


def test_steps_of_raw_turns(spark):
    call = "<tool_call>{}</tool_call>".format
    turns = spark.createDataFrame(
        [(1, 1, call('{"name": "f"}') + call('{"name": "g"}'), "a" * 12, 5.0), (1, 2, call("[1]"), None, 5.0), (1, 3, "the end", None, 5.0), (1, 4, call('{"name": "f"}'), "x", 5.0),
         (2, 1, call('{"name": "f"}'), None, 1.0), (2, 2, "late", None, 1.0), (3, 1, call('{"name": "f"}'), "r", 1.0)],
        "rollout_id int, turn int, action string, result string, reward double",
    )
    stepped = rollouts.steps(turns, max_chars=10)
    got = {(r["rollout_id"], r["turn"]): (r["name"], r["observation"], r["reward"], r["done"]) for r in stepped.collect()}
    assert got == {
        (1, 1): ("f", "a" * 10 + "...", 0.0, False), (1, 2): (None, toolcalls.NOT_AN_OBJECT, 0.0, False), (1, 3): (None, None, 5.0, True),
        (2, 1): ("f", None, 0.0, True), (3, 1): ("f", "r", 0.0, False),
    }
    talk = {r["rollout_id"]: ([m["role"] for m in r["messages"]], r["total_reward"]) for r in rollouts.histories(stepped).collect()}
    assert talk[1] == (["assistant", "user", "assistant", "user", "assistant"], 5.0) and talk[2] == (["assistant"], 0.0)


def test_workspace_files(spark, tmp_path):
    rows = spark.createDataFrame([("r", "a.txt", "hé"), ("s", "a.txt", None)], "rollout_id string, filename string, text string")
    found = workspace.download(workspace.text_content(rows), str(tmp_path / "w")).collect()
    assert len(found) == 2 and (tmp_path / "w" / "r" / "a.txt").read_bytes() == "hé".encode()
    outside = spark.createDataFrame([("r", "../../x", b"1")], "rollout_id string, filename string, content binary")
    assert workspace.text_content(outside, "content").first()["content"] == b"1"
    with pytest.raises(Exception, match="no file name"):
        workspace.download(outside, str(tmp_path / "w")).collect()


def test_files_are_listed_by_tasks(spark, tmp_path):
    """Files of several folders and depths, without a Spark file index, which would hold them all in the driver."""
    expected = {("b", "y", b"2"), (tmp_path.name, "x", b"1"), ("c", "z", b"")} | {("d", f"{i}", b"%d" % i) for i in range(2500)}
    for rollout, name, content in sorted(expected):
        folder = {"c": tmp_path / "b" / "c", tmp_path.name: tmp_path}.get(rollout, tmp_path / rollout)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    found = workspace.files(spark, str(tmp_path))
    assert {(r[0], r[1], bytes(r[2])) for r in found.collect()} == expected and found.count() == len(expected)
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()


def test_contents_of_files_are_not_broadcast(spark):
    """However small Spark takes them to be: their sizes are guesses."""
    from rolloutframe.operators import workbooks

    each = spark.createDataFrame([("a", 1, "in", "A1")], "rollout_id string, id int, input string, position string")
    files = spark.createDataFrame([("in", b"x")], "path string, content binary")
    begun = workbooks.start(each, files)
    assert [tuple(r) for r in begun.collect()] == [("a", "1_1_input.xlsx", b"x", None)]
    assert "Broadcast" not in begun._jdf.queryExecution().executedPlan().toString()


def test_datasets_of_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"id": 7, "x": "a"}, {"id": 8, "x": "b"}], indent=2))
    assert sorted(tuple(r) for r in tables.load_dataset(spark, str(tmp_path / "d.json"), "json").select("id", "x").collect()) == [("7", "a"), ("8", "b")]
    rows = {n: spark.range(i, i + 5).withColumnRenamed("id", "k") for n, i in (("train", 0), ("test", 5))}
    assert {r["k"] for r in datasets.train_and_test(rows, "k").where("split = 'test'").collect()} == {5, 6, 7, 8, 9}
    again = datasets.train_and_test({"a": rows["train"], "b": rows["test"]}, "k").collect()
    assert sorted(r["k"] for r in again) == list(range(10)) and sum(r["split"] == "test" for r in again) == 2


def test_late_rows_are_lost(spark, tmp_path):
    """A row behind the watermark of earlier batches does not count; one within it does."""
    schema = "ts timestamp_ntz, event_type string, value double"
    for n, day in enumerate((1, 20, 21, 2)):
        spark.createDataFrame([(datetime(2024, 1, day), "a", 1.0)], schema).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    paths = [str(next((tmp_path / f"in{n}").glob("*.parquet"))) for n in range(4)]
    (tmp_path / "all").mkdir()
    for n, path in enumerate(paths):
        target = tmp_path / "all" / f"{n}.parquet"
        target.write_bytes(open(path, "rb").read())
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    def counted(late):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
        return streams.run_to_end(streams.windowed_counts(stream, late=late), ["window_start", "event_type"]).count()

    assert counted("60 days") == 4 and counted("1 day") == 3


def test_environment(spark):
    call = '<tool_call>{"name": "%s", "arguments": {"n": 2}}</tool_call>'
    env = Environment({"twice": Tool(lambda a: F.get_json_object(a, "$.n").cast("int") * 2), "never": Tool(lambda a: F.lit(None).cast("string"))},
                      {"same": rewards.text_match}, "Hi", required=("path",))
    turns = spark.createDataFrame(
        [(1, 1, call % "twice", "x", "p"), (1, 2, call % "never", "x", "p"), (1, 3, "<answer>X</answer>", "x", "p"), (1, 4, "late", "x", "p"), (2, 1, "<answer>x</answer>", "x", None), (3, 1, call % "twice", "x", None), (3, 2, "late", "x", None)],
        "rollout_id int, turn int, action string, truth string, path string",
    )
    got = {(r["rollout_id"], r["turn"]): (r["observation"], r["reward"], r["done"]) for r in env.play(turns).collect()}
    assert got[1, 1] == ("4", 0.0, False) and got[1, 2] == ("Error: never failed.", 0.0, False) and got[1, 3] == (None, 1.0, True)
    assert got[2, 1] == (None, 0.0, True) and got[3, 1] == (None, 0.0, True) and len(got) == 5
    assert [r["name"] for r in env.catalogue(spark).collect()] == ["never", "twice"] and env.prompt().startswith("Hi\n\n# Tools")
    with pytest.raises(NotImplementedError):
        env.workspace(turns)
