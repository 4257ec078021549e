"""Scalars against Python's own, with hypothesis and fixed cases."""

from __future__ import annotations

import html
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolloutframe.functions import calendar, exact, text


def column(spark, values, function, kind="string"):
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r["y"] for r in frame.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def python_float(value):
    try:
        return float(value)
    except ValueError:
        return None


def test_number_reads_what_float_reads(spark):
    values = ["4", " 4.50 ", "1_000", "1__0", "1d", "-.5", "5.", ".", "", "1e3", "1e", "inf", "-Infinity", "+inf", "0x10", "١", "1_000.5_1", "\t7\n"]
    expected = [python_float(v) if v != "١" else None for v in values]
    assert column(spark, values, text.number) == expected
    assert str(column(spark, ["nan"], text.number)) == "[nan]"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=30, max_size=60))
def test_rounding(spark, values):
    values = [2.675, 0.125, 2.5, -2.5, *values]
    assert column(spark, values, lambda x: exact.py_round(x, F.lit(2)), "double") == [round(v, 2) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab&;#x1lt gamp<>é", max_size=20), min_size=10, max_size=40))
def test_unescape(spark, values):
    assert column(spark, values, text.unescape) == [html.unescape(v) for v in values]


def test_clean_html_replaces_closed_entities(spark):
    values = ["<p>a &amp; b</p>&copy;&#39;&#x41;", "the&&amp;&ampp{margin:0}", "&am</p>p;&nope;&amp", "&", "", None, "x&lt;y&amp;lt;"]
    expected = ["a & b©'A", "the&&&ampp{margin:0}", "&amp;&nope;&amp".replace("&amp;", "&"), "&", "", None, "x<y&lt;"]
    assert column(spark, values, text.clean_html) == expected


def test_evaluate_by_expression(spark):
    """As Python has it row by row: several expressions, missing and null names, zeros, whole numbers without bounds."""
    texts = ["(q + 2) * 3 - q / t", "q", "-t / 0", "7 / 2", "2 ** q", "z + 1", "1" + "0" * 400 + " * q", "q / (t - t)", "10000000000000001 - 10000000000000000", "q +", "1 / 0", None]
    maps = [{"q": 1.5, "t": 0.5}, {"q": -2.0, "t": 0.0}, {"q": None, "t": 1.0}, {}, None, {"t": 4.0, "q": 7.0}]
    rows = [(i, e, m) for i, (e, m) in enumerate((e, m) for e in texts for m in maps)]
    frame = spark.createDataFrame(rows, "i int, e string, m map<string,double>").coalesce(1)
    found = {r["i"]: r["v"] for r in frame.select("i", exact.evaluate(F.col("e"), F.col("m")).alias("v")).collect()}
    expected = {i: None if e is None else exact.arithmetic(e, {k: v for k, v in (m or {}).items() if v is not None}) for i, e, m in rows}
    assert found == expected and found[0] == (1.5 + 2) * 3 - 1.5 / 0.5 and found[48] == 1.0


def test_noon_in_serial_days(spark):
    noons = [datetime(2024, 1, d, h, 0, 0, u) for d, h, u in ((1, 12, 0), (2, 12, 0), (2, 12, 400_000), (2, 11, 999_999), (3, 0, 0))]
    assert column(spark, noons, lambda x: calendar.serial_days(x, noon_up=True), "timestamp_ntz") == [45293.0, 45294.0, 45294.0, 45293.0, 45294.0]
    assert column(spark, noons, calendar.serial_days, "timestamp_ntz") == [45292.0, 45294.0, 45294.0, 45293.0, 45294.0]


def test_answers(spark):
    values = ["<answer> 4 </answer>", "x <ANSWER>\nA\nB</Answer> <answer>no</answer>", "none", None, "<answer>rock &amp; Roll</answer>"]
    assert column(spark, values, text.answer) == ["4", "a\nb", "", "", "rock & roll"]


def test_tokens(spark):
    values = ['"Apple, banana|Cherry\tapple"', "  ", "'x;y'"]
    assert column(spark, values, text.tokens) == [["apple", "banana", "cherry"], [], ["x;y"]]


def test_normalized(spark):
    assert column(spark, ["The cat_sat, on  a MAT!", "theory an"], text.normalized) == ["cat sat on mat", "theory"]


def test_truncated(spark):
    assert column(spark, ["abcdef", "abc", None], lambda x: text.truncated(x, 3)) == ["abc...", "abc", None]


def test_arithmetic():
    assert exact.arithmetic("(x + 2) * 3", {"x": 1.5}) == 10.5
    assert exact.arithmetic("-4 / 2", {}) == -2
    for bad in ("__import__('os')", "x", "1 / 0", "2 **", "x.y", "True", "9 ** 9"):
        assert exact.arithmetic(bad, {}) is None


def test_periods():
    assert calendar.period("March", 2023) == (date(2023, 3, 1), date(2023, 4, 1))
    assert calendar.period("Q2", 2023) == (date(2023, 4, 1), date(2023, 7, 1))
    assert calendar.period("Summer", 2023) == (date(2023, 6, 1), date(2023, 9, 1))
    assert calendar.period("Winter", 2023) == (date(2023, 12, 1), date(2024, 3, 1))
    with pytest.raises(ValueError):
        calendar.period("Q5", 2023)


@pytest.mark.parametrize(
    ("end", "unit", "n", "expected"),
    [("2023-12-31", "day", 7, "2023-12-24"), ("2023-12-31", "week", 2, "2023-12-17"), ("2023-12-31", "quarter", 1, "2023-09-30"),
     ("2024-01-31", "month", 1, "2023-12-31"), ("2024-03-31", "month", 1, "2024-02-29"), ("2024-03-31", "day", 0, "2024-03-31")],
)
def test_start_dates(spark, end, unit, n, expected):
    frame = spark.createDataFrame([(datetime.fromisoformat(end),)], "d timestamp_ntz")
    assert frame.select(calendar.start_date(F.col("d"), unit, n).alias("s")).first()["s"] == datetime.fromisoformat(expected)


def test_start_date_rejects_bad_intervals():
    with pytest.raises(ValueError):
        calendar.start_date(None, "year", 1)
    with pytest.raises(ValueError):
        calendar.start_date(None, "day", -1)
