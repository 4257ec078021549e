"""Ranges, comparison and rendering of spreadsheet cells.

Cells are rows of (workbook, sheet, sheet_idx, row, col, ref, value, ...). A row
without ``row`` says that its sheet is there, though it may have no cells; one
of the type ``unreadable`` says that its workbook could not be read. A workbook
is one file, so its cells fit a task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import SERIAL_START, clock_text
from ..functions.exact import equal_when_rounded
from ..functions.text import number

# Fills that count as white, and the colour of a cell without a fill.
WHITE_FILLS = ("00000000", "FFFFFFFF", "FFFFFF00")
NO_FILL = "00000000"
UNREADABLE = "unreadable"
BLOCK_ROWS = 64  # of a sheet, by which ranges meet cells


def column_number(letters: Column) -> Column:
    """A is 1, Z is 26, AA is 27."""
    def digit(i: int) -> Column:
        return F.ascii(F.substring(F.upper(letters), i, 1)) - 64

    n, two = F.length(letters), digit(1) * 26 + digit(2)
    any_length = F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))
    return F.when(n == 1, digit(1)).when(n == 2, two).when(n == 3, two * 26 + digit(3)).otherwise(any_length)


def column_letters(n: Column) -> Column:
    """The inverse, for up to three letters."""
    def letter(x: Column) -> Column:
        return F.char(x + 65)

    one, two, three = n - 1, F.floor((n - 27) / 26), F.floor((n - 703) / 676)
    return F.concat(
        F.when(n > 702, letter(three % 26)).otherwise(""), F.when(n > 26, letter(two % 26)).otherwise(""), letter(one % 26)
    )


def split_ranges(rows: DataFrame, position: str) -> DataFrame:
    """``rows``, one for each of the comma-separated ranges: sheet (null: the first), low, high, left, right, part, state.

    ``state`` is ``cell``, ``bad`` for a malformed range, and ``none`` for one that ends before it starts.
    """
    pattern = r"^(?:'?([^'!]+)'?!)?([A-Za-z]+)(\d+)(?::([A-Za-z]+)(\d+))?$"
    each = rows.select(*rows.columns, F.posexplode(F.split(F.col(position), ",")).alias("part", "_range"))
    # matched once: no part holds a "!", so what is no range stays as it is; each step is a projection of its own, so that nothing is counted twice
    each = each.withColumn("_found", F.regexp_replace("_range", pattern, "$1!$2!$3!$4!$5"))
    each = each.withColumn("_parts", F.when(F.col("_found") != F.col("_range"), F.split("_found", "!")))
    each = each.withColumns({f"_p{i}": F.coalesce(F.get("_parts", F.lit(i - 1)), F.lit("")) for i in range(1, 6)})
    each = each.withColumns({
        "low": F.col("_p3").try_cast("int"), "high": F.when(F.col("_p5") == "", F.col("_p3")).otherwise(F.col("_p5")).try_cast("int"),
        "left": column_number(F.col("_p2")), "right": column_number(F.when(F.col("_p4") == "", F.col("_p2")).otherwise(F.col("_p4"))),
    })
    low, high, left, right = (F.col(c) for c in ("low", "high", "left", "right"))
    ok = F.col("_p3") != ""  # the one part that every range has
    some = ok & (low <= high) & (left <= right)
    state = F.when(some, "cell").when(ok & low.isNotNull() & high.isNotNull(), "none").otherwise("bad")
    return each.select(*rows.columns, F.when(F.col("_p1") != "", F.col("_p1")).alias("sheet"), low, high, left, right, "part", state.alias("state"))


def expand_ranges(rows: DataFrame, position: str) -> DataFrame:
    """``rows``, one for each cell of the comma-separated ranges: sheet (null: the first), row, col, ord, state.

    Cells run down each column. ``state`` is ``cell``; a malformed range and one
    that ends before it starts give one row without a cell, ``bad`` and ``none``.
    """
    def span(a: str, b: str) -> Column:
        return F.when(F.col("state") == "cell", F.sequence(a, F.greatest(a, b)))

    each = split_ranges(rows, position)
    columns = each.select(*rows.columns, "part", "sheet", span("low", "high").alias("_rows"), "state", F.explode_outer(span("left", "right")).alias("col"))
    cells = columns.select(*rows.columns, "part", "sheet", "col", F.explode_outer("_rows").alias("row"), "state")
    return cells.select(*rows.columns, "sheet", "row", "col", F.struct("part", "col", "row").alias("ord"), "state")


def time_text(serial: Column) -> Column:
    """A fraction of a day as Python shows a time: microseconds only where there are any."""
    millis = F.rint(serial % 1 * 86_400_000).cast("long")
    clock = F.date_format(F.timestamp_millis(millis), "HH:mm:ss")
    return F.when(millis % 1000 == 0, clock).otherwise(F.concat(clock, F.date_format(F.timestamp_millis(millis), ".SSSSSS")))


def date_text(serial: Column) -> Column:
    """A serial date as Python shows a datetime."""
    millis = F.unix_millis(F.lit(SERIAL_START).cast("timestamp")) + F.rint(serial * 86_400_000).cast("long")
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss")


def _number(raw: Column, kind: Column) -> Column:
    """The number that a cell compares by, from its value as one: whole days of a date, null for times and other texts."""
    return F.when(kind == "date", F.rint(raw)).when(kind == "time", F.lit(None)).otherwise(raw)


def _text(value: Column, raw: Column, kind: Column) -> Column:
    """The text that a cell compares by where it is no number: hours and minutes of a time."""
    return F.when(kind == "time", clock_text(time_text(raw))).otherwise(value)


def _sheets(truth: DataFrame, output: DataFrame) -> DataFrame:
    """(workbook, sheet, in_t, in_o, first, unread) of every sheet on either side; first: of the truth."""
    def marks(cells: DataFrame, own: bool) -> DataFrame:
        """One number of bits for each cell, which is far cheaper to unite than a column for each."""
        unread = F.when(F.col("value_type") == UNREADABLE, 8).otherwise(0)
        first = F.when(F.col("sheet_idx") == 0, 4).otherwise(0) if own else F.lit(0)
        return cells.select("workbook", "sheet", (F.lit(1 if own else 2) + first + unread).alias("marks"))

    both = marks(truth, True).unionByName(marks(output, False)).groupBy("workbook", "sheet").agg(F.bit_or("marks").alias("marks"))
    names = {1: "in_t", 2: "in_o", 4: "first", 8: "unread"}
    return both.select("workbook", "sheet", *[(F.col("marks").bitwiseAND(bit) != 0).alias(name) for bit, name in names.items()])


def _asked(wanted: DataFrame, sheets: DataFrame) -> DataFrame:
    """``wanted`` with the sheets that ranges without one mean, and which sides have them."""
    known = F.struct("sheet", "in_t", "in_o")
    books = sheets.groupBy("workbook").agg(
        F.max(F.when(F.col("first"), F.col("sheet"))).alias("_first"), F.max("unread").alias("unread"), F.collect_list(known).alias("_known")
    )
    named = wanted.join(books, "workbook", "left").withColumn("sheet", F.coalesce("sheet", "_first"))
    own = F.get(F.filter("_known", lambda x: x["sheet"] == F.col("sheet")), F.lit(0))
    sides = named.withColumn("_own", own).withColumns({"in_t": F.col("_own.in_t"), "in_o": F.col("_own.in_o")})
    return sides.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("unread", "in_t", "in_o")}).drop("_first", "_known", "_own")


def _differing(truth: DataFrame, output: DataFrame, most: DataFrame, styles: bool) -> DataFrame:
    """(workbook, sheet, _row, _col, ref, a, b, close, unequal, differs) of the cells that may not be equal.

    ``differs`` says what does; where it is null, rounding tells whether ``unequal`` is said (``close``).

    ``most`` has one row, the last row and column of any range: cells beyond are in none and stay where they are.
    """
    shown = ["value", "value_type", *(["fill_fg", "fill_bg", "font_rgb"] if styles else [])]
    keys = ["workbook", "sheet", "row", "col"]

    def side(cells: DataFrame, name: str) -> DataFrame:
        near = cells.where((F.col("row") <= most.select("row").scalar()) & (F.col("col") <= most.select("col").scalar()))
        return near.select(*keys, F.struct(*shown).alias(name))

    pairs = side(truth, "t").join(side(output, "o"), keys, "full")
    fill, font = F.lit(True), F.lit(True)
    if styles:
        for c in ("fill_fg", "fill_bg"):
            fill = fill & F.coalesce(f"t.{c}", F.lit(NO_FILL)).eqNullSafe(F.coalesce(f"o.{c}", F.lit(NO_FILL)))
        font = F.col("t.font_rgb").eqNullSafe(F.col("o.font_rgb"))
    # cells of the same text need no number, but for NaN, which equals nothing; each column is computed once
    pairs = pairs.withColumns({"same": F.col("t.value").eqNullSafe(F.col("o.value")) & F.col("t.value_type").eqNullSafe(F.col("o.value_type")), "fill": fill, "font": font})
    pairs = pairs.where(~(F.col("same") & F.col("fill") & F.col("font")) | F.lower("t.value").contains("nan"))
    differs = {x: F.when(~F.col("same") | F.lower(f"{x}.value").contains("nan"), F.col(f"{x}.value")) for x in ("t", "o")}
    pairs = pairs.withColumns({f"raw_{x}": number(v) for x, v in differs.items()})
    pairs = pairs.withColumns({
        name: made for name, x in (("a", "t"), ("b", "o"))
        for name, made in ((name, _number(F.col(f"raw_{x}"), F.col(f"{x}.value_type"))), (f"text_{name}", _text(F.col(f"{x}.value"), F.col(f"raw_{x}"), F.col(f"{x}.value_type"))))
    })
    nan = F.coalesce(F.isnan("a") | F.isnan("b"), F.lit(False))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    neither = F.col("a").isNull() & F.col("b").isNull()
    alike = F.when(nan, False).when(F.col("same"), True).when(both, F.col("a") == F.col("b")).when(neither, F.col("text_a").eqNullSafe(F.col("text_b")))
    pairs = pairs.withColumn("alike", F.coalesce(alike, F.lit(False)))
    close = both & ~nan & ~F.col("alike") & (F.abs(F.col("a") - F.col("b")) <= 0.011)  # rounding alone can tell
    pairs = pairs.where(~(F.col("alike") & F.col("fill") & F.col("font"))).withColumn("close", F.coalesce(close, F.lit(False)))
    pairs = pairs.withColumn("ref", F.concat(column_letters(F.col("col")), F.col("row").cast("string")))
    unequal = F.concat(F.lit("Value mismatch at "), "ref", F.lit(": expected "), F.coalesce("t.value", F.lit("None")), F.lit(", got "), F.coalesce("o.value", F.lit("None")))
    message = (
        F.when(~F.col("alike") & ~F.col("close"), unequal)
        .when(~F.col("fill"), F.concat(F.lit("Fill color mismatch at "), "ref"))
        .when(~F.col("font"), F.concat(F.lit("Font color mismatch at "), "ref"))
    )
    return pairs.select("workbook", "sheet", F.col("row").alias("_row"), F.col("col").alias("_col"), "ref", "a", "b", "close", unequal.alias("unequal"), message.alias("differs"))


def compare_cells(wanted: DataFrame, truth: DataFrame, output: DataFrame, styles: bool = False, by: tuple[str, ...] = ("workbook",)) -> DataFrame:
    """(*by, matches, first_mismatch, message) for the cells ``wanted`` (workbook, sheet, *by, ...).

    ``wanted`` has the ranges of ``split_ranges``, which are never expanded, or the
    cells of ``expand_ranges``. ``by`` names what is judged: all ranges of a
    workbook together, or those of each example. Numbers, also as text, are equal
    when they are rounded to two places; dates are their whole days, times their
    hours and minutes; a missing cell equals an empty one. A range without a sheet
    means the truth's first one. Nothing matches in a sheet that either side lacks,
    a malformed range, or a workbook that could not be read. ``styles`` also
    compares fills and font colours.

    The sides' cells meet once, without those past the last row and column of all
    ranges; only cells that may differ meet ranges, by blocks of rows, and then
    ``by``. Rounding, which is Python's own, sees one row for each, with the few
    numbers that it decides. Both sides are read twice, the second time for their
    sheets: write first what is costly to parse.
    """
    ranged = "low" in wanted.columns
    valid = F.col("state") == "cell"
    last = {"row": F.col("high" if ranged else "row"), "col": F.col("right" if ranged else "col")}
    most = wanted.agg(*[F.max(F.when(valid, v)).alias(k) for k, v in last.items()])
    found = _differing(truth, output, most, styles)
    asked = _asked(wanted, _sheets(truth, output))
    if ranged:
        blocks = F.when(valid, F.sequence(F.expr(f"low div {BLOCK_ROWS}"), F.expr(f"greatest(low, high) div {BLOCK_ROWS}")))
        asked = asked.select("*", F.struct("part", F.col("left").alias("col"), F.col("low").alias("row")).alias("ord"), F.explode_outer(blocks).alias("_block"))
        found = found.withColumn("_block", F.expr(f"_row div {BLOCK_ROWS}"))
        within = (asked["_block"] == found["_block"]) & F.col("_row").between(F.col("low"), F.col("high")) & F.col("_col").between(F.col("left"), F.col("right"))
        ord_ = F.when(F.col("_row").isNotNull(), F.struct("part", F.col("_col").alias("col"), F.col("_row").alias("row"))).otherwise(F.col("ord"))
    else:
        within, ord_ = (F.col("row") == F.col("_row")) & (F.col("col") == F.col("_col")), F.col("ord")
    met = asked.join(found, (asked["workbook"] == found["workbook"]) & (asked["sheet"] == found["sheet"]) & within, "left").drop(found["workbook"], found["sheet"])
    message = (
        F.when(F.col("unread"), "A workbook could not be read.")
        .when(F.col("state") == "bad", "A range is malformed.")
        .when(~F.col("in_o"), F.concat(F.lit("Worksheet '"), F.coalesce("sheet", F.lit("")), F.lit("' not found in output workbook.")))
        .when(~F.col("in_t"), F.concat(F.lit("Worksheet '"), F.coalesce("sheet", F.lit("")), F.lit("' not found.")))
        .when(F.col("state") == "none", F.lit(None))
        .otherwise(F.col("differs"))
    )
    ref = F.when(valid & F.col("in_o") & F.col("in_t") & ~F.col("unread"), F.col("ref"))
    # messages are made before, with the few cells that differ: a longer step here is too long for the JVM to compile
    met = met.withColumns({"message": message, "close": F.coalesce("close", F.lit(False))}).where(F.col("close") | F.col("message").isNotNull())
    judged = met.select(*by, ord_.alias("ord"), ref.alias("ref"), "message", "a", "b", "close", "unequal")
    failed = F.when(F.col("message").isNotNull(), F.struct("ord", "ref", "message"))
    unsure = F.when(F.col("close") & F.col("message").isNull(), F.struct("ord", "ref", F.col("unequal").alias("message"), "a", "b"))
    found = judged.groupBy(*by).agg(F.min(failed).alias("failed"), F.array_sort(F.collect_list(unsure)).alias("unsure"))
    found = found.withColumn("same", equal_when_rounded(F.col("unsure.a"), F.col("unsure.b")))
    open_ = F.filter(F.arrays_zip("unsure", "same"), lambda x: ~x["same"])
    late = F.get(open_, F.lit(0))["unsure"]
    worst = F.least("failed", F.when(late.isNotNull(), F.struct(late["ord"].alias("ord"), late["ref"].alias("ref"), late["message"].alias("message"))))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in by], worst.alias("worst"))
    judgements = wanted.select(*by).distinct().join(found, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]), "left")
    return judgements.select(
        *by, F.col("worst").isNull().alias("matches"), F.col("worst.ref").alias("first_mismatch"), F.coalesce("worst.message", F.lit("All comparisons passed.")).alias("message")
    )


def render(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, sheet_idx, text): a line a cell, a blank line after each row that shows any.

    Values that are empty, 0 or FALSE are left out, formulas show their result,
    and an empty cell shows only where it is filled.
    """
    filled = F.coalesce(F.col("fill_fg").isNotNull() & ~F.col("fill_fg").isin(*WHITE_FILLS), F.lit(False))
    marks = F.filter(
        F.array(
            F.when(filled, F.concat(F.lit("bg:"), "fill_fg")), F.concat(F.lit("color:"), "font_rgb"),
            *[F.when(F.col(k), F.lit(k)) for k in ("bold", "italic", "underline")],
        ),
        lambda x: x.isNotNull(),
    )
    style = F.when(F.size(marks) > 0, F.concat(F.lit(" ["), F.array_join(marks, ", "), F.lit("]"))).otherwise("")
    falsy = F.col("value").isNull() | (F.col("value") == "") | (
        F.col("value_type").isin("number", "boolean") & F.coalesce(number(F.col("value")) == 0, F.lit(False))
    )
    value = (
        F.when(F.col("value_type") == "date", date_text(number(F.col("value"))))
        .when(F.col("value_type") == "time", time_text(number(F.col("value"))))
        .when(F.col("value_type") == "boolean", F.when(F.col("value") == "1", "True").otherwise("False"))
        .otherwise(F.col("value"))
    )
    shown = (
        F.when(F.col("formula").isNotNull(), F.concat("formula", F.lit(" -> "), F.coalesce(value, F.lit("None"))))
        .when(F.col("value").isNull() & filled, F.lit("null"))
        .when(~falsy, value)
    )
    lines = cells.select(
        "workbook", "sheet", "sheet_idx", "row", "col", F.concat("ref", F.lit(": "), shown, style).alias("line")
    ).where(F.col("line").isNotNull())
    keys = ["workbook", "sheet", "sheet_idx"]
    # each step is a projection of its own, so that cells are sorted once
    cells = lines.groupBy(*keys).agg(F.collect_list(F.struct("row", "col", "line")).alias("_found"))
    cells = cells.select(*keys, F.array_sort("_found").alias("_cells"))
    cells = cells.select(*keys, "_cells", F.concat(F.slice("_cells", 1, 1), F.slice("_cells", F.lit(1), F.size("_cells") - 1)).alias("_before"))
    shown = F.zip_with("_cells", "_before", lambda x, y: F.when(x["row"] == y["row"], x["line"]).otherwise(F.concat(F.lit("\n"), x["line"])))
    return cells.select(*keys, F.concat(F.array_join(shown, "\n"), F.lit("\n")).alias("text"))


def render_books(cells: DataFrame) -> DataFrame:
    """(workbook, text): each sheet's name on a line, its cells below; a sheet without cells is its name."""
    named = cells.where(F.col("sheet").isNotNull()).select("workbook", "sheet", "sheet_idx").distinct()
    keys = ["workbook", "sheet", "sheet_idx"]
    parts = named.join(render(cells.where(F.col("row").isNotNull())), keys, "left")
    text = F.concat_ws("\n", F.concat(F.lit("Sheet Name: "), "sheet"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("sheet_idx", text.alias("text"))))
    return parts.groupBy("workbook").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def spreadsheet_reward(examples: DataFrame, truth: DataFrame, output: DataFrame) -> DataFrame:
    """``examples`` (workbook, position, ...) with ``reward``: 1 where the output's cells at the position match, 0 otherwise.

    Each example is judged on its own, also where several ask about one workbook;
    a null workbook or position is 0.
    """
    key = ["workbook", "position"]
    wanted = split_ranges(examples.select(*key).distinct(), "position")
    found = compare_cells(wanted, truth, output, by=("workbook", "position")).select(*[F.col(c).alias(f"_{c}") for c in key], "matches")
    joined = examples.join(found, (F.col("workbook") == F.col("_workbook")) & (F.col("position") == F.col("_position")), "left")
    return joined.withColumn("reward", F.coalesce("matches", F.lit(False)).cast("double")).drop("_workbook", "_position", "matches")
