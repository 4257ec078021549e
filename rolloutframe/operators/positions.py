"""Dense positions of rows in any order, and exact permutations of them.

Rows are dealt to ranges of their order, whose bounds Spark samples, and written
sorted within each; the sizes of the ranges before, a row each, are summed and
added. So the number of ranges follows the number of rows, and no task holds more
than its own range, whatever the keys are: numbers, texts, dates or several
columns. Each range sends the driver its share of the sample and a task's result, so
ranges smaller than ``RANGE_ROWS`` grow towards it once there are ``MOST_RANGES``.
Rows of equal keys are told apart by where they stood in the input, so a key that
many rows share may be split over ranges as well.

A shuffle is a permutation of positions by a few rounds of arithmetic: it needs
no exchange besides the numbering.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged

RANGE_ROWS = 1_000_000
MOST_RANGES = 1000  # of fewer rows than that
PRIME, ROUNDS, CANDIDATES = (1 << 31) - 1, 6, 1000
_OFFSET_BITS = 33  # of monotonically_increasing_id: the rest is the partition


def _ranges(n: int, range_rows: int) -> int:
    """How many ranges ``n`` rows are dealt to: of ``range_rows``, or of up to ``RANGE_ROWS`` where there would be too many."""
    return min(-(-n // range_rows), max(MOST_RANGES, -(-n // RANGE_ROWS)))


def numbered(rows: DataFrame, *order: str | Column, name: str = "position", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with their ``name``, from 0 without gaps, in ascending ``order`` (nulls first)."""
    keys = {f"__k{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), _ranges(rows.count(), range_rows))
    tied = rows.withColumns({**keys, "__tie": F.monotonically_increasing_id()})
    dealt = tied.repartitionByRange(ranges, *keys, "__tie").sortWithinPartitions(*keys, "__tie").drop(*keys, "__tie")
    written = staged(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    written = written.withColumn("__part", F.shiftright("__at", _OFFSET_BITS))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = written.groupBy("__part").count()
    bases = sizes.select(F.col("__part").alias("__own"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    place = F.col("__base") + F.col("__at").bitwiseAND((1 << _OFFSET_BITS) - 1)
    return written.join(F.broadcast(bases), F.col("__part") == F.col("__own")).select(*rows.columns, place.alias(name))


def round_keys(seed: int) -> list[list[int]]:
    """Three numbers below ``PRIME`` for each round."""
    draw = random.Random(seed)
    return [[draw.randrange(1, PRIME) for _ in range(3)] for _ in range(ROUNDS)]


def grid(n: int) -> tuple[int, int]:
    """Columns and rows of a nearly square grid with ``n`` places or a few more: of those tried, the one with the fewest more."""
    root = max(1, math.isqrt(max(n, 1) - 1) + 1)
    a = min(range(root, min(root + CANDIDATES, 2 * root) + 1), key=lambda a: (-n % a, a))
    return a, max(1, -(-n // a))


def _outside(n: int, seed: int) -> dict[int, int]:
    """Where the places of the grid past ``n``, fewer than one of its rows, lead on to, until inside."""
    a, b = grid(n)
    found = {}
    for start in range(n, a * b) if n else ():
        x = start
        while x >= n:
            x, y = x % a, x // a
            for i, (k, m, o) in enumerate(round_keys(seed)):
                u = ((x if i % 2 else y) + k) % PRIME
                step = (u * u + m) % PRIME * ((u + o) % PRIME) % PRIME
                x, y = (x, (y + step) % b) if i % 2 else ((x + step) % a, y)
            x += y * a
        found[start] = x
    return found


def permuted(rows: DataFrame, n: int, position: str = "position", name: str = "place", seed: int = 42) -> DataFrame:
    """``rows`` with ``name``: where each of the positions 0 to n - 1 stands in the permutation that ``seed`` names.

    A position is a column and a row of a grid. Each round moves one of them by a
    function of the other, which is a bijection, and so are all rounds together;
    what falls on a place past ``n`` moves on until it falls inside.
    """
    a, b = grid(n)
    out = rows.withColumns({"_x": F.col(position) % a, "_y": F.expr(f"`{position}` div {a}")})
    for i, (k, m, o) in enumerate(round_keys(seed)):
        moves, by, side = ("_x", "_y", a) if i % 2 == 0 else ("_y", "_x", b)
        # no product leaves 62 bits
        out = out.withColumn("_u", (F.col(by) + k) % PRIME)
        out = out.withColumn("_v", (F.col("_u") * F.col("_u") + m) % PRIME)
        out = out.withColumn(moves, (F.col(moves) + F.col("_v") * ((F.col("_u") + o) % PRIME) % PRIME) % side)
    place = F.col("_x") + F.col("_y") * a
    led = _outside(n, seed)
    if led:
        place = F.when(place < n, place).otherwise(F.create_map(*[F.lit(v).cast("long") for pair in led.items() for v in pair])[place])
    return out.withColumn(name, place).select(*rows.columns, name)
