"""Chat formatting after the collapse of cumulative snapshots.

Loggers write a conversation again after each turn, so most logged
conversations are prefixes of longer ones. Each turn gets a 128-bit hash of
its place, role and text; the XOR of the hashes of the first k turns names the
prefix of length k (the place inside each hash keeps order). A conversation
whose whole hash is a proper prefix of another one is anti-joined away, equal
ones collapse onto the smallest id, and what is left is rendered.

A conversation may hold a third of all rows, and so may one turn number: places
come from ranges of all rows in order, sampled bounds and summed sizes, and prefix
hashes are windowed over runs of ``RUN`` places and shifted by small per-run sums,
so no task holds a whole conversation. :func:`render_runs` gives the text of each
run, so that no value holds a whole conversation either; joined to one value by
:func:`format_chats`, a conversation may have 2 GB of text at most.

Only DataFrame functions run here.

Defined cases: rows without a conversation id are left out; rows that repeat
in full count once; a null turn sorts first and equal turns sort by role and
text; a null role or text is empty; ``<|`` inside a role or text is written
``< |`` so that no text can forge a marker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.positions import numbered
from .common import stage

RUN = 256


def _placed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, run, place, role, text), places from 1 without gaps, runs of ``RUN`` places."""
    rows = (
        turns.where(F.col(conv).isNotNull())
        .select(
            F.col(conv).alias("c"),
            F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 62))).alias("t"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )
        .distinct()
    )
    ordered = numbered(stage(rows, "chat-rows"), "c", "t", "role", "text", name="at")
    firsts = ordered.groupBy("c").agg(F.min("at").alias("first"))
    place = F.col("at") - F.col("first") + 1
    return ordered.join(firsts, "c").select("c", F.floor((place - 1) / RUN).alias("run"), place.alias("place"), "role", "text")


def _prefixes(placed: DataFrame) -> DataFrame:
    """(c, place, p1, p2): the rolling hash of each prefix."""
    hashed = placed.select(
        "c", "run", "place",
        F.xxhash64("place", "role", "text").alias("x1"),
        F.xxhash64(F.lit(1), "place", "role", "text").alias("x2"),
    )
    runs = hashed.groupBy("c", "run").agg(F.bit_xor("x1").alias("r1"), F.bit_xor("x2").alias("r2"))
    earlier = Window.partitionBy("c").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "c", "run", *[F.coalesce(F.bit_xor(f"r{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)]
    )
    upto = Window.partitionBy("c", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = hashed.select("c", "run", "place", *[F.bit_xor(f"x{i}").over(upto).alias(f"o{i}") for i in (1, 2)])
    return own.join(runs, ["c", "run"]).select(
        "c", "place", *[F.col(f"o{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2)]
    )


def marked(value: Column) -> Column:
    return F.replace(value, F.lit("<|"), F.lit("< |"))


def _rendered(rows: DataFrame, within: str | None, order: str, line: Column) -> DataFrame:
    """(c, within, rendered): ``line`` of all rows joined, in ``order``."""
    ordered = F.array_sort(F.collect_list(F.struct(order, line.alias("line"))))
    return rows.groupBy("c", *([within] if within else [])).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("rendered"))


def _maximal(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(c, n_turns, n_copies) of every maximal conversation, and (c, run, rendered) of its runs."""
    placed = stage(_placed(turns, conv, turn, role, text), "chat-turns")
    prefixes = stage(_prefixes(placed), "chat-prefixes")
    whole = prefixes.groupBy("c").agg(F.max(F.struct("place", "p1", "p2")).alias("w")).select("c", "w.*")
    ends = whole.select("c", F.col("place").alias("n"))
    proper = (
        prefixes.join(ends, "c").where(F.col("place") < F.col("n")).select("place", "p1", "p2").distinct()
    )
    maximal = (
        whole.groupBy("place", "p1", "p2")
        .agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_copies"))
        .join(proper, ["place", "p1", "p2"], "left_anti")
        .select("c", F.col("place").cast("long").alias("n_turns"), "n_copies")
    )
    line = F.concat(
        F.lit("<|im_start|>"), marked(F.col("role")), F.lit("\n"), marked(F.col("text")), F.lit("<|im_end|>\n")
    )
    return maximal, _rendered(placed.join(maximal.select("c"), "c", "left_semi"), "run", "place", line)


def render_runs(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, run, rendered): the maximal conversations in runs of turns; in order of ``run`` they make the whole text."""
    _, runs = _maximal(turns, conv, turn, role, text)
    return runs.select(F.col("c").alias(conv), "run", "rendered")


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, n_turns, n_copies, rendered) of every maximal conversation.

    ``n_copies`` counts the logged conversations equal to it, itself included.
    """
    maximal, runs = _maximal(turns, conv, turn, role, text)
    whole = _rendered(runs, None, "run", F.col("rendered"))
    return maximal.join(whole, "c").select(F.col("c").alias(conv), "n_turns", "n_copies", "rendered")


ORACLE_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, -4611686018427387904) AS turn,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, row_number() OVER w AS place, list({'r': role, 't': text}) OVER w AS turns,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
whole AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n_turns
  FROM p WHERE place = n GROUP BY turns)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies,
       list_aggregate(list_transform(turns, lambda x: '<|im_start|>' || replace(x.r, '<|', '< |') || chr(10)
         || replace(x.t, '<|', '< |') || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
FROM whole WHERE turns NOT IN (SELECT turns FROM p WHERE place < n)
"""
