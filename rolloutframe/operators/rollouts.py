"""Folds of turn logs into rollout outcomes.

A log row is (rollout_id, seq, tool, name, value, filename, message). A rollout
is over at its first error (reward 0) or its first row without a tool; rows
after that do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import is_name, truncated
from .positions import numbered
from .toolcalls import first_call

CHUNK = 4096


def steps(turns: DataFrame, max_chars: int = 10_000) -> DataFrame:
    """The steps of rollouts from their raw turns: (rollout_id, turn, action, name, arguments, observation, reward, done).

    ``turns``: (rollout_id, turn, action, result, reward), where ``action`` is
    the model's text, ``result`` what its first tool call gave (null where the
    tool, or the rollout's start, failed) and ``reward`` what its final text
    earns. A text without calls is the last step and gets the reward; a call that
    fails latches the error: that step is done with reward 0. Later turns do not
    count. Of several calls only the first runs; a malformed call's error, or the
    result cut to ``max_chars``, is the observation.
    """
    parsed = first_call(turns, "action")
    observed = F.coalesce(F.col("error"), truncated(F.col("result"), max_chars))
    over = ~F.col("has_call") | observed.isNull()
    # a row each for the ends, by partial aggregation: a hot rollout is never one task's
    ends = parsed.groupBy(F.col("rollout_id").alias("_r")).agg(F.min(F.when(over, F.col("turn"))).alias("_end"))
    live = parsed.join(ends, F.col("rollout_id") == F.col("_r")).where(F.col("_end").isNull() | (F.col("turn") <= F.col("_end")))
    return live.select(
        "rollout_id", "turn", "action", "name", "arguments", F.when(F.col("has_call"), observed).alias("observation"),
        F.when(F.col("has_call"), 0.0).otherwise(F.col("reward").cast("double")).alias("reward"), over.alias("done"),
    )


def histories(stepped: DataFrame) -> DataFrame:
    """(rollout_id, messages, total_reward): the chat of each rollout, actions as assistant, observations as user."""
    said = F.array(
        F.struct(F.lit("assistant").alias("role"), F.col("action").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("observation").alias("content")),
    )
    own = F.array_sort(F.collect_list(F.struct("turn", F.filter(said, lambda m: m["content"].isNotNull()).alias("said"))))
    return stepped.groupBy("rollout_id").agg(F.flatten(F.transform(own, lambda x: x["said"])).alias("messages"), F.sum("reward").alias("total_reward"))


def _ends(log: DataFrame) -> DataFrame:
    """(rollout_id, end, failed, turns): where each rollout ends, by one partial aggregation."""
    over = F.col("tool").isNull() | (F.col("tool") == "error")
    return log.groupBy("rollout_id").agg(
        F.min(F.when(over, F.col("seq"))).alias("end"),
        F.min_by(F.col("tool"), F.when(over, F.col("seq"))).eqNullSafe(F.lit("error")).alias("failed"),
    )


def live_rows(log: DataFrame) -> DataFrame:
    """The rows up to the end of their rollout, that end included, with ``end`` and ``failed``."""
    return log.join(_ends(log), "rollout_id").where(F.col("end").isNull() | (F.col("seq") <= F.col("end")))


def outcomes(log: DataFrame, max_turns: int | None = None) -> DataFrame:
    """(rollout_id, n_turns, status): status is failed, done, cut (by ``max_turns``) or open."""
    rows = live_rows(log)
    n = F.count(F.lit(1))
    status = F.when(F.max("failed"), "failed").when(F.max("end").isNotNull(), "done").otherwise("open")
    if max_turns is not None:
        status = F.when(n > max_turns, "cut").otherwise(status)
        n = F.least(n, F.lit(max_turns))
    return rows.groupBy("rollout_id").agg(n.alias("n_turns"), status.alias("status"))


def variables(log: DataFrame) -> DataFrame:
    """(rollout_id, name, value): each variable as its last definition leaves it."""
    defined = live_rows(log).where(F.col("tool") == "define_variable")
    return defined.groupBy("rollout_id", "name").agg(F.max_by("value", "seq").alias("value"))


def name_error(name: Column, known: Column) -> Column:
    """Why a variable cannot be read, null where it can."""
    return F.when(~is_name(name), F.concat(F.lit("Invalid variable name: '"), F.coalesce(name, F.lit("")), F.lit("'"))).when(
        ~known, F.concat(F.lit("Variable '"), name, F.lit("' not defined"))
    )


def variables_at(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(rollout_id, seq, name, value, error): what each ``get_variable`` call finds, as defined before it.

    Rows are numbered by rollout, name and ``seq`` and looked up within chunks of
    ``chunk`` rows; what holds at a chunk's start comes from the ends of those
    before it, so a rollout with a third of all rows is never one task's.
    """
    calls = live_rows(log).where(F.col("tool").isin("define_variable", "get_variable")).select("rollout_id", "name", "seq", "tool", "value")
    keys = ["_chunk", "rollout_id", "name"]
    rows = numbered(calls, "rollout_id", "name", "seq", name="_at").withColumns({
        "_chunk": F.floor(F.col("_at") / chunk),
        "_set": F.when((F.col("tool") == "define_variable") & is_name(F.col("name")), F.struct(F.col("value").cast("double").alias("value"))),
    })
    ends = rows.groupBy(*keys).agg(F.max_by("_set", F.when(F.col("_set").isNotNull(), F.col("_at"))).alias("_end"))
    before = Window.partitionBy("rollout_id", "name").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias(f"_e{k}") for k in keys], F.last("_end", ignorenulls=True).over(before).alias("_held"))
    earlier = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.last("_set", ignorenulls=True).over(earlier)).where(F.col("tool") == "get_variable")
    same = [F.col(k).eqNullSafe(F.col(f"_e{k}")) for k in keys]
    found = rows.join(ends, same[0] & same[1] & same[2]).withColumn("_now", F.coalesce("_own", "_held"))
    return found.select("rollout_id", "seq", "name", F.col("_now.value").alias("value"), name_error(F.col("name"), F.col("_now").isNotNull()).alias("error"))


def success_rate(scored: DataFrame, success: Column, *keys: str) -> DataFrame:
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(success.cast("double")).alias("success_rate"))


def repeated_ids(rollouts: DataFrame) -> DataFrame:
    """Rollout ids that start more than once."""
    return rollouts.groupBy("rollout_id").count().where("count > 1").select("rollout_id")
