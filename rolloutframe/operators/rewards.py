"""Rewards of completions, as Columns, and their fan-out over a DataFrame.

A completion is a text or an array of (role, content) messages, of which the
last one counts. A reward that has no value (a null truth or metric) is NaN.

Rewards given as Python functions are called for each row of Arrow batches: they
are the user's own code, and one that fails, or takes too long, costs a NaN and no
job. Those that wait, for a judge or a sandbox, wait together.
"""

from __future__ import annotations

import asyncio
import inspect
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from importlib import import_module

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import answer, normalized, number, strip, tokens

NAN = float("nan")
AHEAD = 8  # batches of waiting rewards, besides the one that is awaited


def completion_text(rows: DataFrame, column: str) -> Column:
    """The text of a completion column of either kind."""
    if isinstance(rows.schema[column].dataType, T.ArrayType):
        return F.coalesce(F.try_element_at(F.col(column), F.lit(-1))["content"], F.lit(""))
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _score(hit: Column) -> Column:
    return F.coalesce(hit, F.lit(False)).cast("double")


def text_match(text: Column, truth: Column) -> Column:
    """1 where the answer is the truth, case aside."""
    return F.when(truth.isNull(), NAN).otherwise(_score(F.lower(truth) == answer(text)))


def numeric_match(text: Column, truth: Column) -> Column:
    """1 where answer and truth are the same number; never for NaN."""
    a, b = number(answer(text)), number(truth.cast("string"))
    return _score((a == b) & ~F.isnan(a))


def token_iou(text: Column, truths: Column) -> Column:
    """Shared over all distinct tokens of the answer and the truths."""
    theirs = F.array_distinct(F.flatten(F.transform(F.filter(truths, lambda t: t.isNotNull()), tokens)))

    def score(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair["own"], pair["theirs"]))
        either = F.size(pair["own"]) + F.size(pair["theirs"]) - both  # each side is distinct
        return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))

    # bound to a name, the token arrays are made once
    pair = F.array(F.struct(tokens(answer(text)).alias("own"), theirs.alias("theirs")))
    return F.when(truths.isNull(), NAN).otherwise(F.get(F.transform(pair, score), F.lit(0)))


def token_f1(text: Column, truth: Column) -> Column:
    """F1 of the token multisets of answer and truth; 0 without a shared token.

    For answers: each distinct shared token is counted along both arrays.
    """
    def words(value: Column) -> Column:
        return F.filter(F.split(normalized(value), " "), lambda w: w != "")

    def count(some: Column, word: Column) -> Column:
        return F.size(F.filter(some, lambda w: w == word))

    def score(pair: Column) -> Column:
        own, theirs = pair["own"], pair["theirs"]
        shared = F.aggregate(
            F.array_intersect(own, theirs), F.lit(0), lambda total, w: total + F.least(count(own, w), count(theirs, w))
        )
        return F.when(shared == 0, 0.0).otherwise(2.0 * shared / F.greatest(F.size(own) + F.size(theirs), F.lit(1)))

    # the pair is an argument: a lambda may not hold the UDF behind the answer
    pair = F.array(F.struct(words(answer(text)).alias("own"), words(truth).alias("theirs")))
    return F.when(truth.isNull(), 0.0).otherwise(F.get(F.transform(pair, score), F.lit(0)))


def by_metric(text: Column, truths: Column, metric: Column) -> Column:
    """The metric that each row names; 0 for an unknown one, NaN for none."""
    return (
        F.when(metric.isNull(), NAN)
        .when(metric == "exact_match", token_iou(text, truths))
        .when(metric == "fuzzy_match", token_f1(text, F.get(truths, F.lit(0))))
        .otherwise(0.0)
    )


def stripped_match(text: Column, truth: Column) -> Column:
    return _score(strip(text) == strip(truth))


def fan_out(rows: DataFrame, rewards: dict[str, Column]) -> DataFrame:
    """``rows``, a map of all rewards and their sum; a null reward is NaN, and NaN makes the sum NaN."""
    pairs = [x for name, r in rewards.items() for x in (F.lit(name), F.coalesce(r.cast("double"), F.lit(NAN)))]
    total = F.aggregate(F.map_values("rewards"), F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("rewards", F.create_map(*pairs)).withColumn("total_reward", total)


def group_normalized(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """Each reward against its group: (reward - mean) / standard deviation, 0 where they are all equal.

    Sums are grouped and joined back, so that a hot group is never one task's.
    """
    sums = rows.groupBy(F.col(group).alias("_g")).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_sd"))
    joined = rows.join(sums, F.col(group).eqNullSafe(F.col("_g")), "left")
    score = F.when(F.col("_sd") > 0, (F.col(reward) - F.col("_mean")) / F.col("_sd")).otherwise(0.0)
    return joined.withColumn("advantage", score).drop("_g", "_mean", "_sd")


def first_of_group(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each group of equal ``keys``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def named_rewards(module: str, attribute: str = "reward_functions") -> dict[str, Callable]:
    """The reward functions that a module lists by name."""
    found = getattr(import_module(module), attribute)
    if not isinstance(found, dict) or not all(callable(f) for f in found.values()):
        raise TypeError(f"{module}.{attribute} must map names to functions")
    return found


async def _value(function: Callable, arguments: dict, gate: asyncio.Semaphore, timeout: float | None, threads: ThreadPoolExecutor | None) -> float:
    """A function's reward; NaN where it fails, gives no number or takes longer than ``timeout``."""
    async with gate:
        try:
            if threads and not inspect.iscoroutinefunction(function):
                call = asyncio.get_running_loop().run_in_executor(threads, partial(function, **arguments))
                found = await asyncio.wait_for(call, timeout)
            else:
                found = function(**arguments)
            if inspect.isawaitable(found):
                found = await asyncio.wait_for(found, timeout)
            return float(found) if isinstance(found, (int, float)) else NAN
        except Exception:  # the user's code may fail in any way
            return NAN


async def _gathered(functions: dict[str, Callable], records: list[dict], gate: asyncio.Semaphore, timeout: float | None, threads: ThreadPoolExecutor | None) -> list[dict]:
    calls = [_value(f, record, gate, timeout, threads) for record in records for f in functions.values()]
    values = iter(await asyncio.gather(*calls))
    return [{name: next(values) for name in functions} for _ in records]


def call_rewards(
    rows: DataFrame, functions: dict[str, Callable], completion: str = "completion", truth: str = "ground_truth", extras: tuple[str, ...] = (),
    concurrency: int = 64, timeout: float | None = None,
) -> DataFrame:
    """``rows`` with ``rewards``, a map of what each function returns, and their sum.

    A function takes completion, ground_truth and the ``extras`` by keyword; it
    may be a coroutine function. A null completion or truth is an empty text.

    A task runs one event loop, in which up to ``concurrency`` calls are under way
    at once; those of the next ``AHEAD`` batches begin before the slowest of a batch
    have ended. With a ``timeout``, in seconds for each call, rows are dealt to as many
    tasks as there are cores, and plain functions run on threads, since nothing else
    can outwait them; without one they run in turn.
    """
    if timeout is not None:
        rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    names = {"completion": completion, "ground_truth": truth, **{e: e for e in extras}}

    @F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        threads = ThreadPoolExecutor(concurrency) if timeout is not None else None
        gate = asyncio.Semaphore(concurrency)

        async def ended(batch: asyncio.Task) -> list[dict]:
            return await batch

        try:
            with asyncio.Runner() as loop:
                begun: deque[asyncio.Task] = deque()
                for given in batches:
                    begun.append(loop.get_loop().create_task(_gathered(functions, given.to_dict("records"), gate, timeout, threads)))
                    if len(begun) > AHEAD:
                        yield pd.Series(loop.run(ended(begun.popleft())), dtype=object)
                while begun:
                    yield pd.Series(loop.run(ended(begun.popleft())), dtype=object)
        finally:
            if threads:
                threads.shutdown(wait=False, cancel_futures=True)

    def argument(name: str, column: str) -> Column:
        empty = name in ("completion", "ground_truth") and isinstance(rows.schema[column].dataType, T.StringType)
        return (F.coalesce(F.col(column), F.lit("")) if empty else F.col(column)).alias(name)

    given = F.struct(*[argument(name, column) for name, column in names.items()])
    total = F.aggregate(F.map_values("rewards"), F.lit(0.0), lambda a, b: a + b)
    # Arrow turns a NaN of pandas into a null
    return rows.withColumn("rewards", F.transform_values(call(given), lambda _, v: F.coalesce(v, F.lit(NAN)))).withColumn("total_reward", total)


def variable_reward(asked: DataFrame, variables: DataFrame) -> DataFrame:
    """``asked`` (rollout_id, name, expected, ...) with ``reward``: 1 where the variable ends as expected, else 0."""
    held = variables.select(F.col("rollout_id").alias("_r"), F.col("name").alias("_n"), F.col("value").cast("double").alias("_v"))
    joined = asked.join(held, (F.col("rollout_id") == F.col("_r")) & (F.col("name") == F.col("_n")), "left")
    expected = F.col("expected").cast("double")
    hit = (F.col("name") != "") & (F.col("_v") == expected) & ~F.isnan("_v")
    return joined.withColumn("reward", _score(hit)).drop("_r", "_n", "_v")


def log_reward(asked: DataFrame, files: DataFrame) -> DataFrame:
    """``asked`` (rollout_id, filename, expected, ...) with ``reward``: 1 where the file holds the expected text, else 0.

    White space at both ends does not count; a null expectation is an empty text.
    """
    content = F.col("content").cast("string")
    held = files.select(F.col("rollout_id").alias("_r"), F.col("filename").alias("_f"), content.alias("_c"))
    joined = asked.join(held, (F.col("rollout_id") == F.col("_r")) & (F.col("filename") == F.col("_f")), "left")
    hit = (F.col("filename") != "") & (strip(F.col("_c")) == strip(F.coalesce(F.col("expected"), F.lit(""))))
    return joined.withColumn("reward", _score(hit)).drop("_r", "_f", "_c")


def group_rewards(
    rows: DataFrame, group: str, function: Callable | None = None, rollout: str = "rollout_id",
    completion: str = "completion", truth: str = "ground_truth",
) -> DataFrame:
    """(group, rollout, rewards): ``function`` of all rollouts of a group at once.

    It takes lists rollout_ids, completions and ground_truths and returns a map
    for each rollout; none means empty maps. A group is the rollouts of one
    prompt, whose number the sampler sets, so it fits a task. Spark gathers the
    groups, and Python gets many of them in each Arrow batch.
    """
    if function is None:
        return rows.select(group, rollout, F.create_map().cast("map<string,double>").alias("rewards"))
    kind = rows.schema[rollout].dataType.simpleString()

    @F.arrow_udf(f"array<struct<rollout:{kind},rewards:map<string,double>>>")
    def score(groups: pa.Array) -> pa.Array:
        out = []
        for own in groups.to_pylist():
            own.sort(key=lambda r: (r["rollout"] is None, r["rollout"]))
            ids, said, truths = ([r[k] for r in own] for k in ("rollout", "completion", "truth"))
            found = function(rollout_ids=ids, completions=said, ground_truths=truths)
            out.append([{"rollout": i, "rewards": [(k, float(v)) for k, v in x.items()]} for i, x in zip(ids, found, strict=True)])
        rollouts = groups.type.value_type.field("rollout").type
        return pa.array(out, pa.list_(pa.struct([("rollout", rollouts), ("rewards", pa.map_(pa.string(), pa.float64()))])))

    each = F.struct(F.col(rollout).alias("rollout"), F.col(completion).alias("completion"), F.col(truth).alias("truth"))
    gathered = rows.groupBy(group).agg(F.collect_list(each).alias("_own"))
    return gathered.select(group, F.inline(score("_own"))).toDF(group, rollout, "rewards")
