"""Task datasets as chat examples with reproducible splits."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .positions import numbered, permuted


def chat(user: Column, system: str | None = None) -> Column:
    """Messages of (role, content)."""
    turns = ([("system", F.lit(system))] if system else []) + [("user", user)]
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns])


def crm_prompt(persona: Column, task: Column, required: Column, query: Column) -> Column:
    """Four lines, the third left out where it is missing."""
    return F.concat_ws("\n", persona, task, F.when(required != "", required), query)


def spreadsheet_prompt(instruction: Column, content: Column, kind: Column, position: Column, id_: Column) -> Column:
    return F.concat(
        F.lit("Instruction: "), instruction, F.lit("\nSpreadsheet Path: 1_"), id_, F.lit("_input.xlsx\nSpreadsheet Content: "),
        content, F.lit("\nInstruction Type: "), kind, F.lit(" \nAnswer Position: "), position,
        F.lit("\nOutput Path: 1_"), id_, F.lit("_output.xlsx"),
    )


def standardised(rows: DataFrame, prompt: Column, truth: Column, env: str, source: str, system: str | None = None) -> DataFrame:
    """(prompt, ground_truth, env_class, data_source) and what else ``rows`` hold."""
    own = {"prompt", "ground_truth", "env_class", "data_source"}
    return rows.select(
        *[F.col(c) for c in rows.columns if c not in own],
        chat(prompt, system).alias("prompt"), truth.alias("ground_truth"),
        F.lit(env).alias("env_class"), F.lit(source).alias("data_source"),
    )


def question_answer(rows: DataFrame, question: str, answer: str, env: str, source: str, system: str | None = None) -> DataFrame:
    """Examples of a question and an answer, standardised; a missing question or answer is empty."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (question, answer)]
    named = rows.withColumns({"_q": own[0], "_a": own[1]}).drop(question, answer)
    return standardised(named, F.col("_q"), F.col("_a"), env, source, system).drop("_q", "_a")


def split_tail(rows: DataFrame, order: str, test: float = 0.2) -> DataFrame:
    """``rows`` with ``split``: the last ``ceil(test * n)`` in order are test, the others train.

    ``order`` may be of any kind that sorts; equal values keep some order.
    """
    return _cut(numbered(rows, order, name="_place"), test)


def _cut(placed: DataFrame, test: float) -> DataFrame:
    """``split`` in the place of ``_place``, dense from 0."""
    n = placed.count()
    train = n - math.ceil(n * test)
    return placed.withColumn("split", F.when(F.col("_place") < train, "train").otherwise("test")).drop("_place")


def concatenated(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits as one dataset; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), splits.values())


def shuffled(rows: DataFrame, order: str, seed: int = 42, name: str = "place") -> DataFrame:
    """``rows`` with their ``name`` in a permutation of the order by ``order``: reproducible, whatever the layout of the input."""
    placed = numbered(rows, order, name="_position")
    return permuted(placed, placed.count(), "_position", name, seed).drop("_position")


def train_and_test(splits: dict[str, DataFrame], order: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """All rows with ``split``: splits named train and test are kept, others joined, shuffled and cut anew.

    A single split is cut in its own order, several are shuffled first.
    """
    if set(splits) == {"train", "test"}:
        return concatenated({name: rows.withColumn("split", F.lit(name)) for name, rows in splits.items()})
    rows = concatenated(splits)
    if len(splits) < 2:
        return split_tail(rows, order, test)
    return _cut(shuffled(rows, order, seed, "_place"), test)


def without_nulls(values: Column) -> Column:
    """A map without the keys whose value is null."""
    return F.map_filter(values, lambda _, v: v.isNotNull())


def extras(values: Column) -> Column:
    """What a reward function gets besides rollout id, completion and truth."""
    return F.map_filter(values, lambda k, _: ~k.isin("rollout_id", "completion", "ground_truth"))


def required_note(metadata: Column) -> Column:
    """The ``required`` text of a metadata JSON, null where there is none."""
    return F.get_json_object(metadata, "$.required")


def environment(metadata: Column, version: str = "engine_version") -> Column:
    """An environment's metadata from JSON, with what is missing filled in."""
    kinds = f"struct<pip_dependencies:array<string>,python_version:string,{version}:string,constructor_args:string,constructor_args_pickled:boolean,format_version:int>"
    read = F.from_json(metadata, kinds)
    return F.struct(
        F.coalesce(read["pip_dependencies"], F.array().cast("array<string>")).alias("pip_dependencies"),
        *[F.coalesce(read[c], F.lit("unknown")).alias(c) for c in ("python_version", version)],
        read["constructor_args"].alias("constructor_args"),
        F.coalesce(read["constructor_args_pickled"], F.lit(False)).alias("constructor_args_pickled"),
        F.coalesce(read["format_version"], F.lit(1)).alias("format_version"),
    )
