"""Environments: tools, their prompt and rewards under one name, over DataFrames of turns.

Tools and rewards are Columns of a call's arguments and of a final text, so a
whole table of rollouts is played in one plan; nothing is kept between rollouts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rewards, rollouts, toolcalls


@dataclass(frozen=True)
class Tool:
    """``run``: the tool's text as a Column of its arguments' JSON, null where it fails; ``parse`` changes that text."""

    run: Callable[[Column], Column]
    description: str = ""
    parameters: dict | None = None
    parse: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class Environment:
    """``scores``: for each reward its name and a Column of a final text and its truth."""

    tools: dict[str, Tool]
    scores: dict[str, Callable[[Column, Column], Column]]
    system: str = ""
    required: tuple[str, ...] = field(default=())

    def catalogue(self, spark: SparkSession) -> DataFrame:
        """(name, description) of the tools, by name."""
        rows = [(name, tool.description) for name, tool in sorted(self.tools.items())]
        return spark.createDataFrame(rows, "name string, description string").orderBy("name")

    def prompt(self) -> str:
        """The system message with the tools."""
        return toolcalls.tools_prompt([(n, t.description, t.parameters) for n, t in sorted(self.tools.items())], self.system)

    def run(self, calls: DataFrame) -> DataFrame:
        """``calls`` (name, arguments, error, ...) with ``output``; errors are texts and nothing is raised."""
        parsers = {n: t.parse for n, t in self.tools.items() if t.parse}
        return toolcalls.run_tools(calls, {n: t.run for n, t in self.tools.items()}, parsers)

    def reward(self, rows: DataFrame, completion: str, truth: str) -> DataFrame:
        """``rows`` with ``rewards`` and ``total_reward``; a missing completion or truth is an empty text."""
        text, wanted = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (completion, truth))
        return rewards.fan_out(rows, {name: score(text, wanted) for name, score in self.scores.items()})

    def play(self, turns: DataFrame, max_chars: int = 10_000) -> DataFrame:
        """The steps of rollouts (rollout_id, turn, action, truth): every first call is run, every final text scored.

        Columns in ``required`` that are null fail the rollout's start: its first step is its last, with reward 0.
        """
        ready = F.lit(True)
        for column in self.required:
            ready = ready & F.col(column).isNotNull()
        called = self.run(toolcalls.first_call(turns, "action"))
        scored = self.reward(called, "action", "truth")
        given = scored.select(
            "rollout_id", "turn", F.col("action"), F.when(ready, F.col("output")).alias("result"),
            F.when(ready, F.col("total_reward")).otherwise(0.0).alias("reward"),
        )
        return rollouts.steps(given, max_chars)

    def workspace(self, rows: DataFrame) -> DataFrame:
        """Tools here are Columns and read no files."""
        raise NotImplementedError("this environment has no workspace")
