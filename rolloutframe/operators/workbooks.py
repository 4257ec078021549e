"""Spreadsheet tasks from start to reward, over tables of rollouts and files.

A rollout (rollout_id, id, input, position) works on a copy of its example's input
and leaves an output; both lie in its workspace (rollout_id, filename, content).
Each file is parsed where it is read, one a time, and an example's answer once,
however many rollouts share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from ..sources import xlsx
from .sheets import spreadsheet_reward

# The names of a task's files.
INPUT, OUTPUT, ANSWER = "1_%s_input.xlsx", "1_%s_output.xlsx", "1_%s_answer.xlsx"
NO_INPUT = "an input file is required"


def start(rollouts: DataFrame, inputs: DataFrame) -> DataFrame:
    """(rollout_id, filename, content, error): each rollout's copy of its input, or why it cannot start.

    ``inputs``: (path, content). A rollout without an input, or with one that is not there, has an error and no file.
    """
    # Spark takes a file's content for 100 bytes; by that guess it would send all files through the driver as a broadcast
    files = inputs.select(F.col("path").alias("input"), "content").hint("merge")
    found = rollouts.select("rollout_id", "id", "input").join(files, "input", "left")
    lost = F.when(F.coalesce(F.col("input"), F.lit("")) == "", NO_INPUT).when(F.col("content").isNull(), F.concat(F.lit("no such file: "), "input"))
    name = F.when(lost.isNull(), F.format_string(INPUT, F.col("id").cast("string")))
    return found.select("rollout_id", name.alias("filename"), "content", lost.alias("error"))


def _cells(files: DataFrame, key: Column) -> DataFrame:
    return xlsx.parse_cells(files.select(key.cast("string").alias("workbook"), "content"))


def reward(rollouts: DataFrame, workspace: DataFrame, answers: DataFrame) -> DataFrame:
    """``rollouts`` with ``reward``: 1 where the output's cells at ``position`` match the answer's.

    ``answers``: (filename, content). 0 for a rollout without an output, an answer
    or a position, and for files that cannot be read.
    """
    named = rollouts.select("rollout_id", "id", F.format_string(OUTPUT, F.col("id").cast("string")).alias("filename"))
    own = workspace.join(named.hint("merge"), ["rollout_id", "filename"], "left_semi")
    output = staged(_cells(own, F.col("rollout_id")), "output")  # cells are read twice, and files parsed once
    wanted = rollouts.select("id", F.format_string(ANSWER, F.col("id").cast("string")).alias("filename")).distinct()
    truth = staged(_cells(answers.join(wanted.hint("merge"), "filename"), F.col("id")), "truth").withColumnRenamed("workbook", "_id")
    owners = rollouts.select(F.col("id").cast("string").alias("_id"), F.col("rollout_id").cast("string").alias("workbook")).distinct()
    truth = truth.join(owners.hint("merge"), "_id").select(*output.columns)
    asked = rollouts.select(F.col("rollout_id").cast("string").alias("workbook"), "position", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(rollouts.columns)])
    found = spreadsheet_reward(asked, truth, output)
    return found.select(*[F.col(f"_o{i}").alias(c) for i, c in enumerate(rollouts.columns)], "reward")
