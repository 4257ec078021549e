"""Spark DataFrames for preparing, replaying and scoring tool-using rollouts."""
