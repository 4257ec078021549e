"""Tool state at each call, in batch and as a stream, and event sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollouts
from ..sources import tables as t
from ..streaming import rollouts as streams
from ..streaming import state


def _calls(events: DataFrame) -> DataFrame:
    """Events as calls that define and read variables; some names are none, some rollouts end early."""
    kind, key = F.col("event_type"), F.col("event_id")
    tool = (
        F.when((kind == "error") & (key % 5 == 0), "error").when((kind == "purchase") & (key % 9 == 0), F.lit(None).cast("string"))
        .when(kind.isin("signup", "purchase", "error"), "define_variable").otherwise("get_variable")
    )
    name = F.when(key % 11 == 0, "2nd").when(key % 3 == 0, "x").when(key % 3 == 1, "_y").otherwise("naïve")
    return events.select(F.col("user_id").alias("rollout_id"), key.alias("seq"), tool.alias("tool"), name.alias("name"), "value")


def variable_at_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.variables_at(_calls(t.load(spark, sf_dir, "events")))


def stream_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = t.load(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return streams.run_to_end(state.variables_at(_calls(source)), ["rollout_id", "seq"], state.PROVIDER)


QUERIES = {f.__name__: f for f in (variable_at_call, stream_variables)}

_AT_CALL = """WITH log AS (SELECT user_id AS rollout_id, event_id AS seq, value,
  CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'error' WHEN event_type = 'purchase' AND event_id % 9 = 0 THEN NULL
    WHEN event_type IN ('signup', 'purchase', 'error') THEN 'define_variable' ELSE 'get_variable' END AS tool,
  CASE WHEN event_id % 11 = 0 THEN '2nd' WHEN event_id % 3 = 0 THEN 'x' WHEN event_id % 3 = 1 THEN '_y' ELSE 'naïve' END AS name FROM events),
ends AS (SELECT rollout_id, min(seq) AS e FROM log WHERE tool IS NULL OR tool = 'error' GROUP BY 1),
live AS (SELECT log.* FROM log LEFT JOIN ends USING (rollout_id) WHERE e IS NULL OR seq < e),
held AS (SELECT *, last_value(CASE WHEN tool = 'define_variable' AND name <> '2nd' THEN value END IGNORE NULLS)
  OVER (PARTITION BY rollout_id, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM live)
SELECT rollout_id, seq, name, v AS value, CASE WHEN name = '2nd' THEN 'Invalid variable name: ' || chr(39) || name || chr(39)
  WHEN v IS NULL THEN 'Variable ' || chr(39) || name || chr(39) || ' not defined' END AS error FROM held WHERE tool = 'get_variable'"""
ORACLES = {"variable_at_call": _AT_CALL, "stream_variables": _AT_CALL}
