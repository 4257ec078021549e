"""The questions of ``operators.crm`` and the parsing of tool calls as SQL table functions.

They are temporary functions over temporary views, so ad-hoc texts call them with
parameters and Catalyst plans each call with the text around it. Ids and names are
lists of texts; a null parameter, the default, asks for everything.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.crm import OWNER_FIELD
from ..operators.toolcalls import BAD_ARGUMENTS, CALL, NO_NAME, NOT_AN_OBJECT
from ..session import ship_package

_PERIOD = "start TIMESTAMP DEFAULT NULL, end TIMESTAMP DEFAULT NULL"
_WITHIN = "(start IS NULL OR created >= start) AND (end IS NULL OR created < end)"
_CLOSED = "(start IS NULL OR created >= start) AND (end IS NULL OR created <= end)"
_TOOK = "CAST(unix_micros(CAST(closed AS TIMESTAMP)) - unix_micros(CAST(created AS TIMESTAMP)) AS DECIMAL(20, 0))"  # a sum leaves a long


def _listed(column: str, names: str) -> str:
    return f"({names} IS NULL OR array_contains({names}, CAST({column} AS STRING)))"


def _functions(cases: str, history: str, accounts: str) -> dict[str, str]:
    """Signature and body of each function."""
    moved = f"SELECT * FROM {history} WHERE field = '{OWNER_FIELD}' AND {_CLOSED}"
    ids = {"owner_id": "owners", "id": "ids", "order_item_id": "items", "issue_id": "issues", "status": "statuses"}
    lists = ", ".join(f"{p} ARRAY<STRING> DEFAULT NULL" for p in ids.values())
    return {
        f"get_cases({_PERIOD}, {lists})": f"SELECT owner_id, created, closed, account_id FROM {cases} WHERE {_WITHIN} AND {' AND '.join(_listed(c, p) for c, p in ids.items())}",
        f"non_transferred({_PERIOD})": f"SELECT case_id FROM ({moved}) GROUP BY case_id HAVING count(id) = 1",
        f"handled_by_agent({_PERIOD})": f"SELECT new_value AS agent, count(id) AS n_cases FROM ({moved}) GROUP BY new_value",
        f"transferred_by_agent({_PERIOD}, agents ARRAY<STRING> DEFAULT NULL)":
            f"SELECT old_value AS agent, count(id) AS n_cases FROM ({moved}) WHERE old_value IS NOT NULL AND {_listed('old_value', 'agents')} GROUP BY old_value",
        f"qualified_agents(n BIGINT, {_PERIOD})": f"SELECT new_value AS agent FROM ({moved}) GROUP BY new_value HAVING count(id) > first(n)",
        f"issue_counts({_PERIOD}, items ARRAY<STRING> DEFAULT NULL)":
            f"SELECT issue_id, count(id) AS n_cases FROM {cases} WHERE {_CLOSED} AND {_listed('order_item_id', 'items')} GROUP BY issue_id",
        f"average_handle_minutes({_PERIOD})":
            f"SELECT owner_id, CAST(sum({_TOOK}) AS DOUBLE) / (count(*) * 6e7D) AS minutes FROM {cases} WHERE {_WITHIN} AND closed >= created GROUP BY owner_id",
        f"closure_seconds_by_region({_PERIOD})":
            f"SELECT shipping_state, CAST(sum({_TOOK}) AS DOUBLE) / (count(*) * 1e6D) AS seconds FROM {cases} c JOIN {accounts} a ON c.account_id = a.id"
            f" WHERE {_WITHIN} AND closed IS NOT NULL AND shipping_state <> '' GROUP BY shipping_state",
        f"month_counts({_PERIOD})": f"SELECT date_format(created, 'MMMM') AS month, count(*) AS n_cases FROM {cases} WHERE {_WITHIN} GROUP BY 1",
        f"agents_by_cases(most BOOLEAN DEFAULT true, {_PERIOD})":
            f"WITH n AS (SELECT owner_id, count(*) AS n FROM {cases} WHERE {_WITHIN} GROUP BY owner_id)"
            " SELECT owner_id FROM n WHERE (most AND n = (SELECT max(n) FROM n)) OR (NOT most AND n = (SELECT min(n) FROM n))",
    }


def register_questions(cases: DataFrame, history: DataFrame, accounts: DataFrame, prefix: str = "crm") -> None:
    """``prefix``_get_cases, ``prefix``_handled_by_agent, … as table functions over the three tables."""
    spark = cases.sparkSession
    views = {name: f"{prefix}_{name}_view" for name in ("cases", "history", "accounts")}
    for name, rows in (("cases", cases), ("history", history), ("accounts", accounts)):
        rows.createOrReplaceTempView(views[name])
    for signature, body in _functions(**views).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{signature} RETURNS TABLE RETURN {body}")


@dataclass
class _Wanted(AnalyzeResult):
    keys: tuple[str, ...] = ()


class ToolCalls:
    """``tool_calls(text[, keys])``: a row for each call of a model's text: its number, name, arguments as JSON, error.

    ``keys``, a constant of names between commas, adds these arguments as columns.
    None at all where any call is no JSON.
    """

    def __init__(self, wanted: _Wanted):
        self.keys = wanted.keys

    @staticmethod
    def analyze(text: AnalyzeArgument, keys: AnalyzeArgument | None = None) -> _Wanted:
        if keys is not None and (not keys.isConstantExpression or not isinstance(keys.value, str)):
            raise ValueError("the keys of tool_calls are a constant text")
        names = tuple(k.strip() for k in keys.value.split(",") if k.strip()) if keys is not None else ()
        schema = StructType().add("call", IntegerType()).add("name", StringType()).add("arguments", StringType()).add("error", StringType())
        for name in names:
            schema = schema.add(name, StringType())
        return _Wanted(schema, keys=names)

    def eval(self, text: str | None, keys: str | None = None) -> Iterator[tuple]:
        try:
            found = [json.loads(x.strip(), parse_constant=float.fromhex) for x in re.findall(CALL, text or "")]
        except ValueError:
            return
        for number, call in enumerate(found):
            if not isinstance(call, dict):
                yield (number, None, None, NOT_AN_OBJECT, *[None] * len(self.keys))
                continue
            name, given = _shown(call.get("name")), call.get("arguments")
            error = NO_NAME if not name else BAD_ARGUMENTS % name if given is not None and not isinstance(given, dict) else None
            own = given if isinstance(given, dict) else {}
            yield (number, name, "{}" if given is None else _shown(given), error, *[_shown(own.get(k)) for k in self.keys])


def _shown(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def register_tool_calls(spark: SparkSession) -> None:
    """``tool_calls`` as a table function: SELECT … FROM t, LATERAL tool_calls(t.text)."""
    from pyspark.sql.functions import udtf

    ship_package(spark)
    spark.udtf.register("tool_calls", udtf(ToolCalls))
