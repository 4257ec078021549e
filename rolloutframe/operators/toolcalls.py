"""Tool calls in model texts, their checks, and the tool catalogue of a prompt."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# The tag of a call, the messages of its checks, the prompt around the catalogue.
CALL = r"(?s)<tool_call>(.*?)</tool_call>"
NOT_AN_OBJECT = "Error: Tool command must be a JSON object."
NO_NAME = "Error: Missing 'name' field in tool command."
BAD_ARGUMENTS = "Error: 'arguments' for %s must be a JSON object."
BEFORE_TOOLS = """

# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
"""
AFTER_TOOLS = """
</tools>

For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:
<tool_call>
{"name": <function-name>, "arguments": <args-json-object>}
</tool_call>"""


def call_texts(text: Column) -> Column:
    """The JSON texts of all calls, in order; none at all where any of them is no JSON."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CALL), F.lit(1)), strip)
    broken = F.exists(found, lambda x: F.try_parse_json(x).isNull())
    return F.when(broken, F.array().cast("array<string>")).otherwise(found)


def described(text: Column) -> list[Column]:
    """name, arguments and error of a call's JSON text; all null for a null text."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    name = F.get_json_object(text, "$.name")
    arguments = F.get_json_object(text, "$.arguments")
    is_object, has_object = kind.startswith("OBJECT<"), F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT<")
    nameless = name.isNull() | (name == "")
    return [
        F.when(is_object, name).alias("name"),
        F.when(is_object, F.coalesce(arguments, F.lit("{}"))).alias("arguments"),
        F.when(text.isNull(), F.lit(None)).when(~is_object, NOT_AN_OBJECT).when(nameless, NO_NAME)
        .when(arguments.isNotNull() & ~F.coalesce(has_object, F.lit(False)), F.format_string(BAD_ARGUMENTS, name))
        .alias("error"),
    ]


def calls(rows: DataFrame, text: str) -> DataFrame:
    """``rows``, one for each call: its number from 0, its name, its arguments as JSON, its error."""
    each = rows.select(*rows.columns, F.posexplode(call_texts(F.col(text))).alias("call", "_json"))
    return each.select(*rows.columns, "call", *described(F.col("_json")))


def first_call(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``has_call`` and the first call's name, arguments and error: the only call that runs."""
    found = rows.withColumn("_json", F.get(call_texts(F.col(text)), F.lit(0)))
    return found.select(*rows.columns, F.col("_json").isNotNull().alias("has_call"), *described(F.col("_json")))


def run_tools(
    rows: DataFrame, tools: dict[str, Callable[[Column], Column]], parsers: dict[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """``rows`` (name, arguments, error, ...) with ``output``, the text that each call gives.

    ``tools``: for each name, the text of a tool as a Column of its arguments'
    JSON, null where it fails; ``parsers`` change the text of a tool by name.
    Errors are texts too, and nothing is raised.
    """
    cases = F.when(F.col("error").isNotNull(), F.col("error"))
    for name, tool in tools.items():
        text = tool(F.col("arguments")).cast("string")
        parsed = (parsers or {}).get(name, lambda x: x)(text)
        cases = cases.when(F.col("name") == name, F.coalesce(parsed, F.format_string("Error: %s failed.", F.lit(name))))
    return rows.withColumn("output", cases.otherwise(F.format_string("Error: Unknown tool: %s", F.col("name"))))


def allowed(tools: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The tools of a whitelist, all without one; a missing description is empty."""
    rows = tools.where(F.col("name").isin(names)) if names else tools
    return rows.withColumn("description", F.coalesce("description", F.lit(""))).orderBy("name")


def function_schema(name: str, description: str | None, parameters: dict | None) -> dict:
    """A tool as chat models take it; ``required`` is there even where it is empty."""
    parameters = {**(parameters or {})}
    parameters["required"] = parameters.get("required") or []
    inner = {"name": name, "description": description, "parameters": parameters, "strict": False}
    return {"type": "function", "function": inner}


def tools_prompt(tools: list[tuple[str, str | None, dict | None]], system: str = "") -> str:
    """The system message with a catalogue of the tools; alone where there are none."""
    if not tools:
        return system
    lines = (json.dumps(function_schema(*t), separators=(",", ":")) for t in tools)
    return system + BEFORE_TOOLS + "\n".join(lines) + AFTER_TOOLS
