"""Answers, tokens, tool calls, search and rewards over texts.

The tables hold no model answers, so queries and oracles splice the same ones
together from their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact, text
from ..operators import rewards, search, toolcalls
from ..sources import tables as t


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, completion, truth, number): answers in several spellings."""
    word = F.col("o_orderpriority")
    key = F.col("o_orderkey")
    spelled = (
        F.when(key % 4 == 0, F.concat(F.lit("So <ANSWER>\n "), word, F.lit(" </Answer> and <answer>no</answer>")))
        .when(key % 4 == 1, F.concat(F.lit("<answer>"), F.lower(word), F.lit("</answer>")))
        .when(key % 4 == 2, word)
        .otherwise(F.lit("<answer>R&amp;D &lt;b&gt;</answer>"))
    )
    digits = (key % 50).cast("string")
    number = (
        F.when(key % 5 == 0, F.concat(F.lit(" "), digits, F.lit(".0 ")))
        .when(key % 5 == 1, F.concat(F.lit("+"), digits))
        .when(key % 5 == 2, F.concat(digits, F.lit("e0")))
        .when(key % 5 == 3, F.concat(digits, F.lit("d")))
        .otherwise(F.lit("n/a"))
    )
    return t.load(spark, sf_dir, "orders").select(
        key.alias("id"), spelled.alias("completion"), word.alias("truth"),
        F.concat(F.lit("<answer>"), number, F.lit("</answer>")).alias("number_text"), (F.col("o_custkey") % 50).cast("string").alias("number_truth"),
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("<answer>The "), "p_name", F.lit(", a|"), "p_type", F.lit("</answer>")).alias("completion"),
        F.array("p_type", F.concat("p_name", F.lit("_the "), "p_brand")).alias("truths"),
    )


def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("id", text.answer(F.col("completion")).alias("answer"))


def token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.tokens(text.answer(F.col("completion")))
    return _parts(spark, sf_dir).select("id", F.array_join(F.array_sort(found), " ").alias("tokens"))


def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("id", text.normalized(text.answer(F.col("completion"))).alias("normalized"))


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t.load(spark, sf_dir, "pages")
    return pages.select("page_id", F.sha2(text.clean_html(F.col("html")), 256).alias("text_sha256"))


def tool_output_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(text.truncated(F.col("text"), 10_000), 256).alias("text_sha256"))


def reward_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("id", rewards.text_match(F.col("completion"), F.col("truth")).alias("reward"))


def reward_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("id", rewards.numeric_match(F.col("number_text"), F.col("number_truth")).alias("reward"))


def reward_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("id", F.round(rewards.token_iou(F.col("completion"), F.col("truths")), 6).alias("reward"))


def reward_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("id", F.round(rewards.token_f1(F.col("completion"), F.col("truths")[0]), 6).alias("reward"))


def reward_fanout_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    scored = rewards.fan_out(rows, {
        "text": rewards.text_match(F.col("completion"), F.col("truth")),
        "number": rewards.numeric_match(F.col("number_text"), F.col("number_truth")),
    })
    return scored.select("id", F.col("rewards")["text"].alias("text"), F.col("rewards")["number"].alias("number"), "total_reward")


def reward_group_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), (F.col("o_orderkey") % 7).cast("double").alias("reward")
    )
    return rewards.group_normalized(rows, "grp", "reward").select("id", F.round("advantage", 6).alias("advantage"))


def call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, text) with calls, of which some are broken, lack a name, or have arguments of another kind."""
    key = F.col("event_id")
    name = F.when(key % 7 == 3, F.lit("")).otherwise(F.col("event_type"))
    arguments = F.when(key % 11 == 5, F.lit("[1]")).otherwise(F.col("props"))
    one = F.concat(F.lit('<tool_call>\n{"name": "'), name, F.lit('", "arguments": '), arguments, F.lit("}\n</tool_call>"))
    other = F.when(key % 13 == 2, F.lit("<tool_call>{oops</tool_call>")).when(key % 3 == 0, F.lit("<tool_call>7</tool_call>")).otherwise("")
    return t.load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Let me see. "), one, other).alias("text"))


def tool_calls_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.calls(call_rows(spark, sf_dir), "text").select("event_id", "call", "name", "arguments", "error")


def search_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_products(t.products(spark, sf_dir), "brand#12")


def search_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_knowledge(t.knowledge(spark, sf_dir), "the", "src6", "en")


def wiki_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_articles(t.articles(spark, sf_dir), "the", 10).select("rank", "id", "hits")


def wiki_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = t.load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"), F.col("html").alias("extract"))
    first = titled.where("id = 0").select("title").first()
    return search.get_article(titled, first["title"] if first else "", 1000)


def safe_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t.load(spark, sf_dir, "lineitem")
    names = F.create_map(F.lit("q"), F.col("l_quantity"), F.lit("t"), F.col("l_tax"))
    value = exact.evaluate(F.lit("(q + 2) * 3 - q / 4 + t * 0"), names)
    return items.select("l_orderkey", "l_linenumber", F.round(value, 6).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        answer_extract, token_set, normalize_answer, html_clean, tool_output_truncate, reward_text_match, reward_numeric,
        reward_iou, reward_f1, reward_fanout_total, reward_group_norm, tool_calls_parse, search_products, search_knowledge,
        wiki_search_topk, wiki_article, safe_evaluate,
    )
}

_XML = "replace(replace(replace(replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_BARE = "regexp_replace(html, '<[^>]+>', '', 'g')"
_ORDERS = f"""o AS (SELECT o_orderkey AS id, o_orderpriority AS truth, CAST(o_custkey % 50 AS VARCHAR) AS number_truth,
  CASE o_orderkey % 4 WHEN 0 THEN 'So <ANSWER>' || chr(10) || ' ' || o_orderpriority || ' </Answer> and <answer>no</answer>'
    WHEN 1 THEN '<answer>' || lower(o_orderpriority) || '</answer>' WHEN 2 THEN o_orderpriority ELSE '<answer>R&amp;D &lt;b&gt;</answer>' END AS completion,
  CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey % 50 END AS number FROM orders),
a AS (SELECT *, lower(trim({_XML.format("regexp_extract(completion, '(?is)<answer>(.*?)</answer>', 1)")}, chr(10) || ' ')) AS answer,
  CAST(coalesce(number = CAST(number_truth AS BIGINT), false) AS DOUBLE) AS number_reward FROM o)"""
_PARTS = """p AS (SELECT p_partkey AS id, lower('The ' || p_name || ', a|' || p_type) AS answer, p_type AS t1, p_name || '_the ' || p_brand AS t2 FROM part)"""
_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[,\s|]+'), lambda x: x <> ''))"
_NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~´]', ' ', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"""
ORACLES = {
    "answer_extract": f"WITH {_ORDERS} SELECT id, answer FROM a",
    "token_set": f"WITH {_PARTS} SELECT id, array_to_string(list_sort({_TOKENS.format('answer')}), ' ') AS tokens FROM p",
    "normalize_answer": f"WITH {_PARTS} SELECT id, {_NORMAL.format('answer')} AS normalized FROM p",
    "html_clean": f"SELECT page_id, sha256({_XML.format(_BARE)}) AS text_sha256 FROM pages",
    "tool_output_truncate": "SELECT doc_id, sha256(CASE WHEN length(text) > 10000 THEN substring(text, 1, 10000) || '...' ELSE text END) AS text_sha256 FROM documents",
    "reward_text_match": f"WITH {_ORDERS} SELECT id, CAST(lower(truth) = answer AS DOUBLE) AS reward FROM a",
    "reward_numeric": f"WITH {_ORDERS} SELECT id, number_reward AS reward FROM a",
    "reward_iou": f"""WITH {_PARTS}, s AS (SELECT id, {_TOKENS.format('answer')} AS a, {_TOKENS.format("t1 || ' ' || t2")} AS b FROM p)
SELECT id, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 6) AS reward FROM s""",
    "reward_f1": f"""WITH {_PARTS}, n AS (SELECT id, string_split({_NORMAL.format('answer')}, ' ') AS a, string_split({_NORMAL.format('t1')}, ' ') AS b FROM p),
ca AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(a) AS w FROM n) GROUP BY ALL),
cb AS (SELECT id, w, count(*) AS c FROM (SELECT id, unnest(b) AS w FROM n) GROUP BY ALL),
s AS (SELECT ca.id, sum(least(ca.c, cb.c)) AS m FROM ca JOIN cb ON ca.id = cb.id AND ca.w = cb.w GROUP BY 1)
SELECT n.id, round(coalesce(2.0 * CAST(m AS DOUBLE) / (len(a) + len(b)), 0.0), 6) AS reward FROM n LEFT JOIN s ON s.id = n.id""",
    "reward_fanout_total": f"""WITH {_ORDERS} SELECT id, CAST(lower(truth) = answer AS DOUBLE) AS "text", number_reward AS "number",
  CAST(lower(truth) = answer AS DOUBLE) + number_reward AS total_reward FROM a""",
    "reward_group_norm": """SELECT o_orderkey AS id, round(CASE WHEN s > 0 THEN (o_orderkey % 7 - m) / s ELSE 0.0 END, 6) AS advantage
FROM (SELECT o_orderkey, avg(o_orderkey % 7) OVER w AS m, stddev_pop(o_orderkey % 7) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey))""",
    "tool_calls_parse": """WITH one AS (SELECT event_id, CAST(0 AS INTEGER) AS call, CASE WHEN event_id % 7 = 3 THEN '' ELSE event_type END AS name,
    CASE WHEN event_id % 11 = 5 THEN '[1]' ELSE replace(props, ': ', ':') END AS arguments FROM events WHERE event_id % 13 <> 2)
SELECT event_id, call, name, arguments, CASE WHEN name = '' THEN 'Error: Missing ''name'' field in tool command.'
  WHEN arguments = '[1]' THEN 'Error: ''arguments'' for ' || name || ' must be a JSON object.' END AS error FROM one
UNION ALL SELECT event_id, 1, NULL, NULL, 'Error: Tool command must be a JSON object.' FROM events WHERE event_id % 13 <> 2 AND event_id % 3 = 0""",
    "search_products": """SELECT p_partkey AS id, p_name AS name, p_brand || ' ' || p_type AS description FROM part
WHERE lower(p_name || chr(10) || p_brand || ' ' || p_type) LIKE '%brand#12%'""",
    "search_knowledge": """SELECT doc_id AS id, 'Note ' || doc_id AS title, coalesce(text, '') AS content FROM documents
WHERE source = 'src6' AND lang = 'en' AND contains(lower(concat_ws(chr(10), 'Note ' || doc_id, text)), 'the')""",
    "wiki_search_topk": f"""WITH c AS (SELECT page_id AS id, lower({_XML.format(_BARE)}) AS x FROM pages),
h AS (SELECT id, CAST((length(x) - length(replace(x, 'the', ''))) // 3 AS BIGINT) AS hits FROM c)
SELECT CAST(row_number() OVER (ORDER BY hits DESC, id) AS INTEGER) AS rank, id, hits FROM h WHERE hits > 0 ORDER BY hits DESC, id LIMIT 10""",
    "wiki_article": "SELECT page_id AS id, substring(html, 1, 1000) AS extract FROM pages WHERE url = (SELECT url FROM pages WHERE page_id = 0)",
    "safe_evaluate": "SELECT l_orderkey, l_linenumber, round((l_quantity + 2) * 3 - l_quantity / 4, 6) AS value FROM lineitem",
}
