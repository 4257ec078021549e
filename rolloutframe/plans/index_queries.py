"""Searches that read an inverted index of products and knowledge."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text_index
from ..session import shared_folder
from ..sources import tables as t


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/product-index-{uuid.uuid4().hex}"
    products = t.products(spark, sf_dir)
    fields = {"name": F.col("name"), "description": F.col("description")}
    text_index.add(products.where("id % 2 = 0"), path, "id", fields)
    text_index.add(products.where("id % 2 = 1"), path, "id", fields)  # a second run
    return text_index.read(spark, path)


def _knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/knowledge-index-{uuid.uuid4().hex}"
    text_index.add(t.knowledge(spark, sf_dir), path, "id", {"title": F.col("title"), "content": F.col("faq_answer")})
    return text_index.read(spark, path)


def index_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields: two alternatives, one with a prefix."""
    return text_index.search(_products(spark, sf_dir), "Brand AND 2* OR copper")


def index_products_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index.search(_products(spark, sf_dir), "brand 1*", ("description",))


def index_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published articles alone: the index finds ids, which filter the rows."""
    found = text_index.search(_knowledge(spark, sf_dir), "note th* OR 17")
    own = t.knowledge(spark, sf_dir).where("language = 'en'").select("id", "title")
    return own.join(found, "id")


def index_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text over everything."""
    return text_index.find({"Product": _products(spark, sf_dir), "Knowledge": _knowledge(spark, sf_dir)}, "brand OR note AND 12*")


QUERIES = {f.__name__: f for f in (index_products, index_products_by_field, index_knowledge, index_find)}

_TERMS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _said(rows: str, *fields: tuple[str, str]) -> str:
    """(id, field, w) of every word of the fields."""
    return " UNION ALL ".join(f"SELECT id, '{name}' AS field, unnest({_TERMS.format(text)}) AS w FROM {rows}" for name, text in fields)


_PRODUCTS = f"""prod AS (SELECT p_partkey AS id, p_name AS name, p_brand || ' ' || p_type AS description FROM part),
pw AS ({_said('prod', ('name', 'name'), ('description', 'description'))})"""
_KNOWLEDGE = f"""know AS (SELECT doc_id AS id, 'Note ' || doc_id AS title, text, lang FROM documents),
kw AS ({_said('know', ('title', 'title'), ('content', 'text'))})"""
ORACLES = {
    "index_products": f"""WITH {_PRODUCTS} SELECT id, count(*) AS hits FROM pw WHERE w IN ('brand', 'copper') OR starts_with(w, '2') GROUP BY id
HAVING bool_or(w = 'copper') OR (bool_or(w = 'brand') AND bool_or(starts_with(w, '2')))""",
    "index_products_by_field": f"""WITH {_PRODUCTS} SELECT id, count(*) AS hits FROM pw WHERE field = 'description' AND (w = 'brand' OR starts_with(w, '1')) GROUP BY id
HAVING bool_or(w = 'brand') AND bool_or(starts_with(w, '1'))""",
    "index_knowledge": f"""WITH {_KNOWLEDGE}, m AS (SELECT id, count(*) AS hits FROM kw WHERE w IN ('note', '17') OR starts_with(w, 'th') GROUP BY id
HAVING bool_or(w = '17') OR (bool_or(w = 'note') AND bool_or(starts_with(w, 'th')))) SELECT id, title, hits FROM m JOIN know USING (id) WHERE lang = 'en'""",
    "index_find": f"""WITH {_PRODUCTS}, {_KNOWLEDGE}
SELECT 'Product' AS object, CAST(id AS VARCHAR) AS id, count(*) AS hits FROM pw WHERE w IN ('brand', 'note') OR starts_with(w, '12') GROUP BY id
HAVING bool_or(w = 'brand') OR (bool_or(w = 'note') AND bool_or(starts_with(w, '12')))
UNION ALL SELECT 'Knowledge', CAST(id AS VARCHAR), count(*) FROM kw WHERE w IN ('brand', 'note') OR starts_with(w, '12') GROUP BY id
HAVING bool_or(w = 'brand') OR (bool_or(w = 'note') AND bool_or(starts_with(w, '12')))""",
}
