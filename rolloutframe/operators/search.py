"""Text search over products, knowledge and articles.

A term matches where the lower-cased fields hold the lower-cased term.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_html, truncated


SNIPPET, BEFORE = 120, 30


def _needle(term: str) -> Column:
    if not term or not term.strip():
        raise ValueError("a search needs a term")
    return F.lower(F.lit(term.strip()))


def matching(rows: DataFrame, term: str, *fields: str) -> DataFrame:
    return rows.where(F.lower(F.concat_ws("\n", *fields)).contains(_needle(term)))


def search_products(products: DataFrame, term: str) -> DataFrame:
    return matching(products, term, "name", "description").select("id", "name", "description")


def search_knowledge(articles: DataFrame, term: str, status: str = "Online", language: str = "en_US") -> DataFrame:
    """Published articles of one language whose title or answer holds the term; a missing one is empty."""
    own = articles.where((F.col("publish_status") == status) & (F.col("language") == language))
    shown = [F.coalesce(c, F.lit("")).alias(name) for c, name in (("title", "title"), ("faq_answer", "content"))]
    return matching(own, term, "title", "faq_answer").select("id", *shown)


def search_articles(articles: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """The ``limit`` articles that hold the term most often: (rank, id, title, hits, snippet).

    A snippet is ``SNIPPET`` code points of the text, from a little before the first hit on. Spark keeps the top rows of each partition alone; only those meet for the ranks.
    """
    needle = _needle(term)
    plain = articles.select("id", clean_html(F.col("title")).alias("title"), clean_html(F.col("extract")).alias("plain"))
    text = F.lower("plain")
    at = F.greatest(F.lit(1), F.instr(text, term.strip().lower()) - BEFORE)
    hits = ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")
    snippet = F.substring("plain", at, F.lit(SNIPPET))
    found = plain.select("id", "title", hits.alias("hits"), snippet.alias("snippet")).where("hits > 0")
    top = found.orderBy(F.desc("hits"), "id").limit(limit)
    order = F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("lost"), "id", "title", "hits", "snippet")))
    return top.agg(order.alias("found")).select(F.posexplode("found").alias("at", "x")).select(
        (F.col("at") + 1).alias("rank"), "x.id", "x.title", "x.hits", "x.snippet"
    )


def hit_list(hits: DataFrame) -> DataFrame:
    """One text: numbered titles and snippets, a blank line between; says so where there are none."""
    title, snippet = (F.coalesce(c, F.lit("")) for c in ("title", "snippet"))
    entry = F.concat(F.col("rank").cast("string"), F.lit(". "), title, F.lit("\n   "), snippet)
    listed = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return hits.agg(
        F.when(F.count(F.lit(1)) == 0, F.lit("No results found."))
        .otherwise(F.array_join(F.transform(listed, lambda x: x["entry"]), "\n\n"))
        .alias("text")
    )


def search_text(articles: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """(text): the hits as a model reads them, or why there are none."""
    if not term or not term.strip():
        return articles.sparkSession.createDataFrame([("Error: Missing required parameter: 'q'",)], "text string")
    return hit_list(search_articles(articles, term, limit))


def article_texts(
    asked: DataFrame, articles: DataFrame, max_chars: int = 10_000, redirects: DataFrame | None = None, within: tuple[str, ...] = ()
) -> DataFrame:
    """``asked`` (title, ...) with ``text``: the article of each title, or why there is none.

    ``redirects``: (title, target), followed once; of several, the least target. All
    three tables have the columns ``within``, and titles are looked up among rows
    that are equal in them: other articles may share a title. Of those that do not
    differ even there, the one of the least id counts.
    """
    own = [f"_in{i}" for i in range(len(within))]

    def met(title: str, key: str) -> Column:
        return reduce(and_, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(within, own, strict=True)], F.col(title) == F.col(key))

    def keyed(key: str) -> list[Column]:
        return [F.col("title").alias(key), *[F.col(c).alias(k) for c, k in zip(within, own, strict=True)]]

    named = asked.withColumn("_wanted", F.col("title"))
    if redirects is not None:
        moved = redirects.groupBy(*keyed("_from")).agg(F.min("target").alias("_to"))
        named = named.join(moved, met("title", "_from"), "left").withColumn("_wanted", F.coalesce("_to", "title")).drop("_from", "_to", *own)
    pages = articles.groupBy(*keyed("_title")).agg(F.min_by(F.struct("extract"), "id").alias("_page"))
    found = named.join(pages, met("_wanted", "_title"), "left")
    extract = F.col("_page.extract")
    text = (
        F.when(F.coalesce(F.col("title"), F.lit("")) == "", "Error: Missing required parameter: 'title'")
        .when(F.col("_title").isNull(), F.format_string("Error: No pages found for title '%s'", F.col("title")))
        .when(extract.isNull(), F.format_string("Error: No extract found for '%s'", F.col("title")))
        .otherwise(truncated(extract, max_chars, ""))
    )
    return found.withColumn("text", text).drop("_wanted", "_title", "_page", *own)


def get_article(articles: DataFrame, title: str, max_chars: int = 10_000) -> DataFrame:
    return articles.where(F.col("title") == title).select("id", truncated(F.col("extract"), max_chars, "").alias("extract"))
