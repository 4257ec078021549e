"""Full-text search over an inverted index: postings of (term, field, id, hits), sorted by term.

A term is a run of letters and digits, lower-cased. The index is a folder of
Parquet runs, whose rows are dealt to files by id, with their texts: words are
counted where they are and never exchanged. A file holds blocks of postings, each
sorted by term, so that the filter of a search, equal terms and prefixes, is pushed
into the scan and skips all other pages; a term that every row holds is in all files.
A search reads postings alone, once, whatever the number of its terms, and unites
them by id with a partial aggregation: each term sets a bit, and a clause matches
where all its bits are set.

A search text is a list of alternatives between ``OR``; in each all words must
occur (``AND`` may stand between them), and a word that ends in ``*`` matches
every term that begins with it. A word of several terms, like ``e-mail``, asks for
all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package

MOST_TERMS = 62  # one bit each
BLOCK_BYTES = 1 << 24  # of the texts of a block
OUT_ROWS = 1 << 16


def terms(text: Column) -> Column:
    """The terms of a text, with repeats, a space between them; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of all batches in blocks of ``BLOCK_BYTES`` of text, or of one longer text."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES - size, "right")))
            held.append(batch.slice(start, stop - start))
            size += ends[stop - 1] - before
            start = stop
            if start < len(ends) or size >= BLOCK_BYTES:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, field, id, hits) of rows (id, field, text), in each block by term."""
    for rows in _blocks(batches):
        said = pc.split_pattern(rows["text"].combine_chunks(), " ")
        words = said.flatten().dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        keys = rank[words.indices.to_numpy()] * len(rows) + pc.list_parent_indices(said).to_numpy()
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        hits = np.diff(np.append(first, len(keys)))
        for i in range(0, len(first), OUT_ROWS):
            term, row = np.divmod(keys[first[i : i + OUT_ROWS]], len(rows))
            own = rows.select(["field", "id"]).take(pa.array(row)).combine_chunks()
            found = [words.dictionary.take(pa.array(order[term])), *(own[c].combine_chunks() for c in own.column_names), pa.array(hits[i : i + OUT_ROWS])]
            yield pa.RecordBatch.from_arrays(found, ["term", "field", "id", "hits"])


def add(rows: DataFrame, path: str, id_col: str, fields: dict[str, Column]) -> None:
    """Add a run with the postings of ``rows`` to the index; their ids are new to it."""
    each = [F.struct(F.lit(name).alias("field"), text.cast("string").alias("text")) for name, text in fields.items()]
    dealt = rows.select(F.col(id_col).alias("id"), F.array(*each).alias("texts")).repartition("id")
    said = dealt.select("id", F.explode("texts").alias("x")).select("id", F.col("x.field").alias("field"), terms(F.col("x.text")).alias("text"))
    kinds = StructType().add("term", "string").add("field", "string").add("id", said.schema["id"].dataType).add("hits", "long")
    ship_package(rows.sparkSession)
    said.where("text <> ''").mapInArrow(_postings, kinds).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def clauses(text: str) -> list[list[str]]:
    """The words of each alternative; ValueError without any, or with too many."""
    words = lambda part: [w for w in part.split() if w != "AND" and re.search(r"[^\W_]", w)]
    found = [c for c in (words(part) for part in re.split(r"(?:^|\s)OR(?=\s|$)", text or "")) if c]
    if not found:
        raise ValueError("search_term cannot be empty")
    if len({w for c in found for w in c}) > MOST_TERMS:
        raise ValueError(f"a search has at most {MOST_TERMS} terms")
    return found


def _parts(word: str) -> list[tuple[str, bool]]:
    """(term, whether it is a prefix) of a word; only its last term may be one."""
    found = [w for w in re.split(r"[\W_]+", word.lower()) if w]
    return [(w, i == len(found) - 1 and word.endswith("*")) for i, w in enumerate(found)]


def search(index: DataFrame, text: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """(id, hits) of the rows that match ``text`` in any field, or in those given; hits counts the occurrences of its words."""
    wanted = [sorted({p for w in c for p in _parts(w)}) for c in clauses(text)]
    bits = {p: 1 << i for i, p in enumerate(sorted({p for c in wanted for p in c}))}
    match = {p: F.col("term").startswith(p[0]) if p[1] else F.col("term") == p[0] for p in bits}
    rows = index.where(reduce(or_, match.values()))
    if fields:
        rows = rows.where(F.col("field").isin(*fields))
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(match[p], F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")) for p, bit in bits.items()])
    met = rows.groupBy("id").agg(F.bit_or(mask).alias("mask"), F.sum("hits").alias("hits"))
    needs = [sum(bits[p] for p in c) for c in wanted]
    return met.where(reduce(or_, [F.col("mask").bitwiseAND(n) == n for n in needs])).select("id", "hits")


def find(indexes: dict[str, DataFrame], text: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """(object, id, hits) over several indexes, ids as texts: an ad-hoc search of everything."""
    found = [search(i, text, fields).select(F.lit(name).alias("object"), F.col("id").cast("string").alias("id"), "hits") for name, i in indexes.items()]
    return reduce(DataFrame.unionByName, found)
