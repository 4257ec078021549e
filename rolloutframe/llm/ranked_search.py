"""Ranked lexical search, score at a time over impact-ordered postings.

The documents are scanned once: each becomes one small row of its length and the
query terms it holds, and these rows are written. From them come the counts that
the scores need (documents, terms, documents of each query term), over the whole
table. Then every task indexes its own documents in blocks: the postings of a
term are grouped by exact impact, largest first. An item takes the groups of all
its terms in descending impact, whatever their term, and adds them up document by
document. What a document can still gain is at most the sum of the terms' next
impacts, so the walk stops once that sum proves that nothing outside a few
candidates can be among the best; the candidates' scores are then completed from
their own postings. Nothing is approximate. Later blocks of a task start from the
scores that earlier ones reached.

Documents are never shuffled, and no term is a key: a word that every document
holds costs what its postings cost, wherever they are. A block hands on at most
``k`` documents of each item; ranks are taken within salted parts first.

Items are read in parts of at most ``part_bytes`` of text, measured before they
are read (a larger single item is a part of its own), and each part is answered
by a scan of its own.

Defined cases: a null text has no terms; documents without terms count nowhere
and are never found; rows that repeat a document id are documents of their own,
and a null id sorts after all others; rows that repeat an item id are one item
with the terms of them all; items with a null id or without terms have no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import on_workers, stage, union_all
from .words import ALPHANUMERIC, Words, slices, words_of

K, PART_BYTES, BLOCK_DOCS, BLOCK_POSTINGS, SALTS = 10, 8 << 20, 1 << 16, 1 << 22, 64
FEW, FIRST_STEP = 64, 1024
_FILTER_BITS = 20


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, … of every span, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Terms:
    """The distinct terms of some items, and the terms of each item by number."""

    def __init__(self, ids: list[str], texts: list[str]):
        words = words_of(pa.array(texts, pa.string()), ALPHANUMERIC, lower=True)
        self.keys, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.starts, self.ends, self.data = words.starts[first], words.ends[first], words.data
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self.keys >> np.uint64(64 - _FILTER_BITS)] = True
        self.ids, place = np.unique(np.array(ids, dtype=object), return_inverse=True)
        owner = place[words.doc_of()] if len(number) else number
        pairs = np.unique(np.stack([owner, number]), axis=1) if len(number) else np.empty((2, 0), np.int64)
        border = np.searchsorted(pairs[0], np.arange(len(self.ids) + 1))
        self.items = [pairs[1, a:b] for a, b in zip(border[:-1], border[1:], strict=True)]

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(places of words, numbers of terms) of the words that are terms, byte for byte."""
        at = np.flatnonzero(self.bits[words.hashes >> np.uint64(64 - _FILTER_BITS)])
        number = np.minimum(np.searchsorted(self.keys, words.hashes[at]), len(self.keys) - 1)
        size = words.ends[at] - words.starts[at]
        ok = (self.keys[number] == words.hashes[at]) & (self.ends[number] - self.starts[number] == size)
        at, number, size = at[ok], number[ok], size[ok]
        differs = words.data[_spans(words.starts[at], size)] != self.data[_spans(self.starts[number], size)]
        if differs.any():
            ok = np.bincount(np.repeat(np.arange(len(at)), size)[differs], minlength=len(at)) == 0
            at, number = at[ok], number[ok]
        return at, number


def _counted(terms):
    """(id, n, terms, tfs) of every document with terms; ``terms`` is a broadcast."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words = words_of(batch.column(1), ALPHANUMERIC, lower=True)
            at, number = terms.value.find(words)
            doc = np.searchsorted(words.first, at, "right") - 1
            pair, tf = np.unique(doc * len(terms.value.keys) + number, return_counts=True)
            doc, number = np.divmod(pair, max(1, len(terms.value.keys)))
            some = np.flatnonzero(words.counts)
            border = pa.array(np.append(np.searchsorted(doc, some), len(doc)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array(words.counts[some]),
                 pa.ListArray.from_arrays(border, pa.array(number.astype(np.int32))),
                 pa.ListArray.from_arrays(border, pa.array(tf.astype(np.int32)))],
                ["id", "n", "terms", "tfs"],
            )

    return emit


def weights(n_docs: int, seen: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in seen], np.int64)


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 90 + (90 n N) div L of each document length."""
    if int(n.max(initial=0)) * n_docs * 90 < 1 << 63:
        return 10 + (90 * n * n_docs) // n_terms
    return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)


class Block:
    """Postings of some documents, by document and, grouped by exact impact, by term."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        doc = np.repeat(np.arange(len(n)), sizes)
        tf = tf.astype(np.int64)
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * lengths(n, n_docs, n_terms)[doc]))
        some = impact > 0
        self.own_term, self.own_impact, doc = term[some], impact[some], doc[some]
        self.own = np.searchsorted(doc, np.arange(len(n) + 1))
        order = np.lexsort((-self.own_impact, self.own_term))
        term, impact = self.own_term[order], self.own_impact[order]
        self.docs = doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(order)))
        self.impact = impact[self.start]  # of each group
        self.first = np.searchsorted(term[self.start], np.arange(len(weight) + 1))  # groups of each term
        self.member = np.zeros(len(weight), bool)

    def __len__(self) -> int:
        return len(self.own) - 1

    def search(self, terms: np.ndarray, k: int, reached: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read): all that can be among the ``k`` best and score ``reached`` or more."""
        count = self.first[terms + 1] - self.first[terms]
        terms, count = terms[count > 0], count[count > 0]
        groups = _spans(self.first[terms], count)
        of = np.repeat(np.arange(len(terms)), count)
        order = np.argsort(-self.impact[groups], kind="stable")
        groups, of = groups[order], of[order]
        total = np.cumsum(self.size[groups])
        score, done, step = np.zeros(len(self), np.int64), 0, FIRST_STEP
        taken = np.zeros(len(terms), np.int64)
        while done < len(groups):
            read = int(total[done - 1]) if done else 0
            to = max(done + 1, int(np.searchsorted(total, read + step, "right")))
            some, step = groups[done:to], step * 4
            np.add.at(score, self.docs[_spans(self.start[some], self.size[some])], np.repeat(self.impact[some], self.size[some]))
            taken += np.bincount(of[done:to], minlength=len(terms))
            done = to
            left = taken < count
            rest = int(self.impact[(self.first[terms] + taken)[left]].sum())
            if len(score) >= k:
                reached = max(reached, int(np.partition(score, len(score) - k)[len(score) - k]))
            if rest < reached:  # a document not met yet scores at most ``rest``
                candidates = np.flatnonzero(score + rest >= reached)
                if len(candidates) <= max(FEW, 2 * k):
                    return (*self._completed(candidates, terms, reached), int(total[done - 1]))
        found = np.flatnonzero(score >= max(1, reached))
        return found, score[found], int(total[-1]) if len(total) else 0

    def _completed(self, docs: np.ndarray, terms: np.ndarray, reached: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates and their whole scores, from their own postings."""
        size = self.own[docs + 1] - self.own[docs]
        at = _spans(self.own[docs], size)
        self.member[terms] = True
        gain = np.where(self.member[self.own_term[at]], self.own_impact[at], 0)
        self.member[terms] = False
        score = np.zeros(len(docs), np.int64)
        np.add.at(score, np.repeat(np.arange(len(docs)), size), gain)
        ok = score >= max(1, reached)
        return docs[ok], score[ok]


def _ranked(held, k: int, block_docs: int, block_postings: int):
    """(item, id, score): the ``k`` best of each block for each item; ``held`` broadcasts (items, weights, N, L)."""

    def answered(rows: list[pa.RecordBatch], reached: np.ndarray) -> pa.RecordBatch:
        items, weight, n_docs, n_terms = held.value
        table = pa.Table.from_batches(rows).combine_chunks()
        ids, n, terms, tfs = (c.chunk(0) for c in table.columns)
        sizes = np.diff(np.asarray(terms.offsets))
        block = Block(np.asarray(n), sizes, np.asarray(terms.flatten()), np.asarray(tfs.flatten()), weight, n_docs, n_terms)
        place = np.empty(len(ids), np.int64)
        place[np.asarray(pc.array_sort_indices(ids))] = np.arange(len(ids))  # nulls come last
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 3]
        for i, own in enumerate(items):
            docs, score, _ = block.search(own, k, int(reached[i, -1]))
            best = np.lexsort((place[docs], -score))[:k]
            docs, score = docs[best], score[best]
            reached[i] = -np.sort(-np.concatenate([reached[i], score]))[:k]
            out.append((np.full(len(docs), i), docs, score))
        item, docs, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(docs)), pa.array(score)], ["item", "id", "score"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = np.zeros((len(held.value[0]), k), np.int64)
        rows: list[pa.RecordBatch] = []
        docs = postings = 0
        for batch in batches:
            at, sizes = 0, np.cumsum(np.asarray(pc.list_value_length(batch.column(2)), dtype=np.int64))
            while at < len(batch):
                before = int(sizes[at - 1]) if at else 0
                room = int(np.searchsorted(sizes, before + block_postings - postings, "right")) - at
                take = min(len(batch) - at, block_docs - docs, max(room, not rows))
                if take:
                    rows.append(batch.slice(at, take))
                    docs, postings, at = docs + take, postings + int(sizes[at + take - 1]) - before, at + take
                if at < len(batch):
                    yield answered(rows, reached)
                    rows, docs, postings = [], 0, 0
        if rows:
            yield answered(rows, reached)

    return emit


def _parts(items: DataFrame, item_id: str, item_text: str, part_bytes: int) -> Iterator[list]:
    """The items' distinct rows in parts of about ``part_bytes`` of text, all rows of an id in one."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where(
        F.col("i").isNotNull() & F.col("t").isNotNull()
    ).distinct()
    size = F.coalesce(F.sum(F.octet_length("t")), F.lit(0))
    total = rows.agg(size).first()[0]
    bucket = F.pmod(F.xxhash64("i"), F.lit(max(1, -(-4 * total // part_bytes))))
    held: list[int] = []
    room = part_bytes
    for number, used in sorted(map(tuple, rows.groupBy(bucket).agg(size).collect())):
        if held and used > room:
            yield rows.where(bucket.isin(held)).collect()
            held, room = [], part_bytes
        held.append(number)
        room -= used
    if held:
        yield rows.where(bucket.isin(held)).collect()


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = K,
    part_bytes: int = PART_BYTES,
    block_docs: int = BLOCK_DOCS,
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """(item_id, rank, id_col, score): the ``k`` documents of each item with the highest scores above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = dict(rows.dtypes)["id"], dict(items.select(item_id).dtypes)[item_id]
    on_workers(rows)
    found = [spark.createDataFrame([], f"item string, id {kind}, score long")]
    for part in _parts(items, item_id, item_text, part_bytes):
        terms = Terms([r["i"] for r in part], [r["t"] for r in part])
        if not len(terms.keys):
            continue
        known = spark.sparkContext.broadcast(terms)
        index = stage(rows.mapInArrow(_counted(known), f"id {kind}, n long, terms array<int>, tfs array<int>"), "query-postings")
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            return found[0].select(F.col("item").cast(item_kind).alias(item_id), F.lit(1).alias("rank"), F.col("id").alias(id_col), "score")
        seen = np.zeros(len(terms.keys), np.int64)
        holding = index.select(F.explode("terms").alias("term")).groupBy("term").count()
        for term, df in holding.collect():  # the items' terms, a part's worth
            seen[term] = df
        held = spark.sparkContext.broadcast((terms.items, weights(n_docs, seen), n_docs, n_terms))
        best = index.where(F.size("terms") > 0).mapInArrow(
            _ranked(held, k, block_docs, block_postings), f"item long, id {kind}, score long"
        )
        names = spark.createDataFrame(list(enumerate(terms.ids.tolist())), "item long, name string")
        found.append(best.join(F.broadcast(names), "item").select(F.col("name").alias("item"), "id", "score"))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    some = union_all(found).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return (
        some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        .select(F.col("item").cast(item_kind).alias(item_id), "rank", F.col("id").alias(id_col), "score")
    )


ORACLE_SQL = r"""
WITH dt AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS w FROM documents),
lengths AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM dt WHERE len(w) > 0),
whole AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM lengths),
post AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, t, CAST(count(*) AS BIGINT) AS tf
         FROM (SELECT r, doc_id, n, unnest(w) AS t FROM lengths) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM post GROUP BY t),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM df, whole),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')) AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
scored AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
         CAST(sum(w * ((1000000000::BIGINT * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM it JOIN post USING (t) JOIN weight USING (t), whole GROUP BY item_id, r),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
