"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (an item of fewer
words is one window). To contain it, a document must contain each of its word
shingles; so for exact containment a prefix of one shingle is necessary, and
the window's rarest shingle, counted over the whole corpus, serves. A document
shingle that equals one is a candidate; its place and the shingle's place in the
window fix where the window would start. It must start inside the document and
end there (the positional and the length bound); then every word is compared.

The benchmark is broadcast in parts of at most ``part_bytes`` of text, measured
before it is read (a larger single item is a part of its own). A benchmark of
one part takes two scans of the documents, one to count and one to mark, and no
document is shuffled. Of more parts, each is read, used and released in turn:
the documents are written once with row numbers, every part writes the hits it
finds (row, hit words, items), and these rows are joined at the end, by broadcast
where all of them are smaller than a part.

Defined cases: a null text has no words; a very long text is marked whole; a
null or repeated document id is a row like any other; rows that repeat an item
id are one item; an item without words or id is none; an empty benchmark marks
nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, stage, union_all
from .words import ALPHANUMERIC, Words, slices, words_of

WINDOW, SHINGLE, PART_BYTES, BUCKETS = 13, 5, 16 << 20, 8
_FILTER_BITS = 20
HITS = "row long, bits binary, names array<string>"
OUT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class _Keys:
    """Sorted 64-bit keys behind a bit filter."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in values, numbers of keys) of the values that are keys."""
        at = np.flatnonzero(self.bits[values >> np.uint64(64 - _FILTER_BITS)])
        number = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        same = self.keys[number] == values[at]
        return at[same], number[same]


class _Items:
    """A part of the benchmark: its words and its windows."""

    def __init__(self, ids: list[str], texts: list[str], window: int, shingle: int):
        self.ids = np.array(ids, dtype=object)
        self.words = words_of(pa.array(texts, pa.string()), ALPHANUMERIC, lower=True)
        counts = self.words.counts
        n = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
        self.item = np.repeat(np.arange(len(counts)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.start = self.words.first[self.item] + within
        self.length = np.minimum(counts[self.item], window)
        self.size = np.minimum(self.length, shingle)
        self.sizes = sorted({int(s) for s in np.unique(self.size)})
        self.keys = {s: _Keys(self._grams(s)) for s in self.sizes}

    def _grams(self, size: int) -> np.ndarray:
        """Hashes of all shingles of ``size`` words inside windows that use that size."""
        grams = self.words.ngrams(size)
        mine = np.flatnonzero(self.size == size)
        n = self.length[mine] - size + 1
        at = np.repeat(self.start[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return grams[at]

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep each window's rarest shingle, by (size, number of key) -> count."""
        self.lead, self.of, self.border, self.windows = {}, {}, {}, {}
        for s in self.sizes:
            seen = np.array([counts.get((s, k), 0) for k in range(len(self.keys[s].keys))], np.int64)
            grams, mine = self.words.ngrams(s), np.flatnonzero(self.size == s)
            best, lead = np.full(len(mine), np.iinfo(np.int64).max), np.zeros(len(mine), np.int64)
            for j in range(int((self.length[mine] - s).max()) + 1):
                ok = self.length[mine] - s >= j
                number = np.searchsorted(self.keys[s].keys, grams[self.start[mine[ok]] + j])
                cost = np.full(len(mine), np.iinfo(np.int64).max)
                cost[ok] = seen[number]
                better = cost < best
                best[better], lead[better] = cost[better], j
            chosen = grams[self.start[mine] + lead]
            order = np.argsort(chosen, kind="stable")
            self.of[s] = _Keys(chosen)
            self.windows[s], self.lead[s] = mine[order], lead[order]
            self.border[s] = np.append(np.searchsorted(chosen[order], self.of[s].keys), len(order))

    def matches(self, docs: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word at which it starts, window) of every window that a document holds."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        room, doc = docs.room(), docs.doc_of()
        for s in self.sizes:
            at, key = self.of[s].find(docs.ngrams(s))
            n = self.border[s][key + 1] - self.border[s][key]
            pick = np.repeat(self.border[s][key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, window = np.repeat(at, n), self.windows[s][pick]
            begin = at - self.lead[s][pick]
            ok = begin >= docs.first[doc[at]] if len(at) else np.empty(0, bool)
            begin, window = begin[ok], window[ok]
            ok = room[begin] >= self.length[window]
            found.append((begin[ok], window[ok]))
        begin, window = (np.concatenate(x) for x in zip(*found, strict=True))
        return self._verified(docs, begin, window)

    def _verified(self, docs: Words, begin: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Compare hashes word by word, then the bytes of the words."""
        for j in range(int(self.length.max()) if len(window) else 0):
            inside = self.length[window] > j
            b, w = np.where(inside, begin + j, begin), np.where(inside, self.start[window] + j, self.start[window])
            ok = ~inside | (docs.hashes[b] == self.words.hashes[w])
            begin, window = begin[ok], window[ok]
        if not len(window):
            return begin, window
        n = self.length[window]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = np.repeat(begin, n) + step, np.repeat(self.start[window], n) + step
        size = docs.ends[a] - docs.starts[a]
        equal = size == self.words.ends[b] - self.words.starts[b]
        size = np.where(equal, size, 0)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        differs = docs.data[np.repeat(docs.starts[a], size) + step] != self.words.data[np.repeat(self.words.starts[b], size) + step]
        equal &= np.bincount(np.repeat(np.arange(len(a)), size)[differs], minlength=len(a)) == 0
        ok = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return begin[ok], window[ok]


def _parts(items: DataFrame, item_id: str, item_text: str, part_bytes: int) -> Iterator[list]:
    """The benchmark's distinct rows in parts of at most ``part_bytes`` of text, one at a time.

    Rows are dealt to hash buckets, more of them than parts; their sizes are
    measured, and whole buckets fill a part. A bucket that is too large is dealt again.
    """
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where(
        F.col("i").isNotNull() & F.col("t").isNotNull()
    )
    todo = [(rows.distinct(), 0)]
    while todo:
        some, salt = todo.pop()
        size = F.sum(F.octet_length("t"))
        total, n = some.agg(F.coalesce(size, F.lit(0)), F.count(F.lit(1))).first()
        if not n:
            continue
        if total <= part_bytes or n == 1:
            yield some.collect()
            continue
        bucket = F.pmod(F.xxhash64(F.lit(salt), "i", "t"), F.lit(max(2, BUCKETS * total // part_bytes)))
        held: list[int] = []
        room = part_bytes
        for number, used in sorted(map(tuple, some.groupBy(bucket).agg(size).collect())):
            if used > part_bytes:
                todo.append((some.where(bucket == number), salt + 1))
                continue
            if used > room:
                yield some.where(bucket.isin(held)).collect()
                held, room = [], part_bytes
            held.append(number)
            room -= used
        if held:
            yield some.where(bucket.isin(held)).collect()


def _key_counts(docs: DataFrame, part: _Items) -> dict[tuple[int, int], int]:
    """How often the corpus holds each shingle of the benchmark part."""
    held = docs.sparkSession.sparkContext.broadcast(part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = held.value
        seen = {s: np.zeros(len(part.keys[s].keys), np.int64) for s in part.sizes}
        for batch in slices(batches, 0):
            words = words_of(batch.column(0), ALPHANUMERIC, lower=True)
            room = words.room()
            for s in part.sizes:
                at, key = part.keys[s].find(words.ngrams(s))
                np.add.at(seen[s], key[room[at] >= s], 1)
        for s in part.sizes:
            key = np.flatnonzero(seen[s])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), s)), pa.array(key), pa.array(seen[s][key])], ["size", "key", "n"]
            )

    found = on_workers(docs).mapInArrow(count, "size long, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n"))
    counts = {(r["size"], r["key"]): r["n"] for r in found.collect()}
    held.destroy()
    return counts


def _found(part: _Items | None, words: Words, n: int) -> tuple[np.ndarray, list[set]]:
    """(hit words, items of each of the ``n`` documents) of one part."""
    cover = np.zeros(len(words.starts) + 1, np.int64)
    names: list[set] = [set() for _ in range(n)]
    if part is not None:
        begin, window = part.matches(words)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + part.length[window], -1)
        pairs = np.unique(np.stack([words.doc_of()[begin], part.item[window]]), axis=1)
        for d, i in zip(*pairs.tolist(), strict=True):
            names[d].add(part.ids[i])
    return np.cumsum(cover[:-1]) > 0, names


def _hits(held: Broadcast):
    """(row, bits, names) of the documents in which the part occurs; bits: which words are hit."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            words = words_of(batch.column(0), ALPHANUMERIC, lower=True)
            hit, names = _found(held.value, words, len(batch))
            some = [d for d, x in enumerate(names) if x]
            bits = [np.packbits(hit[words.first[d] : words.first[d + 1]]).tobytes() for d in some]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(some, pa.int64())), pa.array(bits, pa.binary()),
                 pa.array([sorted(names[d]) for d in some], pa.list_(pa.string()))],
                ["row", "bits", "names"],
            )

    return emit


def _marker(held: Broadcast | None, kept: int, known: bool):
    """The result columns, from one part or from ``known`` hits in the last two columns."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            words = words_of(batch.column(0), ALPHANUMERIC, lower=True)
            hit, names = _found(held.value if held else None, words, len(batch))
            if known:
                bits, lists = batch.column(1 + kept).to_pylist(), batch.column(2 + kept).to_pylist()
                for d in [d for d, x in enumerate(bits) if x]:
                    own = hit[words.first[d] : words.first[d + 1]]
                    for packed in bits[d]:
                        own |= np.unpackbits(np.frombuffer(packed, np.uint8), count=len(own)).astype(bool)
                    names[d] = {name for part in lists[d] for name in part}
            total = np.append(0, np.cumsum(hit))
            n_hit = total[words.first[1:]] - total[words.first[:-1]]
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1 : 1 + kept], pa.array(words.counts), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()),
                 pa.array(sha), pa.array((n_hit > 0) & (20 * n_hit >= words.counts))],
                [*batch.schema.names[1 : 1 + kept], "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return mark


def mark_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    part_bytes: int = PART_BYTES,
    keep_text: bool = False,
) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated) of every row.

    ``contaminated``: at least one word in twenty lies in a window. With
    ``keep_text`` all columns of ``docs`` come first, unchanged, but for those
    named like a result, which are replaced.
    """
    results = [x.split()[0] for x in OUT.split(", ")]
    kept = [c for c in docs.columns if c not in results] if keep_text else [id_col]
    taken = docs.select(F.col(text_col).cast("string").alias("_t"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)])
    carried = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in taken.schema.fields[1:])
    spark = docs.sparkSession
    on_workers(taken)
    parts = _parts(items, item_id, item_text, part_bytes)

    def prepared(rows: list, texts: DataFrame) -> _Items:
        part = _Items([r["i"] for r in rows], [r["t"] for r in rows], window, shingle)
        if len(part.item):
            part.choose(_key_counts(texts, part))
        return part

    first, second = next(parts, None), next(parts, None)
    if second is None:
        part = prepared(first, taken.select("_t")) if first else None
        held = spark.sparkContext.broadcast(part) if part and len(part.item) else None
        rows = taken.mapInArrow(_marker(held, len(kept), False), f"{carried}, {OUT}")
    else:
        numbered = stage(taken.withColumn("_r", F.monotonically_increasing_id()), "numbered")
        found = []
        for some in chain((first, second), parts):
            part = prepared(some, numbered.select("_t"))
            if len(part.item):
                held = spark.sparkContext.broadcast(part)
                found.append(stage(numbered.select("_t", "_r").mapInArrow(_hits(held), HITS), "hits"))
                held.destroy()
        hits = union_all(found) if found else spark.createDataFrame([], HITS)
        size = F.octet_length("bits") + F.octet_length(F.array_join("names", ",")) + 64
        few = (hits.agg(F.sum(size)).first()[0] or 0) <= part_bytes
        hits = hits.groupBy("row").agg(F.collect_list("bits").alias("_bits"), F.collect_list("names").alias("_names"))
        if few:  # then the texts stay where they are
            hits = F.broadcast(hits)
        rows = numbered.join(hits, numbered["_r"] == hits["row"], "left").select(*taken.columns, "_bits", "_names")
        rows = rows.mapInArrow(_marker(None, len(kept), True), f"{carried}, {OUT}")
    return rows.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], *results)


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM dwin d JOIN win ON d.n = win.n AND d.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
