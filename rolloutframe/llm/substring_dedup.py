"""Substring deduplication by level-wise doubling.

A window of ``window`` words can occur in two documents only if every shorter
window inside it does. So the levels double: they start from the half of a half
of ``window`` (rounded up) that has no fewer than ``BASE_WORDS`` words, and only
places whose windows repeat across documents at one level are extended to twice
that length, until ``window`` is reached or no candidate survives. (A window of
13 words has the levels 7 and 13, one of 50 has 7, 13, 25 and 50.)

At a short level one short window stands for each long one: the one of least
hash among those inside it. Equal long windows choose equal short ones, so none
is lost, while about a quarter of the places is shuffled.

A passage may lie in a third of all documents. What a slice of the scan, or its
task so far, already shows to be settled does not go to the task of its hash: a
key seen twice is known to repeat, and a window seen in a document of smaller
id is known to go. Such rows are spread by a salt; the task of the hash gets
one mark, or the row of the least id, for each task of the scan. Each task reads
its rows in a fixed order, so a task that is run again deals the same rows.

A short key may also stand in many different long windows, around a very common
passage. Long windows are dealt by their short keys, but where a sample of the
documents shows more different runs of windows under one key than a task should
hold: these windows are dealt one by one, each by the hashes of both. The sample
decides where rows go, never which are compared.

Defined cases: a null text has no words; rows with a null id are returned whole
and cause no removal; rows that repeat an id are one document (they remove
nothing from each other); texts shorter than a window are kept whole; a very
long text is read whole, in a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import on_workers, shuffle_parts, stage
from .words import SLICE_BYTES, Words, mix, slices, sliding_min, words_of

WINDOW, BASE_WORDS, SALTS, MOST_KNOWN = 13, 5, 4096, 1 << 16
#: A key is hot with one different run for every HOT_SHARE documents (for as many as there are shuffle partitions, if more);
#: SAMPLE documents for each of them are looked at, and the MOST_HOT hottest keys at most are split.
HOT_SHARE, SAMPLE, MOST_HOT = 100, 50, 1 << 16
_SECOND = 0x5851F42D4C957F2D


def _short_keys(words: Words, window: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word of each long window, its short key)."""
    starts = np.flatnonzero(words.room() >= window)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    return starts, sliding_min(words.ngrams(short), window - short + 1)[starts]


def _runs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, doc) pairs, sorted by key."""
    if not len(key):
        return doc, key
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
    doc, key = doc[new], key[new]
    order = np.lexsort((doc, key))
    doc, key = doc[order], key[order]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
    return doc[new], key[new]


def _lists(values: pa.Array, border: np.ndarray, many: np.ndarray) -> pa.Array:
    """For each group, its values where it is one of ``many``, else null."""
    size = np.where(many, np.diff(border), 0)
    at = np.repeat(border[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), values.take(pa.array(at)), mask=pa.array(~many) if len(many) else None
    )


def _salt(number: int) -> int:
    """The salt of a task's slice ``number``: the same when the task is run again."""
    return (TaskContext.get().partitionId() * 7919 + number) % SALTS + 1


def _salted(many: np.ndarray, salt: int) -> pa.Array:
    return pa.array(np.where(many, salt, 0).astype(np.int32))


def _live(batch: pa.RecordBatch, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which (document, key) pairs are in the documents' lists of column 2."""
    lists = batch.column(2)
    known_doc = np.repeat(np.arange(len(batch)), np.asarray(lists.value_lengths().fill_null(0)))
    known = np.asarray(lists.flatten()).view(np.uint64)
    salt = mix(np.arange(len(batch), dtype=np.uint64) + np.uint64(1))
    return np.isin(mix(key ^ salt[doc]), mix(known ^ salt[known_doc]))


def _short_level(window: int, before: int | None, short: int, slice_bytes: int):
    """Keys of one level, of the places that the level ``before`` left.

    A row is (k, salt, id, ids): the one document of a slice with the key (salt
    0), or, where the key is known to repeat, the list of them under a salt and
    once for each task a mark (salt 0, neither id nor ids).
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.empty(0, np.uint64)
        for number, batch in enumerate(slices(batches, most=slice_bytes)):
            words = words_of(batch.column(1))
            starts, key = _short_keys(words, window, short)
            doc = words.doc_of()[starts]
            if before is not None:
                live = _live(batch, doc, _short_keys(words, window, before)[1])
                doc, key = doc[live], key[live]
            doc, key = _runs(doc, key)
            border = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else [], len(key)).astype(np.int64)
            k, old = key[border[:-1]], np.isin(key[border[:-1]], known)
            many = (np.diff(border) > 1) | old
            mark = np.flatnonzero(many & ~old)
            known = np.concatenate([known if len(known) + len(mark) <= MOST_KNOWN else known[:0], k[mark]])
            ids = batch.column(0).take(pa.array(doc))
            alone = pa.array(np.where(many, 0, border[:-1]), mask=many) if len(many) else pa.array([], pa.int64())
            lists = _lists(ids, border, many)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.view(np.int64)), _salted(many, _salt(number)), ids.take(alone), lists], ["k", "salt", "id", "ids"]
            )
            if len(mark):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[mark].view(np.int64)), pa.array(np.zeros(len(mark), np.int32)),
                     pa.nulls(len(mark), ids.type), pa.nulls(len(mark), lists.type)],
                    ["k", "salt", "id", "ids"],
                )

    return emit


def _window_runs(words: Words, window: int, starts: np.ndarray, doc: np.ndarray, key: np.ndarray, hot: np.ndarray):
    """(hash of each window, first window of each run, windows of each run, its hash); a ``hot`` window is a run of its own."""
    own = words.ngrams(window)[starts]
    new = hot | np.append(True, (starts[1:] != starts[:-1] + 1) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
    new[1:] |= hot[:-1]
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, len(starts)))
    place = np.arange(len(starts)) - np.repeat(run, size)
    whole = np.add.reduceat(mix(own + place.astype(np.uint64) * np.uint64(_SECOND)), run)
    return own, run, size, whole


def _named_runs(window: int, short: int, slice_bytes: int):
    """(k, run): the short key and the hash of every run of long windows, once a slice."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=0, most=slice_bytes):
            words = words_of(batch.column(0))
            starts, key = _short_keys(words, window, short)
            if len(starts):
                _, run, _, whole = _window_runs(words, window, starts, words.doc_of()[starts], key, np.zeros(len(starts), bool))
                some = np.unique(np.stack([key[run], whole]).view(np.int64), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(some[0]), pa.array(some[1])], ["k", "run"])

    return emit


def hot_keys(docs: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES, hot_share: int = HOT_SHARE) -> list[int]:
    """Short keys of the last short level around which a sample of ``docs`` (text) shows very many different runs of windows."""
    share = max(hot_share, shuffle_parts(docs.sparkSession))
    n, wanted = docs.count(), SAMPLE * share
    sample = docs.select("text") if n <= wanted else docs.select("text").sample(wanted / n, seed=1)
    short = (levels(window)[:-1] or [window])[-1]
    runs = on_workers(sample).mapInArrow(_named_runs(window, short, slice_bytes), "k long, run long").distinct()
    found = runs.groupBy("k").count().where(F.col("count") > max(1, min(n, wanted) // share))
    return [r["k"] for r in found.orderBy(F.desc("count"), "k").limit(MOST_HOT).collect()]


def _long_level(window: int, short: int, slice_bytes: int, hot_keys: np.ndarray):
    """Runs of long windows whose short key repeats; equal runs of a slice in one row.

    A run is the windows at consecutive words that chose the same short window,
    with a hash for each; under a hot key each window is a run, and k is made of
    both hashes. Equal windows have equal short keys, so the pair of
    both hashes names a window. A row is (k, salt, gs, n, id, at, ids, ats): the
    places of the least document of a slice with the run (salt 0, with the
    hashes), or places known to go (under a salt, with the number of windows).
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}  # run -> the least id that this task has sent
        for number, batch in enumerate(slices(batches, most=slice_bytes)):
            words = words_of(batch.column(1))
            starts, key = _short_keys(words, window, short)
            doc = words.doc_of()[starts]
            live = _live(batch, doc, key)
            starts, doc, key = starts[live], doc[live], key[live]
            if not len(starts):
                continue
            hot = np.isin(key, hot_keys)
            own, run, size, whole = _window_runs(words, window, starts, doc, key, hot)
            key = np.where(hot, mix(key ^ mix(own)), key)
            order = np.lexsort((run, whole, key[run]))
            run, size, whole = run[order], size[order], whole[order]
            k = key[run]
            first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (whole[1:] != whole[:-1])))
            ids = batch.column(0).take(pa.array(doc[run]))
            plain = ids.to_numpy(zero_copy_only=False)
            least = np.minimum.reduceat(plain, first)
            name = mix(k[first] ^ mix(whole[first]))
            count = np.diff(np.append(first, len(run)))
            if len(known) > MOST_KNOWN:
                known.clear()
            for g in np.flatnonzero((count > 1) | np.isin(name, np.fromiter(known, np.uint64, len(known)))).tolist():
                here = int(name[g])
                least[g] = known[here] = min(least[g], known.get(here, least[g]))
            group = np.repeat(np.arange(len(first)), count)
            gone = plain > least[group]
            places = pa.array((starts[run] - words.first[doc[run]]).astype(np.int32))

            def rows(some: np.ndarray, removed: bool) -> pa.RecordBatch:
                """The entries ``some``, those of one run in one row."""
                head = np.flatnonzero(np.append(True, group[some][1:] != group[some][:-1]))
                at, border = some[head], np.append(head, len(some))
                many = (np.diff(border) > 1) | removed
                n = np.zeros(len(at), np.int64) if removed else size[at]
                inner = np.repeat(run[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hashes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(own[inner].view(np.int64)))
                alone = pa.array(np.where(many, 0, at), mask=many)
                entries = pa.array(some)
                salt = _salted(np.full(len(at), removed), _salt(number))
                return pa.RecordBatch.from_arrays(
                    [pa.array(k[at].view(np.int64)), salt, hashes, pa.array(size[at].astype(np.int32)), ids.take(alone), places.take(alone),
                     _lists(ids.take(entries), border, many), _lists(places.take(entries), border, many)],
                    ["k", "salt", "gs", "n", "id", "at", "ids", "ats"],
                )

            for removed in (False, True):
                some = np.flatnonzero(gone == removed)
                if len(some):
                    yield rows(some, removed)

    return emit


def _kept(window: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, text = [], [], []
            for whole, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = (whole.as_py() or "").encode().split()
                n_words.append(len(words))
                if starts.is_valid and len(starts):
                    cover = np.zeros(len(words) + 1, np.int32)
                    at = np.asarray(starts.values.field("at"))
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + np.asarray(starts.values.field("n")) + window - 1, -1)
                    out = np.cumsum(cover[:-1]) > 0
                    n_removed.append(int(out.sum()))
                    words = [words[i] for i in np.flatnonzero(~out).tolist()]
                else:
                    n_removed.append(0)
                text.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in text], pa.string()), pa.array(text, pa.binary())],
                ["id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return emit


def levels(window: int) -> list[int]:
    """Lengths of the levels, the shortest first: each about twice the one before."""
    found = [window]
    while -(-found[0] // 2) >= BASE_WORDS:
        found.insert(0, -(-found[0] // 2))
    return found


def _survivors(keys: DataFrame) -> DataFrame:
    """(id_, keys): each document's keys that another document holds as well."""
    by_key = Window.partitionBy("k", "salt")
    marked = F.max(F.col("id").isNull()).over(by_key)
    again = F.col("ids").isNotNull() | marked | (F.min("id").over(by_key) != F.max("id").over(by_key))
    repeated = keys.select("id", "ids", "k", again.alias("again")).where("again AND (id IS NOT NULL OR ids IS NOT NULL)")
    each = F.coalesce(F.col("ids"), F.array("id"))
    return repeated.select(F.explode(each).alias("id_"), "k").groupBy("id_").agg(F.collect_set("k").alias("keys"))


def removed_windows(docs: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES, hot: Sequence[int] = ()) -> DataFrame:
    """(id_, starts): runs of windows to remove, (first word, windows). ``docs``: (id, text), dealt by id, none null.

    ``hot``: short keys whose windows are dealt one by one (``hot_keys``).
    """
    kind = dict(docs.dtypes)["id"]
    steps = levels(window)
    order = ("id", F.xxhash64("text"))
    found, before = docs, None
    for short in steps[:-1] or steps:
        keys = on_workers(found).sortWithinPartitions(*order).mapInArrow(_short_level(window, before, short, slice_bytes), f"k long, salt int, id {kind}, ids array<{kind}>")
        live = _survivors(keys)
        if len(steps) > 2:
            live = stage(live, "live-keys")
            if live.isEmpty():
                before = None
                break
        found = docs.join(live.hint("shuffle_hash"), F.col("id") == F.col("id_"), "left").select("id", "text", "keys")
        # no filter on the texts of all rows: it would sink below the exchange, which the readers would then not share
        before = short
    if before is None:
        return docs.sparkSession.createDataFrame([], f"id_ {kind}, starts array<struct<at int, n int>>")
    runs = found.sortWithinPartitions(*order).mapInArrow(_long_level(window, before, slice_bytes, np.array(hot, np.int64).view(np.uint64)), RUNS.format(kind))
    # dealt by the short key, so that the long windows need no exchange of their own; places known to go have no hashes
    hashes = F.when(F.col("salt") == 0, F.col("gs")).otherwise(F.array(F.lit(None).cast("long")))
    each = runs.repartition("k", "salt").select("k", "salt", "n", "id", "at", "ids", "ats", F.posexplode(hashes).alias("off", "g"))
    own = F.coalesce(F.col("id"), F.get("ids", F.lit(0)))
    first = F.min(own).over(Window.partitionBy("k", "salt", "g"))
    known = F.col("salt") > 0
    pairs = F.coalesce(F.arrays_zip("ids", "ats"), F.array(F.struct(F.col("id").alias("ids"), F.col("at").alias("ats"))))
    count = F.when(known, F.col("n")).otherwise(1)
    return (
        each.withColumn("first", first)
        .where(known | (own > F.col("first")))
        .select("off", count.alias("n"), F.inline(pairs))
        .groupBy(F.col("ids").alias("id_"))
        .agg(F.collect_list(F.struct((F.col("ats") + F.col("off")).alias("at"), "n")).alias("starts"))
    )


RUNS = "k long, salt int, gs array<long>, n int, id {0}, at int, ids array<{0}>, ats array<int>"


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) of every row.

    ``kept``: the words left, joined by one space, as UTF-8 bytes. A word goes
    if a window over it also starts in a document of smaller id.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(docs.dtypes)["id"]
    dealt = docs.where(F.col("id").isNotNull()).repartition("id")
    hot = hot_keys(docs.where(F.col("id").isNotNull()), window, slice_bytes, hot_share)
    removed = removed_windows(dealt, window, slice_bytes, hot)
    joined = dealt.join(removed.hint("shuffle_hash"), F.col("id") == F.col("id_"), "left").select("id", "text", "starts")
    whole = docs.where(F.col("id").isNull()).select("id", "text", F.lit(None).cast(joined.schema["starts"].dataType).alias("starts"))
    # a union below the maps would name the columns of one reader's exchange apart, and it would not be shared
    kinds = f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept binary"
    kept, untouched = (on_workers(rows).mapInArrow(_kept(window), kinds) for rows in (joined, whole))
    return kept.unionByName(untouched)


def digest(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x{20}\x{09}-\x{0D}]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw WHERE len(w) >= 13)),
firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k HAVING count(DISTINCT doc_id) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM win JOIN firsts USING (k) WHERE doc_id > f),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM dw),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p
  WHERE gone.p IS NULL GROUP BY words.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM dw LEFT JOIN kept ON dw.doc_id = kept.doc_id LEFT JOIN n ON dw.doc_id = n.doc_id
"""
