"""Quality and toxicity by hierarchical empirical Bayes.

Two logistic classifiers over a few shape measures and those hashed words whose
share differs between both kinds beyond chance give each document its evidence:
the log odds of "bad" and of "toxic", with the base rate taken out. It is
computed once and written with the rows. A site has a rate of its own for each, and so has each path of a
site. The expected counts are summed per (host, path) in one grouped
aggregation; a host's rate is shrunk toward the global rate and a path's toward
its host's, each level by a weight of its own, which the spread between the hosts
and that between the paths of a host set (method of moments). Evidence and the
path's log odds add up to the posterior.

The classifiers are fitted to a bounded sample: at most about ``SAMPLE_ROWS``
labelled ids, chosen by a hash, and one document of each (of rows that repeat an
id that with the least hash of its text). All else covers every row.

Defined cases: a null text is an empty one; null hosts and paths are groups of
their own; labels without a document, with a null id or null marks are not
used; of labels that repeat an id the largest marks count; without labels, or
without both kinds of a mark, that mark's evidence is zero and nothing is
rejected for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_workers, stage
from .words import ALPHANUMERIC, slices, words_of

SAMPLE_ROWS, FEATURE_BITS, LEAST_DOCS, BROADCAST_ROWS = 20_000, 18, 4, 100_000
STEPS, RATE, PENALTY, LEAST_Z = 150, 0.1, 1e-5, 5.0
HEADS = ("bad", "toxic")
ADDED = ("_bad", "_toxic", "_host", "_path", "_h", "_p", "_bad_rate", "_toxic_rate", "_p_bad", "_p_toxic", "_keep")
_SYMBOLS = np.isin(np.arange(256), list(b"!*$%&#|=+<>{}[]^~@\\"))
_UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)
_LETTER = (np.arange(256) >= 0x80) | _UPPER | ((np.arange(256) >= 0x61) & (np.arange(256) <= 0x7A))
SHAPES = 7
LEAST_WEIGHT, LARGEST_WEIGHT = 20.0, 1e4
NEVER = -30.0  # log odds of a mark that no sample shows


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(border of each document in features, hashed words present, shape measures)."""
    raw = words_of(texts)
    words = words_of(texts, ALPHANUMERIC, lower=True)
    n = len(texts)
    key = words.doc_of().astype(np.uint64) << np.uint64(FEATURE_BITS) | words.hashes >> np.uint64(64 - FEATURE_BITS)
    key = np.unique(key)
    border = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(FEATURE_BITS))
    index = (key & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int64)

    def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(values, dtype=np.float64))[first])

    edge = np.append(raw.starts, len(raw.data))[np.minimum(raw.first, len(raw.starts))]  # bytes of each document
    size = np.maximum(1, np.diff(edge))
    count = np.maximum(1, raw.counts)
    again = np.zeros(len(raw.starts), bool)
    if len(again):
        again[1:] = (raw.hashes[1:] == raw.hashes[:-1]) & (raw.room()[:-1] > 1)
    letters = per_doc(_LETTER[raw.data], edge)
    shape = np.stack([
        np.log1p(raw.counts),
        per_doc(_UPPER[raw.data], edge) / np.maximum(1, letters),
        per_doc(_SYMBOLS[raw.data], edge) / size,
        letters / size,
        per_doc(again, raw.first) / count,
        np.diff(border) / np.maximum(1, words.counts),
        per_doc(raw.ends - raw.starts, raw.first) / count,
    ], 1)
    return border, index, shape


def _squash(shape: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((shape - mean) / scale, -6, 6)


@dataclass
class Model:
    """Weights of both heads: words x 2, shapes x 2, bias x 2; log odds of the sample."""

    words: np.ndarray
    shapes: np.ndarray
    bias: np.ndarray
    base: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def evidence(self, texts: pa.Array) -> np.ndarray:
        border, index, shape = features(texts)
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(self.words[index], 0, dtype=np.float64)])
        return np.diff(total[border], axis=0) + _squash(shape, self.mean, self.scale) @ self.shapes + self.bias - self.base


def _telling(row: np.ndarray, index: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which hashed words differ between both kinds of documents beyond chance (a test of two shares)."""
    width, good = 1 << FEATURE_BITS, y.sum()
    with_mark = np.bincount(index, y[row], width)
    seen = np.bincount(index, minlength=width)
    share = seen / len(y)
    spread = np.sqrt(share * (1 - share) * (1 / good + 1 / (len(y) - good)))
    apart = np.abs(with_mark / good - (seen - with_mark) / (len(y) - good))
    return (seen >= LEAST_DOCS) & (apart > LEAST_Z * spread)


def fit(border: np.ndarray, index: np.ndarray, shape: np.ndarray, marks: np.ndarray) -> Model:
    """Logistic regression of both heads by full-batch Adam with an L2 penalty, over the telling words."""
    width = 1 << FEATURE_BITS
    rows = np.repeat(np.arange(len(marks)), np.diff(border))
    mean, scale = shape.mean(0), shape.std(0) + 1e-9
    dense = np.append(_squash(shape, mean, scale), np.ones((len(marks), 1)), 1)
    words, own, bias, base = np.zeros((width, 2), np.float32), np.zeros((SHAPES, 2)), np.full(2, NEVER), np.full(2, NEVER)
    for head in range(2):
        y = marks[:, head].astype(np.float64)
        if not 0 < y.sum() < len(y):
            continue
        keep = _telling(rows, index, y)[index]
        row, (column, place) = rows[keep], np.unique(index[keep], return_inverse=True)
        base[head] = np.log(y.mean() / (1 - y.mean()))
        w = np.zeros(len(column) + dense.shape[1])
        w[-1] = base[head]
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            margin = np.bincount(row, w[place], len(y)) + dense @ w[len(column) :]
            miss = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
            g = np.append(np.bincount(place, miss[row], len(column)), dense.T @ miss) + PENALTY * w
            g[-1] -= PENALTY * w[-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        words[column, head] = w[: len(column)]
        own[:, head], bias[head] = w[len(column) : -1], w[-1]
    return Model(words, own, bias, base, mean, scale)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of a bounded sample of labelled documents; None without one."""
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").alias("_l"))
        .agg((1 - F.max("quality")).alias("bad"), F.max("toxic").alias("toxic"))
    )
    share = min(1.0, sample_rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("_l"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).join(
        F.broadcast(marks), F.col("_id") == F.col("_l")
    )
    # one document of each id, found where it is read: an id on many rows is one of the sample
    rows = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_t"), "_t", "bad", "toxic")).alias("m")).select("m.*")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            border, index, shape = features(batch.column(0))
            lists = pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(index.astype(np.int32)))
            shapes = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * SHAPES), pa.array(shape.ravel()))
            yield pa.RecordBatch.from_arrays([lists, shapes, batch.column(1), batch.column(2)], ["f", "s", "bad", "toxic"])

    found = (
        on_workers(rows.select("_t", F.col("bad").cast("int"), F.col("toxic").cast("int")))
        .mapInArrow(emit, "f array<int>, s array<double>, bad int, toxic int")
        .toArrow()
    )
    if not len(found):
        return None
    found = found.combine_chunks()
    f = found["f"].combine_chunks()
    border = np.append(0, np.cumsum(np.asarray(f.value_lengths())))
    return fit(
        border, np.asarray(f.flatten()).astype(np.int64),
        np.asarray(found["s"].combine_chunks().flatten()).reshape(-1, SHAPES),
        np.stack([np.asarray(found["bad"]), np.asarray(found["toxic"])], 1),
    )


def with_evidence(docs: DataFrame, model: Model | None, text_col: str) -> DataFrame:
    """All columns of ``docs`` and ``_bad``, ``_toxic``: evidence in log odds."""
    if model is None:
        return docs.withColumns({f"_{h}": F.lit(0.0) for h in HEADS})
    at = docs.columns.index(text_col)
    renamed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            values = held.value.evidence(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values[:, 0]), pa.array(values[:, 1])], [*batch.schema.names, "b", "t"]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema.fields)
    return on_workers(renamed).mapInArrow(emit, f"{kinds}, b double, t double").toDF(*docs.columns, "_bad", "_toxic")


def _chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _weight(noise: float, spread: float, groups: int, n: int) -> float:
    """The rows that a level above counts for: noise of a row over the variance between groups, of which ``groups`` are free."""
    between = max(0.0, (spread - groups * noise) / n)
    return min(LARGEST_WEIGHT, max(LEAST_WEIGHT, noise / between - 1 if between else LARGEST_WEIGHT))


def site_rates(scored: DataFrame, base: dict[str, float]) -> DataFrame:
    """(_host, _path, _bad_rate, _toxic_rate): shrunk rates of every path, from (_host, _path, _bad, _toxic)."""
    sums = [F.sum(_chance(F.col(f"_{h}") + F.lit(base[h]))).alias(h) for h in HEADS]
    paths = stage(scored.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), *sums), "path-sums")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), *[F.sum(h).alias(f"h_{h}") for h in HEADS])
    whole = hosts.agg(
        F.sum("hn").alias("n"), F.count(F.lit(1)).alias("k"),
        *[F.sum(f"h_{h}").alias(h) for h in HEADS],
        *[F.sum(F.col(f"h_{h}") * F.col(f"h_{h}") / F.col("hn")).alias(f"{h}2") for h in HEADS],
    ).first()
    inner = paths.agg(F.count(F.lit(1)).alias("k"), *[F.sum(F.col(h) * F.col(h) / F.col("n")).alias(f"{h}2") for h in HEADS]).first()
    rates = paths.join(hosts, paths["_host"].eqNullSafe(hosts["_host"])).select(paths["*"], "hn", *[f"h_{h}" for h in HEADS])
    columns = []
    for h in HEADS:
        n = max(1, whole["n"] or 0)
        rate = min(1 - 1e-6, max(1e-6, (whole[h] or 0.0) / n))
        by_host, by_path = whole[f"{h}2"] or 0.0, inner[f"{h}2"] or 0.0
        weight = _weight(rate * (1 - rate), by_host - n * rate * rate, max(0, whole["k"] - 1), n)
        own = _weight(max(0.0, rate - by_host / n), by_path - by_host, inner["k"] - whole["k"], n)
        host = (F.col(f"h_{h}") + weight * rate) / (F.col("hn") + weight)
        columns.append(((F.col(h) + own * host) / (F.col("n") + own)).alias(f"_{h}_rate"))
    return rates.select("_host", "_path", *columns)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    path: Column | None = None,
    sample_rows: int = SAMPLE_ROWS,
    keep_text: bool = True,
) -> DataFrame:
    """All columns of ``docs``, ``_p_bad``, ``_p_toxic`` and ``_keep`` (both below one half).

    Columns of ``docs`` with names in ``ADDED`` are replaced. Without
    ``keep_text`` the text is left out, and not written with the evidence.
    """
    docs = docs.drop(*ADDED)
    host = (F.col("source") if host is None else host).cast("string")
    path = (F.col("lang") if path is None else path).cast("string")
    model = train(docs, labels, id_col, text_col, sample_rows)
    base = dict(zip(HEADS, model.base.tolist() if model else (NEVER, NEVER), strict=True))
    scored = with_evidence(docs.withColumns({"_host": host, "_path": path}), model, text_col)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    scored = stage(scored.select(*kept, "_host", "_path", *[f"_{h}" for h in HEADS]), "evidence")
    rates = stage(site_rates(scored.select("_host", "_path", "_bad", "_toxic"), base), "site-rates")
    small = rates.count() <= BROADCAST_ROWS
    rates = rates.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "_bad_rate", "_toxic_rate")
    joined = scored.join(
        F.broadcast(rates) if small else rates,
        F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")),
        "left",
    )
    posterior = {f"_p_{h}": _chance(F.col(f"_{h}") + _logit(F.col(f"_{h}_rate"))) for h in HEADS}
    return joined.withColumns(posterior).select(
        *kept, "_p_bad", "_p_toxic", ((F.col("_p_bad") < 0.5) & (F.col("_p_toxic") < 0.5)).alias("_keep")
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs.select("doc_id", "text", "source", "lang"), labels, keep_text=False).select(
        "doc_id", F.round("_p_bad", 6).alias("p_bad"), F.round("_p_toxic", 6).alias("p_toxic"), F.col("_keep").alias("keep")
    )
