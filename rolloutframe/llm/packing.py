"""Best-fit packing with certified bounds.

Every document is encoded, cut into pieces of at most ``capacity`` tokens, and
only (row, length) pairs are packed from then on. Full pieces are sequences of
their own. The others are dealt into partitions of about ``part_rows`` rows
by a hash of the row; each partition runs best-fit decreasing and computes a
lower bound from dual feasible functions. A partition that meets its bound is
certified and done. Those with a gap exchange the documents of their unfilled
sequences: these are pooled, dealt anew and packed again, until the pool is
empty or a round saves nothing (or for ``rounds`` rounds, where given).

Defined cases: a null text is an empty one, which is the end id alone; a null
or repeated id is a row like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, stage
from .tokens import encoder

CAPACITY, PART_ROWS, END_ID = 1024, 20_000, 2


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound of three families of dual feasible functions."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    n_above = np.append(np.cumsum(count[::-1])[::-1], 0)  # of sizes >= i
    s_above = np.append(np.cumsum((count * size)[::-1])[::-1], 0)
    half = capacity // 2
    for t in range(1, half + 1):  # large ones alone, small ones below t vanish
        free = (n_above[half + 1] - n_above[capacity - t + 1]) * capacity - (
            s_above[half + 1] - s_above[capacity - t + 1]
        )
        left = int(s_above[t] - s_above[half + 1] - free)
        best = max(best, int(n_above[half + 1]) + max(0, -(-left // capacity)))
    for k in range(1, 21):  # rounding to k-ths of a sequence
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms: list[int] = []
    n_bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        at = bisect_left(rooms, length)
        if at == len(rooms):
            room, number = capacity, n_bins
            n_bins += 1
        else:
            room = rooms[at]
            number = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
        bins[i], offsets[i] = number, capacity - room
        left = room - length
        if left:
            if not open_bins[left]:
                insort(rooms, left)
            open_bins[left].append(number)
    return bins, offsets


def pieces_of(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, crc): the pieces of every document, in a mapped scan."""
    kind = dict(docs.dtypes)[id_col]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            source, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = memoryview(encode(text.as_py()) + end)
                n = len(ids) // 4
                first = n % capacity or capacity
                at = 0
                for k in range(-(-n // capacity)):
                    to = first + k * capacity
                    source.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at = to
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "crc"],
            )

    return on_workers(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))).mapInArrow(
        cut, f"id {kind}, piece int, start long, length long, crc long"
    )


def _pack(rows: DataFrame, salt: int, first: int, parts: int, capacity: int) -> DataFrame:
    """(row, length, part, bin, offset, fill, gap); ``parts`` partitions, numbered from ``first``."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        lengths = frame["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        return frame.assign(
            bin=bins, offset=offsets, fill=fill[bins], gap=len(fill) - lower_bound(lengths, capacity)
        )[["row", "length", "part", "bin", "offset", "fill", "gap"]]

    return (
        on_workers(rows.select("row", "length"))
        .withColumn("part", F.lit(first).cast("long") + F.pmod(F.xxhash64(F.lit(salt), "row"), F.lit(parts)))
        .groupBy("part")
        .applyInPandas(pack, "row long, length long, part long, bin long, offset long, fill long, gap long")
    )


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int | None = None) -> DataFrame:
    """(row, sequence_id, offset) for ``rows`` (row, length), row unique."""

    def parts_of(some: DataFrame) -> int:
        return max(1, -(-some.count() // part_rows))

    short = rows.where(F.col("length") < capacity)
    parts = parts_of(short)
    state = stage(_pack(short, 0, 0, parts, capacity), "packed")
    done = [
        rows.where(F.col("length") == capacity).select(
            "row", (F.lit(1 << 62) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
        )
    ]
    # partitions are numbered on from round to round, so any number of rounds has ids of its own
    keep = ["row", (F.shiftleft("part", 24) + F.col("bin")).alias("sequence_id"), "offset"]
    gapped = (F.col("gap") > 0) & (F.col("fill") < capacity)
    used = parts
    for salt in count(1) if rounds is None else range(1, rounds + 1):
        pool = state.where(gapped)
        before = pool.where(F.col("offset") == 0).count()
        if before < 2:
            break
        parts = parts_of(pool)
        again = stage(_pack(pool, salt, used, parts, capacity), "repacked")
        if again.where(F.col("offset") == 0).count() >= before:
            break
        used += parts
        done.append(state.where(~gapped).select(*keep))
        state = again
    done.append(state.select(*keep))
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    part_rows: int = PART_ROWS,
    rounds: int | None = None,
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = stage(
        pieces_of(docs, vocabulary, id_col, text_col, capacity, end_id).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "pieces",
    )
    places = pack_pieces(pieces.select("row", "length"), capacity, part_rows, rounds)
    return pieces.join(places, "row").select(
        F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset"
    )
