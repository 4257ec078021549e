"""Token ids in Re-Pair compressed shard files.

Documents are dealt by ranges of their ids and encoded in that order. Each run
of about ``shard_tokens`` tokens is one shard. In a shard frequent pairs of
neighbouring symbols are replaced by nonterminals, round after round, until no
pair occurs ``MIN_COUNT`` times or the ids of a symbol's width run out; a round
replaces all frequent pairs at once and never two that overlap. The end id of a
document starts no pair, so no symbol crosses documents.

A shard is one row of a Parquet file:

=========== =====================================================================
part, no    place in the order of shards: range partition, then number in it
doc_ids     the documents' ids, in order
n_tokens    32-bit little-endian: tokens of each document, end id included
n_symbols   32-bit little-endian: symbols of each document
base        ids below it are tokens; ``base + i`` is nonterminal i
rules       32-bit little-endian pairs: left and right symbol of each nonterminal
lengths     32-bit little-endian: tokens that each nonterminal stands for
width       bytes of a symbol, 2 or 4
symbols     the symbols, little-endian
tokens      how many tokens the shard holds
=========== =====================================================================

Any document is decoded on its own: ``n_symbols`` gives its symbols, and the
lengths say which of them hold a wanted token range (:func:`read_ranges`).

Defined cases: a null text is the end id alone; null ids come first; rows that
repeat an id stand side by side, by the hash of their texts, and may be dealt to
several ranges; a very long text is one document of one shard, however large
that makes it; an empty table gives no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import on_workers, scratch_path
from .tokens import encoder

END_ID, SHARD_TOKENS, MIN_COUNT = 1, 1_000_000, 24
#: Symbols take two bytes where so many rules fit beside the tokens, else four.
LEAST_RULES = 16_000
_HASH_BITS, SORT_PLACES = 18, 100_000


def _frequent(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair number of each place, or -1; which places may hold a frequent pair that is not counted yet).

    At most ``most`` pairs are numbered, the most frequent. Many places are
    counted by hash slot, so nothing is sorted; of pairs that share a slot one is
    exact and the others wait for a later round. Few are counted one by one.
    """
    number, waiting = np.full(len(key), -1, np.int64), np.zeros(len(key), bool)
    if len(key) > SORT_PLACES:
        bits = key.dtype.itemsize * 8
        factor = key.dtype.type(0x9E3779B1 if bits == 32 else 0x9E3779B97F4A7C15)
        slot = ((key * factor) >> key.dtype.type(bits - _HASH_BITS)).astype(np.int64)
        at = np.flatnonzero((np.bincount(slot) >= MIN_COUNT)[slot])
        slot = slot[at]
        owner = np.zeros(1 << _HASH_BITS, key.dtype)
        owner[slot] = key[at]
        own = owner[slot] == key[at]
        waiting[at[~own]] = True
        at, slot = at[own], slot[own]
    else:
        at, slot = np.arange(len(key)), np.unique(key, return_inverse=True)[1]
    count = np.bincount(slot)
    chosen = np.flatnonzero(count >= MIN_COUNT)
    if len(chosen) > most:
        chosen = chosen[np.argsort(-count[chosen], kind="stable")[:most]]
    order = np.full(len(count), -1, np.int64)
    order[chosen] = np.arange(len(chosen))
    number[at] = order[slot]
    return number, waiting


def compress(tokens: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols before each document end, rules, lengths). ``ends``: last token of each document.

    After the first round only these places can start a frequent pair: those at
    a new symbol or just before one, those of a frequent pair that overlapped
    another, and those that waited. The others were counted, and counts only fall.
    """
    width = 16 if base + LEAST_RULES <= 1 << 16 else 32
    most = (1 << width) - base
    symbols = tokens.astype(np.uint16 if width == 16 else np.uint32)
    wide = np.uint32 if width == 16 else np.uint64
    last = np.zeros(len(symbols), bool)
    last[ends] = True
    rules, lengths = np.empty((0, 2), np.uint32), np.empty(0, np.uint32)
    places = np.flatnonzero(~last[:-1])
    while len(places) and len(rules) < most:
        key = symbols[places].astype(wide) << wide(width) | symbols[places + 1]
        number, waiting = _frequent(key, most - len(rules))
        at, number = places[number >= 0], number[number >= 0]
        if not len(at):
            if len(places) <= SORT_PLACES or waiting.all():
                break
            places = places[waiting]
            continue
        run = np.flatnonzero(np.append(True, np.diff(at) != 1))  # overlapping places: take every other one
        taken = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
        left, at, number = at[~taken], at[taken], number[taken]
        used, number = np.unique(number, return_inverse=True)
        where = np.empty(len(used), np.int64)
        where[number] = at
        new = np.stack([symbols[where], symbols[where + 1]], 1)
        known = np.append(np.ones(base, np.uint32), lengths)
        symbols[at] = base + len(rules) + number
        rules, lengths = np.concatenate([rules, new]), np.append(lengths, known[new[:, 0]] + known[new[:, 1]])
        last[at] |= last[at + 1]
        open_ = np.zeros(len(symbols) + 1, bool)
        open_[at] = open_[left] = open_[places[waiting]] = True
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, last, open_ = symbols[stay], last[stay], open_[:-1][stay]
        open_[:-1] |= symbols[1:] >= base + len(rules) - len(new)
        open_ &= ~last
        open_[-1:] = False
        places = np.flatnonzero(open_)
    return symbols, np.flatnonzero(last) + 1, rules, lengths


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The tokens that symbols stand for."""
    size = np.append(np.ones(base, np.int64), lengths)
    first = np.append(0, np.cumsum(size))[:-1]
    spelled = np.empty(int(size.sum()), np.uint32)
    spelled[:base] = np.arange(base)
    for i, (left, right) in enumerate(rules.tolist(), base):
        at, cut = first[i], first[i] + size[left]
        spelled[at:cut] = spelled[first[left] : first[left] + size[left]]
        spelled[cut : at + size[i]] = spelled[first[right] : first[right] + size[right]]
    n = size[symbols]
    return spelled[np.repeat(first[symbols] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def token_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, start: int, stop: int) -> np.ndarray:
    """Tokens start to stop of a document, expanding only the symbols that hold them.

    Those are opened level by level; at each level what lies outside the range
    goes, so no other rule of the grammar is read.
    """
    some, at = np.asarray(symbols, np.int64), 0
    while True:
        size = np.where(some < base, 1, lengths[np.maximum(some - base, 0)] if len(lengths) else 1).astype(np.int64)
        border = at + np.append(0, np.cumsum(size))
        inside = (border[1:] > start) & (border[:-1] < stop)
        some, at = some[inside], int(border[:-1][inside][0]) if inside.any() else start
        deep = some >= base
        if not deep.any():
            return some.astype(np.uint32)
        wide = np.repeat(some, np.where(deep, 2, 1))
        first = np.cumsum(np.where(deep, 2, 1)) - np.where(deep, 2, 1)
        pairs = rules[some[deep] - base]
        wide[first[deep]], wide[first[deep] + 1] = pairs[:, 0], pairs[:, 1]
        some = wide


def _shards(vocabulary: str, kind: pa.DataType, end_id: int, shard_tokens: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        base = max(code.tokenizer.get_vocab_size(), end_id + 1)
        end = np.array([end_id], "<u4").tobytes()
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[bytes] = []
        size = 0

        def shard() -> pa.RecordBatch:
            n = np.array([len(t) // 4 for t in held], "<u4")
            tokens = np.frombuffer(b"".join(held), "<u4")
            symbols, borders, rules, lengths = compress(tokens, np.cumsum(n) - 1, base)
            width = 2 if base + len(rules) <= 1 << 16 else 4
            values = [
                [part], [number], [ids], [n.tobytes()], [np.diff(borders, prepend=0).astype("<u4").tobytes()], [base],
                [rules.astype("<u4").tobytes()], [lengths.astype("<u4").tobytes()], [width], [symbols.astype(f"<u{width}").tobytes()], [len(tokens)],
            ]
            kinds = [pa.int32(), pa.int32(), pa.list_(kind), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], NAMES)

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(id_)
                held.append(code.encode(text.as_py()) + end)
                size += len(held[-1]) // 4
                if size >= shard_tokens:
                    yield shard()
                    number, ids, held, size = number + 1, [], [], 0
        if held:
            yield shard()

    return emit


NAMES = ["part", "no", "doc_ids", "n_tokens", "n_symbols", "base", "rules", "lengths", "width", "symbols", "tokens"]


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode ``docs`` and write the shard files below ``path``, in ascending id order."""
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    ordered = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .withColumn("h", F.xxhash64("text"))  # rows that share an id need not share a range
        .repartitionByRange("id", "h")
        .sortWithinPartitions("id", "h")
        .select("id", "text")
    )
    on_workers(ordered).mapInArrow(
        _shards(vocabulary, to_arrow_type(kind), end_id, shard_tokens),
        f"part int, no int, doc_ids array<{kind.simpleString()}>, n_tokens binary, n_symbols binary, base int,"
        " rules binary, lengths binary, width int, symbols binary, tokens long",
    ).write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(len(batch)):
            part, no, _, n, _, base, rules, lengths, width, symbols = (batch.column(i)[row].as_py() if i != 2 else None for i in range(10))
            n = np.frombuffer(n, "<u4").astype(np.int64)
            pairs = np.frombuffer(rules, "<u4").reshape(-1, 2).astype(np.int64)
            known = np.frombuffer(lengths, "<u4").astype(np.int64)
            tokens = expand(np.frombuffer(symbols, f"<u{width}"), pairs, known, base).astype("<u4").tobytes()
            border = np.append(0, np.cumsum(n))
            view = memoryview(tokens)
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True)]
            ids = batch.column(2)[row].values
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), no, np.int32)), ids,
                 pa.array(border[:-1]), pa.array(n), pa.array(crc, pa.int64())],
                ["part", "no", "id", "at", "n_tokens", "crc"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, crc) of every document, decoded from the files."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    found = on_workers(files.select(*NAMES[:10])).mapInArrow(
        _decoded, f"part int, no int, id {kind}, at long, n_tokens long, crc long"
    )
    sizes = files.select("part", "no", F.col("tokens").alias("n"))
    inner = Window.partitionBy("part").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.select("part", "no", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("b"))
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("a"))
    base = within.join(ranges, "part").select("part", "no", (F.col("a") + F.col("b")).alias("base"))
    return found.join(base, ["part", "no"]).select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "crc")


def _ranges(kind: pa.DataType):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, n, base, rules, lengths, width, symbols in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                border = np.append(0, np.cumsum(np.frombuffer(n, "<u4").astype(np.int64)))
                pairs = np.frombuffer(rules, "<u4").reshape(-1, 2).astype(np.int64)
                known = np.frombuffer(lengths, "<u4").astype(np.int64)
                held = np.frombuffer(symbols, f"<u{width}")
                found = [
                    token_range(held[border[x["place"]] : border[x["place"] + 1]], pairs, known, base, x["from_token"], x["to_token"])
                    for x in asked
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["id"] for x in asked], kind), pa.array([x["from_token"] for x in asked], pa.int64()),
                     pa.array([x["to_token"] for x in asked], pa.int64()), pa.array([x.tolist() for x in found], pa.list_(pa.int64()))],
                    ["id", "from_token", "to_token", "tokens"],
                )

    return decode


def read_ranges(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(id, from_token, to_token, tokens) for each row of ``wanted`` (id, from_token, to_token).

    Only shards that hold a wanted document are decoded, and in them only the
    symbols of the range; what lies past the document's end is not returned.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType
    placed = files.select("part", "no", F.posexplode("doc_ids").alias("place", "id"))
    asked = (
        placed.join(wanted.select("id", F.col("from_token").cast("long"), F.col("to_token").cast("long")), "id")
        .groupBy("part", "no").agg(F.collect_list(F.struct("id", "place", "from_token", "to_token")).alias("asked"))
    )
    shards = files.select("part", "no", "n_symbols", "base", "rules", "lengths", "width", "symbols")
    return on_workers(asked.join(shards, ["part", "no"]).drop("part", "no")).mapInArrow(
        _ranges(to_arrow_type(kind)), f"id {kind.simpleString()}, from_token long, to_token long, tokens array<long>"
    )


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-shards")
    write_tokens(docs, path, vocabulary)
    return read_tokens(docs.sparkSession, path).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32")
    )
