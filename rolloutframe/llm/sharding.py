"""K-d tree sharding by weighted medians over document metadata.

The documents are points in a space of normalised metadata dimensions. The
tree splits a node at the byte-weighted median along the dimension in which
its rows spread widest, again and again, until each leaf holds its share of
the bytes. All nodes of a level are split together. A median is found without
sorting: bytes are summed per node and histogram bin, and the bin that holds
the median is divided again. Rows that share even the last bin are cut along
``tie``, a hash of their place in the input, so repeated rows are cut as well:
that histogram counts bins of the coordinate and, within each, of the tie.

A node is known by its first shard and the number of its shards, which its rows
carry; so the levels are as many as ``shards`` needs, and nothing is collected.
Each level is written, and the next one reads it. The cuts of a level, a row a
node, are broadcast up to ``BROADCAST_NODES``; beyond that they are joined by
shuffle, when no node holds more than a small part of the bytes.

Slots are dense numbers within a shard. They come from small hash buckets,
each numbered on its own and shifted by the count of the buckets before it, so
that no task holds a whole shard.

Only DataFrame functions run here. Groups play no part in this method: equal
texts may lie in different shards, since a group of copies may hold a third of
all bytes and the law is equal bytes.

Defined cases: a null text has size 1 and CRC 0; nulls in a dimension take
coordinate 0; a null or repeated id, or a row that repeats another in full, is a
row like any other; one very long text makes its shard as large as it is; an
empty table gives an empty result; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stage

BINS, TIES, SLOT_ROWS, BROADCAST_NODES = 256, 1024, 50_000, 1_000_000
SHARDS = 16
DIMENSIONS = ("source", "lang", "n_chars", "doc_id")


def _unit(value: Column) -> Column:
    """A hash of ``value`` in [0, 1)."""
    return F.pmod(F.xxhash64(value), F.lit(1 << 30)).cast("double") / float(1 << 30)


def _points(docs: DataFrame, id_col: str, text_col: str, dims: list[str]) -> DataFrame:
    """(id, size, crc, row, m0, m1, ...) with raw numeric coordinates; written, ``row`` is a fixed number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    coordinates = [
        (F.col(d).cast("double") if isinstance(kinds[d], T.NumericType) else _unit(F.col(d).cast("string")))
        for d in dims
    ]
    crc = F.crc32(text)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        crc.alias("crc"),
        F.monotonically_increasing_id().alias("row"),
        *[c.alias(f"m{i}") for i, c in enumerate(coordinates)],
    )


def _cuts_of(rows: DataFrame, cuts: DataFrame, nodes: int) -> DataFrame:
    """``rows`` with the columns of their node's cut, by (shard, k)."""
    return rows.join(F.broadcast(cuts) if nodes <= BROADCAST_NODES else cuts, ["shard", "k"])


def _crossing(sums: DataFrame) -> DataFrame:
    """The bin of each node in which ``goal`` bytes are reached: (shard, k, bin, bytes, goal, ...), goal left inside it.

    ``sums``: (shard, k, goal, bin, bytes, ...), at most ``BINS * TIES`` rows a node.
    """
    order = Window.partitionBy("shard", "k").orderBy("bin")
    upto = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead("bin").over(order).isNull()
    reached = sums.withColumn("before", upto - F.col("bytes")).withColumn("last", last)
    held = reached.where((F.col("before") <= F.col("goal")) & ((F.col("before") + F.col("bytes") > F.col("goal")) | F.col("last")))
    return held.withColumn("goal", F.col("goal") - F.col("before")).drop("before", "last")


def _cuts(rows: DataFrame, width: int, nodes: int) -> DataFrame:
    """(shard, k, dim, lo, hi, cut) of every node: left of ``lo``, or inside up to the tie ``cut``, is its first half."""
    sides = [f(F.col("m")[i]).alias(f"{name}{i}") for i in range(width) for name, f in (("lo", F.min), ("hi", F.max))]
    low, high = (F.array(*[F.col(f"{name}{i}") for i in range(width)]) for name in ("lo", "hi"))
    spread = F.array(*[F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(width)])
    half = F.floor(F.col("k") / 2)
    cuts = (
        rows.groupBy("shard", "k").agg(F.sum("size").alias("bytes"), *sides)
        .withColumn("dim", (F.array_position(spread, F.array_max(spread)) - 1).cast("int"))
        .select("shard", "k", "dim", F.get(low, F.col("dim")).alias("lo"), F.get(high, F.col("dim")).alias("hi"),
                (F.col("bytes") * half / F.col("k")).alias("goal"))
    )
    x = F.get("m", F.col("dim"))

    def inside(cuts: DataFrame) -> DataFrame:
        """The rows from lo to hi of their node, and the bin in which they lie."""
        found = _cuts_of(rows, cuts, nodes).withColumn("x", x).where(F.col("x").between(F.col("lo"), F.col("hi")))
        step = (F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * BINS
        return found.withColumn("bin", F.least(F.coalesce(F.floor(step), F.lit(0)), F.lit(BINS - 1)))

    edges = [F.sum("size").alias("bytes"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    coarse = _crossing(inside(cuts).groupBy("shard", "k", "dim", "goal", "bin").agg(*edges))
    fine = inside(coarse.select("shard", "k", "dim", "lo", "hi", "goal")).withColumn("tie_bin", F.floor(F.col("tie") * TIES))
    sums = fine.groupBy("shard", "k", "dim", "goal", (F.col("bin") * TIES + F.col("tie_bin")).alias("bin")).agg(*edges)
    # a tie cuts a whole bin of the coordinate, whose edges all its parts know
    whole = Window.partitionBy("shard", "k", F.floor(F.col("bin") / TIES))
    sums = sums.withColumns({"lo": F.min("lo").over(whole), "hi": F.max("hi").over(whole)})
    cut = (F.col("bin") % TIES + F.least(F.col("goal") / F.col("bytes"), F.lit(1.0))) / TIES
    return _crossing(sums).select("shard", "k", "dim", "lo", "hi", cut.alias("cut"))


def kd_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple[str, ...] = DIMENSIONS,
    shards: int = SHARDS,
    target_bytes: int | None = None,
) -> DataFrame:
    """(id, size, crc, shard, slot) of every row.

    ``target_bytes``, where given, sets the number of leaves instead of ``shards``.
    """
    dims = [d for d in dims if d in docs.columns]
    points = stage(_points(docs, id_col, text_col, dims), "kd-points")
    bounds = points.agg(
        F.sum("size").alias("bytes"),
        F.count(F.lit(1)).alias("n"),
        *[f(f"m{i}").alias(f"{name}{i}") for i in range(len(dims)) for name, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    if target_bytes:
        shards = max(1, -(-(bounds["bytes"] or 0) // target_bytes))
    rows = points.select(
        "id", "size", "crc", "row", _unit(F.col("row")).alias("tie"), F.lit(0).alias("shard"), F.lit(shards).alias("k"),
        F.array(*[
            F.coalesce(
                (F.col(f"m{i}") - bounds[f"lo{i}"]) / (bounds[f"hi{i}"] - bounds[f"lo{i}"])
                if (bounds[f"hi{i}"] or 0) > (bounds[f"lo{i}"] or 0) else F.lit(0.0),
                F.lit(0.0),
            )
            for i in range(len(dims))
        ] + ([F.lit(0.0)] if not dims else [])).alias("m"),
    )
    columns = rows.columns
    for level in range((shards - 1).bit_length()):
        nodes = min(shards, 1 << level)
        cuts = _cuts(rows.where("k > 1"), max(1, len(dims)), nodes)
        x, half = F.get("m", F.col("dim")), F.floor(F.col("k") / 2).cast("int")
        right = (x > F.col("hi")) | ((x >= F.col("lo")) & (F.col("tie") >= F.col("cut")))
        split = _cuts_of(rows.where("k > 1"), cuts, nodes).withColumn("right", right)
        split = split.withColumns({
            "shard": F.col("shard") + F.when(F.col("right"), half).otherwise(0),
            "k": F.when(F.col("right"), F.col("k") - half).otherwise(half),
        })
        rows = stage(split.select(columns).unionByName(rows.where("k = 1")), "kd-level")
    parts = max(1, bounds["n"] // SLOT_ROWS)
    placed = rows.select("id", "size", "crc", "row", "shard", F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"))
    before = (
        placed.groupBy("shard", "part").count()
        .withColumn("first", F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count"))
        .select("shard", "part", "first")
    )
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "crc", "size", "row"))
    return (
        placed.withColumn("rank", rank)
        .join(before, ["shard", "part"])
        .select("id", "size", "crc", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"))
    )


def digest(docs: DataFrame) -> DataFrame:
    return kd_shards(docs).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
