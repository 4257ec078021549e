"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``3`` bits meet in the middle: some variant lies within
half the radius of both. Half of three is one on one side and two on the other,
and parity says which: fingerprints at an odd distance differ in parity. So

* each fingerprint emits its ball of radius 1, where those at distance 1 or 2
  meet, and
* each of odd parity also emits its sphere of radius 2, where it meets the
  radius-1 ball of an even one at distance 1 or 3.

A variant at which some meet joins all of them to the least: radius-1 members
of a variant lie within 2 bits of each other, and an odd one at radius 2 lies
within 3 bits of the even one. So each collision is a proven link, a hot
variant costs a row a member and never a pair of members, and exact copies are
one fingerprint from the start.

Most fingerprints have no partner. They are found first by the same ball
hashing on 32-bit halves: of two fingerprints within 3 bits, one half differs
in at most one bit, so the halves share a variant if those of odd parity emit
their radius-1 balls and the even ones themselves. One that shares none of its
half variants with another fingerprint has no partner and emits nothing more.
This pays while fingerprints are few against the 2^32 halves; beyond some 2^27
most meet another half by chance, and all odd ones emit their radius-2 spheres.

Groups are met by grouped aggregation joined back, so no task holds a group;
rows of a hot variant are spread by Spark's skew join. Before they expand,
partners are dealt to as many tasks as their variants need.

Defined cases: a null or empty text has fingerprint zero and is linked like any
other; a row with a null id links others as any row does and gets the component
of its fingerprint, null where all ids of that component are null; rows that
repeat an id belong to the component of each of their texts on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import on_workers, shuffle_parts, stage
from .components import components

SHINGLE, SEED, TASK_VARIANTS = 3, 42, 1_000_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the hashes of the word shingles, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)],
        np.uint64,
    )
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        some = hashes[at : at + (1 << 14)]
        set_bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, row_col: str | None = None
) -> DataFrame:
    """(id, fp) of every row, in a mapped scan; with ``row_col`` (id, fp, row)."""
    kinds = dict(docs.dtypes)
    rows = [F.col(row_col).alias("row")] if row_col else []

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            columns = [batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "fp", "row"][: len(columns)])

    return on_workers(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"), *rows)).mapInArrow(
        emit, f"id {kinds[id_col]}, fp long" + (f", row {kinds[row_col]}" if row_col else "")
    )


def _flips(positions: list[tuple[int, ...]]) -> list[int]:
    """Masks with those bits, as signed 64-bit numbers."""
    masks = [sum(1 << p for p in ps) for ps in positions]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _variants(value: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def _odd(value: Column) -> Column:
    return F.bit_count(value) % 2 == 1


def with_partner(nodes: DataFrame) -> DataFrame:
    """The distinct fingerprints that share a half variant with another one.

    Where just two share one, the least and the largest of its group are both;
    only the variants of larger groups, which are few, are joined back.
    """
    ball = _flips([(i,) for i in range(32)])
    side = F.explode(F.array(F.lit(0), F.lit(1)))
    halves = nodes.select("fp", side.alias("side")).select(
        "fp", "side", F.when(F.col("side") == 0, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned(F.col("fp"), 32)).alias("half")
    )
    own = F.array("half")
    variant = F.explode(F.when(_odd(F.col("half")), F.concat(own, _variants(F.col("half"), ball))).otherwise(own))
    emitted = halves.select("fp", "side", variant.alias("v")).select("fp", F.shiftleft("v", 1).bitwiseOR(F.col("side")).alias("key"))
    groups = emitted.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), F.count(F.lit(1)).alias("n"))
    shared = stage(groups.where("n > 1"), "shared-halves")
    two = shared.where("n = 2").select(F.explode(F.array("least", "most")).alias("fp"))
    crowded = emitted.join(shared.where("n > 2").select("key"), "key", "left_semi").select("fp")
    return two.unionByName(crowded).distinct()


def _dealt(nodes: DataFrame) -> DataFrame:
    """``nodes`` in tasks of about ``TASK_VARIANTS`` variants: Spark would read the small table as one split."""
    variants = nodes.count() * (64 * 63 // 2)
    return nodes.repartition(max(shuffle_parts(nodes.sparkSession), -(-variants // TASK_VARIANTS)), "fp")


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints within 3 bits: enough to connect them all.

    Spark takes the variants of a node to be as small as the node, so the joins
    ask for a merge join: a broadcast of all variants has no bound.
    """
    nodes = _dealt(nodes)
    one = _flips([(), *combinations(range(64), 1)])
    two = _flips(list(combinations(range(64), 2)))
    near = nodes.select(
        F.col("fp").alias("node"), _odd(F.col("fp")).alias("odd"), F.explode(_variants(F.col("fp"), one)).alias("v")
    )
    hubs = near.groupBy("v").agg(
        F.min("node").alias("hub"), F.max(~F.col("odd")).alias("even"), F.count(F.lit(1)).alias("n")
    )
    met = near.hint("merge").join(hubs.where(F.col("n") > 1), "v").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    far = nodes.where(_odd(F.col("fp"))).select(F.col("fp").alias("node"), F.explode(_variants(F.col("fp"), two)).alias("v"))
    reached = far.hint("merge").join(hubs.where("even"), "v").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return met.unionByName(reached).where(F.col("a") != F.col("b"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    row_col: str | None = None,
) -> DataFrame:
    """(id, fp, component_id) of every row; the least id reachable names a component.

    With ``row_col``, a number of each row, also ``row`` and ``root``, a
    fingerprint of the component: where ids repeat, components may share an id.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle, row_col), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    # two fingerprints of one repeated id share an id: the fingerprint itself keeps them apart
    partners = stage(with_partner(nodes.select("fp")), "partners")
    roots = components(links(partners))
    least = (
        nodes.join(roots, nodes["fp"] == roots["node"])
        .groupBy("root").agg(F.min(nodes["node"]).alias("least"))
    )
    named = roots.join(least, "root").select(F.col("node").alias("fp"), "least", "root")
    root = [F.coalesce("root", "fp").alias("root")] if row_col else []
    named = stage(
        nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "node").alias("component_id"), *root), "components"
    )
    return prints.join(named, "fp", "left").select("id", "fp", "component_id", *(["row", "root"] if row_col else []))


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
