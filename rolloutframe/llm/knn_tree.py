"""Approximate nearest neighbours by a hierarchical k-means tree.

The top of the tree is fitted to a bounded sample (about ``SAMPLE_ROWS`` distinct
vectors, chosen by a hash). Every vector is filed under its leaf, and leaves of
more than twice ``LEAF_ROWS`` vectors are split by k-means again, all of a level
at once in one grouped job that sees a bounded sample of each, until none is
left. So a leaf's size does not grow with the table, up to ``MOST_LEAVES``
leaves; beyond that (some 2^28 vectors) leaves grow, and the tree, which is
broadcast, does not.

A query walks the tree best bin first: a priority queue holds the nodes met so
far by the inner product with their centres, plus a share (the lean) of the
query's length times the node's radius, which suits vectors of unequal length.
The best is opened next, until enough leaves are visited. A query's own leaf,
which holds all its copies, is always among them. How many are enough, and which
lean needs the fewest, is calibrated: for ``CALIBRATION`` queries the true
neighbours are found against all vectors in blocks, and the number of visits is
widened until the mean recall reaches ``TARGET``, both of all query rows (a
probe weighs as many as share its vector) and of the neighbours that are no
copies, whatever their rows.

Equal vectors are filed once, with the least ids that any query can need, so a
vector shared by a third of all rows is one entry. Neighbouring leaves are read
together as a group of about ``BLOCK_ROWS`` vectors, in which a query meets
those of its own leaves alone; larger leaves are split into blocks, and the
queries of a group into halls of ``HALL_ROWS``.

Defined cases: vectors that are null, zero, hold a null or non-finite component,
or have another dimension than most, take no part; with fewer candidates than
asked for all are returned; an empty table gives an empty result; ids are whole
numbers. Every row is a query and a candidate on its own: a query leaves out one
row, its own, and rows that repeat its id, with its vector or another one, are
found like any others, so an id that stands in several query rows is answered as
often.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import on_workers, shuffle_parts, stage

SAMPLE_ROWS, BRANCHES, LEAF_SAMPLE, ITERATIONS = 32_768, 8, 48, 8
CALIBRATION, TARGET, BLOCK_ROWS, HALL_ROWS = 200, 0.95, 4096, 1024
LEAF_ROWS, SPLIT_ROWS, MOST_LEAVES, LEANS = 2048, 8192, 1 << 17, (0.0, 0.25, 0.5, 1.0)


@dataclass
class Tree:
    """Centres and radii of the inner nodes' children; a child below zero is leaf ``-1 - child``."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    radii: list[np.ndarray] = field(default_factory=list)

    def walk(self, query: np.ndarray, lean: float = 0.0) -> Iterator[int]:
        """The leaves, best bin first."""
        queue: list[tuple[float, int]] = [(0.0, 0 if self.centres else -1)]
        reach = lean * float(np.linalg.norm(query))
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            score = self.centres[node] @ query
            if reach:
                score = score + reach * self.radii[node]
            for value, child in zip(score.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (-value, child))

    def visit(self, query: np.ndarray, most: int, lean: float = 0.0) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        return list(islice(self.walk(query, lean), most))

    def graft(self, below: dict[int, Tree]) -> None:
        """Put a tree in the place of each leaf named; its first leaf keeps the number, the others are new."""
        roots = {}
        for leaf, tree in below.items():
            at, names = len(self.centres), [leaf, *range(self.leaves, self.leaves + tree.leaves - 1)]
            roots[leaf] = at
            self.leaves += tree.leaves - 1
            self.centres += tree.centres
            self.radii += tree.radii
            self.children += [[c + at if c >= 0 else -1 - names[-1 - c] for c in own] for own in tree.children]
        first = min(roots.values(), default=len(self.centres))
        for own in self.children[:first]:
            own[:] = [roots.get(-1 - c, c) if c < 0 else c for c in own]

    def file(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre at each level."""
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            near = _nearest(vectors[rows], self.centres[node].astype(np.float64))
            for i, child in enumerate(self.children[node]):
                some = rows[near == i]
                if child < 0:
                    out[some] = -1 - child
                elif len(some):
                    todo.append((child, some))
        return out


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (vectors @ centres.T), axis=1)


def fit(sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_SAMPLE) -> Tree:
    """K-means of the sample, split again below until leaves hold ``leaf_rows`` of it."""
    tree, random = Tree(), np.random.default_rng(7)

    def grow(rows: np.ndarray) -> int:
        vectors = sample[rows]
        k = min(branches, len(rows) // leaf_rows)
        if k >= 2:
            centres = vectors[np.sort(random.choice(len(rows), k, replace=False))]
            for _ in range(ITERATIONS):
                near = _nearest(vectors, centres)
                held = np.bincount(near, minlength=k)
                sums = np.stack([np.bincount(near, vectors[:, j], k) for j in range(vectors.shape[1])], 1)
                centres = np.where(held[:, None] > 0, sums / np.maximum(1, held)[:, None], centres)
            near = _nearest(vectors, centres)
            used = np.flatnonzero(np.bincount(near, minlength=k))
            if len(used) >= 2:
                node = len(tree.centres)
                apart = ((vectors - centres[near]) ** 2).sum(1)
                tree.centres.append(centres[used].astype(np.float32))
                tree.radii.append(np.sqrt([apart[near == i].mean() for i in used]))
                tree.children.append([])
                tree.children[node] = [grow(rows[near == i]) for i in used]
                return node
        tree.leaves += 1
        return -tree.leaves

    grow(np.arange(len(sample)))
    tree.leaves = max(1, tree.leaves)
    return tree


def _matrix(column: pd.Series | list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def _clean(rows: DataFrame, kind: str) -> DataFrame:
    """(id, is_query, v): usable vectors of (id, vector, is_query) as bytes."""
    sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).count()
    found = sizes.orderBy(F.desc("count"), "d").first()
    d = found["d"] if found else 0

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            rows = np.flatnonzero(np.asarray(pc.equal(pc.list_value_length(column), d).fill_null(False)))
            values = column.take(pa.array(rows)).flatten()
            numbers = np.asarray(values.fill_null(np.nan)).astype(kind).reshape(len(rows), d) if d else np.empty((0, 0), kind)
            good = np.isfinite(numbers).all(1) & (numbers != 0).any(1)
            numbers = numbers[good] + 0  # one zero, not two
            at = pa.array(rows[good])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), pa.array([x.tobytes() for x in numbers], pa.binary())],
                ["id", "is_query", "v"],
            )

    return on_workers(rows.where(F.col("id").isNotNull())).mapInArrow(emit, "id long, is_query boolean, v binary")


def _distinct(clean: DataFrame, most: int) -> DataFrame:
    """(v, ids): each distinct vector with its ``most`` least ids, by salted partial merges."""
    least = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas().sort_values("id")
            ids = frame.groupby("v", sort=False)["id"].agg(lambda x: x.iloc[:most].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.index.tolist(), pa.binary()), pa.array(ids.tolist(), pa.list_(pa.int64()))], ["v", "ids"]
            )

    return (
        clean.select("id", "v").mapInArrow(emit, "v binary, ids array<long>")
        .groupBy("v", F.pmod(F.spark_partition_id(), F.lit(32)).alias("salt")).agg(least.alias("ids"))
        .groupBy("v").agg(least.alias("ids"))
    )


def _share(column: str, share: float, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Columns of each row whose score is among the ``most`` largest, ties included: (rows, columns)."""
    if scores.shape[1] <= most:
        return np.nonzero(np.ones_like(scores, bool))
    edge = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
    return np.nonzero(scores >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None])


def _leading(q: np.ndarray, score: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """The places of each query's ``most`` largest scores, equal ones by ``tie``."""
    order = np.lexsort((tie, -score, q))
    own = q[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < most]


def _truth(items: DataFrame, probes: list[bytes], k: int, kind: str) -> list:
    """(q, leaf, copy, n): where the true ``k`` nearest rows of each probe, itself left out, are filed."""
    queries = _matrix(probes, kind)
    number = {v: i for i, v in enumerate(probes)}

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                vectors, leaf = _matrix(frame["v"], kind), frame["leaf"].to_numpy()
                q, at = _best(queries @ vectors.T, k + 1)
                score = (vectors[at] * queries[q]).sum(1)
                some = _leading(q, score, leaf[at], k + 2)  # of equal scores no more than can count; the probe itself may not
                q, at, score = q[some], at[some], score[some]
                copy = frame["v"].map(lambda v: number.get(v, -1)).to_numpy()[at] == q
                yield pd.DataFrame({"q": q, "leaf": leaf[at], "copy": copy, "n": frame["n"].to_numpy()[at] - copy, "score": score})

    found = items.select("leaf", "v", F.size("ids").cast("long").alias("n")).mapInPandas(
        emit, "q long, leaf long, copy boolean, n long, score double"
    )
    nearer = Window.partitionBy("q").orderBy(F.desc("score"), "leaf").rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(k) - F.coalesce(F.sum("n").over(nearer), F.lit(0))
    return found.withColumn("n", F.least("n", room)).where(F.col("n") > 0).select("q", "leaf", "copy", "n").collect()


def _visits(
    tree: Tree, truth: list, queries: np.ndarray, rows: np.ndarray, own: np.ndarray, target: float, lean: float = 0.0
) -> tuple[int, float]:
    """The least number of visits with a mean recall of ``target``, own leaves being free, and that recall.

    ``rows``: the query rows of each probe; ``own``: the leaf it is filed under.
    """
    wanted: list[set[int]] = [set() for _ in queries]
    for r in truth:
        if r["leaf"] != own[r["q"]]:
            wanted[r["q"]].add(r["leaf"])
    at: list[dict[int, int]] = [{} for _ in queries]
    for q, query in enumerate(queries):
        if wanted[q]:
            for place, leaf in enumerate(tree.walk(query, lean)):
                if leaf in wanted[q]:
                    at[q][leaf] = place
                    if len(at[q]) == len(wanted[q]):
                        break
    depth = np.array([at[r["q"]].get(r["leaf"], 0) for r in truth], np.int64)
    n = np.array([r["n"] for r in truth], np.int64)
    weight = n * rows[[r["q"] for r in truth]] if truth else n
    other = n * ~np.array([r["copy"] for r in truth], bool)
    by = np.argsort(depth, kind="stable")
    found = []
    for share in (weight[by], other[by]):
        reached = np.cumsum(share)
        if len(by) and reached[-1]:
            place = np.searchsorted(reached, target * reached[-1], "right")
            found.append(int(depth[by][min(len(by) - 1, place)]) + 1)
    most = max(found, default=tree.leaves)
    return most, float(other[depth < most].sum() / max(1, other.sum())) if len(by) else 1.0


def _split(items: DataFrame, big: dict[int, int], kind: str, leaf_rows: int, salt: int) -> dict[int, Tree]:
    """A tree below each of the large leaves, fitted to a bounded sample of its vectors; a grouped job."""
    shares = [(leaf, min(1.0, SPLIT_ROWS / n), leaf_rows / n) for leaf, n in big.items()]
    small = items.sparkSession.createDataFrame(shares, "leaf long, share double, part double")
    some = items.join(F.broadcast(small), "leaf").where(
        F.pmod(F.xxhash64(F.lit(salt), "v"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    )

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = _matrix(frame["v"], kind)
        tree = fit(vectors, leaf_rows=max(LEAF_SAMPLE, int(len(vectors) * frame["part"].iloc[0])))
        return pd.DataFrame({
            "leaf": frame["leaf"].iloc[0], "node": range(len(tree.centres)), "leaves": tree.leaves, "children": tree.children,
            "centres": [c.tobytes() for c in tree.centres], "radii": [r.tolist() for r in tree.radii],
        })

    found: dict[int, Tree] = {}
    kinds = "leaf long, node int, leaves int, children array<long>, centres binary, radii array<double>"
    for r in some.select("leaf", "v", "part").groupBy("leaf").applyInPandas(grow, kinds).orderBy("leaf", "node").collect():
        tree = found.setdefault(r["leaf"], Tree(leaves=r["leaves"]))
        tree.children.append(list(r["children"]))
        tree.centres.append(np.frombuffer(r["centres"], np.float32).reshape(len(r["children"]), -1))
        tree.radii.append(np.array(r["radii"]))
    return found


def _groups(sizes: dict[int, int], leaves: int) -> np.ndarray:
    """The group of each leaf: neighbours share one while it holds up to ``BLOCK_ROWS`` vectors."""
    group, held, found = 0, 0, np.zeros(leaves, np.int64)
    for leaf in range(leaves):
        size = sizes.get(leaf, 0)
        if held and held + size > BLOCK_ROWS:
            group, held = group + 1, 0
        found[leaf] = group
        held += size
    return found


def _search(kind: str, keep: int):
    def run(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not (len(items) and len(queries)):
            return pd.DataFrame({"q": [], "vec_id": [], "score": [], "own": []})
        x, q = _matrix(items["v"], kind), _matrix(queries["v"], kind)
        ids = items["ids"].to_numpy()
        leaves, leaf = np.unique(items["leaf"].to_numpy(), return_inverse=True)
        wanted = np.stack([np.isin(leaves, own) for own in queries["leaves"]])[:, leaf]
        row, at = _best(np.where(wanted, q @ x.T, -np.inf), keep)
        row, at = row[wanted[row, at]], at[wanted[row, at]]
        score = (x[at] * q[row]).sum(1)  # the same for equal vectors, wherever they stand
        some = _leading(row, score, np.array([i[0] for i in ids], np.int64)[at], keep)
        row, at, score = row[some], at[some], score[some]
        n = np.array([len(ids[i]) for i in at], np.int64)
        same = items["v"].to_numpy()[at] == queries["v"].to_numpy()[row]
        frame = pd.DataFrame({
            "q": np.repeat(queries["q"].to_numpy()[row], n),
            "vec_id": np.concatenate([np.empty(0, np.int64), *[ids[i] for i in at]]),
            "score": np.repeat(score, n), "own": np.repeat(same, n),
        })
        frame = frame.sort_values(["q", "score", "vec_id"], ascending=[True, False, True])
        return frame.groupby("q").head(keep)

    return run


def nearest(
    table: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    target: float = TARGET,
    sample_rows: int = SAMPLE_ROWS,
    leaf_rows: int = LEAF_ROWS,
    report: dict | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where ``queries`` holds, the ``k`` nearest other rows found.

    ``report``, where given, gets the leaves, the largest one, the visits, the
    lean and the recall of the calibration.
    """
    kind = "<f4" if "float" in dict(table.dtypes)[vector_col] else "<f8"
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), queries.alias("is_query"))
    clean = stage(_clean(rows.select("id", "vector", "is_query"), kind).withColumn("row", F.monotonically_increasing_id()), "vectors")
    items = stage(_distinct(clean, k + 1), "distinct-vectors")
    n = items.count()
    sample = items.where(_share("v", sample_rows / max(1, n), 1)).select("v").toPandas()
    tree = fit(_matrix(sample["v"], kind) if len(sample) else np.empty((0, 1)))
    leaf_rows = max(leaf_rows, -(-n // MOST_LEAVES))
    spark, final = table.sparkSession, set()
    for level in count(1):
        held = spark.sparkContext.broadcast(tree)

        def file(frames: Iterator[pd.DataFrame], held: Broadcast = held) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield frame.assign(leaf=held.value.file(_matrix(frame["v"], kind)))[["leaf", "v", "ids"]]

        items = stage(items.select("v", "ids").mapInPandas(file, "leaf long, v binary, ids array<long>"), "leaves")
        # a row for each leaf, of which there are MOST_LEAVES or so at most
        sizes = {r["leaf"]: r["count"] for r in items.groupBy("leaf").count().collect()}
        big = {leaf: size for leaf, size in sizes.items() if size > 2 * leaf_rows and leaf not in final}
        below = _split(items, big, kind, leaf_rows, level) if big else {}
        final |= big.keys() - below.keys()  # these cannot be told apart
        if not below:
            break
        tree.graft(below)
    asked = clean.where("is_query")
    hashes = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    filed = items.select(*hashes, F.col("leaf").alias("own"))  # shuffled by hash, without the vectors
    wanted = asked.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    wanted = wanted.select("v", "n", *hashes).join(filed, ["h1", "h2"])
    wanted = stage(wanted.select("v", F.monotonically_increasing_id().alias("q"), "n", "own"), "queries")
    asked_for = wanted.count()
    some = wanted.where(_share("v", CALIBRATION / max(1, asked_for), 2)).select("v", "n", "own").toPandas()
    probes = [bytes(v) for v in some["v"]]
    truth = _truth(items, probes, k, kind) if probes else []
    given = (tree, truth, _matrix(probes, kind) if probes else np.empty((0, 1)), some["n"].to_numpy(), some["own"].to_numpy(), target)
    (visits, recall), lean = min(((_visits(*given, lean), lean) for lean in LEANS), key=lambda x: (x[0][0], x[1]))
    if report is not None:
        report.update(leaves=tree.leaves, largest=max(sizes.values(), default=0), visits=visits, lean=lean, recall=recall)
    groups = _groups(sizes, tree.leaves)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            vectors = _matrix(frame["v"], kind) if len(frame) else []
            for q, v, own, x in zip(frame["q"], frame["v"], frame["own"], vectors, strict=True):
                leaves = held.value.visit(x, visits, lean)
                leaves = np.array(leaves if own in leaves else [*leaves, own])
                out += [(g, q, v, leaves[groups[leaves] == g]) for g in np.unique(groups[leaves])]
            yield pd.DataFrame(out, columns=["grp", "q", "v", "leaves"])

    # dealt anew: Spark would read the small table as one split, and one task would walk for all
    dealt_out = wanted.repartition(max(shuffle_parts(spark), -(-asked_for // HALL_ROWS)), "q")
    steps = stage(dealt_out.mapInPandas(walk, "grp long, q long, v binary, leaves array<long>"), "walks")
    group_of = table.sparkSession.createDataFrame(list(enumerate(groups.tolist())), "leaf long, grp long")
    grouped = items.join(F.broadcast(group_of), "leaf")

    def parts(rows: DataFrame, name: str, most: int) -> DataFrame:
        return rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias(name))

    grid = F.broadcast(parts(grouped, "blocks", BLOCK_ROWS).join(parts(steps, "halls", HALL_ROWS), "grp"))
    dealt = grouped.join(grid, "grp").select(
        "grp", F.pmod(F.xxhash64("v"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("halls") - 1)).alias("hall"), "leaf", "v", "ids",
    )
    asked_of = steps.join(grid, "grp").select(
        "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("q"), F.col("halls")).alias("hall"), "q", "v", "leaves",
    )
    key = ["grp", "block", "hall"]
    hits = dealt.groupBy(*key).cogroup(asked_of.groupBy(*key)).applyInPandas(
        _search(kind, k + 1), "q long, vec_id long, score double, own boolean"
    )
    order = [F.desc("score"), F.asc("vec_id")]
    top = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("r") <= k + 1)
    # rows of equal id and vector are alike: the first of them stands for the query's own
    again = F.row_number().over(Window.partitionBy("q", "own", "vec_id").orderBy("r"))
    top = top.withColumn("own", F.col("own") & (again == 1))
    members = asked.join(wanted, "v").select("row", F.col("id").alias("query_id"), "q")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("r"))
    return (
        members.join(top, "q").where(~(F.col("own") & (F.col("query_id") == F.col("vec_id"))))
        .withColumn("rank", rank).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def digest(table: DataFrame) -> DataFrame:
    return nearest(table, F.col("vec_id") % 20 == 0)
