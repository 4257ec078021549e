"""Line deduplication over levelled sorted runs of line hashes.

Every line of every document is reduced to a 128-bit hash of its key (the line
stripped of ASCII white space, A-Z lower-cased). A :class:`LineRuns` store
holds, per line hash, the number of documents seen with it and the largest of
their ids, in sorted runs: each batch of documents is merge-anti-joined with
the runs, what it adds becomes a run of level 0, and ``fanout`` runs of one
level are compacted into one of the next. Runs are tables bucketed and sorted
by hash, so merging them and joining a batch moves the batch alone: runs meet
bucket by bucket, in merge joins without an exchange. Batches come in falling
id order, so that a key that already has enough documents, and its keeper,
never changes again and the anti-join drops it from all later batches.

Only DataFrame functions run here: no Python on the executors.

Defined cases: a null text is one empty line; a null id neither causes nor
suffers a drop (its lines stay); rows that repeat an id count as one document,
but each text has its own line positions; a very long text is split once, in
time linear in its lines, and rebuilt as one value; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, scratch_path, shuffle_parts, stage

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 2
ADDED = ("_n_lines", "_n_dropped", "_drop_id", "_drop_text", "_drop_positions")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs of (h1, h2, n_docs, keep_id), bucketed and sorted by hash.

    A run's rows count all batches up to its own, so of two runs that hold a
    line the newer one, with the larger count, is right. The runs are tables of
    the session's catalogue while the store is open; their files lie in the
    shared folder. All have as many buckets as the session has shuffle
    partitions when the store is made.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = shuffle_parts(spark)
        self.levels: dict[int, list[str]] = {}
        self.tables: list[str] = []

    def _write(self, run: DataFrame, level: int) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = run.write.format("parquet").option("path", scratch_path(self.spark, f"line-run-l{level}"))
        writer.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        self.tables.append(name)
        return name

    def _run(self, name: str, number: int) -> DataFrame:
        return self.spark.table(name).select("h1", "h2", F.col("n_docs").alias(f"n{number}"), F.col("keep_id").alias(f"k{number}"))

    def _merged(self, names: list[str], level: int) -> str:
        """The runs as one, two at a time, for the result of a full join is no longer known to be bucketed."""
        while len(names) > 1:
            both = self._run(names[0], 0).hint("merge").join(self._run(names[1], 1), ["h1", "h2"], "full")
            whole = both.select("h1", "h2", F.greatest("n0", "n1").alias("n_docs"), F.greatest("k0", "k1").alias("keep_id"))
            names = [self._write(whole, level), *names[2:]]
        return names[0]

    def merged(self) -> DataFrame:
        """All runs compacted into one: a row for each line hash. There is a run at least."""
        names = [name for level in sorted(self.levels) for name in self.levels[level]]
        top = max(self.levels)
        self.levels = {top: [self._merged(names, top)]}
        return self.spark.table(self.levels[top][0])

    def add(self, batch: DataFrame) -> None:
        """``batch``: distinct (id, h1, h2); its ids are below all earlier ones.

        The batch meets each run in a left merge join, and lines with enough
        documents go by a filter: an anti-join would sink below the aggregation,
        and all rows of a hot line would meet in one task before they are counted.
        """
        own = batch.groupBy("h1", "h2").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keep_id")
        )
        names = [name for level in self.levels.values() for name in level]
        for number, name in enumerate(names):
            own = own.hint("merge").join(self._run(name, number), ["h1", "h2"], "left")
        before = F.greatest(F.lit(0), F.lit(0), *[f"n{i}" for i in range(len(names))])
        keep = F.greatest("keep_id", "keep_id", *[f"k{i}" for i in range(len(names))])
        new = own.where(before < self.min_docs).select(
            "h1", "h2", (F.col("n_docs") + before).alias("n_docs"), keep.alias("keep_id")
        )
        self.levels.setdefault(0, []).append(self._write(new, 0))
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            whole = self._merged(self.levels.pop(level), level + 1)
            level += 1
            self.levels.setdefault(level, []).append(whole)

    def close(self) -> None:
        """Forget the tables."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def line_index(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, t, h1, h2, positions): a row for each document, text and key that counts.

    ``t`` is the hash of the whole text. It tells rows that repeat an id apart
    as far as needed: those of equal texts drop the same positions.
    """
    # the hash is a column before the lines are exploded, or each line would hash the whole text
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), _lines(F.col(text_col)).alias("lines")
    )
    lines = texts.select("id", "t", F.posexplode("lines").alias("pos", "line"))
    keys = lines.select("id", "t", "pos", line_key(F.col("line")).alias("key")).where(
        F.length("key") >= min_chars
    )
    hashed = keys.select(
        "id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )
    return hashed.groupBy("id", "t", "h1", "h2").agg(F.collect_set("pos").alias("positions"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """``docs`` with ``text_col`` replaced, plus ``_n_lines`` and ``_n_dropped``.

    Keys of at least ``min_chars`` code points found in at least ``min_docs``
    documents lose all their lines except in the document with the largest id.
    Columns of ``docs`` with names in ``ADDED`` are replaced.
    """
    docs = docs.drop(*ADDED)
    spark = docs.sparkSession
    cuts = docs.select(
        F.percentile_approx(id_col, [i / batches for i in range(1, batches)], 1000).alias("cuts")
    ).first()["cuts"] or []
    batch = F.lit(0)
    for cut in sorted(set(cuts)):
        batch = batch + (F.col("id") > F.lit(cut)).cast("int")
    index = stage(
        line_index(docs, id_col, text_col, min_chars).withColumn("batch", batch), "lines", "batch"
    )
    runs = LineRuns(spark, min_docs, fanout)
    try:
        for number in reversed(range(len(set(cuts)) + 1)):
            runs.add(index.where(F.col("batch") == number).select("id", "h1", "h2").distinct())
        common = stage(
            runs.merged().where(F.col("n_docs") >= min_docs).select("h1", "h2", "keep_id"), "common-lines"
        )
    finally:
        runs.close()
    drops = (
        index.join(common, ["h1", "h2"])
        .where(F.col("id") != F.col("keep_id"))
        .groupBy(F.col("id").alias("_drop_id"), F.col("t").alias("_drop_text"))
        .agg(F.flatten(F.collect_list("positions")).alias("_drop_positions"))
    )
    # the text's hash in the key also spreads the rows without an id
    own = (docs[id_col] == drops["_drop_id"]) & (F.xxhash64(docs[text_col]) == drops["_drop_text"])
    joined = docs.join(drops.hint("shuffle_hash"), own, "left")
    lines = _lines(F.col(text_col))
    hit = F.col("_drop_positions").isNotNull()

    def without(text: Column) -> Column:
        """The lines left; bound to a name, the array is split once and not for each line."""
        places = F.array_except(F.sequence(F.lit(0), F.size(text["lines"]) - 1), text["drops"])
        return F.array_join(F.transform(places, lambda i: F.get(text["lines"], i)), "\n")

    bound = F.array(F.struct(lines.alias("lines"), F.col("_drop_positions").alias("drops")))
    return joined.select(
        *[F.col(c) for c in docs.columns if c != text_col],
        F.size(lines).cast("long").alias("_n_lines"),
        F.when(hit, F.size("_drop_positions")).otherwise(0).cast("long").alias("_n_dropped"),
        F.when(hit, F.get(F.transform(bound, without), F.lit(0)))
        .otherwise(F.coalesce(F.col(text_col), F.lit("")))
        .alias(text_col),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for whole ``documents``."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("text"), 256).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (c.key IS NOT NULL AND c.keep_id <> k.doc_id) AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
