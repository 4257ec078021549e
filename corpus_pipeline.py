"""The corpus pipeline: five operators of rolloutframe.llm, one after another.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``, whatever their number and order.
Each stage works on all that its predecessor kept:

1. quality classifier: documents judged bad or toxic go;
2. line dedup: lines that many documents share stay in one of them alone
   (``n_chars`` follows the text);
3. SimHash near-dedup: one row of each component stays, the one of least id,
   the first of those that repeat it; rows with a null id are components of their own;
4. benchmark decontamination: contaminated documents go;
5. best-fit packing: the pieces of what is left and their sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutframe.llm import decontaminate, line_dedup, packing, quality, simhash
from rolloutframe.llm.common import stage, table, vocabulary

#: Tokenizer ids and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


#: The columns that stages read; all others go through under names that clash with nothing.
READ = ("doc_id", "text", "source", "lang", "n_chars")
HOT = 1000


def _plain(docs: DataFrame) -> DataFrame:
    return docs.toDF(*[c if c in READ else f"_other{i}" for i, c in enumerate(docs.columns)])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = _plain(docs)
    kept = quality.classify(plain, table(spark, sf_dir, "labels")).where("_keep")
    return kept.select(plain.columns).toDF(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = _plain(docs)
    out = line_dedup.dedup_lines(plain)
    if "n_chars" in plain.columns:
        length = F.when(F.col("_n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length)
    return out.select(plain.columns).toDF(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = _plain(docs)
    # ids may repeat: rows are told apart by a number of their own, which staging keeps
    numbered = stage(plain.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = simhash.near_duplicates(numbered, row_col="_row").where(F.col("id").isNotNull()).select("id", "row", "root")
    found = stage(found, "components")
    groups = found.groupBy("root").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stage(groups.where("n > 1"), "groups")
    # a group with more than one in HOT of all rows is one of at most HOT, which a broadcast holds; the others fit a task
    is_hot = F.col("n") * HOT > numbered.count()
    hot = F.broadcast(groups.where(is_hot))
    others = found.join(hot.select("root"), "root", "left_anti").join(groups.where(~is_hot), "root")
    later = F.col("row") != F.col("first.row")
    gone = found.join(hot, "root").where(later).select("row").unionByName(others.where(later).select("row"))
    gone = stage(gone, "copies")
    return numbered.join(gone, numbered["_row"] == gone["row"], "left_anti").select(plain.columns).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = _plain(docs)
    marked = decontaminate.mark_contaminated(plain, table(spark, sf_dir, "benchmark"), keep_text=True)
    return marked.where(~F.col("contaminated")).select(plain.columns).toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
