"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolloutframe.llm.common import vocabulary

from .test_operators import SCHEMA, TEXTS, check_packing, fingerprint_brute, lines_brute, marked_brute, roots_brute, sha, table, verdicts_brute

SF = "/root/testdata/sf0.001"


def texts_of(docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    return [i for i, _ in rows], [t for _, t in rows]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"id": F.lit(1), "_keep": F.lit(False)})
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "line_dedup", "simhash_dedup", "decontamination", "best_fit_packing"]

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = steps["quality_classifier"](spark, docs, SF).cache()
    verdicts = verdicts_brute(docs, labels)
    wanted = sorted((r["doc_id"], r["text"]) for r in docs.collect() if verdicts[r["doc_id"]][-1])
    assert list(zip(*texts_of(kept), strict=True)) == wanted and kept.columns == docs.columns and len(wanted) < len(verdicts)

    ids, texts = texts_of(kept)
    deduped = steps["line_dedup"](spark, kept, SF).cache()
    found = dict(zip(*texts_of(deduped), strict=True))
    assert deduped.columns == docs.columns and sorted(found) == ids
    for n, (_, lines, dropped, digest) in enumerate(lines_brute(texts)):
        text = found[ids[n]]
        assert len(text.split("\n")) == max(1, lines - dropped)
        assert sha(text) == digest

    ids, texts = texts_of(deduped)
    single = steps["simhash_dedup"](spark, deduped, SF).cache()
    roots = roots_brute([fingerprint_brute(t) for t in texts])
    assert texts_of(single)[0] == [i for n, i in enumerate(ids) if roots[n] == n] and single.columns == docs.columns

    ids, texts = texts_of(single)
    clean = steps["decontamination"](spark, single, SF).cache()
    marks = marked_brute(texts, bench)
    assert texts_of(clean) == ([i for i, m in zip(ids, marks, strict=True) if not m[-1]], [t for t, m in zip(texts, marks, strict=True) if not m[-1]])
    assert any(m[-1] for m in marks) and clean.columns == docs.columns

    ids, texts = texts_of(clean)
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokens = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in zip(ids, texts, strict=True)}
    check_packing(steps["best_fit_packing"](spark, clean, SF).collect(), tokens)


def test_odd_rows_pass_every_stage(spark):
    """Nulls, repeated ids, empty and very long texts, clashing columns, and no rows at all."""
    odd = table(spark, [*TEXTS, None, "x"], [*range(len(TEXTS)), None, 3])
    for docs in (odd, spark.createDataFrame([], SCHEMA)):
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = step(spark, docs, SF)
            assert docs.columns == odd.columns
        assert {"doc_id", "piece", "sequence_id"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns)


def test_simhash_stage_keeps_one_row_of_each_component(spark):
    """Rows that repeat an id: a clean text stays, and repeated rows leave one."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    rows = table(spark, [a, a, b, c, c, d, d, d, b], [1, 2, 2, 3, 3, 2, 1, 1, None])
    found = corpus_pipeline.simhash_dedup(spark, rows, SF)
    assert found.columns == rows.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found.collect()) == [(0, b), (1, a), (1, d), (2, b), (3, c)]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
