"""Fill-in-the-middle examples, cut by DuckDB inside ``mapInArrow``.

Each Arrow batch is registered with the task's own in-memory DuckDB connection
and one SQL statement cuts, renders and digests all of its rows; the answer goes
back as Arrow, and no Python sees a row. Batches are of about ``BATCH_BYTES`` of
text (a longer text comes alone), so a task's memory is that of a batch.

A text is cut into lines, each with its line feed. Four draws from a hash of the
id say where the prefix and the middle end, whether the text stays plain and
which of two orders it is written in. A text that holds a marker itself stays
plain. Lines never hold part of a marker at a cut, so each marker occurs just
once in an output, and the text is rebuilt from output and form alone.

Defined cases: a null text is an empty one, with no lines, and stays plain; a
null id draws like an empty one; rows that repeat an id are cut at the same
shares of their own lines; lines end at a line feed alone, so a carriage return
stays in its line; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers
from .words import slices

FIM_PERCENT, SPM_PERCENT, SEED, BATCH_BYTES = 100, 50, 7, 4 << 20
OUT = (
    "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, "
    "restored string, restored_sha256 string"
)

_SQL = r"""
WITH cut AS (
  SELECT id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, sha256('{seed}:' || key) AS h
  FROM (SELECT id, coalesce(text, '') AS text, coalesce(CAST(id AS VARCHAR), '') AS key FROM batch)),
drawn AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n,
    list_transform([1, 9, 17, 25], lambda x: CAST('0x' || substr(h, x, 8) AS BIGINT)) AS draw FROM cut),
formed AS (
  SELECT id, text, lines, n,
    least(draw[1] % (n + 1), draw[2] % (n + 1)) AS a, greatest(draw[1] % (n + 1), draw[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR draw[3] % 100 >= {fim} THEN 'plain'
         WHEN draw[4] % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT id, text, n, form, array_to_string(list_slice(lines, 1, a), '') AS p,
    array_to_string(list_slice(lines, a + 1, b), '') AS m, array_to_string(list_slice(lines, b + 1, n), '') AS s
  FROM formed),
written AS (
  SELECT id, n, form, p, m,
    CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts),
split AS (
  SELECT *, strpos(output, '<M>') AS at_m,
    strpos(output, CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS at_2 FROM written),
rebuilt AS (
  SELECT *, CASE form
    WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, 4, at_2 - 4) || substr(output, at_m + 3) || substr(output, at_2 + 3, at_m - at_2 - 3)
    ELSE substr(output, at_2 + 3, at_m - at_2 - 3) || substr(output, at_m + 3) || substr(output, 4, at_2 - 4) END AS restored
  FROM split)
SELECT id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, output, sha256(output) AS output_sha256,
  restored, sha256(restored) AS restored_sha256 FROM rebuilt
"""


def _cut(sql: str, names: list[str], kinds: pa.Schema):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as engine:
            for some in slices(batches, 1, BATCH_BYTES):
                engine.register("batch", pa.Table.from_batches([some]))
                found = engine.sql(sql).select(", ".join(names)).to_arrow_table()
                engine.unregister("batch")
                yield from found.cast(kinds).to_batches()

    return emit


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    seed: int = SEED,
    columns: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output"),
) -> DataFrame:
    """(id_col, and ``columns`` of those in ``OUT``) of every row.

    ``fim_percent`` of the texts are cut, ``spm_percent`` of these with the
    suffix first; ``prefix_chars`` and ``middle_chars`` count code points, null
    where a text stays plain.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    known = dict(x.split() for x in OUT.split(", "))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType.fromDDL(", ".join([f"id {dict(rows.dtypes)['id']}", *[f"{c} {known[c]}" for c in columns]]))
    sql = _SQL.format(seed=int(seed), fim=int(fim_percent), spm=int(spm_percent))
    cut = _cut(sql, ["id", *columns], to_arrow_schema(schema))
    return on_workers(rows).mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def digest(docs: DataFrame) -> DataFrame:
    return fill_in_middle(
        docs, columns=("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS f,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (
  SELECT *, len(f) - (f[-1] = '')::INT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR h3 % 100 >= 100
              THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
t AS (
  SELECT *, coalesce(list_sum(list_transform(f[1:a], lambda x: length(x) + 1)), 0)::BIGINT AS x,
         coalesce(list_sum(list_transform(f[1:b], lambda x: length(x) + 1)), 0)::BIGINT AS y FROM c),
o AS (
  SELECT *, substr(text, 1, x) AS p, substr(text, x + 1, y - x) AS m, substr(text, y + 1) AS s FROM t)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM o
"""
