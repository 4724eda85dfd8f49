"""Registered queries of the office archives and the merge of drafts from pictures, and their DuckDB twins.

Every part becomes a small archive with paragraphs, a formula, a picture and a table; a few archives are damaged.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import visual_merge
from paperloom.plans.bank_queries import table
from paperloom.sources import office
from paperloom.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_PICTURES = ["png", "wmf", "bin"]


def query(sql: str | None = None):
    """Register a query under its function's name; sql is its DuckDB twin."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _entries(spark, sf_dir) -> DataFrame:
    """Entries of an archive a part: its name, type and size in the markup of a document."""

    @F.pandas_udf("binary")
    def packed(key: pd.Series, name: pd.Series, kind: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for k, n, t, s in zip(key, name, kind, size):
            if k % 23 == 0:
                out.append(f"broken {k}".encode())
                continue
            run = lambda x: f"<w:r><w:t xml:space='preserve'>{x}</w:t></w:r>"
            frac = f"<m:oMath><m:f><m:fPr/><m:num><m:r><m:t>{s}</m:t></m:r></m:num><m:den><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>{k}</m:t></m:r></m:sup></m:sSup></m:den></m:f></m:oMath>"
            lines = [f"<w:p><w:pPr/>{run(f'{k}． {n} &amp; {t}')}</w:p>", "<w:p><w:pPr/></w:p>", f"<w:p>{run('面积')}{frac}<w:br/>{run('end')}</w:p>", f"<w:p><w:drawing><a:blip r:embed='r{k}'/></w:drawing></w:p>"]
            cell = lambda x: f"<w:tc><w:tcPr/><w:p>{run(x)}</w:p></w:tc>"
            cells = [cell(f"A. {s}"), cell(f"Ｂ、{n}"), cell("C)"), cell(f"{t}")][: 4 if s % 2 == 0 else 3]
            document = f"<w:document>{''.join(lines)}<w:tbl><w:tr>{''.join(cells)}</w:tr></w:tbl></w:document>"
            relations = f"<Relationships><Relationship Id='r{k}' Type='image' Target='media/p{k}.{_PICTURES[k % 3]}'/><Relationship Id='s' Target='/word/styles.xml'/></Relationships>"
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(office.DOCUMENT, document)
                z.writestr(office.RELATIONS, relations)
                if s % 5:
                    z.writestr(f"word/media/p{k}.{_PICTURES[k % 3]}", b"picture")
            out.append(held.getvalue())
        return pd.Series(out, dtype=object)

    # rows of a small file grow into archives: every core packs and opens its share
    parts = table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    files = parts.select(F.col("p_partkey").cast("string").alias("file_id"), packed("p_partkey", "p_name", "p_type", "p_size").alias("content"))
    return written(office.archive_entries(files))


_P = "WITH p AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS file_id, p_name AS n, p_type AS t, p_size AS s, ['png', 'wmf', 'bin'][p_partkey % 3 + 1] AS ext FROM part), g AS (SELECT * FROM p WHERE k % 23 != 0) "


@query(
    _P + "SELECT file_id, NULL AS entry, 'archive-invalid' AS error FROM p WHERE k % 23 = 0 UNION ALL SELECT file_id, unnest(['word/document.xml', 'word/_rels/document.xml.rels']), NULL FROM g UNION ALL SELECT file_id, 'word/media/p' || k || '.' || ext, NULL FROM g WHERE s % 5 != 0"
)
def a6_archive_entries(spark, sf_dir):
    return _entries(spark, sf_dir).select("file_id", "entry", "error")


@query(
    _P
    + """SELECT file_id, 'r' || k AS id, 'word/media/p' || k || '.' || ext AS target, 'image' AS type, ext, CASE ext WHEN 'png' THEN 'image/png' WHEN 'wmf' THEN 'image/wmf' ELSE 'application/octet-stream' END AS mime, ext = 'png' AS shown, s % 5 != 0 AS present FROM g
UNION ALL SELECT file_id, 's', 'word/styles.xml', '', 'xml', 'application/octet-stream', false, false FROM g"""
)
def a6_relationships(spark, sf_dir):
    return office.relationships(_entries(spark, sf_dir))


@query(
    _P
    + r"""SELECT file_id, 0 AS paragraph, k || '. ' || n || ' & ' || t AS text, false AS has_object FROM g UNION ALL SELECT file_id, 1, '面积 $\frac{' || s || '}{x^{' || k || '}}$ ' || chr(10) || ' end', false FROM g
UNION ALL SELECT file_id, 2, CASE WHEN ext = 'png' AND s % 5 != 0 THEN '[[IMAGE:r' || k || ']]' ELSE '[公式图片待转换:' || ext || ']' END, true FROM g UNION ALL SELECT file_id, 3, 'A. ' || s, false FROM g
UNION ALL SELECT file_id, 4, 'B、' || n, false FROM g UNION ALL SELECT file_id, 5, 'C)', false FROM g UNION ALL SELECT file_id, 6, t, false FROM g WHERE s % 2 = 0"""
)
def a6_paragraphs(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return office.paragraphs(entries, office.relationships(entries))


@query(_P + """SELECT file_id, 0 AS "table", 0 AS row, 4 AS n_cells, 'A. ' || s || ' B. ' || n || ' C.  D. ' || t AS text FROM g WHERE s % 2 = 0 UNION ALL SELECT file_id, 0, 0, 3, 'A. ' || s || ' Ｂ、' || n || ' C)' FROM g WHERE s % 2 != 0""")
def a6_table_rows(spark, sf_dir):
    return office.table_rows(_entries(spark, sf_dir))


@query(
    r"""WITH v AS (SELECT p_partkey, p_size AS s, p_name AS n, p_type AS t FROM part)
SELECT p_partkey AS draft_id, CASE WHEN s % 3 = 0 THEN 'old ' || n ELSE n END AS stem,
  [CASE WHEN s % 2 = 0 THEN '$\frac{' || s || '}{2}$' || chr(10) || '[[IMAGE:i' || s || ']]' ELSE '[[IMAGE:k]] ' || s END,
   CASE WHEN s % 5 = 0 OR s % 3 = 0 THEN t ELSE '$\sin x$ ' || t END, n, ''] AS options, s % 3 != 0 AS merged FROM v WHERE s % 3 != 0
UNION ALL SELECT p_partkey, 'old ' || n, [CASE WHEN s % 2 = 0 THEN '[公式图片待转换:wmf] [[IMAGE:i' || s || ']]' ELSE '[[IMAGE:k]] ' || s END, t, n, ''], false FROM v WHERE s % 3 = 0"""
)
def c12_visual_merge(spark, sf_dir):
    rows, s = table(spark, sf_dir, "part"), F.col("p_size")
    even = s % 2 == 0
    first = F.when(even, F.concat(F.lit("[公式图片待转换:wmf] [[IMAGE:i"), s, F.lit("]]"))).otherwise(F.concat(F.lit("[[IMAGE:k]] "), s))
    drafts = rows.select(
        F.col("p_partkey").alias("draft_id"), F.lit("b").alias("batch_id"), F.concat(F.lit("第"), F.col("p_partkey") % 900 + 1, F.lit("题")).alias("question_number"), F.concat(F.when(s % 3 == 0, "old ").otherwise("[公式图片待转换] "), "p_name").alias("stem"),
        F.array(first, "p_type", "p_name", F.lit("")).alias("options"), F.col("p_partkey").alias("group_id"),
    )
    # the second visual draft of a number must not be taken
    visual = rows.where("p_size % 3 != 0").select(
        F.col("p_partkey").alias("group_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"), (F.col("p_partkey") % 900 + 1).cast("string").alias("question_number"), "p_name", "p_type", "p_size",
    )
    better = F.when(s % 5 == 0, F.concat(F.lit("\\sin "), "p_type")).otherwise(F.concat(F.lit("$\\sin x$ "), "p_type"))
    seen = visual.select(
        "group_id", "ordinal", "question_number", F.when(F.col("ordinal") == 1, F.col("p_name")).otherwise("wrong").alias("stem"), F.array(F.concat(F.lit("$\\frac{"), "p_size", F.lit("}{2}$")), better, F.lit("[公式图片待转换] \\sin \\cos \\tan"), F.lit("")).alias("options"),
    )
    return visual_merge.merge_visual_drafts(drafts, seen, "group_id").select("draft_id", "stem", "options", "merged")
