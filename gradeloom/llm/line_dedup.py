"""Line dedup by overlapping windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.cluster import table, written

LINES = 3


def _row(df: DataFrame, key: str, text: str) -> list[F.Column]:
    """What tells documents apart: key and text, so that a repeated row is the same document."""
    return [F.col(f"`{key}`").cast("long").alias("_doc"), F.xxhash64(F.col(f"`{text}`")).alias("_sum")]


def later_occurrences(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """(_doc, _sum, _at, _from): the windows of ``lines`` lines that occurred before.

    ``_at`` is a window's first line, from 0; ``_from`` the first line it covers that its first
    occurrence, if that is in the same document, doesn't. Occurrences are ordered by key (null last),
    text hash and line. A window is told by the MD5 of its lines and so are its copies; windows of
    blank lines only aren't counted.
    """
    split = F.split(F.col(f"`{text}`"), "\n", -1)
    at = F.sequence(F.lit(0), F.size("_lines") - lines)
    made = docs.where(F.col(f"`{text}`").isNotNull()).select(*_row(docs, key, text), split.alias("_lines")).where(F.size("_lines") >= lines)
    window = lambda i: F.array_join(F.slice(F.col("_lines"), i + 1, lines), "\n")
    found = made.select("_doc", "_sum", F.posexplode(F.transform(at, window)).alias("_at", "_window"))
    found = found.where(F.col("_window").rlike(r"[^\x20\x09-\x0D]"))
    found = found.select("_doc", "_sum", "_at", F.unhex(F.md5(F.col("_window").cast("binary"))).alias("_key"))
    place = F.struct(F.col("_doc").isNull().alias("n"), F.col("_doc").alias("d"), F.col("_sum").alias("s"), F.col("_at").alias("a"))
    # pre-aggregated where it is read; what is seen once goes, and the rest is cut off so that a hot window can be split
    often = found.groupBy("_key").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first <> _last").select("_key", "_first")
    often = written(often, "line-windows")
    later = found.join(often, "_key").where(place > F.col("_first"))
    same = F.col("_first.d").eqNullSafe(F.col("_doc")) & (F.col("_first.s") == F.col("_sum"))
    return later.select("_doc", "_sum", "_at", F.when(same, F.greatest("_at", F.col("_first.a") + lines)).otherwise(F.col("_at")).alias("_from"))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lines: int = LINES) -> DataFrame:
    """All columns of ``docs`` with later occurrences removed from ``text``, and ``n_lines`` and ``n_removed`` (int).

    A line goes if a window of ``lines`` consecutive lines that covers it stood before, in a document
    with a smaller key or earlier in the same one; a window never takes lines of its own first
    occurrence. What stays is joined by ``\\n``. Lines are compared exactly, blank ones included.

    Null texts stay null with null counts; texts of fewer lines stay as they are. Rows of equal key
    and text are one document and get equal results; of rows with one key and different texts the one
    with the smaller hash is the earlier; null keys come last. Columns named n_lines or n_removed are replaced.
    """
    gone = later_occurrences(docs, key=key, text=text, lines=lines)
    covered = gone.select("_doc", "_sum", F.explode(F.sequence("_from", F.col("_at") + lines - 1)).alias("_line")).distinct()
    # covered positions merge to runs: within one, line and rank grow alike
    run = F.col("_line") - F.row_number().over(Window.partitionBy("_doc", "_sum").orderBy("_line"))
    covered = covered.withColumn("_run", run).groupBy("_doc", "_sum", "_run").agg(F.min("_line").alias("a"), F.max("_line").alias("b"))
    covered = covered.groupBy("_doc", "_sum").agg(F.collect_list(F.struct("a", "b")).alias("_gone"))  # runs of one document
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(*(F.col(f"`{c}`") for c in names), *_row(docs, key, text))
    covered = covered.withColumnRenamed("_doc", "_doc2").withColumnRenamed("_sum", "_sum2")
    met = whole.join(covered, F.col("_doc").eqNullSafe(F.col("_doc2")) & (F.col("_sum") == F.col("_sum2")), "left")
    split = F.split(F.col(f"`{text}`"), "\n", -1)
    # a mask of the lines from the sorted runs, so that a long text's lines are gone through once
    runs = F.array_sort("_gone")
    ends = F.concat(F.array(F.lit(-1)), F.transform(F.slice(runs, F.lit(1), F.size(runs) - 1), lambda r: r["b"]))
    mask = F.flatten(F.zip_with(runs, ends, lambda r, end: F.concat(F.array_repeat(F.lit(True), r["a"] - end - 1), F.array_repeat(F.lit(False), r["b"] - r["a"] + 1))))
    keep = F.filter(F.zip_with(split, mask, lambda line, stays: F.when(F.coalesce(stays, F.lit(True)), line)), lambda line: line.isNotNull())
    cut = F.when(F.col("_gone").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(keep, "\n"))
    n_lines = F.when(F.col(f"`{text}`").isNotNull(), F.size(split))
    n_removed = F.when(F.col(f"`{text}`").isNotNull(), F.coalesce(F.aggregate("_gone", F.lit(0), lambda n, r: n + r["b"] - r["a"] + 1), F.lit(0)))
    return met.select(*((cut.alias(c) if c == text else F.col(f"`{c}`")) for c in names), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, i, md5(l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2]) AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines WHERE len(l) >= 3)
  WHERE regexp_matches(l[i] || l[i + 1] || l[i + 2], '[^\x20\x09-\x0D]')
), ranked AS (
  SELECT doc_id, i, first_value(doc_id) OVER w AS fd, first_value(i) OVER w AS fi FROM windows WINDOW w AS (PARTITION BY k ORDER BY doc_id, i)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN fd = doc_id THEN greatest(i, fi + 3) ELSE i END, i + 3)) AS line
  FROM ranked WHERE fd <> doc_id OR fi <> i
), sets AS (
  SELECT doc_id, list(line) AS g FROM gone GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN g IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(g, i)), lambda i: string_split(text, chr(10))[i]), chr(10)) END AS text,
       CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines,
       CASE WHEN text IS NOT NULL THEN CAST(coalesce(len(g), 0) AS INTEGER) END AS n_removed
FROM documents d LEFT JOIN sets s ON d.doc_id = s.doc_id
"""
