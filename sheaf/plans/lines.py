"""Queries on the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import repeated
from ..sources.tables import table


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = repeated.split_lines(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return repeated.drop_repeated(lines, "source", "doc_id", "line", "line_no", ratio=0.05, least=3).select("doc_id", "line_no", "new_no", "line")


QUERIES = {"repeated_lines": repeated_lines}
ORACLE_SQL = {
    "repeated_lines": r"""
WITH l AS (
  SELECT doc_id, source, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents) x, LATERAL unnest(range(1, len(parts) + 1)) t(i)),
u AS (SELECT source, count(DISTINCT doc_id) AS units FROM l GROUP BY source),
r AS (SELECT l.source, l.line FROM l JOIN u USING (source) GROUP BY l.source, l.line, u.units
      HAVING count(DISTINCT l.doc_id) >= greatest(3, floor(u.units * 0.05)))
SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS new_no, line
FROM l ANTI JOIN r USING (source, line)
WHERE NOT regexp_full_match(line, '[\s\d\-–—·°.,;:()\[\]{}<>+=*/|_~^%&$#@!?''"\\]+')""",
}
