"""The driver contract, with and without the training-data subpackage; operators' edge cases."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

from sheaf.functions import text as tx
from sheaf.operators import catalog, folds, intervals, repeated, spans, stats
from sheaf.plans import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_training_data_operators(tmp_path):
    for name in ("sheaf", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'repeated_lines' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "sheaf")):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, n)).read()


def test_three_medians(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 3.0, 1), ("a", 4.0, 1), ("b", 5.0, 3), ("b", 9.0, 1)], "k string, v double, w int")
    assert {tuple(r) for r in df.groupBy("k").agg(stats.upper_median("v")).collect()} == {("a", 3.0), ("b", 9.0)}
    assert {tuple(r) for r in stats.weighted_median(df, ["k"], "v", "w", upper=False).collect()} == {("a", 2.0), ("b", 5.0)}
    assert {tuple(r) for r in stats.weighted_median(df, ["k"], "v", "w", upper=True).collect()} == {("a", 3.0), ("b", 5.0)}


def test_intervals_that_touch_stay_apart(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 3.0, 6.0), (1, 6.0, 8.0), (1, 20.0, 21.0)], "k int, start double, end double")
    got = intervals.merge_intervals(df, ["k"], "start", "end").orderBy("start").collect()
    assert [(r.start, r.end, r.n) for r in got] == [(0, 6, 2), (6, 8, 1), (20, 21, 1)]


def test_equal_intervals_are_one_union(spark):
    """Rows that the order leaves tied (as order 145164 of sf0.1 has) neither split an island nor join the one before."""
    rows = [(1, 60.0, 82.0), (1, 20.0, 35.0), (1, 60.0, 82.0), (1, 20.0, 30.0), (2, 5.0, 5.0), (2, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k int, start double, end double").repartition(3)
    got = intervals.merge_intervals(df, ["k"], "start", "end").orderBy("k", "start").collect()
    assert [tuple(r) for r in got] == [(1, 20, 35, 2), (1, 60, 82, 2), (2, 5, 5, 1), (2, 5, 5, 1)]


def test_rejected_events_leave_no_trace(spark):
    rows = [(1, 1, 10, "a", 10), (1, 2, 5, "b", 999), (1, 3, 10, "c", 50), (1, 4, 11, "d", 3), (1, 5, 2_000_000, "e", 1)]
    df = spark.createDataFrame(rows, "k int, at int, stamp long, value string, read long")
    r = catalog.reading_state(df, "k", "stamp", "at", "value", "read", 1_000_000).first()
    assert (r.updated_at, r.reading, r.last_read, r.n_accepted) == (11, "d", 10, 2)


def test_pack_admits_an_oversize_row_alone(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([10, 200, 10, 90, 1])], "k int, i int, size long")
    got = folds.pack(df, ["k"], ["i"], "size", 3, 100).orderBy("i").collect()
    assert [r.chunk for r in got] == [0, 1, 2, 2, 3]


def test_repeated_default_threshold(spark):
    docs = spark.createDataFrame([("s", i, f"head\nbody {i}\n12") for i in range(4)], "source string, doc_id int, text string")
    kept = repeated.drop_repeated(repeated.split_lines(docs), "source", "doc_id", "line", "line_no").collect()
    assert sorted((r.line, r.new_no) for r in kept) == [(f"body {i}", 0) for i in range(4)]


def test_search_offsets(spark):
    df = spark.createDataFrame([("aaaa",), ("abcabxab",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.literal_offsets(F.col("t"), "aa")).collect()] == [[0, 2], [], [], None]
    assert df.select(tx.literal_offsets(F.col("t"), "ab")).collect()[1][0] == [0, 3, 6]


def test_every_match_has_a_snippet(spark, tmp_path):
    text = "a <nation> " + "x" * 100 + " station" + "y" * 70
    spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "tiontion")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r["at"]): r.snippet for r in catalogue.QUERIES["search_snippets_all"](spark, str(tmp_path)).collect()}
    second = text.rindex("tion")
    assert got == {
        (1, 5): "a &lt;nation&gt; " + "x" * 58 + "…",
        (1, second): "…" + text[second - 40 : second + 64] + "…",
        (4, 0): "tiontion",
        (4, 4): "tiontion",
    }


def test_titles(spark):
    df = spark.createDataFrame([("A ﬁne soft­ware trans-\nlation  of\tthings",)], "t string")
    assert df.select(tx.clean_title(F.col("t"))).first()[0] == "A fine software translation of things"


def test_citations_round_trip(spark):
    text = "As Smith et al. (2019) and (Jones, 2001; Wu and Li, 2020b) say [1, 2–4]. ⟦C0⟧ stays."
    masked, tokens, values = spans.mask_text(text)
    assert tokens[0] == "⟦C1⟧" and "2019" not in masked and "[1" not in masked and "2001" not in masked
    df = spark.createDataFrame([(text,)], "t string").withColumn("m", spans.mask("t"))
    assert df.select(spans.restore(F.col("m.masked"), F.col("m.tokens"), F.col("m.cited"))).first()[0] == text


def test_markup(spark):
    df = spark.createDataFrame([("⟪a⟫ ⟪b⟫",), ("⟫⟪",), ("⟪",), ("",)], "t string")
    assert [r[0] for r in df.select(spans.markup_balanced(F.col("t"), "⟪", "⟫")).collect()] == [True, False, False, True]
