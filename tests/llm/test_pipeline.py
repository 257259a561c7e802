"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import random

import corpus_pipeline

from sheaf.llm._tokens import default_path, load

WORDS = [a + b + c for a in ("ba", "ne", "ko", "lu") for b in ("da", "mi", "po", "re", "su") for c in ("va", "xi", "zo")]


def test_run(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(60, 120)))) for i in range(160)]
    item = " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(30)) + ".\n" + " ".join(rng.choice(WORDS) + "q" for _ in range(6))
    toxic, copies, leaks = set(range(0, 160, 5)), {}, set()
    for i in sorted(toxic):
        docs[i] = (i, docs[i][1] + " grumph blarg grumph snorkt")
    for i in range(61, 160, 10):
        copies[i] = i - 4
        docs[i] = (i, docs[i - 4][1] + " extra")
    for i in range(2, 50, 10):
        leaks.add(i)
        docs[i] = (i, docs[i][1] + "\n" + item)
    full = [(i, t, "aa", f"s{i % 2}", len(t)) for i, t in docs]
    for name, rows, schema in (
        ("documents", full, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(i, 1, int(i in toxic)) for i in range(160)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(0, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage, gone in ((corpus_pipeline.drop_toxic, toxic), (corpus_pipeline.drop_near_copies, set(copies)), (corpus_pipeline.drop_contaminated, leaks)):
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, str(tmp_path))
        assert {r.doc_id for r in kept.select("doc_id").collect()} == before - gone  # no clean document is lost
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = set(range(160)) - toxic - set(copies) - leaks
    assert {r.doc_id for r in got} <= clean
    words = {i: len(docs[i][1].split()) for i in clean}
    by = {s: sum(words[i] for i in clean if i % 2 == s) for s in (0, 1)}
    total = 1.5 * sum(by.values())
    target = {s: min(2 * by[s], total * w / 4) for s, w in ((0, 3), (1, 1))}
    for s in (0, 1):
        if target[s] == 2 * by[s]:
            target[1 - s] = min(2 * by[1 - s], total - target[s])
    for s in (0, 1):
        assert abs(sum(words[r.doc_id] for r in got if r.doc_id % 2 == s) - target[s]) <= 120
    tokenizer, at = load(default_path()), 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(tokenizer.encode(docs[r.doc_id][1], add_special_tokens=False).ids) + 1
        at += r.n_tokens


def test_stages_keep_the_columns():
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5


def test_near_copies_without_ids_of_their_own(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " extra"), (None, texts[2]), (3, texts[2]), (2, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (8, texts[5]), (None, None), (None, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    want = [(None, texts[0]), (None, texts[1]), (2, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5]), (None, None), (None, ""), (9, "")]
    assert got.columns == docs.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, columns with the operators' names, and an empty table."""
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(70))
    long, twice = " ".join(rng.choice(WORDS) for _ in range(30_000)), text()
    texts = [None, "", " ", twice, twice, long, *[text() for _ in range(20)]]
    rows = [(i % 17 if i % 6 else None, t, None if i % 4 == 0 else f"s{i % 2}", 1000 + i, "toxic?", None) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, source string, size long, toxic string, `repeats` string"
    spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "nothing like this stands anywhere\nnor this"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    shown = lambda df: sorted(map(repr, map(tuple, df.collect())))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_contaminated):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and shown(got) == shown(docs)
    got = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and got.count() == len(rows) - 1 and set(shown(got)) < set(shown(docs))
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and set(shown(mixed)) <= set(shown(docs))
    whole = sum(len((t or "").split()) for t in texts)
    assert abs(sum(len((r.text or "").split()) for r in mixed.collect()) - 1.5 * whole) <= 30_000
    ids = corpus_pipeline.write_tokens(spark, docs, str(tmp_path)).collect()
    assert len(ids) == len(rows) and sorted(r.n_tokens for r in ids)[:2] == [1, 1]
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
