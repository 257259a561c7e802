"""Results that must not depend on names, on equal rows, on how a result is read, on scripts, or on where an index is cut."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheaf.llm import _coder, decontamination, jaccard_join, language_id, mixing, quality, registry, sharding, suffix_dedup, token_counts, token_file, toxicity
from sheaf.llm._session import new_folder
from sheaf.llm._text import Texts
from sheaf.llm._tokens import Pieces, default_path, load
from tests.llm.test_operators import WORDS, corpus, table
from tests.test_oracles import SF, rows

THUE = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = registry.QUERIES[name](spark, SF)
    result = con.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert rows(df.columns, df.collect()) == rows(result.columns, result.fetchall())


def test_shards_do_not_depend_on_the_reader(spark):
    df = spark.range(1000).select((F.col("id") % 700).alias("doc_id"), (F.col("id") * 37 % 91).alias("size"), F.lit(7).alias("shard"), F.lit("x").alias("slot"))
    out = sharding.shard_by_bytes(df.repartition(5), ["doc_id", "size"], "size", 6)
    want = sorted(map(tuple, out.collect()))
    assert out.columns == ["doc_id", "size", "shard", "slot"]
    assert sorted(map(tuple, out.coalesce(1).collect())) == want
    assert sorted(map(tuple, out.limit(0).unionByName(out).unionByName(out.filter("size < 0")).collect())) == want
    null = spark.createDataFrame([(None, 5), (None, 5), (1, None), (None, 5)], "doc_id long, size long")
    got = sharding.shard_by_bytes(null, ["doc_id", "size"], "size", 2).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0), (1, 1), (1, 2)]  # middles at 2.5, 7.5, 12.5 and 15 of 15


def test_equal_rows_are_split(spark):
    """A group of equal rows that holds the budget's edge is taken in part."""
    df = spark.createDataFrame([(None, "a", 30, 1.0)] * 400 + [(i, "b", 30, 1.0) for i in range(200)], "doc_id long, source string, size long, w double").repartition(6)
    got = mixing.mix_sources(df, "source", "size", "w", ["doc_id", "size"], weights=(1, 3), share=0.75).collect()
    assert len(got) == 600
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 30
    assert 0 < sum(r.repeats for r in got if r.source == "a") < 400


def test_many_sources_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 9}" if i % 9 else None, i % 13, 1.0) for i in range(300)], "doc_id long, source string, size long, w double")
    run = lambda: sorted(map(str, mixing.mix_sources(df, "source", "size", "w", ["doc_id", "size"]).collect()))
    want = run()
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert run() == want


def test_patterns_that_cancel_out(spark):
    """A word and its complement that a polynomial modulo 2**64 would take for one."""
    texts = Texts(pa.array([THUE, MORSE]))
    assert len(set(texts.hashes(*texts.words()[:2]).tolist())) == 2
    docs = spark.createDataFrame([(1, THUE), (2, MORSE)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.components(docs).collect()} == {1: 1, 2: 2}
    folder = new_folder(spark, "test-thue")
    token_file.write_tokens(docs, folder)
    tokenizer = load(default_path())
    assert {r.doc_id: r.ids[:-1] for r in token_file.read_tokens(spark, folder).collect()} == {1: tokenizer.encode(THUE).ids, 2: tokenizer.encode(MORSE).ids}


def test_pieces_with_one_hash(monkeypatch):
    """Pieces whose hashes are equal though they differ: the texts are encoded as wholes."""


    from sheaf.llm import _tokens

    monkeypatch.setattr(_tokens, "hash_of", lambda number, place, begin, size: np.zeros(len(begin), np.uint64))
    monkeypatch.setattr(_tokens, "_loaded", {})
    given = ["the cat sat", "", "on the mat"]
    ids, counts = Pieces(default_path()).encode(Texts(pa.array(given)))
    want = [load(default_path()).encode(t).ids for t in given]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]


def test_pieces_when_the_memory_is_full(monkeypatch):
    """Pieces with a space, without one and with odd white space, in texts that are met again after the memory was emptied."""
    from sheaf.llm import _tokens

    monkeypatch.setattr(_tokens, "KEPT", 60)
    monkeypatch.setattr(_tokens, "_loaded", {})
    rng, pieces = np.random.default_rng(6), Pieces(default_path())
    words = [" cat", "cat", ".", "\n", " über", "Wort", "  ", " 日本", "\u00a0", "\t", ",", " x" * 70, "\u00a0\u00a0", "7", " <|endoftext|>"]
    for _ in range(40):
        given = ["".join(rng.choice(words, rng.integers(0, 40))) + " " + "".join(map(chr, rng.integers(97, 123, 6))) for _ in range(5)] + ["", "a"]
        ids, counts = pieces.encode(Texts(pa.array(given)))
        want = [load(default_path()).encode(t, add_special_tokens=False).ids for t in given]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert pieces.kept["n"] < 200


def test_one_block_alone():
    rng = np.random.default_rng(9)
    ids = np.concatenate([rng.integers(0, 90_000, 100_000), rng.zipf(1.3, 60_000) % 50_000, [2**32 - 1]])
    code = _coder.encode(ids)
    blocks = len(code["block_crc"]) // 4
    for k in (0, 1, blocks // 2, blocks - 1):
        assert (_coder.decode(len(ids), **code, only=k) == ids[k * code["block"] : (k + 1) * code["block"]]).all()
    assert (_coder.decode(len(ids), **code) == ids).all()


def test_survey_counts_every_id():
    """Followers and neighbours in blocks at places that no stride of four or eight meets."""
    rng = np.random.default_rng(4)
    ids = rng.integers(100, 104, 1 << 20)
    ids[1::4], ids[2::4] = 5, 7
    header, place = _coder._survey(ids)
    assert (header.names[place] == ids).all() and (header.times == np.bincount(ids)[header.names]).all()
    slot = int((np.flatnonzero(header.names == 5).astype(np.uint32) * _coder._MULTIPLIERS[0] >> _coder._SHIFT)[0])
    assert header.names[header.follower[slot]] == 7 and header.sure[slot] == 31
    block = np.arange(1 << 20) // _coder.BLOCK
    ids = rng.integers(20, 30, 1 << 20) + 10 * (block % 2)
    ids[::8] = 1
    names = _coder._survey(ids)[0].names
    low, high = np.flatnonzero((names >= 20) & (names < 30)), np.flatnonzero(names >= 30)
    assert low.max() < high.min() or high.max() < low.min()


def test_fewer_bits_than_order_0():
    """All parts of the code together, on the driver's documents."""
    import pyarrow.parquet as pq

    column = pq.read_table(f"{SF}/documents.parquet").sort_by("doc_id").column("text").combine_chunks()
    ids, _ = token_file._ids_of(Texts(column), Pieces(default_path()), 0)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    code = _coder.encode(ids)
    assert 8 * sum(len(v) for v in code.values() if isinstance(v, bytes)) / len(ids) < float(-(share * np.log2(share)).sum())


def test_splices_in_every_script():
    tokenizer, starts = load(default_path()), token_counts.bounds(default_path())
    import random

    rng = random.Random(1)
    for letters, between in (("абвгдеж", [" "]), ("日本語中文字", ["。", "、"]), ("αβγδ", [" ", ", "]), ("日本語", [""])):
        text = "".join("".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice(between) for _ in range(20_000))
        n, chunks = token_counts.resynchronised(text, starts, 4096, 64)
        assert n == len(tokenizer.encode(text).ids)
        if between != [""]:  # each byte is encoded about once
            assert chunks <= len(text.encode()) // 4096 + 3


def test_names_give_way(spark):
    """Columns of the input that have a result's name don't crash an operator; the result's stands."""
    given = corpus(60)
    docs = table(spark, given)
    clash = docs.select("*", *[F.lit("old").alias(c) for c in ("target", "source_size", "sampling_key", "repeats", "taken", "lang_pred", "score", "slot", "n_words", "kept", "quality", "n_bytes", "n_tokens", "over_limit", "n_chunks", "toxic", "p_toxic", "component_id", "node", "root", "n_removed", "ids", "__s", "list")])
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, given[0][1], "old")], "doc_id long, text string, score string")

    def same(run, *names):
        new, old = run(clash), run(docs)
        assert sorted(map(str, new.select(*names).collect())) == sorted(map(str, old.select(*names).collect()))
        assert len(set(c.lower() for c in new.columns)) == len(new.columns)

    same(lambda d: mixing.mix_sources(mixing.sized(d), "source", "size", "quality_weight", ["doc_id", "size"]), "doc_id", "target", "taken", "repeats", "sampling_key", "source_size")
    names, log = language_id.fit_languages(docs)
    same(lambda d: language_id.predict_languages(d, names, log), "doc_id", "lang_pred", "score")
    same(lambda d: sharding.shard_by_bytes(d.withColumn("size", F.length("text")), ["doc_id"], "size", 4), "doc_id", "shard", "slot")
    model = quality.fit_quality(docs, labels)
    same(lambda d: quality.score_quality(d, model), "doc_id", "n_words", "kept", "quality")
    same(jaccard_join.components, "doc_id", "n_shingles", "component_id")
    same(lambda d: decontamination.search(d, bench, item_key="doc_id"), "doc_id", "item_doc_id", "score")
    same(lambda d: token_counts.count_tokens(d, 9), "doc_id", "n_bytes", "n_tokens", "over_limit")
    same(lambda d: toxicity.judge(d, labels) if "toxic" not in d.columns else toxicity.score_chain(d, toxicity.fit_chain(docs.select("doc_id", "text"), labels, toxicity.label_categories(), "toxic"), "toxic"), "doc_id", "toxic", "p_toxic")
    same(suffix_dedup.remove_repeats, "doc_id", "n_removed", "kept_sha256")

    def written(d):
        folder = new_folder(spark, "test-names")
        token_file.write_tokens(d, folder)
        return token_file.read_tokens(spark, folder)

    same(written, "doc_id", "start", "ids")


def test_scores_by_all_items():
    """Indexes of a few items each say what one index of all says."""

    import random

    rng = random.Random(12)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 60)))) for i in range(40)]
    column = pa.array([" ".join(rng.choice(WORDS) for _ in range(300)) + " " + t for _, t in items[:20]])
    known = decontamination.survey([items])
    one = {(r, decontamination.build_index(items).ids[t]): round(s, 9) for r, t, s, _, _ in decontamination.matches(decontamination.build_index(items), column, 0.3, 0.2)}
    several = {}
    for k in range(0, 40, 5):
        index = decontamination.build_index(items[k : k + 5], known=known)
        several |= {(r, index.ids[t]): round(s, 9) for r, t, s, _, _ in decontamination.matches(index, column, 0.3, 0.2)}
    assert one == several and len(one) >= 20
    assert decontamination.survey([items[:7], items[7:]]).n_units == known.n_units


def test_independent_bm25():
    """The index's impacts against BM25 written out anew over the units' words."""
    items = [(0, "red fox runs"), (1, "red red dog sleeps here"), (2, "a fox and a dog")]
    index = decontamination.build_index(items)
    units = [t.split() for _, t in items]
    mean = sum(map(len, units)) / 3
    for u, words in enumerate(units):
        raw = {}
        for w in set(words):
            df = sum(w in x for x in units)
            tf = words.count(w)
            raw[w] = np.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * (decontamination.K1 + 1) / (tf + decontamination.K1 * (1 - decontamination.B + decontamination.B * len(words) / mean))
        texts = Texts(pa.array([" ".join(raw)]), lower=True)
        rank = index.rank[np.searchsorted(index.terms, texts.hashes(*texts.words(plain=True)[:2]))]
        assert np.allclose(index.impact.get(rank, np.full(len(rank), u)), np.array(list(raw.values())) / sum(raw.values()))
