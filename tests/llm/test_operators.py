"""Each operator against a plain version, on small fixtures with nulls, empty and long texts, ties, repeated rows and further columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sheaf.llm import _coder, decontamination, jaccard_join, language_id, mixing, quality, sharding, suffix_dedup, token_counts, token_file, toxicity
from sheaf.llm._session import new_folder
from sheaf.llm._text import Texts
from sheaf.llm._tokens import default_path, load

WORDS = [a + b for a in ("ba", "ne", "ko", "lu", "ri", "sha", "to") for b in ("da", "mi", "po", "re", "su", "va", "xi")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, note string"


def corpus(n: int = 120, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 90))]
        text = " ".join(words)
        if i % 7 == 3 and rows:
            other = (rows[rng.randrange(len(rows))][1] or "").split()
            for _ in range(rng.randint(0, 2)):
                if other:
                    other[rng.randrange(len(other))] = rng.choice(WORDS)
            text = " ".join(other)
        if i % 11 == 5:
            text = text.replace(" ", "\n", 5) + "\n" + text
        rows.append((i, text))
    rows[4], rows[9], rows[10] = (4, None), (9, ""), (10, " \n\t ")
    rows.append((n, "Überlänge ñandú 日本語 " * 3000))
    rows.append((n + 1, "<|endoftext|> odd  spaces \n and\ttabs"))
    return rows


def table(spark, rows, repeat: bool = False):
    full = [(i, t, None if i % 13 == 0 else ("aa", "bb")[i % 2], None if i % 10 == 0 else f"s{i % 3}", None, 1, "x") for i, t in rows]
    return spark.createDataFrame(full + (full[:3] if repeat else []), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def classes(sets):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_jaccard_join(spark):
    rows = corpus()
    want_sets = sets_of(rows)
    want = classes(want_sets)
    got = jaccard_join.components(table(spark, rows, repeat=True)).collect()
    assert len(got) == len(rows) + 3
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(s), want[i]) for i, s in want_sets.items()}
    assert sum(want[i] != i for i in want) > 3
    assert jaccard_join.components(empty(spark)).count() == 0


def test_jaccard_join_by_rows_without_key(spark):
    """Two documents that only a row with a null key connects, and rows with null keys that link with each other only."""
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(1, words(0, 100)), (None, words(8, 108)), (2, words(16, 116)), (None, words(500, 600)), (None, words(504, 604)), (3, words(800, 900))]
    got = jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(1, 1), (None, 1), (2, 1), (None, None), (None, None), (3, 3)], key=str)


def test_jaccard_signatures_meet():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        most = jaccard_join.most_different(len(a), len(a))
        drop = int(rng.integers(0, most // 2 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64)]))
        if len(b) and jaccard_join.linked(a, b):
            assert len(np.intersect1d(jaccard_join.signatures(a), jaccard_join.signatures(b)))


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 17, 200, 2000]:
        for kinds in (1, 2, 4):
            t = rng.integers(97, 97 + kinds, n).astype(np.uint8)
            raw = t.tobytes()
            got = suffix_dedup.two_stage(t, 50).tolist()
            assert sorted(got) == list(range(n))
            assert [raw[i : i + 50] for i in got] == sorted(raw[i : i + 50] for i in range(n))


def test_units_of_equal_windows():
    """Equal windows lie in units with one anchor at one distance, across tiles and in runs of equal grams."""
    rng = np.random.default_rng(5)
    copy = rng.integers(97, 123, 400).astype(np.uint8)
    texts = [rng.integers(97, 123, suffix_dedup.TILE - 200).astype(np.uint8), copy, np.full(90, 65, np.uint8), rng.integers(97, 123, 77).astype(np.uint8), copy, np.full(90, 65, np.uint8), copy[:49]]
    units = suffix_dedup.Units(Texts(pa.array([t.tobytes().decode() for t in texts])))
    begin = np.cumsum([0] + [len(t) for t in texts])
    assert [int((units.last - units.first + 1)[units.text == i].sum()) for i in range(7)] == [max(0, len(t) - 49) for t in texts]
    of = lambda i: [(a - begin[i], b - begin[i], k, s) for a, b, k, s, t in zip(units.first.tolist(), units.last.tolist(), units.anchor.tolist(), units.string.tolist(), units.text.tolist()) if t == i]
    assert of(1) == of(4) and of(2) == of(5)
    assert int(np.median(units.anchor >> np.uint64(32))) > 1 << 29  # spread over all of the bits that are sent


def test_suffix_dedup(spark):
    rows = corpus() + [(500, "z" * 300), (501, "z" * 200 + "y"), (502, "日本" * 60), (503, "本日" * 60)]
    texts = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(texts[i][k : k + 50], i)
    want = set()
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        edge = np.concatenate([[False], gone])
        want.add((i, len(t), int(gone.sum()), int((edge[1:] & ~edge[:-1]).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    got = suffix_dedup.remove_repeats(table(spark, rows, repeat=True)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(rows) + 3
    assert sum(w[2] > 0 for w in want) > 5
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_shards(spark):
    rows = corpus()
    df = table(spark, rows, repeat=True).selectExpr("doc_id", "coalesce(octet_length(text), 0) + 8 AS size", "note")
    got = sharding.shard_by_bytes(df, ["doc_id", "size"], "size", 5).collect()
    assert len(got) == len(rows) + 3 and {r.note for r in got} == {"x"}
    total, most = sum(r.size for r in got), max(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for s, own in by.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 5) <= most
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in order] == sorted(r.doc_id for r in got)
    assert sharding.shard_by_bytes(df.limit(0), ["doc_id", "size"], "size", 5).count() == 0


def test_targets(spark):
    def targets(sizes, weights):
        df = spark.createDataFrame(sizes, "source string, source_size long")
        return {r.source: r.target for r in mixing.source_targets(df, weights, 1.5, 2.0).collect()}

    t = targets([("a", 100), ("b", 10), (None, 50)], (3, 1, 2))
    assert list(sorted(t, key=str)) == [None, "a", "b"]
    assert t["b"] == 20 and t["a"] <= 200 and t[None] <= 100 and abs(sum(t.values()) - 240) < 1e-6
    assert targets([], (3, 1, 2)) == {}
    assert targets([("a", 0)], (3,)) == {"a": 0.0}
    rng = random.Random(3)
    for _ in range(8):  # against rounds that stop one source after another
        sizes = [(f"s{i}", rng.randint(0, 1000)) for i in range(7)] + [(None, rng.randint(0, 300))]
        weight = {s: (3, 1, 2)[i % 3] for i, (s, _) in enumerate(sizes)}
        left, open_, want = 1.5 * sum(n for _, n in sizes), dict(sizes), {}
        while over := [s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) > 2 * open_[s]]:
            for s in over:
                want[s] = 2.0 * open_.pop(s)
            left = 1.5 * sum(n for _, n in sizes) - sum(want.values())
        want |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        got = targets(sizes, (3, 1, 2))
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixing(spark):
    rows = corpus()
    docs = table(spark, rows, repeat=True)
    run = lambda: mixing.mix_sources(mixing.sized(docs), "source", "size", "quality_weight", ["doc_id", "size"]).collect()
    got = run()
    assert sorted(got, key=str) == sorted(run(), key=str) and len(got) == len(rows) + 3
    words = {i: len((t or "").split()) for i, t in rows}
    by = defaultdict(list)
    for r in got:
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 2 * r.size and r.note == "x"
        by[r.source].append(r)
    for own in by.values():
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r.size for r in own)
    assert mixing.mix_sources(mixing.sized(empty(spark)), "source", "size", "quality_weight", ["doc_id", "size"]).count() == 0


def test_tokens(spark):
    rows = corpus()
    docs = table(spark, rows, repeat=True)
    tokenizer = load(default_path())
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    got = token_counts.count_tokens(docs, 100, chunk=256).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {(i, len((t or "").encode()), len(want[i]), len(want[i]) > 100) for i, t in rows}
    assert max(r.n_chunks for r in got) > 10 and got[0].note == "x"
    folder = new_folder(spark, "test-tokens")
    token_file.write_tokens(docs, folder)
    read = sorted(token_file.read_tokens(spark, folder).collect())
    assert len(read) == len(rows) + 3
    at = 0
    for r in sorted(read, key=lambda r: r.start):
        assert r.start == at and r.ids == want[r.doc_id] + [0]
        at += r.n_tokens
    digest = token_file.read_tokens(spark, folder, digest=True).collect()
    assert {(r.doc_id, r.ids_crc32) for r in digest} == {(i, zlib.crc32(np.array(w + [0], "<u4").tobytes())) for i, w in want.items()}
    for df in (empty(spark),):
        folder = new_folder(spark, "test-tokens")
        token_file.write_tokens(df, folder)
        assert token_file.read_tokens(spark, folder).count() == 0
        assert token_counts.count_tokens(df, 1).count() == 0


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (5000, 1), (5000, 3), (5000, 60000), (40000, 500)])
def test_coder_round_trip(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = rng.integers(0, kinds, n)
    ids[n // 2 :] = ids[: n - n // 2]
    code = _coder.encode(ids)
    assert (_coder.decode(n, **code) == ids).all()
    if n > 1000 and kinds > 1:
        broken = bytearray(code["payload"])
        broken[len(broken) // 2] ^= 64
        with pytest.raises(ValueError, match="damaged"):
            _coder.decode(n, **{**code, "payload": bytes(broken)})


def test_resynchronised():
    tokenizer, starts = load(default_path()), token_counts.bounds(default_path())
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "'s", "1", "!!", "é", "日", "<|endoftext|>", "<|", "\t", "\u0085", " The", " of"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(1, 80)))
        assert token_counts.resynchronised(text, starts, 24, 4)[0] == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_language(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("xyz") + rng.choice("aei") if i % 2 else rng.choice("bdg") + rng.choice("uo") for _ in range(40))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "123 456"), (83, "xa ye zi " * 20000)]
    docs = table(spark, rows)
    names, log = language_id.fit_languages(docs.filter("doc_id < 40"))
    got = {r.doc_id: r for r in language_id.predict_languages(docs, names, log).collect()}
    assert names == ["aa", "bb"]
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] and 0.5 <= got[i].score <= 1 for i in range(80))
    assert [got[i].lang_pred for i in (80, 81, 82, 83)] == ["und", "und", "und", "bb"] and got[80].score == 0
    names, log = language_id.fit_languages(empty(spark))
    assert language_id.predict_languages(docs, names, log).filter("lang_pred <> 'und'").count() == 0


def plain_base(t):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if x.strip(" \t\n\v\f\r"):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality(spark):
    rng = random.Random(5)
    good = [(i, " ".join(rng.choice(WORDS) for _ in range(60))) for i in range(60)]
    bad = [(i, " ".join(rng.choice(WORDS).upper() + rng.choice(["!!", "###"]) for _ in range(60))) for i in range(60, 120)]
    rows = good + bad + [(200, None), (201, ""), (202, "a b\n\na b\nc#\nc#\n"), (203, "x y z w " * 5000), (204, "same line here\n" * 40)]
    docs = table(spark, rows, repeat=True)
    labels = spark.createDataFrame([(i, int(i < 60), None) for i in range(0, 120, 2)] + [(0, 1, None), (1, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        t = dict(rows)[r.doc_id] or ""
        n, chars, symbols, dup, again = plain_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again)
        assert r.base_failed == (n < 20 or 100 * again > 30 * n) and r.note == "x"
        if r.doc_id < 120:
            assert r.kept == (r.doc_id < 60)
    assert quality.fit_quality(docs, labels.limit(0)) is None
    assert quality.score_quality(docs, None).filter("kept").count() > 0
    assert quality.score_quality(empty(spark), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    rows = []
    for i in range(160):
        words = [rng.choice(WORDS) for _ in range(50)]
        if i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(50)] = rng.choice(["grumph", "blarg!", "Snorkt"])
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, " ".join(rng.choice(WORDS) for _ in range(20000))), (303, "grumph, blarg snorkt " * 3)]
    docs = table(spark, rows, repeat=True)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160) if i % 3], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    assert not any(got[i].toxic for i in range(160) if i % 4)
    assert sum(got[i].toxic for i in range(0, 160, 4)) >= 38
    assert [got[i].toxic for i in (300, 301, 302, 303)] == [False, False, False, True]
    assert got[0].p_low_quality is None and got[0].note == "x" and got[0].text
    assert toxicity.judge(docs, labels.limit(0)).filter("toxic").count() == 0
    assert toxicity.judge(empty(spark), labels).count() == 0


def test_decontamination(spark):
    rng = random.Random(7)
    sentence = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)).capitalize()
    items = [(i, f"{sentence(25)}?\n{sentence(4)}.") for i in range(20)] + [(20, None), (21, ""), (22, f"{sentence(600)}. Ja.")]
    rows = [(i, f"{sentence(120)}. {sentence(40)}.") for i in range(40)]
    for i in range(0, 40, 4):
        t = items[i // 4][1]
        rows[i] = (i, rows[i][1][:300] + " " + t.upper() + " " + rows[i][1][300:])
    rows += [(50, None), (51, ""), (52, sentence(30000) + " " + items[3][1]), (53, items[22][1]), (54, items[5][1].split("\n")[0])]
    docs = table(spark, rows, repeat=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.search(docs, bench).collect()}
    assert got == {(i, i // 4) for i in range(0, 40, 4)} | {(52, 3), (53, 22)}
    clean = decontamination.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in got}
    assert decontamination.search(docs, bench.limit(0)).count() == 0 and decontamination.search(empty(spark), bench).count() == 0


def test_retrieval_is_exhaustive():
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 30)))) for i in range(50)]
    index = decontamination.build_index(items)
    texts = Texts(pa.array([" ".join(rng.choice(WORDS) for _ in range(200)) for _ in range(10)]), lower=True)
    starts, ends, counts = texts.words(plain=True)
    hashes = texts.hashes(starts, ends)
    for threshold in (0.3, 0.6):
        begin, end, unit, score = decontamination.retrieve(index, hashes, counts, threshold)
        got = {(int(b), int(u)): round(float(s), 9) for b, u, s in zip(begin, unit, score)}
        want, base = {}, 0
        for n in counts.tolist():
            for b in range(0, n, index.stride):
                own = np.unique(hashes[base + b : base + min(n, b + 2 * index.stride)])
                at = np.minimum(np.searchsorted(index.terms, own), len(index.terms) - 1)
                rank = index.rank[at[index.terms[at] == own]]
                for u in range(index.n_units):
                    s = float(index.impact.get(rank, np.full(len(rank), u)).sum())
                    if s >= threshold - 1e-9:
                        want[base + b, u] = round(s, 9)
            base += n
        assert got == want and want
