"""The document store, extraction, search in normal forms and cuts at sentences, on small fixtures with hand-made results."""

from __future__ import annotations

import json

import pytest

from sheaf.functions import search
from sheaf.operators import extraction, page, spans
from sheaf.sources import store

H1, H2 = "a" * 64, "b" * 64


def test_normal_form():
    raw = "Eﬃ­cient  exam-\n ple\tÄX"
    text, starts, ends = search.normal_form(raw)
    assert text == "efficient example äx"
    assert [raw[a:b] for a, b in search.matches(raw, "EFFICIENT")] == ["Eﬃ­cient"]
    assert [raw[a:b] for a, b in search.matches(raw, "ent exam")] == ["ent  exam"]
    assert [raw[a:b] for a, b in search.matches(raw, "example äx")] == ["exam-\n ple\tÄX"]
    assert search.matches(raw, " ") == [] and search.matches("", "x") == []
    assert search.matches("aaaa", "aa") == [(0, 2), (2, 4)]
    assert search.in_segments((3, 9), [(0, 4), (4, 6), (6, 6), (8, 12)]) == [(0, 3, 4), (1, 0, 2), (3, 0, 1)]
    assert search.compact("a b\n c") == ("abc", [0, 2, 5])


def test_sentence_pieces():
    a, b = "x" * 180 + ".", "Y" * 10 + "!"
    assert search.sentence_pieces(f"{a} {b}  Z.") == [a, f"{b}  Z."]
    assert search.sentence_pieces("short. Text") == ["short. Text"]
    marked = f"__STYLE_0001_OPEN__{a} Q__STYLE_0001_CLOSE__"
    assert search.sentence_pieces(marked) == [marked]


def test_merged_spans():
    assert spans.merged([(5, 9), (0, 4), (3, 5), (4, 4), (20, 21), (0, 2)]) == [(0, 5), (5, 9), (20, 21)]
    assert spans.merged([]) == []


def line(doc, number, n, text, y0, x0=50.0, size=10.0, bold=False, font="Times", dx=1.0, skip=False, source=1):
    return (doc, doc * 100 + number, number, n, text, x0, y0, x0 + 200, y0 + 10, size, font, bold, False, 0, skip, False, None, None, source, dx, 0.0)


LINES = "doc long, page long, page_no int, n int, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, bold boolean, italic boolean, color int, skip boolean, whole boolean, table int, algorithm int, source int, dx double, dy double"


def test_document_extraction(spark):
    rows = []
    for p in range(4):
        rows += [line(1, p, 0, "Journal of Things", 10.0), line(1, p, 99, str(p + 1), 780.0)]
    rows += [line(1, 0, 1, "A long exam-", 100.0, x0=60.0), line(1, 0, 2, "ple of prose", 112.0), line(1, 0, 3, "x_1 = y^2", 140.0, font="CMMI10"), line(1, 0, 4, "turned", 200.0, dx=0.0), line(1, 0, 5, "  ", 300.0)]
    rows += [line(1, 1, 1, "References", 100.0, bold=True), line(1, 1, 2, "[1] Lee. A study", 120.0, source=2), line(1, 1, 3, "plain words of it", 160.0)]
    rows += [line(1, 2, 1, "still in the list", 100.0), line(1, 2, 2, "Appendix A", 200.0, bold=True), line(1, 2, 3, "body again", 300.0)]
    got = extraction.documents(spark.createDataFrame(rows, LINES)).orderBy("page_no", "id").collect()
    assert [(r.page_no, r.id, r.text, r.skip, r.math, r.lines, r.indent) for r in got] == [
        (0, 0, "A long example of prose", False, False, 2, 10.0), (0, 1, "x_1 = y^2", False, True, 1, 0.0), (0, 2, "turned", False, False, 1, 0.0),
        (1, 0, "References", True, False, 1, 0.0), (1, 1, "[1] Lee. A study", True, False, 1, 0.0), (1, 2, "plain words of it", True, False, 1, 0.0),
        (2, 0, "still in the list", True, False, 1, 0.0), (2, 1, "Appendix A", False, False, 1, 0.0), (2, 2, "body again", False, False, 1, 0.0),
    ]
    assert extraction.documents(spark.createDataFrame([], LINES)).count() == 0


@pytest.mark.parametrize("change,want", [({}, True), ({"y0": 123.0}, False), ({"x0": 63.0}, False), ({"size": 11.0}, True), ({"size": 13.0}, False), ({"bold": True}, False), ({"table": 2}, False), ({"math": True}, False), ({"rotated": True}, False), ({"y0": 107.0, "y1": 118.0}, True), ({"y0": 103.0, "y1": 113.0}, False)])
def test_lines_join(change, want):
    a = {"table": None, "algorithm": None, "math": False, "skip": False, "whole": False, "rotated": False, "x0": 50.0, "y0": 100.0, "y1": 110.0, "size": 10.0, "source": 1, "text": "goes on", "bold": False, "italic": False, "color": 0}
    assert page.may_join(a, a | {"y0": 112.0, "y1": 122.0} | change) is want


def test_store(spark, tmp_path, tmp_path_factory):
    (tmp_path / "library" / "presentation").mkdir(parents=True)
    (tmp_path / "cache").mkdir()
    pages = [{"page": 0, "width": 600, "height": 800, "rotation": 0, "blocks": [{"id": 0, "bbox": [1, 2, 3, 4], "text": "a\nb", "bold": True}, {"id": 1, "text": "c"}], "protected": [[0, 0, 5, 5]]}, {"page": 1, "width": 600, "height": 800, "blocks": []}]
    (tmp_path / f"{H1}.pages.json").write_text(json.dumps(pages))
    (tmp_path / f"{H2}.pages.json").write_text("[{broken")
    (tmp_path / f"{H1}.meta.json").write_text(json.dumps({"file_name": "f.pdf", "extract_ver": 3, "outline": [[1, "One", 2], ["x", "No", 1], [2, "Two"]]}))
    (tmp_path / f"{H1}.pdf").write_bytes(b"12345")
    whole = {"hash": H1, "title": "T", "file_name": "f", "page_count": 2, "imported_at": 5, "last_read": 0, "updated_at": 1}
    (tmp_path / "library" / f"{H1}.json").write_text(json.dumps(whole))
    (tmp_path / "library" / f"{H2}.json").write_text(json.dumps(whole))
    (tmp_path / "library" / "presentation" / f"file-{H1}.json").write_text(json.dumps({"display_title": "Mine", "archived": False, "presentation_revision": 4}))
    (tmp_path / "cache" / f"{H1}.json").write_text(json.dumps({"k0": ["x", "y"], "partial|k0": ["z", None], "partial|k1": ["q"]}))
    folder = str(tmp_path)
    got = store.read_pages(spark, folder)
    assert sorted((r.page, r.block.text if r.block else None) for r in got.collect()) == [(0, "a\nb"), (0, "c"), (1, None)]
    out = f"{tmp_path_factory.mktemp('written')}/pages"
    store.write_pages(got, out)
    back = spark.read.json(out).orderBy("page").collect()
    assert [(r.page, [b.text for b in r.blocks]) for r in back] == [(0, ["a\nb", "c"]), (1, [])]
    assert [tuple(r) for r in store.read_meta(spark, folder).collect()] == [(H1, "f.pdf", 3)]
    assert [tuple(r) for r in store.read_outline(spark, folder).collect()] == [(H1, 0, 1, "One", 2)]
    shelf = {r.name: r for r in store.read_library(spark, folder, folder).collect()}
    assert (shelf[H1].presentation.display_title, shelf[H1].available, shelf[H1].damaged) == ("Mine", True, False)
    assert (shelf[H2].presentation.presentation_revision, shelf[H2].available, shelf[H2].damaged) == (0, False, True)
    cache = store.read_cache(spark, folder)
    keys = spark.createDataFrame([(H1, 0, "k0"), (H1, 1, "k1")], "hash string, page int, key string")
    counts = spark.createDataFrame([(H1, 0, 2), (H1, 1, 3)], "hash string, page int, blocks int")
    assert [tuple(r) for r in store.cached_pages(cache, keys, counts).collect()] == [(H1, 0, ["x", "y"])]
    assert {r.kind: r.files for r in store.storage(spark, folder).collect()} == {"papers": 1, "extracted": 3, "records": 3, "translations": 1}
    assert store.read_cache(spark, f"{folder}/none").count() == 0
    assert store.file_stats(spark, folder, "*.pdf").first().bytes == 5
