from pyspark.sql import functions as F

from notespark.operators import outline as O


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_outline_keys(spark):
    raw = spark.createDataFrame(
        [("d", 1, 1, "1. Graphs", 1), ("d", 2, 3, "2.3 Bipartite", 2), ("d", 3, 2, "", 5),
         ("d", 4, 2, "Trees", 6), ("d", 5, 1, "Index", 9), ("e", 1, 5, "Deep", 1)],
        "doc_id string, seq int, level int, title string, page int")
    assert rows(O.outline_keys(raw), "doc_id", "key", "title", "level") == [
        ("d", "1", "Graphs", 1), ("d", "1.1", "Bipartite", 2), ("d", "1.3", "Trees", 2),
        ("d", "2", "Index", 1), ("e", "1", "Deep", 1)]


NODES = [("2.2", 10), ("2.3", 14), ("2.3.1", 14)]
ENTRIES = [("2.2.1", 10), ("2.2.5", 12), ("2.2.6", 14), ("2.3.1", 14), ("2.3.2", 15)]


def test_placement(spark):
    nodes = spark.createDataFrame(
        [(d, i, k, [int(x) for x in k.split(".")], k.count(".") + 1, "t", p) for d in "ab" for i, (k, p) in enumerate(NODES)],
        "doc_id string, seq int, key string, key_path array<int>, level int, title string, page int")
    entries = spark.createDataFrame(
        [("a", i, n, p) for i, (n, p) in enumerate(ENTRIES)]
        + [("b", i, n, p) for i, (n, p) in enumerate(ENTRIES[1:])] + [("c", 1, "4.1.2", None), ("c", 2, "4.2.2", 3), ("b", 9, None, None)],
        "doc_id string, pos int, number string, page int")
    got = rows(O.assign_sections(entries, nodes), "doc_id", "pos", F.coalesce("section", F.lit("-")))
    assert [r[2] for r in got if r[0] == "a"] == ["2.2", "2.2", "2.2", "2.3.1", "2.3.1"]
    assert [r[2] for r in got if r[0] == "b"] == ["2.2", "2.3.1", "2.3.1", "2.3.1", "-"]
    placed, tree = O.choose_tree(entries, nodes)
    assert [r for r in rows(placed, "doc_id", "pos", "section") if r[0] == "c"] == [("c", 1, "4.1"), ("c", 2, "4.2")]
    assert [r[1] for r in rows(tree, "doc_id", "key") if r[0] == "c"] == ["4", "4.1", "4.2"]


def test_extent_depth_slides(spark):
    nodes = spark.createDataFrame(
        [("d", 1, 1), ("d", 2, 5), ("d", 3, 5), ("d", 4, 3), ("d", 5, 9)], "doc_id string, seq int, page int")
    counts = spark.createDataFrame([("d", 20)], "doc_id string, n_pages int")
    assert rows(O.section_extent(nodes, counts), "seq", "end_page") == [(1, 4), (2, 8), (3, 8), (4, 8), (5, 20)]
    sized = spark.createDataFrame(
        [("small", 1, 10)] * 3 + [("small", 2, 5)] * 5 + [("small", 3, 2)] * 5
        + [("big", 1, 60000)] * 3 + [("big", 2, 900)] * 20 + [("big", 3, 9)] * 30,
        "doc_id string, level int, size int")
    assert rows(O.display_depth(sized, ["doc_id"]), "doc_id", "depth") == [("big", 2), ("small", 2)]
    slides = spark.createDataFrame([("k", p, "S1") for p in (1, 3, 4)], "doc_id string, page int, deck_key string")
    parts = spark.createDataFrame([("k", 1, 3), ("k", 2, 4)], "doc_id string, seq int, page int")
    assert rows(O.slide_sections(slides, parts), "page", "section") == [(1, "S1"), (3, "S1.1"), (4, "S1.2")]
