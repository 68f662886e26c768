import random

import pytest
from pyspark.sql import functions as F

from notespark import scan as S
from notespark.operators import chains as C, tasks as T


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_find_tasks(spark):
    sheets = spark.createDataFrame([
        ("gap", "3. Übungsblatt\n1. Sei G\n2. Zeige\n3.\nFormel\n4. Let"),
        ("last", "(1) A\n(2) B\n(3)\n(a) Prove"),
        ("equation", "(1) A\n(2) B\n(3)\nno part"),
        ("restart", "(1) Banded\n(2) Sparse\n(1) Exercise 11.1\n(2) Exercise 11.2\n(3) Exercise 11.3"),
        ("words", "Aufgabe 1: Konvexe Mengen.\nSei C.\na) x\nb) y\nAufgabe 2\nLösen Sie Aufgabe (1.1) vom Skriptum"),
        ("none", "nothing here"),
        ("far", "1. A\n2. B\n3." + "\n" * 25 + "(a) Prove"),
    ], "sheet_id string, text string")
    got = {}
    for sid, num, text in rows(T.find_tasks(sheets), "sheet_id", "number", "text"):
        got.setdefault(sid, []).append((num, text))
    assert [n for n, _ in got["gap"]] == [1, 2, 3, 4]
    assert [n for n, _ in got["last"]] == [1, 2, 3]
    assert [n for n, _ in got["equation"]] == [1, 2]
    assert [n for n, _ in got["far"]] == [1, 2, 3]
    assert got["restart"] == [(1, "Exercise 11.1"), (2, "Exercise 11.2"), (3, "Exercise 11.3")]
    tasks = rows(T.extract_tasks(sheets.filter("sheet_id = 'words'")), "number", "title", "script_references",
                 F.transform("subparts", lambda s: s["label"]))
    assert tasks == [(1, "Konvexe Mengen", [], ["a", "b"]), (2, None, ["1.1"], [])]


@pytest.mark.parametrize("limit", ["2000000", "2"])
def test_split_documents(spark, limit):
    spark.conf.set(S.GROUP_ROWS_SETTING, limit)
    pages = spark.createDataFrame(
        [("d", 1, "Numerics", 1), ("d", 2, "Numerics", 1), ("d", 3, "More", None), ("d", 4, "Numerics", 2),
         ("d", 5, "Numerics", None), ("w", 1, "A", None), ("w", 2, "A", 3)],
        "doc_id string, page int, first_line string, number int")
    assert rows(T.split_documents(pages), "doc_id", "page", "part") == [
        ("d", 1, 1), ("d", 2, 1), ("d", 3, 1), ("d", 4, 2), ("w", 1, 1), ("w", 2, 1)]
    spark.conf.unset(S.GROUP_ROWS_SETTING)


@pytest.mark.parametrize("limit", ["2000000", "5"])
def test_folds_against_loops(spark, limit):
    rnd = random.Random(11)
    items = [(k, i, rnd.randint(0, 12)) for k in "ab" for i in range(14)] + [("c", 0, 99), ("c", 1, 3)]
    spark.conf.set(S.GROUP_ROWS_SETTING, limit)
    try:
        df = spark.createDataFrame(items, "k string, pos int, size int")
        got = rows(C.pack_batches(df, ["k"], 20), "k", "pos", "batch")
        want = []
        for k in "abc":
            batch, used = -1, None
            for _, pos, size in [x for x in items if x[0] == k]:
                if used is None or used + size > 20:
                    batch, used = batch + 1, 0
                used += size
                want.append((k, pos, batch))
        assert got == sorted(want)

        nums = [(k, i, rnd.randint(1, 9), rnd.random() < .1) for k in "ab" for i in range(14)]
        df = spark.createDataFrame(nums, "k string, pos int, last int, free boolean")
        want = []
        for k in "ab":
            prev = 0
            for _, pos, v, free in [x for x in nums if x[0] == k]:
                if free or 0 < v - prev <= 3:
                    want.append((k, pos))
                    prev = v
        assert rows(C.monotone(df, ["k"], exempt="free"), "k", "pos") == want
    finally:
        spark.conf.unset(S.GROUP_ROWS_SETTING)


def test_folds_of_a_null_key(spark):
    items = spark.createDataFrame([(None, i, 5) for i in range(3)] + [(1, 0, 5), (1, 1, 5)], "k int, pos int, size int")
    assert sorted((r["k"] is None, r["pos"], r["batch"]) for r in C.pack_batches(items, ["k"], 10).collect()) == [
        (False, 0, 0), (False, 1, 0), (True, 0, 0), (True, 1, 0), (True, 2, 1)]
    cands = spark.createDataFrame([(None, i, v) for i, v in enumerate([1, 9, 2, 2, 3])], "k int, pos int, last int")
    assert sorted(r["pos"] for r in C.monotone(cands, ["k"]).collect()) == [0, 2, 4]


@pytest.mark.parametrize("limit", ["2000000", "4"])
def test_ties_are_broken_alike(spark, limit):
    spark.conf.set(S.GROUP_ROWS_SETTING, limit)
    try:
        df = spark.createDataFrame([("a", 1, f"n{i % 7}", i) for i in range(20)], "k string, pos int, name string, i int")
        got = S.scan(df, ["k"], ["pos"], n=S.row_number(), before=S.previous(F.col("i"))).collect()
    finally:
        spark.conf.unset(S.GROUP_ROWS_SETTING)
    want = sorted(range(20), key=lambda i: (i % 7, i))
    assert sorted((r["n"], r["i"]) for r in got) == [(n + 1, i) for n, i in enumerate(want)]
    assert {r["i"]: r["before"] and r["before"][0] for r in got} == dict(zip(want, [None, *want]))
