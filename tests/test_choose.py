import random

import pytest
from pyspark.sql import functions as F

from notespark import scan as S
from notespark.operators import budget as B, choose as C, graph as G, lookup as J


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def tree(spark):
    data = [("Definition 1.1.1", "Definition", "1.1", "", "x", None, 1), ("Satz 1.1.2", "Satz", "1.1", "Minkowski", "y", "by hand", 2),
            ("Satz 1.2.1", "Satz", "1.2", None, "z", "see", 3), ("Lemma 1.3", "Lemma", "1.3", None, "w", "Siehe Analysis 2.", 4),
            ("Algorithmus 2.1", "Algorithmus", "2", "Simplex", "v", None, 5)]
    e = spark.createDataFrame([("c", i, *d) for i, d in enumerate(data)],
                              "course string, pos int, id string, type string, section string, name string, text string, proof string, page int")
    return C.with_sizes(e)


def picks(spark, *ids):
    return spark.createDataFrame([("c", i) for i in ids], "course string, id string")


def lines(spark, *items):
    return spark.createDataFrame([("c", *i) for i in items], "course string, kind string, item string")


def test_tree_states(spark, tree):
    plain = C.statements(tree)
    states = {r[0]: r[1:] for r in rows(C.tri_state(plain, picks(spark, "Satz 1.1.2"), ["course"]), "node", "state", "count")}
    assert states["1"] == ("some", "1/4") and states["1.1"] == ("some", "1/2") and states["1.2"] == ("none", "0/1")
    assert "2" not in states
    under = tree.filter("section like '1%'")
    on = C.toggle(picks(spark, "Satz 1.1.2"), under, ["course"])
    assert len(rows(on, "id")) == 4
    assert rows(C.toggle(on, under, ["course"]), "id") == []
    assert {r[0] for r in rows(tree.filter("proof_size > 0 and not referral"), "id")} == {"Satz 1.1.2", "Satz 1.2.1"}


def test_compress_expands_back(spark, tree):
    rnd = random.Random(5)
    ids = [r.id for r in tree.collect()]
    for _ in range(4):
        want = {i for i in ids if rnd.random() < .6}
        if not want:
            continue
        packed = C.compress(tree, picks(spark, *want))
        assert {r[0] for r in rows(C.chosen(tree, packed), "id")} == want
    whole = C.compress(tree, picks(spark, "Definition 1.1.1", "Satz 1.1.2", "Satz 1.2.1", "Lemma 1.3", "Algorithmus 2.1"))
    assert rows(whole, "kind", "item") == [("section", "1"), ("statement", "Algorithmus 2.1")]


def test_toggle_proof(spark, tree):
    offered = tree.filter("proof_size > 0 and not referral")
    sel = lines(spark, ("statement", "Satz 1.1.2"), ("statement", "Satz 1.2.1"), ("proofs", ""))
    off = C.toggle_proof(sel, picks(spark, "Satz 1.1.2"), offered)
    assert rows(off, "kind", "item") == [("proof", "Satz 1.2.1"), ("statement", "Satz 1.1.2"), ("statement", "Satz 1.2.1")]
    on = C.toggle_proof(lines(spark, ("statement", "Satz 1.2.1")), picks(spark, "Satz 1.1.2"), offered)
    assert ("proof", "Satz 1.1.2") in rows(on, "kind", "item") and ("statement", "Satz 1.1.2") in rows(on, "kind", "item")


PROOFS = "t string, id string, p double, cost int, ord int"


def test_budget_example(spark):
    proofs = spark.createDataFrame([("t", "A", .9, 50, 1), ("t", "B", .6, 10, 2), ("t", "C", .5, 40, 3), ("t", "D", .7, 30, 4)], PROOFS)
    base = spark.createDataFrame([("t", 100)], "t string, base int")
    first = C.trim(proofs, base, ["t"], 160)
    assert rows(first.filter("kept"), "id") == [("A",)]
    assert rows(C.refill(first, ["t"], 160).filter("kept"), "id") == [("A",), ("B",)]


@pytest.mark.parametrize("limit", ["2000000", "4"])
def test_budget_against_loop(spark, limit):
    rnd = random.Random(9)
    data = [(t, f"{t}{i}", rnd.randint(0, 9) / 10, rnd.randint(1, 40), i) for t in "abc" for i in range(15)]
    spark.conf.set(S.GROUP_ROWS_SETTING, limit)
    try:
        got = C.refill(C.trim(spark.createDataFrame(data, PROOFS), spark.createDataFrame([(t, 30) for t in "abc"], "t string, base int"), ["t"], 150), ["t"], 150)
        kept = {r[0] for r in rows(got.filter("kept"), "id")}
    finally:
        spark.conf.unset(S.GROUP_ROWS_SETTING)
    for t in "abc":
        mine = [d for d in data if d[0] == t]
        have, used, gone = {d[1] for d in mine}, 30 + sum(d[3] for d in mine), []
        for d in sorted(mine, key=lambda d: d[2]):
            if used > 150:
                have.discard(d[1])
                gone.append(d)
                used -= d[3]
        for d in sorted(gone, key=lambda d: -d[2]):
            if used + d[3] <= 150:
                have.add(d[1])
                used += d[3]
        assert {k for k in kept if k[0] == t} == have


def test_shrink_against_loop(spark):
    rnd = random.Random(2)
    data = [("s", t, c, i, rnd.randint(1, 20)) for t in (1, 2, 3) for c in ("x", "y") for i in range(rnd.randint(1, 6))]
    df = spark.createDataFrame(data, "s string, task int, ctx string, pos int, size int")
    for room in (0, 60, 120, 999):
        left = {(t, c): sorted((i, z) for _, tt, cc, i, z in data if (tt, cc) == (t, c)) for t in (1, 2, 3) for c in ("x", "y")}
        total = lambda keys: sum(z for k in keys for _, z in left[k])
        while total(left) > room:
            task = max((1, 2, 3), key=lambda t: total([(t, "x"), (t, "y")]))
            ctx = max(("x", "y"), key=lambda c: total([(task, c)]))
            left[task, ctx].pop()
        want = sorted((t, c, i) for (t, c), xs in left.items() for i, _ in xs)
        assert rows(B.shrink_to_fit(df, ["s"], room), "task", "ctx", "pos") == want


def test_acyclic_and_reach(spark):
    e = spark.createDataFrame([("s", 1, 2, .9, 1), ("s", 2, 3, .8, 2), ("s", 3, 1, .7, 3), ("s", 3, 2, .4, 4)],
                              "s string, a int, b int, p double, ord int")
    kept = G.acyclic_edges(e, ["s"])
    assert rows(kept, "a", "b") == [(1, 2), (2, 3)]
    assert rows(G.after(kept, ["s"]), "task", "after") == [(2, [1]), (3, [2])]
    assert rows(G.dependency_text(kept, ["s"]), "text") == [("1 → 2, 2 → 3",)]
    asked = spark.createDataFrame([("s", 1, 3), ("s", 3, 1), ("s", 2, 2), ("t", 1, 3), ("s", 1, 9), ("s", 1, 3)], "s string, source int, target int")
    assert rows(G.reaches(kept, asked, ["s"]), "s", "source", "target", "reached") == [
        ("s", 1, 3, True), ("s", 1, 9, False), ("s", 2, 2, True), ("s", 3, 1, False), ("t", 1, 3, False)]


def test_long_cycle_and_null_key(spark):
    ring = [(None, i, (i + 1) % 300, 1 - i / 1000, i) for i in range(300)] + [(None, 500, 0, .9, 400), (7, 1, 2, .9, 0)]
    e = spark.createDataFrame(ring, "s int, a int, b int, p double, ord int")
    kept = G.acyclic_edges(e, ["s"]).collect()
    assert {(r["s"], r["a"]) for r in kept} == {(s, a) for s, a, *_ in ring} - {(None, 299)}


@pytest.mark.parametrize("limit", ["2000000", "5"])
def test_acyclic_against_loop(spark, limit):
    rnd = random.Random(4)
    data = []
    for s in "abc":
        pairs = [(x, y) for x in range(6) for y in range(6) if x != y]
        data += [(s, x, y, rnd.randint(3, 10) / 10, i) for i, (x, y) in enumerate(rnd.sample(pairs, 14))]
    spark.conf.set(S.GROUP_ROWS_SETTING, limit)
    try:
        got = rows(G.acyclic_edges(spark.createDataFrame(data, "s string, a int, b int, p double, ord int"), ["s"]), "s", "a", "b")
    finally:
        spark.conf.unset(S.GROUP_ROWS_SETTING)
    want = []
    for s in "abc":
        kept = set()
        for _, x, y, p, _ in sorted((d for d in data if d[0] == s and d[3] >= .5), key=lambda d: (-d[3], d[4])):
            seen, front = {y}, {y}
            while front:
                front = {b for a, b in kept if a in front} - seen
                seen |= front
            if x not in seen:
                kept.add((x, y))
        want += [(s, *k) for k in kept]
    assert got == sorted(want)


def test_usage(spark):
    u = spark.createDataFrame([("k", 1, 1000, .001), ("k", 2, 1000000, None)], "k string, pick int, input_tokens long, cost double")
    r = J.usage_totals(u, ["k"], 0.042 / 1_000_000, "pick").first()
    assert (r.requests, r.input_tokens, round(r.cost, 6), round(r.estimated, 6), r.last_estimated) == (2, 1001000, .043, .042, True)
