"""Near vectors against all pairs: recall, components, corner cases."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notespark.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_hand(rows, cosine=0.9):
    """(n_links, component) per row, over all pairs"""
    good = [i for i, (d, v, _) in enumerate(rows) if d is not None and v and None not in v
            and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, np.float32))]
    links, root = Counter(), {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(good):
        for j in good[a + 1:]:
            x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine - 1e-12:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    smallest = {}
    for i in good:
        smallest[find(i)] = min(smallest.get(find(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], smallest[find(i)] if i in set(good) else rows[i][0]) for i in range(len(rows))]


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        a = rng.normal(size=32)
        a /= np.linalg.norm(a)
        b = rng.normal(size=32)
        b -= b @ a * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9, 0.93)
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 0)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    found = sum(r["n_links"] > 0 for r in got) / len(got)
    assert found >= 0.95
    assert all(r["component"] in (r["id"], r["id"] - 1) for r in got)


@pytest.mark.parametrize("part_rows", [1024, 7])
def test_like_all_pairs(spark, monkeypatch, part_rows):
    monkeypatch.setattr(embeddings, "PART_ROWS", part_rows)
    monkeypatch.setattr(embeddings, "RECALL", 0.9999)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25])).tolist(), 0) for i in range(160)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [1.0, None] * 8, 1), (504, [float("nan")] * 16, 1),
             (505, [float("inf")] + [1.0] * 15, 1), (None, base[0].tolist(), 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1),
             (508, (base[1] * 1e-30).tolist(), 1), (3, rows[3][1], 0), (3, rows[3][1], 0), (509, [1e30] * 16, 1), (510, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "v": F.lit(1), "rep": F.lit(2), "ok": F.lit(3)})
    got = Counter(tuple(r) for r in embeddings.near_vectors(df).collect())
    assert got == Counter(by_hand(rows))


def test_empty_and_unusable(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    got = embeddings.near_vectors(spark.createDataFrame([(4, None, 0)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(4, 0, 4)]


def test_small_table_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), 0) for r in table.collect()]
    want = {d: n for d, n, _ in by_hand(rows)}
    got = {r["id"]: r["n_links"] for r in embeddings.near_vectors(table).collect()}
    assert sum(got.values()) >= 0.9 * sum(want.values())
    assert all(got[d] <= want[d] for d in want)
