"""The forest against all pairs: recall, ties, copies, corner cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notespark.llm import forest

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_hand(rows, asked, k=5):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in dict(((i, tuple(v)), (i, v)) for i, v in rows if i is not None and v and None not in v
            and np.isfinite(v).all() and np.any(v)).values()]
    out = {}
    for i, v in good:
        if asked(i):
            near = sorted((-float(v @ w / np.sqrt((v @ v) * (w @ w))), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
        near = out.setdefault(r["query"], [])
        assert r["rank"] == len(near) + 1
        near.append((r["id"], r["score"]))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_recall_on_given_vectors(spark, monkeypatch, small):
    if small:  # many shards and turns, and a sample that is a part
        for name, value in (("SHARD_ROWS", 500), ("ASK_ROWS", 10), ("SAMPLE_POINTS", 300), ("SAMPLE_QUERIES", 15)):
            monkeypatch.setattr(forest, name, value)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = by_hand([(r["vec_id"], list(r["embedding"])) for r in table.collect()], lambda i: i % 50 == 0)
    got = answers(forest.nearest(table, F.col("vec_id") % 50 == 0))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want) >= 0.9 * sum(map(len, want.values()))
    for q in want:
        true = dict(want[q])
        assert all(abs(true[i] - s) < 1e-12 for i, s in got[q] if i in true)


def test_ascends_no_further_than_needed(spark):
    """Vectors in tight bundles: the trees stop far above the root, and still find the bundle."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(300, 32))
    rows = [(i, (centres[i % 300] + 0.05 * rng.normal(size=32)).tolist(), 0) for i in range(3000)]
    got = answers(forest.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0))
    want = by_hand([r[:2] for r in rows], lambda i: i % 50 == 0)
    assert sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want) >= 0.9 * 5 * len(want)
    own = forest.labels(forest.unit(np.array([r[1] for r in rows])), forest._planes(32))
    sizes = forest._sizes(own[::50], np.sort(own.T, axis=1))
    depth = forest._depths(sizes, 1.0, 5 * forest.TREES)
    assert (np.take_along_axis(sizes, depth[:, None], 1) < 3000).all()


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = [(i, rng.normal(size=8).tolist()) for i in range(1, 40)]
    rows = base + [(50 + i, base[0][1]) for i in range(20)] + [(100, base[0][1]), (100, base[0][1]), (150, base[1][1]), (None, base[0][1]),
            (200, None), (250, []), (300, [0.0] * 8), (350, [1.0, None] * 4), (400, [float("nan")] * 8), (450, [float("inf")] * 8),
            (500, [1.0, 2.0]), (501, [2.0, 1.0]), (550, [3.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({"id": F.lit("x"), "v": F.lit(1), "asked": F.lit(True), "h1": F.lit(0)})
    got = answers(forest.nearest(df, F.col("vec_id") % 50 == 0))
    want = {q: near for q, near in by_hand(rows, lambda i: i % 50 == 0).items() if near}
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_no_rows_and_no_queries(spark):
    assert forest.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 0.0], 0)], SCHEMA)
    assert forest.nearest(one, F.lit(False)).collect() == [] and forest.nearest(one, F.lit(None).cast("boolean")).collect() == []
    assert [(r["query"], r["id"]) for r in forest.nearest(one, F.lit(True)).sort("query").collect()] == [(1, 2), (2, 1)]
