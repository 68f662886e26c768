"""The quality classifier: held-out accuracy, scoring against a walk of every tree, corner cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from notespark.llm import quality

SCHEMA, LABELS = "doc_id bigint, text string", "doc_id bigint, quality int, toxic int"
SF = "/root/testdata/sf0.01"


def test_forest_scores_like_walking_each_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = quality.fit(x, y, trees=20, depth=3)
    got = forest.score(x)
    inner = forest.feature.shape[1]
    for i in range(len(x)):
        margin = forest.start
        for t in range(20):
            at = 0
            while at < inner:
                at = 2 * at + 1 + (x[i, forest.feature[t, at]] > forest.threshold[t, at])
            margin += forest.leaf[t, at - inner]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-margin)))
    assert ((got > 0.5) == y).mean() > 0.97


def test_without_two_kinds_of_labels():
    width = len(quality.FEATURES)
    assert quality.fit(np.zeros((0, width)), np.zeros(0)).score(np.zeros((2, width))).tolist() == [0.5, 0.5]
    assert quality.fit(np.zeros((8, width)), np.ones(8)).score(np.zeros((1, width)))[0] == pytest.approx(0.9)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50
    assert all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95


def test_corner_cases(spark):
    rng = random.Random(4)
    good = [(i, " ".join(rng.choice(["the", "rain", "falls", "softly", "on", "a", "roof."]) for _ in range(60))) for i in range(200)]
    bad = [(500 + i, "spam " * rng.randrange(20, 90)) for i in range(200)]
    odd = [(900, None), (901, ""), (902, " \n"), (None, "null id here"), (903, "x" * 100_000), (0, good[0][1]), (0, good[0][1])]
    df = spark.createDataFrame(good + bad + odd, SCHEMA).withColumns({"id": F.lit("a"), "score": F.lit(1), "features": F.lit(0), "y": F.lit(2)})
    labels = [(i, int(i < 500), 0) for i, _ in good + bad] + [(900, None, 0), (None, 1, 0), (901, 7, 0), (5, 1, 0)]
    rows = quality.quality_scores(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(good) + len(bad) + len(odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["predicted"] == (r["id"] < 500) for r in rows if r["id"] is not None and r["id"] < 900)
    assert [r["held_out"] for r in rows if r["id"] is None] == [False]
    few = quality.quality_scores(df, spark.createDataFrame(labels, LABELS), fit_rows=150).collect()
    assert sum(r["predicted"] == (r["id"] < 500) for r in few if r["id"] is not None and r["id"] < 900) >= 390
    none = quality.quality_scores(df, spark.createDataFrame([], LABELS)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, LABELS)).collect() == []
