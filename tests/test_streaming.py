"""A stream of layers against a plain loop over what was delivered."""

import os
import random

import pytest

from notespark.streaming import ingest as I

SCHEMA = "k string, mtime bigint, format int, value int, gone boolean"


def by_hand(deliveries):
    """(batch, row) pairs to the valid row per key"""
    low = lambda x: (x is not None, x or 0)
    out = {}
    for k in {r[0] for _, r in deliveries}:
        own = [(b, r) for b, r in deliveries if r[0] == k]
        dead = [(b, r) for b, r in own if r[4]]
        alive = [(b, r) for b, r in own if not r[4] and not any((b <= d if g[1] is None else (low(r[1]), b) <= (low(g[1]), d)) for d, g in dead)]
        if alive:
            out[k] = max(alive, key=lambda x: (low(x[1][2]), low(x[1][1]), x[0]))[1][3]
    return out


def latest(spark, target):
    return {r["k"]: r["value"] for r in I.read_latest(spark, target, ["k"]).collect()}


@pytest.mark.parametrize("fmt", [1, None])
def test_a_deletion_of_any_format_counts(spark, tmp_path, fmt):
    spark.createDataFrame([("a", 1, 2, 10, False), ("b", 9, 2, 20, False), (None, 1, 2, 30, False)], SCHEMA).write.parquet(f"{tmp_path}/batch=0")
    spark.createDataFrame([("a", 5, fmt, 0, True), ("b", 5, fmt, 0, True), (None, 5, fmt, 0, True)], SCHEMA).write.parquet(f"{tmp_path}/batch=1")
    assert latest(spark, str(tmp_path)) == {"b": 20}
    spark.createDataFrame([("a", 6, 1, 40, False), ("b", None, None, 0, True)], SCHEMA).write.parquet(f"{tmp_path}/batch=2")
    assert latest(spark, str(tmp_path)) == {"a": 40}


def test_layers_stay_few_and_say_the_same(spark, tmp_path):
    rnd = random.Random(5)
    deliveries, target = [], str(tmp_path / "out")
    for batch in range(50):
        rows = [(rnd.choice("abcdef") if rnd.random() < .95 else None, rnd.choice([None, *range(40)]), rnd.choice([None, 1, 2]), 1000 * batch + i, rnd.random() < .25) for i in range(3)]
        deliveries += [(batch, r) for r in rows]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{batch:02d}")
        if batch in (3, 20, 49):  # many layers at once, as after a pause
            run = I.stream_ingest(spark, spark.createDataFrame([], SCHEMA).schema, f"{tmp_path}/in/*", target, f"{tmp_path}/state", max_files=1, keys=["k"], compact_after=4)
            run.awaitTermination()
            numbers = {r["value"] // 1000: r["batch"] for r in I._rows(spark, target).filter("value is not null").collect()}
            assert all(delivered == at for delivered, at in numbers.items())
            assert latest(spark, target) == by_hand(deliveries)
            assert len(os.listdir(target)) <= 2 * 4 + 2 + 1
    base, young = I.layers(spark, target)
    assert base is not None and len(young) < 4


def test_an_unfinished_base_is_not_seen(spark, tmp_path):
    target = str(tmp_path)
    for batch in range(3):
        spark.createDataFrame([("a", batch, 1, batch, False), (f"k{batch}", 1, 1, 7, False)], SCHEMA).write.parquet(f"{target}/batch={batch}")
    want = latest(spark, target)
    os.makedirs(f"{target}/_base-2")  # as if a task died while it wrote
    assert latest(spark, target) == want and I.layers(spark, target) == (None, [0, 1, 2])
    I.compact(spark, target, ["k"])
    assert latest(spark, target) == want and I.layers(spark, target) == (2, [])
    I.compact(spark, target, ["k"])
    spark.createDataFrame([("a", 0, 1, 99, False)], SCHEMA).write.mode("overwrite").parquet(f"{target}/batch=1")  # repeated: the base holds it
    assert latest(spark, target) == want
