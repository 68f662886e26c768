"""Whitened components against a dense eigensolver, and FEAST on hard spectra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from notespark.llm import feast, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def with_spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    a = q * np.array(values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    [5.0], [0.0, 0.0], [3, 3, 3, 2, 1, 0], [1.0] * 12, list(np.linspace(1, 2, 40)), [10.0 ** -k for k in range(12)], [1, 1 + 1e-7, 1 + 2e-7] + [0.5] * 20,
    [0.0] * 10 + [1e-3, 2.0], [1e12, 1e11, 3e4, 2e4, 1e4]])
def test_leading_pairs(values):
    a = with_spectrum(values)
    got, vectors = feast.leading(a, 7)
    want = sorted((v for v in values if v > 1e-11 * max(values)), reverse=True)[:7]
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-10, atol=1e-13 * max(values))
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max(initial=0) < 1e-12
    assert np.abs(a @ vectors - vectors * got).max(initial=0) <= 1e-11 * max(values)


def test_inertia_counts():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a = with_spectrum(rng.normal(size=rng.integers(1, 30)), seed=int(rng.integers(1000)))
        shift = rng.normal()
        assert feast.inertia(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    assert feast.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # a pivot of two


def by_hand(rows, components=16):
    xs = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    keep = values > 1e-12 * max(values[0], 1e-300)
    out = {}
    for i, x in xs:
        white = np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ vectors / np.sqrt(np.where(keep, values, 1))
        out.setdefault(i, []).append((n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), white[keep]))
    return out, values[keep] / np.trace(centred.T @ centred / n)


def compare(spark, df, rows):
    got = whitening.whitened_components(df).collect()
    want, explained = by_hand(rows)
    k = len(explained)
    assert len(got) == k * len(rows)
    signs = np.zeros(k)
    for r in got:
        n, deviation, white = want[r["id"]][0]
        c = r["component"] - 1
        assert r["n"] == n and int(r["deviation"]) == deviation and r["identity_error"] < 1e-9
        assert abs(r["explained"] / explained[c] - 1) < 1e-9 and abs(abs(r["whitened"]) - abs(white[c])) < 1e-7
        if abs(white[c]) > 1e-3:
            s = np.sign(r["whitened"] * white[c])
            assert signs[c] in (0, s)
            signs[c] = s


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    compare(spark, table, [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=5)]) for i in range(50)]
    good += [(i, good[0][1]) for i in range(100, 150)] + [(None, good[3][1]), (7, good[7][1])]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("-inf")] * 5), (205, [1.0, 2.0]), (206, [1e30] * 5)]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + bad], SCHEMA).withColumns({"id": F.lit("x"), "v": F.lit(1), "x": F.lit(2)})
    compare(spark, df, good)


def test_few_rows(spark):
    assert whitening.whitened_components(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whitened_components(spark.createDataFrame([(1, [0.5, 1.0], 0)] * 3, SCHEMA)).collect() == []
    rows = [(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [0.0, 4.0])]  # one dimension without spread
    compare(spark, spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), rows)


def test_sums_beyond_64_bits():
    x, sums = np.array([[2_000_000, 0]], dtype=np.int64), np.array([0, 10**15], dtype=np.int64)
    assert whitening._numerators(x, 10**13, sums).tolist() == [[2 * 10**19, -(10**15)]]
