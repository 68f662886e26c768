"""The manifest against a plain tree, row by row."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from notespark.llm import merkle, queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(d, source, lang, n, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def tree(leaves):
    """All levels from the leaves to the one root"""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def steps(levels, i):
    for level in levels[:-1]:
        run = i // 16 * 16
        yield level[run:i], level[i + 1:run + 16]
        i //= 16


def by_hand(rows):
    sources = {}
    for d, text, lang, source, n in rows:
        changed = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        other = leaf_of(d, source, lang, n, changed) if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else None
        sources.setdefault(source, []).append((d is not None, d or 0, leaf_of(d, source, lang, n, text), other))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([r[2] for r in sorted(sources[s], key=lambda r: r[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (has_id, d, own, other) in enumerate(sorted(sources[s], key=lambda r: r[:3])):
            path = [*steps(trees[s], i), *steps(top, k)]
            digest = other or own
            for before, after in path:
                digest = h("".join(before) + digest + "".join(after))
            out.append((d if has_id else None, own, trees[s][-1][0], top[-1][0], h("".join(x for p in path for side in p for x in side)), digest, digest == top[-1][0]))
    return out


def query(spark, monkeypatch, df):
    monkeypatch.setattr(queries, "table", lambda *_: df)
    return [tuple(r) for r in queries.op13_merkle(spark, "").collect()]


@pytest.mark.parametrize("sizes, least_rows", [([1], 3), ([17], 3), ([16, 1], 2_000), ([1, 2, 16, 33, 257], 11), ([1] * 40, 3), ([5, 700, 5], 37)])
def test_like_a_plain_tree(spark, monkeypatch, least_rows, sizes):
    monkeypatch.setattr(merkle, "LEAST_ROWS", least_rows)
    monkeypatch.setattr(merkle, "MOST_ROWS", 4 * least_rows)
    rows = [(1000 * s + i, f"Text {i} Ä" if i % 3 else None, "en", None if s == 1 else f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    assert sorted(query(spark, monkeypatch, spark.createDataFrame(rows[::-1], SCHEMA))) == sorted(by_hand(rows))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAST_ROWS", 5)
    rows = [(7, "same", "en", "a", 4)] * 60 + [(None, "x", None, None, None), (None, None, None, None, None), (7, "Other", "en", "a", 5), (8, "", "en", "", 0),
                                               (9, "B" * 100_000, "de", "é", 1), (10, "C", "de", "z", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "leaf", "part", "idx", "rank", "twin")})
    key = str
    assert sorted(query(spark, monkeypatch, df), key=key) == sorted(by_hand(rows), key=key)
    assert query(spark, monkeypatch, spark.createDataFrame([], SCHEMA)) == []


def test_listed_proofs_lead_to_the_root(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 2) for i in range(40)], SCHEMA)
    got = merkle.prove(docs, queries.LEAF_FIELDS, proofs=True).collect()
    assert all(r["verified"] and len(r["proof"]) == (15 + 2 if r["id"] < 32 else 7 + 2) and h("".join(r["proof"])) == r["proof_sha256"] for r in got)


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(tuple(r) for r in queries.op13_merkle(spark, "/root/testdata/sf0.001").collect()) == sorted(by_hand(rows))
