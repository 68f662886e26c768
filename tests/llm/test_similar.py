"""Near copies by word shingles against brute-force Jaccard."""

import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from notespark.llm import similar

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingle_set(text, width=5):
    words = text.lower().split()
    return {" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = "edit%d" % rng.randrange(10**6)
    return words


def texts():
    """Copies of many texts with random edits, above and below the border, and texts with one shingle over and over."""
    rng = random.Random(8)
    made = []
    for _ in range(60):
        base = ["w%d" % rng.randrange(2000) for _ in range(rng.randrange(100, 600))]
        made += [" ".join(base)] + [" ".join(edited(rng, base, rng.randrange(1, max(2, len(base) // 30)))) for _ in range(3)]
    made += ["again and again and now " * 400 + " ".join("v%d" % rng.randrange(10**6) for _ in range(60)) for _ in range(4)]
    hub = ["u%d" % i for i in range(300)]
    made += [" ".join(edited(rng, hub, 8)) for _ in range(40)]
    return made + ["", " \n", "one two", "ONE  two"]


def groups(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if jaccard(sets[i], sets[j]) >= 0.8]
    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return pairs, [find(i) for i in range(len(sets))]


def test_stage_against_brute_force(spark):
    made = texts()
    pairs, want = groups([shingle_set(t) for t in made])
    assert len(pairs) > 100
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(made)], SCHEMA)
    assert {r["id"]: r["component"] for r in similar.near_texts(docs).collect()} == dict(enumerate(want))
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, None).collect()}
    assert kept == {i for i, c in enumerate(want) if i == c}


def test_unlike_members_of_a_bucket(spark):
    """Texts a, b, c of one bucket: the hub is like neither of two that are alike; the bucket is done when all pairs were looked at."""
    words = ["x%d" % i for i in range(100)]
    made = [" ".join(words), " ".join(words[:50] + ["y%d" % i for i in range(50)]), " ".join(words[:50] + ["y%d" % i for i in range(49)])]
    for order in itertools.permutations(range(3)):
        rows = [(1, k, 1, similar.fingerprint(similar.shingles(made[i].encode())).view(np.int64).tolist(), similar.shingles(made[i].encode()).tobytes())
                for k, i in enumerate(order)]
        df = spark.createDataFrame(rows, "bucket bigint, key bigint, weight bigint, words array<bigint>, hashes binary")
        got = {r["key"]: r["component"] for r in similar._links(df, 0.8).collect()}
        assert got.keys() == {order.index(1), order.index(2)} and len(set(got.values())) == 1


def borders(n, seed=9):
    """Pairs of texts at Jaccard 0.8 to 0.82."""
    rng = random.Random(seed)
    while n:
        base = ["w%d" % rng.randrange(5000) for _ in range(200)]
        copy = edited(rng, base, rng.randrange(2, 6))
        if 0.8 <= jaccard(shingle_set(" ".join(base)), shingle_set(" ".join(copy))) < 0.82:
            n -= 1
            yield " ".join(base), " ".join(copy)


def test_recall_at_the_border():
    """Right at the similarity asked and for as many rows as a corpus has: bits of a piece, both limits."""
    bits, pieces = similar.shape(10**9)
    made = list(borders(400))
    one, two = (np.stack([similar.fingerprint(similar.shingles(p[i].encode())) for p in made]) for i in (0, 1))
    some, other = (similar.variants(np.ascontiguousarray(x[:, :similar.SEARCHED]), bits, pieces) for x in (one, two))
    met = np.array([len(np.intersect1d(a, b)) > 0 for a, b in zip(some, other)])
    met &= similar._apart(one[:, :similar.SEARCHED], two[:, :similar.SEARCHED]) <= similar.limit(0.8, similar.SEARCHED, similar.SPREAD_SEARCHED)
    met &= similar._apart(one, two) <= similar.limit(0.8, similar.WORDS, similar.SPREAD)
    assert met.mean() >= 0.93


def counted(spark, monkeypatch):
    """How many pairs the shingles of which are compared."""
    total = spark.sparkContext.accumulator(0)

    def verified(least):
        def reaches(one, two):
            total.add(len(one))
            return pd.Series([similar.similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(one, two)], dtype=bool)

        return F.pandas_udf(reaches, "boolean")

    monkeypatch.setattr(similar, "_verified", verified)
    return lambda: total.value


def test_a_shared_passage_ties_nothing(spark, monkeypatch):
    """2,000 texts of one passage and own words at Jaccard 0.42: no pair is looked at, and none is linked."""
    rng = random.Random(3)
    passage = ["p%d" % i for i in range(40)]
    made = [" ".join(passage + ["o%d" % rng.randrange(10**9) for _ in range(25)]) for _ in range(2000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(made)], SCHEMA)
    looked_at = counted(spark, monkeypatch)
    assert all(r["id"] == r["component"] for r in similar.near_texts(docs).collect())
    assert looked_at() <= 20


def test_a_large_group_of_copies(spark, monkeypatch):
    """1,500 light edits of one text: tied together by about as many comparisons, and by few entries of shared buckets."""
    rng = random.Random(4)
    base = ["g%d" % i for i in range(400)]
    made = [" ".join(edited(rng, base, 3)) for _ in range(1500)] + [" ".join("z%d" % rng.randrange(10**9) for _ in range(50)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(made)], SCHEMA)
    looked_at = counted(spark, monkeypatch)
    got = {r["id"]: r["component"] for r in similar.near_texts(docs).collect()}
    assert got == {i: 0 if i < 1500 else i for i in got} and len(got) == 1700
    assert looked_at() <= 5 * 1500


def test_widened_limits_make_up_for_what_stays_behind():
    """Members that a batch leaves behind are still tied to those of another batch that are close to them alone."""
    most, words = similar.limit(0.8, similar.SEARCHED, similar.SPREAD_SEARCHED), similar.SEARCHED
    chain = [np.zeros(64 * words, np.uint8)]
    chain *= 4  # a - x - z - b: each step within its limit, a and b farther apart than any
    flips = np.array_split(np.setdiff1d(np.arange(64 * words), similar._DEAL[:26])[:2 * (most // 2) + most], [most // 2, most // 2 + most])
    for i, f in enumerate(flips):
        chain[i + 1] = chain[i].copy()
        chain[i + 1][f] ^= 1
    prints = [np.packbits(c, bitorder="little").view("<u8").view(np.int64) for c in chain]
    full = [np.concatenate([p, np.zeros(similar.WORDS - words, np.int64)]) for p in prints]
    packed = []
    for own in ((0, 1), (3, 2)):
        packed += list(similar._expand(26, 1, 1, most)(iter([pd.DataFrame({"key": own, "fp": [full[k] for k in own]})])))
    rows = pd.concat(packed)
    links = [(int(a), int(b)) for grp in (-1, 0) for part in [rows[rows["grp"] == grp]] for a, b in similar._meet(most)(part).to_numpy()]
    root = {k: k for k in range(4)}
    for a, b in links:
        old, new = root[a], root[b]
        root = {k: new if r == old else r for k, r in root.items()}
    assert len(set(root.values())) == 1


def test_what_travels_does_not_grow_with_the_variants():
    """For three million rows, three times the 1.5 KB that a row of documents has on disk is more than a fingerprint's pieces weigh."""
    bits, pieces = similar.shape(3_000_000)
    prints = np.random.default_rng(1).integers(-2**63, 2**63 - 1, (2048, similar.WORDS))
    packed = pd.concat(similar._expand(bits, pieces, 1000, 99)(iter([pd.DataFrame({"key": np.arange(2048), "fp": list(prints)})])))
    held = [x for c in packed for x in packed[c] if isinstance(x, bytes)]
    assert sum(map(len, held)) < 4500 * 2048


def test_homes_find_what_variants_share(monkeypatch):
    """Pairs of two batches: tied where they share a variant within the limit, also where a home is matched in slices."""
    rng = np.random.default_rng(2)
    bits, pieces = similar.shape(400_000)
    assert bits > similar.FREE
    most, n = similar.limit(0.8, similar.SEARCHED, similar.SPREAD_SEARCHED), 500
    one = rng.integers(0, 2, (n, 64 * similar.SEARCHED), dtype=np.uint8)
    other = one ^ (rng.random(one.shape) < rng.uniform(0.05, 0.25, (n, 1)))
    prints = [np.packbits(x, axis=1, bitorder="little").view("<u8") for x in (one, other.astype(np.uint8))]
    some, more = (similar.variants(p, bits, pieces) for p in prints)
    want = {(i, n + i) for i in range(n) if len(np.intersect1d(some[i], more[i])) and similar._apart(prints[0][i], prints[1][i]) <= most}
    assert n // 4 < len(want) < n
    full = [np.concatenate([p.view(np.int64), np.zeros((n, similar.WORDS - similar.SEARCHED), np.int64)], axis=1) for p in prints]
    for slice_ in (similar.GROUP_VARIANTS, 50):
        monkeypatch.setattr(similar, "GROUP_VARIANTS", slice_)
        packed = pd.concat([x for k in (0, 1) for x in similar._expand(bits, pieces, 5, most)(iter([pd.DataFrame({"key": np.arange(n) + k * n, "fp": list(full[k])})]))])
        assert packed["grp"].nunique() == 5
        found = pd.concat([similar._meet(most)(part) for _, part in packed.groupby("grp")])
        assert {(min(x), max(x)) for x in found.to_numpy().tolist()} == want


def test_stars_tie_what_links_tie():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        a, b = rng.integers(0, 50, (2, n))
        a, b = a[a != b], b[a != b]

        def parts(x, y):
            root = {k: k for k in [*a.tolist(), *b.tolist()]}
            for i, j in zip(x.tolist(), y.tolist()):
                old, new = root[i], root[j]
                root = {k: new if r == old else r for k, r in root.items()}
            return {frozenset(k for k in root if root[k] == r) for r in root.values()}

        x, y = similar._tied(a, b)
        assert parts(x, y) == parts(a, b) and len(x) == sum(len(p) - 1 for p in parts(a, b))


def test_odd_rows_and_names(spark):
    rows = [(1, "a b c d e f"), (2, "A  b\tc d e f"), (3, None), (4, ""), (None, " \n"), (None, "alone and only"), (5, "x " * 70_000), (5, "x " * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.withColumns({c: docs["doc_id"] for c in ("id", "key", "component", "t", "fp", "bucket")})
    got = sorted(((r["id"], r["component"]) for r in similar.near_texts(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (4, 3), (None, 3), (None, None), (5, 5), (5, 5)], key=str)
    assert similar.near_texts(docs.limit(0)).collect() == []
