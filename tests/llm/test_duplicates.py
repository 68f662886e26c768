"""SimHash, line and exact duplicates against brute force, and their corner cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from notespark.llm import exact, lines, simhash
from notespark.llm.components import connected_components

SF = Path("/root/testdata/sf0.001/documents.parquet")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BLANK = re.compile(r"[\x20\x09-\x0D]")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def simhash_by_hand(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def groups_by_hand(prints):
    """component per row index, over all pairs"""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def odd_docs():
    rng = random.Random(5)
    base = ["word%d" % rng.randrange(300) for _ in range(120)]
    texts = [None, "", " \n\t", "one", "ONE", "one two", "É é İ", "x" * 5000, "a b c " * 4000]
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    return [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, "one", "en", "s", 0), (None, "one two", "en", "s", 0)]


def test_fingerprints_and_groups(spark):
    rows = odd_docs()
    # Columns that clash with names used inside must do no harm.
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"fp": F.lit("x"), "id": F.lit(7), "t": F.lit(None)})
    got = simhash.near_duplicates(df).collect()
    prints = [simhash_by_hand(t) for _, t, *_ in rows]
    groups = groups_by_hand(prints)
    smallest = defaultdict(list)
    for g, r in zip(groups, rows):
        smallest[g] += [r[0]] if r[0] is not None else []
    want = Counter((r[0], p, min(smallest[g])) for r, p, g in zip(rows, prints, groups))
    assert Counter((r["id"], r["fp"], r["component"]) for r in got) == want


def test_links_of_every_distance(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base:
        for d in (1, 2, 3, 4):
            v = b
            for bit in rng.sample(range(64), d):
                v ^= 1 << bit
            prints.add(v)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = simhash.near_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()
    for a, b in links:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    hand = groups_by_hand(signed)
    assert [found.get(p, p) for p in signed] == [signed[g] for g in hand]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(200, i) for i in range(201, 300)] + [(9, 9), (None, 3), (7, None), (1, 2)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 200 for i in range(200, 300)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("op", [simhash.near_duplicates, lines.dedup_lines, exact.exact_duplicates])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []


def test_simhash_of_the_small_table(spark):
    docs = spark.read.parquet(str(SF))
    rows = docs.select("doc_id", "text").collect()
    prints = [simhash_by_hand(r["text"]) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i]["doc_id"])
    groups = groups_by_hand([prints[i] for i in order])
    want = {rows[i]["doc_id"]: (prints[i], rows[order[g]]["doc_id"]) for i, g in zip(order, groups)}
    assert {r["id"]: (r["fp"], r["component"]) for r in simhash.near_duplicates(docs).collect()} == want


def test_lines(spark):
    common = "  This Line Is Long Enough To Be Counted, É  "
    assert len(common.strip()) >= 40
    rows = [(i, f"own {i}\n{common if i % 2 else common.upper().replace('É', 'É')}\nshort\n", "en", "s", 0) for i in range(1, 7)]
    rows += [(7, None, "en", "s", 0), (8, "", "en", "s", 0), (9, common, "en", "s", 0), (9, common, "en", "s", 0),
             (None, common + "\nx", "en", "s", 0), (4, common + "\n" + common, "en", "s", 0),
             (10, ("z" * 50 + "\n") * 3000, "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "line": F.lit("x"), "pos": F.lit(1)})
    got = Counter(tuple(r) for r in lines.dedup_lines(df).collect())

    holders = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            k = lower(line.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= 40 and d is not None:
                holders[k].add(d)
    want = Counter()
    for d, t, *_ in rows:
        all_lines = (t or "").split("\n")
        keys = [lower(x.strip(" \t\n\x0b\x0c\r")) for x in all_lines]
        kept = [x for x, k in zip(all_lines, keys)
                if len(k) < 40 or len(holders[k]) < 5 or d == max(holders[k])]
        want[(d, "\n".join(kept), len(all_lines), len(all_lines) - len(kept))] += 1
    assert got == want


def test_exact(spark):
    rows = [(5, "a b c", "en", "s", 0), (3, "abc", "en", "s", 0), (4, "a b\tc", "en", "s", 0), (9, "abd", "en", "s", 0),
            (1, None, "en", "s", 0), (2, "", "en", "s", 0), (7, " ", "en", "s", 0), (8, "x" * 200 + "1", "en", "s", 0),
            (10, "x" * 200 + "2", "en", "s", 0), (11, "x" * 200 + " 2", "en", "s", 0), (None, "q", "en", "s", 0),
            (12, "q", "en", "s", 0), (13, "twin", "en", "s", 0), (13, "twin", "en", "s", 0), (14, "é", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"len": F.lit(1), "norm": F.lit("x"), "full": F.lit("y"), "word": F.lit(2)})
    got = Counter(tuple(r) for r in exact.exact_duplicates(df, carry={"d": F.sha2("norm", 256)}).collect())
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[BLANK.sub("", t or "")].append((len(t or ""), d))
    want = Counter()
    for d, t, *_ in rows:
        norm = BLANK.sub("", t or "")
        keep = min(groups[norm], key=lambda x: (-x[0], x[1] is None, x[1] or 0))[1]
        want[(d, keep, len(groups[norm]), d == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert got == want
