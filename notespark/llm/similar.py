"""Near-duplicate texts by SimHash: ball hashing of pieces of a long fingerprint, links verified on word shingles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import discard, staged
from .components import connected_components

WIDTH, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint, and those of them that the search for candidates works on.
WORDS, SEARCHED = 32, 8
#: Share of pairs right at the similarity asked that some piece brings together; closer pairs fare better.
RECALL = 0.98
#: Standard deviations by which the distance of fingerprints may exceed what the similarity asked lets expect:
#: of the words searched for a candidate, of all words for a pair that is worth a look at its shingles.
SPREAD_SEARCHED, SPREAD = 2.7, 2.2
#: Bits of a piece that may differ; the others, which larger tables have, are equal in all variants and deal the texts out.
FREE = 24
#: Fingerprints expanded at a time, and variants that are matched at a time: bounds on a task's memory.
EXPAND_ROWS, GROUP_VARIANTS = 2048, 2_000_000
#: Times as many hubs in each round.
GROWTH = 8
#: Odd numbers: each makes another 64 bits of a shingle's hash.
_SALTS = np.random.default_rng(7).integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
#: Order in which pieces take their bits.
_DEAL = np.concatenate([np.random.default_rng([8, i]).permutation(64 * SEARCHED) for i in range(64)])


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words of a text given in UTF-8; of all its words if fewer."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not words:
        return np.array([], dtype=np.uint64)
    joined = memoryview(b" ".join(words))
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1:] or ends[-1:])], dtype=np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes: WORDS words, a bit set where over half of the hashes have it; zeros of none."""
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    for i in range(0, len(hashes), 255):  # so many can be counted in a byte
        x = hashes[i:i + 255, None] * _SALTS
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def _flips(least: float) -> float:
    """Share of differing bits that sets at Jaccard similarity ``least`` let expect."""
    return math.acos(2 * least / (1 + least)) / math.pi


def limit(least: float, words: int, spread: float) -> int:
    """Differing bits that ``words`` of two fingerprints may have, that many standard deviations above what ``least`` lets expect."""
    bits, p = 64 * words, _flips(least)
    return math.floor(bits * p + spread * math.sqrt(bits * p * (1 - p)))


def shape(rows: int, least: float = SIMILARITY) -> tuple[int, int]:
    """(bits of a piece, pieces): unlike texts seldom come within two bits, like ones do in some piece with RECALL."""
    bits = min(48, max(16, math.ceil(math.log2(max(rows, 1))) + 8))
    p, free = _flips(least), min(bits, FREE)
    near = (1 - p) ** (bits - free) * sum(math.comb(free, k) * p**k * (1 - p) ** (free - k) for k in range(3))
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - near))


def _values(prints: np.ndarray, bits: int, chosen: np.ndarray) -> np.ndarray:
    """(print, piece): the values of the pieces of these numbers."""
    places = _DEAL[(chosen[:, None] * bits + np.arange(bits)) % len(_DEAL)]
    spread = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")[:, places.ravel()]
    values = np.zeros((len(prints), len(chosen), 8), dtype=np.uint8)
    values[:, :, :-(-bits // 8)] = np.packbits(spread.reshape(len(prints), len(chosen), bits), axis=2, bitorder="little")
    return values.view("<u8")[:, :, 0]


def _ball(bits: int) -> np.ndarray:
    """What makes the variants of a piece: nothing, or one flip of a bit that may differ."""
    return np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(min(bits, FREE), dtype=np.uint64)])


def variants(prints: np.ndarray, bits: int, pieces: int) -> np.ndarray:
    """(print, bucket): for every piece of every fingerprint itself and what one flip makes of it, as 64-bit keys.

    Pieces within two bits of each other, all among the FREE ones, have a variant in common.
    """
    ball = _values(prints, bits, np.arange(pieces))[:, :, None] ^ _ball(bits)
    keys = (ball + (np.arange(pieces, dtype=np.uint64) << np.uint64(bits))[None, :, None]) * np.uint64(0x9E3779B97F4A7C15)
    return (keys ^ (keys >> np.uint64(29))).reshape(len(prints), -1)


def _apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(axis=-1, dtype=np.int64)


def _stars(bucket: np.ndarray, owner: np.ndarray, prints: np.ndarray, most: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """The members of buckets that are shared, each compared with the first of its bucket.

    (places, first place of each one's bucket, whether they are within ``most`` of it, number of the bucket), in the order of buckets.
    """
    order = np.argsort(bucket, kind="stable")
    same = bucket[order[1:]] == bucket[order[:-1]]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    new = shared & ~np.concatenate([[False], same])
    number = np.cumsum(new[shared]) - 1
    places = order[shared]
    first = order[new][number] if len(places) else places
    close = np.zeros(len(places), dtype=bool)
    for i in range(0, len(places), 100_000):
        p, f = places[i:i + 100_000], first[i:i + 100_000]
        close[i:i + 100_000] = _apart(prints[owner[f]], prints[owner[p]]) <= most(f, p)
    return places, first, close, number


def _open(places: np.ndarray, close: np.ndarray, number: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of three members or more whose first is not close to all of them."""
    if len(places):
        sizes, met = np.bincount(number), np.bincount(number, weights=close)
        chosen = (sizes > 2) & (met < sizes)
        ends = np.cumsum(sizes)
        for i in np.flatnonzero(chosen):
            yield places[ends[i] - sizes[i]:ends[i]]


def _tied(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per connected component of the links (a, b), around its member with most links: one link a member says as much."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    degree = np.bincount(ends, minlength=len(nodes))
    order = np.lexsort((np.arange(len(nodes)), -degree, label))
    first = np.concatenate([[True], label[order][1:] != label[order][:-1]])
    root = order[first][np.cumsum(first) - 1]
    return nodes[root[~first]], nodes[order[~first]]


def _homes(bits: int, pieces: int) -> int:
    """Places where pieces meet: one for each piece and value of its bits that must be equal."""
    return pieces << (bits - min(bits, FREE))


def _expand(bits: int, pieces: int, groups: int, most: int):
    """Fingerprints to their pieces, packed by home and batch, and to links within the batch.

    All variants of a piece have one home, so a fingerprint travels once a piece and is expanded there. Of the members of a
    batch with equal pieces that lie within half the limit of one of them, only that one travels: so a piece that a third of
    all texts share does not meet whole in one task. It is marked, and later compared with a wider limit that makes up
    for those it stands for.
    """
    half, homes = most // 2, _homes(bits, pieces)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), EXPAND_ROWS):
                part = batch.iloc[i:i + EXPAND_ROWS]
                prints = np.ascontiguousarray(np.stack(part["fp"].tolist()).astype(np.int64)[:, :SEARCHED]).view(np.uint64)
                keys = part["key"].to_numpy(np.int64)
                made = _values(prints, bits, np.arange(pieces)) + (np.arange(pieces, dtype=np.uint64) << np.uint64(bits))
                owner, bucket = np.repeat(np.arange(len(keys)), pieces), made.ravel()
                stays, marked = np.ones(made.size, bool), np.zeros(made.size, bool)
                places, first, close, number = _stars(bucket, owner, prints, lambda f, p: half)
                absorbed = close & (places != first)
                stays[places[absorbed]], marked[first[absorbed]] = False, True
                links = [owner[first[absorbed]] * len(keys) + owner[places[absorbed]]]
                for left in _open(places, close, number):
                    left = left[1:][stays[left[1:]]]
                    while len(left) > 1:
                        near = _apart(prints[owner[left[0]]], prints[owner[left]]) <= half
                        near[0] = False
                        marked[left[0]] |= near.any()
                        stays[left[near]] = False
                        links.append(owner[left[0]] * len(keys) + owner[left[near]])
                        left = left[1:][~near[1:]]
                a, b = _tied(*np.divmod(np.unique(np.concatenate(links)), len(keys)))
                if len(a):
                    yield pd.DataFrame({"grp": -1, "home": -1, "bits": bits, "marks": None, "keys": keys[a].tobytes(), "prints": keys[b].tobytes()}, index=[0])
                bucket, owner, marked = bucket[stays], owner[stays], marked[stays]
                home = (bucket >> np.uint64(min(bits, FREE))).astype(np.int64)
                order = np.argsort(home, kind="stable")
                rows = []
                for own in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                    at = int(home[own[0]])
                    rows.append((at * groups // homes, at, bits, marked[own].tobytes(), keys[owner[own]].tobytes(), prints[owner[own]].tobytes()))
                yield pd.DataFrame(rows, columns=["grp", "home", "bits", "marks", "keys", "prints"])

    return run


def _at_home(home: int, bits: int, wide: np.ndarray, prints: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ties (one, other) between the fingerprints of a home that share a variant and are close enough, a slice of the variants at a time."""
    free, ball = min(bits, FREE), _ball(bits)
    values = _values(prints, bits, np.array([home >> (bits - free)]))[:, 0] & np.uint64((1 << free) - 1)
    slices = -(-len(values) * len(ball) // GROUP_VARIANTS)
    bits_of_owner = np.uint64(64 - free)
    for k in range(slices):
        made = []
        for flip in ball:
            variant = values ^ flip
            own = np.flatnonzero(variant * np.uint64(slices) >> np.uint64(free) == k) if slices > 1 else np.arange(len(values))
            made.append(variant[own] << bits_of_owner | own.astype(np.uint64))
        packed = np.concatenate(made)
        packed.sort()
        owner = (packed & np.uint64((1 << (64 - free)) - 1)).astype(np.int64)
        bound = lambda f, p, owner=owner: most * (2 + wide[owner[f]] + wide[owner[p]]) // 2
        places, first, close, number = _stars(packed >> bits_of_owner, owner, prints, bound)
        met = close & (places != first)
        links = [owner[first[met]] * len(wide) + owner[places[met]]]
        for own in _open(places, close, number):
            near = _apart(prints[owner[own[0]]], prints[owner[own]]) <= bound(own[0], own)
            left, front = own[~near], own[1:][near[1:]].tolist()
            while len(left):
                if not front:
                    front, left = [int(left[0])], left[1:]
                at = front.pop()
                near = _apart(prints[owner[at]], prints[owner[left]]) <= bound(at, left)
                links.append(owner[at] * len(wide) + owner[left[near]])
                front.extend(left[near].tolist())
                left = left[~near]
        yield np.divmod(np.unique(np.concatenate(links)), len(wide))


def _meet(most: int):
    """Ties between the members of one matching group's homes that are close enough, a star for each set of tied ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["grp"].iat[0] < 0:
            return pd.DataFrame({"a": np.frombuffer(b"".join(pdf["keys"]), np.int64), "b": np.frombuffer(b"".join(pdf["prints"]), np.int64)})
        found = [(np.array([], np.int64),) * 2]
        for (home, bits), rows in pdf.groupby(["home", "bits"]):
            keys = np.frombuffer(b"".join(rows["keys"]), np.int64)
            prints = np.frombuffer(b"".join(rows["prints"]), "<u8").reshape(-1, SEARCHED)
            wide = np.frombuffer(b"".join(rows["marks"]), np.uint8).astype(np.int64)
            found += [(keys[a], keys[b]) for a, b in _at_home(int(home), int(bits), wide, prints, most)]
        a, b = _tied(*map(np.concatenate, zip(*found)))
        return pd.DataFrame({"a": a, "b": b})

    return run


def near_prints(prints: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) over ``prints(key, fp array<bigint>)`` that tie together all fingerprints within the limit of ``least`` that some piece brings together."""
    rows, most = prints.count(), limit(least, SEARCHED, SPREAD_SEARCHED)
    bits, pieces = shape(rows, least)
    groups = min(_homes(bits, pieces), max(8, -(-rows * pieces * len(_ball(bits)) // GROUP_VARIANTS)))
    packed = prints.select("key", "fp").mapInPandas(
        _expand(bits, pieces, groups, most), "grp int, home bigint, bits int, marks binary, keys binary, prints binary")
    # Links within a batch need no company: they are dealt out by themselves.
    spread = F.when(F.col("grp") < 0, F.xxhash64("keys")).otherwise(F.lit(0))
    return packed.withColumn("spread", spread).groupBy("grp", "spread").applyInPandas(_meet(most), "a bigint, b bigint").distinct()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes without repeats; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def _differing(a: str, b: str) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, WORDS)),
               F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


def _verified(least: float) -> Callable[[Column, Column], Column]:
    """Whether two sets of hashes, given as bytes, reach ``least``."""

    @F.pandas_udf("boolean")
    def reaches(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(one, two)], dtype=bool)

    return reaches


def _links(members: DataFrame, least: float) -> DataFrame:
    """(key, component) of ``members(bucket, key, weight, words, hashes)``: ties those of a bucket together that reach ``least``.

    In each round some members of a bucket, the hubs, are compared with all that they are not yet
    known to be tied to and whose fingerprints are within the limit; then they leave it, as all their pairs
    are settled. First it is the weightiest member, which most copies are tied to; later hubs are
    those outside the bucket's largest tie, GROWTH times as many each round. A bucket is done when all
    its members are tied together or those outside have been hubs, so no pair is left out. The
    labels of a round take one step along its links, to spare comparisons; the components are those of all links.
    """
    live, links, turn, reaches = staged(members.withColumn("component", F.col("key")), "live"), [], 0, _verified(least)
    hub = F.struct("key", "component", "words", "hashes")
    while True:
        if turn == 0:
            hubs = live.groupBy("bucket").agg(F.max_by(hub, F.struct("weight", "key")).alias("hub"))
        else:
            ties = live.groupBy("bucket", "component").count()
            main = ties.groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
            share = F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(GROWTH**turn))
            hubs = live.join(main, "bucket").filter("component != main").groupBy("bucket", share.alias("share")).agg(F.min_by(hub, "key").alias("hub"))
        hubs = staged(hubs.select("bucket", F.col("hub.key").alias("hub"), F.col("hub.component").alias("tie"), F.col("hub.words").alias("own"),
                                  F.col("hub.hashes").alias("own_hashes")), "hubs")
        close = (F.col("component") != F.col("tie")) & (_differing("words", "own") <= limit(least, WORDS, SPREAD))
        met = live.join(hubs, "bucket").filter(close).select("bucket", "hub", "tie", "key", "component", "hashes", "own_hashes")
        found = staged(met.filter(reaches("hashes", "own_hashes")).drop("hashes", "own_hashes"), "links")
        links.append(found)
        low = staged(found.groupBy("bucket", "hub").agg(F.min(F.least("component", "tie")).alias("low")), "low")
        step = found.join(low, ["bucket", "hub"]).select("bucket", F.explode(F.array("component", "tie")).alias("component"), "low")
        step = staged(step.groupBy("bucket", "component").agg(F.min("low").alias("new")), "step")
        rest = live.join(hubs.select("bucket", F.col("hub").alias("key")), ["bucket", "key"], "left_anti").join(step, ["bucket", "component"], "left")
        rest = staged(rest.select("bucket", "key", "weight", "words", "hashes", F.coalesce("new", "component").alias("component")), "rest")
        open_ = rest.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("bucket")
        left = staged(rest.join(open_, "bucket", "left_semi"), "live")
        for t in (live, hubs, low, step, rest):
            discard(t)
        if left.isEmpty():
            break
        live, turn = left, turn + 1
    every = reduce(DataFrame.unionByName, links).select(F.col("hub").alias("a"), F.col("key").alias("b"))
    return connected_components(every).select(F.col("node").alias("key"), "component")


def near_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """(id, key, component): a hash of each row's text and the smallest id reachable over texts that share ``least`` of their shingles.

    Long SimHash fingerprints of the distinct shingles are cut into pieces; every piece emits all
    its variants within half the radius of two bits, all in one place, and texts that share a variant and whose
    fingerprints are within the limit are candidates. Before they are linked, candidates are
    compared on their shingles, so a link is never below ``least``; RECALL says how many of
    the links right at ``least`` may be missed. Null, empty and white-space texts have no shingles and
    are alike. Repeated rows share a key. A null id gets the component of its text, which is null only if no
    member has an id. Other columns are not read, whatever their names. No rows, no rows.
    """
    print_of = F.pandas_udf(lambda texts: pd.Series([fingerprint(shingles(t, width)).view(np.int64) for t in texts]), "array<bigint>")
    set_of = F.pandas_udf(lambda texts: pd.Series([shingles(t, width).tobytes() for t in texts]), "binary")
    t = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), t.cast("binary").alias("t"), F.xxhash64(t).alias("key"))
    prints = staged(read.select("id", "key", print_of("t").alias("fp")), "prints")
    distinct = staged(prints.groupBy("key").agg(F.any_value("fp").alias("fp")), "distinct")
    edges = staged(near_prints(distinct, least), "candidates")
    buckets = connected_components(edges).select(F.col("node").alias("key"), F.col("component").alias("bucket"))
    weight = edges.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("weight"))
    members = staged(buckets.join(weight, "key").join(distinct, "key").select("bucket", "key", "weight", F.col("fp").alias("words")), "members")
    # Texts travel once, and only those of candidates stay.
    chosen = read.select("key", "t").join(members.select("key"), "key", "left_semi").groupBy("key").agg(F.any_value("t").alias("t"))
    sets = chosen.select("key", set_of("t").alias("hashes"))
    labels = _links(staged(members.join(sets, "key"), "sets"), least)
    labelled = staged(prints.select("id", "key").join(labels, "key", "left").select("id", "key", F.coalesce("component", "key").alias("component")), "labelled")
    smallest = staged(labelled.groupBy("component").agg(F.min("id").alias("smallest")), "smallest")
    for table in (edges, members, distinct, prints):
        discard(table)
    return labelled.join(smallest, "component").select("id", "key", F.col("smallest").alias("component"))
