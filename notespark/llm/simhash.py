"""Near-duplicate documents by SimHash fingerprints, compared by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from ..session import staged
from .components import connected_components

BITS, RADIUS = 64, 3
#: Fingerprints expanded at a time, and variants that one matching group holds on average: bounds on a task's memory.
EXPAND_ROWS, GROUP_VARIANTS = 2048, 500_000


def _masks() -> np.ndarray:
    """Flips of radius 0 and 1, then those of radius 2 within one half of the bits.

    Of three differing bits two lie in the same half, so these pairs are enough for distance 3.
    """
    bits = [1 << i for i in range(BITS)]
    pairs = [a | b for half in (bits[: BITS // 2], bits[BITS // 2:]) for i, a in enumerate(half) for b in half[i + 1:]]
    return np.array([0, *bits, *pairs], dtype=np.uint64)


MASKS = _masks()
NEAR = 1 + BITS


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The signed 64-bit SimHash of a text given in UTF-8; 0 without words."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    last = ends[width - 1:] or [ends[-1]]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(last), 65_536):
        part = last[i:i + 65_536]
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[i:], part)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(last), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, name: str = "fingerprint") -> DataFrame:
    """``docs`` with the SimHash of ``text`` as bigint; a null or empty text has 0."""

    @F.pandas_udf(LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.withColumn(name, simhash(F.col(text).cast("binary")))


def _expand(groups: int):
    """Fingerprints to packed variants: a row per matching group with variants and the flips that made them."""

    def run(batches):
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for i in range(0, len(values), EXPAND_ROWS):
                part = values[i:i + EXPAND_ROWS]
                odd = (np.bitwise_count(part) & 1).astype(bool)
                made, flips = [], []
                for own, masks in ((part[odd], NEAR), (part[~odd], len(MASKS))):
                    made.append((own[:, None] ^ MASKS[None, :masks]).ravel())
                    flips.append(np.tile(np.arange(masks, dtype=np.uint16), len(own)))
                variant, flip = np.concatenate(made), np.concatenate(flips)
                mixed = (variant * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                group = ((mixed * np.uint64(groups)) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(group, kind="stable")
                group, variant, flip = group[order], variant[order], flip[order]
                cuts = np.flatnonzero(np.diff(group)) + 1
                starts, ends = [0, *cuts], [*cuts, len(group)]
                yield pd.DataFrame({
                    "grp": group[starts],
                    "variants": [variant[s:e].tobytes() for s, e in zip(starts, ends)],
                    "flips": [flip[s:e].tobytes() for s, e in zip(starts, ends)],
                })

    return run


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between fingerprints of one group that share a variant.

    Around a variant, whoever is at most one flip away is within three of everybody else there:
    each such variant gives a star, whose size is bounded by the ball (2,081), not by the data.
    """
    variant = np.frombuffer(b"".join(pdf["variants"]), dtype=np.uint64)
    flip = np.frombuffer(b"".join(pdf["flips"]), dtype=np.uint16)
    order = np.argsort(variant)
    variant, flip = variant[order], flip[order]
    same = variant[1:] == variant[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    variant, flip = variant[shared], flip[shared]
    if not len(variant):
        return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
    owner = variant ^ MASKS[flip]
    starts = np.concatenate([[0], np.flatnonzero(variant[1:] != variant[:-1]) + 1])
    none = np.uint64(2**64 - 1)
    near = flip < NEAR
    hub = np.minimum.reduceat(np.where(near, owner, none), starts)
    some = np.maximum.reduceat(near.astype(np.uint8), starts)
    sizes = np.diff(np.concatenate([starts, [len(variant)]]))
    hub, some = np.repeat(hub, sizes), np.repeat(some, sizes)
    ok = (some == 1) & (hub != owner) & (np.bitwise_count(hub ^ owner) <= RADIUS)
    hub, owner = hub[ok], owner[ok]
    order = np.lexsort((owner, hub))
    hub, owner = hub[order], owner[order]
    new = np.ones(len(hub), dtype=bool)
    new[1:] = (hub[1:] != hub[:-1]) | (owner[1:] != owner[:-1])
    return pd.DataFrame({"a": hub[new].view(np.int64), "b": owner[new].view(np.int64)})


def near_fingerprints(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``nodes(fp bigint)`` that tie together all at distance 3 or less.

    Every fingerprint emits its variants of up to one flip, and those of even weight also the
    two-flip ones: at distance 3 the weights differ in parity, so one side goes two steps and the
    other one step to the middle; at distance 1 or 2 one step each is enough. Variants are
    shuffled by their own value, so no key is hot however alike documents are. Pairs at distance
    3 or less are not all listed, but are always joined by listed ones.
    """
    count = nodes.count()
    groups = max(8, -(-count * (NEAR + len(MASKS)) // (2 * GROUP_VARIANTS)))
    packed = nodes.select("fp").mapInPandas(_expand(groups), "grp int, variants binary, flips binary")
    return packed.groupBy("grp").applyInPandas(_meet, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component): each row's fingerprint and the smallest id reachable over links of 3 bits or fewer.

    Null, empty and white-space texts have fingerprint 0 and link like any other. Repeated rows
    share a fingerprint. A null id gets the component of its fingerprint, which is null only if
    no member has an id. Other columns are not read, whatever their names. No rows, no rows.
    """
    prints = staged(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")), "t", width, "fp")
                    .select("id", "fp"), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    labels = connected_components(near_fingerprints(nodes)).select(F.col("node").alias("fp"), "component")
    labelled = staged(nodes.join(labels, "fp", "left")
                      .select("fp", "first", F.coalesce("component", "fp").alias("component")), "labelled")
    smallest = staged(labelled.groupBy("component").agg(F.min("first").alias("smallest")), "smallest")
    named = labelled.join(smallest, "component").select("fp", F.col("smallest").alias("component"))
    return prints.join(named, "fp").select("id", "fp", "component")
