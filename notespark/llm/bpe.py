"""Byte-level BPE encoding and decoding over a rank file."""

from __future__ import annotations

import base64
import hashlib
import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .pretokens import split

#: Pre-tokens that a Python worker remembers in each of two generations.
REMEMBERED = 300_000


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = {r: p for p, r in self.ranks.items()}
        # The rank bitmap's lower level: about as many words as a word has bits.
        self.width = math.isqrt(max(self.ranks.values())) + 1
        self.words = [0] * self.width
        self.young: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one pre-token: always the pair of lowest rank, leftmost first.

        Parts form a linked list over byte positions. Candidate pairs wait in a bucket of left
        positions per rank, under a bitmap of two levels: bit r of the lower level is set while
        bucket r holds anything, a bit of ``top`` while a word of the lower level does. The next
        rank is found by two find-first-sets. An entry is stale, and skipped, when the pair at
        its position no longer has the bucket's rank. Linear in bytes but for sorting buckets.
        """
        rank_of = self.ranks.get
        whole = rank_of(word)
        if whole is not None:
            return [whole]
        n, width, words, top = len(word), self.width, self.words, 0
        buckets: dict[int, list[int]] = {}
        end = list(range(1, n + 1))  # where the part that starts here ends
        back = list(range(-1, n - 1))  # where the part before this one starts
        pair = [rank_of(word[i:i + 2]) for i in range(n)]  # rank of this part and the next together
        pair[-1] = None
        pushed = [(r, i) for i, r in enumerate(pair) if r is not None]
        while True:
            for r, i in pushed:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    high, low = divmod(r, width)
                    if not words[high]:
                        top |= 1 << high
                    words[high] |= 1 << low
            if not top:
                break
            high = (top & -top).bit_length() - 1
            lower = words[high]
            lowest = lower & -lower
            words[high] = lower ^ lowest
            if lower == lowest:
                top ^= 1 << high
            rank = high * width + lowest.bit_length() - 1
            entries = buckets.pop(rank)
            entries.sort()
            pushed = []
            for k, i in enumerate(entries):
                if pair[i] != rank:
                    continue
                mid = end[i]
                stop = end[i] = end[mid]
                pair[mid] = None
                if stop < n:
                    back[stop] = i
                    right = pair[i] = rank_of(word[i:end[stop]])
                    if right is not None:
                        pushed.append((right, i))
                else:
                    right = pair[i] = None
                left, h = None, back[i]
                if h >= 0:
                    left = pair[h] = rank_of(word[h:stop])
                    if left is not None:
                        pushed.append((left, h))
                if right is not None and right < rank or left is not None and left < rank:
                    pushed += [(rank, j) for j in entries[k + 1:]]  # a lower rank came up and goes first
                    break
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[word[i:end[i]]])
            i = end[i]
        return ids

    def __call__(self, word: str) -> tuple[str, int, bytes]:
        """(ids in decimal, their number, the bytes they decode to) of one pre-token."""
        known = self.young.get(word)
        if known is None:
            known = self.old.get(word)
            if known is None:
                ids = self.merge(word.encode())
                known = " ".join(map(str, ids)), len(ids), self.decode(ids)
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = known
        return known

    def encode(self, text: str) -> list[int]:
        return [i for w in split(text) for i in self.merge(w.encode())]

    def decode(self, ids: list[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read once per Python worker."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text``; a null or empty text has none. The rank file lies at ``path`` on every executor."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return pd.Series([vocab.encode(t or "") for t in texts])

    return docs.withColumn(name, run(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the token ids stand for; null or no ids are no bytes. An unknown id is an error."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return pd.Series([vocab.decode([] if r is None else r) for r in rows])

    return docs.withColumn(name, run(F.col(ids)))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: whole texts encoded, then the ids decoded.

    Digests are of the decimal ids joined by a space and of the decoded bytes. A null or empty
    text has no tokens. Every row is handled alone, so repeated rows and ids, and other columns,
    do not matter.
    """

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        vocab, rows = vocabulary(path), []
        for t in texts:
            parts = [vocab(w) for w in split(t or "")]
            ids = " ".join([p[0] for p in parts])
            decoded = b"".join([p[2] for p in parts])
            rows.append((sum([p[1] for p in parts]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("id"), run(F.col(text)).alias("r")).select("id", "r.*")
