"""Packing documents into sequences of bounded length, planned on the histogram of their lengths."""

from __future__ import annotations

import os
import struct
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import staged
from .pretokens import split

CAPACITY = 2048
#: Rows of a length that one task ranks on average, at most and at least: between them a length is dealt to all tasks.
RANK_ROWS, LEAST_ROWS = 100_000, 1_000
#: Pre-tokens that a Python worker remembers in each of two generations.
REMEMBERED = 300_000
#: The character that stands for a byte in a byte-level vocabulary: printable ones for themselves, then those from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class TokenBytes(dict):
    """Pre-token to its ids as little-endian 32-bit words, by the tokenizers library, remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # in a text their strings are ordinary text
        self.old: dict[str, bytes] = {}

        # Without a normalizer, a pre-token goes to the model as it is, a character for each byte.
        probe = [" ünï", "\n\n", "don", "  ", "<|", "漢字😀", "123"]
        self.direct = self.tokenizer.normalizer is None and self.by_model(probe) == self.by_batch(probe)

    def by_batch(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def by_model(self, words: list[str]) -> list[list[int]]:
        model = self.tokenizer.model
        return [[token.id for token in model.tokenize(w.encode().decode("latin-1").translate(BYTE_CHARS))] for w in words]

    def ids(self, words: list[str]) -> list[list[int]]:
        return self.by_model(words) if self.direct else self.by_batch(words)

    def encode(self, text: str) -> bytes:
        words = split(text)
        found = list(map(self.get, words))
        if None in found:
            # Only places of words that are not remembered are looked at again.
            gaps = [k for k, ids in enumerate(found) if ids is None]
            new = {words[k] for k in gaps}
            known = new & self.old.keys()
            self.update({w: self.old[w] for w in known})
            new = list(new - known)
            for w, now in zip(new, self.ids(new)):
                self[w] = struct.pack(f"<{len(now)}I", *now)
            for k in gaps:
                found[k] = self[words[k]]
        ids = b"".join(found)
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        return ids


@lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    """Loaded once per Python worker."""
    return TokenBytes(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): token ids of each text and ``end_id``, cut where longer than ``capacity``.

    A cut document consists of full pieces but for the first one. A null or empty text is
    ``end_id`` alone. The tokenizer file lies at the same path on every executor.
    """
    fields = "piece: int, start: bigint, length: bigint, ids_crc32: bigint" + (", ids: array<bigint>" if with_ids else "")
    end = np.array([end_id], dtype="<u4").tobytes()

    @F.pandas_udf(f"array<struct<{fields}>>")
    def cut(texts: pd.Series) -> pd.Series:
        encoder, rows = token_bytes(tokenizer), []
        for t in texts:
            ids = encoder.encode(t or "") + end
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
            found = []
            for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                part = ids[4 * s:4 * e]
                found.append({"piece": k, "start": s, "length": e - s, "ids_crc32": zlib.crc32(part)})
                if with_ids:
                    found[-1]["ids"] = np.frombuffer(part, dtype="<u4").astype(np.int64)
            rows.append(found)
        return pd.Series(rows)

    return docs.select(F.col(id_col).alias("id"), F.explode(cut(F.col(text))).alias("p")).select("id", "p.*")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, lo, hi, per, first, offset) by best fit, longest first, over counts.

    The items of ranks lo..hi-1 among those of a length go, ``per`` at a time and one behind the
    other, into sequences first, first+1, ..., from ``offset`` on. Equal sequences are handled
    as one run, and a step splits one run at most: the work and the plan grow with the number of
    lengths, which ``capacity`` bounds, not with the items.
    """
    slots, used = [], 0
    free: dict[int, deque] = {}  # room left -> runs (first, count) of sequences with exactly that room
    rooms = 0  # bit r: some run has room r

    def put(room: int, first: int, count: int) -> None:
        nonlocal rooms
        free.setdefault(room, deque()).append((first, count))
        rooms |= 1 << room

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                # As long as the room is smallest, an item that leaves enough of it has the next one follow.
                first, count = free[room].popleft()
                per = room // length
                whole = min(count, left // per)
                if whole < count:
                    free[room].appendleft((first + whole, count - whole))
                elif not free[room]:
                    del free[room]
                    rooms &= ~(1 << room)
                if whole:
                    slots.append((length, rank, rank + whole * per, per, first, capacity - room))
                    put(room - per * length, first, whole)
                    rank, left = rank + whole * per, left - whole * per
                else:  # the last items, fewer than one sequence takes
                    first, count = free[room].popleft()
                    if count > 1:
                        free[room].appendleft((first + 1, count - 1))
                    elif not free[room]:
                        del free[room]
                        rooms &= ~(1 << room)
                    slots.append((length, rank, rank + left, left, first, capacity - room))
                    put(room - left * length, first, 1)
                    rank, left = rank + left, 0
            else:
                count = -(-left // (capacity // length))
                put(capacity, used, count)
                used += count
    return slots


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts(id, piece, length, ids_crc32, ...)`` with ``sequence_id`` and ``offset``: gapless, at most ``capacity`` long.

    Ranks within a length are dealt in salted shares, so that a length of a third of all rows
    is ranked by many tasks: a share's ranks start where the shares before it end. The counts of
    shares and the slots are small tables bounded by lengths and shares, never rows.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"a piece must have 1 to {capacity} tokens")
    slots = spark.createDataFrame(plan(counts, capacity) or [(0, 0, 0, 1, 0, 0)],
                                  "s_length bigint, lo bigint, hi bigint, per bigint, first bigint, base bigint")
    top = max([1, *counts.values()])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = max(-(-top // RANK_ROWS), min(tasks, -(-top // LEAST_ROWS)))
    dealt = parts.withColumn("share", F.expr(f"pmod(xxhash64(id, piece, ids_crc32), {shares})"))
    sizes = dealt.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(
        F.col("length").alias("b_length"), F.col("share").alias("b_share"),
        F.expr("coalesce(sum(n) over (partition by length order by share rows between unbounded preceding and 1 preceding), 0)")
        .alias("before"))
    ranked = dealt.withColumn("local", F.expr(
        "row_number() over (partition by length, share order by id, piece, ids_crc32) - 1"))
    joined = ranked.join(before, F.expr("length = b_length and share = b_share")).withColumn("rank", F.expr("before + local"))
    # At most a few slots per length, whatever the rows: see plan().
    return joined.join(F.broadcast(slots), F.expr("length = s_length and rank >= lo and rank < hi")).select(
        *parts.columns, F.expr("first + (rank - lo) div per").alias("sequence_id"),
        F.expr("base + (rank - lo) % per * length").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece and its place, by best fit decreasing.

    Rows are packed one by one: repeated rows and ids each get a place of their own, a null id
    stays null, null and empty texts are one token long. No rows, no places. Other columns are
    not read. Pieces are staged, as they are counted, ranked and placed.
    """
    return place(staged(pieces(docs, tokenizer, id_col, text, capacity, end_id, with_ids), "pieces"), capacity)
