"""BPE against the public library, packing against plain best fit, and their corner cases."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notespark.llm import bpe, packing, pretokens

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SF = Path("/root/testdata/sf0.001/documents.parquet")
SCHEMA = "doc_id bigint, text string"
ODD = ["", " ", "a", "\n\n  x", "it's  'tis we'll", "<|endoftext|>", "é\x1c\x85²½ ­ 日本語 🤦🏼‍♂️", "ab" * 9000, "a" * 3000 + " b",
       " ".join(["word"] * 6000), "x\t\ty\r\n z", "_a_1-2_"]


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(RANKS)


@pytest.fixture(scope="module")
def public(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def test_encode_like_the_public_library(vocab, public):
    rng = random.Random(2)
    alphabets = ["abcdefgh the", "aab", "\n \t'sdm'll", "0123456789", ".,!?-_%&*", "éèüßñçÉ", "日本語", "\x1c\x85\xa0 ​²³¼"]
    for _ in range(1500):
        pool = rng.sample(alphabets, 3)
        text = "".join(rng.choice(rng.choice(pool)) for _ in range(rng.randrange(80)))
        ids = vocab.encode(text)
        assert ids == public.encode_ordinary(text)
        assert vocab.decode(ids) == text.encode()
    for text in ODD:
        assert vocab.encode(text) == public.encode_ordinary(text)
    assert not any(vocab.words)


def test_long_pretoken(vocab, public):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmno") for _ in range(60_000))
    assert vocab.encode(text) == public.encode_ordinary(text)


def test_splits_agree_on_plain_characters():
    for c in map(chr, range(0x3000)):
        for text in (f" a{c}1 {c}", f"{c}{c} _{c}", f"  {c}"):
            assert pretokens.split(text) == pretokens._FULL.findall(text)


def test_round_trip(spark, public):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (2, "a"), (2, "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "r": F.lit(1), "ids_sha256": F.lit("y")})
    got = Counter(tuple(r) for r in bpe.round_trip(df, RANKS).collect())
    want = Counter()
    for d, t in rows:
        ids = public.encode_ordinary(t or "")
        want[(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), RANKS).collect() == []


def test_general_encode_and_decode(spark, public):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(99, None)], SCHEMA)
    for r in bpe.decode(bpe.encode(df, RANKS), RANKS).collect():
        assert list(r["ids"]) == public.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def best_fit(histogram, capacity):
    rooms, used = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                used, room = used + 1, capacity
            else:
                room = rooms.pop(i)
            bisect.insort(rooms, room - length)
    return used


def test_plan_is_best_fit():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 50, 100, 2048])
        histogram = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 60))}
        sequences, items = defaultdict(list), Counter()
        for length, lo, hi, per, first, offset in packing.plan(histogram, capacity):
            for rank in range(lo, hi):
                sequences[first + (rank - lo) // per].append((offset + (rank - lo) % per * length, length))
                items[length] += 1
        assert items == histogram
        for content in sequences.values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(sequences) == best_fit(histogram, capacity)
    assert packing.plan({}) == []


def check_packing(spark, rows, got, capacity=2048):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    want = Counter()
    histogram = Counter()
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[(d, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))] += 1
            histogram[e - s] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in sequences.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == best_fit(histogram, capacity)


@pytest.mark.parametrize("rank_rows", [100_000, 3])
def test_packing(spark, monkeypatch, rank_rows):
    monkeypatch.setattr(packing, "RANK_ROWS", rank_rows)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "no id"), (2, "a"), (2, "a"), (5, " ".join(["cat"] * 4095))]
    rows += [(200 + i, "one two three") for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "length": F.lit(1), "rank": F.lit(1), "share": F.lit(1)})
    check_packing(spark, rows, packing.pack_documents(df, JSON).collect())
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), JSON).collect() == []


def test_packing_of_the_small_table(spark):
    docs = spark.read.parquet(str(SF))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = packing.pack_documents(docs, JSON, with_ids=True).collect()
    check_packing(spark, rows, got)
    assert all(len(r["ids"]) == r["length"] for r in got)


def test_remembered_words_are_looked_up_once(monkeypatch):
    """op6: a text of words that a worker remembers costs one look at each; forgotten ones come back with the same ids."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from notespark.llm import packing

    class Counted(packing.TokenBytes):
        looks = 0

        def __getitem__(self, word):
            Counted.looks += 1
            return super().__getitem__(word)

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), Counted(path)
    texts = ["one two two three", "", "four  five\nsix ünï", "one two two three", "seven eight nine ten eleven", "one four ten"]
    for few in (packing.REMEMBERED, 4):
        monkeypatch.setattr(packing, "REMEMBERED", few)
        for text in texts:
            assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "REMEMBERED", 300_000)
    encoder.encode(texts[0])
    Counted.looks = 0
    encoder.encode(texts[0])
    assert Counted.looks == 0


def test_words_through_the_model_alone():
    """op6: what the model makes of a pre-token is what the whole library makes of it."""
    import public_tokenizers

    from notespark.llm import packing
    from notespark.llm.pretokens import split

    encoder = packing.TokenBytes(public_tokenizers.path("byte_bpe_50k.json"))
    words = list({w for w in split("".join(map(chr, [*range(1, 0x3000), *range(0x1F600, 0x1F640)])) + " It's  3.5\n\n\tnaïve <|endoftext|> x")})
    assert encoder.direct and encoder.by_model(words) == encoder.by_batch(words)
