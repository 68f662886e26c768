"""Licence scan against a word-by-word search, and its corner cases."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from notespark.llm import licences

SCHEMA = "doc_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_hand(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licences.BASE:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def notices():
    rng = random.Random(6)
    filler = ["lorem", "ipsum", "the", "license", "of", "MIT", "general", "public", "apache", "é", "4", "x_y"]
    rows = [(i, " ".join(rng.choice(filler) for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(100 + k, f"Some text. {t}. More text\nfollows here.") for k, (_, t, _) in enumerate(licences.TEMPLATES)]
    rows += [(200, None), (201, ""), (202, "..."), (None, "Released under the MIT License."), (203, "mit license mit license"), (204, "mit-License!"),
             (203, "mit license mit license"), (205, "word " * 40_000 + "Apache License"), (206, "Licensed under CC, BY the way: NC 4.0")]
    return rows


def test_scan(spark):
    rows = notices()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "t": F.lit(1), "labels": F.lit(2), "word": F.lit(3)})
    got = licences.scan_licences(df).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((d, *by_hand(t)) for d, t in rows)
    labels = {r["id"]: set(r["labels"].split(",")) for r in got}
    for k, (label, _, _) in enumerate(licences.TEMPLATES):
        assert label in labels[100 + k]
    assert labels[206] == {""}
    for r in got:
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
    assert licences.scan_licences(spark.createDataFrame([], SCHEMA)).collect() == []


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r["doc_id"]: by_hand(r["text"]) for r in docs.collect()}
    assert {r["id"]: tuple(r)[1:6] for r in licences.scan_licences(docs).collect()} == want


MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
       "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
       "distribute, sublicense, and/or sell copies of the Software")


def test_inserted_missing_and_changed_words(spark):
    words = MIT.split()
    texts = [MIT, " ".join(words[:22] + words[24:]), " ".join(words[:25] + ["new", "words", "here"] + words[25:]),
             " ".join(words[:12] + ["changed"] + words[13:30] + words[31:]), "lead in " * 50 + MIT + " and on" * 50]
    # A wording that is far from the standard one in order has no label.
    texts.append(" ".join(["Permission is hereby granted free of charge", "without restriction", *reversed(words[10:])]))
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["id"]: r["labels"] for r in licences.scan_licences(rows).collect()}
    assert got == {0: "mit", 1: "mit", 2: "mit", 3: "mit", 4: "mit", 5: ""}


def test_anchors_occur_in_the_texts():
    """Two of the words that no text has must not be what a template is looked up by."""
    wording = "Permission is hereby granted, free of charge, to any person taking a copy of this software and its files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, share, and/or sell copies of the Software"
    seen = {w: 1 for w in licences.words_of(wording.encode())}
    assert licences.Index(seen).scan(wording.encode())[5] == "mit"
