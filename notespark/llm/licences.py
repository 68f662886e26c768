"""Licence notices in texts, by a positional index of the rarest licence words."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Phrases that always label a text.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, wording, and phrases that must stand in the match.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
            "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
     ("permission is hereby granted free of charge", "without restriction")),
    ("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0", ("in compliance with the license", "apache org licenses")),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", ("general public license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation", ("gnu general public license",)),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
             "by the Free Software Foundation", ("lesser general public license",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License",
     ("creative commons attribution 4 0 international",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted", ("with or without fee is hereby granted",)),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
)
#: Rarest words that a template is looked up by, how many of them must agree on its place, the share of its words
#: that must stand in order, and how many words more or less may stand between a word and its place, as a share of the
#: template's words.
ANCHORS, AGREEING, MATCHED, SLACK = 3, 2, 0.6, 0.25
#: The score of a text with a base phrase that no template covers.
BASE_SCORE = 0.5

_KEEP = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z in lower case) and anything beyond ASCII, of a text given in UTF-8."""
    return (text or b"").translate(_TABLE).split()


def in_order(template: list[bytes], part: list[bytes], lead: int, slack: int) -> int:
    """How many words of ``template`` stand in order in ``part``, each within ``slack`` of its place; word 0 belongs at ``lead``."""
    row = [0] * (len(part) + 1)
    for j, w in enumerate(template):
        new = [0]
        for i, x in enumerate(part):
            fits = x == w and abs(i - j - lead) <= slack
            new.append(row[i] + 1 if fits else max(row[i + 1], new[i]))
        row = new
    return row[-1]


class Index:
    """Postings of the templates' rarest words."""

    def __init__(self, frequencies: dict[bytes, int]) -> None:
        self.templates = [(label, words_of(t.encode()), [words_of(p.encode()) for p in keys]) for label, t, keys in TEMPLATES]
        self.base = [(words_of(p.encode()), label) for p, label in BASE]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for k, (_, words, _) in enumerate(self.templates):
            # Words that no text has find nothing; they come last.
            rare = sorted(set(words), key=lambda w: (w not in frequencies, frequencies.get(w, 0), w))[:ANCHORS]
            self.needed.append(min(AGREEING, len(rare)))
            for at, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((k, at))

    def scan(self, text: bytes | None) -> tuple:
        words = words_of(text)
        present = set(words)
        places, labels = [], set()
        for phrase, label in self.base:
            if present.issuperset(phrase):
                found = [i for i, w in enumerate(words) if w == phrase[0] and words[i:i + len(phrase)] == phrase]
                places += found
                labels |= {label} if found else set()
        matched, score = set(labels), BASE_SCORE if labels else 0.0
        if not present.isdisjoint(self.postings):
            votes = defaultdict(lambda: defaultdict(set))
            for i, w in enumerate(words):
                for k, at in self.postings.get(w, ()):
                    votes[k][i - at].add(w)
            for k, starts in votes.items():
                label, template, keys = self.templates[k]
                slack = int(SLACK * len(template))
                ordered = sorted(starts)
                lo, hi = 0, 0
                for start in ordered:
                    while ordered[lo] < start - slack:
                        lo += 1
                    while hi < len(ordered) and ordered[hi] <= start + slack:
                        hi += 1
                    if len(set().union(*(starts[x] for x in ordered[lo:hi]))) < self.needed[k]:
                        continue
                    first = max(0, start - slack - 3)
                    part = words[first:start + len(template) + slack + 3]
                    window = b" " + b" ".join(part) + b" "
                    if all(b" " + b" ".join(key) + b" " in window for key in keys):
                        share = in_order(template, part, start - first, slack) / len(template)
                        if share >= MATCHED:
                            matched.add(label)
                            score = max(score, share)
        return (len(words), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(labels)), ",".join(sorted(matched)), score)


def _frequencies(texts: DataFrame) -> dict[bytes, int]:
    """In how many rows each licence word occurs, over all rows. A few hundred words reach the driver."""
    vocabulary = frozenset(w for _, t, _ in TEMPLATES for w in words_of(t.encode()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch["t"]:
                counts.update(vocabulary.intersection(words_of(t)))
        if counts:
            yield pd.DataFrame({"word": [w.decode() for w in counts], "n": list(counts.values())})

    rows = texts.select("t").mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"].encode(): r["n"] for r in rows}


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of ``docs``.

    Base labels stand for phrases that occur word by word. Further labels come from templates: a
    template's rarest words, by the number of texts that hold them, are looked up in the text;
    where enough of them agree on about the same place for the template, its key phrases and the
    share of its words that stand there in order decide, so inserted and missing words only shift. The score is the best share, BASE_SCORE at least with a base label, 0
    without labels. Null and empty texts have no words. Rows are judged alone, whatever their
    ids; other columns are not read.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("t"))
    index = Index(_frequencies(read))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    @F.pandas_udf("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([index.scan(t) for t in texts], columns=names, dtype=object)

    return read.select("id", scanned("t").alias("r")).select("id", "r.*")
