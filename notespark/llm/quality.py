"""Quality scores by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged

#: Labelled rows a classifier is fitted on: if there are more, those whose hashed id falls into the share that gives so many.
FIT_ROWS = 20_000
SHARES = 1 << 30
#: The score from which a document counts as good.
THRESHOLD = 0.7

SENTENCE_MARKS, SYMBOLS = b".,;:!?", b"#$%&*|<>{}[]=+_~^\\/@"
FEATURES = (
    "log_chars", "log_words", "mean_word", "long_words", "short_words", "distinct_words", "top_word", "twin_words",
    "distinct_trigrams", "letters", "upper", "digits", "blanks", "marks", "symbols", "bars", "exclaims", "beyond_ascii",
    "entropy", "log_lines", "mean_line", "distinct_lines", "words_per_stop", "capital_words", "marked_words",
)
_CLASS = np.zeros((8, 256))
for _row, _bytes in enumerate((bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t\n\r\x0b\x0c",
                               SENTENCE_MARKS, SYMBOLS, b"|", b"!")):
    _CLASS[_row, list(_bytes)] = 1


def statistics(text: str) -> list[float]:
    """The values of FEATURES for a text: shares and means that need no dictionary; all 0 for one without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    histogram = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, low, digits, blanks, marks, symbols, bars, exclaims = (_CLASS @ histogram / len(raw)).tolist()
    beyond = histogram[128:].sum() / len(raw)
    share = histogram[histogram > 0] / len(raw)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    lines = text.split("\n")
    trigrams = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    ends = Counter([w[-1] for w in words])
    return [
        np.log1p(len(text)), np.log1p(n), sizes.mean(), (sizes > 15).mean(), (sizes <= 3).mean(), len(counts) / n,
        max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, trigrams, upper + low + beyond,
        upper / (upper + low + beyond + 1e-9), digits, blanks, marks, symbols, bars, exclaims, beyond, -(share * np.log2(share)).sum(),
        np.log1p(len(lines)), min(len(text) / len(lines), 5000), len(set(lines)) / len(lines),
        n / (1 + ends["."]), sum([w[0].isupper() for w in words]) / n, sum([ends[m] for m in "#$%&*!|"]) / n,
    ]


@dataclass(frozen=True)
class Forest:
    """Perfect binary trees flattened: inner nodes by level in ``feature`` and ``threshold``, leaves in ``leaf``."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all rows and all trees take a level together."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), dtype=np.int64)
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.threshold[tree, at])
        return 1 / (1 + np.exp(-(self.start + self.leaf[tree, at - inner].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.15, bins: int = 64,
        ridge: float = 1.0, least: float = 1.0) -> Forest:
    """Second-order boosting on the logistic loss; splits are searched on histograms of binned features.

    Without rows, or with labels of one kind, the score is the smoothed share of label 1.
    """
    n, width = len(x), (x.shape[1] if x.ndim == 2 else len(FEATURES))
    prior = (y.sum() + 1) / (n + 2)
    start = float(np.log(prior / (1 - prior)))
    inner = 2**depth - 1
    feature, threshold = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    if not n or y.min() == y.max():
        return Forest(start, feature, threshold, leaf)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(width)], axis=1)
    margin = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            gain, cut = np.full((many, width), -1.0), np.zeros((many, width), dtype=np.int64)
            for f in range(width):
                if not len(edges[f]):
                    continue
                key = node * bins + binned[:, f]
                g = np.bincount(key, gradient, many * bins).reshape(many, bins).cumsum(1)
                h = np.bincount(key, weight, many * bins).reshape(many, bins).cumsum(1)
                gl, hl, g_all, h_all = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gr, hr = g_all - gl, h_all - hl
                value = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g_all**2 / (h_all + ridge)
                value[(hl < least) | (hr < least) | (np.arange(bins - 1) >= len(edges[f]))] = -1.0
                cut[:, f] = value.argmax(1)
                gain[:, f] = value[np.arange(many), cut[:, f]]
            best = gain.argmax(1)
            for k in range(many):
                if gain[k, best[k]] > 1e-9:
                    feature[t, first + k], threshold[t, first + k] = best[k], edges[best[k]][cut[k, best[k]]]
            chosen, limit = feature[t, first + node], threshold[t, first + node]
            node = 2 * node + (x[np.arange(n), chosen] > limit)
        g, h = np.bincount(node, gradient, inner + 1), np.bincount(node, weight, inner + 1)
        leaf[t] = -rate * g / (h + ridge)
        margin += leaf[t, node]
    return Forest(start, feature, threshold, leaf)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, features array<double>) per row, with ``carry`` expressions; a null text counts as empty."""

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t or "") for t in texts])

    carried = [c.alias(name) for name, c in (carry or {}).items()]
    return docs.select(F.col(id_col).alias("id"), measured(F.col(text)).alias("features"), *carried)


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                   label: str = "quality", fit_rows: int = FIT_ROWS, carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, held_out, score, predicted) per row of ``docs``: how likely its label is 1, from the text alone. ``carry``
    adds expressions over ``docs``.

    Statistics of all texts are staged once. The trees are fitted on the labelled rows that are
    not held out (crc32 of the id as text, mod 4, is not 2), about ``fit_rows`` of them at most; their
    statistics are all that reaches the driver, and the trees are a few thousand numbers.
    Null and empty texts have statistics of 0 and are scored like any other. A null id is scored
    and never learned from, as are rows with a null or other label; repeated rows get equal
    scores. Without labels every score is 0.5; no rows, no scores. Other columns are not read.
    """
    rows = staged(with_statistics(docs, id_col, text, carry), "statistics")
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(id_col).alias("l_id"), F.col(label).cast("double").alias("y"))
    labelled = rows.filter(~is_held_out(F.col("id"))).join(known, F.col("id") == F.col("l_id")).select(
        F.xxhash64("id").alias("h"), "id", "features", "y")
    share = fit_rows / max(1, labelled.count())
    if share < 1:  # by hash, so that what reaches the driver is about fit_rows rows however many tasks there are
        labelled = labelled.filter(F.expr(f"pmod(h, {SHARES}) < {int(share * SHARES)}"))
    learned = labelled.toPandas().sort_values(["h", "id", "y"])
    x = np.array(learned["features"].tolist(), dtype=float).reshape(len(learned), len(FEATURES))
    forest = fit(x, learned["y"].to_numpy(float))

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.array(features.tolist(), dtype=float).reshape(len(features), len(FEATURES))))

    scored = rows.select("id", is_held_out(F.col("id")).alias("held_out"), score("features").alias("score"), *(carry or {}))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
