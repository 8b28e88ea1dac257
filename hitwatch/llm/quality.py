"""Quality: a generalised additive model with pairwise interactions over measures of a text.

Every text is measured (``MEASURES``: lengths, shares of kinds of characters and words, repetition, lines). A measure's values fall into bins of about equal
weight, and the model is a sum of lookup tables: one for each measure, and one over the coarser bins of each of a few pairs. Tables are
learned by cyclic boosting: round after round, each measure in turn gets a shallow tree (four leaves at most) on the slope of the log loss, whose
steps are added to its table; then the pairs on which trees of one cut in either direction gain most are boosted alike. A text is scored by looking up its bins and adding.

Labels come from a bounded sample of labelled rows (``max_rows``, documented parameter: 20,000 rows of 24 numbers are 4 MB on the driver, whatever the texts'
lengths); every text is measured and scored whole.

Defined cases: a null text counts as empty, and an empty one has measures of 0 and the score of the tables there; null labels and ids are
ignored, a label counts once for an id (with the least of its rows' measures); with no labelled rows, or a single class, every score is the smoothed
share of label 1. Repeated rows are scored alike; other columns pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitwatch.llm import common

LETTER, CAPITAL, DIGIT, SPACE, STOP, SYMBOL = range(6)
MEASURES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "capitals", "letters", "digits", "spaces", "stops", "symbols", "shouts",
    "entropy", "distinct_words", "commonest_word", "same_as_before", "repeated_pairs", "plain_words", "short_words", "stopped_words", "capital_words",
    "log_lines", "line_words", "repeated_lines", "ended_lines",
)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Kind of each code point."""
    out = np.full(0x110000, SYMBOL, "u1")
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            out[p] = CAPITAL if c.isupper() else LETTER
        elif c.isdigit():
            out[p] = DIGIT
        elif c.isspace():
            out[p] = SPACE
    out[[ord(c) for c in ".,;:!?"]] = STOP
    return out


def measure(text: str | None) -> list[float]:
    """The measures of a whole text; shares of nothing are 0."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    if not words:
        return [0.0] * len(MEASURES)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.bincount(kinds()[points], minlength=6)
    chars, n = len(points), len(words)
    letters = kind[LETTER] + kind[CAPITAL]
    lengths = np.fromiter(map(len, words), "i8", n)
    low = np.bincount(points & 255)
    low = low[low > 0] / chars
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    plain = sum(map(str.isalpha, words))
    ends = [w[-1] for w in words]
    return [
        np.log1p(chars), np.log1p(n), lengths.mean(), lengths.std(), kind[CAPITAL] / max(letters, 1), letters / chars, kind[DIGIT] / chars, kind[SPACE] / chars,
        kind[STOP] / chars, kind[SYMBOL] / chars, text.count("!") / n,
        float(-(low * np.log2(low)).sum()), len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, 1 - pairs / max(n - 1, 1) if n > 1 else 0.0, plain / n, float((lengths <= 3).mean()),
        sum(map(".,;:!?".__contains__, ends)) / n, sum(map(str.istitle, words)) / n,
        np.log1p(len(lines)), n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / max(len(lines), 1),
    ]


@dataclass
class Quality:
    """``edges`` cut each measure into bins, ``tables`` has their terms; ``coarse`` maps bins to those of pairs, whose terms ``grids`` has."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin of every value, a column for each measure."""
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), "i8")

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1: the bias and one term from each table."""
        at, out = self.bins(x), np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            out += table[at[:, f]]
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            out += grid[self.coarse[i][at[:, i]], self.coarse[j][at[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def cut(slope: np.ndarray, curve: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """(gain, first bin of the right side) of the best cut of a row of bins; gain 0 if none is allowed."""
    g, h = np.cumsum(slope)[:-1], np.cumsum(curve)[:-1]
    whole_g, whole_h = slope.sum(), curve.sum()
    if not len(g):
        return 0.0, 0
    gain = g**2 / (h + ridge) + (whole_g - g) ** 2 / (whole_h - h + ridge) - whole_g**2 / (whole_h + ridge)
    gain[(h < least) | (whole_h - h < least)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def tree(slope: np.ndarray, curve: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """Newton step of each bin, constant on the at most four leaves of a tree of depth two."""
    leaves = [(0, len(slope))]
    for _ in range(2):
        halves = []
        for a, b in leaves:
            gain, at = cut(slope[a:b], curve[a:b], ridge, least)
            halves += [(a, a + at), (a + at, b)] if gain > 0 else [(a, b)]
        leaves = halves
    out = np.zeros(len(slope))
    if len(leaves) > 1:
        for a, b in leaves:
            out[a:b] = slope[a:b].sum() / (curve[a:b].sum() + ridge)
    return out


def quarters(slope: np.ndarray, curve: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """(gain, Newton steps) of the best tree with one cut in either direction of a grid."""
    g, h = (np.cumsum(np.cumsum(x, 0), 1) for x in (slope, curve))

    def parts(s: np.ndarray) -> list[np.ndarray]:
        """Sums of the four parts at every pair of cuts."""
        low, top, left = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1]
        return [low, top - low, left - low, s[-1, -1] - top - left + low]

    if min(slope.shape) < 2:
        return 0.0, np.zeros_like(slope)
    gs, hs = parts(g), parts(h)
    # a part that is too small to be judged stays as it is
    gain = sum(np.where(b >= least, a**2 / (b + ridge), 0) for a, b in zip(gs, hs, strict=True)) - g[-1, -1] ** 2 / (h[-1, -1] + ridge)
    r, c = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(slope)
    if gain[r, c] <= 0:
        return 0.0, out
    for (rows, cols), a, b in zip(((slice(0, r + 1), slice(0, c + 1)), (slice(0, r + 1), slice(c + 1, None)), (slice(r + 1, None), slice(0, c + 1)), (slice(r + 1, None), slice(c + 1, None))), gs, hs, strict=True):
        if b[r, c] >= least:
            out[rows, cols] = a[r, c] / (b[r, c] + ridge)
    return float(gain[r, c]), out


def fit(x: np.ndarray, y: np.ndarray, *, most_bins: int = 64, pair_bins: int = 12, n_pairs: int = 8, rounds: int = 120, pair_rounds: int = 60, rate: float = 0.08, ridge: float = 1.0, least: float = 1.0) -> Quality:
    """Tables learned from measures (rows x measures) and 0/1 labels of both kinds."""
    model = Quality(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    for values in x.T:
        steps = np.unique(np.quantile(values, np.arange(1, most_bins) / most_bins, method="higher"))
        model.edges.append(steps[steps > values.min()])
    at = model.bins(x)
    margin = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives of each row's log likelihood."""
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        return y - p, p * (1 - p)

    for f, edges in enumerate(model.edges):
        n = len(edges) + 1
        model.tables.append(np.zeros(n))
        weight = np.cumsum(np.bincount(at[:, f], minlength=n)) / len(y)
        model.coarse.append(np.minimum((np.concatenate([[0], weight[:-1]]) * pair_bins).astype("i8"), pair_bins - 1))
    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = (np.bincount(at[:, f], weights=v, minlength=len(table)) for v in slopes())
            step = rate * tree(g, h, ridge, least)
            table += step
            margin += step[at[:, f]]

    coarse = np.stack([c[at[:, f]] for f, c in enumerate(model.coarse)], axis=1)

    def grid(pair: tuple[int, int], values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[:, pair[0]] * pair_bins + coarse[:, pair[1]], weights=values, minlength=pair_bins**2).reshape(pair_bins, pair_bins)

    g, h = slopes()
    gains = {p: quarters(grid(p, g), grid(p, h), ridge, least)[0] for p in combinations(range(x.shape[1]), 2)}
    model.pairs = sorted((p for p in gains if gains[p] > 0), key=lambda p: (-gains[p], p))[:n_pairs]
    model.grids = [np.zeros((pair_bins, pair_bins)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for p, table in zip(model.pairs, model.grids, strict=True):
            g, h = slopes()
            step = rate * quarters(grid(p, g), grid(p, h), ridge, least)[1]
            table += step
            margin += step[coarse[:, p[0]], coarse[:, p[1]]]
    # tables have mean 0 over the sample, so that a term says how a text differs from the usual one
    for f, table in enumerate(model.tables):
        model.bias += (mean := float(table[at[:, f]].mean()))
        table -= mean
    for p, table in zip(model.pairs, model.grids, strict=True):
        model.bias += (mean := float(table[coarse[:, p[0]], coarse[:, p[1]]].mean()))
        table -= mean
    return model


def measures(text: Column) -> Column:
    """Array of the measures of a text column."""

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.array(measure(t)) for t in texts.tolist()], dtype=object)

    return measured(text)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, seed: int = 11, **settings: float) -> Quality:
    """Fit on at most about ``max_rows`` of the rows of ``labels``; their texts are measured where they are, and no text is exchanged."""
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id IS NOT NULL AND _label IN (0, 1)").distinct()
    chosen = common.bounded(ids, "_id", max_rows, seed)
    # about max_rows rows of 12 bytes: the bound makes the broadcast safe at any size of the corpus
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = found.select("_id", "_label", measures(F.col("_text")).alias("m")).groupBy("_id", "_label").agg(F.min("m").alias("m")).orderBy("_id", "_label").select("_label", "m").toArrow()
    y = rows["_label"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return Quality(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    return fit(rows["m"].combine_chunks().values.to_numpy().reshape(len(y), len(MEASURES)), y, **settings)


def scorer(docs: DataFrame, model: Quality, text_col: str = "text") -> Column:
    """Column with the quality score of ``text_col``: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([measure(t) for t in texts.tolist()]).reshape(-1, len(MEASURES))
            yield pd.Series(shared.value.score(x))

    return quality(F.col(text_col))
