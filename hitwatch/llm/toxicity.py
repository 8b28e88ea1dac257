"""Toxicity: a character n-gram linear classifier over features scaled by naive Bayes log-count ratios.

Presence of hashed character n-grams (3 to 6 code points of the lower-cased text) gives the naive Bayes
log-count ratios. Every n-gram bucket of at least ``least_texts`` texts whose ratio differs from 0 by ``significance`` of its standard
errors is a feature, however many there are (2^20 buckets at most), scaled by its ratio, and an
L2-regularised logistic regression is fitted on them. Without that test (all buckets) the fit learns the common words of its few toxic
texts: 60 instead of 108 of 120 held-out toxic documents of the 10,000-document tables. Labels come from a bounded sample of labelled rows
(``max_rows``, documented parameter), whose features number ``max_values`` at most (4 bytes each; the fit runs in one task over them, the driver gets the
weights alone); every text is scored whole.

Defined cases: a null text counts as empty and gets the model's score for a text without features; null
labels are ignored, a label counts once for an id and its smallest text; with no labelled rows, or a single class, every score is the smoothed share of label 1.
Repeated rows are scored alike, row by row; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitwatch.llm import common

SIZES = (3, 4, 5, 6)
BITS = 20
#: Feature occurrences that the fit takes up together.
BLOCK = 1 << 19


@dataclass
class Toxicity:
    """``slot`` maps an n-gram bucket to a feature (0: none); ``weight`` has the features' products of ratio and coefficient."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float


def buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hash buckets of all character n-grams of a text, one for each occurrence."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found, rolled = [], points
    for n in range(2, SIZES[-1] + 1):
        if len(points) < n:
            break
        rolled = rolled[:-1] * np.uint32(0x01000193) + points[n - 1 :]
        if n in SIZES:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1)
            found.append(mixed >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.zeros(0, "u4")


def distinct(values: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Each value once; ``marks`` is scratch space as long as the value range."""
    at = np.arange(len(values), dtype=marks.dtype)
    marks[values] = at
    return values[marks[values] == at]


def log_ratios(labelled: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows (bucket, pos, neg): in how many texts of either label a bucket occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, marks = np.zeros((2, 1 << bits), "i8"), np.zeros(1 << bits, "i4")
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label, distinct(buckets(text, bits), marks)] += 1
        at = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1, at]), pa.array(seen[0, at])], names=["bucket", "pos", "neg"])

    return labelled.mapInArrow(count, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, penalty: float, rounds: int, settled: float = 1e-3) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the L2-regularised log loss of 0/1 features times ``scale``, until the slope is ``settled`` of the first one."""
    sizes = np.array([len(r) for r in rows])
    n, k, ends = len(rows), len(scale), np.cumsum(sizes)
    at = np.concatenate(rows).astype("i4")
    # in blocks of rows, so that what is made of the features' values stays small
    edges = [0, *np.flatnonzero(np.diff(ends // BLOCK) > 0) + 1, n]
    blocks = [(a, b, int(ends[a] - sizes[a]), int(ends[b - 1])) for a, b in zip(edges, edges[1:], strict=False) if a < b]

    def margins(weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each row's features."""
        out = np.empty(n)
        for a, b, first, last in blocks:
            sums = np.concatenate([[0.0], np.cumsum(weights[at[first:last]])])
            out[a:b] = sums[ends[a:b] - first] - sums[ends[a:b] - sizes[a:b] - first]
        return out

    def spread(values: np.ndarray) -> np.ndarray:
        """Sum of the values of the rows that have each feature."""
        out = np.zeros(k)
        for a, b, first, last in blocks:
            out += np.bincount(at[first:last], weights=np.repeat(values[a:b], sizes[a:b]), minlength=k)
        return out

    coef, bias = np.zeros(k), float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    ahead, ahead_bias, momentum = coef.copy(), bias, 1.0
    # a Lipschitz bound by power iteration on the scaled design matrix with its intercept
    probe = np.ones(k + 1)
    for _ in range(12):
        out = margins(probe[:k] * scale) + probe[k]
        probe = np.append(spread(out) * scale, out.sum())
        top = np.linalg.norm(probe)
        probe /= top
    step, steepest = 1 / (0.3 * top / n + penalty), 0.0
    for _ in range(rounds):
        margin = margins(ahead * scale) + ahead_bias
        miss = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels) / n
        slope = spread(miss) * scale + penalty * ahead
        steepest = max(steepest, float(np.linalg.norm(slope)))
        if np.linalg.norm(slope) <= settled * steepest:
            break
        new, new_bias = ahead - step * slope, ahead_bias - step * miss.sum()
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        push = (momentum - 1) / grown
        ahead, ahead_bias = new + push * (new - coef), new_bias + push * (new_bias - bias)
        coef, bias, momentum = new, new_bias, grown
    return coef * scale, bias


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000, max_values: int = 24_000_000, significance: float = 3.0, least_texts: int = 2, alpha: float = 1.0, penalty: float = 1e-3, rounds: int = 150, seed: int = 7) -> Toxicity:
    """Fit on at most about ``max_rows`` of the rows of ``labels``; its ids select the texts, so only those are exchanged."""
    spark = docs.sparkSession
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_id IS NOT NULL AND _label IN (0, 1)").distinct()
    chosen = common.bounded(ids, "_id", max_rows, seed)
    # about max_rows rows of 12 bytes: the bound makes the broadcast safe at any size of the corpus
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    # an id that many rows share counts once, with its smallest text
    labelled = common.Stored(found.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).select("_text", "_label", F.xxhash64("_id", "_label").alias("_at")), "toxicity")
    sizes = {r["_label"]: r["n"] for r in labelled.df.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    none = Toxicity(np.zeros(1 << BITS, "i4"), np.zeros(1), float(np.log((pos + 1) / (neg + 1))))
    if not pos or not neg:
        labelled.discard()
        return none
    ratio = F.log((F.col("pos") + alpha) / (pos + 2 * alpha)) - F.log((F.col("neg") + alpha) / (neg + 2 * alpha))
    z = F.abs(ratio) / F.sqrt(1 / (F.col("pos") + alpha) + 1 / (F.col("neg") + alpha))
    told = log_ratios(labelled.df).filter(F.col("pos") + F.col("neg") >= least_texts).select("bucket", ratio.alias("ratio"), z.alias("z"))
    top = told.filter(F.col("z") >= significance).select("bucket", "ratio").orderBy("bucket").toArrow()  # at most 2^BITS rows of 16 bytes
    if not len(top):
        labelled.discard()
        return none
    slot = np.zeros(1 << BITS, "i4")
    slot[top["bucket"].to_numpy()] = np.arange(1, len(top) + 1)
    scale = np.concatenate([[0.0], top["ratio"].to_numpy()])
    shared = spark.sparkContext.broadcast(slot)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.unique(s[s > 0]).astype("<i4").tobytes() for s in (shared.value[buckets(t)] for t in batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.binary()), batch.column(1), batch.column(2)], names=["slots", "label", "at"])

    kept = common.Stored(labelled.df.mapInArrow(present, "slots binary, label int, at long"), "slots")
    labelled.discard()
    # two numbers of about max_rows rows: where they hold more values than fit, the rows with the least hashes of their ids stay
    held = sorted((r["at"], r["n"]) for r in kept.df.select("at", (F.octet_length("slots") / 4).cast("long").alias("n")).collect())
    fits = int((np.cumsum([n for _, n in held]) <= max_values).sum())
    last = held[max(fits, 1) - 1][0]

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ys = [], []
        for batch in batches:
            rows += [np.frombuffer(x, "<i4") for x in batch.column(0).to_pylist()]
            ys += batch.column(1).to_pylist()
        weight, bias = fit_logistic(rows, np.array(ys, float), scale, penalty, rounds)
        yield pa.RecordBatch.from_arrays([pa.array([weight.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], names=["weight", "bias"])

    # the sample is bounded in rows and values, so one task holds it; the driver gets a weight a feature
    one = kept.df.filter(F.col("at") <= last).repartition(1).sortWithinPartitions("at").select("slots", "label").mapInArrow(fitted, "weight binary, bias double").first()
    kept.discard()
    return Toxicity(slot, np.frombuffer(one["weight"], "<f8"), one["bias"])


def score_texts(texts: list[str | None], model: Toxicity) -> np.ndarray:
    """Probability of label 1 for each text."""
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        slots = model.slot[buckets(text)]
        out[i] = model.bias + model.weight[np.unique(slots[slots > 0])].sum()
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def scorer(docs: DataFrame, model: Toxicity, text_col: str = "text") -> Column:
    """Column with the toxicity score of ``text_col``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(texts.tolist(), shared.value))

    return toxicity(F.col(text_col))
