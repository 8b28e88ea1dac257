"""Language identification by hyperdimensional profiles.

Each letter of any script has a random bipolar vector of its own, from a counter-based generator keyed by its code point, so
no table of letters is needed. A trigram's vector binds (multiplies) its letters' vectors, the
earlier ones rotated by two and one places; a text's vector bundles (adds) those of all its trigrams, and a
language's prototype bundles the unit vectors of its training texts. A text gets the language whose
prototype has the largest cosine with its own vector. Everything but letters is one separator.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the language that
sorts first; with nothing to learn from, every text is ``und``. Training takes a bounded sample
(``max_rows``) of rows with text and language, one row an id. Repeated rows are predicted alike, other columns ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitwatch.llm import common

DIM = 1024
UNKNOWN = "und"


@dataclass
class Profiles:
    names: list[str]
    vectors: np.ndarray  # unit rows


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """Rows of -1 and 1 of code points: bits of a mixed counter, 64 at a time (the separator is code point 0)."""
    counter = points.astype("u8")[:, None] * np.uint64(DIM // 64) + np.arange(DIM // 64, dtype="u8") + np.uint64(20240611)
    z = counter * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    bits = np.unpackbits((z ^ (z >> np.uint64(31))).astype("<u8").view("u1"), axis=1)
    return bits.astype("i1") * 2 - 1


def trigram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams (three code points in a 64-bit number), as rows."""
    parts = [grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF]
    used, place = np.unique(np.concatenate(parts), return_inverse=True)
    v = letter_vectors(used)
    first, second, third = place.reshape(3, -1)
    return (np.roll(v, 2, axis=1)[first] * np.roll(v, 1, axis=1)[second] * v[third]).astype("f4")


class Seen:
    """Vectors of the trigrams met so far, kept while they fit."""

    def __init__(self, most: int = 12_000) -> None:
        self.grams, self.rows, self.vectors, self.n = np.zeros(0, "i8"), np.zeros(0, "i8"), np.empty((most, DIM), "f4"), 0

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of distinct, sorted trigrams."""
        at = np.searchsorted(self.grams, grams)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == grams[known]
        new = grams[~known]
        if self.n + len(new) > len(self.vectors):
            return trigram_vectors(grams)
        if len(new):
            self.vectors[self.n : self.n + len(new)] = trigram_vectors(new)
            places = np.searchsorted(self.grams, new)
            self.grams = np.insert(self.grams, places, new)
            self.rows = np.insert(self.rows, places, np.arange(self.n, self.n + len(new)))
            self.n += len(new)
            at = np.searchsorted(self.grams, grams)
        return self.vectors[self.rows[at]]


def trigrams(text: str | None) -> np.ndarray:
    """Trigrams of a text's letters, separators squeezed to one and put at both ends; empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kept = np.where(letters()[points], points, 0)
    if not kept.any():
        return np.zeros(0, "i8")
    s = np.concatenate([[0], kept, [0]]).astype("i8")
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    return (s[:-2] << 42) | (s[1:-1] << 21) | s[2:]


def bundle(texts: list[str | None], seen: Seen, block: int = 4096) -> np.ndarray:
    """The texts' vectors, as rows; zero for a text without letters."""
    counted = [np.unique(trigrams(t), return_counts=True) for t in texts]
    used, place = np.unique(np.concatenate([*(g for g, _ in counted), np.zeros(0, "i8")]), return_inverse=True)
    counts = np.zeros((len(texts), len(used)), "f4")
    counts[np.repeat(np.arange(len(texts)), [len(g) for g, _ in counted]), place] = np.concatenate([*(n for _, n in counted), np.zeros(0, "i8")])
    out = np.zeros((len(texts), DIM), "f4")
    for i in range(0, len(used), block):
        out += counts[:, i : i + block] @ seen.of(used[i : i + block])
    return out


def units(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths > 0, lengths, 1)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 8_000, seed: int = 9) -> Profiles:
    """Prototypes from at most about ``max_rows`` rows of ``docs``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    chosen = common.bounded(rows.filter("_lang IS NOT NULL AND _id IS NOT NULL"), "_id", max_rows, seed).filter("_text IS NOT NULL")
    # an id that many rows share counts once, with its smallest text
    known = chosen.groupBy("_id").agg(F.min(F.struct("_text", "_lang")).alias("_r")).select("_r._text", "_r._lang")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        seen = Seen()
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(texts), 128):
                for lang, v in zip(langs[i : i + 128], units(bundle(texts[i : i + 128], seen)), strict=True):
                    total[lang] = total.get(lang, 0) + v.astype("f8")
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = known.mapInArrow(sums, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = parts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    vectors = np.array([[p["x"] for p in r["v"]] for r in found], "f8").reshape(len(found), DIM)
    keep = np.linalg.norm(vectors, axis=1) > 0
    return Profiles([r["lang"] for r, k in zip(found, keep, strict=True) if k], units(vectors[keep]).astype("f4"))


def predict(texts: list[str | None], model: Profiles, seen: Seen) -> tuple[list[str], np.ndarray]:
    langs, scores = [], np.zeros(len(texts))
    for i in range(0, len(texts), 128):
        own = units(bundle(texts[i : i + 128], seen))
        if not model.names:
            langs += [UNKNOWN] * len(own)
            continue
        cosines = own @ model.vectors.T
        best, empty = cosines.argmax(1), ~own.any(1)
        langs += [UNKNOWN if e else model.names[b] for b, e in zip(best, empty, strict=True)]
        scores[i : i + len(own)] = np.where(empty, 0, np.clip(cosines.max(1), 0, 1))
    return langs, scores


def predictor(docs: DataFrame, model: Profiles, text_col: str = "text") -> Column:
    """Column of struct (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen = Seen()
        for texts in batches:
            langs, scores = predict(texts.tolist(), shared.value, seen)
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return language(F.col(text_col))
