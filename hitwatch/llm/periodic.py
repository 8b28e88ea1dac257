"""Periodic runs of words, by recursive frequency splitting and a lag scan of what is left.

A run is a stretch of consecutive words whose smallest period is q, of at least ``max(least, repeats * q)`` words, that no
neighbouring word extends. Every word of a run occurs in it at least ``repeats`` times, so a word that is rarer than that within its
segment belongs to none: it splits the segment, and the pieces are judged anew by their own frequencies until nothing splits.
A run never loses a word to this, so each lies whole in one surviving segment.

Surviving segments are scanned lag by lag. A run of period q is a stretch of at least m words that equal the words q places on, so it
covers one whole block of half of m words; blocks are compared by rolling hashes, about n / q of them at lag q, and those that agree
are extended and verified word by word. A block inside a run of a period that divides q belongs to that run and is passed over.

Defined cases: a null or blank text has no words and no runs; texts are taken whole, in blocks of rows of a bounded number of words;
repeated rows are judged alike, row by row, and other columns pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that one task looks at together, unless a single text has more.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_TYPE = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,best:int,collapsed:string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Run = tuple[int, int, int]


def segments(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the stretches [start, end) that stay when words with under ``repeats`` places in their part split it, again and again."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        own = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(len(own)) - first[own] + starts[own]
        _, which, counts = np.unique(own * (int(codes.max()) + 1) + codes[at], return_inverse=True, return_counts=True)
        rare = counts[which] < repeats
        split = np.bincount(own, weights=rare, minlength=len(starts)) > 0
        done.append((starts[~split], ends[~split]))
        # stretches of words that stay, within the segments that were split; the others are stable
        stays = ~rare & split[own]
        edge = np.concatenate([[True], own[1:] != own[:-1]])
        opens = np.flatnonzero(stays & (edge | ~np.concatenate([[False], stays[:-1]])))
        closes = np.flatnonzero(stays & np.concatenate([edge[1:] | ~stays[1:], [True]]))
        starts, ends = at[opens], at[closes] + 1
    if not done:
        return starts, ends
    starts, ends = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    steps = np.diff(np.concatenate([[0], same.view("i1"), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def lag_scan(words: np.ndarray, least: int, repeats: int) -> list[Run]:
    """All runs (start, length, period) of a sequence of word codes."""
    n = len(words)
    longest = n // repeats
    mixed = (words.astype("u8") + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    powers = np.empty(n + 1, "u8")
    powers[0] = 1
    np.multiply.accumulate(np.full(n, _BASE, "u8"), out=powers[1:])
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(mixed * powers[:n], dtype="u8")])
    runs: list[Run] = []
    low = 1
    while low <= longest:
        # no lag below twice the lowest has a divisor among them, so what divides a lag has been scanned before; each pass stays small
        high = min(2 * low, low + max(1, BLOCK * low // n), longest + 1)
        lags = np.arange(low, high)
        low = high
        need = np.maximum(least - lags, (repeats - 1) * lags)
        block = (need + 1) // 2
        count = (n - lags) // block
        which = np.repeat(np.arange(len(lags)), count)
        lag, width = lags[which], block[which]
        begin = (np.arange(len(which)) - (np.cumsum(count) - count)[which]) * width
        hit = (sums[begin + width] - sums[begin]) * powers[lag] == sums[begin + lag + width] - sums[begin + lag]
        lag, width, begin = lag[hit], width[hit], begin[hit]
        for start, length, period in runs:
            if not len(lag):
                break
            apart = (lag % period != 0) | (begin < start) | (begin + width + lag > start + length)
            lag, width, begin = lag[apart], width[apart], begin[apart]
        if not len(lag):
            continue
        opens = np.flatnonzero(np.concatenate([[True], (lag[1:] != lag[:-1]) | (begin[1:] != begin[:-1] + width[:-1])]))
        found: set[Run] = set()
        for a, b in zip(opens, np.append(opens[1:], len(lag)), strict=True):
            q, w = int(lag[a]), int(width[a])
            lo, hi = max(0, int(begin[a]) - w), min(n - q, int(begin[b - 1]) + 2 * w)
            for s, e in zip(*_stretches(words[lo:hi] == words[lo + q : hi + q]), strict=True):
                run = (lo + int(s), int(e - s) + q, q)
                if run[1] >= max(least, repeats * q) and not any(q % p == 0 and x <= run[0] and run[0] + run[1] <= x + z for x, z, p in runs):
                    found.add(run)
        runs += sorted(found)
    return runs


def best_of(runs: list[Run]) -> int | None:
    """Place of the run with the greatest exact length / period; ties: the first of the list."""
    best = None
    for i, (_, length, period) in enumerate(runs):
        if best is None or length * runs[best][2] > runs[best][1] * period:
            best = i
    return best


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that some run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, "i8")
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def find_runs(texts: list[list[bytes]], least: int = 24, repeats: int = 3) -> list[list[Run]]:
    """Runs of each text's words, sorted by start, then period."""
    sizes = np.array([len(t) for t in texts], "i8")
    out: list[list[Run]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    codes = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy().astype("i8")
    ends = np.cumsum(sizes)
    starts, stops = segments(codes, ends - sizes, ends, least, repeats)
    for a, b, doc in zip(starts.tolist(), stops.tolist(), np.searchsorted(ends, starts, side="right").tolist(), strict=True):
        shift = a - int(ends[doc] - sizes[doc])
        out[doc] += [(s + shift, length, q) for s, length, q in lag_scan(codes[a:b], least, repeats)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def _blocks(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    block: list[list[bytes]] = []
    held = 0
    for text in texts:
        block.append((text or b"").split())  # at space and tab to carriage return, as bytes are
        held += len(block[-1])
        if held >= BLOCK:
            yield block
            block, held = [], 0
    yield block


def periodic_runs(text: Column, *, least: int = 24, repeats: int = 3) -> Column:
    """Column (n_words, runs, best, collapsed) of a text column: its runs by start, then period, the place of the one with the most
    repeats in that list (null: none), and the text without what runs repeat.

    ``repeats`` is at least 3, so that a run's smaller periods divide its lag.
    """
    if repeats < 3 or least < 1:
        raise ValueError("repeats must be at least 3, and least at least 1")

    @F.arrow_udf(_TYPE)
    def runs_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, runs, bests, collapsed = [], [], [], []
            for block in _blocks(batch.cast(pa.binary()).to_pylist()):
                for words, found in zip(block, find_runs(block, least, repeats), strict=True):
                    counts.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    bests.append(best_of(found))
                    collapsed.append(collapse(words, found))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(bests, pa.int32()), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["n_words", "runs", "best", "collapsed"])

    return runs_of(text)
