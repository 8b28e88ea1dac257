"""Periodic runs against a scan of all lags, alone and through the query."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from hitwatch.llm import common, periodic, queries

DATA = "/root/testdata/sf0.001"


def plain_runs(words, least=24, repeats=3):
    """Runs by comparing all words at all lags, and all smaller periods of each stretch."""
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            part = words[start : start + length]
            if length >= max(least, repeats * q) and all(part[:-d] != part[d:] for d in range(1, q)):
                out.append((start, length, q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def texts_with_runs(seed, n):
    """Word lists of stretches at random and of periods, nested and overlapping."""
    rng = random.Random(seed)
    for _ in range(n):
        letters, words = rng.choice([1, 2, 2, 3, 5, 20]), []
        word = lambda k=letters: b"%d" % rng.randrange(k)
        for _ in range(rng.randrange(0, 9)):
            if rng.random() < 0.4:
                words += [word() for _ in range(rng.randrange(1, 30))]
            else:
                words += ([word() for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 12))[: rng.randrange(1, 90)]
        yield words


@pytest.mark.parametrize(("least", "repeats"), [(24, 3), (1, 3), (9, 4)])
def test_runs_equal_a_scan_of_all_lags(least, repeats):
    texts = list(texts_with_runs(least, 400))
    for words, found in zip(texts, periodic.find_runs(texts, least, repeats), strict=True):
        assert found == plain_runs(words, least, repeats)
        assert periodic.collapse(words, found) == plain_collapse(words, found)


def test_splitting_is_stable_and_keeps_runs():
    """b is frequent in the text but rare in the parts that a leaves, so it splits them too."""
    words = [b"x", b"b", b"y", b"b", b"q1", b"b", *[b"p", b"q"] * 15, b"q2", b"b", b"z"]
    codes = np.unique(words, return_inverse=True)[1]
    starts, ends = periodic.segments(codes, np.array([0]), np.array([len(words)]), 24, 3)
    assert [(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] == [(6, 36)]
    assert periodic.find_runs([words]) == [[(6, 30, 2)]]


def test_equal_hashes_of_different_blocks_are_no_run(monkeypatch):
    """With base 1, sums of blocks agree for any order of words; only verified runs come out all the same."""
    monkeypatch.setattr(periodic, "_BASE", 1)
    texts = list(texts_with_runs(5, 200))
    assert periodic.find_runs(texts) == [plain_runs(w) for w in texts]


def test_long_texts():
    rng = random.Random(2)
    words = [b"%d" % rng.randrange(4) for _ in range(30_000)]
    words[9_000:21_000] = words[9_000:12_000] * 4
    words[25_000:25_100] = [b"7"] * 100
    found = periodic.find_runs([words])[0]
    assert {(q, length >= 12_000) for _, length, q in found if q > 200} == {(3_000, True)} and any(q == 1 and length >= 100 for _, length, q in found)
    assert periodic.best_of(found) == next(i for i, r in enumerate(found) if r[2] == 1 and r[1] >= 100)
    assert periodic.find_runs([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text", "score", "n_words", periodic.periodic_runs(odd_docs["text"]).alias("r")).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        words = (r["text"] or "").encode().split()
        runs = plain_runs(words) if len(words) < 5_000 else []
        assert (r["r"]["n_words"], [tuple(x) for x in r["r"]["runs"]], r["score"], r["n_words"]) == (len(words), runs, 0.5, 3)
        assert r["r"]["collapsed"].encode() == plain_collapse(words, runs)
    assert no_docs.select(periodic.periodic_runs(no_docs["text"]).alias("r")).count() == 0
    with pytest.raises(ValueError, match="repeats"):
        periodic.periodic_runs(odd_docs["text"], repeats=2)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in common.read(spark, DATA, "documents").collect()}
    got = queries.op13_periodic(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs) and sum(r["n_runs"] > 0 for r in got) > 10
    for r in got:
        words = planted(r["doc_id"], (docs[r["doc_id"]] or "").encode().split())
        if len(words) > 3_000:  # the plain scan takes all lags
            continue
        runs = plain_runs(words)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest() and r["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, runs)).hexdigest()
        assert r["n_words"] == len(words)


def test_repeats_put_into_odd_documents(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(i, "a b  c\td e " * (i % 9)) for i in range(2_000, 2_200)], "doc_id long, text string"))
    found = queries.with_repeats(rows).collect()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, b" ".join(planted(r["doc_id"], (r["text"] or "").encode().split()) if r["doc_id"] is not None else (r["text"] or "").encode().split())) for r in rows.collect())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, b" ".join((r["text"] or "").encode().split())) for r in found) == want
