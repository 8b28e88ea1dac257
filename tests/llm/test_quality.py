"""Quality: measures and trees against plain loops, and accuracy on held-out labels."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitwatch.llm import common, quality, queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    got = queries.op11_quality(spark, DATA)
    docs, labels = common.read(spark, DATA, "documents"), common.read(spark, DATA, "labels")
    assert got.count() == docs.count() == got.filter(F.col("score").between(0, 1)).count()
    return got.join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()


def test_held_out_documents(rows):
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    pos, neg = ([r["score"] for r in held if r["quality"] == y] for y in (1, 0))
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.97
    assert np.mean([s >= 0.3 for s in pos]) > 0.97 and np.mean([s < 0.3 for s in neg]) > 0.6


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = common.read(spark, DATA, "documents"), common.read(spark, DATA, "labels")
    held = common.crc_fold("doc_id", 5) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x.filter(~held), rounds=5, pair_rounds=2) for x in (labels, turned))
    assert a.bias == b.bias and all((s == t).all() for s, t in zip(a.tables, b.tables, strict=True))


def plain_measures(text):
    """The measures by their names, letter by letter and word by word."""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    share = lambda of, n: sum(of) / n if n else 0.0
    n, chars = len(words), len(text)
    letters = [c for c in text if c.isalpha()]
    low = Counter(ord(c) % 256 for c in text)
    stop = ".,;:!?"
    return {
        "log_chars": np.log(1 + chars), "log_words": np.log(1 + n), "word_length": share(map(len, words), n), "word_length_spread": np.std([len(w) for w in words]),
        "capitals": share((c.isupper() for c in letters), len(letters)), "letters": len(letters) / chars, "digits": share((c.isdigit() for c in text), chars), "spaces": share((c.isspace() for c in text), chars),
        "stops": share((c in stop for c in text), chars), "symbols": share((not (c.isalpha() or c.isdigit() or c.isspace() or c in stop) for c in text), chars), "shouts": text.count("!") / n,
        "entropy": -sum(v / chars * np.log2(v / chars) for v in low.values()), "distinct_words": len(set(words)) / n, "commonest_word": max(map(words.count, set(words))) / n,
        "same_as_before": share((a == b for a, b in zip(words, words[1:], strict=False)), n), "repeated_pairs": 1 - len({(a, b) for a, b in zip(words, words[1:], strict=False)}) / (n - 1) if n > 1 else 0,
        "plain_words": share((w.isalpha() for w in words), n), "short_words": share((len(w) <= 3 for w in words), n), "stopped_words": share((w[-1] in stop for w in words), n), "capital_words": share((w.istitle() for w in words), n),
        "log_lines": np.log(1 + len(lines)), "line_words": n / len(lines), "repeated_lines": 1 - len(set(lines)) / len(lines), "ended_lines": share((x.rstrip()[-1:] in (".", "!", "?") for x in lines), len(lines)),
    }


def test_measures_equal_plain_loops(odd_docs):
    for text in [r["text"] for r in odd_docs.select("text").collect() if r["text"] and len(r["text"]) < 5_000] + ["x", "A b! B", "1 | 2 |\n\n| 3.\n| 3.\n", "ÄÖ ЖЖ жж 日本 \U0001d400"]:
        if text.split():
            want = plain_measures(text)
            assert tuple(want) == quality.MEASURES
            np.testing.assert_allclose(quality.measure(text), list(want.values()), rtol=1e-9, atol=1e-9)
    assert quality.measure(None) == quality.measure("") == quality.measure(" \n") == [0.0] * len(quality.MEASURES)
    assert len(quality.measure("word " * 100_000)) == len(quality.MEASURES)


def gain_of(parts, ridge):
    return sum(g * g / (h + ridge) for g, h in parts) - sum(g for g, _ in parts) ** 2 / (sum(h for _, h in parts) + ridge)


def test_cuts_equal_all_cuts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.uniform(0.1, 2, 9)
        allowed = {i: gain_of([(g[:i].sum(), h[:i].sum()), (g[i:].sum(), h[i:].sum())], 1.0) for i in range(1, 9) if min(h[:i].sum(), h[i:].sum()) >= 2}
        gain, at = quality.cut(g, h, 1.0, 2.0)
        if max(allowed.values(), default=0) <= 0:
            assert gain == 0 and not quality.tree(g, h, 1.0, 2.0).any()
            continue
        assert at == max(allowed, key=allowed.get) and abs(gain - allowed[at]) < 1e-9
        steps = quality.tree(g, h, 1.0, 2.0)
        assert len(np.unique(steps.round(12))) <= 4
        left = slice(0, at)
        sub, sub_at = quality.cut(g[left], h[left], 1.0, 2.0)
        first = slice(0, sub_at if sub > 0 else at)
        assert abs(steps[0] - g[first].sum() / (h[first].sum() + 1)) < 1e-9


def test_quarters_equal_all_crosses():
    rng = np.random.default_rng(2)
    for _ in range(20):
        g, h = rng.normal(size=(5, 6)), rng.uniform(0.1, 1, (5, 6))
        crosses = {}
        for r, c in product(range(1, 5), range(1, 6)):
            parts = [(g[a, b].sum(), h[a, b].sum()) for a in (slice(0, r), slice(r, None)) for b in (slice(0, c), slice(c, None))]
            crosses[r, c] = sum(x * x / (w + 1) for x, w in parts if w >= 1.5) - g.sum() ** 2 / (h.sum() + 1)
        best = max(crosses, key=crosses.get)
        gain, steps = quality.quarters(g, h, 1.0, 1.5)
        assert abs(gain - max(crosses[best], 0)) < 1e-9
        if gain > 0:
            r, c = best
            want = g[:r, :c].sum() / (h[:r, :c].sum() + 1) if h[:r, :c].sum() >= 1.5 else 0
            assert abs(steps[0, 0] - want) < 1e-9


def test_tables_add_up_and_rounds_lower_the_loss():
    """Labels follow one measure, and the sign of a product of two others, which only a pair can tell."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3_000, 4))
    y = ((x[:, 0] > 1) | (x[:, 1] * x[:, 2] > 0)).astype(float)
    losses = []
    for rounds in (1, 10, 60):
        m = quality.fit(x, y, rounds=rounds, pair_rounds=rounds, n_pairs=2)
        p = m.score(x)
        losses.append(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    assert losses[0] > losses[1] > losses[2] and (1, 2) in m.pairs and np.mean((p > 0.5) == y) > 0.9
    for row, margin in zip(x[:40], m.margin(x[:40]), strict=True):
        at = [int(sum(e <= v for e in edges)) for v, edges in zip(row, m.edges, strict=True)]
        terms = [t[b] for t, b in zip(m.tables, at, strict=True)] + [g[m.coarse[i][at[i]], m.coarse[j][at[j]]] for (i, j), g in zip(m.pairs, m.grids, strict=True)]
        assert abs(m.bias + sum(terms) - margin) < 1e-9


def test_bins_of_equal_values_and_constant_measures():
    x = np.array([[0.0, 7], [0, 7], [0, 7], [1, 7], [2, 7], [2, 7]] * 30)
    m = quality.fit(x, (x[:, 0] > 1).astype(float), rounds=40, pair_rounds=2)
    assert len(m.edges[1]) == 0 and (m.score(np.array([[0.0, 7], [2, 9], [-5, 0], [9, 7]])) > 0.5).tolist() == [False, True, False, True]


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(20, 1), (21, 1), (None, 0), (22, None)], "doc_id long, quality int")
    for docs, given, share in ((odd_docs, labels, 0.75), (odd_docs, labels.limit(0), 0.5), (no_docs, labels, 0.5)):
        scores = docs.select(quality.scorer(docs, quality.train(docs, given)).alias("s")).collect()
        assert len(scores) == docs.count() and all(abs(r["s"] - share) < 1e-9 for r in scores)
    both = spark.createDataFrame([(i, int(i % 2)) for i in range(60)] * 2, "doc_id long, quality int")
    a, b = (quality.train(odd_docs.repartition(n), both, rounds=3, pair_rounds=1) for n in (1, 5))
    assert a.bias == b.bias and (a.tables[0] == b.tables[0]).all()
    scored = odd_docs.select("doc_id", "score", "_id", quality.scorer(odd_docs, a).alias("q")).collect()
    assert len(scored) == odd_docs.count() and all(0 < r["q"] < 1 and r["score"] == 0.5 for r in scored)
    by = {r["doc_id"]: r["q"] for r in scored}
    assert by[0] == by[1] == by[2] and by[8] == by[9]
