"""Toxicity and language ID: held-out accuracy, and cases without anything to learn."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitwatch.llm import common, langid, queries, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def toxic_rows(spark):
    got = queries.op3_toxicity(spark, DATA)
    docs, labels = common.read(spark, DATA, "documents"), common.read(spark, DATA, "labels")
    assert got.count() == docs.count()
    return got.join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()


def test_folds(toxic_rows):
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in toxic_rows)


def test_toxicity_of_held_out_documents(toxic_rows):
    """38 labelled positives are few for a rule to be learned in four languages; the ranking must hold all the same."""
    held = [r for r in toxic_rows if r["held_out"]]
    pos, neg = ([r["score"] for r in held if r["toxic"] == y] for y in (1, 0))
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.85
    assert np.mean([s >= 0.3 for s in neg]) < 0.05


def test_toxicity_without_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(20, 1), (21, 1), (None, 0), (22, None)], "doc_id long, toxic int")
    for docs, given, share in ((odd_docs, labels, 0.75), (odd_docs, labels.limit(0), 0.5), (no_docs, labels, 0.5)):
        model = toxicity.train(docs, given)
        rows = docs.select(toxicity.scorer(docs, model).alias("s")).collect()
        assert len(rows) == docs.count() and all(abs(r["s"] - share) < 1e-9 for r in rows)


def test_toxicity_learns_a_word_and_scores_whole_texts(spark):
    rows = [(i, "some plain words here " * 3 + ("you zounder " if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df)
    late, clean = toxicity.score_texts(["plain words " * 50_000 + "zounder", "plain words " * 50_000], model)
    assert late > 0.5 > clean
    assert len(toxicity.score_texts([None, "", "a"], model)) == 3


def test_presence_counts_once():
    marks = np.zeros(1 << toxicity.BITS, "i4")
    got = toxicity.distinct(toxicity.buckets("abcabcabc"), marks)
    assert sorted(got) == sorted(set(toxicity.buckets("abcabcabc").tolist()))
    assert len(toxicity.buckets(None)) == len(toxicity.buckets("ab")) == 0


def test_language_of_held_out_documents(spark):
    docs = common.read(spark, DATA, "documents")
    rows = queries.op9_langid(spark, DATA).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98


def test_languages_of_odd_texts(odd_docs, no_docs):
    model = langid.train(odd_docs)
    rows = odd_docs.select("doc_id", langid.predictor(odd_docs, model).alias("p")).collect()
    by = {r["doc_id"]: r["p"] for r in rows}
    assert len(rows) == odd_docs.count()
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2))
    assert all(by[i]["lang_pred"] in ("en", "fr") for i in (3, 4, 5, 7))
    nothing = langid.train(no_docs)
    assert nothing.names == [] and odd_docs.select(langid.predictor(odd_docs, nothing).alias("p")).filter(F.col("p.lang_pred") != "und").count() == 0


def plain_vector(text):
    """Sum of a text's bound trigrams, letter by letter."""
    points = [0]
    for c in (text or "").lower():
        p = ord(c) if c.isalpha() else 0
        if p or points[-1]:
            points.append(p)
    if points[-1]:
        points.append(0)
    vectors = {p: langid.letter_vectors(np.array([p]))[0].astype(int) for p in set(points)}
    want = np.zeros(langid.DIM, int)
    for a, b, c in zip(points, points[1:], points[2:], strict=False):
        want += np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c]
    return want


def test_bundles_equal_bound_letters_one_by_one():
    for text in ("Ab, éa b", "Это так", "日本 語のテキスト"):
        want = plain_vector(text)
        assert (langid.bundle([text, ""], langid.Seen())[0] == want).all()
        assert (langid.bundle([text], langid.Seen(most=2))[0] == want).all()  # nothing fits the store


def test_letters_have_vectors_of_their_own():
    points = np.concatenate([np.arange(97, 123), np.arange(0x430, 0x450), np.arange(0x5D0, 0x5EB), np.arange(0x4E00, 0x4F00)])
    v = langid.letter_vectors(points).astype(int)
    near = np.abs(v @ v.T - langid.DIM * np.eye(len(v)))
    assert near.max() < 0.2 * langid.DIM


#: Common words of languages in other scripts, two of them in one.
SCRIPTS = {
    "ru": "это как что был она они мой город вода дерево быстро сегодня человек говорить",
    "bg": "това как какво беше тя те моят град вода дърво бързо днес човек говоря",
    "el": "αυτό πώς ήταν αυτή μου πόλη νερό δέντρο γρήγορα σήμερα άνθρωπος μιλώ",
    "ar": "هذا كيف ماذا كان هي هم مدينة ماء شجرة بسرعة اليوم إنسان يتكلم",
    "zh": "这是 怎么 什么 城市 水 树木 快速 今天 人们 说话 学习 朋友",
}


def texts_of(seed, n):
    rng = np.random.default_rng(seed)
    return [(int(i), " ".join(rng.choice(SCRIPTS[lang].split(), 12)), lang) for i, lang in enumerate(rng.choice(list(SCRIPTS), n))]


def test_languages_of_other_scripts_equal_brute_force(spark):
    known, asked = texts_of(1, 120), texts_of(2, 60)
    model = langid.train(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    units = lambda v: v / np.linalg.norm(v)
    prototypes = {lang: units(sum(units(plain_vector(t)) for _, t, own in known if own == lang)) for lang in sorted(SCRIPTS)}
    langs, scores = langid.predict([t for _, t, _ in asked], model, langid.Seen())
    for (_, text, _), lang, s in zip(asked, langs, scores, strict=True):
        cosines = {own: float(units(plain_vector(text)) @ p) for own, p in prototypes.items()}
        assert lang == max(cosines, key=cosines.get) and abs(s - max(cosines.values())) < 1e-4
    assert np.mean([lang == own for (_, _, own), lang in zip(asked, langs, strict=True)]) > 0.95


def plain_grams(text):
    """The distinct buckets of a text's n-grams, gram by gram."""
    low, mask = (text or "").lower(), 0xFFFFFFFF
    found = set()
    for n in toxicity.SIZES:
        for i in range(len(low) - n + 1):
            h = ord(low[i])
            for c in low[i + 1 : i + n]:
                h = (h * 0x01000193 + ord(c)) & mask
            found.add((((h ^ h >> 15) * 0x9E3779B1) & mask) >> (32 - toxicity.BITS))
    return found


def test_toxicity_equals_brute_force(spark):
    """Ratios, features and scores of a small table worked out by loops; the fit minimises the stated loss."""
    rng = np.random.default_rng(3)
    words = "stone river light mill house zounder grumpf field".split()
    rows = [(int(i), " ".join(rng.choice(words[:5] + (words[5:7] if i % 3 == 0 else words[7:]), 9)), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df, rounds=400)
    grams = [plain_grams(t) for _, t, _ in rows]
    y = np.array([v for *_, v in rows])
    pos, neg = y.sum(), len(y) - y.sum()
    want = {}
    for b in set().union(*grams):
        has = np.array([b in g for g in grams])
        p, n = has[y == 1].sum(), has[y == 0].sum()
        r = np.log((p + 1) / (pos + 2)) - np.log((n + 1) / (neg + 2))
        if p + n >= 2 and abs(r) / np.sqrt(1 / (p + 1) + 1 / (n + 1)) >= 3:
            want[b] = r
    assert set(np.flatnonzero(model.slot).tolist()) == set(want)
    weight = {b: model.weight[model.slot[b]] for b in want}
    margin = np.array([model.bias + sum(weight[b] for b in g if b in want) for g in grams])
    np.testing.assert_allclose(toxicity.score_texts([t for _, t, _ in rows], model), 1 / (1 + np.exp(-margin)), rtol=1e-9)
    miss = 1 / (1 + np.exp(-margin)) - y
    slopes = [np.mean([m * want[b] for m, g in zip(miss, grams, strict=True) if b in g] + [0] * sum(b not in g for g in grams)) + 1e-3 * weight[b] / want[b] for b in want]
    assert np.abs(slopes).max() < 2e-3


def test_bounded_sample_is_stable(spark):
    df = spark.range(10_000)
    a, b = (sorted(r["id"] for r in common.bounded(d, "id", 500, 1).collect()) for d in (df, df.repartition(9)))
    assert a == b and 350 < len(a) < 650 and common.bounded(df, "id", 10_000, 1) is df


def test_the_sample_is_bounded_in_values_too(spark):
    """With room for few values, the rows with the least hashes are fitted alone; the result doesn't depend on partitions."""
    rows = [(i, "plain words of a stone mill " + ("zounder grumpf" if i % 3 == 0 else "quiet river"), int(i % 3 == 0)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole, part, again = (toxicity.train(d, d, max_values=n) for d, n in ((df, 24_000_000), (df, 900), (df.repartition(7), 900)))
    assert (whole.slot == part.slot).all() and not np.allclose(whole.weight, part.weight)
    assert np.array_equal(part.weight, again.weight) and part.bias == again.bias
    bad, good = toxicity.score_texts([rows[0][1], rows[1][1]], part)
    assert bad > 0.5 > good
    assert len(toxicity.train(df, df, max_values=1).weight) == len(whole.weight)
