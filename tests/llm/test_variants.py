"""Spelling variants against all pairs of words."""

import random
from collections import Counter

import pytest

from hitwatch.llm import common, queries, variants
from tests.test_plans import plan_of


def one_edit(x, y):
    """Whether two words are exactly one inserted, deleted or replaced code point apart."""
    if len(x) < len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1 :] == y for i in range(len(x)))


def plain_groups(counts, factor=10):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    best = {w: min(o, key=lambda x: (-counts[x], x)) for w, o in near.items() if o}
    form = {w: o for w, o in best.items() if counts[o] >= factor * counts[w]}
    out = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return out


def words_of(seed, n, letters="abé\U00010348", lengths=(0, 9)):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))): rng.choice([2, 3, 25, 31, 400, 5_000]) for _ in range(n)}


@pytest.mark.parametrize("hot", [1, 40, variants.HOT])
def test_groups_equal_all_pairs(spark, hot):
    """Few letters make nearly all keys hot; with ``hot`` 1 every gap is split to the last."""
    counts = words_of(hot, 500)
    got = variants.groups(spark.createDataFrame(list(counts.items()), "word string, n long"), hot=hot)
    rows = got.collect()
    assert len(rows) == len(counts) and {tuple(r) for r in rows} == plain_groups(counts)


def test_one_hot_half(spark):
    """All words share their first half and most of the second."""
    rng = random.Random(3)
    counts = {"stone" + "".join(rng.sample("abcdefgh", 2)) + "er" + rng.choice("xyz"): rng.randrange(2, 300) for _ in range(300)} | {"stoneaber": 9_000}
    rows = variants.groups(spark.createDataFrame(list(counts.items()), "word string, n long"), hot=64).collect()
    assert {tuple(r) for r in rows} == plain_groups(counts)


def test_ways_from_form_to_form(spark):
    counts = {"stonemill": 2, "stonemills": 20, "tonemills": 200, "tonemill": 2_000, "tonmill": 20_000, "tonmil": 200_000, "alonewords": 7}
    rows = variants.groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {tuple(r) for r in rows} == plain_groups(counts)
    assert {r["root"] for r in rows if r["word"] != "alonewords"} == {"tonmil"}


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    nothing = spark.createDataFrame([(None, 3)], "word string, n long")
    assert variants.groups(nothing).count() == variants.groups(nothing.limit(0)).count() == 0
    assert variants.groups(variants.counted(queries.misspelt(no_docs))).count() == 0
    words = [r["word"] for r in queries.misspelt(odd_docs).collect()]
    counts = {w: n for w, n in Counter(words).items() if n >= 2}
    assert "license" in counts and {tuple(r) for r in variants.groups(variants.counted(queries.misspelt(odd_docs))).collect()} == plain_groups(counts)
    repeated = spark.createDataFrame([("x", 1, 2)] * 3 + [(None, 1, 2)], "word string, n int, key int")
    assert [tuple(r) for r in variants.counted(repeated).collect()] == [("x", 3)]
    with pytest.raises(ValueError, match="factor"):
        variants.groups(nothing, factor=1)


def test_runs_of_letters(spark):
    docs = spark.createDataFrame([(3, "ÀBCDEFG-abcdefgh1Straßenbahn ABCDEFG×÷"), (None, "abcdefg"), (4, None)], "doc_id long, text string")
    # × and ÷ lie between À and ÿ, so they count as the letters beside them
    found = {r["word"] for r in queries.misspelt(docs).collect()}
    assert {len(w) for w in found} <= {7, 8, 9, 10, 11} and all(w == w.translate({c: c + 32 for c in range(65, 91)}) for w in found)
    assert sum(one_edit(w, x) or w == x for w in found for x in ("Àbcdefg", "abcdefgh", "straßenbahn", "abcdefg×÷", "abcdefg")) >= 4


def test_pairs_are_joined_by_keys(spark):
    words = spark.createDataFrame(list(words_of(1, 50).items()), "word string, n long")
    plan = plan_of(variants.near_pairs(words))
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_query_equals_all_pairs_near_planted_words(spark):
    """Every rare word of the query is checked against all words of the table."""
    rows = queries.op12_variants(spark, "/root/testdata/sf0.001").collect()
    words = Counter(r["word"] for r in queries.misspelt(common.read(spark, "/root/testdata/sf0.001", "documents")).collect())
    assert {r["word"]: r["n"] for r in rows} == {w: n for w, n in words.items() if n >= 2}
    asked = [r for i, r in enumerate(sorted(rows, key=lambda r: r["word"])) if i % 10 == 0]
    for r in asked:
        assert r["n_near"] == sum(one_edit(r["word"], o["word"]) for o in rows)
