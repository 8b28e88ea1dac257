import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hitwatch.llm import simhash
from hitwatch.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    """Smallest id of each row's component, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [low.get(find(i)) for i in range(len(prints))]


def test_fingerprints(odd_docs):
    for r in odd_docs.collect():
        assert simhash.fingerprint(r["text"]) == plain_fingerprint(r["text"])
    text = "One two three TWO three four " * 30
    assert simhash.fingerprint(text, block=7) == plain_fingerprint(text)


def test_components_of_odd_documents(odd_docs, no_docs):
    rows = odd_docs.collect()
    want = plain_components([plain_fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    got = simhash.near_duplicates(odd_docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == sorted((str(r["doc_id"]), f"{plain_fingerprint(r['text']):016x}", c) for r, c in zip(rows, want, strict=True))
    assert simhash.near_duplicates(no_docs).count() == 0


def linked(spark, prints):
    df = spark.createDataFrame([(int(p),) for p in np.array(prints, "u8").view("i8")], "fp long")
    edges = simhash.links(df.repartition(3)).collect()
    return [(r["u"] & (1 << 64) - 1, r["v"] & (1 << 64) - 1) for r in edges]


@pytest.mark.parametrize("tile", [2048, 16])
def test_links_join_what_all_pairs_join(spark, monkeypatch, tile):
    """Chains, dense clusters and keys over the tile size, with all links between equal components and no other."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    prints = set(map(int, rng.integers(0, 1 << 64, 300, dtype="u8")))
    centre = int(rng.integers(0, 1 << 64, dtype="u8"))
    prints |= {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))}
    chain = int(rng.integers(0, 1 << 64, dtype="u8"))
    for i in range(20):
        chain ^= 0b111 << (3 * i)
        prints.add(chain)
    prints |= {(7 << 40) + i * 977 for i in range(120)}  # many share the upper bits
    prints |= {0, (1 << 64) - 1, 1}
    prints = sorted(prints)
    want = plain_components(prints, list(range(len(prints))))
    place = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in linked(spark, prints):
        assert 0 < (u ^ v).bit_count() <= 3 or want[place[u]] == want[place[v]]
        a, b = sorted((find(place[u]), find(place[v])))
        root[b] = a
    assert [find(i) for i in range(len(prints))] == want


def test_no_more_links_than_needed(spark):
    """A cluster of many texts does not give all its pairs."""
    rng = np.random.default_rng(3)
    prints = {(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 64, (1500, 2))}
    assert len(linked(spark, sorted(prints))) < 25 * len(prints)


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 64, 500, dtype="u8")
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype="u8")) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype="u8"))
    table = [simhash.distances(x, simhash.pivots()) for x in (a, b)]
    assert np.abs(table[0] - table[1]).max() <= 2


def test_star_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, k) for k in range(5001, 5100)] + [(9, 9), (7777, 7777)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = components(spark.createDataFrame(pairs, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in root)


def test_keep_first(odd_docs):
    rows = odd_docs.collect()
    want = plain_components([plain_fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r, c in zip(rows, want, strict=True) if r["doc_id"] == c)
    assert kept.filter(F.col("doc_id") == 8).count() == 2


def test_keep_first_judges_rows_by_their_own_text(spark):
    """An id carried by a clean text and by a copy of another document loses the copy only."""
    rows = [(3, "red blue green stone river"), (7, "red blue green stone river"), (7, "quite other words that no one else has"), (9, "a third text without any copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for repeats in (True, False):
        assert sorted(map(tuple, simhash.keep_first(docs, repeats=repeats).collect())) == sorted([rows[0], rows[2], rows[3]])


def test_one_row_of_each_component(spark, odd_docs):
    rows = odd_docs.collect()
    want = plain_components([plain_fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    kept = simhash.keep_first(odd_docs, repeats=False)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    null_only = [(None, "words of a text whose ids are all null", s, {"k": s}) for s in ("a", "b", None, "b")] * 50
    repeated = [(5, "some words that come again and again", None, None)] * 80 + [(5, "some words that come again and again", "z", None)] * 3
    docs = spark.createDataFrame(null_only + repeated, "doc_id long, text string, source string, more map<string,string>").repartition(5)
    for n in (1, 7):
        once = simhash.keep_first(docs.repartition(n), repeats=False).collect()
        assert sorted(r["text"] for r in once) == [repeated[0][1], null_only[0][1]]
        assert n == 1 or sorted(map(str, once)) == first
        first = sorted(map(str, once))


def test_pipeline_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as cp

    rows = [(1, "some words that come again and again", "en", "s", 36)] * 3 + [(None, "another text of seven words or so", "en", "s", 33)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["text"] for r in cp.one_of_each(spark, docs, "").collect()) == sorted({r[1] for r in rows})


def test_columns_named_as_helpers_are(spark):
    """A caller's columns with names of helpers, in any case, neither change the choice nor are they lost."""
    names = ["_hw_0", "_HW_1", "_id", "fp", "first", "stays", "n", "root", "owner", "run", "side"]
    text = "one two three four five six seven"
    rows = [(1, text, *range(11)), (2, text, *range(11)), (3, "other words that stand quite alone here", *range(11)), (1, text, *range(11))]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{c} int" for c in names]]))
    for repeats, want in ((False, [1, 3]), (True, [1, 1, 3])):
        got = simhash.keep_first(df, repeats=repeats)
        assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == want
        assert all(tuple(r)[2:] == tuple(range(11)) for r in got.collect())
