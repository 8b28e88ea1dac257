import hashlib
import math
from collections import Counter

import pytest

from hitwatch.llm import mixing


def uniform(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / (1 << 52)


def copies(doc_id, rate, seed=2024):
    total, parts = 0, math.ceil(rate / mixing.PART)
    for part in range(1, parts + 1):
        u, mean, k = uniform(f"{seed}|{part}|{'' if doc_id is None else doc_id}"), rate / parts, 0
        p = c = math.exp(-mean)
        while c <= u and k < mean + 12 * mean**0.5 + 40:
            k += 1
            p *= mean / k
            c += p
        total += k
    return total


def test_copies_equal_a_plain_inversion(odd_docs):
    targets = {"s0": 1.0, "s1": 3.0, None: 2.0}
    rows = [(r["doc_id"], r["source"]) for r in odd_docs.collect()]
    sizes = Counter(s for _, s in rows)
    want = Counter()
    for doc_id, source in rows:
        if source in targets:
            want[doc_id] += copies(doc_id, targets[source] / 6 * len(rows) / sizes[source])
    got = Counter(r["doc_id"] for r in mixing.mix(odd_docs, targets).collect())
    assert got == +want


def test_large_rates_and_salted_sources(odd_docs, monkeypatch):
    rows = [(r["doc_id"], r["source"]) for r in odd_docs.collect()]
    n = sum(s == "s2" for _, s in rows)
    want = Counter()
    for doc_id, source in rows:
        if source == "s2":
            want[doc_id] += copies(doc_id, 1300.0)
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    got = Counter(r["doc_id"] for r in mixing.mix(odd_docs, {"s2": 1.0}, total=1300 * n).select("doc_id").collect())
    assert got == want and abs(sum(got.values()) / (1300 * n) - 1) < 0.02


def test_shares_reach_the_targets(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5) END AS source")
    got = Counter(r["source"] for r in mixing.mix(df, {"hot": 1, "s0": 1, "s1": 2}).select("source").collect())
    total = sum(got.values())
    assert abs(total / 20_000 - 1) < 0.03
    assert all(abs(got[s] / total - w / 4) < 0.02 for s, w in {"hot": 1, "s0": 1, "s1": 2}.items()) and set(got) == {"hot", "s0", "s1"}


def test_rows_keep_their_columns_and_partitions_do_not_matter(odd_docs):
    a, b = mixing.mix(odd_docs), mixing.mix(odd_docs.repartition(7))
    assert a.columns == [*odd_docs.columns, "n_copies", "copy_no", "mix_key"]
    key = lambda r: (r["mix_key"], str(r))
    assert sorted(a.collect(), key=key) == sorted(b.collect(), key=key)


def test_edges(odd_docs, no_docs):
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix(odd_docs, {"nowhere": 1.0}).count() == 0
    assert mixing.mix(odd_docs, {"s0": 0.0, "s1": 0.0}).count() == 0
    with pytest.raises(ValueError, match="mix_key"):
        mixing.mix(odd_docs.withColumnRenamed("score", "mix_key"))


def test_native(odd_docs):
    assert "Python" not in mixing.mix(odd_docs)._jdf.queryExecution().executedPlan().toString()


def test_columns_named_as_helpers_are(spark, monkeypatch):
    names = ["_hw_source", "_hw_parts", "_hw_cdf", "_hw_salt", "_hw_own", "_hw_n", "_hw_w", "_hw_rate", "_hw_target"]
    df = spark.createDataFrame([(i, f"s{i % 3}", *range(9)) for i in range(60)], ", ".join(["doc_id long", "source string", *[f"{c} int" for c in names]]))
    plain = sorted((r["doc_id"], r["copy_no"]) for r in mixing.mix(df.select("doc_id", "source")).collect())
    for limit in (mixing.BROADCAST_BYTES, 0):
        monkeypatch.setattr(mixing, "BROADCAST_BYTES", limit)
        got = mixing.mix(df).collect()
        assert sorted((r["doc_id"], r["copy_no"]) for r in got) == plain and all(tuple(r)[2:11] == tuple(range(9)) for r in got)
