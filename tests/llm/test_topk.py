import numpy as np
import pytest

from hitwatch.llm import topk

MOST = (1 << 63) - 1


def whole(x, scale):
    wide = max(-float(MOST), min(float(MOST), float(x) * scale))
    return max(-MOST, min(MOST, int(np.floor(wide))))


def brute(rows, every, k, scale=256):
    sound = [(i, [whole(x, scale) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in sound if i % every == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q and len(w) == len(v)))
        out += [(q, r + 1, i, max(-MOST, min(MOST, -s))) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, kind="float", **kw):
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], f"vec_id long, embedding array<{kind}>, score int, _id int, bar int")
    return sorted(map(tuple, topk.search(df.repartition(5), **kw).collect()))


@pytest.mark.parametrize("dims", [16, 64, 70])
def test_equals_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(topk, "PACK_ROWS", 7)
    monkeypatch.setattr(topk, "GROUP_PACKS", 2)
    rng = np.random.default_rng(dims)
    rows = [(int(i), np.float32(rng.normal(0, 0.2, dims)).tolist()) for i in range(600)]
    assert found(spark, rows, every=20) == brute(rows, 20, 5)


def test_lengths_that_differ_widely(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(0, 1, 8) * 10.0 ** rng.integers(-3, 4)).tolist()) for i in range(800)]
    assert found(spark, rows, "double", every=20) == brute(rows, 20, 5)


def test_odd_rows(spark):
    same = [0.5] * 4
    rows = [(i, same) for i in range(30)] + [(0, same), (7, same), (None, same), (31, None), (32, []), (40, [0.1, None, 0.2, 0.3]), (60, [float("nan")] * 4), (80, [float("inf")] * 4), (100, [0.0] * 4), (120, [0.25, 0.5]), (121, [-0.25, 0.5]), (-20, [-0.5] * 4)]
    assert found(spark, rows, every=20, k=3) == brute(rows, 20, 3)


def test_few_candidates_and_empty_table(spark):
    assert found(spark, [(0, [1.0]), (1, [2.0])], every=50) == [(0, 1, 1, 256 * 512)]
    assert found(spark, [(0, [1.0])], every=50) == [] == found(spark, [], every=50)


def test_large_components(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.normal(0, 1, 4) * 1e7).tolist()) for i in range(300)] + [(400, [1e30, -1e30, 0.0, 0.0]), (401, [1e300, 1.0, 1.0, 1.0]), (402, [-1e30, 1e30, 5.0, 5.0])]
    assert found(spark, rows, "double", every=20) == brute(rows, 20, 5)


def test_one_vector_in_a_third_of_the_rows(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(0, 0.2, 8).tolist()
    rows = [(int(i), hot if i % 3 == 0 else rng.normal(0, 0.2, 8).tolist()) for i in range(900)] + [(0, hot)] * 9
    assert found(spark, rows, "double", every=60) == brute(rows, 60, 5)


def test_rows_of_one_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [0.25, 0.5])]
    assert found(spark, rows, every=50, k=2) == brute(rows, 50, 2)


def test_bounds_hold_and_most_pairs_are_left_early(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), np.float32(rng.normal(0, 0.125, 64)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("id", "transform(v, x -> floor(256 * x)) AS v", "64 AS dim")
    base = df.selectExpr("id", "v", "dim", "xxhash64(v) AS h")
    index = topk.Index(base, 5)
    queries = topk.query_rows(base.filter("id % 20 = 0").selectExpr("dim", "id", "h AS mark", "v"), 1)
    one, near, two, nearer = topk._bounds(1)
    exact = topk._exact(topk.F.col("q_v"), topk.F.col("v"))["score"]
    got = index.met(queries, index.rows, 20).select((exact - one).alias("a"), near.alias("b")).selectExpr("abs(a) <= b AS good").filter("NOT good")
    assert got.count() == 0
    later = index.met(queries, index.rows, 20).select((exact - two).alias("a"), nearer.alias("b"), near.alias("c")).selectExpr("count(*) AS n", "sum(int(abs(a) > b)) AS bad", "avg(b / c) AS tighter").first()
    assert later["n"] == 20 * 400 - 20 and later["bad"] == 0 and later["tighter"] < 0.4


def test_plan_is_native_and_has_no_cross_join(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    plan = topk.search(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Cartesian", "NestedLoop", "Existing"))


def met_pairs(spark, rows, every=20, k=5):
    """How many pairs of queries and distinct vectors are met once the bars are known, and how many there are."""
    df = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("id", "transform(v, x -> floor(256 * x)) AS v", "size(v) AS dim").selectExpr("id", "v", "dim", "xxhash64(v) AS h")
    index = topk.Index(df, k)
    asked = df.filter(f"id % {every} = 0").selectExpr("dim", "id", "h AS mark", "v").distinct()
    barred, n = topk.with_bars(index, asked, k)
    return index.met(barred, index.rows, n).count(), sum(i % every == 0 for i, _ in rows) * (len(rows) - 1)


def test_short_vectors_are_never_met(spark):
    """Of vectors whose lengths span six powers of ten, only those long enough for the bars are scored; of equal ones all are."""
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(1_000, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    even = [(i, (v * 100).tolist()) for i, v in enumerate(unit)]
    uneven = [(i, (v * 10.0 ** rng.uniform(-2, 4)).tolist()) for i, v in enumerate(unit)]
    (met, of), (met_even, of_even) = met_pairs(spark, uneven), met_pairs(spark, even)
    assert met < 0.2 * of and met_even == of_even
    assert found(spark, uneven, "double", every=20) == brute(uneven, 20, 5)
    # scores below 0 alone: no bar is above 0, so nothing is proved out
    negative = [(0, [-1.0, -1.0])] + [(i, [float(i), 1.0]) for i in range(1, 40)]
    assert found(spark, negative, "double", every=50) == brute(negative, 50, 5)
