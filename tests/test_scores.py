import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitwatch.operators import ablation, geometry, metrics, predict, score, splits


def keyed(spark, keys, name="v"):
    return spark.createDataFrame([(1, 0, k, float(k)) for k in keys], f"run long, subrun long, evt long, {name} double")


@pytest.mark.parametrize(("left", "right", "want"), [(range(10), range(10), 10), (range(10), range(5, 15), 5), (range(10), range(100, 110), 0)])
def test_event_join(spark, left, right, want):
    got = score.join_events(keyed(spark, left), keyed(spark, right, "w")).collect()
    assert len(got) == want and all(r["v"] == r["w"] for r in got)


def test_event_join_ignores_null_keys_and_multiplies_repeats(spark):
    left, right = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (1, 0, None)], "run long, subrun long, evt long"), spark.createDataFrame([(1, 0, 1), (1, 0, None)], "run long, subrun long, evt long")
    assert score.join_events(left, right).count() == 2


def test_multi_branch(spark):
    one = lambda v: spark.createDataFrame([(1, 1, 1, v)], "run long, subrun long, evt long, score double")
    got = score.multi_branch({"tpc": one(0.1), "pmt": one(0.3), "window": one(None)}, {"tpc": 0.25, "pmt": 0.25, "window": None}).first()
    assert got["max_score"] == 0.3 and got["alert"]
    assert not score.multi_branch({"tpc": one(0.25)}, {"tpc": 0.25}).first()["alert"]


def test_flag_needs_a_threshold():
    with pytest.raises(ValueError):
        score.flag(F.lit(1.0), None)


def test_positions_must_match(spark):
    a, b = spark.range(3), spark.range(3)
    assert score.pair_by_position(a, b, "id").count() == 3
    with pytest.raises(ValueError):
        score.pair_by_position(a, spark.range(4), "id")


def test_roc_of_four(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "score double, label int")
    assert metrics.roc_auc(df).first()["auc"] == 0.75
    curve = metrics.roc_curve(df).orderBy("idx").collect()
    assert (curve[0]["fpr"], curve[0]["tpr"]) == (0, 0) and math.isinf(curve[0]["threshold"])
    assert (curve[-1]["fpr"], curve[-1]["tpr"]) == (1, 1)


def test_single_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0)], "score double, label int")
    assert math.isnan(metrics.roc_auc(df).first()["auc"])
    assert all(math.isnan(x) for x in metrics.best_f1(df).first())


def test_percentiles(spark):
    got = metrics.score_stats(spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "score double")).first()
    assert [round(got[p], 6) for p in ("p50", "p95", "p99")] == [2.5, 8.95, 9.79]


def test_percentiles_stay_exact_in_large_tables(spark, monkeypatch):
    """No size switches to approximate percentiles, and no group's values are gathered by one aggregate."""
    monkeypatch.setattr(metrics, "EXACT_ROWS", 3, raising=False)
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=501), "b": rng.integers(0, 4, 1000).astype("f8"), None: rng.normal(size=2), "one": np.array([5.0])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, score double").repartition(7)
    every = np.concatenate(list(groups.values()))
    got = metrics.score_stats(df)
    assert got.columns == ["mean", "std", "min", "max", "p50", "p95", "p99"]
    np.testing.assert_allclose(got.first()[4:], np.percentile(every, [50, 95, 99]), rtol=1e-12)
    by = {r["g"]: r for r in metrics.score_stats(df, by=["g"]).collect()}
    assert set(by) == {*groups, "none"} and by["none"][1:] == (None,) * 7
    for g, v in groups.items():
        np.testing.assert_allclose(by[g][1:], [v.mean(), v.std(), v.min(), v.max(), *np.percentile(v, [50, 95, 99])], rtol=1e-9)
    assert tuple(metrics.score_stats(df.limit(0)).first()) == (None,) * 7
    for made in (metrics.score_stats(df, by=["g"]), ablation.summary(df.withColumnRenamed("g", "variant"), 0.5)):
        assert "percentile" not in made._jdf.queryExecution().executedPlan().toString()


def test_fraction_includes_the_threshold_and_is_nan_without_scores(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "score double")
    assert score.anomaly_fraction(df, 2.0).first()[0] == 0.5
    assert math.isnan(score.anomaly_fraction(df.limit(0), 2.0).first()[0])


def test_histogram_ignores_what_is_not_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (1.0,)], "score double")
    got = metrics.score_histogram(df, bins=4).collect()
    assert [(r["bin"], r["n"]) for r in got] == [(2, 2)]


def test_histogram_spec():
    names = ["a", "b"]
    assert metrics.histogram_spec(None, 0) == {"bins": 10}
    assert metrics.histogram_spec(7, 3) == {"bins": 7}
    assert metrics.histogram_spec([4, 5], 1) == {"bins": 5} and metrics.histogram_spec([4, 5], 2) == {"bins": 10}
    spec = {"a": 20, "b": {"bins": 6, "underflow": -1}, 3: {"range": [0, 2]}}
    assert metrics.histogram_spec(spec, 2, names) == {"bins": 20}
    assert metrics.histogram_spec(spec, 1, names) == {"bins": 6, "underflow": -1.0}
    assert metrics.histogram_spec(spec, 3, names) == {"bins": 10, "range": (0.0, 2.0)}
    assert metrics.histogram_spec({"c": 3}, 0, names) == {"bins": 10}


def test_variants():
    assert [v[0] for v in ablation.variants(["a", "b", "c", "a"])] == ["baseline_all", "minus_a", "minus_b", "minus_c"]
    assert ablation.variants(["x.y"], baseline=False) == [("minus_x_y", [], "x.y")]


def test_variants_need_a_branch():
    with pytest.raises(ValueError, match="branch"):
        ablation.variants([])


def test_wire_name_parts_are_read_by_themselves(spark):
    from hitwatch.functions.keys import wire_name

    names = ["posWire_U_1_b", "posWire_Q_5", "posWire_V_x", "posWire_y_7", "posWire_U", "wire_U_1", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(wire_name(F.col("n")).alias("w")).select("w.*").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1), (None, 5, 5), (1, None, None), (2, 7, 7), (None, None, None), (None, None, None), (None, None, None)]


def test_weighted_loss(spark):
    assert score.weighted_mean_loss(spark.createDataFrame([(1.0, 1), (3.0, 3)], "loss double, n long")).first()[0] == 2.5


def test_wire_names(spark):
    rows = [('<position name="posWire_U_1" x="1" y="2" z="3"/>',), ('<position name="posWire_Q_x" x="1" y="2" z="3"/>',), ('<position name="other" x="1" y="2" z="3"/>',)]
    got = geometry.parse_positions(spark.createDataFrame(rows, "xml string"), "xml").collect()
    assert [(r["name"], r["x"], r["plane"], r["wire"], r["channel"]) for r in got] == [("posWire_U_1", 1.0, 0, 1, 1), ("posWire_Q_x", 1.0, None, None, None), ("other", 1.0, None, None, None)]


def test_positions_of_a_file(spark, tmp_path):
    path = tmp_path / "geo.xml"
    path.write_text('<gdml><define><a><position name="posWire_V_3" x="1.5" y="0" z="-1"/></a><position name="zero" x="0" y="0" z="0"/></define></gdml>')
    got = geometry.read_positions(spark, str(path), prefix="posWire")
    assert [tuple(r) for r in got.collect()] == [("posWire_V_3", 1.5, 0.0, -1.0, 1, 3, 3)]
    twice = got.withColumn("line", F.lit(1)).union(got.withColumn("x", F.lit(9.0)).withColumn("line", F.lit(2)))
    assert geometry.position_lookup(twice, "line").first()["x"] == 9.0
    assert geometry.add_positions(spark.range(5).withColumnRenamed("id", "channel"), got).filter("x IS NOT NULL").count() == 1


def test_split_sizes(spark):
    assert [splits.validation_size(n, f) for n, f in ((10, 0.1), (10, 0), (1, 0.5), (10, 1), (10, 0.01), (25, 0.1))] == [1, 0, 0, 0, 0, 2]
    df = spark.range(50)
    got = splits.validation_split(df, "id", 0.2)
    assert got.filter("is_validation").count() == 10
    assert got.orderBy("id").collect() == splits.validation_split(df.repartition(3), "id", 0.2).orderBy("id").collect()


def test_repeated_good_runs_do_not_leak(spark):
    files = spark.createDataFrame([(f"/d/DQM_{i}.root", i) for i in range(10)] + [("/d/DQM_0.root", 0), ("/d/x.txt", 1)], "path string, run long")
    runs = spark.createDataFrame([(i, i < 8) for i in range(10)] + [(0, True)], "run long, good boolean")
    got = splits.train_test_files(splits.data_files(files), runs).collect()
    assert len(got) == len({r["path"] for r in got}) == 10
    assert sum(r["split"] == "train" for r in got) == 6 and sum(r["label"] for r in got) == 2


def test_bootstrap_is_exact(spark):
    got = splits.bootstrap(spark.range(10), "id", 37, seed=1).collect()
    assert len(got) == 37 and {r["id"] for r in got} <= set(range(10))
    assert splits.bootstrap(spark.range(0), "id", 5).count() == 0


def test_network_matches_numpy(spark):
    net = predict.DenseReLU.seeded([4, 3, 4], 1)
    x = np.arange(12.0).reshape(3, 4)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(3, None)], "i int, x array<double>")
    got = {r["i"]: r["score"] for r in predict.score_vectors(df, "x", net).collect()}
    assert got[3] is None and np.allclose([got[i] for i in range(3)], ((net(x) - x) ** 2).mean(1))
    with pytest.raises(ValueError):
        predict.check_model("rnn")


def test_ragged_rows_are_scored_by_row(spark):
    from hitwatch.functions.vectors import pad

    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0])], "i int, x array<double>").withColumn("x", pad(F.col("x"), 4))
    mean = df.withColumn("score", F.aggregate("x", F.lit(0.0), lambda a, b: a + b) / F.size("x")).orderBy("i").collect()
    assert [r["score"] for r in mean] == [1.5, 2.25]


def test_first_rows_and_urls(spark):
    df = spark.createDataFrame([(2, 1), (1, 9), (1, 2)], "file_idx int, entry int")
    assert [tuple(r) for r in splits.first_rows(df, 2, "file_idx", "entry").collect()] == [(1, 2), (1, 9)]
    urls = spark.createDataFrame([("/pnfs/a.root",), ("/data/b.root",)], "path string")
    assert [r[0] for r in urls.select(splits.rewrite_url(F.col("path"), "/pnfs/", "root://door/")).collect()] == ["root://door/a.root", "/data/b.root"]


def test_labels_and_pairs(spark):
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "i int, x array<double>")
    y = spark.createDataFrame([(2, 1)], "i int, label int")
    assert [tuple(r) for r in score.with_labels(v, y, "i").orderBy("i").collect()] == [(1, [1.0], None), (2, [2.0], 1)]


def test_helper_columns_never_meet_a_callers(spark):
    from hitwatch.functions.names import fresh
    from hitwatch.operators import index

    helpers = ["_at", "_part", "_pos", "_before", "_before_v", "_local_v", "_place", "_PART"]
    assert fresh(helpers, "_at", "_part", "new") == ["_at_", "_part_", "new"]
    names = [h for h in helpers if h != "_PART"]
    df = spark.createDataFrame([(i, *[i * 10 + j for j in range(len(names))], 1) for i in range(6)], ", ".join([*[f"{c} long" for c in ["i", *names]], "v long"])).repartition(3)
    kept = [f"{c}" for c in df.columns]
    got = index.prefix_sum(df, [F.col("i").desc()], {"v": "total"})
    assert got.columns == [*kept, "total"] and sorted((r["i"], r["total"], r["_part"], r["_local_v"]) for r in got.collect()) == [(i, 6 - i, i * 10 + 1, i * 10 + 5) for i in range(6)]
    placed = index.with_global_index(df, [F.col("i")], "at")
    assert placed.columns == [*kept, "at"] and all(r["at"] == r["i"] and r["_pos"] == r["i"] * 10 + 2 for r in placed.collect())
    pairs = score.pair_by_position(df, df.select("i", "_place"), "i").collect()
    assert len(pairs) == 6 and all(r["_place"] == r["right__place"] == r["i"] * 10 + 6 for r in pairs)


def test_sketches_merge_over_batches(spark):
    """Statistics of parts, merged by group, against the exact ones of all rows; groups of one, of ties, null keys and null scores among them."""
    rng = np.random.default_rng(9)
    rows = [("a", float(v)) for v in rng.lognormal(size=20_000)] + [("b", 3.0)] * 50 + [("c", 7.5), (None, 1.0), (None, 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, score double")
    parts = [metrics.sketch_stats(df.filter(F.pmod(F.xxhash64("g", "score"), F.lit(5)) == i), by=["g"], k=512) for i in range(5)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    twice = metrics.merge_stats(metrics.merge_stats(whole.filter("n % 2 = 0"), ["g"]).union(whole.filter("n % 2 = 1")), ["g"])
    got = {r["g"]: r for r in metrics.read_stats(twice).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        own = np.sort([v for k, v in rows if k == g and v is not None])
        assert r["n"] == len(own) and np.allclose([r["mean"], r["std"], r["min"], r["max"]], [own.mean(), own.std(), own[0], own[-1]])
        for p in metrics.PERCENTILES:
            value = r[f"p{round(100 * p)}"]
            low, high = np.searchsorted(own, value, side="left") / len(own), np.searchsorted(own, value, side="right") / len(own)
            assert value in own and low <= p + metrics.rank_error(512) and high >= p - metrics.rank_error(512)
    assert metrics.read_stats(metrics.merge_stats(metrics.sketch_stats(df.limit(0)))).count() == 0


def test_score_record_keeps_settings_and_names(spark, tmp_path):
    from hitwatch.sources import files

    one = spark.createDataFrame([(0, 1.5)], "window_id long, score_mean double")
    nodes = spark.createDataFrame([(0, 3, 1.5)], "window_id long, channel long, mse double")
    files.save_scores(one, nodes, f"{tmp_path}/a", {"threshold": 0.5, "features": "sum,cnt"}, spark.createDataFrame([(1, "x.root")], "file_idx int, path string"))
    files.save_scores(one, nodes, f"{tmp_path}/b")
    settings, names = files.load_score_record(spark, f"{tmp_path}/a")
    assert settings == {"threshold": "0.5", "features": "sum,cnt"} and [tuple(r) for r in names.collect()] == [(1, "x.root")]
    settings, names = files.load_score_record(spark, f"{tmp_path}/b")
    assert settings == {} and names.count() == 0 and [d.count() for d in files.load_scores(spark, f"{tmp_path}/b")] == [1, 1]


def test_histogram_markers_and_ablation_branches(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(float("inf"),)], "score double")
    rows = metrics.score_histogram(df, bins=10, threshold=42.0).collect()
    assert sum(r["n"] for r in rows) == 101 and {(r["p95"], r["p99"], r["threshold"]) for r in rows} == {(95.0, 99.0, 42.0)}
    assert {r["threshold"] for r in metrics.score_histogram(df).collect()} == {None}
    scores = spark.createDataFrame([("baseline_all", 1.0, 4.0), ("minus_a_b", 3.0, 8.0), ("minus_a_b", 5.0, 2.0)], "variant string, score double, loss double")
    got = {r["variant"]: r for r in ablation.summary(scores, 3.0, ["a.b", "c"], loss="loss").collect()}
    assert [got["minus_a_b"][c] for c in ("eval_loss", "removed", "branches", "n_branches", "fraction")] == [5.0, "a.b", "c", 1, 1.0]
    assert [got["baseline_all"][c] for c in ("eval_loss", "removed", "branches", "n_branches")] == [4.0, "", "a.b;c", 2]
