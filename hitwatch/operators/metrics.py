"""Evaluation of scores: statistics, ROC, thresholds, histograms. Scores collapse to distinct values before any ordering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitwatch.operators.index import prefix_sum
from hitwatch.sources.scratch import Stored

#: Tables of groups whose keys take up to so many bytes are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
PERCENTILES = (0.5, 0.95, 0.99)


def stats_columns(score: str) -> list[Column]:
    """Mean, population deviation and extremes."""
    return [F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max")]


def percentiles(scores: DataFrame, column: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """(_b0, _b1, ..., p50, p95, p99): exact percentiles of each group's non-null scores, with linear interpolation.

    Scores collapse to distinct values with counts; running counts over all groups, less what lies before a
    group, place each value, and only values at the wanted ranks are kept. No group is ordered in one task.
    """
    names = [f"_b{i}" for i in range(len(by))]
    keys = [F.col(c).alias(n) for c, n in zip(by, names, strict=True)]
    counts = scores.select(*keys, F.col(column).cast("double").alias("_v")).filter("_v IS NOT NULL").groupBy(*names, "_v").agg(F.count("*").alias("_c"))
    running = prefix_sum(counts, [*map(F.col, names), F.col("_v")], {"_c": "_upto"})
    groups = Stored(running.groupBy(*names).agg(F.sum("_c").alias("_n"), F.min(F.col("_upto") - F.col("_c")).alias("_start")), "groups").df
    if names:
        wide = [F.coalesce(F.octet_length(F.col(n).cast("string")), F.lit(0)) for n in names]
        small = groups.agg(F.coalesce(F.sum(sum(wide, F.lit(32))), F.lit(0))).first()[0] <= BROADCAST_BYTES
        sides = groups.select(*[F.col(n).alias(f"_g{n}") for n in names], "_n", "_start")
        same = [F.col(n).eqNullSafe(F.col(f"_g{n}")) for n in names]
        placed = running.join(F.broadcast(sides) if small else sides, same)
    else:
        placed = running.crossJoin(F.broadcast(groups))
    last = F.col("_upto") - F.col("_start") - 1  # places in the group: last - _c + 1 to last
    wanted, cells = F.lit(False), []
    for i, p in enumerate(PERCENTILES):
        at = (F.col("_n") - 1) * F.lit(p)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: (k <= last) & (k > last - F.col("_c"))
        wanted = wanted | holds(low) | holds(high)
        cells += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_l{i}"), F.max(F.when(holds(high), F.col("_v"))).alias(f"_h{i}")]
    found = placed.filter(wanted).groupBy(*names).agg(F.first("_n").alias("_n"), *cells)
    made = []
    for i, p in enumerate(PERCENTILES):
        at, low, high = (F.col("_n") - 1) * F.lit(p), F.col(f"_l{i}"), F.col(f"_h{i}")
        between = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
        made.append(F.when(low == high, low).otherwise(between).alias(f"p{round(100 * p)}"))
    return found.select(*names, *made)


def with_percentiles(stats: DataFrame, scores: DataFrame, column: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """``stats``, a row or one for each group of ``scores``, with the percentiles beside."""
    cuts = percentiles(scores, column, by)
    if not by:
        return stats.crossJoin(F.broadcast(cuts))
    same = [stats[c].eqNullSafe(cuts[f"_b{i}"]) for i, c in enumerate(by)]
    return stats.join(cuts, same, "left").drop(*[f"_b{i}" for i in range(len(by))])


def score_stats(scores: DataFrame, column: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """A row of statistics, or one for each group; percentiles are exact at every size."""
    return with_percentiles(scores.groupBy(*by).agg(*stats_columns(column)), scores, column, by)


def rank_error(k: int) -> float:
    """How far from the wanted rank a quantile of a KLL sketch of size ``k`` is at most, as a share of all values, with 99 % confidence."""
    return 2.296 / k**0.9021


def sketch_stats(scores: DataFrame, column: str = "score", by: Sequence[str] = (), k: int = 1024) -> DataFrame:
    """(by..., n, mean, m2, min, max, sketch): statistics of non-null scores that merge over batches, in a row of some ``8 k`` bytes at most.

    For running statistics of streams; where all scores are at hand ``score_stats`` is exact.
    """
    x = F.col(column).cast("double")
    rows = scores.select(*by, x.alias("_x")).filter("_x IS NOT NULL")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_x").alias("mean"), (F.var_pop("_x") * F.count("*")).alias("m2"), F.min("_x").alias("min"), F.max("_x").alias("max"), F.kll_sketch_agg_double("_x", k).alias("sketch")).filter("n > 0")


def merge_stats(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The statistics of all parts of each group together, in the same columns."""
    whole = parts.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    met = parts.join(F.broadcast(whole), [parts[c].eqNullSafe(whole[c]) for c in by]).drop(*[whole[c] for c in by]) if by else parts.crossJoin(F.broadcast(whole))
    apart = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    return met.groupBy(*by).agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(apart).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch")).filter("n > 0")


def read_stats(stats: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes and percentiles of merged statistics; percentiles are values that occur, off by ``rank_error`` in rank at most."""
    others = [c for c in stats.columns if c not in ("m2", "sketch", "mean", "min", "max")]
    cuts = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{round(100 * p)}") for p in PERCENTILES]
    return stats.select(*others, "mean", F.sqrt(F.col("m2") / F.col("n")).alias("std"), "min", "max", *cuts)


def _cumulative(scores: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg, tp, fp, idx): counts of each distinct score and running ones from the largest score down."""
    y = F.col(label).cast("long")
    groups = scores.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")).withColumn("one", F.lit(1).cast("long"))
    return prefix_sum(groups, [F.col("score").desc()], {"pos": "tp", "neg": "fp", "one": "idx"}).drop("one")


def _totals(scores: DataFrame, label: str, score: str) -> DataFrame:
    y = F.col(label).cast("long")
    return scores.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(F.coalesce(F.sum(y), F.lit(0)).alias("_p"), F.coalesce(F.sum(1 - y), F.lit(0)).alias("_n"))


def roc_curve(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(idx, threshold, fpr, tpr) from (0, 0) at infinity on; inner points on a straight line are dropped."""
    points = _cumulative(scores, score, label)
    following = points.select((F.col("idx") - 1).alias("idx"), F.col("pos").alias("_pos"), F.col("neg").alias("_neg"))
    ends = points.agg(F.max("idx").alias("_last"))
    bent = (F.col("idx") == 1) | (F.col("idx") == F.col("_last")) | (F.col("pos") != F.col("_pos")) | (F.col("neg") != F.col("_neg"))
    kept = points.join(following, "idx", "left").crossJoin(F.broadcast(ends)).filter(bent)
    rated = kept.crossJoin(F.broadcast(_totals(scores, label, score))).select("idx", F.col("score").alias("threshold"), (F.col("fp") / F.col("_n")).alias("fpr"), (F.col("tp") / F.col("_p")).alias("tpr"))
    origin = scores.sparkSession.range(1).select(F.col("id").alias("idx"), F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(rated)


def roc_auc(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: area under the ROC curve, ties by trapezoids; NaN with a single class."""
    area = _cumulative(scores, score, label).agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)).alias("_a"))
    return area.crossJoin(_totals(scores, label, score)).select(F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_a") / F.col("_p") / F.col("_n")).otherwise(float("nan")).alias("auc"))


def threshold_at_fpr(scores: DataFrame, target: float = 0.01, score: str = "score", label: str = "label") -> DataFrame:
    """One row: the threshold of the curve whose false-positive rate is nearest to the target; the first one of equals."""
    return roc_curve(scores, score, label).agg(F.min_by("threshold", F.struct(F.abs(F.col("fpr") - target), F.col("idx"))).alias("threshold"))


def best_f1(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: precision, recall, F1 and threshold where F1 is largest, the lowest threshold of equals; NaN with a single class."""
    points = _cumulative(scores, score, label).crossJoin(F.broadcast(_totals(scores, label, score))).filter("_p > 0 AND _n > 0")
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("_p")
    rated = points.select("score", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + F.lit(1e-12))).alias("_f1"))
    best = rated.agg(F.max_by(F.struct("precision", "recall", "score"), F.struct(F.col("_f1"), -F.col("score"))).alias("_b"))
    p, r, nan = F.col("_b.precision"), F.col("_b.recall"), F.lit(float("nan"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    there = F.col("_b").isNotNull()
    return best.select(F.when(there, p).otherwise(nan).alias("precision"), F.when(there, r).otherwise(nan).alias("recall"), F.when(there, f1).otherwise(nan).alias("f1"), F.when(there, F.col("_b.score")).otherwise(nan).alias("threshold"))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _bin(x: Column, lo: Column, hi: Column, bins: Column | int) -> Column:
    b = F.lit(bins) if isinstance(bins, int) else bins
    return F.least(F.floor((x - lo) / (hi - lo) * b), b - 1).cast("long")


def score_histogram(scores: DataFrame, column: str = "score", bins: int = 100, threshold: float | None = None) -> DataFrame:
    """(bin, n, lo, hi, p95, p99, threshold) of finite scores over [min, max]; equal extremes are widened by a half. Empty bins have no row.

    The percentiles and the threshold (null if there is none) are the places of a plot's markers, the same in every row.
    """
    x = F.col(column).cast("double")
    sound = scores.filter(_finite(x)).select(x.alias("_x"))
    ends = sound.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    wide = ends.select(F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"), F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"))
    counts = sound.crossJoin(F.broadcast(wide)).groupBy(_bin(F.col("_x"), F.col("lo"), F.col("hi"), bins).alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(percentiles(sound, "_x").select("p95", "p99"))).withColumn("threshold", F.lit(threshold).cast("double"))


def feature_histograms(df: DataFrame, column: str, low: float, high: float, bins: int = 100) -> DataFrame:
    """(feature, bin, n, p95, p99): a histogram for each place of a vector; values out of bounds count in the outer bins. Not finite ones are left out."""
    values = df.select(F.posexplode(column).alias("feature", "x")).select(F.col("feature").cast("long").alias("feature"), F.col("x").cast("double").alias("x")).filter(_finite(F.col("x")))
    cuts = percentiles(values, "x", ["feature"]).select(F.col("_b0").alias("feature"), "p95", "p99")  # a row a place
    inside = F.least(F.greatest("x", F.lit(low)), F.lit(high))
    counts = values.groupBy("feature", _bin(inside, F.lit(low), F.lit(high), bins).alias("bin")).agg(F.count("*").alias("n"))
    return counts.join(cuts, "feature").select("feature", "bin", "n", "p95", "p99")


def histogram_spec(spec, index: int, names: Sequence[str] | None = None) -> dict:
    """Histogram settings of one feature: bins, and range, underflow and overflow where given.

    ``spec`` is None, a number of bins, a list of them by feature, or a mapping by feature index or variable name.
    """
    whole = lambda v: int(v) if isinstance(v, int | float) and int(v) > 0 else 10
    if isinstance(spec, Mapping):
        names_of = [index, str(index)] + ([names[index % len(names)]] if names else [])
        own = next((spec[k] for k in names_of if k in spec), None)
    elif isinstance(spec, Sequence) and not isinstance(spec, str):
        own = spec[index] if index < len(spec) else None
    else:
        own = spec
    if isinstance(own, int):
        return {"bins": whole(own)}
    if not isinstance(own, Mapping):
        return {"bins": 10}
    found = {"bins": whole(own.get("bins", 10))}
    if isinstance(own.get("range"), list | tuple) and len(own["range"]) == 2:
        found["range"] = tuple(map(float, own["range"]))
    return found | {k: float(own[k]) for k in ("underflow", "overflow") if own.get(k) is not None}


def hist2d(df: DataFrame, x: str, y: str, spec=None, names: Sequence[str] | None = None, features: int | None = None) -> DataFrame:
    """(feature, xb, yb, n): 2-D histograms of original against reconstructed values, a histogram for each feature.

    Bounds: the range given, else underflow and overflow (the data's where one is missing), else the data's
    extremes, equal ones widened. With underflow or overflow values are clipped, otherwise those outside are dropped.
    """
    pairs = df.select(F.posexplode(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y"))).alias("feature", "_v")).select(F.col("feature").cast("long").alias("feature"), F.col("_v.x").cast("double").alias("x"), F.col("_v.y").cast("double").alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    ends = pairs.groupBy("feature").agg(F.min(F.least("x", "y")).alias("_lo"), F.max(F.greatest("x", "y")).alias("_hi"))
    n = features if features is not None else int(ends.agg(F.coalesce(F.max("feature") + 1, F.lit(0))).first()[0])
    rows = []
    for i in range(n):
        s = histogram_spec(spec, i, names)
        rows.append((i, s["bins"], *s.get("range", (None, None)), s.get("underflow"), s.get("overflow")))
    table = df.sparkSession.createDataFrame(rows, "feature long, bins int, r_lo double, r_hi double, under double, over double")
    clipped = F.col("under").isNotNull() | F.col("over").isNotNull()
    flat = F.col("_hi") <= F.col("_lo")
    delta = F.when(F.col("_lo") == 0, 1.0).otherwise(F.greatest(F.abs("_lo") * 0.05, F.lit(1e-6)))
    finite = _finite(F.col("_lo")) & _finite(F.col("_hi"))
    lo = F.when(F.col("r_lo").isNotNull(), F.col("r_lo")).when(clipped, F.coalesce("under", "_lo")).when(~finite, -1.0).when(flat, F.col("_lo") - delta).otherwise(F.col("_lo"))
    hi = F.when(F.col("r_hi").isNotNull(), F.col("r_hi")).when(clipped, F.coalesce("over", "_hi")).when(~finite, 1.0).when(flat, F.col("_hi") + delta).otherwise(F.col("_hi"))
    bounds = ends.join(F.broadcast(table), "feature").select("feature", "bins", lo.alias("lo"), hi.alias("hi"), clipped.alias("clip"))
    clip = lambda c: F.when(F.col("clip"), F.greatest(F.least(F.col(c), F.col("hi")), F.col("lo"))).otherwise(F.col(c))
    placed = pairs.join(F.broadcast(bounds), "feature").withColumn("x", clip("x")).withColumn("y", clip("y"))
    inside = placed.filter(F.col("x").between(F.col("lo"), F.col("hi")) & F.col("y").between(F.col("lo"), F.col("hi")))
    return inside.groupBy("feature", _bin(F.col("x"), F.col("lo"), F.col("hi"), F.col("bins")).alias("xb"), _bin(F.col("y"), F.col("lo"), F.col("hi"), F.col("bins")).alias("yb")).agg(F.count("*").alias("n"))
