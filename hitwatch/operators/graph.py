"""Window graphs: history assembly, active channels, node vectors, band edges, neighbour sums. All long and sparse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitwatch.functions.vectors import bound
from hitwatch.operators.windows import DEFAULT_FEATURES, Layout, check_features


def assemble(frames: DataFrame, layout: Layout, n_windows: int) -> DataFrame:
    """(window_id, w, channel, bin, features): every frame under each window that uses it, w = 0.. history-1 past, w = history target.

    The windows follow from the frame's start by arithmetic, so nothing is joined or shuffled.
    """
    places = F.filter(F.array(*[F.struct(F.lit(w).cast("long").alias("w"), (F.col("frame_start") - w * layout.size).alias("at")) for w in range(layout.history + 1)]), lambda p: (p["at"] % layout.stride == 0) & p["at"].between(0, (n_windows - 1) * layout.stride))
    return frames.withColumn("_p", F.explode(places)).select((F.col("_p.at") / layout.stride).cast("long").alias("window_id"), F.col("_p.w").alias("w"), *[c for c in frames.columns if c != "frame_start"])


def feature_size(features: Sequence[str]) -> Column:
    """Sum of the features' absolute values."""
    out = F.lit(0.0)
    for f in features:
        out = out + F.abs(F.col(f))
    return out


def active_nodes(assembled: DataFrame, layout: Layout, n_windows: int, features: Sequence[str] = DEFAULT_FEATURES, least: float = 1e-6) -> DataFrame:
    """(window_id, channel, node_rank, rank_index) of channels with past activity; channel 0 where there is none.

    Rows are dealt by window once: sums by channel, ranks and counts all happen there. Each window gets one spare
    row that sorts after its active channels and stays only if there are none.
    """
    size = feature_size(check_features(features))
    dealt = assembled.filter(F.col("w") < layout.history).select("window_id", "channel", size.alias("_a")).repartition("window_id")
    active = dealt.groupBy("window_id", "channel").agg(F.sum("_a").alias("_a")).filter(F.col("_a") > least).select("window_id", "channel", F.lit(1).alias("_real"))
    spare = assembled.sparkSession.range(n_windows).select(F.col("id").alias("window_id"), F.lit(0).cast("long").alias("channel"), F.lit(0).alias("_real"))
    w = W.partitionBy("window_id")
    ranked = active.union(spare).select("*", (F.row_number().over(w.orderBy(F.desc("_real"), "channel")) - 1).cast("long").alias("node_rank"), F.sum("_real").over(w).alias("_m"))
    return ranked.filter("_real = 1 OR _m = 0").select("window_id", "channel", "node_rank", (F.col("node_rank") / F.greatest(F.col("_m") - 1, F.lit(1))).alias("rank_index"))


def collate_nodes(assembled: DataFrame, n_channels: int, features: Sequence[str] = DEFAULT_FEATURES, max_nodes: int | None = None) -> DataFrame:
    """(window_id, channel, node_rank, channel_index): activity of past or target, lowest channels first, at most ``max_nodes``."""
    active = assembled.groupBy("window_id", "channel").agg(F.sum(feature_size(check_features(features))).alias("_a")).filter("_a > 0")
    ranked = active.withColumn("node_rank", (F.row_number().over(W.partitionBy("window_id").orderBy("channel")) - 1).cast("long"))
    kept = ranked if max_nodes is None else ranked.filter(F.col("node_rank") < max_nodes)
    return kept.select("window_id", "channel", "node_rank", channel_index(F.col("channel"), n_channels).alias("channel_index"))


def channel_index(channel: Column, n_channels: int) -> Column:
    return channel / F.lit(max(1, n_channels - 1))


def node_cells(assembled: DataFrame, layout: Layout, n_windows: int, features: Sequence[str] = DEFAULT_FEATURES, least: float = 1e-6) -> DataFrame:
    """(window_id, channel, node_rank, rank_index, cells): the active nodes with their cells, at most one a frame and bin.

    A cell is (w, bin, values). Rows are dealt by window once: activity, cells and ranks all come from that deal. As in
    ``active_nodes`` a spare row stands in for windows without activity; it takes the cells of channel 0, where there are any.
    """
    values = F.array(*[F.col(f).cast("double") for f in check_features(features)])
    activity = F.when(F.col("w") < layout.history, feature_size(features)).otherwise(0.0)
    dealt = assembled.select("window_id", "channel", activity.alias("_a"), F.struct("w", "bin", values.alias("values")).alias("_c")).repartition("window_id")
    found = dealt.groupBy("window_id", "channel").agg((F.sum("_a") > least).cast("int").alias("_real"), F.collect_list("_c").alias("cells")).filter("_real = 1 OR channel = 0")
    spare = assembled.sparkSession.range(n_windows).select(F.col("id").alias("window_id"), F.lit(0).cast("long").alias("channel"), F.lit(0).alias("_real"), F.array().cast(found.schema["cells"].dataType).alias("cells"))
    w = W.partitionBy("window_id")
    ranked = found.union(spare).select("*", F.row_number().over(w.orderBy(F.desc("_real"), "channel", F.size("cells").desc())).alias("_r"), F.sum("_real").over(w).alias("_m"))
    kept = ranked.filter("_real = 1 OR (_m = 0 AND _r = 1)").withColumn("node_rank", (F.col("_r") - 1).cast("long"))
    return kept.select("window_id", "channel", "node_rank", (F.col("node_rank") / F.greatest(F.col("_m") - 1, F.lit(1))).alias("rank_index"), "cells")


def node_entries(layout: Layout, n_features: int = len(DEFAULT_FEATURES), target: bool = False) -> Column:
    """Array of (slot, value) of a row of ``node_cells``, non-zero values only: slot 0 is the rank index, then frames, bins, features; or the target's."""
    of = (lambda c: c["w"] == layout.history) if target else (lambda c: c["w"] < layout.history)
    base = (lambda c: c["bin"] * n_features) if target else (lambda c: 1 + (c["w"] * layout.bins + c["bin"]) * n_features)
    each = F.flatten(F.transform(F.filter("cells", of), lambda c: F.transform(c["values"], lambda v, i: F.struct((base(c) + i).cast("long").alias("slot"), v.alias("value")))))
    own = F.array(F.struct(F.lit(0).cast("long").alias("slot"), F.col("rank_index").cast("double").alias("value")))
    kept = F.filter(each, lambda s: s["value"] != 0)
    return kept if target else F.concat(own, kept)


def node_slots(cells: DataFrame, layout: Layout, n_features: int = len(DEFAULT_FEATURES), target: bool = False) -> DataFrame:
    """(window_id, channel, slot, value) of ``node_cells``: their entries, a row each."""
    return cells.select("window_id", "channel", F.inline(node_entries(layout, n_features, target)))


def node_vectors(cells: DataFrame, layout: Layout, n_features: int = len(DEFAULT_FEATURES)) -> DataFrame:
    """(window_id, channel, node_rank, x, y) of ``node_cells``: dense vectors, zeros where there were no hits."""
    none = F.array(*[F.lit(0.0)] * n_features)

    def dense(first: int, last: int) -> Column:
        """Values of frames ``first`` to ``last``, bin by bin; absent cells are zeros."""
        places = F.sequence(F.lit(first * layout.bins), F.lit((last + 1) * layout.bins - 1))
        by_place = F.map_from_entries(F.transform("cells", lambda c: F.struct((c["w"] * layout.bins + c["bin"]).cast("int"), c["values"])))
        return bound(by_place, lambda m: F.flatten(F.transform(places, lambda i: F.coalesce(F.try_element_at(m, i), none))))

    past = dense(0, layout.history - 1) if layout.history else F.array().cast("array<double>")
    x = F.concat(F.array(F.col("rank_index").cast("double")), past)
    return cells.select("window_id", "channel", "node_rank", x.alias("x"), dense(layout.history, layout.history).alias("y"))


def band_edges(spark: SparkSession, n: int, radius: int = 4) -> DataFrame:
    """(src, dst) of all pairs of n nodes at most ``radius`` apart, each with itself too."""
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.greatest(F.col("id") - radius, F.lit(0)), F.least(F.col("id") + radius, F.lit(n - 1)))).alias("dst"))


def _by_window(nodes: DataFrame, *columns: str) -> DataFrame:
    """A row a window with its nodes by channel, as many as there are channels at most."""
    return nodes.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("channel", *columns))).alias("_n"))


def _near(nodes: Column, x: Column, i: Column, radius: int) -> Column:
    """Nodes within the radius of node number ``i``: channels are distinct, so they are at most ``radius`` places away."""
    first = F.greatest(i - radius, F.lit(0))
    return F.filter(F.slice(nodes, first + 1, i + radius - first + 1), lambda y: F.abs(y["channel"] - x["channel"]) <= radius)


def pruned_edges(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(window_id, src, dst, src_channel, dst_channel): band edges between active nodes, by rank."""
    ends = lambda x, y: F.struct(x["node_rank"].alias("src"), y["node_rank"].alias("dst"), x["channel"].alias("src_channel"), y["channel"].alias("dst_channel"))
    edges = bound(F.col("_n"), lambda n: F.flatten(F.transform(n, lambda x, i: F.transform(_near(n, x, i, radius), lambda y: ends(x, y)))))
    return _by_window(nodes, "node_rank").select("window_id", F.inline(edges))


def _with_values(nodes: DataFrame, values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nodes of each window with their values: both are dealt by window, once, and meet there without a join."""
    mine = nodes.select("window_id", "channel", F.lit(True).alias("_node"), *[F.lit(None).cast("double").alias(c) for c in columns])
    theirs = values.select("window_id", "channel", F.lit(None).cast("boolean").alias("_node"), *[F.col(c).cast("double").alias(c) for c in columns])
    met = mine.union(theirs).repartition("window_id").groupBy("window_id", "channel").agg(F.max("_node").alias("_node"), *[F.max(c).alias(c) for c in columns])
    return _by_window(met.filter("_node"), *columns)


def _sum(items: Column, pick) -> Column:
    """Sum of what there is, null where there is nothing."""
    return F.aggregate(items, F.lit(None).cast("double"), lambda s, y: F.when(pick(y).isNull(), s).otherwise(F.coalesce(s, F.lit(0.0)) + pick(y)))


def neighbour_sum(nodes: DataFrame, values: DataFrame, radius: int = 4, columns: Sequence[str] = ("value",)) -> DataFrame:
    """Sum of the neighbours' values (window_id, channel, columns...), each node's own among them; nodes without any have no row."""

    def summed(n: Column) -> Column:
        return F.transform(n, lambda x, i: bound(_near(n, x, i, radius), lambda near: F.struct(x["channel"].alias("channel"), *[_sum(near, _picker(c)).alias(c) for c in columns])))

    return _with_values(nodes, values, columns).select("window_id", F.inline(bound(F.col("_n"), summed))).filter(" OR ".join(f"`{c}` IS NOT NULL" for c in columns))


def _picker(column: str):
    return lambda y: y[column].cast("double")


def neighbour_norm(nodes: DataFrame, values: DataFrame, radius: int = 4, columns: Sequence[str] = ("value",)) -> DataFrame:
    """Neighbour sum weighted by 1 / sqrt(degree * degree) of both ends; self links count in degrees."""

    def degrees(n: Column) -> Column:
        return F.transform(n, lambda x, i: bound(F.sqrt(F.size(_near(n, x, i, radius)).cast("double")), lambda d: F.struct(x["channel"].alias("channel"), d.alias("_d"), *[(_picker(c)(x) / d).alias(c) for c in columns])))

    def summed(n: Column) -> Column:
        return F.transform(n, lambda x, i: bound(_near(n, x, i, radius), lambda near: F.struct(x["channel"].alias("channel"), *[(_sum(near, _picker(c)) / x["_d"]).alias(c) for c in columns])))

    weighted = bound(F.col("_n"), lambda n: bound(degrees(n), summed))
    return _with_values(nodes, values, columns).select("window_id", F.inline(weighted)).filter(" OR ".join(f"`{c}` IS NOT NULL" for c in columns))
