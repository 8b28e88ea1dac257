"""Sliding windows over the event index: frames, bins, features, provenance, signals.

A window is ``history`` past frames and one target frame of ``size`` events each; windows start every
``stride`` events. Frames shared by windows are computed once: an event goes to the distinct used frames
that contain it, found by arithmetic, so there is no range join and no list of hits anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("sum", "cnt", "mean", "min", "max", "stdev")
DEFAULT_FEATURES = ("sum", "min", "max", "stdev", "cnt")


@dataclass(frozen=True)
class Layout:
    """Window parameters."""

    size: int
    stride: int
    history: int = 0
    bins: int = 1

    def __post_init__(self) -> None:
        if min(self.size, self.stride, self.bins) < 1 or self.history < 0:
            raise ValueError(f"not a window layout: {self}")

    @property
    def span(self) -> int:
        return (self.history + 1) * self.size

    @property
    def overlap(self) -> int:
        """How many different frames an event is in at most."""
        return min(self.size // gcd(self.size, self.stride), (self.history + 1) * -(-self.size // self.stride))

    def count(self, n_events: int) -> int:
        """Number of windows that fit in ``n_events`` events."""
        return max(0, (n_events - self.span) // self.stride + 1) if n_events >= self.span else 0


def check_features(names) -> list[str]:
    if unknown := [n for n in names if n not in FEATURES]:
        raise ValueError(f"unknown features: {unknown}")
    return list(names)


def bin_of(pos: Column, size: int, bins: int) -> Column:
    """Bin of a place in a frame; the first ``size % bins`` bins are one longer."""
    q, r = divmod(size, bins)
    long = F.floor(pos / (q + 1))
    return (long if q == 0 else F.when(pos < r * (q + 1), long).otherwise(r + F.floor((pos - r * (q + 1)) / q))).cast("long")


def place_bins(pos: np.ndarray, size: int, bins: int) -> np.ndarray:
    """``bin_of`` of places in an array."""
    q, r = divmod(size, bins)
    return pos // (q + 1) if q == 0 else np.where(pos < r * (q + 1), pos // (q + 1), r + (pos - r * (q + 1)) // q)


def windows(spark, layout: Layout, n_events: int, max_windows: int | None = None) -> DataFrame:
    """(window_id, start, end) of all windows, or of the first ``max_windows``; end is the last event's index."""
    count = layout.count(n_events)
    return spark.range(count if max_windows is None else min(count, max_windows)).select(F.col("id").alias("window_id"), (F.col("id") * layout.stride).alias("start"), (F.col("id") * layout.stride + layout.span - 1).alias("end"))


def window_ids(index: Column, span: int, stride: int, count: int) -> Column:
    """Array of the windows of ``span`` places that contain a place; empty where there is none."""
    first = F.greatest(F.ceil((index - span + 1) / stride).cast("long"), F.lit(0).cast("long"))
    last = F.least(F.floor(index / stride).cast("long"), F.lit(count - 1).cast("long"))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _frame_starts(index: Column, layout: Layout, n_windows: int, w: int) -> Column:
    """Starts of the frames that contain an event and are the frame number ``w`` of a window."""
    return F.transform(window_ids(index - w * layout.size, layout.size, layout.stride, n_windows), lambda k: k * layout.stride + w * layout.size)


def used_frames(index: Column, layout: Layout, n_windows: int) -> Column:
    """Starts of the distinct frames that contain an event and that some window uses.

    Where few candidates are in reach they are tested; where many are, the starts of each place in a window are listed.
    """
    step = gcd(layout.size, layout.stride)
    if layout.size // step > 2:
        each = [_frame_starts(index, layout, n_windows, w) for w in range(layout.history + 1)]
        return F.array_distinct(F.concat(*each)) if len(each) > 1 else each[0]
    first = F.greatest(F.ceil((index - layout.size + 1) / step).cast("long"), F.lit(0).cast("long"))
    starts = F.transform(F.sequence(first, F.floor(index / step).cast("long")), lambda j: j * step)
    return F.filter(starts, lambda f: is_used(f, layout, n_windows))


def is_used(start: Column, layout: Layout, n_windows: int) -> Column:
    """Whether one of the first ``n_windows`` windows has a frame that starts there."""
    out = F.lit(False)
    for w in range(layout.history + 1):
        at = start - w * layout.size
        out = out | ((at % layout.stride == 0) & at.between(0, (n_windows - 1) * layout.stride))
    return out


#: Blocks that a task takes up on average, where there are many.
BLOCKS_A_TASK = 16


def deal(rows: DataFrame, n_blocks: int) -> DataFrame:
    """``rows`` with those of each ``_block`` in one partition, one block after the other.

    The number of partitions is given: rows become many more in their task, so Spark must not merge partitions by their bytes.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks // BLOCKS_A_TASK))
    return rows.repartition(max(1, min(n_blocks, parts)), "_block").sortWithinPartitions("_block")


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The blocks of dealt rows with their columns, the first of which is the block's number."""
    held: list[list[np.ndarray]] = []
    block = -1
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cuts = np.flatnonzero(columns[0][1:] != columns[0][:-1]) + 1 if batch.num_rows else []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True) if batch.num_rows else []:
            if held and columns[0][a] != block:
                yield block, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            block = int(columns[0][a])
            held.append([c[a:b] for c in columns[1:]])
    if held:
        yield block, [np.concatenate(c) for c in zip(*held, strict=True)]


def cell_features(key: np.ndarray, partials: Sequence[np.ndarray], names: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys in order, and the features of the rows of each: of values, or of partials (sum, cnt, min, max, sum of squares)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    if not len(at):
        return key, [np.zeros(0, "i8" if f == "cnt" else float) for f in names]
    rows = [c[order] for c in partials]
    if len(rows) == 1:
        cnt, squares = np.diff(np.append(at, len(key))), np.add.reduceat(rows[0] * rows[0], at)
        low = high = rows[0]
    else:
        cnt, squares = np.add.reduceat(rows[1], at), np.add.reduceat(rows[4], at)
        low, high = rows[2], rows[3]
    total = np.add.reduceat(rows[0], at)
    mean = total / cnt
    made = {"sum": lambda: total, "cnt": lambda: cnt, "mean": lambda: mean, "stdev": lambda: np.sqrt(np.maximum(squares / cnt - mean * mean, 0.0))}
    # NaN is the largest number, as in Spark, and what is not finite becomes 0
    finite = lambda c: np.where(np.isfinite(c), c, 0.0)
    made |= {"min": lambda: finite(np.fmin.reduceat(low, at)), "max": lambda: finite(np.maximum.reduceat(high, at))}
    return key[at], [made[f]() for f in names]


def merge_features(grouped) -> DataFrame:
    """Frame features of merged partials; deviation is the population's, from sums of squares, never below 0."""
    out = grouped.agg(F.sum("sum").alias("sum"), F.sum("cnt").alias("cnt"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum_sq").alias("_sq"))
    mean = F.col("sum") / F.col("cnt")
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c))
    return out.select(*[c for c in out.columns if c not in ("sum", "cnt", "min", "max", "_sq")], "sum", "cnt", mean.alias("mean"), finite("min").alias("min"), finite("max").alias("max"), F.sqrt(F.greatest(F.col("_sq") / F.col("cnt") - mean * mean, F.lit(0.0))).alias("stdev"))


def frame_features(partials: DataFrame, layout: Layout, n_events: int) -> DataFrame:
    """(frame_start, channel, bin, features) of all used frames; a frame without hits on a channel has no row."""
    count = layout.count(n_events)
    if not count:
        return merge_features(partials.limit(0).select(F.col("event_idx").alias("frame_start"), "channel", F.col("event_idx").alias("bin"), "sum", "cnt", "min", "max", "sum_sq").groupBy("frame_start", "channel", "bin"))
    if layout.overlap > 2:
        return _overlapping_frames(partials, layout, count, n_events)
    framed = partials.withColumn("frame_start", F.explode(used_frames(F.col("event_idx"), layout, count)))
    return merge_features(framed.withColumn("bin", bin_of(F.col("event_idx") - F.col("frame_start"), layout.size, layout.bins)).groupBy("frame_start", "channel", "bin"))


#: Sizes of a frame in a block of frames, and partials that are worked on together.
FRAMES, PARTIALS = 64, 1 << 15


def _overlapping_frames(partials: DataFrame, layout: Layout, count: int, n_events: int) -> DataFrame:
    """``frame_features`` where an event is in many frames: partials are dealt by ranges of frame starts and copied to their frames in their task.

    So a partial is exchanged about once, however many frames it is in; partials without a value are left out.
    """
    wide = FRAMES * layout.size
    blocks = F.sequence(F.floor(F.greatest(F.col("event_idx") - layout.size + 1, F.lit(0)) / wide), F.floor(F.col("event_idx") / wide))
    rows = partials.filter("cnt > 0").select(F.explode(blocks).alias("_block"), "event_idx", "channel", "sum", "cnt", "min", "max", "sum_sq")
    out = partials.sparkSession.createDataFrame([], "frame_start long, channel long, bin long, sum double, cnt long, mean double, min double, max double, stdev double").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (event, channel, *values) in by_block(batches):
            order = np.argsort(event, kind="stable")
            event, channel, *values = [c[order] for c in (event, channel, *values)]
            step = max(1, min(wide, PARTIALS * wide // (len(event) * min(layout.size, layout.overlap))))
            for low in range(block * wide, (block + 1) * wide, step):
                high = min(low + step, (block + 1) * wide)
                starts = np.arange(low, high)
                used = np.zeros(high - low, bool)
                for w in range(layout.history + 1):
                    at = starts - w * layout.size
                    used |= (at % layout.stride == 0) & (at >= 0) & (at <= (count - 1) * layout.stride)
                own = slice(*np.searchsorted(event, [low, high + layout.size - 1]))
                starts = starts[used]
                first, last = np.searchsorted(starts, event[own] - layout.size, side="right"), np.searchsorted(starts, event[own], side="right")
                row = np.repeat(np.arange(len(first)), last - first)
                start = starts[first[row] + np.arange(len(row)) - (np.cumsum(last - first) - (last - first))[row]]
                names, code = np.unique(channel[own], return_inverse=True)
                key = ((start - low) * max(len(names), 1) + code[row]) * layout.bins + place_bins(event[own][row] - start, layout.size, layout.bins)
                key, made = cell_features(key, [c[own][row] for c in values], FEATURES)
                cell, part = np.divmod(key, layout.bins)
                first, which = np.divmod(cell, max(len(names), 1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (first + low, names[which], part, *made)], names=out.names)

    return deal(rows, -(-n_events // wide)).mapInArrow(run, out)


def frames_of_hits(hits: DataFrame, layout: Layout, n_events: int) -> DataFrame:
    """``frame_features`` of indexed hits, with one exchange where the layout allows it.

    Partials by event and channel come first, by an exchange of their own, only if each would be copied to more than two frames: with little overlap
    hits go to their frames as they are and are combined there before they are exchanged, by (frame, channel, bin). The rule follows from the layout alone.
    """
    from hitwatch.operators.hits import channel_partials, hit_partials

    return frame_features(hit_partials(hits) if layout.overlap <= 2 else channel_partials(hits), layout, n_events)


def dense_window_features(hits: DataFrame, layout: Layout, n_events: int) -> DataFrame:
    """(window_id, channel, bin, features) of single-frame windows, straight from indexed hits, by two-pass deviations."""
    ids = window_ids(F.col("event_idx"), layout.size, layout.stride, Layout(layout.size, layout.stride).count(n_events))
    x = F.col("integral").cast("double")
    placed = hits.withColumn("window_id", F.explode(ids)).withColumn("bin", bin_of(F.col("event_idx") - F.col("window_id") * layout.stride, layout.size, layout.bins))
    return placed.groupBy("window_id", "channel", "bin").agg(F.sum(x).alias("sum"), F.count(x).alias("cnt"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("stdev"))


def provenance(spark, indexed: DataFrame, layout: Layout, n_events: int, *, zero_is_missing: bool = False) -> DataFrame:
    """Keys of each window's first and last event, and their files."""
    from hitwatch.functions.keys import provenance_key

    frame = windows(spark, layout, n_events)
    keyed = indexed.select("event_idx", *[provenance_key(F.col(c), zero_is_missing).alias(c) for c in ("run", "subrun", "evt")], "file_idx")
    first = keyed.select(F.col("event_idx").alias("start"), *[F.col(c).alias(f"first_{c}") for c in ("run", "subrun", "evt")], F.col("file_idx").alias("first_file"))
    last = keyed.select(F.col("event_idx").alias("end"), F.col("evt").alias("last_evt"), F.col("file_idx").alias("last_file"))
    return frame.join(first, "start").join(last, "end").select("window_id", "start", "end", "first_run", "first_subrun", "first_evt", "last_evt", "first_file", "last_file")


def files_first_seen(indexed: DataFrame) -> DataFrame:
    """(file_idx, first_event): files in the order in which their events come first."""
    return indexed.groupBy("file_idx").agg(F.min("event_idx").alias("first_event"))


def signal_windows(signal: DataFrame, size: int, stride: int, n: int) -> DataFrame:
    """(window_id, values, labels) of a 1-D signal of rows (t, v, label) with dense t."""
    count = Layout(size, stride).count(n)
    placed = signal.withColumn("window_id", F.explode(window_ids(F.col("t"), size, stride, count)))
    items = placed.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("t", "v", "label"))).alias("_s"))  # at most ``size`` items
    return items.select("window_id", F.transform("_s", lambda s: s["v"]).alias("values"), F.transform("_s", lambda s: s["label"]).alias("labels"))


def over_windows(history: int, stride: int = 1, bins: int = 1) -> Layout:
    """Layout of samples over materialised windows: each window is a frame of one place."""
    return Layout(size=1, stride=stride, history=history, bins=bins)


def history_pairs(spark, n_windows: int, history: int, stride: int = 1) -> DataFrame:
    """Past and target windows of samples over ``n_windows`` windows, hits or not: (sample, lag, window_id); lag ``history`` is the target."""
    samples = windows(spark, over_windows(history, stride), n_windows)
    lags = samples.select(F.col("window_id").alias("sample"), F.posexplode(F.sequence("start", "end")).alias("lag", "window_id"))
    return lags.select("sample", F.col("lag").cast("long").alias("lag"), "window_id")


def ranged_bin_arrays(hits: DataFrame, layout: Layout, n_events: int, names: Sequence[str] = DEFAULT_FEATURES, per_range: int = 256) -> DataFrame:
    """(window_id, channel, bins, window_range): an array for each bin with its features, zeros where a bin has no hits, and the range of ``per_range`` windows.

    These are the features of ``dense_window_features``, straight from indexed hits.
    Hits are dealt by range, once; all bins of a window's channel are summed up together, so no list of bins is gathered.
    """
    count = Layout(layout.size, layout.stride).count(n_events)
    placed = hits.withColumn("window_id", F.explode(window_ids(F.col("event_idx"), layout.size, layout.stride, count)))
    bin_ = bin_of(F.col("event_idx") - F.col("window_id") * layout.stride, layout.size, layout.bins)
    rows = placed.select(F.floor(F.col("window_id") / per_range).alias("_block"), "window_id", "channel", bin_.alias("_bin"), F.col("integral").cast("double").alias("_x"))
    of = {"sum": F.sum, "cnt": F.count, "mean": F.avg, "min": F.min, "max": F.max, "stdev": F.stddev_pop}
    cells = {(b, f): of[f](F.when(F.col("_bin") == b, F.col("_x"))) for b in range(layout.bins) for f in check_features(names)}
    grouped = deal(rows, -(-count // per_range)).groupBy("_block", "window_id", "channel").agg(*[c.alias(f"_{b}_{f}") for (b, f), c in cells.items()])
    bins = F.array(*[F.array(*[F.coalesce(F.col(f"_{b}_{f}").cast("double"), F.lit(0.0)) for f in names]) for b in range(layout.bins)])
    return grouped.select("window_id", "channel", bins.alias("bins"), F.col("_block").alias("window_range"))
