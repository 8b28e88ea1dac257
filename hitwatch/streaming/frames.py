"""Frames over arriving events, kept in Spark's state store: each frame is a key with its partials as state and a timer at its last event."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from hitwatch.operators.windows import Layout, bin_of, is_used, used_frames

FRAME_SCHEMA = "frame_start long, channel long, bin long, sum double, cnt long, mean double, min double, max double, stdev double"
_STATE = "channel array<long>, bin array<long>, sum array<double>, cnt array<long>, min array<double>, max array<double>, sum_sq array<double>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: More windows than any stream has: which of the last frames belong to a whole window is known at its end only, see ``whole_frames``.
_ENDLESS = 1 << 40


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    """Partials with one row for each channel and bin."""
    return parts.groupby(["channel", "bin"], as_index=False).agg(sum=("sum", "sum"), cnt=("cnt", "sum"), min=("min", "min"), max=("max", "max"), sum_sq=("sum_sq", "sum"))


class FrameState(StatefulProcessor):
    """Partials of one frame: channels x bins at most, whatever the number of hits."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.partials = handle.getValueState("partials", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.partials.exists()
        parts = [pd.DataFrame(dict(zip(("channel", "bin", "sum", "cnt", "min", "max", "sum_sq"), map(list, self.partials.get()), strict=True)))] if known else []
        for hits in rows:
            x = hits["integral"]
            parts.append(_merged(pd.DataFrame({"channel": hits["channel"], "bin": hits["bin"], "sum": x, "cnt": 1, "min": x, "max": x, "sum_sq": x * x})))
        merged = _merged(pd.concat(parts))
        self.partials.update(tuple(merged[c].tolist() for c in merged.columns))
        if not known:
            # just before the last event's time: it goes off once that event, or a later one, has come
            self.handle.registerTimer((int(key[0]) + self.size) * 1000 - 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        channel, part, total, cnt, low, high, squares = map(np.array, self.partials.get())
        self.partials.clear()
        mean = total / cnt
        finite = lambda v: np.where(np.isfinite(v), v, 0.0)
        yield pd.DataFrame({"frame_start": int(key[0]), "channel": channel, "bin": part, "sum": total, "cnt": cnt, "mean": mean, "min": finite(low), "max": finite(high), "stdev": np.sqrt(np.maximum(squares / cnt - mean * mean, 0))})

    def close(self) -> None:
        pass


def stream_frames(hits: DataFrame, layout: Layout, lateness: int = 0) -> DataFrame:
    """Frame features of streaming hits (event_idx, channel, integral), each frame's rows once its last event (or a later one) is in.

    Event indexes are the stream's event time, a second each. Hits of a batch may come in any order; between batches, events may come up to
    ``lateness`` places behind the newest one, which holds frames open for so much longer. What comes later still is left out and counted by
    Spark as dropped by the watermark (``dropped``). State and timers are in the checkpoint: a query that is stopped or killed goes on from there.
    """
    # a frame may stay open for as long as it is awaited: negative channels and hits without one are left out, as in the batch job
    sound = hits.filter("channel >= 0").select(F.col("event_idx").cast("long").alias("event_idx"), F.col("channel").cast("long").alias("channel"), F.col("integral").cast("double").alias("integral"))
    # event 0 is one second in, as what is not after the watermark's start would count as late
    timed = sound.withColumn("at", F.timestamp_seconds(F.col("event_idx") + 1)).withWatermark("at", f"{lateness} seconds")
    framed = timed.withColumn("frame_start", F.explode(used_frames(F.col("event_idx"), layout, _ENDLESS)))
    placed = framed.select("frame_start", "channel", bin_of(F.col("event_idx") - F.col("frame_start"), layout.size, layout.bins).alias("bin"), "integral", "at")
    return placed.groupBy("frame_start").transformWithStateInPandas(FrameState(layout.size), FRAME_SCHEMA, "append", "eventtime")


def run_frames(hits: DataFrame, layout: Layout, out: str, checkpoint: str, lateness: int = 0) -> StreamingQuery:
    """Process what has arrived, append the frames that are complete to a Parquet folder, and stop."""
    conf = hits.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        query = stream_frames(hits, layout, lateness).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)
    return query


def whole_frames(spark: SparkSession, out: str, layout: Layout, n_events: int) -> DataFrame:
    """The frames that were written, of the windows that fit in ``n_events`` events."""
    return spark.read.schema(FRAME_SCHEMA).parquet(out).filter(is_used(F.col("frame_start"), layout, layout.count(n_events)))


def state_size(query: StreamingQuery) -> tuple[int, int]:
    """(keys, bytes) in the state store after the last batch."""
    operators = query.lastProgress["stateOperators"]
    return sum(o["numRowsTotal"] for o in operators), sum(o["memoryUsedBytes"] for o in operators)


def dropped(query: StreamingQuery) -> int:
    """Rows that came too late in the batches still on record."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
