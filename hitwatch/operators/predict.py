"""Models as plug-ins: functions on NumPy batches, of one of the kinds that a table lists, and a dense ReLU network from given weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitwatch.operators import window_pass
from hitwatch.operators.score import flag
from hitwatch.operators.windows import DEFAULT_FEATURES, Layout


@dataclass(frozen=True)
class Kind:
    """What a kind of model takes: how many columns, and of how many dimensions a row's value in each is."""

    columns: int
    dims: int


#: Vectors of either sub-detector, windows of channels x time, vectors of both sub-detectors joined by event, and graphs of windows.
KINDS = {"tpc": Kind(1, 1), "pmt": Kind(1, 1), "window": Kind(1, 2), "fusion": Kind(2, 1), "gnn": Kind(0, 0)}


def check_model(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown model type {kind}; one of {tuple(KINDS)}")
    return kind


def _laid_out(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, shape, values): where each row's values begin among the flat values, and their shape; a null row has shape -1.

    For two dimensions a row may be a plain list as well, which is one channel.
    """
    at, inner = column.offsets.to_numpy().astype("i8"), column.values
    count = np.diff(at)
    if dims == 1:
        first, shape = at[:-1], count[:, None]
    elif not pa.types.is_list(column.type.value_type):
        first, shape = at[:-1], np.stack([np.ones_like(count), count], axis=1)
    else:
        inner_at = inner.offsets.to_numpy().astype("i8")
        lengths = np.diff(inner_at)
        width = np.where(count > 0, np.append(lengths, 0)[np.minimum(at[:-1], len(lengths))], 0)
        if inner.null_count or (np.repeat(width, count) != lengths[at[0] : at[-1]]).any():
            raise ValueError("all channels of a window must be of one length")
        first, shape, inner = inner_at[at[:-1]], np.stack([count, width], axis=1), inner.values
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return first, np.where(valid[:, None], shape, -1), inner.to_numpy(zero_copy_only=False).astype(float)


def batches_of(columns: Sequence[pa.Array], dims: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(rows, arrays): the rows of each shape, with a dense array of each column; rows with a null are in none. Cut by offsets, value by value never."""
    parts = [_laid_out(c, dims) for c in columns]
    shapes = np.concatenate([shape for _, shape, _ in parts], axis=1)
    known = np.flatnonzero((shapes >= 0).all(axis=1))
    kinds, which = np.unique(shapes[known], axis=0, return_inverse=True)
    for k, shape in enumerate(kinds):
        rows = known[which.ravel() == k]
        own = shape.reshape(len(parts), dims)
        yield rows, [values[first[rows][:, None] + np.arange(int(s.prod()))].reshape(len(rows), *s) for (first, _, values), s in zip(parts, own, strict=True)]


def z_scored(x: np.ndarray) -> np.ndarray:
    """Values along the last axis less their mean, by their deviation; where that is 0, by 1."""
    spread = x.std(axis=-1, keepdims=True)
    return (x - x.mean(axis=-1, keepdims=True)) / np.where(spread > 0, spread, 1.0)


def _nested(x: np.ndarray) -> pa.Array:
    """Arrow lists of the rows of an array of two or three dimensions."""
    out = pa.array(np.ascontiguousarray(x, float).ravel())
    for level in range(x.ndim - 1, 0, -1):
        out = pa.ListArray.from_arrays(pa.array(np.arange(int(np.prod(x.shape[:level])) + 1) * x.shape[level], pa.int32()), out)
    return out


@dataclass(frozen=True)
class Model:
    """A model of a kind of ``KINDS``; the kind is checked when it is made.

    ``fn`` gets one array for each column, rows first (rows x length; rows x channels x time for windows), and returns their reconstruction; of a
    fusion that of both vectors end to end. A graph model gets node vectors, edges and graph numbers, see ``window_pass.score_windows``.
    With ``normalise`` each row (of a window: each channel) is z-scored before. Rows of different lengths are given in batches of their own; a row with a
    null has no score. A function with a large model is sent once a job, as Spark broadcasts serialised functions over 1 MB.
    """

    kind: str
    fn: Callable[..., np.ndarray]
    normalise: bool = False
    threshold: float | None = None

    def __post_init__(self) -> None:
        check_model(self.kind)

    def _taken(self, columns: Sequence[str]) -> list[Column]:
        """The columns twice over: what is used twice is computed before, so that a long expression never becomes part of
        the Python call (deeply nested functions of arrays are not planned there); each column is sent once all the same."""
        wanted = KINDS[self.kind].columns
        if not wanted:
            raise ValueError(f"{self.kind} takes windows' graphs: use node_scores")
        if len(columns) != wanted:
            raise ValueError(f"{self.kind} takes {wanted} columns, not {len(columns)}")
        return [F.col(c) for c in columns] * 2

    def _run(self, batch: Sequence[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, what was given, what was made of it) for each shape of rows."""
        for rows, arrays in batches_of(batch[: len(batch) // 2], KINDS[self.kind].dims):
            given = [z_scored(a) for a in arrays] if self.normalise else arrays
            whole = given[0] if len(given) == 1 else np.concatenate(given, axis=-1)
            yield rows, whole, np.asarray(self.fn(*given), float).reshape(whole.shape)

    def scores(self, df: DataFrame, *columns: str, out: str = "score") -> DataFrame:
        """``df`` with the mean squared error of reconstructing each row."""

        @F.arrow_udf("double")
        def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                made, known = np.zeros(len(batch[0])), np.zeros(len(batch[0]), bool)
                for rows, given, back in self._run(batch):
                    with np.errstate(invalid="ignore"):
                        made[rows] = ((given - back) ** 2).reshape(len(rows), -1).sum(axis=1) / np.prod(given.shape[1:])
                    known[rows] = True
                yield pa.array(made, mask=~known)

        return df.withColumn(out, score(*self._taken(columns)))

    def reconstruct(self, df: DataFrame, *columns: str, out: str = "x_hat") -> DataFrame:
        """``df`` with each row's reconstruction, in the shape of what was given (a plain list where one was)."""
        taken = self._taken(columns)
        deep = KINDS[self.kind].dims == 2 and df.select(*columns).schema.fields[0].dataType.simpleString().startswith("array<array")

        @F.arrow_udf("array<array<double>>" if deep else "array<double>")
        def back_of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                parts, order = [], np.full(len(batch[0]), -1)
                for rows, given, back in self._run(batch):
                    order[rows] = np.arange(len(rows)) + sum(map(len, parts))
                    parts.append(_nested(back if deep else back.reshape(len(rows), given[0].size)))
                kind = pa.list_(pa.list_(pa.float64())) if deep else pa.list_(pa.float64())
                yield pa.concat_arrays([p.cast(kind) for p in parts] or [pa.array([], kind)]).take(pa.array(order, mask=order < 0))

        return df.withColumn(out, back_of(*taken))

    def node_scores(self, assembled: DataFrame, layout: Layout, n_windows: int, *, features: Sequence[str] = DEFAULT_FEATURES, radius: int = 4) -> DataFrame:
        """(window_id, channel, node_rank, mse) of a graph model."""
        if self.kind != "gnn":
            raise ValueError(f"{self.kind} takes columns: use scores")
        return window_pass.score_windows(assembled, layout, n_windows, self.fn, features=features, radius=radius)

    def flag(self, score: Column) -> Column:
        """Whether a score is over the model's threshold; without one it is an error."""
        return flag(score, self.threshold)


def score_vectors(df: DataFrame, column: str, fn: Callable[[np.ndarray], np.ndarray], out: str = "score") -> DataFrame:
    """``df`` with the mean squared error of reconstructing each vector."""
    return Model("tpc", fn).scores(df, column, out=out)


class DenseReLU:
    """Forward pass of dense layers with ReLU between them, e.g. an encoder and decoder."""

    def __init__(self, layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> None:
        self.layers = [(np.asarray(w, float), np.asarray(b, float)) for w, b in layers]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(self.layers):
            x = x @ w.T + b
            if i < len(self.layers) - 1:
                x = np.maximum(x, 0)
        return x

    @classmethod
    def seeded(cls, sizes: Sequence[int], seed: int = 0) -> DenseReLU:
        """Layers of the given sizes with seeded normal weights."""
        rng = np.random.default_rng(seed)
        return cls([(rng.normal(0, (2 / a) ** 0.5, (b, a)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)])
