"""Leave-one-out feature ablation: all variants are scored in one pass over the events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitwatch.functions.keys import ordered_union, slug
from hitwatch.functions.vectors import interleave, pad
from hitwatch.operators.metrics import stats_columns, with_percentiles


def variants(branches: Sequence[str], baseline: bool = True) -> list[tuple[str, list[str], str | None]]:
    """(name, branches kept, branch removed): the baseline and one variant without each branch."""
    names = ordered_union(list(branches))
    if not names:
        raise ValueError("no branch to leave out")
    out: list[tuple[str, list[str], str | None]] = [("baseline_all", names, None)] if baseline else []
    return out + [(f"minus_{slug(b)}", [n for n in names if n != b], b) for b in names]


def variants_table(spark: SparkSession, branches: Sequence[str], baseline: bool = True) -> DataFrame:
    return spark.createDataFrame(variants(branches, baseline), "variant string, branches array<string>, removed string")


def variant_scores(events: DataFrame, branches: Sequence[str], score: Callable[[Column], Column], input_dim: int, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., variant, score) of every event under every variant; ``score`` makes a column of a vector column."""
    each = [F.struct(F.lit(name).alias("variant"), score(pad(interleave([F.col(f"`{b}`") for b in kept]), input_dim) if kept else pad(F.array().cast("array<double>"), input_dim)).alias("score")) for name, kept, _ in variants(branches)]
    return events.select(*keep, F.inline(F.array(*each)))


def summary(scores: DataFrame, threshold: float, branches: Sequence[str] | None = None, loss: str = "score") -> DataFrame:
    """A row a variant: mean, deviation, percentiles and share of scores at or over the threshold, and the mean loss of its events.

    With ``branches``, all of the ablation's, also what was removed, what was kept (joined by ;) and how many branches that is.
    """
    grouped = scores.groupBy("variant").agg(*stats_columns("score"), F.avg((F.col("score") >= threshold).cast("double")).alias("fraction"), F.avg(loss).alias("eval_loss"), F.count("*").alias("n"))
    told = with_percentiles(grouped, scores, "score", ["variant"])
    if branches is None:
        return told
    kept = variants_table(scores.sparkSession, branches).select("variant", F.coalesce("removed", F.lit("")).alias("removed"), F.array_join("branches", ";").alias("branches"), F.size("branches").alias("n_branches"))
    return told.join(F.broadcast(kept), "variant")
