"""Figures on runs, trees and collision logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_over_runs(runs: DataFrame, weights: list[str], slack: float = 0.0) -> DataFrame:
    """Add ``least`` and ``share``: the least weight of a row's runs and the share of its runs that reach it.

    Null and NaN weights are runs without result: they count in neither. Without any, both are null.
    """
    clean = [F.when(~F.isnan(F.col(c)), F.col(c)) for c in weights]
    least = F.least(*clean)
    reached = sum((F.when(c <= least * (1 + slack), 1).otherwise(0) for c in clean), F.lit(0))
    valid = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in clean), F.lit(0))
    return runs.withColumn("least", least).withColumn("share", F.when(valid > 0, reached / valid))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n``: counts of equal bins 1..bins over [low, high]; the upper end belongs to the last bin. Empty bins
    are left out, as are nulls, NaN and values outside."""
    if not (bins > 0 and high > low):
        raise ValueError("bins must be positive and high above low")
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)) + 1, F.lit(bins))
    inside = df.filter(F.col(value).between(low, high))
    return inside.groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def median_edge(edges: DataFrame) -> DataFrame:
    """``w``: the upper median weight, at position n div 2 (from 0) of the sorted edges, by an exact percentile."""
    n = edges.count()
    if not n:
        return edges.select("w").limit(0)
    # the least value that more than n div 2 of the weights don't exceed
    share = (n // 2 + 0.5) / n
    return edges.agg(F.expr(f"percentile_disc({share!r}d) within group (order by w)").alias("w"))


def tree_weights(edges: DataFrame, points: DataFrame, name: str) -> DataFrame:
    """``run_id, n_edges, weight`` of logged trees ``run_id, u, v``: edges in either direction count once, loops,
    nulls and ends without a vector don't count."""
    from graftline.operators.candidates import weigh

    ends = edges.filter("u is not null and v is not null and u <> v").select("run_id", F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j")).distinct()
    return weigh(ends, points, name).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("w").alias("weight"))
