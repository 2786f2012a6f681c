"""Spanning trees by shortening hash prefixes until a probabilistic rule holds.

At prefix i all tables are used and the working tree is the minimum spanning forest of the pairs with a common
prefix of at least i. As forests compose, it is MSF(tree so far + pairs new at i). The sweep starts at the longest prefix
whose buckets connect all points, as no tree spans before, and each further level compares only the pairs that
first meet there. Only counts and sums reach the driver. When the buckets of a level hold more pairs, over all tables,
than there are, comparing all pairs in tiles is less work; the tree is then the exact one, and the result says so.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.functions.families import Family
from graftline.operators import candidates as cand
from graftline.operators import near
from graftline.operators.buckets import bucket_trees, chain, hashed
from graftline.operators.msf import EDGE, component_labels, forest, msf
from graftline.operators.pairs import exact_tree
from graftline.session import materialize

LEVEL = "prefix int, path string, compared long, n_edges long, n_confirmed long, weight double, bound double, worst double, accepted boolean"


@dataclass
class TreeResult:
    """``edges`` of the tree, the ``prefix`` at which it was accepted, by which ``path`` (lsh or exact), and a row of figures per level."""

    edges: DataFrame
    prefix: int
    path: str = "lsh"
    levels: list[dict] = field(default_factory=list)

    def metrics(self) -> DataFrame:
        """A row per level: pairs compared, edges, confirmed edges, weight, bound, the worst chance of a missed edge, the outcome."""
        return self.edges.sparkSession.createDataFrame([tuple(r.values()) for r in self.levels], LEVEL)

    def described(self) -> DataFrame:
        """The edges with ``prefix`` and ``path``."""
        return self.edges.withColumns({"prefix": F.lit(self.prefix), "path": F.lit(self.path)})


def spans(n_edges: int, n_points: int) -> bool:
    """A forest spans if it has one edge less than points; no or one point needs none."""
    return n_edges >= n_points - 1


def connecting_prefix(table: DataFrame, depth: int, n: int) -> int:
    """The longest prefix at which the buckets of all tables connect ``n`` points."""
    row = msf(chain(table, depth), n).agg(F.max("w").alias("w")).first()
    return depth - int(row.w or 0)


def _sweep(points: DataFrame, family: Family, delta: float, per_edge: bool, accept, prune_connected: bool, switch: float | None) -> TreeResult:
    n = points.count()
    spark = points.sparkSession
    if n < 2:
        return TreeResult(spark.createDataFrame([], EDGE), family.depth)
    limit = delta if per_edge else delta / n
    # equal points share every bucket, so one at each place is hashed and the others hang on it
    points, stars = near.merged(points, family.metric) or (points, None)
    places = n if stars is None else points.count()
    table = hashed(points, family)
    start = connecting_prefix(table, family.depth, places)
    tree, levels, every, before = None, [], places * (places - 1) // 2, 0

    def whole() -> DataFrame:
        return tree if stars is None else tree.unionByName(stars)

    def judged(prefix: int, path: str, compared: int) -> bool:
        sure = cand.confirm(whole(), family, prefix, limit)
        row = cand.bound_weight(sure).crossJoin(sure.agg(F.max("fail").alias("worst"))).first()
        ok = spans(row.n_edges, n) and (not prefix or bool(accept(row, limit)))
        levels.append({"prefix": prefix, "path": path, "compared": compared, "n_edges": row.n_edges, "n_confirmed": row.n_confirmed, "weight": row.weight, "bound": row.bound, "worst": row.worst, "accepted": ok})
        return ok

    for prefix in range(start, -1, -1):
        load = cand.level_load(table, prefix) if prefix else every
        work, before = load - before, load
        if not prefix or switch is not None and work >= switch * every:
            # at prefix 0 every table would compare all pairs
            tree = materialize(exact_tree(points, family.metric), "tree")
            judged(0, "exact", every)
            return TreeResult(whole(), 0, "exact", levels)
        rows = table
        if prune_connected and tree is not None:
            sure = cand.confirm(tree, family, prefix + 1, limit).filter("confirmed")
            rows = table.join(component_labels(sure, points.select("vec_id")), "vec_id")
        edges = bucket_trees(rows, points, prefix, family.metric, tree is not None, "comp" in rows.columns).select("i", "j", "w")
        tree = materialize(msf((edges if tree is None else edges.unionByName(tree)).distinct(), places), "tree")
        if judged(prefix, "lsh", work):
            return TreeResult(whole(), prefix, "lsh", levels)
    raise AssertionError("unreachable")


def find_tree(points: DataFrame, family: Family, delta: float = 0.1, per_edge: bool = False, prune_connected: bool = False, switch: float | None = 1.0) -> TreeResult:
    """Minimum spanning tree, right with high probability: accepted at the longest prefix at which the tree spans
    and every edge would have been missed with a chance below ``delta / n`` (``delta`` with ``per_edge``). Without
    ``switch`` only prefix 0 compares all pairs."""
    return _sweep(points, family, delta, per_edge, lambda row, limit: row.worst < limit, prune_connected, switch)


def find_epsilon_tree(points: DataFrame, family: Family, epsilon: float = 0.2, delta: float = 0.1, per_edge: bool = False, prune_connected: bool = False, switch: float | None = 1.0) -> TreeResult:
    """Spanning tree at most ``1 + epsilon`` times as heavy as the least, with high probability: accepted at the
    longest prefix at which it spans and weighs at most ``1 + epsilon`` times the bound of ``bound_weight``."""
    if epsilon < 0:
        raise ValueError("epsilon must not be negative")
    return _sweep(points, family, delta, per_edge, lambda row, _: row.weight <= (1 + epsilon) * row.bound, prune_connected, switch)


def is_connected(edges: DataFrame, points: DataFrame) -> DataFrame:
    """``n_points, n_edges, n_components, connected``."""
    comps = component_labels(edges, points.select("vec_id")).agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("comp").alias("n_components"))
    return comps.crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges"))).select("n_points", "n_edges", "n_components", (F.col("n_components") <= 1).alias("connected"))


def forests_by_table(table: DataFrame, points: DataFrame, prefix: int, name: str) -> DataFrame:
    """``rep, i, j, w``: the spanning forest of the pairs that each table alone brings together.

    The buckets of a table share no point, so its forest is that of its buckets; only the trees of a bucket that was cut
    into tiles are merged.
    """
    edges = bucket_trees(table, points, prefix, name)

    def run(t: pa.Table) -> pa.Table:
        cols = [t.column(c).to_numpy() for c in ("i", "j", "w")]
        return t.select(["rep", "i", "j", "w"]).take(pa.array(np.sort(forest(*cols))))

    return edges.distinct().groupBy("rep", "bucket").applyInArrow(run, "rep int, i long, j long, w double")
