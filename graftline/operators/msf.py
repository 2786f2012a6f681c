"""Minimum spanning forests of weighted edges.

Edges are ``i, j, w`` with i < j, in the total order (w, i, j), so the forest is unique and
MSF(A + B) = MSF(MSF(A) + MSF(B)). Every partition first keeps the forest of its own edges. What is left is
finished in one task if it has at most ``LOCAL_VERTICES`` vertices, else by distributed rounds in which every
component takes its least outgoing edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftline.session import materialize

EDGE = "i long, j long, w double"
LOCAL_VERTICES = 2_000_000
CHUNK = 2_000_000


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges as i < j, each at its least weight; loops, nulls and NaN weights are dropped."""
    good = edges.filter("i is not null and j is not null and i <> j and w is not null and not isnan(w)")
    ends = good.select(F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"), F.col("w").cast("double").alias("w"))
    return ends.groupBy("i", "j").agg(F.min("w").alias("w"))


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def forest(i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the edges of the minimum spanning forest, in the order (w, i, j)."""
    if not len(i):
        return np.empty(0, np.int64)
    order = np.lexsort((j, i, w))
    names, ends = np.unique(np.concatenate([i[order], j[order]]), return_inverse=True)
    a, b = ends[: len(i)], ends[len(i) :]
    comp, at, taken = np.arange(len(names)), np.arange(len(i)), []
    while len(at):
        ca, cb = comp[a[at]], comp[b[at]]
        open_ = ca != cb
        at, ca, cb = at[open_], ca[open_], cb[open_]
        if not len(at):
            break
        # edges are in order, so the first of a component is its least
        least = np.full(len(names), len(i), np.int64)
        np.minimum.at(least, ca, at)
        np.minimum.at(least, cb, at)
        live = np.flatnonzero(least < len(i))
        edge = least[live]
        other = np.where(comp[a[edge]] == live, comp[b[edge]], comp[a[edge]])
        parent = np.arange(len(names))
        parent[live] = other
        mutual = live[(parent[parent[live]] == live) & (live < parent[live])]
        parent[mutual] = mutual
        comp = roots(parent)[comp]
        taken.append(np.unique(edge))
    picked = np.sort(np.concatenate(taken)) if taken else np.empty(0, np.int64)
    return order[picked]


def _table(i: np.ndarray, j: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(w, pa.float64())], names=["i", "j", "w"])


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest of a partition's edges; at most ``CHUNK`` new edges are held beside it."""
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    new: list[pa.RecordBatch] = []

    def fold() -> None:
        cols = [np.concatenate([held[n], *(b.column(n).to_numpy() for b in new)]) for n in range(3)]
        keep = forest(*cols)
        held[:] = [c[keep] for c in cols]
        del new[:]

    for b in batches:
        new.append(b)
        if sum(x.num_rows for x in new) >= CHUNK:
            fold()
    if new:
        fold()
    yield _table(*held)


def distributed_forest(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Forest of edges whose vertices don't fit one task: rounds of least outgoing edges by joins."""
    spark = edges.sparkSession
    edges = materialize(edges, "edges")
    label = edges.select(F.col("i").alias("v")).union(edges.select(F.col("j").alias("v"))).distinct().withColumn("c", F.col("v"))
    label = materialize(label, "label")
    found = None
    for _ in range(max_rounds):
        a = label.select(F.col("v").alias("i"), F.col("c").alias("ci"))
        b = label.select(F.col("v").alias("j"), F.col("c").alias("cj"))
        out = edges.join(a, "i").join(b, "j").filter("ci <> cj")
        sides = out.select(F.col("ci").alias("c"), F.col("cj").alias("o"), "w", "i", "j").unionByName(out.select(F.col("cj").alias("c"), F.col("ci").alias("o"), "w", "i", "j"))
        least = materialize(sides.groupBy("c").agg(F.min(F.struct("w", "i", "j", "o")).alias("e")).select("c", "e.w", "e.i", "e.j", "e.o"), "least")
        if least.isEmpty():
            break
        picked = least.select("i", "j", "w")
        found = materialize((picked if found is None else found.unionByName(picked)).distinct(), "forest")
        back = least.select(F.col("c").alias("o"), F.col("o").alias("back"))
        hook = least.select("c", "o").join(back, "o", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("p"))
        hook = materialize(hook, "hook")
        while True:
            up = hook.select(F.col("c").alias("p"), F.col("p").alias("q"))
            nxt = materialize(hook.join(up, "p", "left").select("c", F.coalesce("q", "p").alias("p"), (F.coalesce("q", "p") != F.col("p")).alias("moved")), "hook")
            moved = not nxt.filter("moved").isEmpty()
            hook = nxt.select("c", "p")
            if not moved:
                break
        label = materialize(label.join(hook, "c", "left").select("v", F.coalesce("p", "c").alias("c")), "label")
    return found if found is not None else spark.createDataFrame([], EDGE)


def msf(edges: DataFrame, vertices: int | None = None) -> DataFrame:
    """Minimum spanning forest ``i, j, w`` of canonical edges. ``vertices`` is their number, if known."""
    local = edges.select("i", "j", "w").mapInArrow(local_forest, EDGE)
    if vertices is None:
        local = materialize(local, "forests")
        vertices = local.select(F.explode(F.array("i", "j")).alias("v")).agg(F.approx_count_distinct("v", 0.02)).first()[0]
    if vertices > LOCAL_VERTICES:
        return distributed_forest(local)
    # halve the number of forests in parallel before the last task
    return local.repartition(8).mapInArrow(local_forest, EDGE).repartition(1).mapInArrow(local_forest, EDGE)


def _local_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the forest in one partition: each vertex with the least of its component."""
    whole = [b for b in batches if b.num_rows]
    if not whole:
        return
    ends = [np.concatenate([b.column(n).to_numpy() for b in whole]) for n in (0, 1)]
    names, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = at[: len(ends[0])], at[len(ends[0]) :]
    label = np.arange(len(names))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[label])], names=["vec_id", "comp"])


def component_labels(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``vec_id, comp``: the least vertex of each vertex's component.

    Partitions reduce their edges to forests; up to ``LOCAL_VERTICES`` vertices these are labelled in one
    task, more by joins with pointer doubling.
    """
    pairs = edges.select(F.col("i").cast("long"), F.col("j").cast("long")).filter("i <> j")
    few = vertices.count() <= LOCAL_VERTICES
    if few:
        forests = pairs.withColumn("w", F.lit(0.0)).mapInArrow(local_forest, EDGE)
        found = forests.repartition(1).mapInArrow(local_forest, EDGE).mapInArrow(_local_labels, "vec_id long, comp long")
        return vertices.select("vec_id").join(found, "vec_id", "left").select("vec_id", F.coalesce("comp", "vec_id").alias("comp"))
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j")))
    both = materialize(both.distinct(), "links")
    label = materialize(vertices.select(F.col("vec_id"), F.col("vec_id").alias("comp")), "label")
    while True:
        seen = both.join(label.select(F.col("vec_id").alias("j"), "comp"), "j").groupBy("i").agg(F.min("comp").alias("low"))
        step = label.join(seen, label["vec_id"] == seen["i"], "left").select("vec_id", "comp", F.least("comp", F.coalesce("low", "comp")).alias("new"))
        up = step.select(F.col("vec_id").alias("new"), F.col("new").alias("top"))
        nxt = materialize(step.join(up, "new", "left").select("vec_id", F.least("new", "top").alias("comp"), (F.least("new", "top") != F.col("comp")).alias("moved")), "label")
        label = nxt.select("vec_id", "comp")
        if nxt.filter("moved").isEmpty():
            return label
