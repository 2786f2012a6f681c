"""Approximate neighbours and closest pairs by hash prefixes, with stop rules per level."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graftline.functions.families import Family, SimHash, codes
from graftline.functions.probability import simhash_collision
from graftline.functions.vectors import metric, prepare
from graftline.operators import candidates as cand
from graftline.operators.buckets import bucket_closest, hashed
from graftline.operators.pairs import closest_pairs as closest_pairs_exact
from graftline.operators.pairs import exact_neighbours, matrix
from graftline.session import materialize

SMALL = 100  # with fewer points all are compared
FILTERS = ("none", "simple", "default")


def sketches(points: DataFrame, bits: int, seed: int = 7) -> DataFrame:
    """``vec_id, sketch``: one sign bit per random projection, in one integer; at most 63 bits."""
    if not 1 <= bits <= 63:
        raise ValueError("1 to 63 bits")
    dim = points.select(F.size("embedding")).first()
    family = SimHash(dim[0] if dim else 1, 1, bits, seed)
    packed = F.aggregate("code", F.lit(0).cast("long"), lambda s, b: s * 2 + b)
    return codes(points, family).select("vec_id", packed.alias("sketch"))


def most_difference(kth: Column, bits: int, miss: float) -> Column:
    """Bits in which the sketches of two points within cosine distance ``kth`` differ, but with a chance of about
    ``miss``: what is expected and a margin. Without a distance all bits."""
    p = F.lit(1.0) - simhash_collision(kth)
    margin = F.lit(NormalDist().inv_cdf(1 - miss)) * F.sqrt(F.lit(bits) * p * (F.lit(1.0) - p))
    return F.when(kth.isNull(), F.lit(bits)).otherwise(F.ceil(F.lit(bits) * p + margin))


GROWTH = 16  # candidates of a stage for each of the one before, about


def _load(asked: DataFrame, table: DataFrame, depth: int) -> list[int]:
    """Candidates of all queries at each prefix, over all tables, repeated ones counted each time."""

    def sizes(rows: DataFrame, name: str) -> DataFrame:
        levels = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.xxhash64("rep", cand.prefix_of("code", p)).alias("key")) for p in range(depth + 1)]))
        return rows.select(levels.alias("l")).groupBy("l.p", "l.key").agg(F.count(F.lit(1)).alias(name))

    met = sizes(asked, "q").join(sizes(table, "n"), ["p", "key"]).groupBy("p").agg(F.sum(F.col("q") * F.col("n")).alias("c"))
    found = {r["p"]: r["c"] for r in met.collect()}
    return [int(found.get(p, 0)) for p in range(depth + 1)]


def _stages(load: list[int], depth: int, least: int) -> list[tuple[int, int]]:
    """Ranges of prefixes (longest, shortest) that are searched in one join each; every stage has several times the
    candidates of the one before, so what is joined in vain costs little."""
    out, top, budget = [], depth, GROWTH * least
    while top >= 0:
        low = top
        while low and load[low - 1] <= budget:
            low -= 1
        out.append((top, low))
        top, budget = low - 1, GROWTH * max(budget, load[low])
    return out


def knn(queries: DataFrame, points: DataFrame, family: Family, k: int, delta: float = 0.1, filter_type: str = "none", bits: int = 32, miss: float = 0.01) -> DataFrame:
    """``query_id, rank, id, dist``: ``k`` neighbours of each query, with the query's own id left out.

    A query is done at the longest prefix at which it has ``k`` candidates and a point as near as the k-th
    would have been missed with a chance of at most ``delta``; at prefix 0 every point is a candidate. Queries
    done at one level take no part in the next. Levels are searched in stages of one join each, which takes only pairs that the stages
    before did not have. ``filter_type`` simple or default, for cosine distances, drops new candidates by their
    sketches: the limit of a query follows from its k-th distance so far, so that a point as near is dropped with
    a chance of about ``miss``; a query without ``k`` so far drops nothing, and with default none with at most ``k`` new ones.
    """
    if filter_type not in FILTERS:
        raise ValueError(f"filter_type must be one of {FILTERS}")
    if filter_type != "none" and (family.metric != "cosine" or not 0 < miss < 1):
        raise ValueError("sketches are for cosine distances, and miss in (0, 1)")
    if points.count() < SMALL:
        return exact_neighbours(queries, points, family.metric, k)
    table = materialize(codes(points, family), "codes")
    asked = materialize(codes(queries, family).withColumnRenamed("vec_id", "query_id"), "queries")
    m, done, ids = metric(family.metric), None, queries.select(F.col("vec_id").alias("query_id")).distinct()
    left, total = ids, ids.count()
    x = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<float>").alias("_x"))
    y = points.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("_y"))
    if filter_type != "none":
        both = points.select("vec_id", "embedding").unionByName(queries.select("vec_id", "embedding")).dropDuplicates(["vec_id"])
        s = materialize(sketches(both, bits), "sketches")

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                d = m.rows(*(prepare(matrix(t.column(c)), m) for c in ("_x", "_y")))
                yield pa.RecordBatch.from_arrays([*t.columns[:3], pa.array(d)], names=["query_id", "id", "lcp", "dist"])

    held = None  # the nearest of every open query so far, with their prefix
    for high, low in _stages(_load(asked, table, family.depth), family.depth, k * total):
        a = asked.join(left, "query_id").select("query_id", "rep", F.col("code").alias("a"), cand.prefix_of("code", low).alias("key"))
        b = table.select(F.col("vec_id").alias("id"), "rep", F.col("code").alias("b"), cand.prefix_of("code", low).alias("key"))
        met = a.join(b, ["rep", "key"]).filter("query_id <> id").select("query_id", "id", cand.lcp("a", "b").alias("lcp"))
        met = met.groupBy("query_id", "id").agg(F.max("lcp").alias("lcp")).filter(F.col("lcp") <= high)
        if filter_type != "none" and held is not None:
            near = met.join(s.select(F.col("vec_id").alias("query_id"), F.col("sketch").alias("s1")), "query_id").join(s.select(F.col("vec_id").alias("id"), F.col("sketch").alias("s2")), "id")
            near = near.withColumn("diff", F.bit_count(F.col("s1").bitwiseXOR(F.col("s2")))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
            so_far = held.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"), F.max("dist").alias("kth"))
            near = near.join(so_far, "query_id", "left").withColumn("kth", F.when(F.col("have") >= k, F.col("kth")))
            keep = F.col("diff") <= most_difference(F.col("kth"), bits, miss)
            met = near.filter(keep | (F.col("n") <= k) if filter_type == "default" else keep).select("query_id", "id", "lcp")
        dist = met.join(x, "query_id").join(y, "id").select("query_id", "id", "lcp", "_x", "_y").mapInArrow(distances, "query_id long, id long, lcp int, dist double")
        if held is not None:
            dist = dist.unionByName(held.join(left, "query_id"))
        # what a level sees are the pairs with at least its prefix
        seen = dist.withColumn("prefix", F.explode(F.sequence(F.lit(low), F.least(F.col("lcp"), F.lit(high)))))
        whole = Window.partitionBy("query_id", "prefix")
        top = seen.withColumn("rank", F.row_number().over(whole.orderBy("dist", "id"))).filter(F.col("rank") <= k)
        top = top.withColumn("_n", F.max("rank").over(whole)).withColumn("_kth", F.max("dist").over(whole))
        ok = (F.col("prefix") == 0) | (F.col("_n") >= k) & (family.failure(F.col("_kth"), F.col("prefix")) <= delta)
        top = materialize(top.withColumn("ok", ok).withColumn("best", F.max(F.when(ok, F.col("prefix"))).over(Window.partitionBy("query_id"))), "top")
        held = top.filter((F.col("prefix") == low) & F.col("best").isNull()).select("query_id", "id", "lcp", "dist")
        level = top.filter(F.col("prefix") == F.col("best")).select("query_id", "rank", "id", "dist", "prefix")
        done = level if done is None else done.unionByName(level)
        if done.select(F.countDistinct("query_id")).first()[0] == total:
            break
        left = ids.join(done.select("query_id").distinct(), "query_id", "left_anti")
    return done.select("query_id", "rank", "id", "dist")


def closest_pairs(points: DataFrame, family: Family, k: int, recall: float = 0.9, switch: float | None = 1.0, digits: int | None = None) -> tuple[DataFrame, dict]:
    """The ``k`` closest pairs ``i, j, w`` and the figures of the last level: accepted at the longest prefix at which there are ``k`` and
    one as far as the k-th would have been missed with a chance of at most ``1 - recall``.

    A level compares only pairs that no longer prefix brought together in the same table. Where these are more, over all
    tables, than ``switch`` times all pairs, all pairs are compared in tiles instead (``path`` exact). With ``digits``
    weights are rounded before they are compared, so that copies tie."""
    if not 0 < recall <= 1:
        raise ValueError("the recall must be in (0, 1]")
    n = points.count()
    every = n * (n - 1) // 2
    exact = {"prefix": 0, "path": "exact", "compared": every, "fail": 0.0}
    if n < SMALL:
        return closest_pairs_exact(points, family.metric, k, digits=digits), exact
    table = hashed(points, family)
    top, before = None, 0
    for prefix in range(family.depth, 0, -1):
        load = cand.level_load(table, prefix)
        if load < min(k, every):
            continue
        work, before = load - before, load
        if switch is not None and work >= switch * every:
            break
        edges = bucket_closest(table, points, prefix, family.metric, k, digits, top is not None)
        top = materialize((edges if top is None else edges.unionByName(top).distinct()).orderBy("w", "i", "j").limit(k), "top")
        row = top.agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")).select("n", family.failure(F.col("w"), prefix).alias("fail")).first()
        if row.n == k and row.fail <= 1 - recall:
            return top.orderBy("w", "i", "j"), {"prefix": prefix, "path": "lsh", "compared": work, "fail": row.fail}
    return closest_pairs_exact(points, family.metric, k, digits=digits), exact
