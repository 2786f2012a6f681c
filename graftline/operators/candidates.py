"""Similarity self-joins by hash prefixes: candidate pairs, their common prefixes, buckets and reductions.

Buckets nest: shortening a prefix only merges them. So a pair met at prefix i is a pair whose longest common
prefix (lcp) in some table is at least i, and what is new at i are the pairs with exactly i.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.functions.vectors import metric, prepare
from graftline.operators.pairs import matrix
from graftline.session import materialize, parallelism


def prefix_of(code: Column | str, prefix: int) -> Column:
    """The first ``prefix`` symbols; at 0 every code has the same."""
    if prefix < 0:
        raise ValueError("the prefix must not be negative")
    return F.slice(code, 1, prefix) if prefix else F.array().cast("array<long>")


def lcp(a: Column | str, b: Column | str) -> Column:
    """Length of the common prefix of two codes of equal length."""
    same = F.zip_with(a, b, lambda x, y: x == y)
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


HOT = 4096  # points of a bucket; a fuller one is cut so that no task gets all its pairs


def met(codes: DataFrame, prefix: int, new: bool = False, hot: int = HOT) -> DataFrame:
    """``rep, key, i, j, a_code, b_code``: pairs i < j of every table that share a bucket at ``prefix``, with ``new`` only those
    whose next symbols differ. The pairs of a bucket above ``hot`` are spread: one side is cut, the other copied to the cuts."""
    keyed = codes.withColumn("key", prefix_of("code", prefix))
    sizes = keyed.groupBy("rep", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
    cuts = F.coalesce(F.ceil(F.col("n") / hot).cast("int"), F.lit(1))
    sized = keyed.join(sizes, ["rep", "key"], "left").withColumn("_cuts", cuts)
    a = sized.select("rep", "key", F.pmod(F.xxhash64("vec_id"), F.col("_cuts")).cast("int").alias("cut"), F.col("vec_id").alias("i"), F.col("code").alias("a_code"))
    b = sized.select("rep", "key", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1)).alias("cut"), F.col("vec_id").alias("j"), F.col("code").alias("b_code"))
    pairs = a.join(b, ["rep", "key", "cut"]).filter("i < j").drop("cut")
    return pairs.filter(F.element_at("a_code", prefix + 1) != F.element_at("b_code", prefix + 1)) if new else pairs


def pair_lcp(codes: DataFrame, prefix: int) -> DataFrame:
    """``i, j, lcp``: pairs that share ``prefix`` symbols in some table, with their longest common prefix."""
    return met(codes, prefix).select("i", "j", lcp("a_code", "b_code").alias("lcp")).groupBy("i", "j").agg(F.max("lcp").alias("lcp"))


def prefix_pairs(codes: DataFrame, prefix: int) -> DataFrame:
    """``i, j``: pairs that share a bucket at ``prefix`` in some table."""
    return met(codes, prefix).select("i", "j").distinct()


def new_pairs(codes: DataFrame, prefix: int, depth: int | None = None) -> DataFrame:
    """``i, j``: pairs that first share a bucket at ``prefix``, not at any longer one.

    Below the full depth only pairs from different buckets of the next prefix are formed, and those that another
    table brought together before are taken out.
    """
    depth = depth if depth is not None else codes.select(F.size("code")).first()[0] if not codes.isEmpty() else prefix
    if prefix >= depth:
        return prefix_pairs(codes, prefix)
    return met(codes, prefix, True).select("i", "j").distinct().join(met(codes, prefix + 1).select("i", "j").distinct(), ["i", "j"], "left_anti")


def unconnected(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components of ``vec_id, comp``."""
    a = labels.select(F.col("vec_id").alias("i"), F.col("comp").alias("ci"))
    b = labels.select(F.col("vec_id").alias("j"), F.col("comp").alias("cj"))
    return pairs.join(a, "i").join(b, "j").filter("ci <> cj").drop("ci", "cj")


def weigh(pairs: DataFrame, points: DataFrame, name: str) -> DataFrame:
    """``i, j, w`` of pairs of ids; other columns of the pairs stay. Distances are computed by rows of Arrow batches."""
    m = metric(name)
    a = points.select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<float>").alias("_x"))
    b = points.select(F.col("vec_id").alias("j"), F.col("embedding").cast("array<float>").alias("_y"))
    keep = pairs.columns
    schema = T.StructType([*(pairs.schema[c] for c in keep), T.StructField("w", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                w = m.rows(*(prepare(matrix(t.column(c)), m) for c in ("_x", "_y")))
                yield pa.RecordBatch.from_arrays([*(t.column(c) for c in keep), pa.array(w)], names=schema.names)

    return pairs.join(a, "i").join(b, "j").select(*keep, "_x", "_y").mapInArrow(run, schema)


def bucket_sizes(codes: DataFrame, prefix: int) -> DataFrame:
    """``rep, key, n``: points of every bucket at ``prefix``."""
    return codes.groupBy("rep", prefix_of("code", prefix).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def bucket_runs(codes: DataFrame) -> DataFrame:
    """``rep, vec_id, bucket``: number of the run of equal full codes in the sorted table."""
    order = Window.partitionBy("rep").orderBy("code", "vec_id")
    changed = F.coalesce((F.col("code") != F.lag("code").over(order)).cast("long"), F.lit(0).cast("long"))
    return codes.withColumn("_c", changed).withColumn("bucket", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).select("rep", "vec_id", "bucket")


def level_load(codes: DataFrame, prefix: int) -> int:
    """Pairs in the buckets at a prefix, over all tables, repeated ones counted each time."""
    sizes = codes.select(F.xxhash64("rep", prefix_of("code", prefix)).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return int(sizes.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0)


def confirm(edges: DataFrame, family, prefix: int, delta: float, seen: int | None = None) -> DataFrame:
    """Add ``fail`` and ``confirmed``: whether the chance that such a pair was missed is below ``delta``."""
    fail = family.failure(F.col("w"), prefix, seen)
    return edges.withColumn("fail", fail).withColumn("confirmed", F.col("fail") < F.lit(delta))


def bound_weight(edges: DataFrame) -> DataFrame:
    """``n_edges, n_confirmed, weight, bound``: the bound is the confirmed weight plus the heaviest confirmed edge
    for every unconfirmed one; 0 if none is confirmed."""
    sure = F.col("confirmed")
    total, top = F.sum(F.when(sure, F.col("w")).otherwise(0.0)), F.max(F.when(sure, F.col("w")).otherwise(0.0))
    open_ = F.count(F.when(~sure, 1))
    return edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count(F.when(sure, 1)).alias("n_confirmed"), F.sum("w").alias("weight"), (total + top * open_).alias("bound"))


def cap_unconfirmed(edges: DataFrame, per_table: int, part: str = "rep") -> DataFrame:
    """Confirmed edges and the ``per_table`` lightest unconfirmed ones of each table. Lossy, so only on request."""
    order = Window.partitionBy(part, "confirmed").orderBy("w", "i", "j")
    return edges.withColumn("_r", F.row_number().over(order)).filter(F.col("confirmed") | (F.col("_r") <= per_table)).drop("_r")


def spread_key(*columns: str, seed: int) -> Column:
    """A seeded pseudo-random order that any engine can compute: md5 of the values."""
    return F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def reservoir(pairs: DataFrame, size: int, by: list[str], seed: int = 0) -> DataFrame:
    """A uniform sample of ``size`` pairs of every bucket, the same in every run. Only on request."""
    order = Window.partitionBy(*by).orderBy(spread_key("i", "j", seed=seed), "i", "j")
    return pairs.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= size).drop("_r")


def bernoulli(pairs: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Pairs kept independently with probability ``share``, the same in every run. Only on request."""
    if not 0 <= share <= 1:
        raise ValueError("the share must be from 0 to 1")
    value = F.conv(F.substring(spread_key("i", "j", seed=seed), 1, 8), 16, 10).cast("long")
    return pairs.filter(value < int(share * 2**32))


def random_path(points: DataFrame, seed: int = 0) -> DataFrame:
    """``i, j``: a spanning path through the points in pseudo-random order.

    Partitions hold ranges of the order; each links its own rows, and the first of each, one row a partition, is
    linked to the last of the one before.
    """
    spark = points.sparkSession
    ranged = points.select(spread_key("vec_id", seed=seed).alias("key"), F.col("vec_id").cast("long").alias("v")).repartitionByRange(parallelism(spark), "key", "v").sortWithinPartitions("key", "v")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for t in batches:
            if not t.num_rows:
                continue
            v = t.column(1).to_numpy()
            first = v[0] if first is None else first
            v = v if last is None else np.r_[last, v]
            last = v[-1]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(v) - 1, pa.int32()), pa.array(v[:-1]), pa.array(v[1:])], names=["part", "a", "b"])
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.int64()), pa.array([last], pa.int64())], names=["part", "a", "b"])

    found = materialize(ranged.mapInArrow(inner, "part int, a long, b long"), "path")
    ends = found.filter("part is not null").withColumn("next", F.lead("a").over(Window.orderBy("part"))).filter("next is not null").select(F.col("b").alias("a"), F.col("next").alias("b"))
    both = found.filter("part is null").select("a", "b").unionByName(ends)
    return both.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
