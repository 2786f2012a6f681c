"""Per-key results and joins when a few keys hold most rows: fragment-replicate by estimated load.

The load of every key is its row count. Keys above a quarter of a task's fair share are *heavy*; there
are at most four per task, so only those and a fixed number of hash buckets of the light keys reach the
driver. There they are packed into tasks, largest first into the emptiest task; a key larger than a
fair share is first cut into shards in proportion to its load. The packing table is bounded by
``20 * tasks`` rows plus one per shard and is therefore safe to broadcast.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.session import materialize, parallelism

BUCKETS_PER_TASK = 16
HEAVY_SHARE = 0.25


def pack(loads: Sequence[tuple[object, int]], tasks: int) -> list[tuple[object, int, int, int]]:
    """Pack items into tasks: rows ``(item, shards, shard, task)``.

    An item above the fair share becomes ``ceil(load / fair)`` shards. Ties go to the item that comes
    first and to the lower task.
    """
    fair = max(1.0, sum(n for _, n in loads) / tasks)
    parts = []
    for order, (item, n) in enumerate(loads):
        shards = max(1, math.ceil(n / fair))
        parts += [(-n / shards, order, shard, item, shards) for shard in range(shards)]
    bins = [(0.0, t) for t in range(tasks)]
    heapq.heapify(bins)
    out = []
    for load, _, shard, item, shards in sorted(parts, key=lambda x: x[:3]):
        filled, task = heapq.heappop(bins)
        out.append((item, shards, shard, task))
        heapq.heappush(bins, (filled - load, task))
    return out


def _task_salts(spark: SparkSession, tasks: int) -> list[int]:
    """For each task t an integer that Spark's hash partitioning sends to partition t of ``tasks``."""
    tries = int(tasks * (math.log(tasks + 1) + 12)) + 64
    rows = (
        spark.range(tries)
        .select(F.col("id").cast("int").alias("s"))
        .groupBy(F.pmod(F.hash("s"), F.lit(tasks)).alias("t"))
        .agg(F.min("s").alias("s"))
        .collect()
    )
    found = {r.t: r.s for r in rows}
    if len(found) < tasks:
        raise RuntimeError("no salt for some task")
    return [found[t] for t in range(tasks)]


class LoadPlan:
    """Where the rows of each key go: ``shards`` per key and a task for each shard."""

    def __init__(self, df: DataFrame, keys: Sequence[str], tasks: int | None = None):
        self.spark, self.keys = df.sparkSession, list(keys)
        self.tasks = tasks or parallelism(self.spark)
        self.buckets = BUCKETS_PER_TASK * self.tasks
        loads = materialize(df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n")), "loads")
        self.total = loads.agg(F.sum("_n")).first()[0] or 0
        limit = max(1.0, HEAVY_SHARE * self.total / self.tasks)
        heavy = F.col("_n") > limit
        named = [F.when(heavy, F.col(k)).alias(k) for k in self.keys]
        light = F.when(~heavy, self.bucket()).alias("_bucket")
        items = loads.select(*named, light, "_n").groupBy(*self.keys, "_bucket").agg(F.sum("_n").alias("_n"))
        rows = sorted(items.collect(), key=lambda r: (-r["_n"], str(r)))
        packed = pack([(tuple(r)[:-1], r["_n"]) for r in rows], self.tasks)
        salts = _task_salts(self.spark, self.tasks)
        types = {f.name: f.dataType for f in df.schema.fields}
        schema = T.StructType(
            [T.StructField(k, types[k]) for k in self.keys]
            + [T.StructField(c, T.IntegerType()) for c in ("_bucket", "_shards", "_shard", "_salt")]
        )
        self.rows = [(*item, shards, shard, salts[task]) for item, shards, shard, task in packed]
        self.table = self.spark.createDataFrame(self.rows, schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _sized(self, df: DataFrame) -> DataFrame:
        """Add ``_bucket`` (null for heavy keys) and ``_shards``."""
        heavy = self.table.filter("_bucket is null").select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(self.keys)], F.col("_shards").alias("_hs")).distinct()
        on = [df[k].eqNullSafe(heavy[f"_k{n}"]) for n, k in enumerate(self.keys)]
        joined = df.join(F.broadcast(heavy), on, "left").drop(*[f"_k{n}" for n in range(len(self.keys))])
        light = self.table.filter("_bucket is not null").select(F.col("_bucket").alias("_b"), F.col("_shards").alias("_ls")).distinct()
        joined = joined.withColumn("_bucket", F.when(F.col("_hs").isNull(), self.bucket()))
        joined = joined.join(F.broadcast(light), F.col("_bucket") == F.col("_b"), "left").drop("_b")
        return joined.withColumn("_shards", F.coalesce("_hs", "_ls", F.lit(1))).drop("_hs", "_ls")

    def _salted(self, df: DataFrame) -> DataFrame:
        """Add ``_salt``, the hash key of the task, to rows that know their shard."""
        plan = self.table.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(self.keys)], F.col("_bucket").alias("_b"), F.col("_shard").alias("_s"), "_salt")
        heavy, light = plan.filter("_b is null"), plan.filter("_b is not null")
        on = [df[k].eqNullSafe(heavy[f"_k{n}"]) for n, k in enumerate(self.keys)] + [df["_shard"] == heavy["_s"]]
        out = df.join(F.broadcast(heavy.drop("_b").withColumnRenamed("_salt", "_hs")), on, "left").drop("_s", *[f"_k{n}" for n in range(len(self.keys))])
        light = light.select(F.col("_b"), F.col("_s"), F.col("_salt").alias("_ls"))
        out = out.join(F.broadcast(light), (out["_bucket"] == light["_b"]) & (out["_shard"] == light["_s"]), "left").drop("_b", "_s")
        return out.withColumn("_salt", F.coalesce("_hs", "_ls", F.lit(0))).drop("_hs", "_ls")

    def fragment(self, df: DataFrame, by: Sequence[str]) -> DataFrame:
        """Send each row to one shard of its key, chosen by the hash of columns ``by``."""
        sized = self._sized(df)
        # a light bucket above the fair share is cut between its keys, so that none of them is split
        spread = F.when(F.col("_bucket").isNull(), F.xxhash64(*by)).otherwise(F.xxhash64(*self.keys, F.lit(1)))
        return self._salted(sized.withColumn("_shard", F.pmod(spread, F.col("_shards")).cast("int")))

    def replicate(self, df: DataFrame) -> DataFrame:
        """Send each row of the matching side to all shards of its key, and no others."""
        sized = self._sized(df)
        one = F.array(F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.col("_shards")).cast("int"))
        all_ = F.sequence(F.lit(0), F.col("_shards") - 1)
        return sized.withColumn("_shard", F.explode(F.when(F.col("_bucket").isNull(), all_).otherwise(one)))


def _combine(names: list[str], sums: list[str], limit: int):
    """Arrow map-side combine: sums per distinct ``names``, flushed whenever ``limit`` rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            done = pa.concat_tables(held).group_by(names, use_threads=False).aggregate([(c, "sum") for c in sums])
            done = done.select([*names, *[f"{c}_sum" for c in sums]]).rename_columns([*names, *sums])
            held[:] = [done]

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= limit:
                flush()
                rows = held[0].num_rows
                if rows * 2 >= limit:  # hardly anything was combined
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            flush()
            yield from held[0].to_batches()

    return run


def plan_per_key(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> LoadPlan:
    """The plan of ``per_key``; its ``total`` is the number of rows."""
    return LoadPlan(df.select(*[F.col(c).alias(f"k{n}") for n, c in enumerate(keys)]), [f"k{n}" for n in range(len(keys))], tasks)


def per_key(df: DataFrame, keys: Sequence[str], pair: Sequence[str], value: str, usable: Column | None = None, tasks: int | None = None, combine_rows: int = 1_000_000, plan: LoadPlan | None = None) -> DataFrame:
    """Lines, distinct pairs and mean of ``value`` for each key, with no task far above its fair share.

    Output: the keys, ``n_lines`` (all rows), ``n_pairs`` (distinct combinations of ``pair``, in the given
    order; combinations with a null don't count), ``mean_value`` (of rows that satisfy ``usable``; null
    without any). Null keys form keys of their own, as in GROUP BY; an empty table gives no rows; columns
    other than those named are ignored. A heavy key is cut into shards by the hash of its pair, so distinct
    pairs add up over shards; repeats of one pair are combined before the shuffle and can't pile up.
    """
    k, p = [f"k{n}" for n in range(len(keys))], [f"p{n}" for n in range(len(pair))]
    ok = F.coalesce(F.lit(True) if usable is None else usable, F.lit(False)) & F.col(value).isNotNull()
    rows = df.select(
        *[F.col(c).alias(a) for c, a in zip(keys, k, strict=True)],
        *[F.col(c).alias(a) for c, a in zip(pair, p, strict=True)],
        F.lit(1).cast("long").alias("n"),
        F.when(ok, F.col(value).cast("double")).otherwise(0.0).alias("total"),
        F.when(ok, 1).otherwise(0).cast("long").alias("used"),
    )
    plan = plan or plan_per_key(df, keys, tasks)
    placed = plan.fragment(rows, p).select("_salt", "_shard", *k, *p, "n", "total", "used")
    names, sums = ["_salt", "_shard", *k, *p], ["n", "total", "used"]
    partial = placed.mapInArrow(_combine(names, sums, combine_rows), placed.schema)
    # hash partitioning on the salt puts every shard into its task; the three aggregations below need no other exchange
    by_pair = partial.repartition(plan.tasks, "_salt").groupBy(*names).agg(*[F.sum(c).alias(c) for c in sums])
    whole = F.lit(1)
    for c in p:
        whole = F.when(F.col(c).isNull(), 0).otherwise(whole)
    by_shard = by_pair.groupBy("_salt", "_shard", *k).agg(*[F.sum(c).alias(c) for c in sums], F.sum(whole).alias("pairs"))
    out = by_shard.groupBy(*k).agg(*[F.sum(c).alias(c) for c in (*sums, "pairs")])
    return out.select(
        *[F.col(a).alias(c) for c, a in zip(keys, k, strict=True)],
        F.col("n").alias("n_lines"),
        F.col("pairs").alias("n_pairs"),
        F.when(F.col("used") > 0, F.col("total") / F.col("used")).alias("mean_value"),
    )


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner", tasks: int | None = None) -> DataFrame:
    """Equi-join of a skewed ``left`` with ``right``: heavy keys are cut into shards by the hash of ``by``
    and the matching rows of ``right`` are copied to those shards only.

    ``how`` is inner or left. Null keys match nothing, as in SQL. Columns of ``right`` that clash with
    ``left`` (other than the keys) get the suffix ``_right``. Both sides are partitioned by the packed task
    alone; so that the join keeps to that, Spark's wish for all keys in the partitioning is turned off for the session.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    plan = LoadPlan(left, keys, tasks)
    plan.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    right = right.select(*[F.col(c).alias(f"{c}_right" if c in clash else c) for c in right.columns])
    a = plan.fragment(left, by).drop("_shards", "_bucket").repartition(plan.tasks, "_salt")
    b = plan._salted(plan.replicate(right)).drop("_shards", "_bucket").repartition(plan.tasks, "_salt")
    return a.join(b.hint("merge"), ["_salt", *keys, "_shard"], how).drop("_shard", "_salt")
