"""Top N items within every group by statistics-guided skipping.

``cluster`` stores a table clustered by group: range-partitioned and sorted by (group, score, item) in
Parquet with small row groups. A hot group is cut over as many files as it needs, each holding a range
of its scores. ``top_n`` reads each file's row groups from the best score in the footer statistics to the
worst, and skips a row group if its best score is strictly worse than the current N-th score of every
group it contains. Equal scores are read, as ties are decided by the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graftline.llm.files import open_input
from graftline.session import scratch_path

ROW_GROUP_BYTES = 1 << 15  # in memory; small, so that a large group fills several row groups
ROW_GROUP_ITEMS = 64  # or so many times n items of 24 bytes, if that is more


def cluster(df: DataFrame, group: str, item: str, score: str, path: str, largest: bool = True, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write the distinct items of each group, at their best score, clustered for ``top_n``.

    Rows with a null group, item or score and NaN scores have no rank and are left out; -0.0 counts as
    0.0; of an item repeated in a group the best score stays. Repeats are combined before the first
    shuffle, and both shuffles split on more than the group, so no group ends up in one task.
    """
    key = F.col(score).cast("double") + F.lit(0.0)
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("item"), (-key if largest else key).alias("key"))
    rows = rows.filter("g is not null and item is not null and key is not null and not isnan(key)")
    best = rows.groupBy("g", "item").agg((F.min("key") + F.lit(0.0)).alias("key"))
    ranged = best.repartitionByRange("g", "key", "item").sortWithinPartitions("g", "key", "item")
    ranged.select("g", "key", "item").write.option("parquet.block.size", row_group_bytes).parquet(path)


def scan_file(uri: str, n: int) -> tuple[pa.Table | None, int, int]:
    """Candidates of one clustered file, and the numbers of row groups read and skipped."""
    with open_input(uri) as source:
        file = pq.ParquetFile(source)
        meta = file.metadata
        stats = []
        for r in range(meta.num_row_groups):
            g, key = (meta.row_group(r).column(c).statistics for c in (0, 1))
            known = g is not None and g.has_min_max and key is not None and key.has_min_max
            stats.append((key.min if known else -np.inf, r, g.min if known else None, g.max if known else None))
        # current best N keys of groups that reach beyond one row group; all others are complete when read
        nth: dict[object, np.ndarray] = {}
        kept, skipped = [], 0
        for best, r, low, high in sorted(stats, key=lambda s: (s[0], s[1])):
            if low is not None and low == high and len(held := nth.get(low, ())) == n and best > held[-1]:
                skipped += 1
                continue
            t = file.read_row_group(r)
            g = t.column("g").to_pandas().to_numpy()
            if not len(g):
                continue
            key = t.column("key").to_numpy()
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
            kept.append(t.filter(pa.array(rank < n)))
            for s, e in {(starts[0], starts[1] if len(starts) > 1 else len(g)), (starts[-1], len(g))}:
                nth[g[s]] = np.sort(np.r_[nth.get(g[s], ()), key[s : min(e, s + n)]])[:n]
    return (pa.concat_tables(kept) if kept else None), meta.num_row_groups - skipped, skipped


def _counts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [scan_file(uri, n)[1:] for uri in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*seen, strict=True))], names=["file", "n_read", "n_skipped"])

    return run


def scan_report(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``file, n_read, n_skipped``: row groups of every file that ``top_n`` reads and skips."""
    return file_list(spark, spark.read.parquet(path)).mapInArrow(_counts(n), "file string, n_read long, n_skipped long")


def _scan(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                found, _, _ = scan_file(uri, n)
                if found is not None:
                    yield from found.combine_chunks().to_batches()

    return run


def file_list(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """The files of a stored table, about one to a task."""
    names = sorted(stored.inputFiles())
    rows = spark.createDataFrame(pd.DataFrame({"file": pd.Series(names, dtype="object")}), "file string")
    return rows.repartition(max(1, min(len(names), 10_000)))


def top_n(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``g, item, key, rank``: the first ``n`` items of each group by key, then by item."""
    if n < 1:
        raise ValueError("n must be at least 1")
    stored = spark.read.parquet(path)
    found = file_list(spark, stored).mapInArrow(_scan(n), stored.select("g", "key", "item").schema)
    order = Window.partitionBy("g").orderBy("key", "item")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, largest: bool = True) -> DataFrame:
    """The ``n`` best items of each group: ``group, item, score, rank``.

    Ties go to the smaller item. Null groups, items and scores and NaN scores are not ranked, an item
    counts once in its group at its best score, and other columns are ignored. An empty table gives no rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "clustered")
    cluster(df, group, item, score, path, largest, max(ROW_GROUP_BYTES, 24 * ROW_GROUP_ITEMS * n))
    key = -F.col("key") if largest else F.col("key")
    return top_n(spark, path, n).select(F.col("g").alias(group), F.col("item").alias(item), (key + F.lit(0.0)).alias(score), "rank")
