"""A spanning tree that follows appended points, in batch and as a stream.

MSF(old + new) = MSF(tree of old + pairs of new with old + pairs among new), so every batch costs what its new
points cost against all points, not all pairs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.operators.msf import EDGE, msf
from graftline.operators.pairs import all_pairs_with
from graftline.session import scratch_path

POINTS = "vec_id long, embedding array<float>"


def append_points(tree: DataFrame, old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """The exact tree of both sets of points, from the exact tree of the old ones. Ids must differ."""
    edges = all_pairs_with(new, old.unionByName(new), name)
    return msf(tree.select("i", "j", "w").unionByName(edges))


class TreeStream:
    """State of a tree fed by ``foreachBatch``: ``writer(batch, id)`` folds a micro-batch in.

    The state lies in the folder ``where``: the new points of every batch in ``points/batch=<id>``, written once, and the tree
    after it in ``tree/<id>``, whose completion commits the batch; the tree before the last is deleted. A stream started again on the
    folder goes on after the last committed batch; a batch that comes again changes nothing, and what a batch wrote before
    it failed is overwritten. Points with null ids or vectors are left out, as are ids known before.
    """

    def __init__(self, spark: SparkSession, name: str = "euclidean", where: str | None = None):
        self.spark, self.name = spark, name
        self.where = where or scratch_path(spark, "stream")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @property
    def batches(self) -> list[int]:
        """Ids of the committed batches whose trees are kept."""
        folder = self._path(f"{self.where}/tree")
        if not self._fs.exists(folder):
            return []
        names = [int(f.getPath().getName()) for f in self._fs.listStatus(folder)]
        return sorted(n for n in names if self._fs.exists(self._path(f"{self.where}/tree/{n}/_SUCCESS")))

    @property
    def points(self) -> DataFrame:
        """The points of the committed batches."""
        last = self.batches
        if not last:
            return self.spark.createDataFrame([], POINTS)
        stored = self.spark.read.schema(f"{POINTS}, batch long").parquet(f"{self.where}/points")
        return stored.filter(F.col("batch") <= last[-1]).select("vec_id", "embedding")

    @property
    def tree(self) -> DataFrame:
        last = self.batches
        return self.spark.read.schema(EDGE).parquet(f"{self.where}/tree/{last[-1]}") if last else self.spark.createDataFrame([], EDGE)

    def writer(self, batch: DataFrame, batch_id: int) -> None:
        done = self.batches
        if done and batch_id <= done[-1]:
            return
        old, tree = self.points, self.tree
        fresh = batch.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"))
        target = f"{self.where}/points/batch={batch_id}"
        fresh.dropDuplicates(["vec_id"]).join(old.select("vec_id"), "vec_id", "left_anti").write.mode("overwrite").parquet(target)
        new = self.spark.read.schema(POINTS).parquet(target)
        after = tree if new.isEmpty() else append_points(tree, old, new, self.name)
        after.write.mode("overwrite").parquet(f"{self.where}/tree/{batch_id}")
        for n in done[:-1]:
            self._fs.delete(self._path(f"{self.where}/tree/{n}"), True)

    def start(self, stream: DataFrame, **trigger):
        """Start following a streaming DataFrame of points."""
        out = stream.writeStream.foreachBatch(self.writer).option("checkpointLocation", f"{self.where}/offsets")
        return (out.trigger(**trigger) if trigger else out).start()
