"""Points and their hash codes on disk: save, load, build or load, extend, look up, compare."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.functions.families import E2LSH, CrossPolytope, Family, SimHash, codes

_KINDS = {c.__name__: c for c in (SimHash, E2LSH, CrossPolytope)}


class Index:
    """Points ``vec_id, embedding`` with their ``codes``, one Parquet folder per table when saved."""

    def __init__(self, points: DataFrame, family: Family, table: DataFrame | None = None):
        self.points, self.family = points.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")), family
        self.codes = codes(self.points, family) if table is None else table

    def insert(self, new: DataFrame) -> Index:
        """An index with the points whose ids aren't there yet; only these are hashed."""
        fresh = new.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).join(self.points.select("vec_id"), "vec_id", "left_anti")
        return Index(self.points.unionByName(fresh), self.family, self.codes.unionByName(codes(fresh, self.family)))

    def save(self, path: str) -> None:
        """Write to a new folder; an existing one is an error."""
        spark = self.points.sparkSession
        fields = {k: getattr(self.family, k) for k in self.family.__dataclass_fields__}
        meta = json.dumps({"kind": type(self.family).__name__, **fields})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("errorifexists").text(f"{path}/meta")
        self.points.write.mode("errorifexists").parquet(f"{path}/points")
        self.codes.write.mode("errorifexists").partitionBy("rep").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        family = _KINDS[meta.pop("kind")](**meta)
        table = spark.read.schema("vec_id long, code array<long>, rep int").parquet(f"{path}/codes").select("vec_id", "rep", "code")
        return cls(spark.read.parquet(f"{path}/points"), family, table)

    @classmethod
    def load_or_build(cls, points: DataFrame, family: Family, path: str) -> Index:
        """The saved index, or a new one (not saved) if there is none."""
        spark = points.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return cls.load(spark, path) if fs.exists(where) else cls(points, family)

    def get(self, vec_id: int) -> DataFrame:
        return self.points.filter(F.col("vec_id") == vec_id)

    def code_of(self, vec_id: int, rep: int) -> DataFrame:
        return self.codes.filter((F.col("vec_id") == vec_id) & (F.col("rep") == rep))

    def describe(self) -> dict:
        return {"points": self.points.count(), "repetitions": self.family.repetitions, "depth": self.family.depth, "family": self.family.describe()}

    def equals(self, other: Index) -> bool:
        """Whether family, points and codes agree."""
        if self.family != other.family:
            return False
        pairs = ((self.points, other.points), (self.codes, other.codes))
        return all(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in pairs)
