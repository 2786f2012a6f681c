"""Collision, recall and tree logs as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLLISIONS = "i int, j int, edge1 long, edge2 long, distance double"
RECALLS = "name string, rep int, recall double, w0 double, w1 double, w2 double"


def write_collisions(df: DataFrame, path: str) -> None:
    """Append collisions as CSV without a header."""
    df.select("i", "j", "edge1", "edge2", "distance").write.mode("append").csv(path)


def read_collisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLLISIONS).csv(path)


def write_recalls(df: DataFrame, path: str) -> None:
    df.select("name", "rep", "recall", "w0", "w1", "w2").write.mode("append").option("sep", ", ").csv(path)


def read_recalls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECALLS).option("sep", ", ").csv(path)


def write_tree(edges: DataFrame, path: str) -> None:
    """One edge ``u v`` a line."""
    edges.select("i", "j").write.mode("append").option("sep", " ").csv(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("i long, j long").option("sep", " ").csv(path)
