"""Stores of computed results: read what is there, compute and append only what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.session import materialize


class Store:
    """A Parquet table of rows under a key; the latest row of a key counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key"):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def load(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self.exists() else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> None:
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows.select(*names).write.mode("append").parquet(self.path)

    def missing(self, wanted: DataFrame) -> DataFrame:
        return wanted.join(self.load().select(self.key).distinct(), self.key, "left_anti")

    def fill(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The stored rows of ``wanted`` after computing the missing ones, which makes a broken run go on where it stopped."""
        gap = materialize(self.missing(wanted), "missing")
        if not gap.isEmpty():
            self.append(compute(gap))
        return self.load().join(wanted.select(self.key).distinct(), self.key, "left_semi")


def embeddings(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, "id string, vec array<double>", "id")


def pair_scores(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, "key string, score double")


def verdicts(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, "query_id string, key string, is_sufficient boolean, reasoning string")


def tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) saved by :func:`save_tree`, or None if there are none."""
    parts = [Store(spark, f"{path}/{name}", "node_id string") for name in ("nodes", "edges")]
    return (spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")) if all(p.exists() for p in parts) else None


def save_tree(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.withColumn("embedding", F.col("embedding").cast("array<double>")).write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
