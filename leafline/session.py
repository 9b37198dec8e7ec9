"""Shared scratch storage, latest-row selection and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []
#: A side is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 20_000


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where that is unset a local session gets a new temporary
    one; on a cluster, whose machines would not share it, that is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="leafline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which :func:`clear_scratch` empties."""
    path = f"{scratch_root(spark)}/leafline-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str = "t", **seen: Column) -> DataFrame:
    """Cut the lineage: write ``df`` to a table in the shared folder and read that table back.

    The files outlive any executor, so a lost executor never forces earlier rounds of a loop to run again. Aggregates
    given as ``seen`` are taken while the rows are written, without a job of their own: see :func:`seen_value`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    watch = Observation()
    (df.observe(watch, *[c.alias(k) for k, c in seen.items()]) if seen else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafline_path, out._leafline_seen = path, watch.get if seen else {}
    return out


def seen_value(df: DataFrame, name: str):
    """A value that :func:`materialize` took along; a retried task cannot count twice, as only a table's last stage is watched."""
    return df._leafline_seen[name]


def drop_table(df: DataFrame | None) -> None:
    """Delete the files of a table that :func:`materialize` wrote and nothing reads any more."""
    path = getattr(df, "_leafline_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete all tables that this process wrote; call it when their results have been read. Returns their number."""
    paths = list(_WRITTEN)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _WRITTEN:
        _WRITTEN.remove(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def latest_rows(df: DataFrame, key: str, time: str, *columns: str) -> DataFrame:
    """One row for each non-null ``key``: the row with the largest ``time`` (null times are the oldest).

    A maximum over structs combines on the map side, so a key with very many versions is reduced before
    the shuffle. Rows with the same time are ordered by the remaining columns, so the result is defined.
    """
    columns = columns or tuple(c for c in df.columns if c not in (key, time))
    # fields are named by position: the table may hold a column of any name
    fields = [F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate([time, *columns])]
    rows = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("k"), F.struct(*fields).alias("v")).groupBy("k").agg(F.max("v").alias("v"))
    return rows.select(F.col("k").alias(key), *[F.col(f"v.f{i + 1}").alias(c) for i, c in enumerate(columns)], F.col("v.f0").alias(time))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the (materialised or cheap) side has at most ``limit`` rows, else leave it to AQE."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
