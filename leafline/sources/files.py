"""Text directories and corpora as sources, and result tables as sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.functions import text as X
from leafline.schemas import CHUNK, QUERY
from leafline.session import materialize

SUFFIXES = ("md", "txt", "rst")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``n`` from 0 in the given order: rows are range-partitioned and sorted, ranges numbered by their counts."""
    ranged = materialize(rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # a row per partition
    offsets = sizes.select("_p", (F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_c")).alias("_o"))
    inside = W.partitionBy("_p").orderBy(*order)
    return ranged.join(F.broadcast(offsets), "_p").withColumn("n", F.col("_o") + F.row_number().over(inside) - 1).drop("_p", "_o")


def read_text_folder(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """(id, source, content, metadata) of every .md, .txt and .rst file below ``folder``, in path order.

    Content is stripped, blank files are left out; ids number the files that are kept (``source-00000``). A missing
    folder is an error.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    root = F.lit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/"))
    path = F.col("_metadata.file_path")
    local = F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), "^[a-z0-9]+:/+", "/")
    rows = files.select(X.strip(F.col("value")).alias("content"), local.alias("p"), root.alias("r"))
    rows = rows.withColumn("path", F.expr("substring(p, length(r) + 2)")).where(F.lower("path").rlike(rf"\.({'|'.join(SUFFIXES)})$") & (F.col("content") != ""))
    return numbered(rows.select("path", "content"), "path").select(
        F.format_string(f"{source}-%05d", "n").alias("id"), F.lit(source).alias("source"), "content", F.create_map(F.lit("path"), F.col("path")).alias("metadata")
    )


def select_articles(articles: DataFrame, target: int, seed: int = 42, keywords: list[str] | None = None, least: int = 500, most: int = 10_000) -> DataFrame:
    """(id, source, content, metadata) of ``target`` articles (title, text) in seeded hash order: of fitting length, on a
    topic by title or first 500 characters, cleaned, and numbered in the order they are taken."""
    n = X.word_count(F.col("text"))
    topic = X.matches_keywords(F.concat_ws(" ", "title", F.substring("text", 1, 500)), keywords)
    fit = articles.where(n.between(least, most) & topic).select("title", X.clean_article(F.col("text")).alias("content"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "title", "content"))
    taken = fit.withColumn("_k", key).orderBy("_k", "title").limit(target)
    return numbered(taken, "_k", "title").select(
        F.format_string("wikipedia-%05d", "n").alias("id"), F.lit("wikipedia").alias("source"), "content", F.create_map(F.lit("title"), F.col("title")).alias("metadata")
    )


def preset(scale: str, handbook: DataFrame, articles: DataFrame | None = None, small: int = 50) -> DataFrame:
    """The corpora of a scale: ``small`` (the first documents), ``medium`` (all), ``large`` (all and the articles)."""
    if scale == "small":
        return handbook.orderBy("id").limit(small)
    if scale == "medium":
        return handbook
    if scale == "large" and articles is not None:
        return handbook.unionByName(articles)
    raise ValueError(f"unknown scale {scale!r}, or no articles given")


def read_chunks(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Chunks from Parquet or JSON (lines, or one array); the first ``most`` in corpus order if asked for."""
    rows = spark.read.schema(CHUNK).json(path, multiLine=True) if path.rstrip("/").endswith(".json") else spark.read.parquet(path)
    return rows if most is None else rows.orderBy("pos", "id").limit(most)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY).json(path, multiLine=True)


def write_table(df: DataFrame, path: str, form: str = "parquet", digits: int | None = None) -> None:
    """A result table; with ``digits`` all doubles are rounded first."""
    if digits is not None:
        df = df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
    df.write.mode("overwrite").format(form).save(path)
