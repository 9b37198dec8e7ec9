"""The given tables as the operators take them: latest rows, whole texts, the stated query set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions import text as X
from leafline.schemas import CATEGORIES, DIFFICULTIES
from leafline.session import latest_rows, materialize, table

LAST = (1 << 63) - 1
#: Of searches, every query whose number is divisible by this is asked, against all rows.
ASKED = 50


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(id, document_id, content, pos, tokens): latest chunks with at least one word; tokens are words."""
    rows = latest_rows(table(spark, folder, "chunks"), "id", "ingested_at", "document_id", "content", "pos")
    rows = rows.select("id", "document_id", "content", F.coalesce("pos", F.lit(LAST)).alias("pos"), X.word_count(F.col("content")).alias("tokens"))
    return rows.where("tokens > 0")


def chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, content, pos) of :func:`chunks`, whose words are not counted to tell whether there is one."""
    rows = latest_rows(table(spark, folder, "chunks"), "id", "ingested_at", "document_id", "content", "pos")
    return rows.where(F.col("content").rlike(r"[^ \t\r\n\f]")).select("id", "content", F.coalesce("pos", F.lit(LAST)).alias("pos"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, source, content): latest corpus documents with at least one word."""
    rows = latest_rows(table(spark, folder, "corpus_documents"), "id", "ingested_at", "source", "content")
    return rows.select("id", "source", "content").where(X.word_count(F.col("content")) > 0)


def label(c: str, known: list[str]) -> Column:
    """A category or difficulty in one spelling; ``other`` for anything unknown."""
    plain = F.regexp_replace(F.lower(X.strip(F.col(c))), "[ _-]+", "_")
    return F.when(plain.isin(known), plain).otherwise(F.lit("other"))


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, suite_id, text, category, difficulty, feasible, gold): the latest row of every query."""
    rows = latest_rows(
        table(spark, folder, "queries"), "id", "created_at", "suite_id", "text", "category", "difficulty", "budget_feasible_400", "gold_chunk_ids"
    )
    return rows.select(
        F.col("id").alias("query_id"), "suite_id", "text", label("category", CATEGORIES).alias("category"), label("difficulty", DIFFICULTIES).alias("difficulty"),
        F.col("budget_feasible_400").alias("feasible"), F.array_compact(F.array_distinct("gold_chunk_ids")).alias("gold"),
    )


def asked(spark: SparkSession, folder: str) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(query_id, '([0-9]+)$', 1) AS bigint)")
    return materialize(queries(spark, folder).where(number % ASKED == 0), "asked")


def every_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of :func:`queries`, for what is asked of the whole table."""
    return materialize(queries(spark, folder), "queries")


def gold(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.explode("gold").alias("chunk_id"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, label, vec, pos) of the embeddings table."""
    rows = table(spark, folder, "embeddings").where("embedding IS NOT NULL")
    return rows.select(F.col("vec_id").cast("string").alias("chunk_id"), "label", F.col("embedding").cast("array<double>").alias("vec"), F.col("vec_id").cast("long").alias("pos"))


def asked_vectors(rows: DataFrame) -> DataFrame:
    """(query_id, vec, label, self): every vector whose id is divisible by 50 asks for the others."""
    return rows.where(F.col("pos") % ASKED == 0).select(F.concat(F.lit("q"), "chunk_id").alias("query_id"), "vec", "label", F.col("chunk_id").alias("self"))
