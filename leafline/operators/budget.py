"""Greedy packing of a ranking into a token budget: items that overflow are skipped, smaller ones still tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.functions.vec import dot


def _ordered(ranking: DataFrame, *columns: str) -> DataFrame:
    """One sorted array per query; rankings are cut to their top before, which bounds the array."""
    return ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "tokens", *columns))).alias("items"))


def pack_budget(ranking: DataFrame, budget: Column | int) -> DataFrame:
    """(query_id, tokens_used, chunk_ids) from (query_id, chunk_id, rank, tokens), in rank order."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(acc: Column, item: Column) -> Column:
        used = acc["used"] + item["tokens"]
        taken = F.struct(used.alias("used"), F.concat(acc["ids"], F.array(item["chunk_id"])).alias("ids"))
        return F.when(used <= limit, taken).otherwise(acc)

    folded = _ordered(ranking).withColumn("p", F.aggregate("items", start, step))
    return folded.select("query_id", F.col("p.used").alias("tokens_used"), F.col("p.ids").alias("chunk_ids"))


def pack_curve(ranking: DataFrame, budgets: list[int]) -> DataFrame:
    """(query_id, budget, tokens_used, chunk_ids): every budget over the same sorted arrays, without another shuffle."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))
    listed = _ordered(ranking).select("query_id", "items", F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget"))

    def step(acc: Column, item: Column) -> Column:
        used = acc["used"] + item["tokens"]
        taken = F.struct(used.alias("used"), F.concat(acc["ids"], F.array(item["chunk_id"])).alias("ids"))
        return F.when(used <= F.col("budget"), taken).otherwise(acc)

    folded = listed.withColumn("p", F.aggregate("items", start, step))
    return folded.select("query_id", "budget", F.col("p.used").alias("tokens_used"), F.col("p.ids").alias("chunk_ids"))


def pack_diverse(ranking: DataFrame, budget: int, penalty: float = 0.3) -> DataFrame:
    """As :func:`pack_budget` over (.., score, vec): an item whose score less ``penalty`` times its largest product with
    a taken item is negative is dropped, once something is taken. The penalty never changes the order."""
    start = F.struct(
        F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"), F.array().cast("array<array<double>>").alias("vecs")
    )

    def step(acc: Column, item: Column) -> Column:
        used = acc["used"] + item["tokens"]
        near = F.aggregate(acc["vecs"], F.lit(0.0), lambda m, v: F.greatest(m, dot(v, item["vec"])))
        fine = (F.size(acc["vecs"]) == 0) | (item["score"] - penalty * near >= 0)
        taken = F.struct(
            used.alias("used"), F.concat(acc["ids"], F.array(item["chunk_id"])).alias("ids"), F.concat(acc["vecs"], F.array(item["vec"])).alias("vecs")
        )
        return F.when((used <= budget) & fine, taken).otherwise(acc)

    rows = ranking.withColumn("vec", F.col("vec").cast("array<double>"))
    folded = _ordered(rows, "score", "vec").withColumn("p", F.aggregate("items", start, step))
    return folded.select("query_id", F.col("p.used").alias("tokens_used"), F.col("p.ids").alias("chunk_ids"))
