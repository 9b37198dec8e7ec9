"""Query suites: filters, deterministic splits, quotas and source-proportional samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.functions.text import source_prefix

#: Share of each category in a generated suite; the last takes what is left.
CATEGORY_WEIGHTS = {
    "single_branch": 0.25, "entity_spanning": 0.20, "dpi": 0.15, "multi_hop": 0.10, "comparative": 0.10, "aggregation": 0.05, "temporal": 0.05, "ambiguous": 0.05, "ood": 0.05,
}
LEAST_TOKENS = 50


def feasible(queries: DataFrame) -> DataFrame:
    return queries.where("budget_feasible_400")


def of_category(queries: DataFrame, category: str) -> DataFrame:
    return queries.where(F.col("category") == category)


def of_difficulty(queries: DataFrame, difficulty: str) -> DataFrame:
    return queries.where(F.col("difficulty") == difficulty)


def first_of(queries: DataFrame, wanted, most: int = 50, least: int = 10, id_col: str = "query_id") -> DataFrame:
    """The first ``most`` queries that are ``wanted``, by id; the first of all where fewer than ``least`` are."""
    some = queries.where(wanted).orderBy(id_col).limit(most)
    return some if some.limit(least).count() >= least else queries.orderBy(id_col).limit(most)


def _numbered(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """``n`` from 0 in the order of a seeded hash, without one task that sorts all rows: the leading hash digits are
    numbered by counts, the rows inside each by a window."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col)))
    keyed = rows.withColumn("_k", key).withColumn("_p", F.substring("_k", 1, 3))
    counts = keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # at most 4096 rows
    offsets = counts.withColumn("_o", F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_c")).select("_p", "_o")
    inside = W.partitionBy("_p").orderBy("_k", id_col)
    return keyed.join(F.broadcast(offsets), "_p").withColumn("n", F.col("_o") + F.row_number().over(inside) - 1).drop("_k", "_p", "_o")


def split(queries: DataFrame, train: float = 0.6, dev: float = 0.2, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Adds ``part`` (train, dev or test); sizes are cut down to whole rows, test takes the rest."""
    total = queries.agg(F.count(F.lit(1)).alias("_t"))
    rows = _numbered(queries, id_col, seed).crossJoin(F.broadcast(total))
    first = F.floor(F.col("_t") * train)
    second = first + F.floor(F.col("_t") * dev)
    return rows.withColumn("part", F.when(F.col("n") < first, "train").when(F.col("n") < second, "dev").otherwise("test")).drop("n", "_t")


def category_quotas(counts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(suite_id, category, quota) for (suite_id, n): at least one each, the last category takes the remainder."""
    weights = CATEGORY_WEIGHTS if weights is None else weights
    names = list(weights)
    quotas, used = [], F.lit(0).cast("long")
    for name in names[:-1]:
        q = F.greatest(F.lit(1).cast("long"), F.floor(F.round(F.col("n") * weights[name], 9)).cast("long"))
        quotas.append(q)
        used = used + q
    quotas.append(F.greatest(F.lit(1).cast("long"), F.col("n") - used))
    rows = F.array(*[F.struct(F.lit(name).alias("category"), q.alias("quota")) for name, q in zip(names, quotas)])
    return counts.select("suite_id", F.inline(rows).alias("category", "quota"))


def proportional_sample(chunks: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(id, source) of ``count`` chunks with at least 50 tokens, in proportion to their sources; each source gives at
    least one. All are taken if there are too few; what whole numbers leave over is filled up in hash order."""
    rows = chunks.where(F.col("tokens") >= LEAST_TOKENS).select("id", source_prefix(F.col("document_id")).alias("source"))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    quota = sizes.crossJoin(F.broadcast(total)).withColumn("_q", F.greatest(F.lit(1), F.floor(count * F.col("_n") / F.col("_t"))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "id"))
    salt = F.substring("_k", 32, 1)
    first = W.partitionBy("source", "_s").orderBy("_k", "id")
    keyed = rows.withColumn("_k", key).withColumn("_s", salt).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= count)  # 16 salts cut hot sources
    placed = keyed.withColumn("_r", F.row_number().over(W.partitionBy("source").orderBy("_k", "id"))).where(F.col("_r") <= count).join(quota, "source")
    order = placed.withColumn("_first", F.col("_r") <= F.col("_q"))
    best = order.orderBy(F.desc("_first"), "_k", "id").limit(count)
    return best.select("id", "source")
