"""Evaluation: ranking metrics, packed results, token curves, routing error, breakdowns and the fail-fast gate.

``rankings`` are (query_id, chunk_id, rank), ``gold`` is (query_id, chunk_id) without repeats. Queries with gold but
without any result count as zero everywhere; queries without gold are not in the suite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DISTINCT_LEAST, EPSILON_MOST, NDCG_DROP = 0.15, 0.05, -0.15


def per_query(rankings: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, relevant, ndcg, recall, precision, mrr, first_rank) of every query with gold."""
    marked = rankings.select("query_id", "chunk_id", "rank").join(gold.select("query_id", "chunk_id", F.lit(True).alias("g")), ["query_id", "chunk_id"], "left")
    hit = F.col("g").isNotNull()
    near = F.col("rank") <= k
    seen = marked.groupBy("query_id").agg(
        F.sum(F.when(hit & near, F.lit(1.0) / F.log2(F.col("rank") + 1.0))).alias("dcg"),
        F.count_if(hit & near).alias("hits"),
        F.count_if(near).alias("shown"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
    )
    suite = gold.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    zero = F.lit(0.0)
    return suite.join(seen, "query_id", "left").select(
        "query_id", "relevant", F.round(F.coalesce("dcg", zero) / ideal, 6).alias("ndcg"), F.round(F.coalesce("hits", zero) / F.col("relevant"), 6).alias("recall"),
        F.round(F.when(F.col("shown") > 0, F.col("hits") / F.col("shown")).otherwise(zero), 6).alias("precision"),
        F.round(F.coalesce(F.lit(1.0) / F.col("first"), zero), 6).alias("mrr"), F.coalesce("first", F.lit(0)).cast("int").alias("first_rank"),
    )


def system_means(metrics: DataFrame, system: str) -> DataFrame:
    """One row: means over the queries of :func:`per_query`."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 5)
    return metrics.agg(
        F.count(F.lit(1)).alias("queries"), mean("ndcg").alias("ndcg_at_10"), mean("recall").alias("recall_at_10"), mean("precision").alias("precision_at_10"), mean("mrr").alias("mrr")
    ).withColumn("system", F.lit(system))


def packed_rankings(packed: DataFrame) -> DataFrame:
    """Packed chunks as a ranking, in packing order."""
    return packed.select("query_id", *[c for c in packed.columns if c == "budget"], F.posexplode("chunk_ids").alias("at", "chunk_id")).withColumn("rank", (F.col("at") + 1).cast("int")).drop("at")


def sufficiency(packed: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, [budget,] tokens_used, sufficient): offline stand-in for a judge, true if any gold chunk was packed."""
    wanted = gold.groupBy("query_id").agg(F.collect_set("chunk_id").alias("g"))
    keep = [c for c in packed.columns if c == "budget"]
    return packed.join(wanted, "query_id").select("query_id", *keep, "tokens_used", F.arrays_overlap("chunk_ids", "g").alias("sufficient"))


def efficiency_curve(curve: DataFrame, gold: DataFrame) -> DataFrame:
    """(budget, queries_evaluated, sufficiency_rate, mean_tokens_used) of packed results at several budgets."""
    return sufficiency(curve, gold).groupBy("budget").agg(
        F.count(F.lit(1)).alias("queries_evaluated"), F.round(F.avg(F.col("sufficient").cast("double")), 6).alias("sufficiency_rate"), F.round(F.avg("tokens_used"), 4).alias("mean_tokens_used")
    )


def routing_error(trace: DataFrame, gold: DataFrame, nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(level, queries_evaluated, correct_branch_in_beam, epsilon): how often no gold chunk's ancestor is in the beam.

    A leaf above a level has no ancestor at that level, so a right leaf carried along counts as a miss there. The
    first leaf of a chunk counts.
    """
    leaf = nodes.where("is_leaf").groupBy("chunk_id").agg(F.min("node_id").alias("node_id"))
    right = gold.join(leaf, "chunk_id").join(ancestors, "node_id").select("query_id", F.col("ancestor_level").alias("level"), F.col("ancestor_id").alias("node_id")).distinct()
    judged = trace.select("query_id", "level", "node_id").join(gold.select("query_id").distinct(), "query_id", "left_semi")
    judged = judged.join(right.withColumn("hit", F.lit(1)), ["query_id", "level", "node_id"], "left")
    flags = judged.groupBy("query_id", "level").agg(F.max(F.coalesce("hit", F.lit(0))).alias("ok"))
    return flags.groupBy("level").agg(
        F.count(F.lit(1)).alias("queries_evaluated"), F.sum("ok").alias("correct_branch_in_beam"), F.round(1 - F.sum("ok") / F.count(F.lit(1)), 6).alias("epsilon")
    )


def group_routing_error(trace: DataFrame, queries: DataFrame, members: DataFrame, nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """As :func:`routing_error` where all other chunks of a query's group are gold: (query_id, label, self) and (chunk_id, label).

    Nodes are counted by the labels below them, so no query meets the members of its group.
    """
    leaf = nodes.where("is_leaf").groupBy("chunk_id").agg(F.min("node_id").alias("node_id")).join(members.select("chunk_id", "label"), "chunk_id")
    of_label = members.groupBy("label").agg(F.count(F.lit(1)).alias("all"))
    under = ancestors.join(leaf, "node_id").groupBy(F.col("ancestor_id").alias("node_id"), F.col("ancestor_level").alias("level"), "label")
    under = under.agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("one"))
    asked = queries.select("query_id", "label", "self").join(of_label.where(F.col("all") > 1).select("label"), "label")
    judged = trace.select("query_id", "level", "node_id").join(asked, "query_id").join(under, ["node_id", "level", "label"], "left")
    hit = F.coalesce((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("one") != F.col("self"))), F.lit(False))
    flags = judged.groupBy("query_id", "level").agg(F.max(hit.cast("int")).alias("ok"))
    return flags.groupBy("level").agg(
        F.count(F.lit(1)).alias("queries_evaluated"), F.sum("ok").alias("correct_branch_in_beam"), F.round(1 - F.sum("ok") / F.count(F.lit(1)), 6).alias("epsilon")
    )


def compound_recall(errors: DataFrame) -> DataFrame:
    """(levels, compound_recall): the product of 1 - epsilon over levels; 0 if any epsilon is 1."""
    keep = 1 - F.col("epsilon")
    logs = F.sum(F.when(keep > 0, F.log(keep)).otherwise(F.lit(0.0)))
    return errors.agg(F.count(F.lit(1)).alias("levels"), F.round(F.when(F.min(keep) <= 0, F.lit(0.0)).otherwise(F.exp(logs)), 6).alias("compound_recall"))


def by_group(metrics: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """(system, column, ..means, perfect_recall_rate) of (system, query_id, ..) joined with (query_id, column)."""
    mean = lambda c: F.round(F.avg(c), 5)
    return (
        metrics.join(groups.select("query_id", column), "query_id")
        .groupBy("system", column)
        .agg(
            F.count(F.lit(1)).alias("queries"), mean("ndcg").alias("ndcg"), mean("recall").alias("recall"), mean("mrr").alias("mrr"),
            mean(F.when(F.col("recall") >= 1, 1.0).otherwise(0.0)).alias("perfect_recall_rate"),
        )
    )


def pivot(grouped: DataFrame, column: str, value: str, systems: list[str]) -> DataFrame:
    """One row per value of ``column``, one column per system; null where a system has no query."""
    return grouped.groupBy(column).pivot("system", systems).agg(F.first(value))


def deltas(means: DataFrame, baseline: str) -> DataFrame:
    """(system, ndcg_at_10, ndcg_delta, verdict) against one system."""
    base = means.where(F.col("system") == baseline).select(F.col("ndcg_at_10").alias("base"))
    delta = F.round(F.col("ndcg_at_10") - F.col("base"), 5)
    return means.crossJoin(F.broadcast(base)).select("system", "ndcg_at_10", delta.alias("ndcg_delta"), F.when(delta >= 0, "WIN").otherwise("LOSE").alias("verdict"))


def trace_summary(trace: DataFrame) -> DataFrame:
    """(level, queries, top1_misses, top3_misses, mean_place) of a routing trace."""
    return trace.groupBy("level").agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(~F.col("hit_top1")).alias("top1_misses"), F.count_if(~F.col("hit_top3")).alias("top3_misses"), F.round(F.avg("place"), 5).alias("mean_place")
    )


def agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """(first_hits, second_hits, decisions): 2 x 2 table of two traces with (query_id, level, hit_top1)."""
    both = one.select("query_id", "level", F.col("hit_top1").alias("first_hits")).join(two.select("query_id", "level", F.col("hit_top1").alias("second_hits")), ["query_id", "level"])
    return both.groupBy("first_hits", "second_hits").agg(F.count(F.lit(1)).alias("decisions"))


def gate(distinctiveness: DataFrame, errors: DataFrame, delta: DataFrame) -> DataFrame:
    """One row with the fail-fast outcome. Low distinctiveness kills; a level-1 error above the limit (1 if not
    measured) only warns; a drop of nDCG below the limit kills."""
    level1 = errors.agg(F.coalesce(F.max(F.when(F.col("level") == 1, F.col("epsilon"))), F.lit(1.0)).alias("epsilon_l1"))
    row = distinctiveness.crossJoin(level1).crossJoin(delta.select("ndcg_delta"))
    outcome = F.when(F.col("distinctiveness") < DISTINCT_LEAST, "killed: distinctiveness").when(F.col("ndcg_delta") < NDCG_DROP, "killed: ndcg").otherwise("passed")
    return row.select("distinctiveness", "epsilon_l1", "ndcg_delta", (F.col("epsilon_l1") > EPSILON_MOST).alias("epsilon_warning"), outcome.alias("outcome"))


def score_spread(scores: DataFrame) -> DataFrame:
    """(level, right, n, mean, least, most): the scores of right and wrong children of a trace, apart."""
    return scores.groupBy("level", "right").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most"))


def failures(trace: DataFrame, queries: DataFrame, category: str | None = None, level: int | None = None) -> DataFrame:
    """(query_id, category, first_miss, misses, worst_place, severity): queries whose right child was not placed first, worst first.

    ``severity`` adds up how far from the first place the right child was, the upper levels counting double those below
    them. ``category`` and ``level`` (of the first miss) filter.
    """
    miss = trace.where(~F.col("hit_top1")).groupBy("query_id").agg(
        F.min("level").alias("first_miss"), F.count(F.lit(1)).alias("misses"), F.max("place").alias("worst_place"), F.round(F.sum((F.col("place") - 1) / F.pow(F.lit(2.0), F.col("level") - 1)), 6).alias("severity")
    )
    rows = miss.join(queries.select("query_id", "category"), "query_id")
    rows = rows.where(F.col("category") == category) if category else rows
    return rows.where(F.col("first_miss") == level) if level is not None else rows


def failure_rates(trace: DataFrame, queries: DataFrame) -> DataFrame:
    """(category, queries, failed, rate): traced queries of each category and those with a miss at any level."""
    flags = trace.groupBy("query_id").agg(F.max((~F.col("hit_top1")).cast("int")).alias("failed")).join(queries.select("query_id", "category"), "query_id")
    return flags.groupBy("category").agg(F.count(F.lit(1)).alias("queries"), F.sum("failed").alias("failed"), F.round(F.avg("failed"), 5).alias("rate"))


def token_deltas(tokens: DataFrame, baseline: str) -> DataFrame:
    """(system, mean_tokens, token_delta) of (system, tokens_used) rows against one system."""
    means = tokens.groupBy("system").agg(F.round(F.avg("tokens_used"), 4).alias("mean_tokens"))
    base = means.where(F.col("system") == baseline).select(F.col("mean_tokens").alias("base"))
    return means.crossJoin(F.broadcast(base)).select("system", "mean_tokens", F.round(F.col("mean_tokens") - F.col("base"), 4).alias("token_delta"))  # one row
