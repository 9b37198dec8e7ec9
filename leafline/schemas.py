"""Schemas of the data model, and lazy validation: each ``violations`` frame lists (rule, id) instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names of categories and difficulties.
CATEGORIES = ["single_branch", "entity_spanning", "dpi", "multi_hop", "comparative", "aggregation", "temporal", "ambiguous", "ood"]
DIFFICULTIES = ["easy", "medium", "hard"]

DOCUMENT = "id string, source string, content string, metadata map<string,string>"
CHUNK = "id string, document_id string, content string, token_count int, metadata map<string,string>, pos bigint"
SUMMARY = "struct<theme:string,includes:array<string>,excludes:array<string>,key_entities:array<string>,key_terms:array<string>,content_snippet:string>"
NODE = f"node_id string, level int, is_leaf boolean, chunk_id string, parent_ids array<string>, child_ids array<string>, embedding array<float>, summary {SUMMARY}"
EDGE = "parent_id string, child_id string, child_pos int"
QUERY = "id string, text string, category string, difficulty string, budget_feasible_400 boolean, gold_chunk_ids array<string>, gold_answer string"
EPSILON = "level int, queries_evaluated bigint, correct_branch_in_beam bigint, epsilon double"
RANKING = "query_id string, chunk_id string, score double, rank int"
RESULT = (
    "system_name string, corpus_size bigint, query_count bigint, epsilon_per_level array<struct<level:int,epsilon:double>>, "
    "sufficiency_at_400 double, ndcg_at_10 double, recall_at_10 double, mrr double, mean_tokens_used double"
)


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def rules(entity: str) -> tuple[str, dict[str, Column]]:
    """(id column, rule -> condition that breaks it)."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return {
        "document": ("id", {"blank content": _blank("content")}),
        "chunk": ("id", {"blank content": _blank("content"), "token_count not positive": F.coalesce("token_count", F.lit(0)) <= 0}),
        "query": (
            "id",
            {
                "unknown category": ~F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False)),
                "unknown difficulty": ~F.coalesce(F.col("difficulty").isin(DIFFICULTIES), F.lit(False)),
                "no gold chunk": size("gold_chunk_ids") == 0,
            },
        ),
        "node": (
            "node_id",
            {
                "negative level": F.coalesce("level", F.lit(-1)) < 0,
                "leaf without chunk": F.col("is_leaf") & F.col("chunk_id").isNull(),
                "internal without children": ~F.col("is_leaf") & (size("child_ids") == 0),
                "blank theme": F.col("summary").isNotNull() & (F.coalesce(F.trim("summary.theme"), F.lit("")) == ""),
            },
        ),
        "epsilon": ("level", {"epsilon outside 0..1": ~F.coalesce(F.col("epsilon").between(0, 1), F.lit(False))}),
    }[entity]


def violations(df: DataFrame, entity: str) -> DataFrame:
    """(rule, id) of every broken rule of ``entity``, null ids included."""
    key, broken = rules(entity)
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in broken.items()]))
    return df.select(F.explode(hits).alias("rule"), F.col(key).cast("string").alias("id"))
