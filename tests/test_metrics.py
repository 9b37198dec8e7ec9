import math

import pytest
from pyspark.sql import functions as F

from leafline.operators import metrics, suite
from leafline.schemas import violations


def frames(spark, shown, relevant):
    r = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(shown)], "query_id string, chunk_id string, rank int")
    g = spark.createDataFrame([("q", c) for c in relevant], "query_id string, chunk_id string")
    return r, g


@pytest.mark.parametrize(
    "shown,relevant,k,want",
    [
        ("abc", "abc", 3, {"ndcg": 1, "recall": 1}),
        ("xayb", "ab", 4, {"ndcg": round((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)), 6)}),
        ("", "ab", 5, {"ndcg": 0, "recall": 0, "precision": 0, "mrr": 0, "first_rank": 0}),
        ("axy", "ab", 3, {"recall": 0.5, "mrr": 1}),
        ("xy", "ab", 2, {"recall": 0, "mrr": 0}),
        ("xa", "a", 2, {"mrr": 0.5, "precision": 0.5, "first_rank": 2}),
        ("xya", "a", 2, {"ndcg": 0, "mrr": 0.333333}),
    ],
)
def test_per_query(spark, shown, relevant, k, want):
    row = metrics.per_query(*frames(spark, shown, relevant), k).first().asDict()
    assert {c: row[c] for c in want} == want


def test_queries_without_gold_are_not_in_the_suite(spark):
    r, g = frames(spark, "ab", "")
    assert metrics.per_query(r, g).collect() == []
    assert metrics.system_means(metrics.per_query(r, g), "s").first()["ndcg_at_10"] == 0


def test_compound_recall_and_gate(spark):
    e = lambda *v: spark.createDataFrame(list(enumerate(v, 1)), "level int, epsilon double")
    assert metrics.compound_recall(e(*[0.15] * 5)).first()["compound_recall"] == round(0.85**5, 6)
    assert metrics.compound_recall(e(0.1, 1.0)).first()["compound_recall"] == 0
    sd = lambda x: spark.createDataFrame([(x,)], "distinctiveness double")
    delta = lambda x: spark.createDataFrame([(x,)], "ndcg_delta double")
    assert metrics.gate(sd(0.1), e(0.0), delta(0.0)).first()["outcome"] == "killed: distinctiveness"
    assert metrics.gate(sd(0.5), e(0.0), delta(-0.2)).first()["outcome"] == "killed: ndcg"
    row = metrics.gate(sd(0.5), e(0.0).limit(0), delta(-0.1)).first()
    assert row["outcome"] == "passed" and row["epsilon_warning"] and row["epsilon_l1"] == 1.0


def test_agreement(spark):
    t = lambda *v: spark.createDataFrame([("q", i, x) for i, x in enumerate(v)], "query_id string, level int, hit_top1 boolean")
    rows = metrics.agreement(t(True, True, False), t(True, False, False)).collect()
    assert {(r[0], r[1]): r[2] for r in rows} == {(True, True): 1, (True, False): 1, (False, False): 1}


def test_suite(spark):
    q = spark.createDataFrame(
        [("q1", "single_branch", "easy", True), ("q2", "comparative", "medium", True), ("q3", "aggregation", "hard", False), ("q4", "single_branch", "easy", True), ("q5", "temporal", "medium", True)],
        "id string, category string, difficulty string, budget_feasible_400 boolean",
    )
    assert suite.feasible(q).count() == 4 and suite.of_category(q, "single_branch").count() == 2 and suite.of_difficulty(q, "easy").count() == 2
    parts = suite.split(q).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 3, "dev": 1, "test": 1}
    assert suite.split(q.limit(0)).collect() == []
    quotas = suite.category_quotas(spark.createDataFrame([("s", 50)], "suite_id string, n long")).collect()
    assert [r["quota"] for r in quotas] == [12, 10, 7, 5, 5, 2, 2, 2, 5]


def test_proportional_sample(spark):
    rows = [(f"{s}-{d:03d}-{i}", f"{s}-{d:03d}", 60 if i else 10) for s, n in (("big", 30), ("tiny", 1)) for d in range(n) for i in range(4)]
    c = spark.createDataFrame(rows, "id string, document_id string, tokens int")
    got = suite.proportional_sample(c, 20).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"big": 19, "tiny": 1}
    assert suite.proportional_sample(c, 500).count() == 93


def test_violations(spark):
    chunks = spark.createDataFrame([("a", " ", 0), ("b", "x", 3), ("c", None, None)], "id string, content string, token_count int")
    assert {(r[0], r[1]) for r in violations(chunks, "chunk").collect()} == {("blank content", "a"), ("token_count not positive", "a"), ("blank content", "c"), ("token_count not positive", "c")}
    q = spark.createDataFrame([("q", "x", "easy", [])], "id string, category string, difficulty string, gold_chunk_ids array<string>")
    assert {r["rule"] for r in violations(q, "query").collect()} == {"unknown category", "no gold chunk"}
    e = spark.createDataFrame([(1, 1.5)], "level int, epsilon double")
    assert violations(e, "epsilon").count() == 1


def test_curve(spark):
    g = spark.createDataFrame([("q", "a")], "query_id string, chunk_id string")
    p = spark.createDataFrame([("q", 10, 5, ["a"]), ("q", 2, 0, [])], "query_id string, budget int, tokens_used long, chunk_ids array<string>")
    assert {r["budget"]: r["sufficiency_rate"] for r in metrics.efficiency_curve(p, g).collect()} == {10: 1.0, 2: 0.0}
    assert metrics.packed_rankings(p).where(F.col("rank") == 1).count() == 1
