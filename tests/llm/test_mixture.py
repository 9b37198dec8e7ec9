from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from leafline.llm import mixture as M

T1, T2 = datetime(2025, 1, 1), datetime(2025, 1, 2)
Q = "id string, suite_id string, category string, difficulty string, created_at timestamp, available int"
T = "suite_id string, category string, difficulty string, share double, min_rows int, sample_rows int"


def test_raking_meets_margins():
    share = np.array([0.4, 0.2, 0.1, 0.3])
    rows, cols = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    assert np.allclose(M.rake(share, np.full(4, 1e6), rows, cols, 100), share * 100)
    empty = M.rake(share, np.array([1e6, 1e6, 0, 1e6]), rows, cols, 100)
    assert empty[2] == 0 and abs(empty.sum() - 100) < 1
    scarce = M.rake(share, np.array([5, 5, 5, 5]), rows, cols, 100)
    assert np.allclose(scarce, 5)


def test_repair_gives_every_cell_with_rows_its_quota():
    rng = np.random.default_rng(0)
    for _ in range(300):
        have = rng.integers(0, 20, 6)
        fit = np.minimum(rng.uniform(0, 10, 6), have)
        least = rng.integers(0, 3, 6)
        quota = np.maximum(least, rng.integers(0, 12, 6))
        n = int(rng.integers(0, 60))
        out = M.whole_counts(fit, rng.integers(0, 12, 6), least, quota, have, n)
        floor, want = np.minimum(least, have), np.minimum(quota, have)
        assert (out <= have).all() and (out >= floor).all() and (out.sum() == min(n, have.sum()) or (out == floor).all())
        assert (out >= want).all() or out.sum() <= max(n, floor.sum()) < want.sum() + (out - want).clip(0).sum() or want.sum() > n


def test_first_ranks_equal_a_plain_window(spark):
    rng = np.random.default_rng(3)
    rows = [(f"i{k:04d}", "hot" if k % 3 else f"g{k % 7}", float(u)) for k, u in enumerate(np.round(rng.random(3000), 3))]
    df = spark.createDataFrame(rows, "id string, g string, x double")
    for buckets in (1, 16, 500):
        got = {(r["id"], r["_ll_rank"]) for r in M.first_ranks(df, ["g"], "x", F.floor(F.col("x") * buckets), F.lit(40)).collect()}
        want = set()
        for g in {r[1] for r in rows}:
            want |= {(r[0], k) for k, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])), 1) if k <= 40}
        assert got == want


def test_sample_follows_targets_and_reports_gaps(spark):
    rows = [(f"q{i:04d}", "s", " Multi-Hop " if i % 2 else "multi_hop", "EASY", T1, 0) for i in range(400)]
    rows += [(f"r{i:04d}", "s", "ood", "hard", T1, 0) for i in range(300)] + [("t1", "s", "ood", "easy", T1, 0), ("t1", "s", None, "easy", T2, 0)]
    rows += [("u1", "s", "temporal", "hard", T1, 0), ("u1", "s", "temporal", "hard", T1, 0), (None, "s", "ood", "hard", T1, 0), ("z", "other", "ood", "hard", T1, 0)]
    targets = [("s", "multi_hop", "easy", 0.6, 1, 50), ("s", "ood", "hard", 0.3, 1, 50), ("s", "ood", "easy", 0.06, 1, 50), ("s", "temporal", "hard", 0.04, 3, 50), ("none", "ood", "easy", 1.0, 2, 5)]
    sample, report = M.sample_by_targets(spark.createDataFrame(rows, Q), spark.createDataFrame(targets, T))
    got = {(r["category"], r["difficulty"]): r["n"] for r in sample.groupBy("category", "difficulty").agg(F.count_distinct("id").alias("n")).collect()}
    assert sum(got.values()) == 50 and got[("temporal", "hard")] == 1 and ("ood", "easy") not in got
    assert abs(got[("multi_hop", "easy")] - 32) <= 2
    cells = {(r["suite_id"], r["category"], r["difficulty"]): r for r in report.collect()}
    assert len(cells) == 5 and {k for k, r in cells.items() if r["cause"] == "supply"} == {("s", "ood", "easy"), ("s", "temporal", "hard"), ("none", "ood", "easy")}
    assert cells[("s", "temporal", "hard")]["quota"] == 3 and cells[("s", "temporal", "hard")]["gap"] == -2
    again, _ = M.sample_by_targets(spark.createDataFrame(rows[::-1], Q), spark.createDataFrame(targets, T))
    assert {r["id"] for r in again.collect()} == {r["id"] for r in sample.collect()}


def test_empty_tables(spark):
    sample, report = M.sample_by_targets(spark.createDataFrame([], Q), spark.createDataFrame([], T))
    assert sample.collect() == [] and report.collect() == []
