import os
from datetime import datetime

from pyspark.sql import functions as F

from leafline import session as S


def test_scratch_goes_to_the_named_folder(spark):
    df = S.materialize(spark.range(5), "x")
    path = df._leafline_path
    assert path.startswith(S.scratch_root(spark)) and df.count() == 5 and os.path.isdir(path)
    assert S.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    S.drop_table(df)
    assert not os.path.isdir(path)
    S.drop_table(spark.range(1))


def test_latest_rows(spark):
    t1, t2 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    df = spark.createDataFrame([("a", t1, 1, "x"), ("a", t2, 2, "x"), ("a", t2, 2, "x"), ("b", None, 3, "x"), ("b", t1, 4, "x"), (None, t2, 5, "x"), ("c", None, 6, "x")], "k string, t timestamp, v int, _ll_time string")
    assert {r["k"]: r["v"] for r in S.latest_rows(df, "k", "t", "v").collect()} == {"a": 2, "b": 4, "c": 6}
    assert S.latest_rows(df.limit(0), "k", "t").collect() == []


def test_broadcast_is_checked(spark):
    plan = lambda n: spark.range(100).join(S.small(spark.range(n), 10), "id")._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan(5) and "strategy=broadcast" not in plan(50)
    assert S.small(spark.range(3).withColumn("x", F.lit(1))).count() == 3
