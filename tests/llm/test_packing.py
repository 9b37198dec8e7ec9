import math
import random
from collections import defaultdict

import pytest

from leafline.llm import packing as P


def check(rows, sizes, capacity):
    held, spans = defaultdict(int), defaultdict(list)
    for r in rows:
        held[r["doc"]] += r["size"]
        spans[r["container"]].append((r["start"], r["start"] + r["size"]))
    want = defaultdict(int)
    for d, s in sizes:
        if d is not None and s and s > 0:
            want[d] += s
    assert held == want
    for places in spans.values():
        places.sort()
        assert places[0][0] == 0 and places[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(places, places[1:]))
    whole = {d for d, s in sizes if s and s <= capacity}
    assert all(r["piece"] == 0 for r in rows if r["doc"] in whole)
    return len(spans)


@pytest.mark.parametrize("parts", [1, 3])
def test_random_sizes(spark, parts):
    rng = random.Random(parts)
    sizes = [(i, rng.choice([rng.randint(1, 100), rng.randint(1, 20), rng.randint(60, 100), 250])) for i in range(400)]
    df = spark.createDataFrame(sizes, "doc long, size int")
    rows = P.pack_items(df, capacity=100, max_parts=parts).collect()
    bins = check(rows, sizes, 100)
    big = sum(1 for _, s in sizes if s % 100 > 50) + sum(s // 100 for _, s in sizes)
    assert bins <= 1.05 * max(big, math.ceil(sum(s for _, s in sizes) / 100)) + 1


def test_edges(spark):
    sizes = [(1, 0), (2, None), (3, -4), (None, 5), (5, 2048), (6, 4096), (7, 5000), (8, 1), (8, 1)]
    df = spark.createDataFrame(sizes, "doc long, size int")
    rows = P.pack_items(df).collect()
    check(rows, sizes, 2048)
    assert sorted(r["piece"] for r in rows if r["doc"] == 7) == [0, 1, 2]
    assert P.pack_items(df.limit(0)).collect() == []


def test_across_ranges_takes_the_last_free_gaps_first():
    assert P.across([(0, 0, 5), (1, 2, 1), (2, 3, 0)]) == [(0, 4, 1, 0, 2), (1, 0, 2, 0, 1), (0, 2, 2, 1, 2)]
    assert P.across([(0, 4, 0)]) == []
