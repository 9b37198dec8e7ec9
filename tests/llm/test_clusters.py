from datetime import datetime

import numpy as np
import pytest

from leafline.llm import clusters as C

T1, T2 = datetime(2025, 1, 1), datetime(2025, 1, 2)
NODE = "node_id string, chunk_ids array<string>, embeddings array<array<float>>, built_at timestamp, id string, vec string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], NODE)


def brute(ids, x, threshold):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, label = x @ x.T >= threshold, np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(1)
        if (new == label).all():
            return {(min(ids[j] for j in np.flatnonzero(label == label[i])), ids[i]) for i in range(len(x)) if ids[i] != min(ids[j] for j in np.flatnonzero(label == label[i]))}
        label = new


def blobs(rng, n, dim, families, hot=0):
    centre = np.zeros((0, dim))
    while len(centre) < families:  # centres keep apart, as clusters that no link joins do
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        if not len(centre) or (centre @ c).max() < 0.55:
            centre = np.vstack([centre, c])
    kind = np.concatenate([np.zeros(hot, int), rng.integers(0, families, n - hot)])
    x = centre[kind] + rng.normal(scale=0.25 / np.sqrt(dim), size=(n, dim))
    return (x * rng.uniform(0.5, 2, (n, 1))).astype(np.float32)


def test_equals_brute_force_over_many_nodes_with_a_hot_cluster(spark):
    rng = np.random.default_rng(1)
    x = blobs(rng, 900, 16, 90, hot=300)
    ids = [f"d-{i:04d}" for i in rng.permutation(900)]
    rows = [(f"n{k}", ids[k : k + 45], x[k : k + 45].tolist(), T1) for k in range(0, 900, 45)]
    got = {(r[0], r[1]) for r in C.found_pairs(frame(spark, rows), dim=16, node_rows=120, leaf_rows=16).collect()}
    assert got == brute(ids, x.astype(float), 0.75)


def arcs(rng, dim, families, n, degrees):
    """Elongated clusters: ``n`` vectors evenly on each of some arcs in planes at right angles."""
    axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    a = np.radians(np.linspace(0, degrees, n))
    return np.vstack([np.outer(np.cos(a), axes[2 * k]) + np.outer(np.sin(a), axes[2 * k + 1]) for k in range(families)]).astype(np.float32)


@pytest.mark.parametrize("options", [{}, {"node_rows": 150, "leaf_rows": 16}, {"node_rows": 40, "leaf_rows": 16, "max_nodes": 5}])
def test_elongated_clusters_are_whole_across_cuts(spark, options):
    rng = np.random.default_rng(5)
    x = np.vstack([arcs(rng, 16, 4, 350, 85), blobs(rng, 200, 16, 40)])
    ids = [f"d-{i:04d}" for i in rng.permutation(len(x))]
    rows = [(f"n{k}", ids[k : k + 100], x[k : k + 100].tolist(), T1) for k in range(0, len(x), 100)]
    got = {(r[0], r[1]) for r in C.found_pairs(frame(spark, rows), dim=16, **options).collect()}
    assert got == brute(ids, x.astype(float), 0.75)


def test_typical_members_are_nearest_to_the_centre_of_the_whole_cluster(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([arcs(rng, 16, 3, 300, 85), blobs(rng, 200, 16, 20)])
    ids = [f"d-{i:04d}" for i in rng.permutation(len(x))]
    rows = [(f"n{k}", ids[k : k + 100], x[k : k + 100].tolist(), T1) for k in range(0, len(x), 100)]
    first = dict(map(reversed, brute(ids, x.astype(float), 0.75)))
    unit, groups = C.unit(x.astype(float)), {}
    for i, name in enumerate(ids):
        groups.setdefault(first.get(name, name), []).append(i)
    got = {r["cluster"]: (r["size"], r["typical"]) for r in C.cluster_report(frame(spark, rows), dim=16, node_rows=150, leaf_rows=16).collect()}
    assert set(got) == set(groups)
    for name, at in groups.items():
        cos = dict(zip([ids[i] for i in at], unit[at] @ C.unit(unit[at].sum(0))))
        best = sorted(cos.values(), reverse=True)[:3]
        assert got[name][0] == len(at) and np.allclose([cos[i] for i in got[name][1]], best, atol=2e-6)


def test_only_balls_proven_apart_are_skipped():
    rng = np.random.default_rng(6)
    c = C.unit(rng.normal(size=(300, 5)))
    r = rng.uniform(0, 2, 300)
    i, j = C.open_pairs(c[:200], c[200:], r[:200], r[200:], 0.7, strip=64)
    want = np.arccos(np.clip(c[:200] @ c[200:].T, -1, 1)) <= r[:200, None] + r[None, 200:] + 0.7
    assert (np.argwhere(want) == np.column_stack([i, j])).all()


def test_dirty_entries(spark):
    a, b = [1.0, 0.0, 0.0], [0.9, 0.1, 0.0]
    rows = [
        ("n1", ["k", "old", "zero", "short"], [a, a, [0.0, 0.0, 0.0], [1.0]], T1),
        ("n1", ["k", "old", "zero", "short"], [a, a, [0.0, 0.0, 0.0], [1.0]], T1),
        ("n2", ["m", "old", None, "nan"], [b, None, a, [float("nan"), 1.0, 0.0]], T2),
        ("n3", ["tail", "huge", "tiny"], [[-1.0, 0.0, 0.0], [3e38, 0.0, 0.0]], T2),
        ("n4", None, None, T2), ("n5", [], [], None),
    ]
    df = frame(spark, rows)
    assert {(r[0], r[1]) for r in C.found_pairs(df, dim=3).collect()} == {("huge", "k"), ("huge", "m")}
    usable = {r["id"]: r["vec"] is not None for r in C.latest_vectors(df, 3).collect()}
    assert usable == {"k": True, "m": True, "old": False, "zero": False, "short": False, "nan": False, "tail": True, "huge": True, "tiny": False}
    report = {r["cluster"]: (r["size"], r["typical"]) for r in C.cluster_report(df, dim=3).collect()}
    assert report["huge"][0] == 3 and report["tail"] == (1, ["tail"])
    assert C.found_pairs(df.limit(0), dim=3).collect() == []


def test_identical_vectors_do_not_stop_the_bisection():
    x = np.tile(np.array([[1.0, 0.0]], np.float32), (500, 1))
    assert sum(map(len, C.leaves_of(x, 0.9, 10))) == 500
    y = np.vstack([x, [[0.0, 1.0]] * 40]).astype(np.float32)
    assert {len(p) for p in C.leaves_of(y, 0.9, 10)} == {500, 40}


def test_driver_side_is_bounded(spark):
    rng = np.random.default_rng(2)
    x = blobs(rng, 400, 8, 40)
    df = frame(spark, [("n", [f"i{k:03d}" for k in range(400)], x.tolist(), T1)])
    from pyspark.sql import functions as F

    vectors = C.latest_vectors(df, 8).withColumn("h", F.xxhash64("id"))
    tree, sizes, full = C.grow(vectors, 8, 0.75, 10, 15)
    assert len(tree.kids) <= 15 and sum(sizes.values()) == 400 and full
    cells, after = C.cells_of(vectors, 8, 0.75, 10, 15)
    counts = [r["count"] for r in cells.groupBy("cell").count().collect()]
    assert sum(counts) == 400 and max(counts) <= 10 and after > 40


def chains(rng, n, length, cosine, dim=64):
    """Chains of unit vectors whose neighbours have the given cosine."""
    out = []
    for _ in range(n):
        v = C.unit(rng.normal(size=dim))
        for _ in range(length):
            out.append(v)
            side = rng.normal(size=dim)
            v = cosine * v + np.sqrt(1 - cosine**2) * C.unit(side - (side @ v) * v)
    return np.array(out, np.float32)


@pytest.mark.parametrize("options", [{}, {"node_rows": 500}])
def test_chains_are_whole(spark, options):
    rng = np.random.default_rng(11)
    x = chains(rng, 20, 80, 0.85)
    ids = [f"d-{i:05d}" for i in rng.permutation(len(x))]
    rows = [(f"n{k}", ids[k : k + 100], x[k : k + 100].tolist(), T1) for k in range(0, len(x), 100)]
    got = {(r[0], r[1]) for r in C.found_pairs(frame(spark, rows), **options).collect()}
    assert got == brute(ids, x.astype(float), 0.75)


def test_blocks_proven_apart_do_not_meet(spark, monkeypatch):
    rng = np.random.default_rng(12)
    axes = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    x = np.vstack([C.unit(axes[k] + rng.normal(scale=0.05, size=(60, 8))) for k in (0, 1)]).astype(np.float32)
    parts = spark.createDataFrame([(int(i // 60) * C.PLACES + i % 60, v.astype("<f4").tobytes(), 1.0, 1.0) for i, v in enumerate(x)], "part long, centre binary, least double, most double")
    _, centre, reach = C.block_balls(parts, 8, 2)
    assert np.arccos(centre[0] @ centre[1]) > reach.sum() + np.arccos(0.75)
    members = parts.select("part", parts.centre.alias("vec"))
    links = {(r["a"], r["b"]) for r in C.exact_links(members, parts, 8, 0.75, block=60).collect()}
    number = {int(i // 60) * C.PLACES + i % 60: i for i in range(len(x))}
    src, dst = zip(*((number[a], number[b]) for a, b in links))
    near = np.argwhere(x @ x.T >= 0.75)
    assert (C.heads_of(len(x), np.array(src), np.array(dst)) == C.heads_of(len(x), near[:, 0], near[:, 1])).all()


@pytest.mark.parametrize("n", [0, 1, 7])
def test_packing_round_trip(n):
    x = np.random.default_rng(0).normal(size=(n, 4)).astype(np.float32)
    assert (C.matrix(C.pack(x), 4) == x).all()
