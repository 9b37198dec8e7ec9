import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafline.functions import vec
from leafline.operators import metrics, routing, tree


@pytest.fixture(scope="module")
def small_tree(spark):
    """root -> two branches -> two leaves each."""
    vec = {"a1": [1.0, 0.1], "a2": [1.0, 0.2], "b1": [0.1, 1.0], "b2": [0.2, 1.0]}
    v = spark.createDataFrame(list(vec.items()), "chunk_id string, vec array<double>")
    paths = v.select("chunk_id", F.when(F.col("chunk_id").startswith("a"), F.array(F.lit(0))).otherwise(F.array(F.lit(1))).alias("path"))
    return (v, *tree.build_tree(paths, v))


def test_build(spark, small_tree):
    _, nodes, edges = small_tree
    assert {(r["node_id"], r["level"], r["is_leaf"]) for r in nodes.collect()} == {
        ("r", 0, False), ("r.0", 1, False), ("r.1", 1, False), ("r.0.a1", 2, True), ("r.0.a2", 2, True), ("r.1.b1", 2, True), ("r.1.b2", 2, True)
    }
    assert {(r["parent_id"], r["child_id"], r["child_pos"]) for r in edges.collect()} >= {("r", "r.0", 0), ("r", "r.1", 1), ("r.1", "r.1.b2", 1)}
    assert tree.shape(nodes, edges).first().asDict() == {"leaves": 4, "internal_nodes": 3, "root_branches": 2, "depth": 2}


def test_single_member_cluster_is_a_leaf(spark):
    v = spark.createDataFrame([("x", [1.0]), ("y", [2.0]), ("z", [3.0])], "chunk_id string, vec array<double>")
    paths = spark.createDataFrame([("x", [0]), ("y", [1]), ("z", [1])], "chunk_id string, path array<int>")
    nodes, edges = tree.build_tree(paths, v)
    assert {r["node_id"] for r in nodes.where("is_leaf").collect()} == {"r.0", "r.1.y", "r.1.z"}
    assert {(r["parent_id"], r["child_id"]) for r in edges.collect()} == {("r", "r.0"), ("r", "r.1"), ("r.1", "r.1.y"), ("r.1", "r.1.z")}


@pytest.mark.parametrize("beam,want", [({"q1": ["r.0", "r.1"]}, 0.0), ({"q1": ["r.1"]}, 1.0), ({"q1": ["r.0"], "q2": ["r.0"]}, 0.5)])
def test_routing_error(spark, small_tree, beam, want):
    _, nodes, edges = small_tree
    gold = spark.createDataFrame([("q1", "a1"), ("q2", "b1")], "query_id string, chunk_id string").where(F.col("query_id").isin(list(beam)))
    trace = spark.createDataFrame([(q, 1, n) for q, ns in beam.items() for n in ns], "query_id string, level int, node_id string")
    assert metrics.routing_error(trace, gold, nodes, tree.closure(edges, nodes)).first()["epsilon"] == want


def test_carried_leaf_counts_as_a_miss_below(spark):
    v = spark.createDataFrame([("x", [1.0]), ("y", [2.0]), ("z", [3.0])], "chunk_id string, vec array<double>")
    nodes, edges = tree.build_tree(spark.createDataFrame([("x", [0]), ("y", [1]), ("z", [1])], "chunk_id string, path array<int>"), v)
    gold = spark.createDataFrame([("q", "x")], "query_id string, chunk_id string")
    trace = spark.createDataFrame([("q", 1, "r.0"), ("q", 2, "r.0"), ("q", 2, "r.1.y")], "query_id string, level int, node_id string")
    rows = {r["level"]: r["epsilon"] for r in metrics.routing_error(trace, gold, nodes, tree.closure(edges, nodes)).collect()}
    assert rows == {1: 0.0, 2: 1.0}


@pytest.mark.parametrize("vecs,lo,hi", [([[1.0, 0, 0], [0, 1.0, 0]], 0.9, 1.1), ([[1.0, 0, 0], [1.0, 0, 0]], -0.01, 0.01), ([[1, 0.01, 0], [1, 0.02, 0]], 0, 0.15), ([[1.0, 0, 0]], 0, 0), ([[0.0, 0, 0], [1.0, 0, 0]], 0, 0)])
def test_distinctiveness(spark, vecs, lo, hi):
    nodes = spark.createDataFrame([(f"n{i}", [float(x) for x in v]) for i, v in enumerate(vecs)] + [("r", None)], "node_id string, embedding array<double>")
    edges = spark.createDataFrame([("r", f"n{i}", i) for i in range(len(vecs))], "parent_id string, child_id string, child_pos int")
    assert lo <= tree.sibling_distinctiveness(nodes, edges).first()[0] <= hi


def greedy(candidates, width, penalty):
    """Restates the sequential choice: each time the best after a flat penalty for sharing a chosen one's parent."""
    if len(candidates) <= width:
        return [c[1] for c in candidates]
    left = sorted(candidates, key=lambda c: -c[2])
    chosen = [left.pop(0)]
    while len(chosen) < width and left:
        best = max(range(len(left)), key=lambda i: (left[i][2] - (penalty if left[i][0] in {c[0] for c in chosen} else 0.0), -i))
        chosen.append(left.pop(best))
    return [c[1] for c in chosen]


@pytest.mark.parametrize("penalty", [0.0, 0.3])
def test_diverse_selection_equals_greedy(spark, penalty):
    rng = random.Random(11)
    rows = [(f"q{q}", f"p{rng.randint(0, 3)}", f"n{i}", i, rng.randint(0, 8) / 8) for q in range(60) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "query_id string, parent_id string, node_id string, pos int, path_score double")
    got = {}
    for r in routing.diverse(df, 5, penalty).orderBy("query_id", "beam_pos").collect():
        got.setdefault(r["query_id"], []).append(r["node_id"])
    assert got == {q: greedy([(r[1], r[2], r[4]) for r in rows if r[0] == q], 5, penalty) for q in {r[0] for r in rows}}


def test_cascade_scores_pairs_only_if_all_survivors_are_leaves(spark):
    nodes = spark.createDataFrame(
        [("r", 0, False, None, [1.0, 0.0]), ("L", 1, True, "c1", [1.0, 0.0]), ("B", 1, False, None, [0.9, 0.1]), ("N", 1, True, "c2", None)],
        "node_id string, level int, is_leaf boolean, chunk_id string, embedding array<double>",
    )
    edges = spark.createDataFrame([("r", "L", 0), ("r", "B", 1), ("r", "N", 2)], "parent_id string, child_id string, child_pos int")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vec array<double>")
    front = spark.createDataFrame([("q", "r")], "query_id string, parent_id string")
    pair = spark.createDataFrame([("q", "c1", -7.0)], "query_id string, chunk_id string, score double")
    mixed = routing.cascade(front, nodes, edges, q, 3, 3, pair).orderBy("child_rank").collect()
    assert [(r["child_id"], round(r["score"], 3)) for r in mixed] == [("L", 1.0), ("B", 0.994), ("N", 0.0)]
    leaves = routing.cascade(front, nodes, edges.where("child_id <> 'B'"), q, 3, 3, pair).collect()
    assert [(r["child_id"], r["score"]) for r in leaves] == [("L", -7.0)]


def test_beam_and_race(spark, small_tree):
    v, nodes, edges = small_tree
    q = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, vec array<double>")
    trace, leaves = routing.beam_search(q, nodes, edges, width=2)
    assert {r["level"] for r in trace.collect()} == {0, 1, 2}
    assert leaves.orderBy("beam_pos").first()["chunk_id"] == "a1"
    flat = routing.collapsed_search(q, nodes, tree.descendant_leaves(edges, nodes))
    assert flat.count() == 4
    tie = leaves.select("query_id", "beam_pos", "node_id", "chunk_id", F.lit(0.5).alias("path_score"))
    even = flat.withColumn("confidence", F.lit(0.5))
    assert {r["strategy"] for r in routing.dual_path(tie, even).collect()} == {"beam"}
    assert {r["strategy"] for r in routing.dual_path(tie, flat.withColumn("confidence", F.lit(0.6))).collect()} == {"collapsed"}
    assert {r["strategy"] for r in routing.dual_path(tie.limit(0), even).collect()} == {"collapsed"}
    assert {r["strategy"] for r in routing.dual_path(tie, even.limit(0)).collect()} == {"beam"}
    assert routing.resolve_leaves(routing.dual_path(leaves, flat), 2).count() == 2


def test_clusters_two_blobs(spark):
    rng = np.random.default_rng(42)
    x = np.vstack([rng.normal([1, 0, 0, 0], 0.1, (10, 4)), rng.normal([0, 1, 0, 0], 0.1, (10, 4))])
    v = spark.createDataFrame([(f"c{i}", r.tolist()) for i, r in enumerate(x)], "chunk_id string, vec array<double>")
    groups = lambda **k: [r["count"] for r in tree.kmeans_paths(v, **k).groupBy("path").count().collect()]
    assert groups(branching=5, depth=0) == [20]
    assert sorted(groups(branching=2, depth=1)) == [10, 10]
    assert sum(groups(branching=5, depth=1)) == 20 and len(groups(branching=5, depth=1)) > 1
    assert tree.kmeans_paths(v.limit(1), 2, 3).collect()[0]["path"] == []


def test_centres_are_fitted_on_all_members(spark):
    v = spark.range(30_000).select(F.format_string("c%05d", "id").alias("chunk_id"), F.array(F.sin(F.col("id") * 1.7) * F.sqrt("id"), F.cos(F.col("id") * F.col("id"))).alias("vec"))
    rows = v.withColumn("h", F.md5("chunk_id")).orderBy("h").collect()
    x = np.array([r["vec"] for r in rows])
    centre = x[:3].copy()
    for _ in range(25):
        label = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        new = np.stack([x[label == k].mean(0) for k in range(3)])
        if np.allclose(new, centre):
            break
        centre = new
    label = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
    got = {r["chunk_id"]: r["path"][0] for r in tree.kmeans_paths(v, 3, 1).collect()}
    assert sum(got[r["chunk_id"]] != k for r, k in zip(rows, label)) <= 2


def test_summaries_of_branches(spark, small_tree):
    _, nodes, edges = small_tree
    chunks = spark.createDataFrame([("a1", 2, "alpha delta words"), ("a2", 1, "gamma omega words"), ("b1", 3, None), ("b2", 4, "tiny")], "id string, pos long, content string")
    got = {r["node_id"]: r["summary"] for r in tree.summarise(nodes, edges, chunks).collect()}
    assert set(got) == {"r", "r.0", "r.1"} and got["r.0"]["includes"] == ["gamma", "omega", "words", "alpha", "delta"]
    assert got["r.0"]["content_snippet"].startswith("gamma omega words alpha")


def test_small_nodes_are_split_in_tasks_as_across_the_cluster(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (300, 6)), np.repeat(rng.normal(3, 1, (1, 6)), 40, 0)])
    v = spark.createDataFrame([(f"c{i}", r.tolist()) for i, r in enumerate(x)], "chunk_id string, vec array<double>")
    sc = spark.sparkContext
    sc.setJobGroup("k-means", "")
    inside = {r["chunk_id"]: tuple(r["path"]) for r in tree.kmeans_paths(v, 4, 4, 8).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("k-means"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 10  # not one a round
    across = {r["chunk_id"]: tuple(r["path"]) for r in tree.kmeans_paths(v, 4, 4, 8, task_rows=20).collect()}
    assert inside == across and len(set(inside.values())) > 40
    assert len({inside[f"c{i}"] for i in range(300, 340)}) == 1  # equal vectors stay together, though there are more than a node takes


def test_a_large_node_of_equal_vectors_stays_a_leaf(spark):
    v = spark.createDataFrame([(f"c{i}", [1.0, 2.0] if i < 30 else [9.0, float(i)]) for i in range(40)], "chunk_id string, vec array<double>")
    paths = [{r["chunk_id"]: tuple(r["path"]) for r in tree.kmeans_paths(v, 2, 5, 8, task_rows=most).collect()} for most in (5, 1_000)]
    assert paths[0] == paths[1] and len({paths[0][f"c{i}"] for i in range(30)}) == 1


def test_nearest_takes_the_first_of_equal_centres():
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(3_000, 7)), rng.normal(size=(5, 7))
    c = np.vstack([c, c, x[:2]])
    assert (tree.nearest(x, c) == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()


def test_means_of_branches_with_vectors_of_different_lengths(spark):
    vec = {"a": [1.0, 4.0], "b": [3.0], "c": [8.0, 2.0, 6.0]}
    v = spark.createDataFrame(list(vec.items()), "chunk_id string, vec array<double>")
    paths = spark.createDataFrame([("a", [0, 0]), ("b", [0, 0]), ("c", [1])], "chunk_id string, path array<int>")
    got = {r["node_id"]: r["embedding"] for r in tree.build_tree(paths, v)[0].where("NOT is_leaf").collect()}
    assert got == {"r": [4.0, 3.0, 6.0], "r.0": [2.0, 4.0], "r.0.0": [2.0, 4.0]}


def test_closure_of_some_nodes(spark, small_tree):
    _, nodes, edges = small_tree
    some = spark.createDataFrame([("r.0.a1",), ("r.1",), ("gone",)], "node_id string")
    got = {tuple(r) for r in tree.closure(edges, nodes, some).collect()}
    assert got == {("r.0.a1", "r.0.a1", 2), ("r.0.a1", "r.0", 1), ("r.0.a1", "r", 0), ("r.1", "r.1", 1), ("r.1", "r", 0)}
    assert got == {tuple(r) for r in tree.closure(edges, nodes).collect() if r["node_id"] in ("r.0.a1", "r.1")}


def test_summaries_join_no_text_that_they_do_not_read(spark):
    rows = [(f"c{i:02d}", i, ("  " * 150 if i < 2 else "") + f"word{i} " + "text " * (1 if i % 3 else 60)) for i in range(30)]
    chunks = spark.createDataFrame(rows, "id string, pos long, content string")
    v = chunks.select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0)).alias("vec"))
    nodes, edges = tree.build_tree(v.select("chunk_id", F.array((F.substring("chunk_id", 2, 2).cast("int") % 3)).alias("path")), v)
    from leafline.functions import text as X

    whole = {n: " ".join(t for k, (_, _, t) in enumerate(rows) if n == "r" or k % 3 == int(n[2:])) for n in ("r", "r.0", "r.1", "r.2")}
    cut = {n: " ".join([t for k, (_, _, t) in enumerate(rows) if n == "r" or k % 3 == int(n[2:])][:20]) for n in whole}
    want = spark.createDataFrame(list(cut.items()), "node_id string, t string").select("node_id", X.fallback_summary(F.col("t")).alias("summary"))
    seen, kept = [], tree.materialize
    try:
        tree.materialize = lambda df, name="t", **k: [seen.append((name, out := kept(df, name, **k))), out][1]
        got = {r["node_id"]: r["summary"] for r in tree.summarise(nodes, edges, chunks).collect()}
    finally:
        tree.materialize = kept
    assert got == {r["node_id"]: r["summary"] for r in want.collect()}
    assert next(df for name, df in seen if name == "read").count() < 30


def test_a_tree_from_blocks_equals_that_from_joins(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (260, 5)), np.repeat(rng.normal(2, 1, (1, 5)), 40, 0)])
    text = ["  " * (i % 90) + f"word{i} some text " * (i % 7) for i in range(300)]
    rows = [(f"c{i:03d}", int(rng.integers(0, 90)), t, r.tolist()) for i, (t, r) in enumerate(zip(text, x))]
    chunks = spark.createDataFrame(rows, "id string, pos long, content string, vec array<double>")
    v = tree.text_lengths(chunks).select(F.col("id").alias("chunk_id"), "pos", "n", "bare", "vec")
    slow = tree.build_tree(tree.kmeans_paths(v, 3, 4, 8), v)
    want = {r["node_id"]: r["summary"] for r in tree.summarise(*slow, chunks).collect()}
    kept = tree.FAMILY_ROWS
    for most, family in ((None, kept), (30, kept), (30, 1)):
        tree.FAMILY_ROWS = family
        try:
            leaves = tree.kmeans_leaves(v, 3, lambda n: 4 if n == 300 else 0, 8, task_rows=most)
            nodes, edges = tree.build_tree(leaves, branching=3)
        finally:
            tree.FAMILY_ROWS = kept
        plain = lambda df: {(r["node_id"], r["level"], r["is_leaf"], r["chunk_id"], tuple(round(e, 9) for e in r["embedding"])) for r in df.collect()}
        assert plain(nodes) == plain(slow[0]) and set(edges.collect()) == set(slow[1].collect())
        assert {r["node_id"]: r["summary"] for r in tree.summarise(nodes, edges, chunks, leaves=leaves).collect()} == want
        bare, _ = tree.build_tree(tree.kmeans_leaves(v, 3, 4, 8, task_rows=most, embedded=False), branching=3)
        assert set(bare.collect()) == set(nodes.drop("embedding").collect())
    some = nodes.where("is_leaf AND chunk_id < 'c050'")
    assert set(tree.path_closure(edges, some).collect()) == set(tree.closure(edges, nodes, some).collect())
    of = spark.createDataFrame([("r.1",)], "node_id string")
    assert {r["node_id"]: r["summary"] for r in tree.summarise(nodes, edges, chunks, leaves=leaves, of=of).collect()} == {"r.1": want["r.1"]}


def test_blocks_of_vectors_of_different_lengths_are_an_error(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "chunk_id string, vec array<double>")
    with pytest.raises(Exception, match="vectors of"):
        tree.kmeans_leaves(v.repartition(1), 2, 1).collect()
    with pytest.raises(Exception, match="vectors of"):
        tree.kmeans_leaves(v.repartition(2, "chunk_id"), 1, 1, task_rows=1).collect()


@pytest.mark.parametrize("depth", [0, 1, 4])
def test_families_on_the_way_equal_those_of_the_whole_tree(spark, depth):
    rng = np.random.default_rng(5)
    rows = [(f"c{i:03d}", [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    v = spark.createDataFrame(rows, "chunk_id string, vec array<double>")
    leaves = tree.kmeans_leaves(v, 3, depth, 8, embedded=False)
    nodes, edges = (df.collect() for df in tree.build_tree(leaves, branching=3))
    parent = {r["child_id"]: r["parent_id"] for r in edges}
    of, way = {"c007", "c150", "c151"}, set()
    for node in (r["node_id"] for r in nodes if r["chunk_id"] in of):
        while node in parent:
            node = parent[node]
            way.add(node)
    got, links = tree.families(leaves, spark.createDataFrame([(c,) for c in of], "chunk_id string"), 3)
    assert set(links.collect()) == {r for r in edges if r["parent_id"] in way} and links.count() == len(set(links.collect()))
    assert sorted(got.select("node_id", "level", "is_leaf", "chunk_id").collect(), key=str) == sorted((r for r in nodes if parent.get(r["node_id"]) in way), key=str)
    assert tree.families(leaves, v.select("chunk_id").limit(0), 3)[1].count() == 0


def test_texts_hashed_where_they_are_packed_give_the_same_leaves(spark):
    t = spark.createDataFrame([(f"c{i:02d}", i, f"Word w{i % 7} W{i % 5} x{i}" if i else " ") for i in range(60)], "id string, pos long, text string")
    want = tree.kmeans_leaves(vec.hash_embedding(t, "id", "text", keep=("pos",)).withColumnRenamed("id", "chunk_id"), 3, 3, 8, task_rows=20)
    got = tree.kmeans_leaves(t.select(F.col("id").alias("chunk_id"), "pos", vec.lowered("text").alias("text")), 3, 3, 8, task_rows=20, embed=vec.hashed)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 59


def test_sums_of_nearest_equal_sums_by_label():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5000, 6))
    label = tree.nearest(x, x[:4])
    n, total = tree.sums_by_nearest(x, x[:4])
    assert n.tolist() == np.bincount(label, minlength=4).tolist()
    assert np.allclose(total, [x[label == k].sum(0) for k in range(4)], rtol=0, atol=1e-9)
