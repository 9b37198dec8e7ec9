import pytest
from pyspark.sql import functions as F

from leafline.functions.vec import hash_embedding
from leafline.operators import metrics, retrieval, routing, suite, tree

TOPICS = {"a": "leave policy vacation days request approval", "b": "deploy pipeline rollback release branch", "c": "expense invoice refund travel card"}


@pytest.fixture(scope="module")
def small(spark):
    rows = [(f"{t}{i}", n * 10 + i, f"{words} note {t}{i}") for n, (t, words) in enumerate(TOPICS.items()) for i in range(6)]
    c = spark.createDataFrame(rows, "id string, pos long, content string")
    v = hash_embedding(c, "id", "content").withColumnRenamed("id", "chunk_id")
    paths = c.select(F.col("id").alias("chunk_id"), F.array((F.col("pos") / 10).cast("int")).alias("path"))
    nodes, edges = tree.build_tree(paths, v)
    return c, nodes, edges


def test_branches_take_the_vectors_of_their_summaries(spark, small):
    c, nodes, edges = small
    told = tree.summarise(nodes, edges, c)
    after = {r["node_id"]: r["embedding"] for r in tree.reembed(nodes, told, hash_embedding).collect()}
    before = {r["node_id"]: (r["is_leaf"], r["embedding"]) for r in nodes.collect()}
    assert all((after[n] == e) == leaf for n, (leaf, e) in before.items())
    assert {r["node_id"]: r["embedding"] for r in tree.reembed(nodes, told.limit(0), hash_embedding).collect()} == {n: e for n, (_, e) in before.items()}


def test_tree_retriever_finds_the_topic(spark, small):
    c, nodes, edges = small
    q = spark.createDataFrame([("q1", "rollback a release in the deploy pipeline", "b"), ("q2", "refund of a travel invoice", "c"), ("q3", "", "a")], "query_id string, text string, topic string")
    got = routing.TreeRetriever(nodes, edges, c, hash_embedding, retrieval.LexicalScorer(retrieval.Bm25(c).idf)).rank(q, 3).collect()
    assert {r["query_id"]: r["chunk_id"][0] for r in got if r["rank"] == 1} == {"q1": "b", "q2": "c"}
    assert all(r["rank"] <= 3 for r in got)


def test_flat_search_opens_no_more_leaves_than_asked_for(spark, small):
    _, nodes, edges = small
    q = nodes.where("level = 1").select(F.concat(F.lit("q"), "node_id").alias("query_id"), F.col("embedding").alias("vec"))
    below = tree.descendant_leaves(edges, nodes)
    some = {(r["query_id"], r["leaf_id"], r["place"]) for r in routing.collapsed_search(q, nodes, below, most=8).collect()}
    every = {(r["query_id"], r["leaf_id"], r["place"]) for r in routing.collapsed_search(q, nodes, below, most=10_000).collect()}
    assert some == {r for r in every if r[2] <= 8} and len(every) == 3 * 18


def test_error_by_group_equals_that_by_pairs(spark, small):
    _, nodes, edges = small
    label = F.when(F.col("chunk_id").isin("a0", "b3"), "x").when(F.col("chunk_id") == "c5", "alone").otherwise(F.substring("chunk_id", 1, 1))
    members = nodes.where("is_leaf").select("chunk_id", label.alias("label"), F.col("embedding").alias("vec"))
    q = members.select(F.concat(F.lit("q"), "chunk_id").alias("query_id"), "label", F.col("chunk_id").alias("self"), "vec")
    trace, _ = routing.beam_search(q, nodes, edges, width=2)
    ancestors = tree.closure(edges, nodes)
    gold = q.join(members.select("chunk_id", "label"), "label").where("chunk_id <> self").select("query_id", "chunk_id")
    assert set(metrics.group_routing_error(trace, q, members, nodes, ancestors).collect()) == set(metrics.routing_error(trace, gold, nodes, ancestors).collect())


def test_traces_and_failures(spark, small):
    c, nodes, edges = small
    q = spark.createDataFrame([("q1", "rollback note b2", "easy"), ("q2", "leave note c1", "hard")], "query_id string, text string, category string")
    gold = spark.createDataFrame([("q1", "b2"), ("q2", "c1")], "query_id string, chunk_id string")
    texts = nodes.where("is_leaf").join(c.select(F.col("id").alias("chunk_id"), "content"), "chunk_id").select("node_id", "content")
    texts = texts.unionByName(tree.summarise(nodes, edges, c).select("node_id", F.concat_ws(" ", "summary.includes").alias("content")))
    trace, scores = routing.pair_trace(q, gold, nodes, edges, tree.closure(edges, nodes), texts, retrieval.LexicalScorer(retrieval.Bm25(c).idf))
    hit = {(r["query_id"], r["level"]): r["hit_top1"] for r in trace.collect()}
    assert hit == {("q1", 1): True, ("q1", 2): True, ("q2", 1): False, ("q2", 2): True}
    worst = metrics.failures(trace, q).collect()
    assert [(r["query_id"], r["first_miss"], r["misses"]) for r in worst] == [("q2", 1, 1)] and worst[0]["severity"] == worst[0]["worst_place"] - 1
    assert metrics.failures(trace, q, category="easy").collect() == [] and metrics.failures(trace, q, level=2).collect() == []
    assert {r["category"]: r["rate"] for r in metrics.failure_rates(trace, q).collect()} == {"easy": 0.0, "hard": 1.0}
    spread = {(r["level"], r["right"]): (r["n"], r["mean"]) for r in metrics.score_spread(scores).collect()}
    assert spread[2, True][0] == 2 and spread[2, False][0] == 10 and spread[2, True][1] > spread[2, False][1]


def test_first_of_falls_back_to_all(spark):
    q = spark.createDataFrame([(f"q{i:02d}", "easy" if i % 2 else "hard") for i in range(30)], "query_id string, difficulty string")
    easy = F.col("difficulty") == "easy"
    assert [r["query_id"] for r in suite.first_of(q, easy, 12).orderBy("query_id").collect()] == [f"q{i:02d}" for i in range(1, 25, 2)]
    assert [r["query_id"] for r in suite.first_of(q, easy, 12, least=16).orderBy("query_id").collect()] == [f"q{i:02d}" for i in range(12)]


def test_token_deltas(spark):
    df = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5)], "system string, tokens_used long")
    assert {r["system"]: (r["mean_tokens"], r["token_delta"]) for r in metrics.token_deltas(df, "a").collect()} == {"a": (15.0, 0.0), "b": (5.0, -10.0)}


def test_only_pairs_whose_scores_count_are_scored(spark, small):
    c, nodes, edges = small
    asked = []

    class Counting(retrieval.LexicalScorer):
        def score(self, pairs):
            asked.append(pairs.count())
            return super().score(pairs)

    q = spark.createDataFrame([("q1", "rollback a release in the deploy pipeline")], "query_id string, text string")
    routing.TreeRetriever(nodes, edges, c, hash_embedding, Counting(retrieval.Bm25(c).idf)).rank(q, 3).collect()
    assert asked == [3 * 5]  # the first five leaves of the three branches in the beam, none at the level of branches


def test_gate_ranks_only_the_queries_it_judges(spark, folder, monkeypatch):
    from leafline.plans import registry

    some, whole = [], registry._ranked
    rows = spark.range(300).select(F.format_string("q%03d", "id").alias("query_id"), F.lit("words of a release").alias("text"), F.lit("how").alias("category"), F.when(F.col("id") % 2 == 0, "easy").otherwise("hard").alias("difficulty"), F.array(F.lit("c1")).alias("gold"))
    monkeypatch.setattr(registry.inputs, "asked", lambda *_: rows)
    monkeypatch.setattr(registry, "_ranked", lambda *a, **k: [some.append(out := whole(*a, **k)), out][1])
    assert registry.failfast_gate(spark, folder).count() == 1
    assert some[0][0]["flat_ce"].select("query_id").distinct().count() == 100


def _refused(*_, **__):
    raise AssertionError("not needed")


def test_trace_scores_reads_no_vectors_of_nodes(spark, folder, monkeypatch):
    from leafline.plans import registry

    monkeypatch.setattr(tree, "reembed", _refused)
    monkeypatch.setattr(routing, "routing_trace", _refused)
    assert {(r["level"], r["right"]) for r in registry.trace_scores(spark, folder).collect()} >= {(1, True), (1, False)}


def test_failure_rates_walk_no_levels_of_the_tree(spark, folder, monkeypatch):
    from leafline.plans import registry

    monkeypatch.setattr(tree, "_inner_reach", _refused)
    rows = registry.trace_failure_rates(spark, folder).collect()
    assert rows and all(0 <= r["failed"] <= r["queries"] for r in rows)


def test_trace_failures_tell_only_of_scored_branches(spark, folder, monkeypatch):
    from leafline.plans import registry

    asked, whole = [], tree.summarise
    monkeypatch.setattr(tree, "summarise", lambda *a, **k: [asked.append((k["of"], out := whole(*a, **k))), out][1])
    assert registry.trace_failures(spark, folder).collect() is not None
    assert all(out.join(of, "node_id", "left_anti").count() == 0 for of, out in asked) and len(asked) == 1


def test_retriever_reads_leaves_below_branches_off_their_paths(spark, small, monkeypatch):
    c, nodes, edges = small
    want = set(tree.descendant_leaves(edges, nodes).collect())
    monkeypatch.setattr(tree, "_inner_reach", _refused)
    monkeypatch.setattr(routing, "descendant_leaves", _refused, raising=False)
    assert set(routing.TreeRetriever(nodes, edges, c, hash_embedding).below.collect()) == want


def test_failure_rates_number_no_children_off_the_way(spark, folder, monkeypatch):
    from leafline.plans import registry

    monkeypatch.setattr(tree, "build_tree", _refused)
    monkeypatch.setattr(tree, "_edges", _refused)
    rows = registry.trace_failure_rates(spark, folder).collect()
    assert rows and all(0 <= r["failed"] <= r["queries"] for r in rows)


@pytest.fixture(scope="module")
def suite_queries(spark, folder):
    """(ids of all queries, ids of those with gold, ids of those with a gold chunk that is there)."""
    from leafline.plans import inputs

    q = inputs.queries(spark, folder)
    g = inputs.gold(q)
    there = g.join(inputs.chunks(spark, folder).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return tuple({r["query_id"] for r in df.select("query_id").distinct().collect()} for df in (q, g, there))


def test_tree_metrics_count_every_query_with_gold(spark, folder, suite_queries):
    from leafline.plans import registry

    assert registry.ir_metrics_tree(spark, folder).first()["queries"] == len(suite_queries[1])


def test_agreement_counts_the_decisions_of_every_query(spark, folder, suite_queries, monkeypatch):
    from leafline.plans import registry

    traced, whole = [], metrics.agreement
    monkeypatch.setattr(metrics, "agreement", lambda *both: [traced.extend(both), whole(*both)][1])
    n = sum(r["decisions"] for r in registry.trace_agreement(spark, folder).collect())
    assert [{r["query_id"] for r in t.collect()} for t in traced] == [suite_queries[2]] * 2 and n == traced[1].count()


def test_failure_rates_are_of_every_query(spark, folder, suite_queries):
    from leafline.plans import registry

    assert sum(r["queries"] for r in registry.trace_failure_rates(spark, folder).collect()) == len(suite_queries[2])


def test_trace_failures_follow_every_query(spark, folder, suite_queries, monkeypatch):
    from leafline.plans import registry

    traced, whole = [], metrics.failures
    monkeypatch.setattr(metrics, "failures", lambda trace, q: [traced.append(trace), whole(trace, q)][1])
    found = {r["query_id"] for r in registry.trace_failures(spark, folder).collect()}
    assert found <= {r["query_id"] for r in traced[0].collect()} == suite_queries[2]


def test_trace_scores_hold_the_right_child_of_every_query(spark, folder, suite_queries):
    from leafline.plans import registry

    assert [r["n"] for r in registry.trace_scores(spark, folder).collect() if r["level"] == 1 and r["right"]] == [len(suite_queries[2])]


def test_tree_ranks_for_every_query(spark, folder, suite_queries):
    from leafline.plans import registry

    assert {r["query_id"] for r in registry.tree_topk(spark, folder).collect()} == suite_queries[0]
