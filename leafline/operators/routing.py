"""Routing queries through a tree: the scoring cascade, beam search, flat search over branches, and their race.

Every step handles all queries at once. ``queries`` are (query_id, vec); nodes and edges as in
:mod:`leafline.operators.tree`. ``pair_scores`` (query_id, chunk_id, score) stand for a pair scorer over leaf
texts; without them leaves keep their cosine. Scores are rounded to nine places before they are ranked, and ties
keep the order of the parent's children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.functions.vec import norm, normalise, path_ema
from leafline.operators import families
from leafline.operators.retrieval import LexicalScorer, PairScorer, many_top_k
from leafline.operators.tree import ROOT, child_label, child_scores, parents, path_closure, way_steps
from leafline.session import materialize, seen_value

#: More levels than this mean that the edges hold a cycle.
MAX_LEVELS = 100


def cascade(frontier: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame, pre_k: int = 5, final_k: int = 3, pair_scores: DataFrame | None = None) -> DataFrame:
    """(query_id, parent_id, child_id, score, child_rank, is_leaf, chunk_id) for (query_id, parent_id).

    ``pair_scores`` may be a function that scores the (query_id, chunk_id) it is given, those that are asked for. Children pass by cosine to the best ``pre_k``. Only if all of these are leaves are they scored as pairs; those
    without a pair score are dropped then, unless none has one.
    """
    asked = frontier.select("query_id", "parent_id").join(queries.select("query_id", "vec"), "query_id")
    by_parent = W.partitionBy("query_id", "parent_id")
    first = child_scores(nodes, edges, asked).withColumn("r", F.row_number().over(by_parent.orderBy(F.desc("cosine"), "child_pos"))).where(F.col("r") <= pre_k)
    if pair_scores is not None:
        first = first.withColumn("leaves", F.min("is_leaf").over(by_parent))
        if callable(pair_scores):
            first = materialize(first, "first", asked=F.count_if("leaves"))
            pair_scores = pair_scores(first.where("leaves").select("query_id", "chunk_id").distinct()) if seen_value(first, "asked") else None
    if pair_scores is None:
        scored = first.withColumn("score", F.col("cosine"))
    else:
        paired = first.join(pair_scores.select("query_id", "chunk_id", F.col("score").alias("pair")), ["query_id", "chunk_id"], "left")
        any_pair = F.max(F.col("pair").isNotNull()).over(by_parent)
        paired = paired.withColumn("use", F.col("leaves") & any_pair).where(~F.col("use") | F.col("pair").isNotNull())
        scored = paired.withColumn("score", F.when(F.col("use"), F.round("pair", 9)).otherwise(F.col("cosine")))
    last = by_parent.orderBy(F.desc("score"), "r")
    return (
        scored.withColumn("child_rank", F.row_number().over(last))
        .where(F.col("child_rank") <= final_k)
        .select("query_id", "parent_id", "child_id", "score", "child_rank", "is_leaf", "chunk_id")
    )


def diverse(candidates: DataFrame, width: int, penalty: float) -> DataFrame:
    """The best ``width`` of (query_id, parent_id, pos, path_score, ..) in order ``beam_pos``; fewer stay as they are.

    With one parent per node the greedy choice is a static sort: the best child of a parent is never penalised and
    always precedes its siblings, which all carry the penalty from then on.
    """
    by_query = W.partitionBy("query_id")
    family = W.partitionBy("query_id", "parent_id").orderBy(F.desc("path_score"), "pos")
    rows = candidates.withColumn("n", F.count(F.lit(1)).over(by_query)).withColumn("sorted", F.row_number().over(by_query.orderBy(F.desc("path_score"), "pos")))
    rows = rows.withColumn("key", F.round(F.col("path_score") - F.when(F.row_number().over(family) == 1, 0.0).otherwise(penalty), 9))
    rows = rows.withColumn("picked", F.row_number().over(by_query.orderBy(F.desc("key"), "sorted")))
    few = F.col("n") <= width
    rows = rows.where(few | (F.col("picked") <= width))
    place = F.when(few, F.row_number().over(by_query.orderBy("pos"))).otherwise(F.col("picked"))
    return rows.withColumn("beam_pos", place.cast("int")).drop("n", "sorted", "key", "picked")


def beam_search(
    queries: DataFrame, nodes: DataFrame, edges: DataFrame, width: int = 5, pre_k: int = 5, final_k: int = 3, penalty: float = 0.3, alpha: float = 0.5,
    pair_scores: DataFrame | None = None, levelled: bool = False, step=None,
) -> tuple[DataFrame, DataFrame]:
    """(trace: query_id, level, beam_pos, node_id, path_score; leaves: query_id, beam_pos, node_id, chunk_id, path_score).

    In a ``levelled`` tree, as ``build_tree`` makes it, children are one level below their node: a step reads only that level.
    ``step`` (frontier with above and parent_score, level) stands for :func:`cascade` where queries and children meet inside tasks.
    """
    nothing = F.lit(None).cast("string")
    state = queries.select("query_id", F.lit(0).alias("level"), F.lit(1).alias("beam_pos"), F.lit(ROOT).alias("node_id"), nothing.alias("parent_id"), F.lit(1.0).alias("path_score"))
    state = state.join(F.broadcast(nodes.where(F.col("level") == 0).select("node_id", "is_leaf", "chunk_id")), "node_id")
    inside = F.count_if(~F.col("is_leaf"))
    state = materialize(state, "beam", inside=inside)
    trace = state
    for level in range(1, MAX_LEVELS + 2):
        inner = state.where(~F.col("is_leaf"))
        if not seen_value(state, "inside"):
            break
        if level > MAX_LEVELS:
            raise ValueError(f"no leaf after {MAX_LEVELS} levels: the edges hold a cycle")
        over = inner.select("query_id", F.col("node_id").alias("parent_id"), F.col("beam_pos").alias("above"), F.col("path_score").alias("parent_score"))
        if step is not None:
            kids = step(over, level, pre_k, final_k)
        else:
            kids = cascade(inner.select("query_id", F.col("node_id").alias("parent_id")), nodes.where(F.col("level") == level) if levelled else nodes, edges, queries, pre_k, final_k, pair_scores)
            kids = kids.join(over, ["query_id", "parent_id"])
        fresh = kids.select(
            "query_id", F.lit(level).alias("level"), F.col("child_id").alias("node_id"), "parent_id", F.round(path_ema(F.col("score"), F.col("parent_score"), alpha), 9).alias("path_score"),
            "is_leaf", "chunk_id", (F.col("above") * 1000 + F.col("child_rank")).alias("pos"),
        )
        fresh = materialize(fresh, "fresh")
        active = fresh.select("query_id").distinct()
        carried = state.where("is_leaf").select("query_id", F.lit(level).alias("level"), "node_id", "parent_id", "path_score", "is_leaf", "chunk_id", (F.col("beam_pos") + 1_000_000_000).alias("pos"))
        moving = fresh.unionByName(carried.join(active, "query_id", "left_semi"))
        chosen = diverse(moving, width, penalty).select("query_id", "level", "beam_pos", "node_id", "parent_id", "path_score", "is_leaf", "chunk_id")
        chosen = materialize(chosen, "beam")
        trace = trace.unionByName(chosen)
        # queries without candidates end with the leaves they hold
        state = materialize(chosen.unionByName(state.where("is_leaf").join(active, "query_id", "left_anti").select(*chosen.columns)), "state", inside=inside)
    leaves = state.where("is_leaf").select("query_id", "beam_pos", "node_id", "chunk_id", "path_score")
    return trace.select("query_id", "level", "beam_pos", "node_id", "path_score"), leaves


def collapsed_search(queries: DataFrame, nodes: DataFrame, below: DataFrame, top_k: int = 10, pair_scores: DataFrame | None = None, most: int = 10) -> DataFrame:
    """(query_id, leaf_id, chunk_id, score, place, confidence): the best ``top_k`` branches by cosine, opened into their first ``most`` leaves.

    ``below`` is (node_id, leaf_id). A leaf keeps its first place; leaves of a branch follow in leaf order.
    ``pair_scores`` (query_id, node_id, score) re-rank the branches. No more than the first ``most`` leaves of any branch
    can be among a query's first ``most``, so a branch that a query found is cut to these, by salts first, before queries meet it.
    """
    return open_branches(flat_branches(queries, nodes, top_k, pair_scores), nodes, below, most)


def flat_branches(queries: DataFrame, nodes: DataFrame, top_k: int = 10, pair_scores: DataFrame | None = None) -> DataFrame:
    """(query_id, node_id, r, cosine, place, confidence): the branches of :func:`collapsed_search`."""
    branches = nodes.where(~F.col("is_leaf") & (norm(F.col("embedding")) > 0)).select(F.col("node_id").alias("chunk_id"), F.lit(0).alias("pos"), normalise(F.col("embedding")).alias("vec"))
    asked = queries.where(norm(F.col("vec")) > 0).select("query_id", normalise(F.col("vec")).alias("vec"))
    top = many_top_k(asked, branches, top_k, digits=9).select("query_id", F.col("chunk_id").alias("node_id"), F.col("score").alias("cosine"), F.col("rank").alias("r"))
    by_query = W.partitionBy("query_id")
    if pair_scores is not None:
        top = top.join(pair_scores, ["query_id", "node_id"]).select("query_id", "node_id", "r", F.round("score", 9).alias("cosine"))
    top = top.withColumn("place", F.row_number().over(by_query.orderBy(F.desc("cosine"), "r"))).withColumn("confidence", F.max("cosine").over(by_query))
    return materialize(top, "top")


def open_branches(top: DataFrame, nodes: DataFrame, below: DataFrame, most: int) -> DataFrame:
    """:func:`collapsed_search` from its branches on. What stands behind a branch with ``most`` leaves is never among the first ``most``."""
    by_query = W.partitionBy("query_id")
    cut = below.join(top.select("node_id").distinct(), "node_id", "left_semi")
    for keys in (["node_id", F.pmod(F.xxhash64("leaf_id"), F.lit(64))], ["node_id"]):
        cut = cut.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("leaf_id"))).where(F.col("_r") <= most)
    cut = materialize(cut.drop("_r"), "below")
    full = cut.groupBy("node_id").agg((F.count(F.lit(1)) >= most).alias("full"))
    ahead = by_query.orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    top = top.join(full, "node_id").withColumn("behind", F.coalesce(F.max("full").over(ahead), F.lit(False))).where("NOT behind").drop("full", "behind")
    leaves = top.join(cut, "node_id").groupBy("query_id", "leaf_id", "confidence").agg(F.min(F.struct("place", F.col("cosine").alias("score"))).alias("first"))
    out = leaves.withColumn("place", F.row_number().over(by_query.orderBy("first.place", "leaf_id"))).where(F.col("place") <= most)
    out = out.join(nodes.select(F.col("node_id").alias("leaf_id"), "chunk_id"), "leaf_id")
    return out.select("query_id", "leaf_id", "chunk_id", F.col("first.score").alias("score"), "place", "confidence")


def dual_path(beam_leaves: DataFrame, collapsed: DataFrame) -> DataFrame:
    """(query_id, strategy, leaf_id, chunk_id, score, place): the search with the higher confidence, ties to the beam.

    An empty search has confidence 0.
    """
    beam = beam_leaves.groupBy("query_id").agg(F.max("path_score").alias("b"))
    flat = collapsed.groupBy("query_id").agg(F.max("confidence").alias("c"))
    race = beam.join(flat, "query_id", "full").select("query_id", (F.coalesce("b", F.lit(0.0)) >= F.coalesce("c", F.lit(0.0))).alias("by_beam"))
    one = beam_leaves.join(race.where("by_beam"), "query_id").select(
        "query_id", F.lit("beam").alias("strategy"), F.col("node_id").alias("leaf_id"), "chunk_id", F.col("path_score").alias("score"), F.col("beam_pos").alias("place")
    )
    two = collapsed.join(race.where(~F.col("by_beam")), "query_id").select("query_id", F.lit("collapsed").alias("strategy"), "leaf_id", "chunk_id", "score", "place")
    return one.unionByName(two)


def resolve_leaves(result: DataFrame, top_k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks in the order of their leaves, each at its first place."""
    first = result.groupBy("query_id", "chunk_id").agg(F.min(F.struct("place", "score")).alias("f"))
    order = W.partitionBy("query_id").orderBy("f.place", "chunk_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query_id", "chunk_id", F.col("f.score").alias("score"), "rank")


def gold_path(gold: DataFrame, nodes: DataFrame, edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(query_id, parent_id, right_id, level): the links from the root to the first leaf of each query's gold chunk."""
    leaf = nodes.where("is_leaf").groupBy("chunk_id").agg(F.min("node_id").alias("leaf"))
    path = gold.join(leaf, "chunk_id").join(ancestors.select(F.col("node_id").alias("leaf"), F.col("ancestor_id").alias("right_id"), "ancestor_level"), "leaf").where("ancestor_level > 0")
    return path.join(edges.select("parent_id", F.col("child_id").alias("right_id")), "right_id").select("query_id", "parent_id", "right_id", F.col("ancestor_level").alias("level"))


def placed_trace(scores: DataFrame, path: DataFrame, score: str) -> DataFrame:
    family = W.partitionBy("query_id", "parent_id")
    placed = scores.withColumn("place", F.row_number().over(family.orderBy(F.desc(score), "child_pos"))).withColumn("siblings", F.count(F.lit(1)).over(family))
    right = placed.join(path, ["query_id", "parent_id"]).where(F.col("child_id") == F.col("right_id"))
    return right.select(
        "query_id", "level", F.col("right_id").alias("node_id"), F.round(score, 6).alias(score), F.col("place").cast("int").alias("place"), "siblings",
        (F.col("place") <= 1).alias("hit_top1"), (F.col("place") <= 3).alias("hit_top3"),
    )


def routing_trace(queries: DataFrame, gold: DataFrame, nodes: DataFrame, edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(query_id, level, node_id, cosine, place, siblings, hit_top1, hit_top3): along the gold path, the place of the
    right child among all children. ``gold`` is (query_id, chunk_id), one a query; the first leaf of the chunk counts."""
    path = gold_path(gold, nodes, edges, ancestors)
    return placed_trace(child_scores(nodes, edges, path.join(queries.select("query_id", "vec"), "query_id")), path, "cosine")


def family_trace(frontier: DataFrame, kids: DataFrame, crowd: DataFrame, score: str) -> DataFrame:
    """:func:`placed_trace` with ``others``, the scores of all wrong children, where queries and children meet inside tasks: of
    (query_id, parent_id, right_id, level, ..) and (child_id, label, ..) by ``cosine`` of vec and embedding or by the words (``pair``) of terms and content."""
    kinds = {c: frontier.schema[c].dataType.simpleString() for c in ("query_id", "level")}
    out = families.meet(frontier, kids, crowd, families.placed(score), f"query_id {kinds['query_id']}, level {kinds['level']}, node_id string, {score} double, place int, siblings long, others array<double>")
    return out.select("query_id", "level", "node_id", F.round(score, 6).alias(score), "place", "siblings", (F.col("place") <= 1).alias("hit_top1"), (F.col("place") <= 3).alias("hit_top3"), "others")


def word_trace(queries: DataFrame, ways: DataFrame, kids: DataFrame, crowd: DataFrame, scorer: LexicalScorer) -> tuple[DataFrame, DataFrame]:
    """:func:`pair_trace` along :func:`leafline.operators.tree.gold_ways`, with (child_id, label, content) of the children that are visited."""
    asked = queries.select("query_id", F.col("text").alias("query"))
    frontier = ways.join(asked.select("query_id"), "query_id").join(scorer.terms(asked), "query_id", "left")
    trace = materialize(family_trace(way_steps(frontier, "query_id", "mass", "terms", "weights"), kids, crowd, "pair"), "traced")
    wrong = trace.select("query_id", "level", F.explode("others").alias("score"), F.lit(False).alias("right"))
    return trace.drop("others"), trace.select("query_id", "level", F.col("pair").alias("score"), F.lit(True).alias("right")).unionByName(wrong)


def pair_trace(queries: DataFrame, gold: DataFrame, nodes: DataFrame, edges: DataFrame, ancestors: DataFrame, texts, scorer: PairScorer) -> tuple[DataFrame, DataFrame]:
    """(the same trace by a pair scorer over (query_id, text) and (node_id, content), scores of all children: query_id, level, score, right).

    ``texts`` may be a function that gives the texts of the (node_id) it is given, the nodes that are scored."""
    path = materialize(gold_path(gold, nodes, edges, ancestors), "path")
    kids = materialize(path.join(edges, "parent_id").select("query_id", "parent_id", "level", "child_id", "child_pos", (F.col("child_id") == F.col("right_id")).alias("right")), "kids")
    texts = texts(materialize(kids.select(F.col("child_id").alias("node_id")).distinct(), "scored")) if callable(texts) else texts
    pairs = kids.select("query_id", F.col("child_id").alias("node_id")).join(texts, "node_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    scores = scorer.score(pairs.select("query_id", F.col("node_id").alias("chunk_id"), "query", "content")).withColumnRenamed("chunk_id", "child_id")
    scored = materialize(kids.join(scores, ["query_id", "child_id"], "left").withColumn("pair", F.coalesce("score", F.lit(0.0))).drop("score"), "scored")
    return placed_trace(scored.drop("level"), path, "pair"), scored.select("query_id", "level", F.col("pair").alias("score"), "right")


def by_words(scorer) -> bool:
    """Whether a scorer scores as :class:`LexicalScorer` does, whose scores are known inside tasks."""
    return getattr(type(scorer), "score", None) is LexicalScorer.score


class TreeRetriever:
    """Ranks texts by a summary tree of ``build_tree``: beam search, raced by flat search over the branches, with leaves scored as pairs.

    ``embed`` maps (id, text) to (id, vec) in the space of the tree; ``scorer`` scores pairs over ``chunks`` (id, content).
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, embed, scorer: PairScorer | None = None, width: int = 5):
        self.nodes, self.edges, self.chunks, self.embed, self.scorer, self.width = nodes, edges, chunks, embed, scorer, width
        self.below = path_closure(edges, nodes.where("is_leaf")).select(F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("leaf_id"))

    def search(self, queries: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame]:
        """(trace of the beam, ranking)."""
        asked = materialize(self.embed(queries, "query_id", "text"), "asked")
        texts = self.chunks.select(F.col("id").alias("chunk_id"), "content")

        def pair_scores(pairs: DataFrame) -> DataFrame:
            return self.scorer.score(pairs.join(texts, "chunk_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id"))

        step = self._step(queries, asked, texts) if by_words(self.scorer) else None
        trace, leaves = beam_search(asked, self.nodes, self.edges, width=self.width, pair_scores=pair_scores if self.scorer else None, levelled=True, step=step)
        top = flat_branches(asked, self.nodes)
        # only where the flat search wins the race its branches are opened
        beam = leaves.groupBy("query_id").agg(F.max("path_score").alias("b"))
        ahead = F.coalesce("confidence", F.lit(0.0)) > F.coalesce("b", F.lit(0.0))
        wins = materialize(top.join(beam, "query_id", "left").where(ahead).drop("b"), "wins")
        flat = materialize(open_branches(wins, self.nodes, self.below, top_k), "flat")
        return trace, resolve_leaves(dual_path(leaves, flat), top_k)

    def _step(self, queries: DataFrame, asked: DataFrame, texts: DataFrame):
        """:func:`cascade` with queries and children inside tasks, for scorers by words: leaves' texts go to the level they are at."""
        known = queries.select("query_id", F.col("text").alias("query"))
        known = materialize(asked.select("query_id", "vec").join(self.scorer.terms(known), "query_id", "left"), "known")

        def step(frontier: DataFrame, level: int, pre_k: int, final_k: int) -> DataFrame:
            crowd = families.crowds(frontier)
            kids = parents(self.nodes.where(F.col("level") == level)).withColumn("label", child_label())
            kids = materialize(families.visited(kids, crowd), "kids", leaves=F.count_if("is_leaf"))
            paired = bool(seen_value(kids, "leaves"))
            if paired:
                kids = kids.join(texts.select("chunk_id", F.lower("content").alias("content")), "chunk_id", "left")
            met = frontier.join(known if paired else known.select("query_id", "vec"), "query_id")
            return families.meet(met, kids, crowd, families.best_children(pre_k, final_k, paired), out)

        kind = queries.schema["query_id"].dataType.simpleString()
        out = f"query_id {kind}, parent_id string, above int, parent_score double, child_id string, is_leaf boolean, chunk_id string, score double, child_rank int"
        return step

    def rank(self, queries: DataFrame, top_k: int = 50) -> DataFrame:
        return self.search(queries, top_k)[1]
