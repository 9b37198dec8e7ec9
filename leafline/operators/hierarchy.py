"""p4: parent-child links to full hierarchies, with cycles reported.

A link holds if either side records it; ids without a row, null elements and repeated links are ignored. A
node without any parent link is a root. The depth of a node is the smallest number of links from any root.

1. *Cycle separation.* Nodes with exactly one parent form chains that end at an *anchor* (a root or a node with
   several parents) or in a cycle. Pointer jumping, in rounds logarithmic in the length of these chains, finds each
   node's anchor and distance; nodes that never finish hang on cycles of single-parent nodes. The links into nodes
   with several parents, taken from the anchors, are a contracted weighted graph; shortest distances, which need as
   many rounds as a path has nodes with several parents, and strong components are solved there.
2. *Forest.* Each node hangs on the parent of its shortest path (of several the smallest id); a node without a path
   from a root hangs on its smallest parent, or on none if it is on a cycle.
3. *Heavy paths.* Subtree sizes come from the same jumps that find each node's root. The largest child of a node (of
   several the smallest id) continues its chain, so every node has a chain and a place in it, and no chain lies
   under more than log2(n) others.
4. *Answers from labels.* A node's depth is its place plus the depth of its chain's head; its path is the chain
   segments above it, then its own; its descendants are intervals: the rest of its own chain and whole chains that
   hang at or below its place. Links that are not in the forest (further parents, links on cycles) are closed over
   their targets alone, by doubling, and each target brings its own intervals along.

Rows with a null id are ignored; of a repeated id the latest row counts. Nodes on or reachable only from cycles
have null depth, root and path. An empty table gives empty results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.session import drop_table, latest_rows, materialize, seen_value

#: Pointer jumping triples its reach each round: chains of 3**40 links are beyond any table.
MAX_ROUNDS = 40
#: Places of a chain that are one join key when intervals are opened, so that a long chain is many keys.
SEGMENT = 512


def links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(latest nodes: id, level; distinct links: parent, child)."""
    rows = latest_rows(nodes, "node_id", "built_at", "level", "parent_ids", "child_ids")
    rows = materialize(rows.select(F.col("node_id").alias("id"), "level", "parent_ids", "child_ids"), "nodes")
    ids = rows.select("id")
    up = rows.select(F.explode("parent_ids").alias("parent"), F.col("id").alias("child"))
    down = rows.select(F.col("id").alias("parent"), F.explode("child_ids").alias("child"))
    up = up.where(F.col("parent").isNotNull()).join(ids.withColumnRenamed("id", "parent"), "parent", "left_semi")
    down = down.where(F.col("child").isNotNull()).join(ids.withColumnRenamed("id", "child"), "child", "left_semi")
    found = up.select("parent", "child").unionByName(down.select("parent", "child")).distinct()
    return rows.select("id", "level"), materialize(found, "links")


def _count(df: DataFrame, name: str) -> DataFrame:
    return materialize(df, name, n=F.count(F.lit(1)))


def _state(df: DataFrame) -> DataFrame:
    return materialize(df, "jump", open=F.count_if(~F.col("done")), far=F.max("steps"))


def ends_at(up: DataFrame) -> DataFrame:
    """Jump table over (id, up or null, ..): rows without ``up`` are ends, and all that is one link off an end is done."""
    rest = [c for c in up.columns if c not in ("id", "up")]
    ends = up.where("up IS NULL").select("id", *rest)
    inner = up.where("up IS NOT NULL").join(ends.select(F.col("id").alias("up"), F.lit(True).alias("hit")), "up", "left")
    return ends.select("id", F.col("id").alias("up"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("done"), *rest).unionByName(
        inner.select("id", "up", F.lit(1).cast("long").alias("steps"), F.coalesce("hit", F.lit(False)).alias("done"), *rest)
    )


def _onward(state: DataFrame, *rest: str) -> DataFrame:
    """Every open row of a jump table moved on twice by the jump of where it points; an end points at itself."""
    far = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("done").alias("done2"))
    moved = state.where(~F.col("done"))
    for _ in range(2):
        moved = moved.join(far, "up").select("id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("done2").alias("done"), *rest)
    return state.where("done").unionByName(moved)


def jump(start: DataFrame, keep: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """Pointer jumping over (id, up, steps, done); done rows point at their end. Returns the last state and the states before."""
    state, before, was = start, [], None
    for _ in range(MAX_ROUNDS):
        after = _state(_onward(state))
        if keep:
            before.append(state)
        else:
            drop_table(state)
        state = after
        if seen_value(state, "open") in (0, was):  # chain lengths have no holes: if nothing ended, nothing does in the next round either
            return state, before
        was = seen_value(state, "open")
    raise ValueError(f"chains of more than 3**{MAX_ROUNDS} links")


def closed_cycles(state: DataFrame) -> DataFrame:
    """(id) of the nodes on cycles, from the unfinished rows of :func:`jump`: the image that no longer shrinks."""
    f = state.where(~F.col("done")).select("id", "up")
    image = _count(f.select(F.col("up").alias("id")).distinct(), "image")
    while seen_value(image, "n"):
        f = materialize(f.join(f.select(F.col("id").alias("up"), F.col("up").alias("up2")), "up").select("id", F.col("up2").alias("up")), "loop")
        smaller = _count(f.select(F.col("up").alias("id")).distinct(), "image")
        same = seen_value(smaller, "n") == seen_value(image, "n")
        drop_table(image)
        image = smaller
        if same:
            break
    return image


def shortest(contracted: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, dist) of the anchors reachable from ``roots`` over (src, dst, weight); only changed rows travel on."""
    known = front = roots.select("id", F.lit(0).cast("long").alias("dist"))
    while True:
        reach = front.join(contracted.withColumnRenamed("src", "id"), "id").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("weight")).alias("new"))
        best = known.groupBy("id").agg(F.min("dist").alias("dist"))
        better = reach.join(best, "id", "left").where(F.col("dist").isNull() | (F.col("new") < F.col("dist"))).select("id", F.col("new").alias("dist"))
        front = _count(better, "front")
        if not seen_value(front, "n"):
            break
        known = known.unionByName(front)
    return known.groupBy("id").agg(F.min("dist").alias("dist"))


def _trim(edges: DataFrame) -> DataFrame:
    """Drop edges from sources nothing leads to and into targets that lead nowhere, until none is left to drop."""
    edges = _count(edges, "trim")
    while seen_value(edges, "n"):
        kept = edges
        for a, b in (("src", "dst"), ("dst", "src"), ("src", "dst")):
            kept = kept.join(kept.select(F.col(b).alias(a)), a, "left_semi").select("src", "dst")
        kept = _count(kept, "trim")
        same = seen_value(kept, "n") == seen_value(edges, "n")
        drop_table(edges)
        edges = kept
        if same:
            break
    return edges


def _spread(seed: DataFrame, edges: DataFrame) -> DataFrame:
    """Largest ``color`` that reaches each id over (src, dst), starting from (id, color); only changes travel on."""
    known = front = seed
    while True:
        colors = known.groupBy("id").agg(F.max("color").alias("color"))
        hop = lambda df: df.join(edges.withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id"), "color")
        one = hop(front)
        sent = one.unionByName(hop(one.distinct())).groupBy("id").agg(F.max("color").alias("new"))
        better = sent.join(colors, "id", "left").where(F.col("color").isNull() | (F.col("new") > F.col("color"))).select("id", F.col("new").alias("color"))
        front = _count(better, "front")
        if not seen_value(front, "n"):
            return colors
        known = known.unionByName(front)


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids on cycles of (src, dst): trim, colour forwards by the largest id, answer backwards."""
    edges, out = _trim(edges.select("src", "dst").distinct()), None
    while seen_value(edges, "n"):
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        colors = materialize(_spread(ids.select("id", F.col("id").alias("color")), edges), "colors")
        ends = edges.join(colors.select(F.col("id").alias("src"), F.col("color").alias("c1")), "src").join(
            colors.select(F.col("id").alias("dst"), F.col("color").alias("c2")), "dst"
        )
        same = materialize(ends.where("c1 = c2").select("src", "dst", "c1"), "same")
        back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        hit = _spread(colors.where("id = color"), back).select("id", F.col("color").alias("component"))
        out = hit if out is None else out.unionByName(hit)
        rest = same.select("src", "dst").join(hit.select(F.col("id").alias("src")), "src", "left_anti")
        edges = _trim(rest.join(hit.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    if out is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component"))
    # a colour root without a cycle of its own answers alone: only edges inside a component make a cycle
    return out


class Labels(NamedTuple):
    """``rows`` (id, level); ``found`` (parent, child); ``tree`` (id, parent, root, links, size, chain, pos, reached, in_cycle).

    ``links`` counts those from the root of the forest.
    """

    rows: DataFrame
    found: DataFrame
    tree: DataFrame


def separate(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, parent in the forest, reached from a root, in_cycle) of every node."""
    parents = found.groupBy(F.col("child").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("up"))
    table = materialize(rows.select("id").join(parents, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "up"), "parents")
    state, before = jump(ends_at(table.select("id", F.when(F.col("n") == 1, F.col("up")).alias("up"))), keep=True)
    cycles = closed_cycles(state)

    ended = state.where("done").select(F.col("id").alias("parent"), F.col("up").alias("src"), "steps")
    several = table.where("n > 1").select(F.col("id").alias("child"))
    contracted = found.join(several, "child", "left_semi").join(ended, "parent")
    contracted = materialize(contracted.select("src", F.col("child").alias("dst"), (F.col("steps") + 1).alias("weight"), "parent"), "contracted")
    dist = shortest(contracted.groupBy("src", "dst").agg(F.min("weight").alias("weight")), table.where("n = 0"))

    inner = contracted.join(several.withColumnRenamed("child", "src"), "src", "left_semi")  # roots are on no cycle
    scc = strong_components(inner)
    inside = inner.join(scc.select(F.col("id").alias("src"), F.col("component").alias("c1")), "src").join(
        scc.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst"
    )
    inside = materialize(inside.where("c1 = c2"), "inside", n=F.count(F.lit(1)), far=F.max("weight"))
    if seen_value(inside, "n"):
        on = inside.select(F.col("parent").alias("id")).distinct()
        near = [step for k, step in enumerate([*before, state]) if 3**k <= seen_value(inside, "far")]
        for step in near * 2:  # jumps of 1, 3, 9 ... links, each twice, mark every node between a parent and its anchor
            on = on.join(step.select("id", "up"), "id").select(F.explode(F.array("id", "up")).alias("id")).distinct()
        on = materialize(on, "on")
        cycles = cycles.unionByName(on.unionByName(inside.select(F.col("dst").alias("id")))).distinct()
    near = contracted.join(dist.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"))
    near = near.agg(F.min(F.struct(F.col("dist") + F.col("weight"), "parent")).alias("near")).select("id", F.col("near.parent").alias("near"))
    facts = (
        table.join(state.where("done").select("id", F.col("up").alias("anchor")), "id", "left")
        .join(dist.select(F.col("id").alias("anchor"), F.lit(True).alias("reached")), "anchor", "left")
        .join(cycles.select("id", F.lit(True).alias("in_cycle")), "id", "left")
        .join(near, "id", "left")
        .select("id", "n", "up", "near", F.coalesce("reached", F.lit(False)).alias("reached"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))
    )
    parent = F.when(F.col("reached"), F.when(F.col("n") > 1, F.col("near")).otherwise(F.col("up"))).when(~F.col("in_cycle"), F.col("up"))
    facts = materialize(facts.select("id", parent.alias("parent"), "reached", "in_cycle"), "facts")
    for t in [*before, state]:
        drop_table(t)
    return facts


def heavy_paths(facts: DataFrame) -> DataFrame:
    """``tree`` of :class:`Labels`."""
    state, k = ends_at(facts.select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"))), 0
    while k == 0 or (seen_value(state, "far") or 0) >= 3**k:
        # rows at exactly 3**k links, and at twice that, add what lies less than 3**k links below them to the ends of their jumps
        exact = state.where(F.col("steps") == 3**k)
        next_jump = exact.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        ends = exact.join(next_jump, "up", "left").select(F.explode(F.array_compact(F.array("up", "up2"))).alias("id"), "size")
        more = ends.groupBy("id").agg(F.sum("size").alias("more"))
        grown = _onward(state, "size").join(more, "id", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        after, k = _state(grown), k + 1
        drop_table(state)
        state = after
    sized = facts.join(state.select("id", F.col("up").alias("root"), F.col("steps").alias("links"), "size"), "id")
    heavy = (
        sized.where("parent IS NOT NULL")
        .groupBy("parent")
        .agg(F.min(F.struct((-F.col("size")).alias("s"), F.col("id").alias("i"))).alias("m"))
        .select(F.col("m.i").alias("id"), F.col("parent").alias("up"))
    )
    chains, _ = jump(ends_at(facts.select("id").join(heavy, "id", "left")))
    tree = materialize(sized.join(chains.select("id", F.col("up").alias("chain"), F.col("steps").alias("pos")), "id"), "tree")
    drop_table(chains)
    return tree


def chains_above(tree: DataFrame) -> DataFrame:
    """(chain, over, at, gap): the chains that a chain hangs under, with the place where; ``gap`` is the number of links from there to its head."""
    heads = tree.where("pos = 0 AND parent IS NOT NULL").select("chain", F.col("parent").alias("id"))
    hang = _count(heads.join(tree.select("id", F.col("chain").alias("over"), F.col("pos").alias("at")), "id").select("chain", "over", "at", F.lit(1).cast("long").alias("gap")), "hang")
    above = front = hang
    while seen_value(front, "n"):  # at most log2(n) times
        up = hang.select(F.col("chain").alias("over"), F.col("over").alias("over2"), F.col("at").alias("at2"))
        front = _count(front.join(up, "over").select("chain", F.col("over2").alias("over"), F.col("at2").alias("at"), (F.col("gap") + F.col("at") + 1).alias("gap")), "hang")
        above = above.unionByName(front)
    return above


def label(nodes: DataFrame) -> Labels:
    rows, found = links(nodes)
    return Labels(rows, found, heavy_paths(separate(found, rows)))


def depths(labels: Labels) -> DataFrame:
    """(.. of the tree, depth): place in the chain plus the depth of the chain's head; null for nodes no root reaches."""
    head = labels.tree.where("pos = 0").select("chain", F.col("links").alias("head"))
    return labels.tree.join(head, "chain").withColumn("depth", F.when(F.col("reached"), F.col("head") + F.col("pos"))).drop("head", "links")


def issues(nodes: DataFrame | None, labels: Labels | None = None) -> DataFrame:
    """(issue, node_id): ``cycle`` for nodes that are their own ancestors, ``level`` for levels that contradict the depth."""
    labels = labels or label(nodes)
    told = depths(labels).join(labels.rows, "id")
    bad = F.array_compact(F.array(F.when(F.col("in_cycle"), F.lit("cycle")), F.when(F.col("level") != F.col("depth"), F.lit("level"))))
    return told.select(F.explode(bad).alias("issue"), F.col("id").alias("node_id"))


def intervals(labels: Labels, above: DataFrame) -> DataFrame:
    """(node, chain, first, offset): what lies below each node in the forest, as chains from place ``first`` on.

    A place is ``offset`` + place links below the node.
    """
    own = labels.tree.select(F.col("id").alias("node"), "chain", (F.col("pos") + 1).alias("first"), (-F.col("pos")).alias("offset"))
    hung = labels.tree.select(F.col("id").alias("node"), F.col("chain").alias("over"), "pos").join(above, "over").where("pos <= at")
    return own.unionByName(hung.select("node", "chain", F.lit(0).cast("long").alias("first"), (F.col("at") - F.col("pos") + F.col("gap")).alias("offset")))


def opened(spans: DataFrame, tree: DataFrame) -> DataFrame:
    """(node_id, descendant_id, links) of intervals: joined to places by chain and segment of the chain, so that long chains are many keys."""
    place = tree.select("chain", F.floor(F.col("pos") / SEGMENT).alias("segment"), "pos", F.col("id").alias("descendant_id"))
    most = tree.groupBy("chain").agg(F.max("pos").alias("last"))
    wanted = spans.join(most, "chain").where("first <= last")
    wanted = wanted.withColumn("segment", F.explode(F.sequence(F.floor(F.col("first") / SEGMENT), F.floor(F.col("last") / SEGMENT))))
    hit = wanted.join(place, ["chain", "segment"]).where("pos >= first")
    return hit.select(F.col("node").alias("node_id"), "descendant_id", (F.col("offset") + F.col("pos")).alias("links"))


def all_descendants(labels: Labels, above: DataFrame | None = None) -> DataFrame:
    """(node_id, descendant_id, links): one row for each node and each node it reaches over (parent, child) links.

    ``links`` is the smallest number of them, at least one; a node on a cycle is its own descendant.
    """
    above = chains_above(labels.tree) if above is None else above
    tree, spans = labels.tree, intervals(labels, above)
    extra = labels.found.join(tree.select(F.col("parent"), F.col("id").alias("child")), ["parent", "child"], "left_anti")
    extra = _count(extra.join(tree.select(F.col("id").alias("parent"), "chain", "pos"), "parent").select("parent", "chain", "pos", "child"), "extra")
    if not seen_value(extra, "n"):
        return opened(spans, tree)
    # every node at or above the source of an extra link reaches its target: along the source's chain and the chains above it
    own = extra.select("chain", F.col("pos").alias("at"), F.lit(0).cast("long").alias("gap"), "child")
    over = extra.join(above, "chain").select(F.col("over").alias("chain"), "at", (F.col("gap") + F.col("pos")).alias("gap"), "child")
    base = tree.select("id", "chain", "pos").join(own.unionByName(over), "chain").where("pos <= at")
    base = base.groupBy(F.col("id").alias("node"), F.col("child").alias("target")).agg(F.min(F.col("at") - F.col("pos") + F.col("gap") + 1).alias("links"))
    base = materialize(base, "base")
    targets = extra.select(F.col("child").alias("node")).distinct()
    closed = materialize(base.join(targets, "node", "left_semi").select("node", "target", "links"), "closed")
    for _ in range(MAX_ROUNDS):
        far = closed.select(F.col("node").alias("target"), F.col("target").alias("to"), F.col("links").alias("more"))
        longer = closed.join(far, "target").select("node", F.col("to").alias("target"), (F.col("links") + F.col("more")).alias("links"), F.lit(False).alias("old"))
        both = closed.withColumn("old", F.lit(True)).unionByName(longer).groupBy("node", "target")
        both = both.agg(F.min("links").alias("links"), F.min(F.when(F.col("old"), F.col("links"))).alias("was"))
        after = materialize(both.select("node", "target", "links", (F.col("was").isNull() | (F.col("links") < F.col("was"))).alias("new")), "closed", n=F.count_if("new"))
        drop_table(closed)
        closed = after.drop("new")
        closed._leafline_path = after._leafline_path
        if not seen_value(after, "n"):
            break
    further = base.withColumnRenamed("target", "via").join(closed.select(F.col("node").alias("via"), "target", F.col("links").alias("more")), "via")
    reach = base.unionByName(further.select("node", "target", (F.col("links") + F.col("more")).alias("links")))
    reach = materialize(reach.groupBy("node", "target").agg(F.min("links").alias("links")), "targets")
    brought = spans.withColumnRenamed("node", "target").join(reach, "target").select("node", "chain", "first", (F.col("offset") + F.col("links")).alias("offset"))
    pairs = opened(spans.unionByName(brought), tree).unionByName(reach.select(F.col("node").alias("node_id"), F.col("target").alias("descendant_id"), "links"))
    return pairs.groupBy("node_id", "descendant_id").agg(F.min("links").alias("links"))


def paths(labels: Labels) -> DataFrame:
    """(node_id, root_id, depth, level, level_matches, in_cycle, path, chain_id, chain_pos, n_descendants).

    The ids of a chain stand in one array; that of no chain is longer than the path of its last node, which is one
    row of the result. ``n_descendants`` counts over all links.
    """
    chains = labels.tree.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("s"))
    chains = materialize(chains.select("chain", F.transform("s", lambda x: x["id"]).alias("ids")), "segments")
    above = chains_above(labels.tree)
    upper = above.join(chains.withColumnRenamed("chain", "over"), "over")
    upper = upper.select("chain", F.struct((-F.col("gap")).alias("g"), F.slice("ids", F.lit(1), F.col("at").cast("int") + 1).alias("ids")).alias("s"))
    prefix = upper.groupBy("chain").agg(F.array_sort(F.collect_list("s")).alias("s")).select("chain", F.flatten(F.transform("s", lambda x: x["ids"])).alias("prefix"))
    whole = chains.join(prefix, "chain", "left").select("chain", F.coalesce("prefix", F.array().cast("array<string>")).alias("prefix"), "ids")
    n = all_descendants(labels, above).groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    full = depths(labels).join(whole, "chain").join(labels.rows, "id").join(n, "id", "left")
    known = F.col("depth").isNotNull()
    return full.select(
        F.col("id").alias("node_id"), F.when(known, F.col("root")).alias("root_id"), "depth", "level", (F.col("level") == F.col("depth")).alias("level_matches"), "in_cycle",
        F.when(known, F.concat("prefix", F.slice("ids", F.lit(1), F.col("pos").cast("int") + 1))).alias("path"),
        F.col("chain").alias("chain_id"), F.col("pos").alias("chain_pos"), F.coalesce("n", F.lit(0).cast("long")).alias("n_descendants"),
    )
