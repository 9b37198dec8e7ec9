"""p1: clusters of mutually similar vectors by bisecting k-means, closed by an exact cosine check.

1. Entries are exploded to (chunk, unit vector); of a chunk listed more than once the entry of the latest row
   counts, even if its vector is unusable. A usable vector has ``dim`` finite numbers that are not all zero.
2. Bisecting k-means across the cluster: every pass routes all rows down the tree of centres and returns each
   open node's count, vector sum and a few members by smallest hash. Nodes that are neither compact nor small
   enough for one task are split, the one of largest dispersion first; all other centres move to their means. A tree
   has at most ``MAX_NODES`` nodes; a node that it leaves too large is split on by a tree of its own.
3. Every node of at most ``NODE_ROWS`` rows is bisected on inside one task until its leaves are compact or
   have ``LEAF_ROWS`` rows; larger compact nodes are dealt over several tasks by a hash of the id. A compact leaf (all
   cosines to its centre at least ``compactness``) cannot hold a pair under the threshold. Other leaves are checked
   exactly: members with a cosine of ``threshold`` or more are one part. Parts of a task whose centre-nearest members
   reach the threshold are one part as well.
4. Splits may cut a cluster, so all parts are checked against each other, exactly. Parts stand in blocks, in the order
   of the tree, and blocks and parts have balls (centre and radius). Two blocks meet in one task unless their balls are
   farther apart than the angle of the threshold; so do two parts there, and of two parts that may touch the members
   that can reach the other's ball are compared. Links are closed by label propagation over parts. No part or row
   is copied for nearness to a cut. Where balls prove nothing, which is so for blocks of unrelated directions, the
   pairs of parts (not of rows) grow with the square of their number, at one product of centres each.

What the driver holds is bounded: a tree, and a ball for each of at most ``MAX_BLOCKS`` blocks; it never sees rows, parts
or links. Chunks without a usable vector, and chunks alone in a cluster, get a cluster of one.
Entries with a null id are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.session import drop_table, materialize, small

DIM, THRESHOLD = 64, 0.75
NODE_ROWS, LEAF_ROWS, MAX_NODES = 16_384, 256, 4_096
SAMPLE = 96
#: Parts in a block of the closing step, blocks at most, and radians that make up for centres sent as half floats.
BLOCK, LARGE_BLOCK, MAX_BLOCKS, SLACK = 8_192, 65_536, 4_096, 1e-3
#: A part's number is that of its cell times this, plus its place in it; a cell's that of its node times ``DEALS``, plus its deal.
PLACES, DEALS = 1_000_000, 10_000


def compactness(threshold: float) -> float:
    """The cosine to a centre from which any two members reach ``threshold``: half its angle."""
    return float(np.cos(np.arccos(threshold) / 2))


def latest_vectors(cluster_nodes: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, vec): each chunk with its latest vector as ``dim`` packed unit float32, null if unusable."""
    src = cluster_nodes.select("chunk_ids", "embeddings", F.col("built_at").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            flat, times = ids.flatten(), batch.column(2).take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
            theirs = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            inner = lists.flatten()
            # position of each id's vector among all vectors; -1 where the two lists differ in length
            at = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = np.repeat(np.cumsum(theirs) - theirs, counts)
            place = np.where(at < np.repeat(theirs, counts), start + at, -1)
            lengths = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False)
            begins = np.cumsum(lengths) - lengths
            values = inner.flatten()
            numbers = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            good = (place >= 0) & (lengths[place] == dim if len(lengths) else False)
            rows = begins[place[good]][:, None] + np.arange(dim) if good.any() else np.zeros((0, dim), int)
            with np.errstate(all="ignore"):
                vec = numbers[rows]
                vec = vec / np.abs(vec).max(axis=1, keepdims=True)  # also keeps huge and tiny vectors in range
                vec = vec / np.linalg.norm(vec, axis=1, keepdims=True)
            fine = np.isfinite(vec).all(axis=1)
            usable = np.zeros(len(flat), bool)
            usable[np.flatnonzero(good)[fine]] = True
            packed = np.ascontiguousarray(vec[fine], dtype="<f4").tobytes()
            ends = np.concatenate([[0], np.cumsum(usable) * 4 * dim]).astype(np.int32)
            mask = np.packbits(usable, bitorder="little").tobytes()
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(flat), [pa.py_buffer(mask), pa.py_buffer(ends.tobytes()), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([flat, times, binary], ["id", "t", "vec"])

    rows = src.mapInArrow(run, "id string, t timestamp, vec binary").where(F.col("id").isNotNull())
    # entries of one row time are repeats of each other; a usable one comes first should they differ
    order = W.partitionBy("id").orderBy(F.col("t").desc_nulls_last(), F.col("vec").desc_nulls_last())
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("id", "vec")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a packed binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros((0, dim), np.float32)
    return np.frombuffer(column.buffers()[2], "<f4")[offsets[0] // 4 : offsets[-1] // 4].reshape(-1, dim)


def pack(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, "<f4")
    ends = (np.arange(len(x) + 1) * x.shape[1] * 4).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def two_means(x: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Two unit centres: from the member farthest from the mean and the member farthest from that one."""
    a = x[int(np.argmin(x @ unit(x.sum(0))))]
    pair = np.stack([a, x[int(np.argmin(x @ a))]])
    side = None
    for _ in range(rounds):
        now = (x @ (pair[1] - pair[0])) > 0
        if side is not None and (now == side).all():
            break
        side = now
        if side.all() or not side.any():
            break
        pair = np.stack([unit(x[~side].sum(0)), unit(x[side].sum(0))])
    return pair


class Tree:
    """Centres of a bisecting tree: ``kids[n]`` are the children of node ``n``; leaves have none."""

    def __init__(self, dim: int):
        self.centre, self.kids = [np.zeros(dim, np.float32)], [()]

    def split(self, node: int, pair: np.ndarray) -> None:
        self.kids[node] = (len(self.kids), len(self.kids) + 1)
        self.centre += [pair[0].astype(np.float32), pair[1].astype(np.float32)]
        self.kids += [(), ()]

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out = np.zeros(len(x), int)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if len(at) == 0 or not self.kids[node]:
                out[at] = node
                continue
            a, b = self.kids[node]
            right = (x[at] @ (self.centre[b] - self.centre[a])) > 0
            stack += [(a, at[~right]), (b, at[right])]
        return out


def node_statistics(vectors: DataFrame, tree: Tree, dim: int, node_rows: int, limit: float) -> list:
    """One row per open node: count, sum, least cosine to the present centre, and some members if it must be split."""

    keyed = vectors.select("h", "vec")
    share = max(2, -(-2 * SAMPLE // keyed.rdd.getNumPartitions()))  # all tasks together send about twice the sample of a node

    def local(batches):
        total: dict[int, list] = {}
        for batch in batches:
            x = matrix(batch.column(1), dim)
            leaf_of = tree.route(x)
            order = np.lexsort((batch.column(0).to_numpy(), leaf_of))
            cos = np.einsum("ij,ij->i", x, np.stack(tree.centre)[leaf_of])
            cuts = np.flatnonzero(np.r_[True, np.diff(leaf_of[order]) != 0, True]) if len(x) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                mine, leaf = order[lo:hi], int(leaf_of[order[lo]])
                n, s, least, some = total.get(leaf, (0, np.zeros(dim), 2.0, np.zeros((0, dim), np.float32)))
                some = np.concatenate([some, x[mine[: share - len(some)]]]) if len(some) < share else some
                total[leaf] = [n + len(mine), s + x[mine].sum(0, dtype=np.float64), min(least, float(cos[mine].min())), some]
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()), pack64(np.stack([total[k][1] for k in keys])),
                    pa.array([total[k][2] for k in keys], pa.float64()), pa.array([total[k][3].tobytes() for k in keys], pa.binary()),
                ],
                ["node", "n", "total", "least", "some"],
            )

    def merged(key, part):
        sums = np.frombuffer(b"".join(part.column("total").to_pylist()), "<f8").reshape(-1, dim).sum(0)
        some = np.frombuffer(b"".join(part.column("some").to_pylist()), "<f4").reshape(-1, dim)
        n, least = pc.sum(part.column("n")).as_py(), pc.min(part.column("least")).as_py()
        some = some[:: max(1, len(some) // SAMPLE)][:SAMPLE] if n > node_rows and least < limit else some[:0]
        return pa.table(
            {
                "node": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "total": pack64(sums[None]),
                "least": pa.array([least], pa.float64()), "some": pa.array([some.tobytes()], pa.binary()),
            }
        )

    shape = "node int, n long, total binary, least double, some binary"
    return keyed.mapInArrow(local, shape).groupBy("node").applyInArrow(merged, shape).collect()


def pack64(x: np.ndarray) -> pa.Array:
    return pa.array([row.astype("<f8").tobytes() for row in x], pa.binary())


def grow(vectors: DataFrame, dim: int, threshold: float, node_rows: int, max_nodes: int) -> tuple[Tree, dict[int, int], set[int]]:
    """The tree, the rows of each open node, and the open nodes that are too large only because the tree is full."""
    tree, limit = Tree(dim), compactness(threshold)
    while True:
        stats = node_statistics(vectors, tree, dim, node_rows, limit)
        sizes, wanted, full = {}, [], set()
        for row in stats:
            s = np.frombuffer(row["total"], "<f8")
            sizes[row["node"]] = row["n"]
            dispersion = row["n"] - np.linalg.norm(s)
            if np.linalg.norm(s) > 0:
                tree.centre[row["node"]] = unit(s).astype(np.float32)
            if row["n"] > node_rows and row["least"] < limit:
                wanted.append((dispersion, row["node"], np.frombuffer(row["some"], "<f4").reshape(-1, dim)))
        split = False
        for _, node, some in sorted(wanted, key=lambda w: -w[0]):
            pair = two_means(some)
            if float(np.linalg.norm(pair[1] - pair[0])) <= 1e-3:  # cannot be told apart by its sample
                continue
            if len(tree.kids) + 2 <= max_nodes:
                tree.split(node, pair)
                split = True
            else:
                full.add(node)
        if not split:
            return tree, sizes, full


def cells_of(vectors: DataFrame, dim: int, threshold: float, node_rows: int, max_nodes: int, base: int = 0) -> tuple[DataFrame, int]:
    """((cell, id, vec) of all (id, h, vec), the next free node number)."""
    tree, sizes, full = grow(vectors, dim, threshold, node_rows, max_nodes)

    def routed(batches):
        for batch in batches:
            if batch.num_rows:
                node = base + tree.route(matrix(batch.column(2), dim))
                yield pa.RecordBatch.from_arrays([pa.array(node), *batch.columns], ["node", "id", "h", "vec"])

    def dealt(batches):
        deals = np.array([min(DEALS, max(1, -(-sizes.get(k, 1) // node_rows))) for k in range(len(tree.kids))])
        for batch in batches:
            if batch.num_rows:
                node = batch.column(0).to_numpy()
                cell = node * DEALS + (batch.column(2).to_numpy() % 1_000_003) % deals[node - base]
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1), batch.column(3)], ["cell", "id", "vec"])

    rows = vectors.select("id", "h", "vec").mapInArrow(routed, "node long, id string, h long, vec binary")
    after = base + len(tree.kids)
    if not full:
        return rows.mapInArrow(dealt, "cell long, id string, vec binary"), after
    rows = materialize(rows.repartitionByRange("node").sortWithinPartitions("node"), "routed")  # a node's rows are read without the others
    large = {base + k for k in full}
    cells = rows.where(~F.col("node").isin(large)).mapInArrow(dealt, "cell long, id string, vec binary")
    for node in sorted(large):
        more, after = cells_of(rows.where(F.col("node") == node), dim, threshold, node_rows, max_nodes, after)
        cells = cells.unionByName(more)
    return cells, after


def leaves_of(x: np.ndarray, limit: float, leaf_rows: int) -> list[np.ndarray]:
    """Bisect the rows of ``x`` until each leaf is compact or has at most ``leaf_rows`` rows."""
    out, open_nodes = [], [np.arange(len(x))]
    while open_nodes:
        at = open_nodes.pop()
        if len(at) <= leaf_rows or float((x[at] @ unit(x[at].sum(0))).min()) >= limit:
            out.append(at)
            continue
        pair = two_means(x[at])
        side = (x[at] @ (pair[1] - pair[0])) > 0
        if side.all() or not side.any():  # cannot be told apart: deal them out, the exact check joins them again
            side = np.arange(len(at)) % 2 == 1
        open_nodes += [at[~side], at[side]]
    return out


def components(x: np.ndarray, threshold: float, block: int = 2048) -> np.ndarray:
    """The smallest index of the component of each row under cosines of ``threshold`` or more, block by block."""
    label = np.arange(len(x))
    while True:
        new = label.copy()
        for a in range(0, len(x), block):
            near = x[a : a + block] @ x.T >= threshold
            near[np.arange(near.shape[0]), np.arange(a, a + near.shape[0])] = True
            new[a : a + block] = np.where(near, label[None, :], len(x)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_parts(typical: np.ndarray, threshold: float, block: int = 1024) -> np.ndarray:
    """Component labels of parts: linked if their typical members reach the threshold."""
    src, dst = [np.zeros(0, int)], [np.zeros(0, int)]
    for a in range(0, len(typical), block):
        i, j = np.nonzero(typical[a : a + block] @ typical[a:].T >= threshold)
        keep = i < j
        src.append(i[keep] + a)
        dst.append(j[keep] + a)
    return heads_of(len(typical), np.concatenate(src), np.concatenate(dst))


def heads_of(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest number of the component of each of ``n`` under the links."""
    head = np.arange(n)
    while len(src):
        low = np.minimum(head[src], head[dst])
        new = head.copy()
        for at in (src, dst, head[src], head[dst]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == head).all():
            break
        head = new
    return head


def open_pairs(left: np.ndarray, right: np.ndarray, rl: np.ndarray, rr: np.ndarray, angle: float, strip: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the balls (unit centres, radii in radians) that are not proven farther apart than ``angle``."""
    a = rl + angle
    # centre cosine >= cos(a + r), with the cosine of the sum written as two more terms of the product
    x = np.column_stack([left, -np.cos(a), np.sin(a)]).astype(np.float32)
    y = np.column_stack([right, np.cos(rr), np.sin(rr)]).astype(np.float32).T
    wide = len(a) and len(rr) and a.max() + rr.max() >= np.pi
    rows, cols = [np.zeros(0, int)], [np.zeros(0, int)]
    for at in range(0, len(x), strip):
        near = x[at : at + strip] @ y >= 0
        if wide:
            near |= a[at : at + strip, None] + rr[None, :] >= np.pi
        i, j = np.nonzero(near)
        rows.append(i + at)
        cols.append(j)
    return np.concatenate(rows), np.concatenate(cols)


def touch(x: np.ndarray, y: np.ndarray, threshold: float, strip: int = 1024) -> bool:
    """Whether any row of ``x`` reaches the threshold with any row of ``y``."""
    return any(bool((x[at : at + strip] @ y.T >= threshold).any()) for at in range(0, len(x), strip))


def block_balls(parts: DataFrame, dim: int, blocks: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((block, part, c, radius, near) of the parts, the centre and the radius of the ball of each block).

    Blocks are runs of cells, so of neighbours in the tree; parts are counted by cell, never gathered.
    """

    def halved(batches):
        for batch in batches:
            c = matrix(batch.column(1), dim).astype("<f2")
            radius = np.arccos(np.clip(batch.column(2).to_numpy(), -1, 1)) + SLACK
            near = np.arccos(np.clip(batch.column(3).to_numpy(), -1, 1)) + SLACK
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in c], pa.binary()), pa.array(radius), pa.array(near)], ["part", "c", "radius", "near"])

    cell = F.floor(F.col("part") / PLACES)
    cells = parts.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    before, total = F.sum("n").over(W.orderBy("cell")) - F.col("n"), F.sum("n").over(W.partitionBy())
    cells = materialize(cells.select("cell", F.least(F.floor(before * blocks / total), F.lit(blocks - 1)).cast("int").alias("block")), "cells")  # a row a cell
    sent = parts.select("part", "centre", "least", "most").mapInArrow(halved, "part long, c binary, radius double, near double").withColumn("cell", cell)
    sent = materialize(sent.join(small(cells), "cell").select("block", "part", "c", "radius", "near"), "blocks")

    def folded(start, step):
        """Per block, what ``step`` makes of its centres and radii; tasks send one row a block."""

        def run(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                block, c, r = batch.column(0).to_numpy(), unpack(batch.column(1), dim), batch.column(2).to_numpy()
                for k in np.unique(block):
                    held[k] = step(held.get(k, start), c[block == k], r[block == k], k)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.astype("<f8").tobytes() for v in held.values()], pa.binary())], ["block", "v"])

        return [(r["block"], np.frombuffer(r["v"], "<f8")) for r in sent.select("block", "c", "radius").mapInArrow(run, "block int, v binary").collect()]

    centre, reach = np.zeros((blocks, dim)), np.zeros(blocks)
    for k, v in folded(np.zeros(dim), lambda s, c, r, k: s + c.sum(0, dtype=np.float64)):
        centre[k] += v
    centre = unit(centre)
    for k, v in folded(np.zeros(1), lambda s, c, r, k: np.maximum(s, (np.arccos(np.clip(unit(c) @ centre[k], -1, 1)) + r).max())):
        reach[k] = max(reach[k], v[0])
    return sent, centre, reach


def unpack(column, dim: int, kind: str = "<f2") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float32)


def exact_links(members: DataFrame, parts: DataFrame, dim: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b): all pairs of parts with members that reach the threshold.

    ``members``: part, vec; ``parts``: part, centre, least and most (cosine of a member to the centre). A pair is linked
    without its members where the centres are near enough for the most typical ones, or by one side's members where
    one of them is near enough for the other's most typical one; only of the rest members are brought together.
    """
    angle, n = float(np.arccos(threshold)), parts.count()
    # enough pairs of blocks for all tasks, but no more copies of a part than that; blocks of bounded size, and not too many
    enough = 2 + int(np.ceil(np.sqrt(8 * members.sparkSession.sparkContext.defaultParallelism)))
    blocks = max(1, min(-(-n // block), max(enough, -(-n // LARGE_BLOCK)), MAX_BLOCKS))
    sent, centre, reach = block_balls(parts, dim, blocks)
    apart = np.arccos(np.clip(centre @ centre.T, -1, 1)) > reach[:, None] + reach[None, :] + angle + SLACK
    meets = members.sparkSession.createDataFrame([(i, [j for j in range(blocks) if not apart[i, j] or i == j]) for i in range(blocks)], "block int, js array<int>")

    def met(key, group):
        i, j = divmod(key[0].as_py(), blocks)
        part, own, radius, near = (group.column(c).to_numpy() for c in ("part", "block", "radius", "near"))
        c = unpack(group.column("c"), dim)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        p, q = open_pairs(c[left], c[right], radius[left], radius[right], angle)
        p, q = left[p], right[q]
        keep = (part[p] < part[q]) | ((i != j) & (part[p] != part[q]))
        p, q = p[keep], q[keep]
        sure = near[p] + near[q]
        sure = (np.einsum("ij,ij->i", unit(c[p]), unit(c[q])) >= np.cos(np.minimum(angle - sure, np.pi))) & (sure < angle)
        head = heads_of(len(part), p[sure], q[sure])
        linked, keep = np.flatnonzero(head != np.arange(len(part))), head[p] != head[q]
        p, q = np.concatenate([p[keep], q[keep], head[linked]]), np.concatenate([q[keep], p[keep], linked])
        told = group.column("c").combine_chunks().take(pa.array(np.r_[q[: len(q) - len(linked)], np.full(len(linked), -1)], mask=np.arange(len(q)) >= len(q) - len(linked)))
        columns = [part[p] // PLACES, part[p], part[q], told, radius[q], near[q]]
        return pa.table([pa.array(v) for v in columns], names=["cell", "p", "q", "c", "radius", "near"])

    pair = F.least("block", "j") * blocks + F.greatest("block", "j")
    asked = sent.join(F.broadcast(meets), "block").withColumn("j", F.explode("js")).select("block", "part", "c", "radius", "near", pair.alias("pair"))  # a row a block, at most MAX_BLOCKS
    pairs = asked.groupBy("pair").applyInArrow(met, "cell long, p long, q long, c binary, radius double, near double")

    def reaching(rows, wanted):
        sure = wanted.filter(pc.is_null(wanted.column("c")))
        wanted = wanted.filter(pc.is_valid(wanted.column("c")))
        a, b = sure.column("p").to_numpy(), sure.column("q").to_numpy()
        found = [(np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), bool), np.full(len(a), -1))]
        part = rows.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        part = part[order]
        vec = rows.column("vec").combine_chunks().take(pa.array(order)) if wanted.num_rows else pa.array([], pa.binary())
        if wanted.num_rows:
            p, q, near = (wanted.column(k).to_numpy() for k in ("p", "q", "near"))
            by = np.argsort(p, kind="stable")
            x, c = unpack(vec, dim, "<f4"), unpack(wanted.column("c"), dim)
            least = np.cos(np.minimum(wanted.column("radius").to_numpy() + angle, np.pi)) - 1e-6
            enough = np.where(near < angle, np.cos(np.clip(angle - near, 0, np.pi)), 2)
            cuts = np.flatnonzero(np.r_[True, np.diff(p[by]) != 0, True])
            for s, e in zip(cuts[:-1], cuts[1:]):
                lo, hi = np.searchsorted(part, [p[by[s]], p[by[s]] + 1])
                for at in range(s, e, 1024):
                    some = by[at : min(at + 1024, e)]
                    cos = x[lo:hi] @ unit(c[some]).T
                    sure = (cos >= enough[some]).any(axis=0)
                    i, j = np.nonzero((cos >= least[some]) & ~sure)
                    for k, members, told in ((some[sure], np.full(int(sure.sum()), -1), False), (some[j], lo + i, True)):
                        found.append((np.minimum(p[k], q[k]), np.maximum(p[k], q[k]), (p[k] < q[k]) & told, members))
        a, b, low, at = (np.concatenate(f) for f in zip(*found))
        vecs = vec.take(pa.array(at, mask=at < 0)) if len(vec) else pa.nulls(len(at), pa.binary())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "low": pa.array(low), "vec": vecs})

    rows = members.select(F.floor(F.col("part") / PLACES).alias("cell"), "part", "vec")
    left = rows.groupBy("cell").cogroup(pairs.groupBy("cell")).applyInArrow(reaching, "a long, b long, low boolean, vec binary")

    def joined(key, group):
        low = group.column("low").to_numpy()
        x = unpack(group.column("vec"), dim, "<f4")
        hit = touch(x[low], x[~low], threshold)
        return pa.table({"a": pa.array([key[0].as_py()][:hit], pa.int64()), "b": pa.array([key[1].as_py()][:hit], pa.int64())})

    reached = materialize(left, "reached")
    sure = reached.where("vec IS NULL").select("a", "b").distinct()
    told = reached.where("vec IS NOT NULL")
    both = told.groupBy("a", "b").agg(F.bool_or("low").alias("l"), F.bool_and("low").alias("h")).where("l AND NOT h").select("a", "b").join(sure, ["a", "b"], "left_anti")
    return sure.unionByName(told.join(both, ["a", "b"]).groupBy("a", "b").applyInArrow(joined, "a long, b long"))


PART = "part long, centre binary, first_id string, n long, least double, most double, member string, vec binary, cosine double"


def cluster(
    cluster_nodes: DataFrame, dim: int = DIM, threshold: float = THRESHOLD, node_rows: int = NODE_ROWS, leaf_rows: int = LEAF_ROWS,
    max_nodes: int = MAX_NODES,
) -> tuple[DataFrame, DataFrame]:
    """(members: id, cluster, its size and parts, cosine to the centre of the member's part, vec; the unusable ids, each alone).

    ``cluster`` is the smallest id of the cluster.
    """
    all_rows = materialize(latest_vectors(cluster_nodes, dim).withColumn("h", F.xxhash64("id")), "vectors")
    unusable = materialize(all_rows.where(F.col("vec").isNull()).select("id"), "unusable")
    vectors = all_rows.where(F.col("vec").isNotNull())
    limit = compactness(threshold)

    def parts_of_cell(key, group):
        group = group.combine_chunks()
        x = matrix(group.column("vec").chunk(0), dim)
        ids = np.array(group.column("id").to_pylist(), dtype=object)
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        label = np.empty(len(x), int)
        for at in leaves_of(x, limit, leaf_rows):
            near = float((x[at] @ unit(x[at].sum(0))).min()) >= limit
            label[at] = at.min() if near else np.sort(at)[components(x[np.sort(at)], threshold)][np.argsort(np.argsort(at))]
        starts, code = np.unique(label, return_inverse=True)
        total = np.zeros((len(starts), dim))
        np.add.at(total, code, x)
        centre = unit(total).astype(np.float32)
        cos = np.einsum("ij,ij->i", x, centre[code])
        best = np.lexsort((np.arange(len(x)), -cos, code))
        typical = x[best[np.searchsorted(code[best], np.arange(len(starts)))]]
        head = link_parts(typical, threshold)  # parts that a split inside this task cut
        code = head[code]
        kept, code = np.unique(code, return_inverse=True)
        total = np.zeros((len(kept), dim))
        np.add.at(total, code, x)
        centre = unit(total).astype(np.float32)
        cos = np.einsum("ij,ij->i", x, centre[code])
        best = np.lexsort((np.arange(len(x)), -cos, code))
        typical = x[best[np.searchsorted(code[best], np.arange(len(kept)))]]
        part = key[0].as_py() * PLACES + code
        first = np.zeros(len(x), bool)
        first[best[np.searchsorted(code[best], np.arange(len(kept)))]] = True
        size, least = np.bincount(code), np.ones(len(kept))
        np.minimum.at(least, code, cos)
        most = np.full(len(kept), -1.0)
        np.maximum.at(most, code, cos)
        low = np.full(len(kept), len(x))
        np.minimum.at(low, code, np.arange(len(x)))
        at = pa.array(np.where(first, code, -1))
        at = pc.if_else(pc.equal(at, -1), pa.scalar(None, pa.int64()), at)
        pick = [col.take(at) for col in (pack(centre), pa.array(ids[low], pa.string()), pa.array(size, pa.int64()), pa.array(least, pa.float64()), pa.array(most, pa.float64()))]  # only at a part's first row
        names = ["part", "centre", "first_id", "n", "least", "most", "member", "vec", "cosine"]
        return pa.table([pa.array(part, pa.int64()), *pick, pa.array(ids, pa.string()), pack(x), pa.array(cos.astype(float))], names=names)

    cells, _ = cells_of(vectors, dim, threshold, node_rows, max_nodes)
    members = materialize(cells.groupBy("cell").applyInArrow(parts_of_cell, PART), "members")
    drop_table(all_rows)  # the members hold every usable vector
    parts = materialize(members.where("n IS NOT NULL").select("part", "centre", "first_id", "n", "least", "most"), "parts")
    heads = close_links(exact_links(members, parts, dim, threshold))
    whole = parts.join(heads, F.col("part") == F.col("id"), "left").select("part", "first_id", "n", F.coalesce("head", "part").alias("head"))
    named = whole.groupBy("head").agg(F.min("first_id").alias("cluster"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"))
    lookup = materialize(whole.join(named, "head").select("part", "cluster", "size", "parts"), "lookup")
    found = members.select("part", F.col("member").alias("id"), "cosine", "vec").join(lookup, "part").select("id", "cluster", "size", "cosine", "parts", "vec")
    lone = unusable.select("id", F.col("id").alias("cluster"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("double").alias("cosine"))
    return found, lone


def close_links(links: DataFrame) -> DataFrame:
    """(id, head): the smallest id of the component of every id in (a, b); hops double by following the heads."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")), "both")
    heads = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("head")), "heads")
    while True:
        sent = both.join(heads.select(F.col("id").alias("b"), "head"), "b").groupBy(F.col("a").alias("id")).agg(F.min("head").alias("seen"))
        step = heads.join(sent, "id").select("id", F.col("head").alias("was"), F.least("head", "seen").alias("via"))
        over = heads.select(F.col("id").alias("via"), F.col("head").alias("far"))
        new = materialize(step.join(over, "via", "left").select("id", "was", F.coalesce("far", "via").alias("head")), "heads")
        if new.where("was <> head").isEmpty():
            return new.select("id", "head")
        drop_table(heads)
        heads = materialize(new.select("id", "head"), "heads")


def found_pairs(cluster_nodes: DataFrame, **options) -> DataFrame:
    """(first_id, chunk_id): every chunk of a cluster of two or more but its smallest id."""
    members, _ = cluster(cluster_nodes, **options)
    return members.where(F.col("id") != F.col("cluster")).select(F.col("cluster").alias("first_id"), F.col("id").alias("chunk_id"))


def to_cluster_centre(members: DataFrame, dim: int) -> DataFrame:
    """(id, cluster, size, cosine): the cosine to the centre of the cluster; of a cluster in one part it is known."""
    cut = members.where("parts > 1").select("id", "cluster", "size", "vec")

    def local(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            x, names = matrix(batch.column(1), dim), batch.column(0).dictionary_encode()
            sums, code = np.zeros((len(names.dictionary), dim)), names.indices.to_numpy()
            np.add.at(sums, code, x)
            for name, s in zip(names.dictionary.to_pylist(), sums):
                total[name] = total.get(name, 0) + s
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pack64(np.stack(list(total.values())))], ["cluster", "total"])

    def merged(key, group):
        s = np.frombuffer(b"".join(group.column("total").to_pylist()), "<f8").reshape(-1, dim).sum(0)
        return pa.table({"cluster": pa.array([key[0].as_py()]), "centre": pack(unit(s)[None])})

    def measured(batches):
        for batch in batches:
            cos = np.einsum("ij,ij->i", matrix(batch.column(3), dim), matrix(batch.column(4), dim)).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cos)], ["id", "cluster", "size", "cosine"])

    centres = cut.select("cluster", "vec").mapInArrow(local, "cluster string, total binary").groupBy("cluster").applyInArrow(merged, "cluster string, centre binary")
    centres = materialize(centres, "centres")
    far = cut.join(small(centres), "cluster").select("id", "cluster", "size", "vec", "centre").mapInArrow(measured, "id string, cluster string, size long, cosine double")
    return members.where("parts = 1").select("id", "cluster", "size", "cosine").unionByName(far)


def cluster_report(cluster_nodes: DataFrame, typical: int = 3, dim: int = DIM, **options) -> DataFrame:
    """(cluster, size, typical): each cluster of usable vectors with its members nearest to the centre of the cluster.

    Each salt first keeps its own best members, so a hot cluster is cut down before it is ranked as one.
    """
    members = to_cluster_centre(cluster(cluster_nodes, dim=dim, **options)[0], dim)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("cosine", 6)).alias("c"), "id"))), 1, typical)
    salted = members.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64)))
    order = W.partitionBy("cluster", "_s").orderBy(F.desc(F.round("cosine", 6)), "id")
    cut = salted.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= typical)
    return cut.groupBy("cluster", "size").agg(best.alias("b")).select("cluster", "size", F.transform("b", lambda x: x["id"]).alias("typical"))
