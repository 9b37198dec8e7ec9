"""Summary trees over vectors: clustering into paths, node and edge tables, closures, shape and distinctiveness.

A node's id is its path from the root (``r.3.1``), so ancestors are prefixes and no join walks the tree.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.functions import text as X
from leafline.functions.vec import cosine, norm
from leafline.session import drop_table, materialize, seen_value, small
from leafline.sources.files import numbered

ROOT = "r"
#: Nodes whose centres are fitted at a time: what the driver holds and sends out does not grow with the table.
FIT_NODES = 4_096
#: Numbers in the vectors of one node that one task holds and splits on, with all levels below it.
TASK_NUMBERS = 1 << 22
#: Children of one node that are numbered in one task; more are numbered in ranges.
FAMILY_ROWS = 1 << 16
#: Numbers in the tasks' sums that the driver adds up itself; more are added up across the cluster.
DRIVER_NUMBERS = 1 << 22
#: Rows without texts that go to every task, after they were counted, where they are joined with all texts.
TEXT_ROWS = 200_000
#: Numbers in the vectors of one block of rows.
BLOCK_NUMBERS = 1 << 17


def kmeans_paths(vectors: DataFrame, branching: int = 10, depth: int = 2, rounds: int = 25, task_rows: int | None = None) -> DataFrame:
    """(chunk_id, path) of a k-ary hierarchical k-means over (chunk_id, vec): see :func:`kmeans_leaves`."""
    return kmeans_leaves(vectors.select("chunk_id", "vec"), branching, depth, rounds, task_rows, embedded=False).select("chunk_id", "path")


def kmeans_leaves(vectors: DataFrame, branching: int = 10, depth=2, rounds: int = 25, task_rows: int | None = None, embedded: bool = True, embed=None) -> DataFrame:
    """(chunk_id, ..others, path, members[, vec]) of a k-ary hierarchical k-means over (chunk_id, ..others, vec), level by level.

    The centres of every node that has more members than ``branching`` start from the members with the smallest id
    hashes and are fitted in Lloyd rounds over all members. A node with more than ``task_rows`` members is fitted across
    the cluster, one job a round; a smaller one is gathered once and split on in one task down to the last level. Empty
    clusters vanish; a node whose split leaves one cluster stays a leaf. Repeated ids and vectors are kept as they are.
    Rows travel in blocks, whose vectors are packed bytes: a round turns no number into a row and back. ``vectors`` are
    read once; ``depth`` may be a function of their number. ``embed`` makes batches that end with vec of batches that end
    with text, as :func:`leafline.functions.vec.hashed` does: then ``vectors`` have texts, and no vector leaves its task unpacked.
    """
    last = F.col("vec").cast("array<double>").alias("vec") if embed is None else F.col("text")
    rest = [c for c in vectors.columns if c not in ("chunk_id", "text" if embed else "vec")]
    src = vectors.select(F.col("chunk_id").cast("string"), *rest, last)
    rest = src.columns[:-1]
    kinds = {c: src.schema[c].dataType.simpleString() for c in rest}
    held = ", ".join(f"`{c}` array<{k}>" for c, k in kinds.items())
    state = materialize(src.mapInArrow(_blocks if embed is None else lambda batches: _blocks(embed(batches)), f"{held}, node binary, vec binary, dim int"), "blocks", dim=F.max("dim"), n=F.sum(F.size("chunk_id")))
    dim = seen_value(state, "dim") or 1
    depth = depth(seen_value(state, "n") or 0) if callable(depth) else depth
    most = max(branching, TASK_NUMBERS // max(1, dim)) if task_rows is None else max(branching, task_rows)
    paths: list[tuple] = [()]  # of the nodes by number, at most ``branching`` for each large node
    ended: dict[int, tuple] = {}  # the only cluster of a node: the node
    before: list[int] = []
    while True:
        size = {r["node"]: r["n"] for r in state.select("node").mapInArrow(_sizes, "node int, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}
        below: dict[tuple, list] = {paths[k]: [] for k in before}
        for k in size:
            if paths[k] and paths[k][:-1] in below:
                below[paths[k][:-1]].append(k)
        ended |= {some[0]: node for node, some in below.items() if len(some) == 1}
        large = [k for k, n in sorted(size.items()) if n > most and k not in ended and len(paths[k]) < depth]
        if not large:
            break
        moved = state
        for at in range(0, len(large), FIT_NODES):
            some = large[at : at + FIT_NODES]
            moved = moved.mapInArrow(_assign(some, fit_centres(state, some, dim, branching, rounds), len(paths), branching), moved.schema)
            paths += [(*paths[k], j) for k in some for j in range(branching)]
        moved = materialize(moved, "blocks")
        drop_table(state)
        state, before = moved, large
    whole = {k: n for k, n in size.items() if k in ended or len(paths[k]) >= depth}
    out = f"{', '.join(f'`{c}` {k}' for c, k in kinds.items())}, path array<int>, members long" + ", vec array<double>" * embedded
    ends = state.mapInArrow(_ends({k: ended.get(k, paths[k]) for k in whole}, whole, embedded), out)
    parts = state.mapInArrow(_parts(set(whole)), f"{held}, node int, vec binary, dim int")
    split = parts.groupBy("node").applyInArrow(_split({k: paths[k] for k in size if k not in whole}, branching, depth, rounds, embedded), out)
    seen = {"most": F.max("members")} | ({"length": F.max(F.size("vec"))} if embedded else {})
    leaves = materialize(ends.unionByName(split) if whole else split, "assigned", **seen)
    drop_table(state)
    return leaves


def _blocks(batches):
    """Rows (.., vec) as blocks of one row each: lists of the columns, nodes (0) and vectors as bytes."""
    for batch in batches:
        at, end = 0, batch.num_rows
        column = batch.column(batch.num_columns - 1)
        step = max(1, BLOCK_NUMBERS // max(1, len(column.flatten()) // max(1, end)))
        for at in range(0, end, step):
            some = batch.slice(at, step)
            x = np.ascontiguousarray(matrix(some.column(some.num_columns - 1)), np.float64)
            yield _block(some.columns[:-1], some.schema.names[:-1], x, pa.array([np.zeros(len(x), np.int32).tobytes()], pa.binary()))


def _block(columns, names: list[str], x: np.ndarray, node: pa.Array) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
    return pa.RecordBatch.from_arrays([*lists, node, pa.array([_packed(x)], pa.binary()), pa.array([x.shape[1]], pa.int32())], [*names, "node", "vec", "dim"])


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "lz4", asbytes=True)


def _unpacked(vec: pa.Scalar, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(vec.as_buffer(), 8 * rows * dim, "lz4"), np.float64).reshape(rows, dim)


def _opened(batch: pa.RecordBatch):
    """(row, nodes, vectors) of each block of a batch that ends with node, vec and dim."""
    at = batch.num_columns - 3
    for i in range(batch.num_rows):
        node = np.frombuffer(batch.column(at)[i].as_buffer(), np.int32)
        yield i, node, _unpacked(batch.column(at + 1)[i], len(node), batch.column(at + 2)[i].as_py())


def _sizes(batches):
    n = np.zeros(0, np.int64)
    for batch in batches:
        for node in batch.column(0):
            some = np.bincount(np.frombuffer(node.as_buffer(), np.int32))
            n, some = (n, some) if len(n) >= len(some) else (some, n)
            n = n + np.pad(some, (0, len(n) - len(some)))
    held = np.flatnonzero(n)
    if len(held):
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held], pa.int64())], ["node", "n"])


def _families(node: np.ndarray):
    """(node, its rows in their order) of each node."""
    order = np.argsort(node, kind="stable")
    kinds, at = np.unique(node[order], return_index=True)
    for k, lo, hi in zip(kinds.tolist(), at, [*at[1:], len(node)]):
        yield k, order[lo:hi]


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _ends(path: dict[int, tuple], size: dict[int, int], embedded: bool):
    """The rows of the nodes that are not split on."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names[:-3]
            for i, node, x in _opened(batch):
                rows = np.flatnonzero(np.isin(node, list(path)))
                if len(rows):
                    columns = [batch.column(c)[i].values.take(pa.array(rows)) for c in range(len(names))]
                    columns += [pa.array([list(path[k]) for k in node[rows].tolist()], pa.list_(pa.int32())), pa.array([size[k] for k in node[rows].tolist()], pa.int64())]
                    columns += [_vectors(x[rows])] if embedded else []
                    yield pa.RecordBatch.from_arrays(columns, [*names, "path", "members", *["vec"] * embedded])

    return run


def _parts(leave: set[int]):
    """Blocks cut up by their nodes, without those of ``leave``."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names[:-3]
            for i, node, x in _opened(batch):
                some = [(k, rows) for k, rows in _families(node) if k not in leave]
                if not some:
                    continue
                order, ends = pa.array(np.concatenate([rows for _, rows in some])), pa.array(np.cumsum([0, *[len(rows) for _, rows in some]]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, batch.column(c)[i].values.take(order)) for c in range(len(names))]
                packed = [pa.array([k for k, _ in some], pa.int32()), pa.array([_packed(x[rows]) for _, rows in some], pa.binary()), pa.array([x.shape[1]] * len(some), pa.int32())]
                yield pa.RecordBatch.from_arrays([*lists, *packed], [*names, "node", "vec", "dim"])

    return run


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The first nearest centre of each row: by products, and by differences where these leave it open."""
    label = np.empty(len(x), np.int64)
    length = (centres * centres).sum(1)
    for at in range(0, len(x), 4096):
        some = x[at : at + 4096]
        far = length - 2.0 * (some @ centres.T)
        found = far.argmin(1)
        best = far[np.arange(len(some)), found]
        slack = 1e-9 * max(1.0, length.max(), np.einsum("ij,ij->i", some, some).max())
        unsure = np.flatnonzero(~np.isfinite(best) | ((far <= (best + slack)[:, None]).sum(1) > 1))
        for lo in range(0, len(unsure), 512):
            rows = unsure[lo : lo + 512]
            found[rows] = ((some[rows, None, :] - centres[None, :, :]) ** 2).sum(2).argmin(1)
        label[at : at + 4096] = found
    return label


def sums_by_nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, sum of the members) of each centre, piece by piece while a piece is in the CPU's cache."""
    n, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape)
    for at in range(0, len(x), 1024):
        some = x[at : at + 1024]
        label = nearest(some, centres)
        mark = np.zeros((len(centres), len(some)))
        mark[label, np.arange(len(some))] = 1.0
        n += np.bincount(label, minlength=len(centres))
        total += mark @ some
    return n, total


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A column of vectors as rows; vectors of different lengths are an error."""
    x = column.flatten().to_numpy(zero_copy_only=False)
    dim = dim or len(x) // max(1, len(column))
    if len(x) != len(column) * dim:
        raise ValueError(f"vectors of other lengths than {dim}")
    return x.reshape(-1, dim)


def _still(new: np.ndarray, old: np.ndarray) -> bool:
    return bool((np.abs(new - old) <= 1e-8 + 1e-5 * np.abs(old)).all())


def _hashes(ids: list) -> list[tuple[str, str]]:
    """What members are ordered by: the hash of the id, then the id; no id comes first."""
    return [("", "") if i is None else (hashlib.md5(i.encode()).hexdigest(), i) for i in ids]


def _split(paths: dict[int, tuple], branching: int, depth: int, rounds: int, embedded: bool):
    """All levels below one node, inside a task; members stay in the order of their id hashes, from which centres start."""

    def lloyd(x: np.ndarray) -> np.ndarray:
        centres = x[:branching].copy()
        for _ in range(rounds):
            n, total = sums_by_nearest(x, centres)
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
            if _still(new, centres):
                break
            centres = new
        return nearest(x, centres)

    def run(table: pa.Table) -> pa.Table:
        names = table.column_names[:-3]
        dims = set(table.column("dim").to_pylist())
        if len(dims) > 1:
            raise ValueError(f"vectors of {sorted(dims)} numbers")
        dim = dims.pop()
        x = np.concatenate([_unpacked(v, len(i.values), dim) for v, i in zip(table.column("vec"), table.column("chunk_id"))])
        columns = {c: pa.concat_arrays([v.flatten() for v in table.column(c).chunks]) for c in names}
        keys = _hashes(columns["chunk_id"].to_pylist())
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        x = x[order]
        todo = [(np.arange(len(x)), list(paths[table.column("node")[0].as_py()]))]
        found_paths, sizes, at = [], [], np.empty(len(x), np.int64)
        while todo:
            rows, path = todo.pop()
            label = lloyd(x[rows]) if len(rows) > branching and len(path) < depth else np.zeros(len(rows), np.int64)
            found = np.unique(label)
            if len(found) > 1:
                todo += [(rows[label == k], [*path, int(k)]) for k in found]
            else:
                at[rows] = len(found_paths)
                found_paths.append(path)
                sizes.append(len(rows))
        took = {c: v.take(pa.array(order)) for c, v in columns.items()} | {"path": pa.array(found_paths, pa.list_(pa.int32())).take(pa.array(at)), "members": pa.array(sizes, pa.int64()).take(pa.array(at))}
        return pa.table(took | ({"vec": _vectors(x)} if embedded else {}))

    return run


def _assign(nodes: list[int], centres: list[np.ndarray], first: int, branching: int):
    """Moves the members of ``nodes`` into the cluster of their nearest centre; other rows stay. Clusters are numbered on from ``first``."""
    number = {k: (at, centre) for at, (k, centre) in enumerate(zip(nodes, centres))}

    def run(batches):
        for batch in batches:
            moved = []
            for _, node, x in _opened(batch):
                new = node.copy()
                for k, rows in _families(node):
                    if k in number:
                        at, centre = number[k]
                        new[rows] = first + at * branching + nearest(x[rows], centre)
                moved.append(new.astype(np.int32).tobytes())
            at = batch.num_columns - 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(moved, pa.binary()), *batch.columns[at + 1 :]], batch.schema.names)

    return run


def fit_centres(state: DataFrame, nodes: list[int], dim: int, branching: int, rounds: int) -> list[np.ndarray]:
    """The centres of some nodes of blocks (chunk_id, .., node, vec, dim): Lloyd rounds over all members, sums added up in tasks."""

    def first(batches):
        best: dict[int, list] = {}
        for batch in batches:
            for i, node, x in _opened(batch):
                ids = batch.column(0)[i].as_py()
                for k, rows in _families(node):
                    if k in wanted:
                        keys = _hashes([ids[r] for r in rows])
                        some = [(keys[r], x[rows[r]].tobytes()) for r in heapq.nsmallest(branching, range(len(keys)), key=keys.__getitem__)]
                        best[k] = heapq.nsmallest(branching, [*best.get(k, []), *some], key=lambda m: m[0])
        found = [(k, h, i, v) for k, some in best.items() for (h, i), v in some]
        if found:
            k, h, i, v = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(h, pa.string()), pa.array(i, pa.string()), pa.array(v, pa.binary())], ["node", "h", "chunk_id", "vec"])

    wanted = set(nodes)
    some = state.select("chunk_id", "node", "vec", "dim").mapInArrow(first, "node int, h string, chunk_id string, vec binary")
    some = some.withColumn("_r", F.row_number().over(W.partitionBy("node").orderBy("h", "chunk_id"))).where(F.col("_r") <= branching)
    start: dict[int, list] = {}
    for r in some.select("node", "_r", "vec").orderBy("node", "_r").collect():
        start.setdefault(r["node"], []).append(np.frombuffer(r["vec"], np.float64))
    if any(len(v) != dim for vs in start.values() for v in vs):
        raise ValueError(f"vectors of other lengths than {dim}")
    centre = {k: np.array(start[k]) for k in nodes}
    moving = list(nodes)
    tasks = state.rdd.getNumPartitions()

    def sums(now: dict[int, np.ndarray]):
        def run(batches):
            total: dict[int, tuple] = {}
            for batch in batches:
                for _, node, x in _opened(batch):
                    if x.shape[1] != dim:
                        raise ValueError(f"vectors of other lengths than {dim}")
                    for k, rows in _families(node):
                        if k in now:
                            members = x[rows] if len(rows) < len(x) else x
                            n, s = sums_by_nearest(members, now[k])
                            total[k] = (total[k][0] + n, total[k][1] + s) if k in total else (n, s)
            keys = [(k, j) for k, (n, _) in total.items() for j in np.flatnonzero(n)]
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([total[k][0][j] for k, j in keys], pa.int64()), pa.array([total[k][1][j] for k, j in keys], pa.list_(pa.float64()))],
                    ["node", "label", "n", "total"],
                )

        return run

    for _ in range(rounds):
        if not moving:
            break
        added = state.select("node", "vec", "dim").mapInArrow(sums({k: centre[k] for k in moving}), "node int, label int, n long, total array<double>")
        if len(moving) * branching * dim * tasks > DRIVER_NUMBERS:
            added = added.groupBy("node", "label").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total"))
        total: dict[tuple, tuple] = {}
        for r in added.collect():
            n, t = total.get((r["node"], r["label"]), (0, 0.0))
            total[r["node"], r["label"]] = n + r["n"], t + np.array(r["total"])
        new = {k: centre[k].copy() for k in moving}
        for (k, j), (n, t) in total.items():
            new[k][j] = t / n
        moving = [k for k in moving if not _still(new[k], centre[k])]
        for k in moving:
            centre[k] = new[k]
    return [centre[k] for k in nodes]


def vector_sums(rows: DataFrame, vec: str, dim: int, *keys: str) -> DataFrame:
    """(..keys, n, total): rows and the sum of their vectors of ``dim`` numbers, without a row for each number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _each(vec, dim).alias("total"))


def _each(vec: str, dim: int, f=F.sum) -> Column:
    return F.array(*[f(F.get(vec, i)) for i in range(dim)])


def build_tree(assignments: DataFrame, vectors: DataFrame | None = None, branching: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from (chunk_id, path): a cluster of one is a leaf, a larger one a branch with its members as leaves.

    A branch's vector is the mean of its members. Children are ordered by label, leaves by chunk id. Without ``vectors``
    the assignments are those of :func:`kmeans_leaves` with ``branching``; if these have no vectors, the nodes have none.
    """
    label = lambda p: F.concat_ws(".", F.lit(ROOT), p)
    alone = (F.col("members") == 1) & (F.size("path") > 0)
    if vectors is not None:
        rows = assignments.join(vectors.select(F.col("chunk_id").cast("string"), F.col("vec").cast("array<double>").alias("vec")), "chunk_id")
        rows = rows.withColumn("cluster", label(F.transform("path", lambda x: x.cast("string"))))
        single = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
        rows = rows.join(single, "cluster")
    else:
        rows = assignments.withColumn("cluster", label(F.col("path").cast("array<string>")))
    leaves = rows.select(F.when(alone, F.col("cluster")).otherwise(F.concat_ws(".", "cluster", "chunk_id")).alias("node_id"), "chunk_id", *(["vec"] if "vec" in rows.columns else []), "path", "cluster", "members")
    leaves = leaves.withColumn("level", F.size("path") + F.when(alone, 0).otherwise(1))
    if vectors is None and "vec" not in leaves.columns:
        up = leaves.groupBy("path", "level").agg(F.count(F.lit(1)).alias("n")).select("path", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("level"))
        branches = up.select(label(F.slice(F.col("path").cast("array<string>"), F.lit(1), F.col("level"))).alias("node_id"), "level").distinct()
        branches = materialize(branches, "branches").select("node_id", "level", F.lit(False).alias("is_leaf"), F.lit(None).cast("string").alias("chunk_id"))
        nodes = leaves.select("node_id", "level", F.lit(True).alias("is_leaf"), "chunk_id").unionByName(branches)
        return nodes, _edges(nodes, seen_value(assignments, "most"), branching)
    if vectors is not None:
        leaves = materialize(leaves, "leaves", least=F.min(F.size("vec")), most=F.max(F.size("vec")), gaps=F.count_if(F.exists("vec", lambda x: x.isNull())))
        dim = seen_value(leaves, "most") or 0
        even = dim == seen_value(leaves, "least") and not seen_value(leaves, "gaps")
    else:
        dim, even = seen_value(assignments, "length") or 0, True
    # the sums of the lowest clusters, added up above them; each number has a count of its own only where vectors differ in length
    low = leaves.where("vec IS NOT NULL").groupBy("path", "level").agg(_each("vec", dim).alias("total"), (F.count(F.lit(1)) if even else _each("vec", dim, F.count)).alias("n"))
    up = low.select("path", "n", "total", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("at"))
    up = up.withColumn("node_id", label(F.slice(F.transform("path", lambda x: x.cast("string")), F.lit(1), F.col("at"))))
    sums = up.groupBy("node_id", F.col("at").alias("level")).agg((F.sum("n") if even else _each("n", dim)).alias("n"), _each("total", dim).alias("total"))
    if even:
        mean = F.transform("total", lambda t: t / F.col("n"))
    else:
        mean = F.transform(F.filter(F.zip_with("total", "n", lambda t, n: F.struct(t.alias("t"), n.alias("n"))), lambda p: p["n"] > 0), lambda p: p["t"] / p["n"])
    branches = sums.select("node_id", "level", mean.alias("embedding"))
    branches = branches if vectors is not None else materialize(branches, "branches")
    nodes = leaves.select("node_id", "level", F.lit(True).alias("is_leaf"), "chunk_id", F.col("vec").alias("embedding")).unionByName(
        branches.select("node_id", "level", F.lit(False).alias("is_leaf"), F.lit(None).cast("string").alias("chunk_id"), "embedding")
    )
    if vectors is None:
        return nodes, _edges(nodes, seen_value(assignments, "most"), branching)
    nodes = materialize(nodes, "nodes")
    return nodes, _edges(nodes)


def _edges(nodes: DataFrame, members: int | None = None, branching: int | None = None) -> DataFrame:
    """(parent_id, child_id, child_pos); ``members`` are the most leaves of a cluster and ``branching`` the most branches of a node, where that is known."""
    return _placed(parents(nodes).select("parent_id", "child_id"), members, branching)


def parents(nodes: DataFrame) -> DataFrame:
    """(parent_id, child_id, ..others) of the nodes (node_id, ..) of :func:`build_tree` below the root, read off their ids."""
    return nodes.where("level > 0").select(
        F.when(F.col("is_leaf") & F.expr("right(node_id, length(chunk_id) + 1) = concat('.', chunk_id)"), F.expr("left(node_id, length(node_id) - length(chunk_id) - 1)"))
        .otherwise(F.regexp_replace("node_id", r"\.\d+$", ""))
        .alias("parent_id"),
        F.col("node_id").alias("child_id"), *[c for c in nodes.columns if c != "node_id"],
    )


def child_label() -> Column:
    """What the children of a node are ordered by, before child_id."""
    return F.coalesce(F.expr("try_cast(regexp_extract(child_id, '([^.]+)$', 1) AS bigint)"), F.lit((1 << 63) - 1))


def _placed(child: DataFrame, members: int | None, branching: int | None) -> DataFrame:
    """(parent_id, child_id, child_pos) of (parent_id, child_id), in the order of labels."""
    last = child_label()
    if members is not None and branching is not None and members + branching <= FAMILY_ROWS:
        place = F.row_number().over(W.partitionBy("parent_id").orderBy(last, "child_id")) - 1
        return materialize(child.select("parent_id", "child_id", place.cast("int").alias("child_pos")), "edges")
    # a hot parent's children are numbered in ranges, not in one task
    placed = materialize(numbered(child.select("parent_id", "child_id", last.alias("label")), "parent_id", "label", "child_id"), "placed")
    first = placed.groupBy("parent_id").agg(F.min("n").alias("first"))
    return materialize(placed.join(first, "parent_id").select("parent_id", "child_id", (F.col("n") - F.col("first")).cast("int").alias("child_pos")), "edges")


def families(leaves: DataFrame, of: DataFrame, branching: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of :func:`build_tree` over the leaves of :func:`kmeans_leaves`, of those families that lie on the way to the leaves
    of some chunks (chunk_id): all children of every node above these, without vectors."""
    label = lambda p: F.concat_ws(".", F.lit(ROOT), p.cast("array<string>"))
    alone = (F.col("members") == 1) & (F.size("path") > 0)
    top = F.slice("path", F.lit(1), F.size("path") - alone.cast("int"))  # the lowest branch above a leaf
    rows = leaves.select("chunk_id", "path", "members", label(top).alias("parent_id"))
    some = materialize(rows.join(small(of.select("chunk_id").distinct()), "chunk_id", "left_semi").select(top.alias("top")).distinct(), "ways")
    ways = some.select(F.col("top"), F.explode(F.sequence(F.lit(0), F.size("top"))).alias("at")).select(label(F.slice("top", F.lit(1), F.col("at"))).alias("parent_id")).distinct()
    ways = small(materialize(ways, "ways"), TEXT_ROWS)
    low = rows.join(ways, "parent_id", "left_semi")
    own = F.when(alone, label(F.col("path"))).otherwise(F.concat_ws(".", "parent_id", "chunk_id"))
    low = low.select("parent_id", own.alias("node_id"), (F.size(top) + 1).alias("level"), F.lit(True).alias("is_leaf"), "chunk_id")
    up = leaves.select(top.alias("top")).distinct().where(F.size("top") > 0).select("top", F.explode(F.sequence(F.lit(1), F.size("top"))).alias("level"))
    up = up.select(label(F.slice("top", F.lit(1), F.col("level") - 1)).alias("parent_id"), label(F.slice("top", F.lit(1), F.col("level"))).alias("node_id"), "level")
    up = up.join(ways, "parent_id", "left_semi").distinct().select("*", F.lit(False).alias("is_leaf"), F.lit(None).cast("string").alias("chunk_id"))
    nodes = materialize(low.unionByName(up), "families")
    return nodes.drop("parent_id"), _placed(nodes.select("parent_id", F.col("node_id").alias("child_id")), seen_value(leaves, "most"), branching)


def gold_ways(leaves: DataFrame, of: DataFrame) -> DataFrame:
    """(query_id, top, own) of (query_id, chunk_id): the path of the lowest branch above each chunk's leaf of :func:`kmeans_leaves`, and the leaf."""
    top, own = _leaf_place()
    return materialize(of.join(leaves.select("chunk_id", top.alias("top"), own.alias("own")), "chunk_id").select("query_id", "top", "own"), "ways")


def _leaf_place() -> tuple[Column, Column]:
    """(the path of the lowest branch above a leaf, the leaf's id) of (chunk_id, path, members)."""
    label = lambda p: F.concat_ws(".", F.lit(ROOT), p.cast("array<string>"))
    alone = (F.col("members") == 1) & (F.size("path") > 0)
    top = F.slice("path", F.lit(1), F.size("path") - alone.cast("int"))
    return top, F.when(alone, label(F.col("path"))).otherwise(F.concat_ws(".", label(F.col("path")), "chunk_id"))


def way_steps(ways: DataFrame, *keep: str) -> DataFrame:
    """(..keep, parent_id, right_id, level): every link from the root down to the leaf of :func:`gold_ways`."""
    label = lambda p: F.concat_ws(".", F.lit(ROOT), p.cast("array<string>"))
    steps = ways.select(*keep, "top", "own", F.explode(F.sequence(F.lit(1), F.size("top") + 1)).alias("level"))
    right = F.when(F.col("level") > F.size("top"), F.col("own")).otherwise(label(F.slice("top", F.lit(1), F.col("level"))))
    return steps.select(*keep, label(F.slice("top", F.lit(1), F.col("level") - 1)).alias("parent_id"), right.alias("right_id"), "level")


def leaf_children(leaves: DataFrame, *keep: str) -> DataFrame:
    """(parent_id, child_id, label, chunk_id, ..keep) of the leaves of :func:`kmeans_leaves`."""
    top, own = _leaf_place()
    rows = leaves.select(F.concat_ws(".", F.lit(ROOT), top.cast("array<string>")).alias("parent_id"), own.alias("child_id"), "chunk_id", *keep)
    return rows.withColumn("label", child_label())


def branch_children(leaves: DataFrame) -> DataFrame:
    """(parent_id, child_id, label, level) of all branches below the root, of the leaves of :func:`kmeans_leaves`."""
    label = lambda p: F.concat_ws(".", F.lit(ROOT), p.cast("array<string>"))
    up = leaves.select(_leaf_place()[0].alias("top")).distinct().where(F.size("top") > 0).select("top", F.explode(F.sequence(F.lit(1), F.size("top"))).alias("level"))
    up = up.select(label(F.slice("top", F.lit(1), F.col("level") - 1)).alias("parent_id"), label(F.slice("top", F.lit(1), F.col("level"))).alias("child_id"), "level").distinct()
    return up.withColumn("label", child_label())


def reembed(nodes: DataFrame, summaries: DataFrame, embed) -> DataFrame:
    """``nodes`` with every branch's vector taken from its summary (node_id, summary); without a vector of its own text it keeps its mean.

    ``embed`` maps (id, text) to (id, vec), as :func:`leafline.functions.vec.hash_embedding` does.
    """
    vectors = embed(summaries.select("node_id", X.summary_text(F.col("summary")).alias("text")), "node_id", "text")
    branches = nodes.where("NOT is_leaf").join(vectors.select("node_id", F.col("vec").cast("array<double>").alias("told")), "node_id", "left")
    return nodes.where("is_leaf").unionByName(materialize(branches.withColumn("embedding", F.coalesce("told", "embedding")).select(*nodes.columns), "branches"))


def _inner_reach(edges: DataFrame) -> DataFrame:
    """(node_id, ancestor_id) of all nodes with children, themselves included; kept with ``edges``, whose rows do not change."""
    if not hasattr(edges, "_leafline_reach"):
        parents = materialize(edges.select("parent_id").distinct(), "parents")
        links = materialize(edges.join(parents.select(F.col("parent_id").alias("child_id")), "child_id", "left_semi").select(F.col("child_id").alias("ancestor_id"), "parent_id"), "links")
        reach = front = parents.select(F.col("parent_id").alias("node_id"), F.col("parent_id").alias("ancestor_id"))
        while True:
            front = materialize(front.join(links, "ancestor_id").select("node_id", F.col("parent_id").alias("ancestor_id")), "front", n=F.count(F.lit(1)))
            if not seen_value(front, "n"):
                break
            reach = reach.unionByName(front)
        edges._leafline_reach = reach
    return edges._leafline_reach


def closure(edges: DataFrame, nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node_id, ancestor_id, level of the ancestor), every node being its own ancestor as well; with ``of`` (node_id) only of these.

    Only nodes with children are walked level by level; all others take the ancestors of their parents.
    """
    levels = nodes.select(F.col("node_id").alias("ancestor_id"), F.col("level").alias("ancestor_level"))
    inner = _inner_reach(edges).join(levels, "ancestor_id").select(F.col("node_id").alias("parent_id"), "ancestor_id", "ancestor_level")
    ids = nodes.select("node_id", "level")
    ids = ids if of is None else ids.join(of.select("node_id").distinct(), "node_id", "left_semi")
    above = ids.select("node_id").join(edges.select(F.col("child_id").alias("node_id"), "parent_id"), "node_id").join(inner, "parent_id")
    own = ids.select("node_id", F.col("node_id").alias("ancestor_id"), F.col("level").alias("ancestor_level"))
    return own.unionByName(above.select("node_id", "ancestor_id", "ancestor_level"))


def descendant_leaves(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, leaf_id) of every node; a leaf has itself."""
    leaf = nodes.where("is_leaf").select("node_id")
    inner = _inner_reach(edges).select(F.col("node_id").alias("parent_id"), "ancestor_id")
    above = leaf.join(edges.select(F.col("child_id").alias("node_id"), "parent_id"), "node_id").join(inner, "parent_id").join(nodes.select(F.col("node_id").alias("ancestor_id")), "ancestor_id", "left_semi")
    return leaf.select("node_id", F.col("node_id").alias("leaf_id")).unionByName(above.select(F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("leaf_id")))


def shape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: leaves, internal nodes, branches of the root, depth."""
    top = edges.join(edges.select(F.col("child_id").alias("parent_id")).distinct(), "parent_id", "left_anti").agg(F.count(F.lit(1)).alias("root_branches"))
    counts = nodes.agg(F.count_if("is_leaf").alias("leaves"), F.count_if(~F.col("is_leaf")).alias("internal_nodes"), F.max("level").alias("depth"))
    return counts.crossJoin(top).select("leaves", "internal_nodes", "root_branches", "depth")


def sibling_distinctiveness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(distinctiveness): mean of 1 - cosine over all pairs of siblings with a vector of positive length; 0 if none.

    The mean over pairs needs no pairs: within a family of m unit vectors with sum s the cosines of all pairs sum
    to (|s|^2 - m) / 2, and s is an ordinary grouped sum.
    """
    kids = edges.join(nodes.where("embedding IS NOT NULL").select(F.col("node_id").alias("child_id"), F.col("embedding").cast("array<double>").alias("e")), "child_id")
    kids = kids.withColumn("n", norm(F.col("e"))).where("n > 0")
    kids = kids.withColumn("e", F.transform("e", lambda x: x / F.col("n")))
    dim = nodes.agg(F.max(F.size("embedding"))).first()[0] or 0
    sums = vector_sums(kids, "e", max(1, dim), "parent_id").where("n > 1")
    family = sums.select(F.col("n").alias("m"), F.aggregate("total", F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0))).alias("s2"))
    pairs = F.col("m") * (F.col("m") - 1) / 2
    total = family.agg(F.sum(pairs - (F.col("s2") - F.col("m")) / 2).alias("d"), F.sum(pairs).alias("p"))
    return total.select(F.round(F.coalesce(F.col("d") / F.col("p"), F.lit(0.0)), 6).alias("distinctiveness"))


def summarise(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, per_node: int = 20, leaves: DataFrame | None = None, of: DataFrame | None = None) -> DataFrame:
    """(node_id, summary) of every branch, without a model: from its first ``per_node`` leaf texts in chunk order.

    Leaves are cut to the first ones per salt before a branch sees them, so the root never gathers the corpus; they are
    ranked by the lengths of their texts, and only texts that reach into what a summary reads are joined. ``leaves`` are
    those of :func:`kmeans_leaves`, with what :func:`text_lengths` adds: ancestors are then read off their paths. With
    ``of`` (node_id) only these branches are told of.
    """
    if leaves is None:
        texts = text_lengths(chunks.withColumnRenamed("id", "chunk_id")).select("chunk_id", "pos", "n", "bare")
        texts = nodes.where("is_leaf").select(F.col("node_id").alias("leaf_id"), "chunk_id").join(texts, "chunk_id")
        below = descendant_leaves(edges, nodes).where(F.col("node_id") != F.col("leaf_id")).join(texts, "leaf_id")
        first = W.partitionBy("node_id", F.pmod(F.xxhash64("leaf_id"), F.lit(16))).orderBy("pos", "chunk_id")
        below = below.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_node)
        cut = _read(below, per_node, F.col("node_id"))
    else:
        cut = _read_below(leaves, per_node)
    cut = cut.select("node_id", "chunk_id", "pos")
    cut = materialize(cut if of is None else cut.join(of, "node_id", "left_semi"), "read")
    listed = small(cut, TEXT_ROWS).join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id")
    listed = listed.groupBy("node_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "content"))), 1, per_node).alias("t"))
    return listed.select("node_id", X.fallback_summary(F.array_join(F.transform("t", lambda x: x["content"]), " ")).alias("summary"))


def text_lengths(chunks: DataFrame) -> DataFrame:
    """Adds n and bare, the lengths of ``content`` with and without white space around it; 0 without a text."""
    bare = F.length(F.btrim(F.col("content"), F.lit(" \t\r\n\f")))
    return chunks.withColumns({"n": F.coalesce(F.length("content"), F.lit(0)), "bare": F.coalesce(bare, F.lit(0))})


def _read(rows: DataFrame, per_node: int, *node: Column) -> DataFrame:
    """The rows (.., pos, chunk_id, n, bare) whose texts the summary of their node reads: always the first ones of it."""
    by_node = W.partitionBy(*node).orderBy("pos", "chunk_id")
    ahead = by_node.rowsBetween(W.unboundedPreceding, -1)
    read = (F.coalesce(F.sum("n").over(ahead), F.lit(0)) < X.SUMMARY_HEAD) | (F.coalesce(F.sum("bare").over(ahead), F.lit(0)) <= X.SNIPPET)
    return rows.withColumn("_r", F.row_number().over(by_node)).where(F.col("_r") <= per_node).withColumn("_read", read).where("_read").drop("_r", "_read")


def _read_below(leaves: DataFrame, per_node: int) -> DataFrame:
    """(node_id, chunk_id, pos) of the texts that branches read.

    What the summary of a cluster does not read stands behind texts that fill it, so no branch above reads it: rows are
    cut by clusters and by the clusters' parents before all branches above see them.
    """
    label = lambda p: F.concat_ws(".", F.lit(ROOT), p.cast("array<string>"))
    own = materialize(_read(leaves.select("path", "members", "chunk_id", "pos", "n", "bare"), per_node, F.col("path")), "own")
    above = own.where(F.size("path") > 0).withColumn("over", F.slice("path", F.lit(1), F.size("path") - 1))
    above = _read(above, per_node, F.col("over")).select("over", "chunk_id", "pos", "n", "bare", F.explode(F.sequence(F.lit(0), F.size("over"))).alias("at"))
    above = above.select(label(F.slice("over", F.lit(1), F.col("at"))).alias("node_id"), "chunk_id", "pos", "n", "bare")
    own = own.where((F.col("members") > 1) | (F.size("path") == 0)).select(label(F.col("path")).alias("node_id"), "chunk_id", "pos")
    return own.unionByName(_read(above, per_node, F.col("node_id")).select("node_id", "chunk_id", "pos"))


def path_closure(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """:func:`closure` of some leaves (node_id, level) of a tree of :func:`build_tree`, whose branches' ids are their paths."""
    up = leaves.select("node_id").distinct().join(edges.select(F.col("child_id").alias("node_id"), "parent_id"), "node_id")
    part = F.split("parent_id", r"\.")
    up = up.select("node_id", part.alias("p"), F.explode(F.sequence(F.lit(0), F.size(part) - 1)).alias("ancestor_level"))
    up = up.select("node_id", F.array_join(F.slice("p", F.lit(1), F.col("ancestor_level") + 1), ".").alias("ancestor_id"), "ancestor_level")
    own = leaves.select("node_id", F.col("node_id").alias("ancestor_id"), F.col("level").alias("ancestor_level"))
    return own.unionByName(up)


def child_scores(nodes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, parent_id, child_id, child_pos, cosine) of all children of (query_id, parent_id, vec) rows."""
    kids = queries.join(edges, "parent_id").join(nodes.select(F.col("node_id").alias("child_id"), "is_leaf", "chunk_id", "embedding"), "child_id")
    score = F.round(F.coalesce(cosine(F.col("vec"), F.col("embedding")), F.lit(0.0)), 9)
    return kids.select("query_id", "parent_id", "child_id", "child_pos", "is_leaf", "chunk_id", score.alias("cosine"))
