"""Queries and the children of the nodes they stand at, met inside tasks: a pair of a query and a child is never a row of a table.

A task holds the queries and the children of many nodes at a time. Queries at one node beyond ``NODE_QUERIES`` are cut
into blocks, each with the node's children.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.functions import text as X
from leafline.operators.tree import TEXT_ROWS, matrix
from leafline.session import materialize, seen_value, small

#: Queries of one node that a task holds, and queries of all nodes that it holds at a time.
NODE_QUERIES, TASK_QUERIES = 2_048, 8_192
#: Pairs that are scored at a time.
PAIRS = 1 << 19


def crowds(frontier: DataFrame) -> DataFrame:
    """(parent_id, blocks): the nodes that queries stand at and into how many blocks their queries are cut."""
    n = frontier.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    return materialize(n.select("parent_id", F.ceil(F.col("n") / NODE_QUERIES).cast("long").alias("blocks"), "n"), "crowds", rows=F.sum("n"))


def visited(kids: DataFrame, crowd: DataFrame) -> DataFrame:
    """Of (parent_id, ..) the children of nodes that queries stand at, with blocks."""
    return kids.join(small(crowd.select("parent_id", "blocks"), TEXT_ROWS), "parent_id")


def meet(frontier: DataFrame, kids: DataFrame, crowd: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the rows of (query_id, parent_id, ..) and of :func:`visited` children, as tables with all children of each parent."""
    groups = max(1, -(-(seen_value(crowd, "rows") or 0) // TASK_QUERIES))
    hot = small(crowd.where("blocks > 1").select("parent_id", "blocks"))
    left = frontier.join(hot, "parent_id", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("query_id"), F.col("blocks")), F.lit(0)))
    right = kids.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = F.pmod(F.xxhash64("parent_id", "block"), F.lit(groups)).alias("group")
    # a task's rows of several blocks of one parent must not meet: the block is part of the parent's name
    name = F.when(F.col("blocks") > 1, F.concat_ws("|", F.col("block").cast("string"), "parent_id")).otherwise(F.col("parent_id")).alias("family")
    left = left.select(group, name, *frontier.columns).groupBy("group")
    return left.cogroup(right.select(group, name, *[c for c in kids.columns if c not in ("parent_id", "blocks")]).groupBy("group")).applyInArrow(run, schema)


def column(table: pa.Table, name: str) -> pa.Array:
    some = table.column(name).combine_chunks()
    return pa.concat_arrays(some.chunks) if isinstance(some, pa.ChunkedArray) else some


class Families:
    """The children of a task in the order of their families, and for each query where its family starts and how large it is."""

    def __init__(self, left: pa.Table, right: pa.Table, *order: str):
        right = right.take(pc.sort_indices(right, sort_keys=[(c, "ascending") for c in ("family", *order)]))
        family = column(right, "family")
        kinds = family.unique()
        code = pc.index_in(family, kinds).to_numpy(zero_copy_only=False)
        self.own = pc.fill_null(pc.index_in(column(left, "family"), kinds), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        left, self.own = left.take(pa.array(np.flatnonzero(self.own >= 0))), self.own[self.own >= 0]
        size = np.bincount(code, minlength=len(kinds))
        first = np.cumsum(size) - size
        self.left, self.right, self.code = left, right, code.astype(np.int64)
        self.first, self.size = first[self.own], size[self.own]

    def pieces(self):
        """(first, last + 1) of queries with about ``PAIRS`` pairs in all."""
        lo, ends = 0, np.cumsum(self.size)
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
            yield lo, hi
            lo = hi

    def pairs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, child) of all pairs of some queries, by query and in the order of the children."""
        size = self.size[lo:hi]
        q = np.repeat(np.arange(lo, hi), size)
        return q, self.first[q] + np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)


class Cosines:
    """Cosines of pairs, rounded to nine places; 0 where a side has length zero."""

    def __init__(self, f: Families):
        self.x, self.y = (matrix(column(t, c)) for t, c in ((f.left, "vec"), (f.right, "embedding")))
        self.nx, self.ny = (np.sqrt((v * v).sum(1)) for v in (self.x, self.y))
        if len(self.x) and self.x.shape[1] != self.y.shape[1]:
            raise ValueError(f"vectors of {self.y.shape[1]} and {self.x.shape[1]} numbers")

    def of(self, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        length = self.nx[q] * self.ny[k]
        return np.round(np.einsum("ij,ij->i", self.x[q], self.y[k]) / np.where(length > 0, length, 1.0), 9) + 0.0


class Hits:
    """Scores of :class:`leafline.operators.retrieval.LexicalScorer` for all pairs of some queries: (mass, terms, weights) against content in lower case."""

    def __init__(self, f: Families):
        self.f = f
        terms = column(f.left, "terms")
        kinds = terms.flatten().unique()
        lists = X.word_lists(column(f.right, "content"))
        coded = lists.flatten().dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, kinds), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        word = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int64)
        kid = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[word >= 0]
        self.kinds = len(kinds) + 1
        pair = np.unique(kid * self.kinds + word[word >= 0])  # a word of a text once
        kid, word = pair // self.kinds, pair % self.kinds
        key = f.code[kid] * self.kinds + word
        order = np.argsort(key, kind="stable")
        self.key, self.kid = key[order], kid[order]
        self.term = pc.index_in(terms.flatten(), kinds).to_numpy(zero_copy_only=False).astype(np.int64)
        self.weight = column(f.left, "weights").flatten().to_numpy(zero_copy_only=False)
        n = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
        self.at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        self.mass = pc.fill_null(column(f.left, "mass"), 0.0).to_numpy(zero_copy_only=False)

    def of(self, lo: int, hi: int) -> np.ndarray:
        f, some = self.f, slice(self.at[lo], self.at[hi])
        of = np.repeat(np.arange(lo, hi), np.diff(self.at[lo : hi + 1]))
        key = f.own[of] * self.kinds + self.term[some]
        first, n = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = n - first
        entry = np.repeat(np.arange(len(key)), n)
        kid = self.kid[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(entry))]
        size = f.size[lo:hi]
        start = np.cumsum(size) - size
        pair = start[of[entry] - lo] + kid - f.first[of[entry]]
        hit = np.bincount(pair, self.weight[some][entry], int(size.sum()))
        mass = np.repeat(self.mass[lo:hi], size)
        return np.where(mass > 0, np.floor(hit / np.where(mass > 0, mass, 1.0) * 1e6 + 0.5) / 1e6, 0.0)


def placed(score: str):
    """Inside a task, of queries (.., level, right_id) whose right child is one of the family: its score and place, and the scores of the others."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        f = Families(left, right, "label", "child_id")
        scorer = Cosines(f) if score == "cosine" else Hits(f)
        wanted = pc.index_in(column(f.left, "right_id"), column(f.right, "child_id")).to_numpy(zero_copy_only=False)
        kid = column(f.right, "child_id")
        name = pc.index_in(kid, kid.unique()).to_numpy(zero_copy_only=False)  # a child stands once in each block of its family
        right_name = name[wanted.astype(np.int64)] if len(wanted) else name[:0]
        own, place, other, ends = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(1, np.int64)]
        for lo, hi in f.pieces():
            q, k = f.pairs(lo, hi)
            s = scorer.of(q, k) if score == "cosine" else scorer.of(lo, hi)
            is_right = name[k] == right_name[q]
            at = np.flatnonzero(is_right)
            s_right, k_right = s[at][q - lo], k[at][q - lo]
            before = (s > s_right) | ((s == s_right) & (k < k_right))
            own.append(s[at])
            place.append(1 + np.bincount(q[before] - lo, minlength=hi - lo))
            other.append(s[~is_right])
            ends.append(ends[-1][-1] + np.cumsum(f.size[lo:hi] - 1))
        others = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(other)))
        return pa.table({
            "query_id": column(f.left, "query_id"), "level": column(f.left, "level"), "node_id": column(f.left, "right_id"), score: pa.array(np.concatenate(own)),
            "place": pa.array(np.concatenate(place), pa.int32()), "siblings": pa.array(f.size, pa.int64()), "others": others,
        })

    return run


def best_children(pre_k: int, final_k: int, paired: bool):
    """Inside a task, :func:`leafline.operators.routing.cascade`: the best ``final_k`` children of each query's node."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        f = Families(left, right, "label", "child_id")
        cosines, hits = Cosines(f), Hits(f) if paired else None
        leaf = column(f.right, "is_leaf").to_numpy(zero_copy_only=False).astype(bool)
        rows, kids, scores, ranks = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.float64, np.int32))
        for lo, hi in f.pieces():
            q, k = f.pairs(lo, hi)
            c = cosines.of(q, k)
            start = np.cumsum(f.size[lo:hi]) - f.size[lo:hi]
            order = np.lexsort((k, -c, q))
            order = order[np.arange(len(order)) - start[q - lo] < pre_k]
            q, k, s = q[order], k[order], c[order]
            if paired:
                all_leaves = np.bincount(q - lo, ~leaf[k], hi - lo) == 0
                s = np.where(all_leaves[q - lo], hits.of(lo, hi)[order], s)
                again = np.lexsort((np.arange(len(q)), -s, q))
                q, k, s = q[again], k[again], s[again]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            keep = rank < final_k
            for held, some in ((rows, q), (kids, k), (scores, s), (ranks, rank + 1)):
                held.append(some[keep])
        at, kid = pa.array(np.concatenate(rows)), pa.array(np.concatenate(kids))
        return pa.table(
            {c: column(f.left, c).take(at) for c in ("query_id", "parent_id", "above", "parent_score")}
            | {c: column(f.right, c).take(kid) for c in ("child_id", "is_leaf", "chunk_id")}
            | {"score": pa.array(np.concatenate(scores)), "child_rank": pa.array(np.concatenate(ranks), pa.int32())}
        )

    return run
