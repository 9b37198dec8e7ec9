"""p7: fill containers of fixed capacity with whole documents, by bulk-synchronous best fit.

Sizes are token counts. A document beyond the capacity gives full pieces, each a container of its own, and a
last piece that is an item like any other. Items over half the capacity open a container each, and so many
empty containers are opened as the other items need at least. Then, round by round:

1. Items and gaps are range-sorted by size, largest first, gaps before items of the same size.
2. A sweep of each range, in its own task, gives every item its successor among the free gaps: the smallest one
   that holds it. Of several claims the rank in the sort decides. A gap that took an item stays, smaller.
3. What a range could not match (items at its head, gaps at its tail) is matched across ranges: the driver
   sees a few counts a range and hands out rank intervals, last gaps first.
4. Gaps shrink by what they took, and the next round begins. When nothing fits any more, containers are opened
   for what is left.

Null, empty and zero-size items get no place; items with a null id are ignored; repeated ids are separate items.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.session import materialize

CAPACITY, RANGE_ROWS = 2_048, 32_768


def cut_items(sizes: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """((item, size, doc, piece) that need a place, full pieces) of (doc, size)."""
    rows = sizes.where((F.col("size") > 0) & F.col("doc").isNotNull()).withColumn("full", F.floor(F.col("size") / capacity).cast("int"))
    rest = (F.col("size") - F.col("full") * capacity).cast("int")
    full = rows.where("full > 0").select("doc", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), F.lit(capacity).alias("size"))
    items = rows.withColumn("rest", rest).where("rest > 0").select("doc", F.col("full").alias("piece"), F.col("rest").alias("size"))
    return items, full


ROUND = "range int, gap long, item long, size int, room int, rank long"


def sweep(rows: DataFrame, parts: int, capacity: int) -> DataFrame:
    """One round inside the ranges, over (size, is_item, id), a gap's ``size`` being its room.

    Rows of the result: pairs (gap, item, size, room before); items without a gap, with their rank; gaps with the
    room that is left, with a rank if that still holds any item of the ranges that follow.
    """

    def local(batches):
        import pyspark

        task = pyspark.TaskContext.get().partitionId()
        free: list[list[int]] = [[] for _ in range(capacity + 1)]
        mask, least = 0, capacity
        out: list[tuple] = []
        lone = 0
        for batch in batches:
            for size, is_item, key in zip(*(batch.column(c).to_pylist() for c in range(3))):
                least = size
                if not is_item:
                    free[size].append(key)
                    mask |= 1 << size
                    continue
                above = mask >> size
                if not above:
                    out.append((None, key, size, None, lone))
                    lone += 1
                    continue
                room = size + (above & -above).bit_length() - 1
                gap = free[room].pop()
                if not free[room]:
                    mask &= ~(1 << room)
                out.append((gap, key, size, room, None))
                if room > size:
                    free[room - size].append(gap)
                    mask |= 1 << (room - size)
        rank = 0
        for room in range(capacity, 0, -1):
            for gap in free[room]:
                out.append((gap, None, None, room, rank if room >= least else None))
                rank += 1
        if out:
            gap, item, size, room, rank_col = zip(*out)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            cols = [[task] * len(out), gap, item, size, room, rank_col]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["range", "gap", "item", "size", "room", "rank"])

    order = [F.desc("size"), F.asc("is_item"), F.asc("id")]
    ranged = rows.select("size", "is_item", "id").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(local, ROUND)


def across(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(gap range, first gap rank, item range, first item rank, length): the last free gaps before each range go first.

    ``counts`` has (range, lone items, lone gaps). Gap ranks of a stretch fall as its item ranks rise.
    """
    stack: list[list[int]] = []
    out = []
    for part, items, gaps in sorted(counts):
        taken = 0
        while taken < items and stack:
            top = stack[-1]
            n = min(items - taken, top[1])
            out.append((top[0], top[1] - 1, part, taken, n))
            top[1] -= n
            taken += n
            if top[1] == 0:
                stack.pop()
        if gaps:
            stack.append([part, gaps])
    return out


def span_pairs(swept: DataFrame, counts: list) -> DataFrame | None:
    """(gap, item, size, room): what the ranges of a swept table could not match inside, matched across ranges."""
    spans = across([(r["range"], r["items"], r["gaps"]) for r in counts])
    if not spans:
        return None
    names = "gr int, g0 long, ir int, i0 long, n long, span int"
    table = F.broadcast(swept.sparkSession.createDataFrame([(*s, k) for k, s in enumerate(spans)], names))  # at most two stretches a range
    free = swept.where("item IS NULL AND rank IS NOT NULL").join(table, (F.col("range") == F.col("gr")) & F.col("rank").between(F.col("g0") - F.col("n") + 1, F.col("g0")))
    want = swept.where("gap IS NULL").join(table, (F.col("range") == F.col("ir")) & F.col("rank").between(F.col("i0"), F.col("i0") + F.col("n") - 1))
    free = free.select("gap", "room", "span", (F.col("g0") - F.col("rank")).alias("k"))
    want = want.select("item", "size", "span", (F.col("rank") - F.col("i0")).alias("k"))
    return materialize(free.join(want, ["span", "k"]).select("gap", "item", "size", "room"), "spans")


def state_after(swept: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(size, is_item, id): items still without a place and gaps with room, after a round."""
    items = swept.where("gap IS NULL").select("size", F.lit(True).alias("is_item"), F.col("item").alias("id"))
    gaps = swept.where("item IS NULL").select(F.col("room").alias("size"), F.lit(False).alias("is_item"), F.col("gap").alias("id"))
    if pairs is None:
        return items.unionByName(gaps)
    items = items.join(pairs.select(F.col("item").alias("id")), "id", "left_anti")
    gaps = gaps.join(pairs.select(F.col("gap").alias("id"), F.col("size").alias("took")), "id", "left")
    gaps = gaps.select((F.col("size") - F.coalesce("took", F.lit(0))).alias("size"), "is_item", "id").where("size > 0")
    return items.select("size", "is_item", "id").unionByName(gaps)


def pack_items(sizes: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS, max_parts: int | None = None) -> DataFrame:
    """(doc, piece, container, start, size) for (doc, size): ``start`` is the place, the first token of the piece in its container."""
    spark = sizes.sparkSession
    sizes = materialize(sizes.select("doc", "size"), "sizes")
    items, full = cut_items(sizes, capacity)
    inner = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")  # written, so that numbers stay
    state = inner.select("size", F.lit(True).alias("is_item"), F.col("item").alias("id"))
    left = state.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.count_if(F.col("size") > capacity // 2).alias("big")).first()
    n_items, tokens, n_gaps, opened = left["n"], left["s"] or 0, 0, 0
    need = max(left["big"], math.ceil(tokens / capacity))
    placed: list[DataFrame] = []
    while n_items:
        if need:
            fresh = spark.range(opened, opened + need).select(F.lit(capacity).alias("size"), F.lit(False).alias("is_item"), "id")
            state, opened, n_gaps = state.unionByName(fresh), opened + need, n_gaps + need
        parts = max(1, math.ceil((n_items + n_gaps) / range_rows)) if max_parts is None else max_parts
        swept = materialize(sweep(state, parts, capacity), "swept")
        both = F.col("gap").isNotNull() & F.col("item").isNotNull()
        counts = (
            swept.groupBy("range")
            .agg(
                F.count_if(both).alias("pairs"), F.count_if(F.col("gap").isNull()).alias("items"), F.count_if(F.col("item").isNull() & F.col("rank").isNotNull()).alias("gaps"),
                F.count_if(F.col("item").isNull()).alias("open"), F.sum(F.when(F.col("gap").isNull(), F.col("size"))).alias("tokens"),
            )
            .collect()
        )
        pairs = span_pairs(swept, counts)
        crossed = sum(n for *_, n in across([(r["range"], r["items"], r["gaps"]) for r in counts]))
        placed.append(swept.where(both).select("item", "gap", "room"))
        if pairs is not None:
            placed.append(pairs.select("item", "gap", "room"))
        state = state_after(swept, pairs)
        n_items, n_gaps = sum(r["items"] for r in counts) - crossed, sum(r["open"] for r in counts)
        need = 0
        if n_items and not crossed and not any(r["pairs"] for r in counts):  # nothing fits any more
            need = math.ceil(sum(r["tokens"] or 0 for r in counts) / capacity)
    kind = sizes.schema["doc"].dataType.simpleString()
    if not placed:
        at = spark.createDataFrame([], f"doc {kind}, piece int, container string, start int, size int")
    else:
        at = inner.join(reduce(DataFrame.unionByName, placed), "item").select(
            "doc", "piece", F.concat(F.lit("c"), F.col("gap").cast("string")).alias("container"),
            (F.lit(capacity) - F.col("room")).cast("int").alias("start"), "size",
        )
    alone = full.select(
        "doc", "piece", F.concat(F.lit("f"), F.col("doc").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"),
        F.lit(0).alias("start"), "size",
    )
    return at.unionByName(alone)
