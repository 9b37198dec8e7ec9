"""p3: draw a sample of each suite whose category and difficulty mix follows target shares.

Per suite a small table of cells (category x difficulty) is raked by iterative proportional fitting: starting
from the target shares of the cells that have rows at all, the fitted counts are scaled to the category and to
the difficulty margins in turn, never beyond the rows there are. A row's weight is its cell's fitted count over
its cell's rows; the rows with the smallest exponential keys ``-ln(u)/weight`` are drawn, ``u`` being a hash of
the id. The draw is then repaired with the next keys of each cell: a cell that has the rows gets its quota (the
larger of its minimum and its share of the sample) as far as the size of the sample allows, and its minimum in any
case. Every cell's remaining gap is reported with its cause: ``supply`` (fewer rows than the quota) or ``size`` (the
quotas of the suite add up to more than its sample).

Nothing sorts a whole cell or suite: rows are counted in buckets of their keys, and only those of the buckets that
can hold the smallest ones are ranked.

Values of category and difficulty are compared in lower case, without outer white space, and with runs of
space, hyphen or underscore as one. Other values and nulls belong to no cell. Of a repeated query id the latest
row counts; rows with a null id or suite are ignored. A suite without targets gives no sample; a target cell
without rows is reported with ``available`` 0; repeated target rows count once (the largest).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafline.session import latest_rows, materialize

ROUNDS = 60
#: Buckets of keys per cell or suite at most: what is counted before anything is ranked.
BUCKETS = 4_096


def canonical(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    trimmed = F.regexp_replace(F.lower(c), r"^[\s\u00a0\u2000-\u200b\u3000]+|[\s\u00a0\u2000-\u200b\u3000]+$", "")
    return F.regexp_replace(trimmed, r"[\s\u00a0\u2000-\u200b\u3000_-]+", "_")


def rake(share: np.ndarray, available: np.ndarray, rows: np.ndarray, cols: np.ndarray, total: float, rounds: int = ROUNDS) -> np.ndarray:
    """Fitted counts: margins of ``share * total`` over ``rows`` and ``cols`` codes, at most ``available`` each."""
    want = share * total
    fit = np.where(available > 0, np.maximum(want, 1e-9), 0.0)
    for _ in range(rounds):
        for code in (rows, cols):
            goal, have = np.bincount(code, want), np.bincount(code, fit)
            fit = np.minimum(fit * np.where(have > 0, goal / np.where(have > 0, have, 1), 1)[code], available)
    if 0 < fit.sum() < min(total, available.sum()):  # margins that cannot be met leave rows over: spread them
        for _ in range(rounds):
            room = np.where(fit < available, fit + 1e-6, 0.0)
            gap = min(total, available.sum()) - fit.sum()
            if gap < 1e-9 or room.sum() == 0:
                break
            fit = np.minimum(fit + gap * room / room.sum(), available)
    return fit


def whole_counts(fit: np.ndarray, drawn: np.ndarray, least: np.ndarray, quota: np.ndarray, available: np.ndarray, total: int) -> np.ndarray:
    """Repair ``drawn``: at least ``quota`` or all rows of the cell, and ``total`` in sum; where the quotas exceed that,
    cells give up rows, those farthest above the fit first, but never fall under ``least``."""
    lo = np.minimum(quota, available).astype(int)
    hi = np.maximum(np.minimum(np.ceil(fit), available), lo).astype(int)
    floor = np.minimum(np.minimum(least, available), lo).astype(int)
    out = np.clip(drawn, lo, hi)
    goal = min(total, int(available.sum()))
    for up, bounds in ((False, (lo, floor)), (True, (hi, available.astype(int)))):
        for bound in bounds:
            while (out.sum() < goal) if up else (out.sum() > goal):
                can = out < bound if up else out > bound
                if not can.any():
                    break
                lack = np.where(can, (fit - out) * (1 if up else -1), -np.inf)
                out[int(np.argmax(lack))] += 1 if up else -1
    return out


def first_ranks(rows: DataFrame, keys: list[str], order: str, bucket: Column, most: Column) -> DataFrame:
    """(.. of ``rows``, _ll_rank): the first ``most`` rows of every group in the order (``order``, id).

    ``bucket`` rises with ``order``. Buckets are counted; a row can be among the first only if fewer than ``most`` rows
    stand in the buckets before its own, and its rank is that number plus its rank inside the bucket.
    """
    rows = rows.withColumn("_ll_bucket", bucket)
    counts = rows.groupBy(*keys, "_ll_bucket").agg(F.count(F.lit(1)).alias("_ll_n"))
    before = F.sum("_ll_n").over(W.partitionBy(*keys).orderBy("_ll_bucket")) - F.col("_ll_n")  # at most BUCKETS rows a group
    near = rows.join(counts.withColumn("_ll_before", before).drop("_ll_n"), [*keys, "_ll_bucket"]).where(F.col("_ll_before") < most)
    inside = F.row_number().over(W.partitionBy(*keys, "_ll_bucket").orderBy(order, "id"))
    return near.withColumn("_ll_rank", F.col("_ll_before") + inside).where(F.col("_ll_rank") <= most).drop("_ll_bucket", "_ll_before")


def suite_cells(queries: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with the rows available in each, eligible rows with their cell)."""
    rows = latest_rows(queries, "id", "created_at", "suite_id", "category", "difficulty").select(
        "id", "suite_id", canonical("category").alias("_ll_cat"), canonical("difficulty").alias("_ll_dif")
    )
    cells = (
        targets.where(F.col("suite_id").isNotNull())
        .groupBy("suite_id", canonical("category").alias("_ll_cat"), canonical("difficulty").alias("_ll_dif"))
        .agg(F.max(F.struct("share", "min_rows", "sample_rows", "category", "difficulty")).alias("_ll_t"))
        .select("suite_id", "_ll_cat", "_ll_dif", "_ll_t.*")
    )
    keys = ["suite_id", "_ll_cat", "_ll_dif"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("available"))
    cells = cells.join(counts, keys, "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    return cells, rows.join(cells.select(*keys), keys, "left_semi")


def sample_by_targets(queries: DataFrame, targets: DataFrame, seed: int = 7, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(sample: suite_id, category, difficulty, id; report: one row per target cell)."""
    keys = ["suite_id", "_ll_cat", "_ll_dif"]
    cells, rows = suite_cells(queries, targets)
    cells = materialize(cells, "cells")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["sample_rows"].fillna(0).max())
        have = pdf["available"].to_numpy(float)
        codes = [pd.factorize(pdf[c].fillna(""))[0] for c in ("_ll_cat", "_ll_dif")]
        fit = rake(pdf["share"].fillna(0).to_numpy(float), have, *codes, float(n), rounds)
        return pdf.assign(fitted=fit)

    shape = "suite_id string, _ll_cat string, _ll_dif string, share double, min_rows int, sample_rows int, category string, difficulty string, available long, fitted double"
    fits = materialize(cells.groupBy("suite_id").applyInPandas(fitted, shape), "fits")
    u = (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = (
        rows.join(fits.select(*keys, "fitted", "available", "sample_rows", "min_rows"), keys)
        .withColumn("_ll_u", u)
        .withColumn("_ll_key", -F.log("_ll_u") * F.col("available") / F.greatest("fitted", F.lit(1e-9)))
    )
    most = F.greatest(F.col("sample_rows"), F.col("min_rows"), F.lit(0))
    # inside a cell the smallest keys are the largest u, which are spread evenly: some multiples of what is wanted a bucket
    fine = F.least(F.lit(BUCKETS), F.ceil(F.col("available") / (2 * most + 64)))
    candidates = first_ranks(keyed, keys, "_ll_key", F.floor((1 - F.col("_ll_u")) * fine), most)
    candidates = materialize(candidates.select(*keys, "id", "_ll_key", "sample_rows", F.col("_ll_rank").alias("_ll_cell_rank")), "candidates")
    widest = candidates.groupBy("suite_id").agg(F.max("_ll_key").alias("_ll_top"))  # one row a suite
    scaled = candidates.join(widest, "suite_id")
    taken = first_ranks(scaled, ["suite_id"], "_ll_key", F.floor(F.col("_ll_key") / F.col("_ll_top") * (BUCKETS - 1)), F.col("sample_rows"))
    ranked = candidates.join(taken.select("suite_id", "id", F.lit(True).alias("_ll_drawn")), ["suite_id", "id"], "left")
    ranked = materialize(ranked.withColumn("_ll_drawn", F.coalesce("_ll_drawn", F.lit(False))), "ranked")
    drawn = ranked.groupBy(*keys).agg(F.count_if("_ll_drawn").alias("drawn"))

    quota = F.greatest(F.coalesce("min_rows", F.lit(0)).cast("long"), F.round(F.coalesce(F.col("share") * F.col("sample_rows"), F.lit(0.0))).cast("long"))

    def repaired(pdf: pd.DataFrame) -> pd.DataFrame:
        have, draw = pdf["available"].to_numpy(int), pdf["drawn"].to_numpy(int)
        least = np.minimum(pdf["min_rows"].fillna(0).to_numpy(int), have)
        n = int(pdf["sample_rows"].fillna(0).max())
        return pdf.assign(sampled=whole_counts(pdf["fitted"].to_numpy(float), draw, least, pdf["quota"].to_numpy(int), have, n))

    plan = fits.join(drawn, keys, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("long"))).withColumn("quota", quota)
    plan = materialize(plan.groupBy("suite_id").applyInPandas(repaired, shape + ", drawn long, quota long, sampled long"), "plan")
    gap = F.col("sampled") - F.col("quota")
    cause = F.when(gap >= 0, None).when(F.col("available") < F.col("quota"), "supply").otherwise("size")
    report = plan.select(
        "suite_id", "category", "difficulty", "share", "min_rows", "sample_rows", "quota", "available", F.round("fitted", 6).alias("fitted"), "drawn", "sampled", gap.alias("gap"), cause.alias("cause"),
    )
    sample = (
        ranked.join(plan.select(*keys, "category", "difficulty", "sampled"), keys)
        .where(F.col("_ll_cell_rank") <= F.col("sampled"))
        .select("suite_id", "category", "difficulty", "id")
    )
    return sample, report
