"""Vector functions. Arrays of floats are cast to double before any arithmetic."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.functions.text import word_lists, words

BUCKETS = 64


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column, floor: float = 1e-10) -> Column:
    n = F.greatest(norm(v), F.lit(floor))
    return F.transform(as_double(v), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """Null where either side has length zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def path_ema(current: Column, parent: Column, alpha: float = 0.5) -> Column:
    return F.lit(alpha) * current + F.lit(1 - alpha) * parent


def hash_buckets(df: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(id, bucket, value): signed feature hashing of lower-cased words, not normalised; zero sums are left out."""
    word = df.select(F.col(id_col), F.explode(words(F.lower(F.col(text_col)))).alias("w"))
    code = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long")
    sign = F.when(F.pmod(F.floor(code / buckets), F.lit(2)) == 0, F.lit(1)).otherwise(F.lit(-1))
    sums = word.groupBy(id_col, F.pmod(code, F.lit(buckets)).cast("int").alias("bucket")).agg(F.sum(sign).cast("double").alias("value"))
    return sums.where("value <> 0")


def hash_embedding(df: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ..keep, vec): unit-length hashed bag of words, the sums of :func:`hash_buckets` scaled to length one.

    A row's vector depends on its own text, so nothing is shuffled: a task hashes its distinct words once. Texts
    without any word, or whose sums cancel, get no row; repeated ids give repeated rows.
    """
    src = df.select(id_col, *keep, lowered(text_col).alias("_text"))
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in [id_col, *keep])
    return src.mapInArrow(lambda batches: hashed(batches, buckets), f"{kinds}, vec array<double>")


def lowered(text_col: str) -> Column:
    """The texts that :func:`hashed` takes."""
    return F.lower(F.coalesce(F.col(text_col), F.lit("")))


def hashed(batches, buckets: int = BUCKETS):
    """:func:`hash_embedding` inside a task: batches that end with lower-cased texts as batches that end with vec."""
    known: dict[str, int] = {}
    for whole in batches:
        at, names = whole.num_columns - 1, whole.schema.names[:-1]
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            column = word_lists(batch.column(at))
            coded = column.flatten().dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(known) > 200_000:
                known.clear()
            known.update({w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in distinct if w not in known})
            code = np.array([known[w] for w in distinct], np.int64)
            word = coded.indices.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            total = np.zeros((batch.num_rows, buckets))
            if len(code):
                key = row * buckets + (code % buckets)[word]
                total = np.bincount(key, np.where(code // buckets % 2 == 0, 1.0, -1.0)[word], total.size).reshape(total.shape)
            n = np.sqrt((total * total).sum(1))
            good = np.flatnonzero(n > 0)
            vec = (total[good] / n[good, None]).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1, dtype=np.int32) * buckets), pa.array(vec))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(good)) for i in range(at)), lists], [*names, "vec"])
