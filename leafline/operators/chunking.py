"""Token-bounded chunks: fixed windows, and greedy packing of paragraphs or sentences. Words are the tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.functions import text as X

MAX_TOKENS, OVERLAP = 512, 50


def _stride(most: int, overlap: int) -> int:
    return most - overlap if overlap < most else most


def windows(tokens: Column, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    """Texts of fixed windows over an array of words; the last may lie inside the one before it."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(_stride(most, overlap)))
    return F.when(F.size(tokens) > 0, F.transform(starts, lambda s: F.array_join(F.slice(tokens, s + 1, most), " "))).otherwise(F.array().cast("array<string>"))


def force_split(df: DataFrame, id_col: str, text_col: str, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, document_id, chunk_no, content, token_count); null and blank texts give no row."""
    cut = df.select(F.col(id_col).cast("string").alias("document_id"), X.words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    rows = cut.select("document_id", F.posexplode(windows(F.col("w"), most, overlap)).alias("chunk_no", "content"))
    return rows.select(
        F.concat_ws("-", "document_id", "chunk_no").alias("chunk_id"), "document_id", "chunk_no", "content", X.word_count(F.col("content")).alias("token_count")
    )


def packed(text: Column, most: int, overlap: int) -> Column:
    """Chunk texts of one text: a fold over its segments that carries (chunks, open segments, open tokens)."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), none.alias("open"), F.lit(0).alias("n"))
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda s, p: s + X.word_count(p))

    def step(acc: Column, seg: Column) -> Column:
        n = X.word_count(seg)
        flushed = F.when(F.size(acc["open"]) > 0, F.concat(acc["out"], F.array(X.join_segments(acc["open"])))).otherwise(acc["out"])
        tail = X.overlap_tail(acc["open"], overlap)
        forced = F.struct(F.concat(flushed, windows(X.words(seg), most, overlap)).alias("out"), none.alias("open"), F.lit(0).alias("n"))
        fresh = F.struct(flushed.alias("out"), F.concat(tail, F.array(seg)).alias("open"), (total(tail) + n).alias("n"))
        more = F.struct(acc["out"].alias("out"), F.concat(acc["open"], F.array(seg)).alias("open"), (acc["n"] + n).alias("n"))
        return F.when(n > most, forced).when(acc["n"] + n > most, fresh).otherwise(more)

    done = lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["out"], F.array(X.join_segments(acc["open"])))).otherwise(acc["out"])
    folded = F.aggregate(X.segments(text), start, step, done)
    return F.when(X.word_count(text) <= most, F.array(text)).otherwise(F.filter(folded, lambda c: c != ""))


def chunk_documents(df: DataFrame, id_col: str = "id", text_col: str = "content", most: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of every document along paragraphs or sentences; null and blank texts give none.

    After an overlap seed the next segment is added without another check, so a chunk may hold up to
    ``most + overlap`` words.
    """
    texts = df.select(F.col(id_col).cast("string").alias("document_id"), X.strip(F.col(text_col)).alias("t")).where("t <> ''")
    rows = texts.select("document_id", F.posexplode(packed(F.col("t"), most, overlap)).alias("chunk_no", "content"))
    return rows.select(
        F.concat_ws("-", "document_id", "chunk_no").alias("chunk_id"), "document_id", "chunk_no", "content", X.word_count(F.col("content")).alias("token_count")
    )
