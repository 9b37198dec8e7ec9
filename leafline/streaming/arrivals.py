"""Queries that arrive as a stream: each micro-batch goes through a set-oriented retriever."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from leafline.operators.retrieval import Retriever


def rank_arrivals(arrivals: DataFrame, retriever: Retriever, target: str, checkpoint: str, top_k: int = 10, once: bool = False) -> StreamingQuery:
    """Rank every micro-batch of (query_id, text) and append it to a Parquet table under its batch number.

    A batch that is run again after a failure overwrites its own folder, so each query is answered once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        retriever.rank(rows.select("query_id", "text"), top_k).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
