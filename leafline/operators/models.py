"""Steps that a text model may take over: routing summaries, sufficiency verdicts and query writing.

A model is any picklable callable from a list of prompts to a list of replies; it runs inside tasks, one call per
Arrow batch. None is shipped. Replies that cannot be read are asked again up to ``attempts`` times, then the
offline answer stands: the fallback summary, "not sufficient", or no query.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.functions import text as X

Model = Callable[[list[str]], list[str]]
ATTEMPTS = 3


def _reply(prompts: DataFrame, model: Model, wanted: tuple[str, ...], attempts: int) -> DataFrame:
    """(key, reply) of (key, prompt); null where no attempt gave JSON with the ``wanted`` fields."""

    def readable(reply: str | None) -> bool:
        text = reply or ""
        body = text[text.find("{") : text.rfind("}") + 1]
        try:
            got = json.loads(body)
        except ValueError:
            return False
        return isinstance(got, dict) and all(w in got for w in wanted)

    def run(batches):
        for pdf in batches:
            reply: list[str | None] = [None] * len(pdf)
            left = list(range(len(pdf)))
            for _ in range(attempts):
                if not left:
                    break
                for i, r in zip(left, model([pdf["prompt"].iloc[i] for i in left])):
                    reply[i] = r if readable(r) else None
                left = [i for i in left if reply[i] is None]
            yield pd.DataFrame({"key": pdf["key"], "reply": reply})

    return prompts.select("key", "prompt").mapInPandas(run, "key string, reply string")


def summaries(samples: DataFrame, model: Model, siblings: DataFrame | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """(node_id, summary) for (node_id, texts): one prompt a node, with the summaries of ``siblings`` (node_id, lines) if given."""
    rows = samples.select("node_id", X.prompt_sample(F.col("texts")).alias("sample"), F.array_join("texts", " ").alias("whole"))
    rows = rows.join(siblings.select("node_id", "lines"), "node_id", "left") if siblings is not None else rows.withColumn("lines", F.lit(None).cast("array<string>"))
    near = F.coalesce(F.array_join(F.transform("lines", lambda s: F.concat(F.lit("- "), s)), "\n"), F.lit("(none)"))
    prompt = F.concat(F.lit("Describe what the texts below cover, as JSON with theme, includes, excludes, key_entities, key_terms.\n\nTexts:\n"), F.col("sample"), F.lit("\n\nNeighbours:\n"), near)
    replies = _reply(rows.select(F.col("node_id").alias("key"), prompt.alias("prompt")), model, ("theme", "includes"), attempts)
    return rows.join(replies.withColumnRenamed("key", "node_id"), "node_id").select("node_id", X.parse_summary(F.col("reply"), F.col("whole")).alias("summary"))


def verdicts(contexts: DataFrame, model: Model, attempts: int = 1) -> DataFrame:
    """(query_id, is_sufficient, reasoning) for (query_id, text, texts): do the packed texts answer the query?"""
    prompt = F.concat(F.lit("Do these passages answer the question? Reply as JSON with sufficient (true or false) and reasoning.\n\nQuestion: "), F.col("text"), F.lit("\n\n"), F.array_join("texts", "\n---\n"))
    replies = _reply(contexts.select(F.col("query_id").alias("key"), prompt.alias("prompt")), model, ("sufficient",), attempts)
    got = F.from_json(X.extract_json(F.col("reply")), "sufficient boolean, reasoning string")
    return replies.select(F.col("key").alias("query_id"), F.coalesce(got["sufficient"], F.lit(False)).alias("is_sufficient"), F.coalesce(got["reasoning"], F.lit("no readable verdict")).alias("reasoning"))


def written_queries(chunks: DataFrame, model: Model, prefix: str, attempts: int = ATTEMPTS) -> DataFrame:
    """Queries for (id, category, content), one gold chunk each; chunks without a readable reply give none."""
    rows = chunks.withColumn("key", F.concat_ws("-", F.lit(prefix), "id", "category"))
    prompt = F.concat(F.lit("Write one question of the kind "), F.col("category"), F.lit(" that this text answers, as JSON with text, difficulty and answer.\n\n"), F.col("content"))
    replies = _reply(rows.select("key", prompt.alias("prompt")), model, ("text", "answer"), attempts).where("reply IS NOT NULL")
    got = F.from_json(X.extract_json(F.col("reply")), "text string, difficulty string, answer string")
    return rows.join(replies, "key").select(
        F.col("key").alias("id"), got["text"].alias("text"), "category", F.coalesce(got["difficulty"], F.lit("medium")).alias("difficulty"),
        F.array("id").alias("gold_chunk_ids"), got["answer"].alias("gold_answer"),
    )
