import json

from leafline.functions.text import FALLBACK_THEME
from leafline.operators import models


def reply(prompts):
    out = []
    for p in prompts:
        if "broken" in p:
            out.append("no json here")
        elif "Question:" in p:
            out.append(json.dumps({"sufficient": "yes it is" in p, "reasoning": "r"}))
        elif "question of the kind" in p:
            out.append("```json\n" + json.dumps({"text": "What?", "answer": "That."}) + "\n```")
        else:
            out.append("Sure: " + json.dumps({"theme": "Rails", "includes": ["passes"], "excludes": ["roads"] if "- roads" in p else []}))
    return out


def test_summaries_fall_back(spark):
    df = spark.createDataFrame([("n1", ["rail passes", "rail desk"]), ("n2", ["broken words here"])], "node_id string, texts array<string>")
    sib = spark.createDataFrame([("n1", ["roads: asphalt"])], "node_id string, lines array<string>")
    got = {r["node_id"]: r["summary"] for r in models.summaries(df, reply, sib).collect()}
    assert got["n1"]["theme"] == "Rails" and got["n1"]["excludes"] == ["roads"]
    assert got["n2"]["theme"] == FALLBACK_THEME and got["n2"]["includes"] == ["broken", "words"]


def test_verdicts_and_queries(spark):
    df = spark.createDataFrame([("q1", "a?", ["yes it is"]), ("q2", "b?", ["no"]), ("q3", "broken?", [])], "query_id string, text string, texts array<string>")
    assert {r["query_id"]: r["is_sufficient"] for r in models.verdicts(df, reply).collect()} == {"q1": True, "q2": False, "q3": False}
    chunks = spark.createDataFrame([("c1", "dpi", "text"), ("c2", "ood", "broken")], "id string, category string, content string")
    rows = models.written_queries(chunks, reply, "gen").collect()
    assert [(r["id"], r["gold_chunk_ids"], r["difficulty"]) for r in rows] == [("gen-c1-dpi", ["c1"], "medium")]
