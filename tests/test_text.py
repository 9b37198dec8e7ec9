import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafline.functions import text as X
from leafline.operators import chunking


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,parts",
    [
        ("One. Two! Three", ["One.", "Two!", "Three"]),
        ("3.14", ["3.", "14"]),
        ("...", ["..", "."]),
        ("no end", ["no end"]),
        (".", ["."]),
        ("", [""]),
        ("   ", ["   "]),
        (None, [None]),
    ],
)
def test_sentences(spark, text, parts):
    assert one(spark, X.sentences, text) == parts


def test_segments_prefer_paragraphs(spark):
    assert one(spark, X.segments, "A b.\n\n c d. e\n\n \n\n") == ["A b.", "c d. e"]
    assert one(spark, X.segments, "A b. c") == ["A b.", "c"]


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), (" \t\n ", 0), ("a", 1), (" a  b\tc\r\nd ", 4)])
def test_word_count(spark, text, n):
    assert one(spark, X.word_count, text) == n


@pytest.mark.parametrize(
    "text,short", [("abc", "abc"), ("x" * 250, "x" * 200), ("word " * 60, ("word " * 40).rstrip()), (" " + "y" * 300, "y" * 200), ("a" * 150 + " " + "b" * 150, "a" * 150), (None, None)]
)
def test_snippet(spark, text, short):
    assert one(spark, X.snippet, text) == short


def test_article_and_keywords(spark):
    assert one(spark, X.clean_article, "a\n\n\n\nb\n== References ==\nx\n== See also ==\ny") == "a\n\nb"
    assert one(spark, X.matches_keywords, "the CAPITAL city") is True
    assert one(spark, X.matches_keywords, "plain moth") is False


def test_summary_renderings(spark):
    row = spark.createDataFrame([(("T", ["a", "b"], [], None, ["k"], ""),)], "s struct<theme:string,includes:array<string>,excludes:array<string>,key_entities:array<string>,key_terms:array<string>,content_snippet:string>")
    got = row.select(X.summary_text(F.col("s")).alias("a"), X.summary_line(F.col("s")).alias("b"), X.summary_line(F.col("s"), True).alias("c")).first()
    assert got["a"] == "T. Covers: a, b. Terms: k"
    assert got["b"] == "Theme: T. Includes: a, b."
    assert got["c"] == "Theme: T. Includes: a, b. Excludes: ."


@pytest.mark.parametrize(
    "reply,theme",
    [
        ('Sure:\n```json\n{"theme": "x", "includes": ["a"]}\n```', "x"),
        ('I think {"theme": "y", "includes": []} fits', "y"),
        ("no json at all", X.FALLBACK_THEME),
        ('{"includes": ["a"]}', X.FALLBACK_THEME),
        (None, X.FALLBACK_THEME),
    ],
)
def test_parse_summary(spark, reply, theme):
    got = spark.createDataFrame([(reply, "alpha beta gamma")], "r string, t string").select(X.parse_summary(F.col("r"), F.col("t")).alias("s")).first()["s"]
    assert got["theme"] == theme


def test_prompt_sample_and_prefix(spark):
    got = spark.createDataFrame([(["a" * 2000, "b" * 2000],)], "t array<string>").select(X.prompt_sample(F.col("t")).alias("x")).first()["x"]
    assert got.endswith("\n[truncated]") and len(got) == 3012
    assert one(spark, X.source_prefix, "gitlike-book-00012") == "gitlike-book" and one(spark, X.source_prefix, "plain") == "plain"


def brute_chunks(text, most, overlap):
    """Plain restatement of the greedy chunker over whitespace words."""
    strip = lambda s: s.strip(" \t\r\n\f")
    words = lambda s: [w for w in re.split(r"[ \t\r\n\f]+", s) if w]
    text = strip(text)
    if not text:
        return []
    if len(words(text)) <= most:
        return [text]
    parts = [strip(p) for p in text.split("\n\n") if strip(p)]
    if len(parts) < 2:
        parts, buf = [], ""
        for ch in text:
            buf += ch
            if ch in ".!?" and len(strip(buf)) > 1:
                parts.append(strip(buf))
                buf = ""
        if strip(buf):
            parts.append(strip(buf))
    out, open_parts = [], []
    size = lambda ps: sum(len(words(p)) for p in ps)
    for p in parts:
        w = words(p)
        if len(w) > most:
            if open_parts:
                out.append(" ".join(open_parts))
            step = most - overlap if overlap < most else most
            out += [" ".join(w[i : i + most]) for i in range(0, len(w), step)]
            open_parts = []
        elif size(open_parts) + len(w) > most:
            if open_parts:
                out.append(" ".join(open_parts))
            tail = []
            for q in reversed(open_parts):
                if overlap <= 0 or size(tail) + len(words(q)) > overlap:
                    break
                tail.insert(0, q)
            open_parts = [*tail, p]
        else:
            open_parts.append(p)
    if open_parts:
        out.append(" ".join(open_parts))
    return out


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "c.", "d!", "e?", "f\n\n", "\n\ng", "hhh"]), max_size=60), min_size=1, max_size=12))
def test_chunks_equal_brute_force(spark, docs):
    texts = [" ".join(d) for d in docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    got = {}
    for r in chunking.chunk_documents(df, most=10, overlap=3).orderBy("document_id", "chunk_no").collect():
        got.setdefault(int(r["document_id"]), []).append(r["content"])
    assert got == {i: c for i, t in enumerate(texts) if (c := brute_chunks(t, 10, 3))}


def test_chunk_edges(spark):
    df = spark.createDataFrame([("n", None), ("e", ""), ("w", "Word " * 2000), ("s", "This is a short document.")], "id string, content string")
    rows = chunking.chunk_documents(df, most=100, overlap=10).collect()
    assert {r["document_id"] for r in rows} == {"w", "s"}
    assert [r["content"] for r in rows if r["document_id"] == "s"] == ["This is a short document."]
    assert all(r["token_count"] <= 100 for r in rows) and len({r["chunk_id"] for r in rows}) == len(rows)
    forced = chunking.force_split(spark.createDataFrame([("x", "w " * 100)], "id string, content string"), "id", "content", 100, 10).collect()
    assert [r["token_count"] for r in sorted(forced, key=lambda r: r["chunk_no"])] == [100, 10]


def test_fences_inside_the_json_do_not_end_it(spark):
    reply = 'Here:\n```json\n{"theme": "```", "includes": ["a ``` b"]}\n```\nDone. ```'
    inline = 'So: ```{"theme": "t", "includes": []}``` there'
    df = spark.createDataFrame([(1, reply), (2, inline), (3, None)], "k int, reply string")
    got = {r["k"]: r["s"] for r in df.select("k", X.parse_summary(F.col("reply"), F.lit("whole text here")).alias("s")).collect()}
    assert (got[1]["theme"], got[1]["includes"]) == ("```", ["a ``` b"])
    assert (got[2]["theme"], got[2]["includes"]) == ("t", [])
    assert got[3]["theme"] == X.FALLBACK_THEME


def test_summary_blocks(spark):
    schema = "k int, chunk_id string, summary struct<theme:string,includes:array<string>,excludes:array<string>,key_entities:array<string>,key_terms:array<string>,content_snippet:string>"
    rows = [(1, "c", ("t", ["a", None, "b"], [], None, ["x"], "s")), (2, "c", (None, None, None, None, None, None)), (3, "c", None), (4, None, None), (5, "", None)]
    got = {r["k"]: r["b"] for r in spark.createDataFrame(rows, schema).select("k", X.summary_block(F.col("summary"), F.col("chunk_id")).alias("b")).collect()}
    assert got[1] == "Theme: t\nIncludes: a, b\nExcludes: \nEntities: \nTerms: x"
    assert got[2] == "Theme: \nIncludes: \nExcludes: \nEntities: \nTerms: "
    assert (got[3], got[4], got[5]) == ("[leaf: c]", "[no summary]", "[no summary]")


def test_words_inside_tasks_equal_those_of_columns(spark):
    import pyarrow as pa

    texts = ["  a b\tc\n\nd ", "", None, "x\fy\rz", "q", "é ü w v", " "]
    for some in (texts, [*texts, "m\vn o"]):
        want = [r["w"] or [] for r in spark.createDataFrame([(i, t) for i, t in enumerate(some)], "i int, t string").coalesce(1).orderBy("i").select(X.words(F.col("t")).alias("w")).collect()]
        assert X.word_lists(pa.array(some)).to_pylist() == want
        assert X.word_lists(pa.array(some).slice(3)).to_pylist() == want[3:]
