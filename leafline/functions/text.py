"""Scalar text functions as Column expressions.

Words are runs of characters other than space, tab, carriage return, line and form feed. Null texts give null
arrays or null strings unless a function says otherwise; empty texts give empty arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[ \t\r\n\f]"
#: Business and technology topics an article has to touch.
TOPIC_KEYWORDS = [
    "company", "organization", "management", "software", "technology", "engineering", "devops", "policy", "compliance", "human resources",
    "leadership", "remote work", "open source", "saas", "cloud computing", "security", "governance", "agile", "project management", "startup",
    "enterprise", "data science", "machine learning", "artificial intelligence", "infrastructure", "automation", "continuous integration",
    "continuous delivery", "version control", "software development", "information technology", "cybersecurity", "networking", "database",
    "api", "microservices", "kubernetes", "docker", "linux", "programming", "computer science",
]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def word_lists(texts: pa.Array) -> pa.ListArray:
    """:func:`words` inside a task: the words of each text of a batch; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    # a vertical tab is white space to Arrow, but part of a word
    tabs = pc.any(pc.match_substring(texts, "\v")).as_py()
    parts = pc.split_pattern_regex(texts, WS) if tabs else pc.ascii_split_whitespace(texts)
    word = parts.flatten()
    keep = pc.greater(pc.binary_length(word), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(keep)])[parts.offsets.to_numpy()]
    return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), word.filter(pa.array(keep)))


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("int")


def sentences(text: Column) -> Column:
    """Cut after each of ``. ! ?`` that is not the first character of its stretch; the whole text if nothing is left."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"{WS}*[^ \t\r\n\f][^.!?]*(?:[.!?]|\z)"), F.lit(0)), strip), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def segments(text: Column) -> Column:
    """Paragraphs (blank-line separated) if there are at least two, else sentences."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    return F.when(F.size(paragraphs) > 1, paragraphs).otherwise(sentences(text))


def join_segments(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, strip), lambda s: s != ""), " ")


def overlap_tail(parts: Column, overlap: int) -> Column:
    """The longest run of last segments with at most ``overlap`` words, up to the first that does not fit."""
    start = F.struct(F.array().cast("array<string>").alias("tail"), F.lit(0).alias("n"), F.lit(overlap > 0).alias("open"))

    def step(acc: Column, seg: Column) -> Column:
        n = acc["n"] + word_count(seg)
        fits = acc["open"] & (n <= overlap)
        return F.struct(
            F.when(fits, F.concat(F.array(seg), acc["tail"])).otherwise(acc["tail"]).alias("tail"), F.when(fits, n).otherwise(acc["n"]).alias("n"), fits.alias("open")
        )

    return F.aggregate(F.reverse(parts), start, step, lambda acc: acc["tail"])


def matches_keywords(text: Column, keywords: list[str] | None = None) -> Column:
    """Any keyword occurs as a substring, whatever the case ("api" hits "capital")."""
    lower = F.lower(text)
    hit = F.lit(False)
    for k in TOPIC_KEYWORDS if keywords is None else keywords:
        hit = hit | F.contains(lower, F.lit(k.lower()))
    return hit


#: Headings of the sections at the end of an article that are left out.
CLOSING_SECTIONS = ["References", "External links", "See also", "Notes", "Further reading"]


def clean_article(text: Column) -> Column:
    """At most one blank line in a row; nothing from the first trailing section (references, links, notes) on."""
    fewer = F.regexp_replace(text, "\n{3,}", "\n\n")
    cut = F.regexp_replace(fewer, rf"(?s)\n=={WS}*(?:{'|'.join(CLOSING_SECTIONS)}){WS}*==.*", "")
    return strip(cut)


#: Characters of a text that a snippet shows, and that the words of a summary without a model come from.
SNIPPET, SUMMARY_HEAD = 200, 500


def snippet(text: Column, limit: int = SNIPPET) -> Column:
    """The text if short, else its head up to the last space that is not the first character, else a hard cut."""
    whole = strip(text)
    head = F.substring(whole, 1, limit)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    return F.when(F.length(whole) <= limit, whole).when((F.instr(head, " ") > 0) & (at > 0), F.substring(head, F.lit(1), at)).otherwise(head)


def _listed(label: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, ", ")))


def summary_text(summary: Column) -> Column:
    """One line with every non-empty part of a routing summary."""
    return F.concat_ws(
        ". ", summary["theme"], _listed("Covers", summary["includes"]), _listed("Not", summary["excludes"]), _listed("Entities", summary["key_entities"]),
        _listed("Terms", summary["key_terms"]), F.when(F.length(summary["content_snippet"]) > 0, F.concat(F.lit("Sample: "), summary["content_snippet"])),
    )


def summary_line(summary: Column, with_excludes: bool = False) -> Column:
    """The short rendering that flat search over summaries scores."""
    line = F.concat(F.lit("Theme: "), summary["theme"], F.lit(". Includes: "), F.array_join(F.coalesce(summary["includes"], F.array().cast("array<string>")), ", "), F.lit("."))
    if not with_excludes:
        return line
    return F.concat(line, F.lit(" Excludes: "), F.array_join(F.coalesce(summary["excludes"], F.array().cast("array<string>")), ", "), F.lit("."))


def summary_block(summary: Column, chunk_id: Column) -> Column:
    """A node for display: one line for each part of its summary, null parts empty; of a node without one what it is."""
    theme = F.concat(F.lit("Theme: "), F.coalesce(summary["theme"], F.lit("")))
    lists = [("Includes", "includes"), ("Excludes", "excludes"), ("Entities", "key_entities"), ("Terms", "key_terms")]
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(F.array_join(summary[part], ", "), F.lit(""))) for name, part in lists]
    leaf = F.when(F.length(chunk_id) > 0, F.concat(F.lit("[leaf: "), chunk_id, F.lit("]"))).otherwise(F.lit("[no summary]"))
    return F.when(summary.isNull(), leaf).otherwise(F.concat_ws("\n", theme, *lines))


FALLBACK_THEME = "(no summary: words of the text)"


def fallback_summary(text: Column) -> Column:
    """A summary without a model: the first distinct longer words among the first 500 characters."""
    head = words(F.substring(text, 1, SUMMARY_HEAD))
    empty = F.array().cast("array<string>")
    pick = lambda more, n: F.slice(F.array_distinct(F.filter(head, lambda w: F.length(w) > more)), 1, n)
    return F.struct(
        F.lit(FALLBACK_THEME).alias("theme"), pick(4, 8).alias("includes"), empty.alias("excludes"), empty.alias("key_entities"), pick(3, 10).alias("key_terms"),
        snippet(text).alias("content_snippet"),
    )


SUMMARY_TYPE = T.StructType(
    [
        T.StructField("theme", T.StringType()),
        *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("includes", "excludes", "key_entities", "key_terms")],
        T.StructField("content_snippet", T.StringType()),
    ]
)


def extract_json(reply: Column) -> Column:
    """The JSON part of a noisy reply: a fenced block, else from the first to the last brace, else the reply.

    The fence that ends a block begins a line, so that one inside the JSON's own texts does not."""
    whole = strip(reply)
    fenced = F.regexp_extract(whole, r"(?s)```(?:json)?\s*\n(.*?)\n[ \t]*```", 1)
    braces = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", strip(fenced)).when(braces != "", braces).otherwise(whole)


def parse_summary(reply: Column, text: Column) -> Column:
    """The summary in a model's reply; the fallback summary of ``text`` where it cannot be read or lacks a part."""
    got = F.from_json(extract_json(reply), SUMMARY_TYPE)
    ok = got["theme"].isNotNull() & got["includes"].isNotNull()
    return F.when(ok, got).otherwise(fallback_summary(text))


def prompt_sample(texts: Column, limit: int = 3000) -> Column:
    """Texts of a cluster as one sample, cut at ``limit`` characters with a mark."""
    joined = F.array_join(texts, "\n---\n")
    return F.when(F.length(joined) > limit, F.concat(F.substring(joined, 1, limit), F.lit("\n[truncated]"))).otherwise(joined)


def source_prefix(document_id: Column) -> Column:
    """A document id without its trailing number, or the whole id."""
    return F.regexp_replace(document_id, r"-\d+$", "")


def pair_key(query: Column, chunk_id: Column, text: Column | None = None) -> Column:
    """Key of a cached pair score; with ``text`` a changed chunk gets another key."""
    parts = [F.substring(F.sha2(query, 256), 1, 16), chunk_id]
    return F.concat_ws("_", *parts, *([F.substring(F.sha2(text, 256), 1, 8)] if text is not None else []))


def judge_key(chunk_ids: Column) -> Column:
    """Key of a cached verdict on a set of chunks, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(chunk_ids), ","), 256)
