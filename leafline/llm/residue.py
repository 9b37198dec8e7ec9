"""p5: values that are template residue, filler, error-page text or a notice that scripts must be on.

Values are cut into word tokens, which are reduced to stems; every unfilled placeholder (``{{name}}``, ``<your name
here>``, ``[name]`` ...) becomes one slot token, every number one number token, every HTTP error code one status token.
Labelled exemplars are held in an inverted index of fixed size, by families and languages. A value is looked at in
passages: the whole value (or windows of ``WINDOW`` tokens of a longer one), and the words around each slot. Only
passages that hold all tokens of a core exemplar are looked at further. The TF-IDF containment of a passage in a family
is the share of the passage's weight that words of the family cover; weights are inverse frequencies over all distinct
values, and proper names (words that are capitalised inside mixed-case values) weigh little.

* A passage is residue if it holds a core exemplar of a family, and none of real content, and the family covers at least ``COVER`` of it, after ``AGAINST``
  times the weight of words in it that texts about such things have. A value is residue if at least half of its
  passages are.
* A value with a slot is residue unless the words around the slot are mostly those of texts about placeholders.

Nodes without a summary, and null, empty or wordless values are no case. Of a repeated id the latest row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm import exemplars as E
from leafline.llm.exemplars import LETTER, NUMBER, SLOT, STATUS
from leafline.session import latest_rows, materialize

WINDOW, STEP, AROUND = 24, 12, 3
COVER, AGAINST, NAME_WEIGHT, NAME_SHARE = 0.6, 3.0, 0.1, 0.9
_ACCENTS = "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"

_NAME = r"[\p{L}_][\p{L}\p{N}_.]*(?:\[\d*\])?[\p{L}\p{N}_]*"
_SLOT_NAME = rf"(?=\s*[^\s]*[\p{{L}}_][\p{{L}}\p{{N}}_.])\s*{_NAME}\s*"
#: The marks by which templates write a place to fill in, the most specific first.
PLACEHOLDERS = [
    rf"\\?\{{\\?\{{\\?\{{?[#/^&>!]?\s*(?:if|each|unless|with)?{_SLOT_NAME}\\?\}}\\?\}}\\?\}}?",
    rf"\{{%-?\s*\w+{_SLOT_NAME}-?%\}}",
    rf"<%[=-]?{_SLOT_NAME}-?%>",
    rf"[$#%]\{{{_SLOT_NAME}(?::[^}}]*)?\}}",
    rf"%\({_NAME}\)[sdf]",
    rf"@@{_NAME}@@",
    rf"\$\${_NAME}\$\$",
    rf"(?<![\p{{L}}\p{{N}}])__{_NAME}__",
    rf"%%{_NAME}%%",
    rf"\[\[{_SLOT_NAME}\]\]",
    rf"<<{_SLOT_NAME}>>",
    rf"\[(?:insert|enter|add|your|hier|ici)?{_SLOT_NAME}(?:here|einfügen|eintragen|ici|aquí|à compléter)?\s*\]",
    rf"\((?:enter|insert|add|your|votre|ihr|su){_SLOT_NAME}(?:here)?\)",
    rf"<(?:your|insert|enter|votre|ihr|su)?{_SLOT_NAME}(?:here|à compléter|einfügen|aquí)?\s*>",
    rf"\{{{_SLOT_NAME}(?::\s*\w+)?\}}",
]


def plain(value: Column) -> Column:
    """White space, escapes and full-width marks as plain ones; marks that wrappers add are taken off."""
    v = F.regexp_replace(value, r"[\s\u00a0\u1680\u2000-\u200d\u202f\u205f\u3000\ufeff]+", " ")
    for was, new in (("&[lL][tT];", "<"), ("&[gG][tT];", ">"), ("｛", "{"), ("｝", "}"), ("［", "["), ("］", "]"), ("＜", "<"), ("＞", ">"), ("[’‘]", "'")):
        v = F.regexp_replace(v, was, new)
    v = F.regexp_replace(v, r"(?i)\s*[(\[](?:auto|retry\s*\d*)[)\]]\s*", " ")
    return F.trim(v)


def stems(word: Column) -> Column:
    return F.substring(F.translate(F.regexp_replace(F.regexp_replace(word, "ß", "ss"), r"\p{M}+", ""), *_ACCENTS), 1, E.STEM)


def tokens(plain_value: Column) -> Column:
    """Stems of the lower-case words, with slots, numbers, error codes and single letters as one token each."""
    v = F.lower(plain_value)
    for mark in PLACEHOLDERS:
        v = F.regexp_replace(v, mark, f" {SLOT} ")
    v = F.regexp_replace(v, r"(?<![\p{L}\p{N}])(?=[a-f]*\d)[\da-f]{6,}(?![\p{L}\p{N}])", " 0 ")
    v = F.regexp_replace(v, r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " ")
    words = F.regexp_extract_all(v, F.lit(r"[\p{L}\p{M}]+(?:'[\p{L}]+)?|\p{N}+"), F.lit(0))
    return F.transform(
        words,
        lambda w: F.when(w == SLOT, w)
        .when(w.isin(E.STATUS_CODES), F.lit(STATUS))
        .when(w.rlike(r"^\p{N}+$"), F.lit(NUMBER))
        .when((F.length(w) == 1) & ~w.isin("a", "à"), F.lit(LETTER))
        .otherwise(stems(w)),
    )


def node_values(nodes: DataFrame) -> DataFrame:
    """(node_id, value): theme, includes and key terms of the latest row of each node, without nulls."""
    rows = latest_rows(nodes.select("node_id", "built_at", "summary.theme", "summary.includes", "summary.key_terms"), "node_id", "built_at")
    lists = F.concat(F.array("theme"), F.coalesce("includes", F.array().cast("array<string>")), F.coalesce("key_terms", F.array().cast("array<string>")))
    return rows.select("node_id", F.explode(lists).alias("value")).where(F.col("value").isNotNull())


def token_weights(values: DataFrame, known: DataFrame) -> DataFrame:
    """(token, weight) over all distinct values of (plain, toks); (token) of ``known`` are no names."""
    # capitals count only inside values that mix cases, and not for the first word
    raw = F.regexp_extract_all("plain", F.lit(r"\p{L}[\p{L}\p{M}]*(?:'[\p{L}]+)?"), F.lit(0))
    mixed = (F.col("plain") != F.upper("plain")) & (F.col("plain") != F.lower("plain"))
    seen = (
        values.where(mixed)
        .select(F.explode(F.filter(raw, lambda w, i: i > 0)).alias("w"))
        .groupBy(stems(F.lower("w")).alias("token"))
        .agg(F.avg(F.col("w").rlike(r"^\p{Lu}").cast("double")).alias("capital"))
    )
    df = values.select(F.explode(F.array_distinct("toks")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    total = values.agg(F.count(F.lit(1)).alias("total"))
    idf = F.log((F.col("total") + 1) / (F.col("df") + 0.5))
    name = F.col("known").isNull() & (F.coalesce("capital", F.lit(0.0)) >= NAME_SHARE)
    return (
        df.join(seen, "token", "left")
        .join(F.broadcast(known.withColumn("known", F.lit(True))), "token", "left")  # of fixed size
        .crossJoin(F.broadcast(total))  # one row
        .select("token", (idf * F.when(name, F.lit(NAME_WEIGHT)).otherwise(F.lit(1.0))).alias("weight"))
    )


def residue_values(values: DataFrame, cover: float = COVER) -> DataFrame:
    """(value) of the distinct values of ``values`` that are residue."""
    spark = values.sparkSession
    core = spark.createDataFrame([(k, f, len(words), w) for k, (f, words) in enumerate(E.cores()) for w in words], "exemplar int, family string, length int, token string")
    vocabulary = spark.createDataFrame(E.vocabulary(), "family string, token string")
    about = spark.createDataFrame([(w,) for w in sorted({E.token(w) for w in E.ABOUT})], "token string")
    talk = spark.createDataFrame(sorted({(E.token(w), w in E.TALK) for w in [*E.TALK, *E.TALK_ALONG]}), "token string, strong boolean")
    known = vocabulary.select("token").union(about).union(talk.select("token")).distinct()

    distinct = values.select("value").distinct().withColumn("plain", plain(F.col("value")))
    distinct = distinct.withColumn("toks", tokens(F.col("plain"))).where(F.size("toks") > 0)
    distinct = materialize(distinct.withColumn("key", F.md5(F.array_join("toks", " "))), "values")
    shapes = distinct.groupBy("key").agg(F.first("toks").alias("toks"))
    weights = materialize(token_weights(distinct.select("plain", "toks"), known), "weights")

    starts = F.when(F.size("toks") <= WINDOW, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("toks") - STEP, F.lit(STEP)))
    whole = shapes.select("key", F.explode(starts).alias("at"), "toks").select("key", "at", F.slice("toks", F.col("at") + 1, WINDOW).alias("part"))
    # retrieval through the index: passages that hold every token of a core exemplar
    held = whole.select("key", "at", F.explode(F.array_distinct("part")).alias("token")).join(F.broadcast(core), "token")
    held = held.groupBy("key", "at", "exemplar", "family", "length").agg(F.count(F.lit(1)).alias("n")).where("n = length")
    held = held.groupBy("key", "at").agg(F.collect_set("family").alias("families")).where(~F.array_contains("families", "about"))  # a few families
    held = materialize(held.select("key", "at", F.explode("families").alias("family")), "held")
    near = whole.join(held.select("key").distinct(), "key", "left_semi")
    words = near.select("key", "at", F.explode("part").alias("token")).groupBy("key", "at", "token").agg(F.count(F.lit(1)).alias("n")).join(weights, "token")
    words = materialize(words.select("key", "at", "token", (F.col("n") * F.col("weight")).alias("w")), "words")
    mass = words.join(F.broadcast(about.withColumn("about", F.lit(True))), "token", "left").groupBy("key", "at")
    mass = mass.agg(F.sum("w").alias("mass"), F.sum(F.when(F.col("about"), F.col("w")).otherwise(0.0)).alias("against"))
    covered = words.join(F.broadcast(vocabulary), "token").join(held, ["key", "at", "family"]).groupBy("key", "at", "family").agg(F.sum("w").alias("covered"))
    covered = covered.groupBy("key", "at").agg(F.max("covered").alias("covered"))
    bad = F.coalesce("covered", F.lit(0.0)) - AGAINST * F.col("against") >= cover * F.col("mass")
    whole_bad = mass.join(covered, ["key", "at"], "left").groupBy("key").agg(F.avg(bad.cast("double")).alias("share")).where("share >= 0.5").select("key")

    slots = shapes.where(F.array_contains("toks", SLOT)).select("key", "toks", F.posexplode("toks").alias("at", "tok")).where(F.col("tok") == SLOT)
    lo = F.greatest(F.col("at") - AROUND, F.lit(0))
    around = slots.select("key", "at", F.explode_outer(F.array_remove(F.slice("toks", lo + 1, F.col("at") + 1 + AROUND - lo), SLOT)).alias("token"))
    around = around.join(weights, "token", "left").join(F.broadcast(talk), "token", "left").groupBy("key", "at")
    spoken = F.sum(F.when(F.col("strong").isNotNull(), F.col("weight")).otherwise(0.0))
    example = F.coalesce(F.max("strong"), F.lit(False)) & (spoken >= cover * F.sum("weight"))
    open_slot = around.agg(example.alias("example")).groupBy("key").agg(F.bool_or(~F.col("example")).alias("open"))
    # a slot that content speaks about is no case even if the rest looks like residue
    verdict = whole_bad.withColumn("bad", F.lit(True)).join(open_slot, "key", "full").where(F.coalesce("open", "bad")).select("key")
    return distinct.join(verdict, "key", "left_semi").select("value")


def residue_nodes(nodes: DataFrame, cover: float = COVER) -> DataFrame:
    """(node_id) of the nodes with at least one residue value."""
    values = materialize(node_values(nodes), "node_values")
    return values.join(residue_values(values, cover), "value", "left_semi").select("node_id").distinct()


def residue_report(nodes: DataFrame, cover: float = COVER) -> DataFrame:
    """(value, nodes): each residue value and the number of nodes that hold it."""
    values = materialize(node_values(nodes), "node_values")
    return values.join(residue_values(values, cover), "value", "left_semi").groupBy("value").agg(F.countDistinct("node_id").alias("nodes"))
