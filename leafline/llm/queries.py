"""The pN_ queries of this subpackage, and their SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import abuse, clusters, packing, residue
from leafline.llm.mixture import sample_by_targets
from leafline.llm.split import LIMIT, OVERLAP, split_oversized, word_count
from leafline.llm.tokens import count_tokens, decode_ids, encode_ids
from leafline.session import latest_rows, materialize, table


def broken(*rules: tuple[str, DataFrame, str]) -> DataFrame:
    """(rule, broken): for each (rule, rows, condition) the number of rows that meet the condition, which should be none."""
    out = None
    for rule, rows, condition in rules:
        row = rows.agg(F.count_if(F.expr(condition)).alias("broken")).select(F.lit(rule).alias("rule"), "broken")
        out = row if out is None else out.unionByName(row)
    return out


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.found_pairs(table(spark, folder, "cluster_nodes"))


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.cluster_report(table(spark, folder, "cluster_nodes"))


def _p2(spark: SparkSession, folder: str) -> DataFrame:
    documents = split_oversized(table(spark, folder, "corpus_documents")).withColumn("kind", F.lit("document"))
    chunks = split_oversized(table(spark, folder, "chunks")).withColumn("kind", F.lit("chunk"))
    return documents.unionByName(chunks)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p2(spark, folder).where(F.col("piece") == 0).select("kind", "id")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _p2(spark, folder).select("kind", "id", "piece", "n_pieces", "first_word", "n_words", "overlap", "content")


def p2_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What every result of the splitting must keep, counted."""
    pieces = materialize(_p2(spark, folder), "pieces")
    sizes = None
    for kind, name in (("document", "corpus_documents"), ("chunk", "chunks")):
        rows = latest_rows(table(spark, folder, name), "id", "ingested_at", "content").select(F.lit(kind).alias("kind"), "id", word_count(F.col("content")).alias("words"))
        sizes = rows if sizes is None else sizes.unionByName(rows)
    told = pieces.groupBy("kind", "id").agg(F.sum(F.col("n_words") - F.col("overlap")).alias("told"), F.count_distinct("piece").alias("n"), F.max("n_pieces").alias("n_pieces"), F.max(F.col("first_word") + F.col("n_words")).alias("end"))
    whole = sizes.where(F.col("words") > LIMIT).join(told, ["kind", "id"], "left")
    counted = pieces.withColumn("counted", word_count(F.col("content")))
    return broken(
        (f"piece of more than {LIMIT} words", counted, f"counted > {LIMIT}"), ("words of a piece miscounted", counted, "counted <> n_words"), (f"overlap of more than {OVERLAP} words", pieces, f"overlap > {OVERLAP}"),
        ("text not covered once by its pieces", whole, "coalesce(told, 0) <> words OR end <> words"), ("piece missing", whole, "coalesce(n, 0) <> coalesce(n_pieces, -1)"),
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    _, report = sample_by_targets(table(spark, folder, "queries"), table(spark, folder, "suite_targets"))
    return report.where("cause = 'supply'").select("suite_id", "category", "difficulty")


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sample_by_targets(table(spark, folder, "queries"), table(spark, folder, "suite_targets"))[0]


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return sample_by_targets(table(spark, folder, "queries"), table(spark, folder, "suite_targets"))[1]


def p3_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What every sample must keep, counted."""
    sample, report = sample_by_targets(table(spark, folder, "queries"), table(spark, folder, "suite_targets"))
    report = materialize(report, "report")
    drawn = sample.groupBy("suite_id", "category", "difficulty").agg(F.count_distinct("id").alias("ids"), F.count(F.lit(1)).alias("rows"))
    cells = materialize(report.join(drawn, ["suite_id", "category", "difficulty"], "left"), "cells")
    suites = report.groupBy("suite_id").agg(F.sum("sampled").alias("sampled"), F.sum("available").alias("available"), F.max("sample_rows").alias("wanted"), F.sum(F.least("available", "quota")).alias("owed"), F.sum(F.least("available", F.col("min_rows").cast("long"))).alias("least"))
    short = report.where("cause = 'size'").join(suites.select("suite_id", "owed", "wanted"), "suite_id")
    return broken(
        ("cell without its minimum though it has rows", cells, "sampled < least(available, min_rows)"), ("cell with more rows than there are", cells, "sampled > available"),
        ("report and sample differ", cells, "coalesce(rows, 0) <> sampled OR coalesce(ids, 0) <> sampled"), ("cell under its quota without a cause", cells, "gap < 0 AND cause IS NULL"),
        ("sample of another size", suites, "sampled <> greatest(least(wanted, available), least)"), ("cell cut for size where the quotas fit", short, "owed <= wanted"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_nodes(table(spark, folder, "nodes"))


def p5_values(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_report(table(spark, folder, "nodes"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_ids(table(spark, folder, "documents"))


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What every encoding must keep, counted: read back, the ids of each document give its text."""
    texts = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("source"))
    ids = materialize(encode_ids(table(spark, folder, "documents")), "ids")
    sizes = ids.select("doc_id", F.size("ids").alias("n"))
    back = texts.join(decode_ids(ids), "doc_id", "left").join(sizes, "doc_id", "left")
    rows = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    return broken(
        ("document without ids", back, "n IS NULL"), ("ids that do not give the text", back, "coalesce(text, '') <> source"),
        ("ids of an empty text", back, "source = '' AND n <> 0"), ("more ids than bytes", back, "n > octet_length(source)"), ("document in two rows", rows, "rows > 1"),
    )


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = count_tokens(table(spark, folder, "documents")).select(F.col("doc_id").alias("doc"), F.col("n_tokens").alias("size"))
    return packing.pack_items(sizes).withColumnRenamed("doc", "doc_id")


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What every packing must keep, counted."""
    sizes = materialize(count_tokens(table(spark, folder, "documents")).select(F.col("doc_id").alias("doc"), F.col("n_tokens").alias("size")), "sizes")
    packed = materialize(packing.pack_items(sizes), "packed")
    docs = sizes.where("size > 0").join(packed.groupBy("doc").agg(F.sum("size").alias("packed"), F.count(F.lit(1)).alias("pieces")), "doc", "left")
    docs = docs.withColumn("due", F.ceil(F.col("size") / packing.CAPACITY))
    containers = packed.groupBy("container").agg(F.sum("size").alias("used"), F.max(F.col("start") + F.col("size")).alias("end"), F.count_distinct("start").alias("starts"), F.count(F.lit(1)).alias("pieces"))
    fill = containers.agg(F.count(F.lit(1)).alias("n"), F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / packing.CAPACITY).alias("bound"))
    return broken(
        ("container over its capacity", containers, f"used > {packing.CAPACITY}"), ("places that overlap or leave gaps", containers, "end <> used OR starts <> pieces"),
        ("document lost or changed", docs, "coalesce(packed, 0) <> size"), ("document split though it fits", docs, "pieces > due"), ("more than one in a hundred containers over the bound", fill, "n > ceil(bound * 1.01)"),
    )


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.found(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = abuse.score_documents(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))
    return scores.withColumn("score", F.round("score", 6))


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.source_rates(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What every scoring must keep, counted: whole, bounded, and with passages that stand in the text where they are said to."""
    documents = table(spark, folder, "documents")
    scores = materialize(abuse.score_documents(documents, table(spark, folder, "doc_labels")), "scores")
    told = documents.select("doc_id", F.col("text").alias("whole")).join(scores, "doc_id", "left")
    each = told.select("whole", "score", F.explode("passages").alias("p"))
    cut = F.col("whole").substr(F.col("p.start") + 1, F.col("p.end") - F.col("p.start"))
    each = each.select("score", F.col("p.score").alias("own"), (cut == F.col("p.text")).alias("there"))
    return broken(
        ("document without a score", told, "score IS NULL"), ("score out of bounds", told, "score < 0 OR score > 1"), ("worst passage without passages", told, "(worst IS NULL) <> (passages IS NULL)"),
        ("passage below the threshold", each, f"own < {abuse.THRESHOLD}"), ("passage above its document", each, "own > score + 1e-6"), ("passage that is not there in the text", each, "NOT coalesce(there, false)"),
        ("score of an empty text", told, "score > 0 AND trim(coalesce(whole, '')) = ''"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_clusters, p2_found, p2_pieces, p2_invariants, p3_found, p3_sample, p3_report, p3_invariants, p5_found, p5_values, p6_ids, p6_invariants,
        p7_containers, p7_invariants, p8_found, p8_scores, p8_rates, p8_invariants,
    )
}

_LATEST_QUERIES = """
latest AS (
  SELECT id, suite_id,
    regexp_replace(regexp_replace(lower(category), '^\\s+|\\s+$', '', 'g'), '[\\s_-]+', '_', 'g') AS cat,
    regexp_replace(regexp_replace(lower(difficulty), '^\\s+|\\s+$', '', 'g'), '[\\s_-]+', '_', 'g') AS dif
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC) AS rn FROM queries) WHERE rn = 1)
"""


def _none(*rules: str) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST(0 AS BIGINT) AS broken" for r in rules)


SQL = {
    "p2_invariants": _none(f"piece of more than {LIMIT} words", "words of a piece miscounted", f"overlap of more than {OVERLAP} words", "text not covered once by its pieces", "piece missing"),
    "p3_invariants": _none(
        "cell without its minimum though it has rows", "cell with more rows than there are", "report and sample differ", "cell under its quota without a cause", "sample of another size", "cell cut for size where the quotas fit",
    ),
    "p1_found": f"""
WITH RECURSIVE e AS (SELECT built_at AS t, chunk_ids, embeddings, unnest(range(1, len(chunk_ids) + 1)) AS k FROM cluster_nodes),
r AS (SELECT chunk_ids[k] AS id, CASE WHEN k <= len(embeddings) THEN embeddings[k] END AS v, t FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC NULLS LAST, v IS NULL) AS rn FROM r WHERE id IS NOT NULL),
u AS (SELECT id, CAST(v AS DOUBLE[]) AS v FROM o WHERE rn = 1 AND len(v) = {clusters.DIM}
  AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
n AS MATERIALIZED (SELECT id, CAST(v AS DOUBLE[{clusters.DIM}]) AS v FROM u),
l AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id AND array_cosine_similarity(a.v, b.v) >= {clusters.THRESHOLD}),
reach AS (SELECT id, id AS first_id FROM n UNION SELECT l.b, reach.first_id FROM reach JOIN l ON l.a = reach.id WHERE reach.first_id < l.b),
m AS (SELECT id, min(first_id) AS first_id FROM reach GROUP BY 1)
SELECT first_id, id AS chunk_id FROM m WHERE first_id <> id
""",
    "p6_invariants": _none("document without ids", "ids that do not give the text", "ids of an empty text", "more ids than bytes", "document in two rows"),
    "p8_invariants": _none(
        "document without a score", "score out of bounds", "worst passage without passages", "passage below the threshold", "passage above its document", "passage that is not there in the text", "score of an empty text",
    ),
    "p7_invariants": _none("container over its capacity", "places that overlap or leave gaps", "document lost or changed", "document split though it fits", "more than one in a hundred containers over the bound"),
    "p2_found": """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM corpus_documents),
     c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM chunks),
     u AS (SELECT 'document' AS kind, id, content FROM d WHERE rn = 1
           UNION ALL SELECT 'chunk' AS kind, id, content FROM c WHERE rn = 1)
SELECT kind, id FROM u WHERE len(regexp_extract_all(content, '[^ \\t\\r\\n]+')) > 512
""",
    "p3_found": f"""
WITH {_LATEST_QUERIES}
SELECT t.suite_id, t.category, t.difficulty
FROM suite_targets t LEFT JOIN latest q ON q.suite_id = t.suite_id AND q.cat = t.category AND q.dif = t.difficulty
GROUP BY t.suite_id, t.category, t.difficulty, t.min_rows, t.share, t.sample_rows
HAVING count(q.id) < greatest(t.min_rows, CAST(round(t.share * t.sample_rows) AS BIGINT))
""",
}
