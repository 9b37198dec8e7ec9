import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafline.functions.vec import cosine, hash_embedding, norm, normalise, path_ema
from leafline.operators import budget, retrieval

CORPUS = [
    ("c1", 0, "python machine learning"), ("c2", 1, "java web development"), ("c3", 2, "python data science statistics"),
    ("c4", 3, "javascript frontend react"), ("c5", 4, "python deep learning neural networks"),
]


@pytest.fixture(scope="module")
def bm25(spark):
    return retrieval.Bm25(spark.createDataFrame(CORPUS, "id string, pos long, content string"))


def ask(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")


def brute_bm25(query):
    docs = [c.split() for _, _, c in CORPUS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    vocabulary = {w for d in docs for w in d}
    idf = {w: math.log((n - sum(w in d for d in docs) + 0.5) / (sum(w in d for d in docs) + 0.5)) for w in vocabulary}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query.lower().split()) for d in docs]


@pytest.mark.parametrize("query", ["python", "python python learning", "Deep WEB", "unseen words", "react"])
def test_bm25_equals_formula(spark, bm25, query):
    rows = bm25.rank(ask(spark, query), 5).orderBy("rank").collect()
    want = sorted(zip((round(s, 6) for s in brute_bm25(query)), range(5)), key=lambda x: (-x[0], x[1]))
    assert [(r["chunk_id"], round(r["score"], 6)) for r in rows] == [(CORPUS[i][0], s) for s, i in want]


def test_bm25_null_query_fills_in_corpus_order(spark, bm25):
    rows = bm25.rank(ask(spark, None, ""), 2).orderBy("query_id", "rank").collect()
    assert [r["chunk_id"] for r in rows] == ["c1", "c2"] * 2


def test_bm25_empty_corpus(spark):
    empty = retrieval.Bm25(spark.createDataFrame([], "id string, pos long, content string"))
    assert empty.rank(ask(spark, "python"), 3).collect() == []


def test_vector_search(spark):
    items = [("c1", 0, [1.0, 0.0, 0.0, 0.0]), ("c2", 1, [0.0, 1.0, 0.0, 0.0]), ("c3", 2, [0.9939, 0.1104, 0.0, 0.0]), ("c4", 3, [0.0, 0.0, 1.0, 0.0])]
    df = spark.createDataFrame(items, "chunk_id string, pos long, vec array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0])], "query_id string, vec array<double>")
    assert [r["chunk_id"] for r in retrieval.vector_top_k(q, df, 2).orderBy("rank").collect()] == ["c1", "c3"]
    assert retrieval.vector_top_k(q, df, 9).count() == 4
    assert retrieval.vector_top_k(q.limit(0), df, 2).collect() == []


def test_vector_search_equals_brute_force_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 8)), 1)
    df = spark.createDataFrame([(f"c{i}", i, v.tolist()) for i, v in enumerate(x)], "chunk_id string, pos long, vec array<double>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", x[i].tolist()) for i in range(40)], "query_id string, vec array<double>")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.vector_top_k(q, df, 5, block=16).collect()}
    for i in range(40):
        order = sorted(range(300), key=lambda j: (-round(float(x[i] @ x[j]), 6), j))[:5]
        assert [got[(f"q{i}", r)] for r in range(1, 6)] == [f"c{j}" for j in order]


def test_fusion_ties_keep_the_first_ranking(spark):
    shape = "query_id string, chunk_id string, score double, rank int"
    one = spark.createDataFrame([("q", "a", 2.0, 1), ("q", "b", 1.0, 2)], shape)
    two = spark.createDataFrame([("q", "c", 2.0, 1), ("q", "b", 1.0, 2)], shape)
    rows = retrieval.fuse(one, two, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["b", "a", "c"]


def test_rescoring_uses_the_cache(spark, bm25):
    q = ask(spark, "python learning")
    chunks = spark.createDataFrame(CORPUS, "id string, pos long, content string")
    first = bm25.rank(q, 5)

    class Counting(retrieval.LexicalScorer):
        seen = 0

        def score(self, pairs):
            self.seen += pairs.count()
            return super().score(pairs)

    scorer = Counting(bm25.idf)
    plain = [r["chunk_id"] for r in retrieval.rescore(first, chunks, q, scorer, 5).orderBy("rank").collect()]
    assert scorer.seen == 5 and plain[0] == "c1"
    from leafline.functions.text import pair_key

    pairs = first.join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id").join(q, "query_id")
    cache = pairs.select(pair_key(F.col("text"), F.col("chunk_id"), F.col("content")).alias("key"), F.when(F.col("chunk_id") == "c2", 9.0).otherwise(0.0).alias("score"))
    assert [r["chunk_id"] for r in retrieval.rescore(first, chunks, q, scorer, 5, cache).orderBy("rank").collect()][0] == "c2"
    assert scorer.seen == 5


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    got = row.select(norm(F.col("a")).alias("n"), normalise(F.col("b")).alias("z"), cosine(F.col("a"), F.col("b")).alias("c"), normalise(F.col("a")).alias("u")).first()
    assert got["n"] == 5 and got["z"] == [0, 0] and got["c"] is None and got["u"] == [0.6, 0.8]
    values = spark.range(1).select(path_ema(F.lit(0.8), F.lit(0.6)).alias("a"), path_ema(F.lit(0.8), F.lit(0.2), 1).alias("b")).first()
    assert round(values["a"], 9) == 0.7 and values["b"] == 0.8


def test_hash_embedding_is_unit_length(spark):
    df = spark.createDataFrame([("a", "one two two three"), ("b", None), ("c", ""), ("d", "x")], "id string, t string")
    got = {r["id"]: r["vec"] for r in hash_embedding(df, "id", "t").collect()}
    assert set(got) <= {"a", "d"} and all(abs(np.linalg.norm(v) - 1) < 1e-9 and len(v) == 64 for v in got.values())


def brute_pack(items, limit, penalty=None):
    used, ids, vecs = 0, [], []
    for rank, cid, tokens, score, vec in sorted(items):
        if used + tokens > limit:
            continue
        if penalty is not None and vecs and score - penalty * max(0, *(float(np.dot(vec, v)) for v in vecs), 0) < 0:
            continue
        used, ids, vecs = used + tokens, [*ids, cid], [*vecs, vec]
    return used, ids


def test_packing_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (f"q{q}", f"c{r}", r, rng.randint(1, 30), round(rng.random() - 0.2, 3), [round(rng.gauss(0, 1), 2) for _ in range(3)]) for q in range(30) for r in range(1, rng.randint(2, 15))
    ]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, tokens int, score double, vec array<double>")
    per = {q: [(r[2], r[1], r[3], r[4], r[5]) for r in rows if r[0] == q] for q in {r[0] for r in rows}}
    assert {r["query_id"]: (r["tokens_used"], r["chunk_ids"]) for r in budget.pack_budget(df, 40).collect()} == {q: brute_pack(i, 40) for q, i in per.items()}
    assert {r["query_id"]: (r["tokens_used"], r["chunk_ids"]) for r in budget.pack_diverse(df, 60, 0.3).collect()} == {q: brute_pack(i, 60, 0.3) for q, i in per.items()}
    curve = budget.pack_curve(df, [10, 20, 80]).collect()
    assert {(r["query_id"], r["budget"]): (r["tokens_used"], r["chunk_ids"]) for r in curve} == {(q, b): brute_pack(i, b) for q, i in per.items() for b in (10, 20, 80)}
    used = {q: [r["tokens_used"] for r in sorted((r for r in curve if r["query_id"] == q), key=lambda r: r["budget"])] for q in per}
    assert all(u == sorted(u) for u in used.values())


def test_packing_skips_and_goes_on(spark):
    df = spark.createDataFrame([("q", "a", 1, 10), ("q", "b", 2, 20), ("q", "c", 3, 5)], "query_id string, chunk_id string, rank int, tokens int")
    assert budget.pack_budget(df, 16).first()["chunk_ids"] == ["a", "c"]
    assert budget.pack_budget(df, 0).first()["chunk_ids"] == []
    assert budget.pack_budget(df.limit(0), 9).collect() == []


def test_best_of_many_blocks_equals_sorting_all():
    rng = np.random.default_rng(9)
    score = rng.integers(-40, 40, (6, 40_000)) / 400 + rng.normal(0, 1e-9, (6, 40_000))
    best = retrieval.Best(6, 5)
    for at in range(0, 40_000, 700):
        best.add(score[:, at : at + 700], np.arange(at, min(at + 700, 40_000)), np.array([f"c{i}" for i in range(at, min(at + 700, 40_000))], dtype=object), digits=4)
    rows = best.rows(np.array([f"q{i}" for i in range(6)], dtype=object)).to_pylist()
    for k in range(6):
        want = sorted(range(40_000), key=lambda i: (-round(score[k, i], 4), i))[:5]
        assert sorted((r for r in rows if r["query_id"] == f"q{k}"), key=lambda r: (-r["score"], r["pos"]))[:5] == [{"query_id": f"q{k}", "chunk_id": f"c{i}", "pos": i, "score": round(score[k, i], 4) + 0.0} for i in want]


def test_document_counts_in_one_pass():
    import pyarrow as pa

    lists = [["a", "b", "a"], [], ["b"], ["c", "c"]] * 3_000
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["words"])
    total = {}
    for out in retrieval.document_counts([batch.slice(0, 7_000), batch.slice(7_000)], most=2):
        for r in out.to_pylist():
            n, w = total.get(r["term"], (0, 0))
            total[r["term"]] = (n + r["df"], w + r["words"])
    assert total == {None: (12_000, 18_000), "a": (3_000, 0), "b": (6_000, 0), "c": (3_000, 0)}


def test_pairs_are_scored_without_lists_of_words_in_rows(spark, monkeypatch):
    idf = spark.createDataFrame([("alpha", 2.0), ("beta", 1.5), ("\u00e9t\u00e9", 0.25), ("off", -0.5), ("a\vb", 1.0)], "term string, idf double")
    queries = {"q1": "Alpha beta alpha gone", "q2": "\u00c9T\u00c9 off beta", "q3": "unknown words", "q4": None, "q5": "A\vB alpha"}
    texts = {"c1": "beta  ALPHA\talphabet", "c2": "\u00e9t\u00e9\noff", "c3": "", "c4": None, "c5": "a\vb b", "c6": "BETA " * 3000}
    pairs = [(q, c, queries[q], texts[c]) for _ in range(60) for q in queries for c in texts]
    weight = {r["term"]: r["idf"] for r in idf.collect()}

    def words(text):
        return {w for w in re.split("[ \t\r\n\f]+", (text or "").lower()) if w}

    def want(q, c):
        known = [t for t in sorted(words(queries[q])) if t in weight]
        mass = sum(weight[t] for t in known)
        return round(sum(weight[t] for t in known if t in words(texts[c])) / mass, 6) if mass > 0 else 0.0

    rows = spark.createDataFrame(pairs, "query_id string, chunk_id string, query string, content string")
    monkeypatch.setattr(F, "array_intersect", None)
    got = retrieval.LexicalScorer(idf).score(rows).collect()
    assert len(got) == len(pairs) and {(r["query_id"], r["chunk_id"]): r["score"] for r in got} == {(q, c): want(q, c) for q in queries for c in texts}
