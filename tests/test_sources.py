import pytest

from leafline.operators.retrieval import Bm25
from leafline.sources import files, stores
from leafline.streaming.arrivals import rank_arrivals


def test_text_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in (("a/2.MD", " two "), ("1.txt", "one"), ("blank.rst", " \n "), ("skip.py", "x"), ("z é+b.md", "last")):
        (tmp_path / name).write_text(text)
    rows = files.read_text_folder(spark, str(tmp_path), "book").orderBy("id").collect()
    assert [(r["id"], r["content"], r["metadata"]["path"]) for r in rows] == [("book-00000", "one", "1.txt"), ("book-00001", "two", "a/2.MD"), ("book-00002", "last", "z é+b.md")]
    with pytest.raises(Exception):
        files.read_text_folder(spark, str(tmp_path / "missing"), "x").collect()


def test_articles(spark):
    long = "software word " * 300
    df = spark.createDataFrame([("A", long), ("B", "software"), ("C", "moth " * 600), ("D", long + "\n== References ==\nx")], "title string, text string")
    rows = files.select_articles(df, 5).collect()
    assert {r["metadata"]["title"] for r in rows} == {"A", "D"} and all("References" not in r["content"] for r in rows)
    assert {r["id"] for r in rows} == {"wikipedia-00000", "wikipedia-00001"}
    book = df.selectExpr("title AS id", "'s' AS source", "text AS content", "map() AS metadata")
    assert files.preset("small", book, small=2).count() == 2 and files.preset("medium", book).count() == 4
    assert files.preset("large", book, files.select_articles(df, 1).selectExpr("id", "source", "content", "map() AS metadata")).count() == 5
    with pytest.raises(ValueError):
        files.preset("huge", book)


def test_chunks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("c", "d", "text", 3, {"k": "v"}, 2), ("a", "d", "more", 1, None, 1)], "id string, document_id string, content string, token_count int, metadata map<string,string>, pos bigint")
    files.write_table(df, str(tmp_path / "chunks"))
    assert [r["id"] for r in files.read_chunks(spark, str(tmp_path / "chunks"), 1).collect()] == ["a"]
    files.write_table(df, str(tmp_path / "chunks.json"), "json")
    assert files.read_chunks(spark, str(tmp_path / "chunks.json")).count() == 2
    files.write_table(spark.createDataFrame([(1.23456789,)], "x double"), str(tmp_path / "r"), digits=4)
    assert spark.read.parquet(str(tmp_path / "r")).first()["x"] == 1.2346


def test_store_computes_only_what_is_missing(spark, tmp_path):
    store = stores.pair_scores(spark, str(tmp_path / "scores"))
    asked = []

    def compute(rows):
        asked.append(rows.count())
        return rows.selectExpr("key", "1.0D AS score")

    want = spark.createDataFrame([("a",), ("b",)], "key string")
    assert store.fill(want, compute).count() == 2
    assert store.fill(want.union(spark.createDataFrame([("c",)], "key string")), compute).count() == 3
    assert asked == [2, 1]


def test_tree_store(spark, tmp_path):
    assert stores.tree(spark, str(tmp_path / "t")) is None
    nodes = spark.createDataFrame([("r", [1.0])], "node_id string, embedding array<float>")
    edges = spark.createDataFrame([("r", "x", 0)], "parent_id string, child_id string, child_pos int")
    stores.save_tree(nodes, edges, str(tmp_path / "t"))
    assert stores.tree(spark, str(tmp_path / "t"))[1].count() == 1


def test_arriving_queries(spark, tmp_path):
    index = Bm25(spark.createDataFrame([("c1", 0, "python code"), ("c2", 1, "java code"), ("c3", 2, "rust code"), ("c4", 3, "go code")], "id string, pos long, content string"))
    inbox = tmp_path / "in"
    spark.createDataFrame([("q1", "python"), ("q2", "java")], "query_id string, text string").write.parquet(str(inbox))
    arrivals = spark.readStream.schema("query_id string, text string").parquet(str(inbox))
    rank_arrivals(arrivals, index, str(tmp_path / "out"), str(tmp_path / "cp"), 1, once=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in rows} == {("q1", "c1"), ("q2", "c2")}
