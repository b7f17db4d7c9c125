"""The stored BM25 index: merged versions equal fresh builds, bounds lose no hit."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kbspark.operators import lexical as L
from kbspark.operators.lexical_store import LexicalStore

SF = "/root/testdata/sf0.1"


def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), "chunk_id long, text string")


def prose(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(n))


def rows(df, *by):
    return sorted(map(tuple, df.select(*by).collect()), key=str)


def same_as_fresh(store, chunks, queries, *ks):
    fresh = L.build_bm25(chunks)
    assert rows(store.postings(), "chunk_id", "token", "tf", "dl") == rows(fresh.postings, "chunk_id", "token", "tf", "dl")
    near = lambda df: [(t, d, round(i, 9)) for t, d, i in rows(df, "token", "df", "idf")]
    assert near(store.terms()) == near(fresh.terms)
    hits = L.bm25_search(queries, fresh)
    assert rows(store.search(queries), "query_id", "chunk_id", "bm25_score") == rows(hits, "query_id", "chunk_id", "bm25_score")
    for k in ks:
        want = L.lexical_topk(hits, k)
        assert rows(store.top_k(queries, k), *want.columns) == rows(want, *want.columns)


def test_versions_merge_to_a_fresh_build(spark, tmp_path):
    rng = random.Random(2)
    texts = {i: prose(rng, rng.randrange(1, 120)) for i in range(120)} | {500: None, 501: "", 502: "the of", 503: "w1 " * 3000}
    queries = spark.createDataFrame([(i, prose(rng, 12)) for i in range(6)] + [(7, "w1 w1 w299 unheard"), (8, None), (9, "the")], "query_id long, query string")
    store = LexicalStore(spark, str(tmp_path / "index"))
    assert store.refresh(corpus(spark, texts)) == "built"
    same_as_fresh(store, corpus(spark, texts), queries)
    assert store.refresh(corpus(spark, texts).repartition(3)) == "reused"

    texts = texts | {3: prose(rng, 400), 700: prose(rng, 30)}
    del texts[5], texts[503]
    assert store.refresh(corpus(spark, texts)) == "merged"

    texts = texts | {5: "w1 w2 came back", 3: prose(rng, 5)}  # removed and added again, changed twice
    assert store.refresh(corpus(spark, texts)) == "merged"
    same_as_fresh(store, corpus(spark, texts), queries)

    assert rows(store.top_k(queries, 3), "query_id", "chunk_id", "rank") == rows(L.lexical_topk(store.search(queries), 3), "query_id", "chunk_id", "rank")
    texts = {i: t and t + " w7" for i, t in texts.items()}
    assert store.refresh(corpus(spark, texts)) == "built"
    assert store.state().base == store.state().version == 4


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    store = LexicalStore(spark, str(tmp_path / "index"))
    assert store.state() is None
    store.refresh(corpus(spark, {1: "a1 b1", 2: "b1", 3: "c1", 4: "c1", 5: "d1", 6: "e1"}))
    before = rows(store.postings(), "chunk_id", "token")
    commit = store._commit
    store._commit = lambda state: (_ for _ in ()).throw(RuntimeError("lost"))
    changed = corpus(spark, {1: "a1 b1", 2: "x1", 3: "c1", 4: "c1", 5: "d1", 6: "e1"})
    with pytest.raises(RuntimeError):
        store.refresh(changed)
    assert store.state().version == 1 and rows(store.postings(), "chunk_id", "token") == before
    store._commit = commit
    assert store.refresh(changed) == "merged"
    assert rows(store.postings().where("chunk_id = 2"), "token") == [("x1",)]


def test_an_empty_corpus(spark, tmp_path):
    store = LexicalStore(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "w1")], "query_id long, query string")
    assert store.refresh(corpus(spark, {1: "w1"}).limit(0)) == "built"
    assert store.search(queries).count() == 0 and store.top_k(queries, 3).count() == 0 and store.terms().count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_bounds_spare_two_thirds_of_the_postings(spark, tmp_path):
    store = LexicalStore(spark, str(tmp_path / "index"))
    store.refresh(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text"))
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    counted = {}
    got = store.top_k(queries, 5, counted=counted)
    want = L.lexical_topk(store.search(queries), 5)
    assert rows(got, *want.columns) == rows(want, *want.columns)
    assert 0 < 3 * counted["scored"] <= counted["all"]
