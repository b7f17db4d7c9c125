"""Cases that reviews found, on small tables of their own, against the queries' DuckDB SQL."""

import glob

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from kbspark.functions.text import CJK
from kbspark.operators import chunking as C
from kbspark.operators import lexical as L
from kbspark.operators import lifecycle as I
from kbspark.operators import vectors as V
from kbspark.plans.base import ORACLES, QUERIES, corpus, questions
from kbspark.sources.shared import shared_folder

DOCUMENT, ITEM = "doc_id long, text string, lang string, source string", "item_id long, text string"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables (name -> schema, rows) and gives their folder."""

    def write(**given):
        for name, (schema, rows) in given.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def check(spark, folder, name, *names):
    """The rows of a query, which equal those of its SQL over the tables ``names``."""
    duck = duckdb.connect()
    for n in names:
        duck.sql(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet/*.parquet'")
    theirs, df = duck.sql(ORACLES[name]), QUERIES[name](spark, folder)
    order = [theirs.columns.index(c) for c in df.columns]
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    mine = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str)
    assert mine == sorted((tuple(plain(r[i]) for i in order) for r in theirs.fetchall()), key=str)
    return mine


def test_passages_glued_to_longer_words(spark, tables):
    docs = [(1, "so the longestword here is it", "en", "s"), (2, "xlongestword here is my endy", "en", "s"), (3, "one two", "en", "s"), (4, None, "en", "s")]
    items = [(1, "longestword here is"), (2, "here is my end"), (3, "two"), (4, "e t"), (5, "nowhere to be found"), (6, "is my endy ")]
    folder = tables(documents=(DOCUMENT, docs), benchmark=(ITEM, items))
    found = {int(r[0]): r[4] for r in check(spark, folder, "A12", "documents", "benchmark")}
    assert found[1] == found[3][:15] == "s-1-txt,s-2-txt" and found[2] == "s-2-txt" and found[3] == "s-1-txt,s-2-txt,s-3-txt"


def test_knn_is_dealt_out_in_cells(spark):
    """Exact with copies, other dimensions and gaps; without broadcasting, vectors of one dimension still do not meet in one task."""
    import numpy as np

    rng = np.random.default_rng(5)
    m = np.round(rng.normal(size=(700, 6)), 1).astype(np.float32)
    m[300:600] = m[7]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, [1.0, 2.0]), (901, None), (902, [float("nan")] * 6), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, [0.0] * 6)]
    coll = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = coll.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    full = np.vstack([m, np.zeros((1, 6), np.float32)]).astype(np.float64)
    ids = np.array([*range(700), 904])
    for metric in V.METRICS:
        dots, norms = full @ full.T, np.sqrt((full * full).sum(1))
        d = {"ip": 1 - dots, "cosine": 1 - np.divide(dots, np.outer(norms, norms), out=np.zeros_like(dots), where=np.outer(norms, norms) > 0),
             "l2": np.maximum(norms[:, None] ** 2 + norms[None] ** 2 - 2 * dots, 0)}[metric]
        got = {}
        for r in V.knn(queries, coll, 5, metric).collect():
            got.setdefault(r.query_id, {})[r.rank] = (round(r.distance, 5), r.id)
        assert len(got.pop(900)) == 1
        for q, hits in got.items():
            at = int(np.flatnonzero(ids == q)[0])
            order = np.lexsort((ids, np.floor(d[at] * 1e6 + 0.5)))[:5]
            assert [hits[n + 1][1] for n in range(5)] == ids[order].tolist(), (metric, q)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = V.knn(queries, coll, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plan and "cell" in plan


def test_top_hits_build_no_index(spark, tables):
    """The scan gives the rows of a search in a fresh index, and nothing writes a stored one for them."""
    docs = [(i, None if i == 3 else " ".join(f"w{(i * j) % 17}" for j in range(i % 11)), "en", "s") for i in range(60)]
    folder = tables(documents=(DOCUMENT, docs), benchmark=(ITEM, [(0, "w1 w2 w2 w9 the"), (1, "w5 nothere"), (2, "")]))
    stored = lambda: sorted(glob.glob(f"{shared_folder(spark)}/lexical-*/*"))
    before, hits = stored(), QUERIES["C3"](spark, folder).select("query_id", "chunk_id", "bm25_score")
    fresh = L.bm25_search(questions(spark, folder), L.build_bm25(corpus(spark, folder)))
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, fresh.select(*hits.columns).collect())) and stored() == before


def test_equal_sets_of_documents_are_covered_alike(spark):
    batches = spark.createDataFrame([(1, "k", [3, 1, 1], 9, "queued"), (2, "k", [1, 3], 5, "running"), (3, "k", [1, 3], 1, "done"), (4, "k", [1, 2, 3, 4], 7, "queued"), (5, "j", [1, 3], 1, "queued")],
                                    "batch_id long, kb_id string, doc_ids array<long>, created_at long, status string")
    asks = spark.createDataFrame([(1, "k", [1, 3]), (2, "k", [3, 1, 3]), (3, "k", [2, 4]), (4, "k", [5]), (5, "k", []), (6, "j", [3])], "request_id long, kb_id string, doc_ids array<long>")
    assert sorted(map(tuple, I.covering_batch(batches, asks).select("request_id", "batch_id").collect())) == [(1, 2), (2, 2), (3, 4), (6, 5)]


def test_words_are_counted_in_one_pass(spark):
    """Counts of a text are those of its tokens, for every code point; terms leave a task counted, not one row for each text and word."""
    from kbspark.functions.text import STOP_WORDS, tokens, word_counts

    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF]
    texts = ["".join(points[at : at + 100]) for at in range(0, len(points), 100)] + ["é".join(points[at : at + 7]) for at in range(0, 0x3400, 7)]
    texts += ["The Cat the cat_2 a", "中文字 的 ab中文 \U0001f600x", "ÉCOLE “école” ΟΔΟΣ İx", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(4)
    each = tokens(F.coalesce("text", F.lit("")))
    theirs = rows.select("chunk_id", F.filter(each, lambda t: ~t.isin(STOP_WORDS)).alias("l")).collect()
    mine = {r.chunk_id: r for r in word_counts(rows, "chunk_id").collect()}
    dfs = {}
    for r in theirs:
        n = {}
        for t in r.l:
            n[t] = n.get(t, 0) + 1
        m = mine[r.chunk_id]
        assert (m.dl, list(zip(m.words, m.tfs))) == (len(r.l), list(n.items())), ascii(texts[r.chunk_id])[:300]
        for t in n:
            dfs[t] = dfs.get(t, 0) + 1
    found = L.term_counts(rows).collect()
    assert {r.token: r.df for r in found} == dfs and sum(r.total for r in found) == sum(len(r.l) for r in theirs)
    plan = L.term_counts(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_signatures_go_before_texts_are_read_again(spark, monkeypatch):
    """When the sets of the candidates are taken, the disk holds no signature any more."""
    from kbspark.llm import near_dedup as N

    made, seen, sets = [], [], N.shingle_sets

    class Kept(N.Scratch):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    def looked(docs, size):
        for folder in glob.glob(f"{made[0].root}/*".removeprefix("file:")):
            seen.append(spark.read.parquet(folder).columns)
        return sets(docs, size)

    monkeypatch.setattr(N, "Scratch", Kept)
    monkeypatch.setattr(N, "shingle_sets", looked)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[: 50 + i])) for i in range(8)] + [(20, "other words stand here"), (21, None), (22, " ".join(words[:50]))]
    got = {r.doc_id: (r.component_id, r.kept) for r in N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[22] == (0, False) and all(got[i][0] == 0 for i in range(8)) and got[20] == (20, True) and got[21] == (21, True)
    assert seen and not any("signature" in columns for columns in seen)


def test_best_hits_need_no_row_for_each_pair(spark):
    """The best chunks of each question equal those among all pairs, of which only the best become rows; copies tie, questions come in groups."""
    words = ["alpha", "beta", "gamma", "delta", "omega", "und", "über", "知识库"]
    text = lambda i: " ".join(words[(i * j + j // 3) % len(words)] for j in range(1, 4 + i % 9)) if i % 7 else "beta beta gamma"
    chunks = spark.createDataFrame([(f"c{i}", text(i) if i % 11 else None) for i in range(600)], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "beta gamma"), (2, "alpha alpha 知识库"), (3, "omega"), (4, "nothing here"), (5, "über und delta")], "query_id long, query string")
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    wanted = L.wanted_terms(asked, L.term_counts(chunks), n)
    hits = L.bm25_scan(wanted, chunks)
    found = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "bm25_score", "bm25_rank_score", "rank").collect()))
    want = found(L.lexical_topk(hits, 3))
    assert {q for q, *_ in want} == {1, 2, 3, 5} and hits.count() > 600
    for groups in (1, 3):
        assert found(L.bm25_top(wanted, chunks, 3, groups)) == want
    for tile in (1, 100):  # many tiles in a cell
        assert found(L.bm25_top(wanted, chunks, 3, tile=tile)) == want


def test_chunks_are_cut_once(spark):
    """the plan estimates the tokens of a chunk once, not for each piece it is cut into."""
    docs = spark.createDataFrame([(1, "one two. three\n\n" * 60), (2, "文档知识 " * 90), (3, ""), (4, None)], "doc_id long, text string")
    df = C.recursive_chunks(docs, max_tokens=60)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(CJK) <= 2
    assert df.where("doc_id = 1").count() > 2 and {r.doc_id for r in df.collect()} == {1, 2}


def test_stored_index_is_searched_where_its_places_lie(spark, tmp_path, monkeypatch):
    """Of a merged index only hits leave a task, whatever its cells, groups of questions and tiles; ids may be strings."""
    from kbspark.operators import lexical_store as S

    words = ["alpha", "beta", "gamma", "delta", "omega", "und", "über", "知识库"]
    text = lambda i: " ".join(words[(i * j + j // 3) % len(words)] for j in range(1, 4 + i % 9)) if i % 7 else "beta beta gamma"
    chunks = lambda ids: spark.createDataFrame([(f"c{i}", text(i) if i % 11 else None) for i in ids], "chunk_id string, text string")
    before = chunks(range(400)).withColumn("text", F.when(F.expr("chunk_id LIKE 'c1_'"), F.lit("omega other")).otherwise(F.col("text")))
    asked = spark.createDataFrame([(1, "beta gamma"), (2, "alpha alpha 知识库"), (3, "omega"), (4, "nothing here"), (5, "über und delta"), (6, None)], "query_id long, query string")
    now, found = chunks([*range(390), *range(400, 410)]), lambda df: sorted(map(tuple, df.collect()))
    hits = L.bm25_search(asked, L.build_bm25(now))
    all_hits, best = found(hits), found(L.lexical_topk(hits, 3))
    monkeypatch.setattr(S, "CELL_CHUNKS", 100)
    for n, (tile, questions_) in enumerate(((1, 2), (40, 16_384))):
        monkeypatch.setattr(L, "CELL_QUERIES", questions_)
        store = S.LexicalStore(spark, str(tmp_path / f"index{n}"), tile)
        assert (store.refresh(before), store.refresh(now)) == ("built", "merged")
        df = store.search(asked)
        assert found(df) == all_hits and found(store.top_k(asked, 3).select(*L.lexical_topk(hits, 3).columns)) == best
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(cell" in plan and "hashpartitioning(query_id" not in plan


def test_lines_under_a_dense_key_meet_where_their_letters_allow_it(spark):
    """line_dedup: of lines under one key only those become pairs that their letters do not keep apart, and all that are similar do."""
    import random

    from kbspark.llm import line_dedup as D

    rng = random.Random(31)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz éß文") for _ in range(200 + i % 9)) for i in range(80)]
    for i in range(0, 80, 4):  # edits of every kind, up to what the similarity allows
        line = list(lines[i])
        for _ in range(1 + i % 20):
            at = rng.randrange(len(line))
            line[at : at + rng.choice([0, 1])] = rng.choice([[], ["z"], ["文"]])
        lines.append("".join(line))
    rows = spark.createDataFrame(list(enumerate(lines)), "id long, norm string")
    at = rows.select(F.lit(1).alias("cell"), "id", F.length("norm").alias("size"), F.col("id").alias("c"), *D.letter_counts(F.col("norm")))
    most = D.most_edits(F.greatest(F.length("ta"), F.length("tb")))
    near = rows.toDF("x", "ta").join(rows.toDF("y", "tb"), F.col("x") < F.col("y")).where(F.levenshtein("ta", "tb") <= most)
    near, met = {(r.x, r.y) for r in near.collect()}, {(r.x, r.y) for r in D.dense_pairs(at).collect()}
    assert len(near) >= 20 and near <= met and len(met) < 2 * len(near)
