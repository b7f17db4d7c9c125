"""Exact top-k inner-product search: ball-tree branch and bound per shard.

Vectors are integers (``floor(scale * x)``), so scores are exact.  Rows are dealt into shards of at
most about :data:`SHARD_ROWS` by a hash of id and vector; each shard becomes one row that holds its
ball tree.  Queries travel in blocks.  A block first searches one shard, which gives each of its
queries a k-th score; every other shard then starts from that score and visits its leaves in the
order of their inner-product upper bound ``q.c + |q| r``, until no bound reaches the k-th score.

Scale: shard rows and query blocks have bounded size whatever the input; the work is
(query blocks) x (shards) independent rows.  Equal vectors inside a shard keep only the k + 1
smallest ids, which is exact, so one very common vector costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARD_ROWS = 8192
BLOCK_ROWS = 1024
LEAF_ROWS = 128


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, dim, v): ids with vectors of floor(scale * x).

    Rows with a null id, a null or empty vector, or a component that is null or not finite take no part.
    """
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return (
        df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0))
        .where(finite)
        .select(
            F.col(id_col).cast("long").alias("id"),
            F.size(vec_col).alias("dim"),
            F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"),
        )
    )


def build_tree(ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in leaf order, leaf starts, leaf centres and radii."""
    order = np.lexsort((ids, *v.T[::-1]))
    ids, v = ids[order], v[order]
    new = np.r_[True, (v[1:] != v[:-1]).any(axis=1)]
    starts = np.flatnonzero(new)
    rank = np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
    ids, v = ids[rank <= k], v[rank <= k]
    leaves, todo = [], [np.arange(len(ids))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF_ROWS:
            leaves.append(rows)
            continue
        x = v[rows]
        far = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
        other = x[np.argmax(((x - far) ** 2).sum(axis=1))]
        side = np.argsort(x @ (other - far), kind="stable")
        todo += [rows[side[: len(rows) // 2]], rows[side[len(rows) // 2 :]]]
    leaves = [r[np.argsort(ids[r])] for r in leaves]
    centre = np.array([v[r].mean(axis=0) for r in leaves])
    radius = np.array([np.sqrt(((v[r] - c) ** 2).sum(axis=1).max()) for r, c in zip(leaves, centre, strict=True)])
    rows = np.concatenate(leaves)
    return ids[rows], v[rows], np.cumsum([0] + [len(r) for r in leaves]), centre, radius


def merge(scores: np.ndarray, ids: np.ndarray, s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    s, i = np.concatenate([scores, s], axis=1), np.concatenate([ids, i], axis=1)
    best = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def search(tree, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top k (scores, ids) of each query in one shard; scores below ``floor`` may be left out."""
    ids, v, starts, centre, radius = tree
    scores = np.full((len(q), k), -np.inf)
    found = np.full((len(q), k), np.iinfo(np.int64).max)
    bound = q @ centre.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius[None, :]
    bound += 1e-3 + 1e-9 * np.abs(bound)
    order = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(len(q))
    for step in range(len(radius)):
        leaf = order[active, step]
        alive = bound[active, leaf] >= np.maximum(scores[active, -1], floor[active])
        active, leaf = active[alive], leaf[alive]
        if not len(active):
            break
        for n in np.unique(leaf):
            own = active[leaf == n]
            part = slice(starts[n], starts[n + 1])
            s = q[own] @ v[part].T
            s[qid[own][:, None] == ids[part][None, :]] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            scores[own], found[own] = merge(scores[own], found[own], np.take_along_axis(s, top, 1), ids[part][top], k)
    return scores, found


def _pack(ids: pd.Series, v: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return ids.to_numpy(np.int64), np.array(v.tolist(), dtype=np.float64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries`` (both as of :func:`integer_vectors`).

    Returns query_id, rank (from 1), vec_id, score.  Ties go to the smaller id; rows with the
    query's own id are no candidates; a query is compared with vectors of its own length only.
    Queries or vectors repeated under one id count once.  Empty tables give an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    vectors = vectors.dropDuplicates(["id", "v"])
    deal = F.xxhash64("id", "v")
    n_shards = -(-max(1, vectors.count()) // SHARD_ROWS)
    n_blocks = -(-max(1, queries.count()) // BLOCK_ROWS)

    def trees(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v, starts, centre, radius = build_tree(*_pack(pdf["id"], pdf["v"]), k)
        data = [ids.tobytes(), v.astype(np.int64).tobytes(), starts.astype(np.int64).tobytes(), centre.tobytes(), radius.tobytes()]
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "tree": [data]})

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v = _pack(pdf["id"], pdf["v"])
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "qid": [ids.tobytes()], "q": [v.tobytes()]})

    shards = scratch.write(
        vectors.withColumn("shard", F.pmod(deal, F.lit(n_shards)))
        .groupBy("dim", "shard").applyInPandas(trees, "dim int, shard long, tree array<binary>")
    )
    asked = scratch.write(
        queries.dropDuplicates(["id"]).withColumn("block", F.pmod(deal, F.lit(n_blocks)))
        .groupBy("dim", "block").applyInPandas(blocks, "dim int, block long, qid binary, q binary")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                f, i = np.float64, np.int64
                ids, v, starts, centre, radius = (np.frombuffer(b, t) for b, t in zip(r.tree, (i, i, i, f, f), strict=True))
                tree = ids, v.reshape(-1, r.dim).astype(f), starts, centre.reshape(-1, r.dim), radius
                qid, q = np.frombuffer(r.qid, i), np.frombuffer(r.q, f).reshape(-1, r.dim)
                floor = np.frombuffer(r.floor, f) if r.floor is not None else np.full(len(qid), -np.inf)
                s, found = search(tree, qid, q, floor, k)
                kth = np.maximum(s[:, -1], floor)
                rows, cols = np.nonzero(np.isfinite(s) & (s >= floor[:, None]))
                yield pd.DataFrame({
                    "dim": r.dim, "block": r.block, "floor": [kth.tobytes()],
                    "hits": [list(zip(qid[rows].tolist(), found[rows, cols].tolist(), s[rows, cols].astype(i).tolist(), strict=True))],
                })

    out = "dim int, block long, floor binary, hits array<struct<query_id:long,vec_id:long,score:long>>"
    home = F.pmod(F.col("block"), F.lit(n_shards))
    first = scratch.write(
        asked.withColumn("shard", home).join(shards, ["dim", "shard"])
        .withColumn("floor", F.lit(None).cast("binary"))
        .repartition(n_blocks, "dim", "block").mapInPandas(run, out)
    )
    tour = (
        asked.join(first.select("dim", "block", "floor"), ["dim", "block"], "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
        .where((F.col("shard") != home) | F.col("floor").isNull())
    )
    rest = tour.join(shards, ["dim", "shard"]).repartition("dim", "block", "shard").mapInPandas(run, out)
    hits = first.select(F.inline("hits")).unionByName(rest.select(F.inline("hits"))).dropDuplicates()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def every_nth(vectors: DataFrame, n: int = 50) -> Column:
    """The stated query set: rows whose id is divisible by ``n``."""
    return vectors.where(F.col("id") % n == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
