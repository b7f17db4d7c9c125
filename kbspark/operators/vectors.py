"""Vector collections (D): rows of (id, embedding, text, metadata map<string,string>)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

METRICS = ("cosine", "l2", "ip")


def upsert(base: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """``base`` with the rows of ``batch`` put in or replaced.  A key twice in one batch raises an error when run."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    checked = batch.withColumn("n_", n).withColumn(key, F.when(F.col("n_") > 1, F.raise_error(F.lit("duplicate id in batch"))).otherwise(F.col(key)))
    return base.join(batch.select(key), key, "left_anti").unionByName(checked.drop("n_"))


def duplicate_ids(batch: DataFrame, key: str = "id") -> DataFrame:
    return batch.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def where(condition: dict, field: Callable[[str], Column] = lambda n: F.col("metadata")[n]) -> Column:
    """A metadata filter as a column: equality, $eq $ne $gt $gte $lt $lte $in $nin, and $and / $or of such filters."""
    compare = {
        "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
        "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
    }
    parts: list[Column] = []
    for name, value in condition.items():
        if name in ("$and", "$or"):
            both = [where(x, field) for x in value]
            parts.append(reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), both))
        elif isinstance(value, dict):
            parts += [compare[op](field(name), v) for op, v in value.items()]
        else:
            parts.append(field(name) == value)
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """cosine: 1 - cos; l2: squared Euclidean; ip: 1 - inner product.  Smaller is nearer."""
    if metric == "cosine":
        return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    if metric == "ip":
        return 1 - dot(a, b)
    raise ValueError(f"metric must be one of {METRICS}")


#: A vector search is cut into so many groups of rows times groups of queries; each pair of groups, a cell, is a group of its own in the shuffle.
CELLS = (32, 4)
QUERY_TILE, ROW_TILE = 256, 4096


def _nearest(metric: str, k: int, empty: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows (c_id, c_vector) and queries (q_id, q_vector) of a cell -> (query_id, id, d): for each query the ``k`` rows at the
    smallest distances to six digits, smaller ids first.

    Null vectors and those holding nulls or NaN take no part, nor do vectors of other dimensions.  A tile of distances at a time is in memory.
    """

    def matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        vectors = column.combine_chunks()
        sizes, out = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False), {}
        for dim in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == dim)
            m = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
            good = ~np.isnan(m).any(axis=1)
            out[int(dim)] = at[good], m[good]
        return out

    def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = q @ c.T
        if metric == "cosine":
            norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :]
            d = np.divide(d, norms, out=np.zeros_like(d), where=norms > 0)
        elif metric == "l2":
            return np.maximum((q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * d, 0)
        return np.subtract(1, d, out=d)

    def best(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, row of c, distance) of the nearest; rows of ``c`` are in the order of their ids."""
        row, col, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        reach = np.full(len(q), np.inf)
        for start in range(0, len(c), ROW_TILE):
            d = distances(q, c[start : start + ROW_TILE])
            if start == 0 and d.shape[1] > k:
                reach = np.partition(d, k - 1, axis=1)[:, k - 1] + 2e-6
            i, j = np.nonzero(~(d > reach[:, None]))  # what is not a number stays, and comes last
            if len(i):
                row, col, dist = np.concatenate([row, i]), np.concatenate([col, j + start]), np.concatenate([dist, d[i, j]])
                rounded = np.floor(dist * 1e6 + 0.5)
                order = np.lexsort((col, rounded, row))
                row, col, dist, rounded = row[order], col[order], dist[order], rounded[order]
                first = np.searchsorted(row, np.arange(len(q)))
                stays = np.arange(len(row)) - first[row] < k
                row, col, dist, rounded = row[stays], col[stays], dist[stays], rounded[stays]
                last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row] == k - 1)
                reach = np.full(len(q), np.inf)
                reach[row[last]] = (rounded[last] - 0.5) / 1e6 + 1e-9  # later ones have larger ids, so they have to be nearer
        return row, col, dist

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:  # a side without rows has no columns either
            return empty.empty_table()
        rows = rows.take(pc.sort_indices(rows["c_id"]))
        left, right, out = matrices(queries["q_vector"]), matrices(rows["c_vector"]), []
        for dim in left.keys() & right.keys():
            (qat, q), (cat, c) = left[dim], right[dim]
            for start in range(0, len(q), QUERY_TILE):
                i, j, d = best(q[start : start + QUERY_TILE], c)
                out.append((qat[i + start], cat[j], d))
        i, j, d = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (list(zip(*out)) or [()] * 3))
        return pa.table({"query_id": queries["q_id"].take(pa.array(i)), "id": rows["c_id"].take(pa.array(j)), "d": pa.array(d.astype(np.float64))})

    return run


def knn(queries: DataFrame, coll: DataFrame, k: int, metric: str = "cosine", condition: Column | None = None, max_distance: float | None = None) -> DataFrame:
    """(query_id, id, distance, rank) of the ``k`` nearest rows for each query (query_id, embedding).

    Exact.  Rows and queries are dealt out by hashes of their ids, a row to a cell for each group of queries and a query to a cell for each group of
    rows; matrix products in each cell give the distances, of which ``k`` a query and cell reach the next shuffle.  Ids stay out of the arithmetic.
    A vector of length zero is at cosine distance 1 from all.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    n, m = CELLS
    group = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    c = (coll if condition is None else coll.where(condition)).select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("g"), "id", "embedding")
    c = c.select((group("id", n) * m + F.col("g")).alias("cell"), F.col("id").alias("c_id"), F.col("embedding").alias("c_vector"))  # new names, as both sides may come from one table
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("g"), "query_id", "embedding")
    q = q.select((F.col("g") * m + group("query_id", m)).alias("cell"), F.col("query_id").alias("q_id"), F.col("embedding").alias("q_vector"))
    schema = StructType([StructField("query_id", q.schema["q_id"].dataType), StructField("id", c.schema["c_id"].dataType), StructField("d", DoubleType())])
    near = c.groupBy("cell").cogroup(q.groupBy("cell")).applyInArrow(_nearest(metric, k, to_arrow_schema(schema)), schema)
    pairs = near.select("query_id", "id", F.round("d", 6).alias("distance"))
    if max_distance is not None:
        pairs = pairs.where(F.col("distance") <= max_distance)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fetch(coll: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of ``coll`` by requests (request_id, ids array) with pos; missing ids are skipped."""
    wanted = requests.select("request_id", F.posexplode("ids").alias("pos", "id"))
    return wanted.join(coll, "id")


def delete(coll: DataFrame, ids: DataFrame | None = None, condition: Column | None = None) -> DataFrame:
    """``coll`` without the rows of ``ids`` (id) and those for which ``condition`` is true; both given: rows that meet both go."""
    if ids is None and condition is None:
        return coll
    if ids is None:
        return coll.where(~F.coalesce(condition, F.lit(False)))
    if condition is None:
        return coll.join(ids.select("id"), "id", "left_anti")
    gone = coll.where(condition).select("id").join(ids.select("id"), "id", "left_semi")
    return coll.join(gone, "id", "left_anti")


def patch(coll: DataFrame, patches: DataFrame) -> DataFrame:
    """``coll`` with ``patches`` (id, metadata) laid over the metadata of existing ids."""
    p = patches.select("id", F.col("metadata").alias("new_"))
    old = F.coalesce(F.map_filter("metadata", lambda k, v: ~F.array_contains(F.map_keys("new_"), k)), F.expr("map()").cast("map<string,string>"))
    merged = F.when(F.col("new_").isNull(), F.col("metadata")).otherwise(F.map_concat(old, "new_"))
    return coll.join(p, "id", "left").withColumn("metadata", merged).drop("new_")


def validate_vectors(rows: DataFrame, dimension: int) -> DataFrame:
    """``rows`` (id, embedding, text) plus reason: why a record is refused, null if it is not."""
    both = F.col("embedding").isNotNull() & F.col("text").isNotNull()
    none = F.col("embedding").isNull() & F.col("text").isNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    reason = (
        F.when(F.col("id").isNull() | (F.length(F.col("id").cast("string")) == 0) | (F.length(F.col("id").cast("string")) > 512), "id")
        .when(both | none, "text_or_vector")
        .when(F.col("embedding").isNotNull() & (F.size("embedding") != dimension), "dimension")
        .when(F.col("embedding").isNotNull() & ~finite, "not_finite")
    )
    return rows.withColumn("reason", reason)


def hashed_embedding(dimension: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedding of token counts, for tests and as a default of :func:`embed`."""
    import math
    import zlib

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % dimension] += 1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return run


def embed(df: DataFrame, fn: Callable[[list[str]], list[list[float]]], dimension: int, batch_size: int = 16, max_batch_tokens: int = 8192) -> DataFrame:
    """``df`` (id, text) plus embedding.  Batches are bounded in items and estimated tokens; a batch that
    raises MemoryError is halved; a wrong number or length of vectors is an error."""

    def call(texts: list[str]) -> list[list[float]]:
        try:
            out = fn(texts)
        except MemoryError:
            if len(texts) == 1:
                raise
            return call(texts[: len(texts) // 2]) + call(texts[len(texts) // 2 :])
        if len(out) != len(texts) or any(len(v) != dimension for v in out):
            raise ValueError("the embedding function returned a wrong number or length of vectors")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, done, cost = [], [], 0
            for t in [x or "" for x in pdf["text"]]:
                n = len(t.encode())
                if texts and (len(texts) >= batch_size or cost + n > 4 * max_batch_tokens):
                    done += call(texts)
                    texts, cost = [], 0
                texts.append(t)
                cost += n
            done += call(texts) if texts else []
            yield pd.DataFrame({"id": pdf["id"], "embedding": done})

    return df.select("id", "text").mapInPandas(run, f"id {df.schema['id'].dataType.simpleString()}, embedding array<float>")


def collection_stats(coll: DataFrame, doc: Column) -> DataFrame:
    """One row: rows, documents, chunks per document (mean), dimension (largest)."""
    return coll.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(doc).alias("documents"),
        F.round(F.count(F.lit(1)) / F.countDistinct(doc), 6).alias("chunks_per_document"), F.max(F.size("embedding")).alias("dimension"),
    )
