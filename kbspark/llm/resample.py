"""Importance resampling towards a target distribution, over hashed words and word pairs.

Features of a text are its words and its pairs of neighbouring words; the bucket of a feature is the CRC-32 of its bytes.
A block of texts is brought to one alphabet (lower case, one byte for every delimiter); its distinct words, bounded by
delimiters on both sides, go into an Aho-Corasick automaton and carry their CRC and length.  Scanning a text then emits one
payload for each word, and the CRC of a pair is composed from the payloads of two neighbours: the first CRC, carried over as many
zero bytes as the second word is long, plus the second.  No pair is ever written out as bytes.

Two narrow passes over whole texts: one counts buckets of the documents (and of the target texts), one adds up the gains of
every document's buckets.  What is shared is a table of as many numbers as there are buckets.  The draw ranks documents
without a global sort: ranks are offsets by score, from a histogram of the scores (integers in a narrow range), plus the place among documents of equal score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of

BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 25, 20, 7
BLOCK_BYTES = 4 << 20
#: Longer words stand in the automaton under a short name; their payload is the same.
LONG = 256
#: Byte -> byte: ASCII letters in lower case, digits, and bytes of longer characters stay; all else is a delimiter.
ALPHABET = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


@lru_cache(1)
def _powers() -> list[np.ndarray]:
    """Images of the 32 bits of a CRC when 1, 2, 4, ... zero bytes follow."""
    byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # of a last byte
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = [(bits >> np.uint32(8)) ^ byte[bits & np.uint32(255)]]
    for _ in range(31):
        out.append(_apply(out[-1], out[-1]))
    return out


def _apply(images: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for k in range(32):
        out ^= np.where((x >> np.uint32(k)) & np.uint32(1), images[k], np.uint32(0))
    return out


@lru_cache(4096)
def carry_table(n: int) -> np.ndarray:
    """(4, 256): the CRC after ``n`` zero bytes, as the sum of the entries of its four bytes."""
    x = np.arange(256, dtype=np.uint32)[None, :] << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]
    for k, images in enumerate(_powers()):
        if n >> k & 1:
            x = _apply(images, x)
    return x


def carried(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRCs of texts that go on with as many zero bytes as ``lengths`` say, apart from the CRC of what follows."""
    kinds, at = np.unique(lengths, return_inverse=True)
    table = np.stack([carry_table(int(n)) for n in kinds])
    low = np.uint32(255)
    return (
        table[at, 0, crc & low] ^ table[at, 1, (crc >> np.uint32(8)) & low] ^ table[at, 2, (crc >> np.uint32(16)) & low] ^ table[at, 3, crc >> np.uint32(24)]
    )


def payloads(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc, length, words): CRC and byte length of every word in order, and the number of words of each text."""
    plain = [t.translate(ALPHABET) for t in texts]
    words: set[bytes] = set()
    for t in plain:
        words.update(t.split())
    automaton = ahocorasick.Automaton()
    names = {w: b"\1%d" % n for n, w in enumerate(w for w in words if len(w) > LONG)}  # no byte 1 is left in a text
    for w in words:
        # latin-1 strings stand for bytes
        automaton.add_word(f" {names.get(w, w).decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
    out, counts = [], []
    if words:
        automaton.make_automaton()
    for t in plain:
        if names:
            t = b" ".join(names.get(w, w) for w in t.split())
        found = [p for _, p in automaton.iter(f" {t.decode('latin-1')} ")] if words else []
        out.append(np.array(found, np.int64))
        counts.append(len(found))
    all_ = np.concatenate([np.zeros(0, np.int64), *out])
    return (all_ & 0xFFFFFFFF).astype(np.uint32), all_ >> 32, np.array(counts, np.int64)


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text): of every word and every pair of neighbouring words."""
    crc, length, words = payloads(texts)
    text = np.repeat(np.arange(len(texts)), words)
    follows = np.flatnonzero(text[1:] == text[:-1])
    if not len(follows):
        return crc % np.uint32(buckets), text
    spaced = carried(crc[follows], np.ones(len(follows), np.int64)) ^ np.uint32(zlib.crc32(b" "))
    pairs = carried(spaced, length[follows + 1]) ^ crc[follows + 1]
    return np.concatenate([crc, pairs]) % np.uint32(buckets), np.concatenate([text, text[follows]])


def blocks(texts: pa.Array) -> Iterator[list[bytes]]:
    """An Arrow column of bytes in runs of about :data:`BLOCK_BYTES`; a longer text is a run of its own."""
    block, size = [], 0
    for t in texts:
        b = t.as_py() or b""
        if block and size + len(b) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(b)
        size += len(b)
    if block:
        yield block


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sends at most ``buckets`` rows to the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                n += np.bincount(features(block, buckets)[0], minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": used.astype(np.int32), "n": n[used]})

    rows = texts.select(text_of(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the smoothed share of a bucket in ``target`` over that in ``docs``), for every bucket."""
    s, t = [0] * buckets, [0] * buckets
    for counts, table in ((s, docs), (t, target)):
        for r in bucket_counts(table, buckets=buckets).collect():  # at most ``buckets`` rows
            counts[r.bucket] = r.n
    of_docs, of_target = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * of_docs / ((a + 1) * of_target))) for a, b in zip(s, t, strict=True)], np.int64)


def weigh(text: Column, gain: np.ndarray, spark) -> Column:
    """struct<n_features, weight> of a text column: the number of features and the floored mean of their gains (none: 0)."""
    shared = spark.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        g = shared.value
        for batch in batches:
            n, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for block in blocks(batch):
                bucket, of = features(block, len(g))
                count = np.bincount(of, minlength=len(block))
                total = np.bincount(of, g[bucket], minlength=len(block)).astype(np.int64)  # sums of integers, exact in doubles
                n.append(count)
                weight.append(total // np.maximum(count, 1))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(n)), pa.array(np.concatenate(weight))], ["n_features", "weight"])

    return F.arrow_udf(run, "struct<n_features:long,weight:long>")(text.cast("binary"))


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text) against the texts of ``target``.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred (floored) are drawn without replacement: those of
    the highest scores, where the score is the weight plus Gumbel noise by a hash of the id, so the draw does not depend on order or
    partitions.  Ties go to the smaller id.  rank counts from 1 in that order and is null for all others.

    A null text counts as empty: no feature, weight 0, never drawn.  A null id counts as empty text in the hash and comes last among
    ties.  Rows that repeat an id and a text have one score and successive ranks.  Without target texts or documents the
    shares are those of the smoothing.  Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), weigh(text_of("text"), gains(docs, target, buckets), spark).alias("w"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scratch.write(row.select("doc_id", "w.n_features", "w.weight", (F.col("w.weight") + noise).alias("score")))

    # n words have 2 n - 1 features
    can = F.col("n_features") >= 2 * min_words - 1 if min_words > 0 else F.lit(True)
    count = scored.agg(F.coalesce(F.sum(can.cast("long")), F.lit(0))).first()[0]
    draw = percent * count // 100
    same = scored.where(can).groupBy("doc_id", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("times"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    start = scored.where(can).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    start = start.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("start"))  # as many rows as there are scores
    tied = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight").rowsBetween(Window.unboundedPreceding, 0)
    last = same.join(start, "score").withColumn("last", F.col("start") + F.sum("times").over(tied))
    ranked = last.withColumn("rank", F.explode(F.sequence(F.col("last") - F.col("times") + 1, F.col("last"))))
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = ranked.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~can).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with all their columns; a null id is never drawn here."""
    ids = importance_resample(docs, target, **how).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(*docs.columns)
