"""Language-model scores by Katz backoff.

Bigram counts of the training documents are discounted by Good-Turing (counts of at most MAX_R); what
the discount frees is given to the words never seen after a history, in proportion to their
unigram probability, by a backoff weight that makes each history's distribution sum to one exactly.
Unigrams are discounted in the same way; their freed mass is the probability of an unknown word.
The start of a text is a history of its own, its end a token.

    p(w | h) = d(c) c(h w) / c(h)         where h w was seen
             = alpha(h) p(w)              else; alpha(h) = 1 for a history never seen
    alpha(h) = (1 - sum of the seen p(w | h)) / (1 - sum of p(w) over the words seen after h)

Tables, each written once in the shared folder:

1. Texts are cut into words once.  A row of the token table holds a block of documents of about BLOCK_BYTES:
   the 64-bit hashes of its distinct words and the texts as indices into them.
2. Words and bigrams are summed within a block before anything is shuffled; their counts go to buckets
   of about BUCKET_TOKENS tokens by a hash of the whole word or bigram, and each block gets back the corpus
   counts of its own.  One that makes up a third of all tokens is one entry per block.  One block
   with a bigram in its training part owns it for the sums over a history.
3. Counts of counts of all buckets give one set of discounts for the corpus; the sums of each history
   go to buckets in the same way, and denominators and backoff weights come back.
4. Each block scores its documents from the figures of its own words and bigrams.

So the work is the same at every size: scores do not depend on blocks or buckets, a key is at most one
entry per block, nothing that grows is broadcast or collected.  Entries travel as compressed arrays,
one row per block and bucket.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, text_of

MAX_R = 5
BLOCK_BYTES = 8 << 20
BUCKET_TOKENS = 1_500_000
#: Rows of blocks are megabytes each; so many go to Python at once.
BATCH = 2
START, END = 1, 2
WORDS, BIGRAMS = 1, 2
BLOCK = "block long, ids array<long>, train array<boolean>, n array<int>, words binary, stream binary"


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unpack(x: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def pack_keys(x: np.ndarray) -> bytes:
    """Sorted unsigned keys, as differences."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_keys(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x, np.uint64), dtype=np.uint64)


def hash_words(words: list[str]) -> np.ndarray:
    """64-bit hashes above START and END."""
    own = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words]
    return np.maximum(np.array(own, np.uint64), np.uint64(END + 1))


def blocks(docs: DataFrame) -> DataFrame:
    """One row per block of rows of ``docs`` (doc_id, train, text_).

    block: its number; ids, train, n: by document (n: its words); words: hashes of the block's words, then
    START and END; stream: for each document START, its words and END as indices into words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch["text_"]).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(size // BLOCK_BYTES)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if hi > lo:
                    yield one(batch.slice(lo, hi - lo))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(batch["text_"]))
        flat = lists.flatten()
        doc = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        some = pc.not_equal(flat, "")
        doc, coded = doc[some.to_numpy(zero_copy_only=False)], flat.filter(some).dictionary_encode()
        n, v = np.bincount(doc, minlength=len(batch)), len(coded.dictionary)
        first = np.cumsum(n + 2) - (n + 2)
        stream = np.full(int(n.sum()) + 2 * len(batch), v + 1, np.int32)
        stream[first] = v
        stream[np.arange(len(doc)) + 2 * doc + 1] = coded.indices.to_numpy()
        words = np.concatenate([hash_words(coded.dictionary.to_pylist()), np.array([START, END], np.uint64)])
        row = {"ids": batch["doc_id"], "train": batch["train"], "n": pa.array(n, pa.int32())}
        return pa.RecordBatch.from_pydict(
            {"block": pa.array([uuid.uuid4().int >> 65], pa.int64())}
            | {k: pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), x) for k, x in row.items()}
            | {"words": pa.array([pack(words)], pa.binary()), "stream": pa.array([pack(stream)], pa.binary())}
        )

    return docs.mapInArrow(run, BLOCK)


class Block:
    """A row of :func:`blocks`: its tokens in order, each with history h, word w and document doc."""

    def __init__(self, row: dict):
        self.block, self.n = row["block"], np.array(row["n"], np.int64)
        self.train = np.array(row["train"], bool)
        self.words = unpack(row["words"], np.uint64)
        self.order = np.argsort(self.words)
        stream = unpack(row["stream"], np.int32)
        inside = stream[1:] != len(self.words) - 2
        self.h, self.w = stream[:-1][inside], stream[1:][inside]
        self.doc = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n + 1)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct bigrams as sorted 64-bit hashes, an occurrence of each, the bigram of each token)."""
        with np.errstate(over="ignore"):
            g = (self.words[self.h] * np.uint64(0x9E3779B97F4A7C15)) ^ self.words[self.w]
            g = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            g ^= g >> np.uint64(29)
        return np.unique(g, return_index=True, return_inverse=True)

    def by_word(self, answers: list[bytes], kind: type = np.int64) -> np.ndarray:
        """Answers to the sorted words, in the order of the block's words."""
        x = np.concatenate([unpack(a, kind) for a in answers])
        out = np.empty_like(x)
        out[self.order] = x
        return out


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, list[slice]]:
    """(buckets, the slice of each) of sorted keys: a bucket is a key's first ``bits`` bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[at], [slice(x, y) for x, y in zip(at, [*at[1:], len(keys)], strict=True)]


def asked(table: DataFrame, bits: int) -> DataFrame:
    """(kind, bucket, block, keys, counts): the distinct words and bigrams of a block with their training counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            b = Block(row)
            own = b.train[b.doc]
            yield rows(b, WORDS, b.words[b.order], np.bincount(b.w, own, minlength=len(b.words))[b.order])
            g, _, of = b.grams()
            yield rows(b, BIGRAMS, g, np.bincount(of, own, minlength=len(g)))

    def rows(b: Block, kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        counts = counts.astype(np.uint32)
        buckets, parts = cut(keys, bits)
        return pa.RecordBatch.from_pydict({
            "kind": np.full(len(parts), kind, np.int32), "bucket": buckets, "block": np.full(len(parts), b.block),
            "keys": pa.array([pack_keys(keys[x]) for x in parts], pa.binary()), "counts": pa.array([pack(counts[x]) for x in parts], pa.binary()),
        })

    schema = "kind int, bucket int, block long, keys binary, counts binary"
    return table.select("block", "train", "n", "words", "stream").mapInArrow(run, schema)


def answered(requests: DataFrame) -> DataFrame:
    """(kind, block, bucket, answer, r): twice the corpus count of each key asked for, plus 1 for the block that owns it.

    r: of the owned keys their number, the sum of their counts, and how many have the counts 1, 2, .. MAX_R + 1.
    """

    def run(t: pa.Table) -> pa.Table:
        parts = [unpack_keys(x.as_py()) for x in t["keys"]]
        c = np.concatenate([unpack(x.as_py(), np.uint32) for x in t["counts"]]).astype(np.float64)
        of = np.unique(np.concatenate(parts), return_inverse=True)[1]
        total = np.bincount(of, c).astype(np.int64)
        has = np.flatnonzero(c)
        own = np.zeros(len(of), np.int64)
        own[has[np.unique(of[has], return_index=True)[1]]] = 1
        answer, ends = 2 * total[of] + own, np.cumsum([len(p) for p in parts])
        answers = [answer[e - len(p) : e] for e, p in zip(ends, parts, strict=True)]
        r = []
        for a in answers:
            owned = a[a % 2 == 1] // 2
            r.append([len(owned), int(owned.sum()), *np.bincount(np.minimum(owned, MAX_R + 2), minlength=MAX_R + 3)[1 : MAX_R + 2].tolist()])
        return pa.table({
            "kind": t["kind"], "block": t["block"], "bucket": t["bucket"],
            "answer": pa.array([pack(a) for a in answers], pa.binary()), "r": pa.array(r, pa.list_(pa.int64())),
        })

    return requests.groupBy("kind", "bucket").applyInArrow(run, "kind int, block long, bucket int, answer binary, r array<long>")


def discounts(count_of_counts: dict[int, int]) -> list[float]:
    """d(1) .. d(MAX_R) by Katz's Good-Turing formula; where the counts are too thin for it, (r - 0.5) / r."""
    n = lambda r: count_of_counts.get(r, 0)
    cut = (MAX_R + 1) * n(MAX_R + 1) / n(1) if n(1) else 1.0
    out = []
    for r in range(1, MAX_R + 1):
        d = ((r + 1) * n(r + 1) / (r * n(r)) - cut) / (1 - cut) if n(r) and cut < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    """d(c) * c"""
    low = np.array([0.0, *[r * f for r, f in enumerate(d, 1)]])
    return np.where(c <= MAX_R, low[np.minimum(c, MAX_R).astype(np.int64)], c)


def gathered(answers: DataFrame, name: str, *columns: str) -> DataFrame:
    """(block, ``name``): the answers of a block as structs of ``columns``, by bucket; as many as there are buckets."""
    got = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", *columns))).alias(name))
    return got.withColumnRenamed("block", "of_" + name)


def with_answers(table: DataFrame, *answers: DataFrame) -> DataFrame:
    for a in answers:
        table = table.join(a, table["block"] == a[a.columns[0]]).drop(a.columns[0])
    return table


def counts_of(answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(count, owned) of a block's distinct bigrams in the order of :meth:`Block.grams`."""
    x = np.concatenate([unpack(a["answer"]) for a in answers])
    return x >> 1, (x & 1).astype(bool)


def history_sums(joined: DataFrame, bits: int, d1: list[float], d2: list[float], mass: float) -> DataFrame:
    """(bucket, block, keys, sums): for each word of a block the sums of counts, discounted counts and unigram probabilities over its owned bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            b = Block(row)
            at = b.grams()[1]
            c, owned = counts_of(row["a2"])
            c1 = b.by_word([a["answer"] for a in row["a1"]]) >> 1
            at, c = at[owned], c[owned]
            h, p1 = b.h[at], discounted(c1[b.w[at]], d1) / mass
            sums = [np.bincount(h, x, minlength=len(b.words)).astype(np.float64)[b.order] for x in (c, discounted(c, d2), p1)]
            keys = b.words[b.order]
            buckets, parts = cut(keys, bits)
            yield pa.RecordBatch.from_pydict({
                "bucket": buckets, "block": np.full(len(parts), b.block), "keys": pa.array([pack_keys(keys[x]) for x in parts], pa.binary()),
                "sums": pa.array([pack(np.concatenate([y[x] for y in sums])) for x in parts], pa.binary()),
            })

    return joined.mapInArrow(run, "bucket int, block long, keys binary, sums binary")


def histories(sums: DataFrame) -> DataFrame:
    """(block, bucket, den, alpha) of the words asked for; a history never seen has den 0 and alpha 1."""

    def run(t: pa.Table) -> pa.Table:
        parts = [unpack_keys(x.as_py()) for x in t["keys"]]
        got = np.concatenate([unpack(x.as_py(), np.float64).reshape(3, -1) for x in t["sums"]], axis=1)
        keys, of = np.unique(np.concatenate(parts), return_inverse=True)
        ch, s, u = (np.bincount(of, x, minlength=len(keys)) for x in got)
        whole = s > ch - 1e-9  # nothing is discounted: one count in ch + 1 is set aside
        den = np.where(ch > 0, ch + whole, 0)
        alpha = np.where(ch > 0, np.where(whole, 1 / (ch + 1), 1 - s / np.maximum(ch, 1)) / (1 - u), 1.0)
        ends = np.cumsum([len(p) for p in parts])
        cuts = [of[e - len(p) : e] for e, p in zip(ends, parts, strict=True)]
        return pa.table({
            "block": t["block"], "bucket": t["bucket"],
            "den": pa.array([pack(den[x]) for x in cuts], pa.binary()), "alpha": pa.array([pack(alpha[x]) for x in cuts], pa.binary()),
        })

    return sums.groupBy("bucket").applyInArrow(run, "block long, bucket int, den binary, alpha binary")


def document_sums(joined: DataFrame, d1: list[float], d2: list[float], mass: float, free: float, base: float) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, score of every document of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(rows_of([batch])):
                yield one(row, batch["ids"].slice(i, 1).flatten())

    def one(row: dict, ids: pa.Array) -> pa.RecordBatch:
        b = Block(row)
        of = b.grams()[2]
        c = counts_of(row["a2"])[0][of]
        c1 = b.by_word([a["answer"] for a in row["a1"]]) >> 1
        den, alpha = (b.by_word([a[k] for a in row["ah"]], np.float64) for k in ("den", "alpha"))
        known = c1[b.w] > 0
        p1 = np.where(known, (discounted(c1, d1) / mass)[b.w], free)
        p = np.where(c > 0, discounted(c, d2) / np.maximum(den[b.h], 1), alpha[b.h] * p1)
        by_doc = lambda x: np.bincount(b.doc, x, minlength=len(b.n))
        return pa.RecordBatch.from_pydict({
            "doc_id": ids, "train": b.train, "n_tokens": b.n + 1, "n_known": by_doc(known).astype(np.int64),
            "base_score": by_doc(np.log10((c1 + 0.5) / base)[b.w]), "score": by_doc(np.log10(p)),
        })

    return joined.mapInArrow(run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")


def katz_scores(docs: DataFrame, train: Column, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out (not ``train``), n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    A null or empty text is one end token.  Null ids pass through; rows that repeat id or text are
    scored each and count as often as they occur.  Without training tokens every word is unknown:
    base and score are those of one type.  Extra columns are ignored; an empty table gives an
    empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "katz")
    train = F.coalesce(train, F.lit(False)).alias("train")
    table = scratch.write(blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), train, text_of("text").alias("text_"))))
    n_all = table.agg(F.sum(F.expr("aggregate(n, 0L, (s, x) -> s + x + 1)"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, n_all / BUCKET_TOKENS))))

    answers = scratch.write(answered(asked(table, bits)), batch=BATCH)
    figures = answers.groupBy("kind").agg(F.array(*[F.sum(F.col("r")[i]) for i in range(MAX_R + 3)]).alias("r")).collect()
    figures = {f.kind: f.r for f in figures}
    types, total, *ones = figures.get(WORDS, [0] * (MAX_R + 3))
    d1, d2 = (discounts(dict(enumerate(x, 1))) for x in (ones, figures.get(BIGRAMS, [0] * (MAX_R + 3))[2:]))
    freed = sum((1 - d) * r * k for r, (d, k) in enumerate(zip(d1, ones, strict=False), 1))
    mass = max(1, total)
    free = freed / mass if total else 1.0
    if free < 1e-12:  # no count is small enough to be discounted
        free, mass = 1 / (total + 1), total + 1

    own = [gathered(answers.where(F.col("kind") == k), f"a{k}", "answer") for k in (WORDS, BIGRAMS)]
    sums = history_sums(with_answers(table.drop("ids"), *own), bits, d1, d2, mass)
    history = scratch.write(histories(sums), batch=BATCH)
    joined = with_answers(table, *own, gathered(history, "ah", "den", "alpha"))
    scores = document_sums(joined, d1, d2, mass, free, total + 0.5 * (types + 1))
    scores = scratch.write(scores, table, answers, history, batch=BATCH)
    return scores.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
    )


def lm_scores(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Scores by a model of the documents whose crc32(doc_id as text) mod ``folds`` is not 1."""
    return katz_scores(docs, crc_mod("doc_id", folds) != 1)
