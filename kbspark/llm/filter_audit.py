"""What five document filters remove in every order of application.

A table-driven transducer over UTF-8 bytes runs once over whole texts: its state is whether the last byte belonged to a word, and a
table of (state, byte) gives what that byte emits: the begin or the end of a word, a code point, a capital, a symbol.  As the next
state depends on the byte alone, whole columns of texts are run at once.  The spans of words that it emits go into a hash
table, one per text, in which an entry is accepted only after its bytes have been compared.

A document is then five bits (which filters it fails), and every figure of every order is a sum over the 32 kinds of documents of a
part.  Identity of texts is by SHA-256 and byte length; the first id of each group of copies comes from an aggregation
with map-side combine, and the documents are matched with it by digest *and* id, so that no group of copies meets in one task.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, b"#$%&*|"
SPACES = b" \t\n\v\f\r"
BLOCK_BYTES = 4 << 20
BEGIN, END, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16
OUT, IN = 0, 1
FIGURES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")
LAST = (1 << 63) - 1  # stands for a null id


def _table() -> tuple[np.ndarray, np.ndarray]:
    """(next state of a byte, what (state, byte) emits)."""
    after = np.array([OUT if b in SPACES else IN for b in range(256)], np.uint8)
    emit = np.zeros((2, 256), np.uint8)
    for b in range(256):
        own = POINT * (b & 0xC0 != 0x80) | CAPITAL * (65 <= b <= 90) | SYMBOL * (b in SYMBOLS)
        emit[OUT, b] = own | BEGIN * (after[b] == IN)
        emit[IN, b] = own | END * (after[b] == OUT)
    return after, emit


NEXT, EMIT = _table()


def transduce(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The figures of the texts data[offsets[i]:offsets[i + 1]] (valid UTF-8), in one pass over the bytes."""
    state = np.empty(len(data), np.uint8)  # before each byte
    state[1:] = NEXT[data[:-1]]
    starts, ends = offsets[:-1], offsets[1:]
    full = np.flatnonzero(ends > starts)
    state[starts[full]] = OUT
    signals = EMIT[state, data]

    def per_text(bit: int) -> np.ndarray:
        n = np.zeros(len(starts), np.int64)
        if len(full):
            n[full] = np.add.reduceat((signals & bit) != 0, starts[full], dtype=np.int64)
        return n

    begin = np.flatnonzero(signals & BEGIN)
    # a word ends where a space follows, or with its text
    open_ = full[NEXT[data[ends[full] - 1]] == IN]
    end = np.sort(np.concatenate([np.flatnonzero(signals & END), ends[open_]]))
    words = per_text(BEGIN)
    body, distinct, at = data.tobytes(), np.zeros(len(starts), np.int64), 0
    spans = list(zip(begin.tolist(), end.tolist(), strict=True))
    for i in np.flatnonzero(words):
        n = int(words[i])
        distinct[i] = len({body[a:b] for a, b in spans[at : at + n]})
        at += n
    return dict(zip(FIGURES, (words, distinct, per_text(CAPITAL), per_text(POINT), per_text(SYMBOL)), strict=True))


def text_figures(text: Column) -> Column:
    """struct of the counts of words, distinct words, capitals, code points and symbols of a text column (null: all 0)."""
    kind = pa.struct([(f, pa.int64()) for f in FIGURES])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = batch.cast(pa.large_binary())
            offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
            data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)
            out, i = [pa.array([], kind)], 0
            while i < len(rows):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
                got = transduce(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out.append(pa.StructArray.from_arrays([pa.array(got[f]) for f in FIGURES], list(FIGURES)).cast(kind))
                i = j
            yield pa.concat_arrays(out)

    return F.arrow_udf(run, ", ".join(f"{f} long" for f in FIGURES))(text)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` and a column ``fails``: bit i is set where the document fails filter i of A, B, C, D, E.

    A: under 200 words; B: under 50 distinct words in a hundred; C: over 3 capitals in a hundred code points; D: any symbol;
    E: the same text as any row of a smaller id.  A null text counts as empty (fails A only, and E if repeated), a null id as the
    largest; rows that repeat the smallest id of their text do not fail E.
    """
    made = [unused(docs, f"{c}_") for c in ("figures", "digest", "bytes", "id", "first")]
    figures, digest, size, key, first = made
    text = text_of(text_col)
    d = docs.withColumns({figures: text_figures(text), digest: F.sha2(text, 256), size: F.octet_length(text), key: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))})
    firsts = d.groupBy(digest, size).agg(F.min(key).alias(key)).withColumn(first, F.lit(True))
    of = lambda f: F.col(f"{figures}.{f}")
    bits = [
        of("n_words") < MIN_WORDS, 100 * of("n_distinct") < DISTINCT_PERCENT * of("n_words"), 100 * of("n_capitals") > CAPITALS_PERCENT * of("n_points"),
        of("n_symbols") > 0, F.col(first).isNull(),
    ]
    fails = sum((F.when(b, F.lit(1 << i)).otherwise(F.lit(0)) for i, b in enumerate(bits)), F.lit(0))
    return d.join(firsts, [digest, size, key], "left").select(*[d[c] for c in docs.columns], fails.alias("fails"))


def _orders() -> Column:
    """All (filter_order, step, own bit, bits before it)."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    rows = [
        {"filter_order": "".join(order), "step": n + 1, "own": bit[f], "before": sum(bit[x] for x in order[:n])}
        for order in itertools.permutations(FILTERS) for n, f in enumerate(order)
    ]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,own:int,before:int>>")


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for every part of ``docs``, every order and step.

    ``docs``: doc_id, text and the part (null counts as an empty string); ``labels``: doc_id, quality, toxic, where a label of 1 in any of several
    rows counts and null is no label.  Null and repeated rows: see :func:`failures`.  Extra columns are ignored; an empty table has no part and gives an empty result.
    """
    seen = docs.select("doc_id", F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col("text").alias("text"))
    kinds = failures(seen).groupBy("doc_id", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    lost = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    kinds = kinds.join(marks, "doc_id", "left").groupBy("part", "fails").agg(F.sum("n").alias("n"), lost("quality"), lost("toxic"))
    # at most 32 kinds a part
    parts = kinds.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "quality", "toxic")).alias("kinds"))
    steps = parts.select("part", "kinds", F.explode(_orders()).alias("o")).select("part", "kinds", "o.*")
    own, before = F.col("own"), F.col("before")

    def total(value: str, where) -> Column:
        return F.aggregate("kinds", F.lit(0).cast("long"), lambda s, k: s + F.when(where(k.fails), k[value]).otherwise(F.lit(0)))

    here = lambda x: (x.bitwiseAND(own) != 0) & (x.bitwiseAND(before) == 0)
    # among the filters that a document fails, each comes first in the same number of orders
    share = F.aggregate("kinds", F.lit(0).cast("long"), lambda s, k: s + F.when(k.fails.bitwiseAND(own) != 0, k.n * (F.lit(120) / F.bit_count(k.fails)).cast("long")).otherwise(F.lit(0)))
    return steps.select(
        "part", "filter_order", "step",
        total("n", lambda x: x.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda x: (x.bitwiseAND(own) != 0) & (x.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda x: x == own).alias("unique_fails"),
        total("quality", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
bits AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS fails FROM words),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
kinds AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM bits LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT filter_order, s.step, bits[s.step] AS own, coalesce(list_sum(bits[1:s.step - 1]), 0)::INT AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s),
figures AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN fails & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails & own <> 0 AND fails & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM kinds, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM figures
"""
