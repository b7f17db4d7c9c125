"""Near-duplicates by a MinHash LSH forest, every link confirmed on full shingle sets.

1. Each text becomes the set of its word shingles.  Documents with equal sets form one class at once
   (one aggregation), so copies cost nothing later.
2. Each class gets TREES labels of DEPTH MinHash values.  A tree is the order of the classes by their
   label; classes that share a prefix are neighbours there.  Regions start at the prefix length
   FIRST; a region with more than REGION classes is split by one more value, up to DEPTH.
   A region that is dense even then is cut into bands of set sizes; similar sets share a band.
3. The classes of a small region are compared with its first; then those of different components with
   each other.  A region that stays dense is compared with a pivot, the member closest to the
   consensus of the lowest bits of the region's MinHash values; as long as members lie outside the region's largest
   component, a new pivot is taken from them, and in the end each of those that are left is
   compared with every member of another component.  A pair may only be left out where both
   sides are already known to be connected, so no link between components is lost.
4. Links (100 * |A & B| >= threshold * |A | B|) become connected components by alternating large and
   small stars, written to shared storage in each round.

A pair is looked at in full only if the sizes of its sets allow the similarity and the lowest bits of
its MinHash values disagree in no more places than six standard deviations above the mean for a
pair at the threshold (a chance under 1e-7 to lose such a pair).

Chance of missing a pair at the threshold in all trees: (1 - 0.85**3)**20 = 5e-9, and at the full depth
of a dense region (1 - 0.85**5)**20 = 8e-6; at a threshold of 0.8
(1 - 0.8**3)**20 = 6e-7 and (1 - 0.8**5)**20 = 4e-4.  Work and shuffled rows grow with the number of classes times TREES.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of
from .graph import components

TREES, DEPTH, FIRST = 20, 5, 3
REGION = 16
SAMPLE = 256
BLOCK = 128
PIVOT_ROUNDS = 3
CACHE = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = x = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return x


def shingle_set(text: str, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z is lower-cased, words end at ASCII white space."""
    if len(words) > CACHE:
        words.clear()
    w = np.array([words[x] for x in text.encode().lower().split()], np.uint64)
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, min(len(w), size), np.uint64)
        for i in range(min(len(w), size)):
            h = (h ^ w[i : i + n]) * MIX
            h ^= h >> np.uint64(29)
    return np.unique(h)


def _constants() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, (TREES * DEPTH, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values of 32 bits, big-endian so that bytes sort like numbers."""
    low = None
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            part = (odd * shingles[None, at : at + 4096]).min(axis=1)
            low = part if low is None else np.minimum(low, part)
    # of a minimum over many values the upper bits are all small; mixing makes every bit tell
    with np.errstate(over="ignore"):
        return ((low * MIX) >> np.uint64(32)).astype(">u4")


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, digest (of the whole set), signature, s1 and s2 (its lowest bits); n is 0 and the rest null without words."""

    def lowest(sig: np.ndarray) -> np.ndarray:
        bits = np.zeros(128, np.uint8)
        bits[: len(sig)] = sig & 1
        return np.packbits(bits).view(np.int64)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, odd = WordHashes(), _constants()
        for batch in batches:
            rows = []
            for text in batch:
                s = shingle_set(text.as_py(), size, words)
                g = signature(s, odd) if len(s) else None
                s1, s2 = (0, 0) if g is None else lowest(g)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                rows.append((len(s), digest, None if g is None else g.tobytes(), s1, s2))
            kinds = {"n": pa.int64(), "digest": pa.binary(), "signature": pa.binary(), "s1": pa.int64(), "s2": pa.int64()}
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    signed = F.arrow_udf(run, "struct<n:long,digest:binary,signature:binary,s1:long,s2:long>")
    return docs.select("doc_id", signed("text_").alias("r")).select("doc_id", "r.*")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, shingles array<long> of the rows of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "shingles": [shingle_set(t, size, words).astype(np.int64) for t in pdf["text_"]]})

    return docs.mapInPandas(run, "doc_id long, shingles array<long>")


def near_dedup(docs: DataFrame, shingle: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    ``threshold`` is the Jaccard similarity in percent.  component_id is the smallest doc_id that
    is reachable over links.  Null and empty texts have the empty set and are linked with nothing,
    as are rows with a null id; texts of fewer words than ``shingle`` are one shingle.  Rows that
    repeat an id are linked each.  Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text_"))
    sig = scratch.write(signatures(docs, shingle))
    full = sig.where("n > 0 AND doc_id IS NOT NULL")
    classes = scratch.write(full.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "signature", "s1", "s2")).alias("r")).select("digest", "r.*"))
    sig = scratch.write(sig.select("doc_id", "n", "digest"), sig)  # signatures go as soon as nothing needs them
    reps = classes.select(F.col("doc_id").alias("rep"), "n", "signature", "s1", "s2")
    agree = (1 + threshold / 100) / 2
    far = math.ceil(TREES * DEPTH * (1 - agree) + 6 * math.sqrt(TREES * DEPTH * agree * (1 - agree)))
    #: whether members x and y may reach the threshold
    may = f"100 * least(x.n, y.n) >= {threshold} * greatest(x.n, y.n) AND bit_count(x.s1 ^ y.s1) + bit_count(x.s2 ^ y.s2) <= {far}"

    # regions: (tree, prefix), deeper where dense
    width = 4 * DEPTH
    member = ["rep", "n", "s1", "s2"]
    labels = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("signature", t * width + 1, F.lit(width)))
    entries = reps.select(*member, F.posexplode(labels).alias("tree", "label"))

    def regions(keyed: DataFrame, *more: str) -> DataFrame:
        size = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        return scratch.write(keyed.join(size, "cell").select("cell", *member, *more, "m"))

    cells, kept_regions, live = [], [], entries
    for depth in range(FIRST, DEPTH + 1):
        prefix = F.concat(F.chr(F.col("tree") + 65).cast("binary"), F.substring("label", 1, 4 * depth))
        held = regions(live.withColumn("cell", prefix), "tree", "label")
        kept_regions.append(held)
        cells.append(held.where(F.col("m") <= REGION).select("cell", *member))
        live = held.where(F.col("m") > REGION).drop("m", "cell")
        if live.isEmpty():
            break
    dense = scratch.write(held.where(F.col("m") > REGION).select("cell", *member))
    crowded = not dense.isEmpty()
    if crowded:
        band = F.floor(F.log("n") / -math.log(threshold / 100) + 1e-9)
        banded = dense.withColumn("band", F.explode(F.array(band, band - 1)))
        held = regions(banded.withColumn("cell", F.concat("cell", F.lit("/").cast("binary"), F.col("band").cast("string").cast("binary"))))
        kept_regions.append(held)
        cells.append(held.where(F.col("m") <= REGION).select("cell", *member))
        dense = scratch.write(held.where(F.col("m") > REGION).select("cell", *member), dense)
        crowded = not dense.isEmpty()
    small = cells[0]
    for c in cells[1:]:
        small = small.unionByName(c)
    small = scratch.write(small, *kept_regions)
    classes = scratch.write(classes.select("digest", "doc_id"), classes)
    met = small.groupBy("cell").agg(F.collect_list(F.struct(*member)).alias("g")).withColumn("x", F.array_min("g"))
    star = f"transform(filter(g, y -> y.rep > x.rep AND {may}), y -> struct(x.rep AS a, y.rep AS b))"
    pairs = scratch.write(met.select(F.expr(f"inline({star})")).distinct())

    wanted = small.unionByName(dense).select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(wanted, "doc_id")
    sets = scratch.write(shingle_sets(texts, shingle))

    def verify(candidates: DataFrame) -> DataFrame:
        a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - F.col("both")
        joined = candidates.join(a, "a").join(b, "b").withColumn("both", both)
        return joined.where(100 * F.col("both") >= threshold * union).select("a", "b").distinct()

    def against_pivot(members: DataFrame, free: DataFrame) -> DataFrame:
        """Pairs of every member with the pivot of its region, taken among ``free``."""
        order = Window.partitionBy("cell").orderBy(F.xxhash64("rep"), "rep")
        sample = free.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE).select("cell", "s1", "s2")

        def consensus(pdf: pd.DataFrame) -> pd.DataFrame:
            most = [np.unpackbits(pdf[c].to_numpy().view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0) > 0.5 for c in ("s1", "s2")]
            m1, m2 = (np.packbits(x).view(np.int64)[0] for x in most)
            return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "m1": [m1], "m2": [m2]})

        modes = sample.groupBy("cell").applyInPandas(consensus, "cell binary, m1 long, m2 long")
        differ = F.bit_count(F.col("s1").bitwiseXOR(F.col("m1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("m2")))
        close = free.join(modes, "cell").select("cell", *member, (-differ).alias("same"))
        pivot = close.groupBy("cell").agg(F.max(F.struct("same", *member)).alias("y"))
        met = members.select("cell", F.struct(*member).alias("x")).join(pivot, "cell").where(f"x.rep <> y.rep AND {may}")
        return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()

    def across(free: DataFrame, placed: DataFrame) -> DataFrame:
        """Links between free members and members of other components of their region.

        Members meet in blocks, so a row holds two bounded lists of sets, and only links leave it.
        """
        placed = placed.join(free.select("cell").distinct(), "cell", "left_semi")
        size = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))

        def blocks(d: DataFrame, name: str) -> DataFrame:
            full_sets = d.select("cell", "rep", "c").join(sets.withColumnRenamed("doc_id", "rep"), "rep").join(size, "cell")
            part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / BLOCK))
            return full_sets.groupBy("cell", part.alias(name + "_part")).agg(F.collect_list(F.struct("rep", "c", "shingles")).alias(name))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                a, b = [], []
                for xs, ys in zip(pdf["x"], pdf["y"], strict=True):
                    lens = np.array([len(y["shingles"]) for y in ys])
                    flat, starts = np.concatenate([y["shingles"] for y in ys]), np.cumsum(lens) - lens
                    reps, cs = np.array([y["rep"] for y in ys]), np.array([y["c"] for y in ys])
                    for x in xs:
                        own = np.sort(np.asarray(x["shingles"]))
                        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                        both = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
                        hit = (100 * both >= threshold * (len(own) + lens - both)) & (cs != x["c"])
                        a += np.minimum(reps[hit], x["rep"]).tolist()
                        b += np.maximum(reps[hit], x["rep"]).tolist()
                yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

        met = blocks(free, "x").join(blocks(placed, "y"), "cell").select("x", "y")
        return met.mapInPandas(run, "a long, b long").distinct()

    def placed_in(members: DataFrame) -> DataFrame:
        return members.join(comp.withColumnRenamed("v", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")

    def grown(more: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = scratch.write(links.unionByName(more).distinct(), links)
        return both, scratch.write(components(both, scratch), comp)

    first = pairs.unionByName(against_pivot(dense, dense)).distinct() if crowded else pairs
    links = scratch.write(verify(first), pairs)
    comp = scratch.write(components(links, scratch))
    apart = placed_in(small).groupBy("cell").agg(F.collect_list(F.struct(*member, "c")).alias("g"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    inner = f"transform(filter(g, y -> y.rep > x.rep AND y.c <> x.c AND {may}), y -> struct(x.rep AS a, y.rep AS b))"
    rest = apart.where("lo < hi").select(F.expr(f"inline(flatten(transform(g, x -> {inner})))")).distinct()
    links, comp = grown(verify(rest))
    scratch.drop(small)
    for turn in range(PIVOT_ROUNDS if crowded else 0):
        placed = placed_in(dense)
        main = placed.groupBy("cell", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("cell").agg(F.max_by("c", F.struct("k", "c")).alias("main"))
        free = scratch.write(placed.join(main, "cell").where("c <> main").select("cell", *member, "c"))
        if free.isEmpty():
            break
        more = verify(against_pivot(dense, free)) if turn < PIVOT_ROUNDS - 1 else across(free, placed)
        links, comp = grown(more)
        scratch.drop(free)
    scratch.drop(dense, sets, links)

    of = classes.select(F.col("digest").alias("of"), F.col("doc_id").alias("v")).join(comp, "v", "left")
    of = of.select("of", F.coalesce("component", "v").alias("component_id"))
    return (
        sig.join(of, F.col("doc_id").isNotNull() & (F.col("digest") == F.col("of")), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
