"""Exact duplicates by distributed MSD radix partitioning.

Texts are split by their byte length and then by successive runs of bytes.  A group that is a
singleton leaves at once; a group whose bytes have ended holds equal texts.  Only rows of groups
that can still be split are carried on, each round with fewer bytes left, so a corpus without
copies costs one pass over short prefixes.  Equality never rests on a digest: the groups are
formed by the bytes themselves.

Scale: every round is one aggregation with map-side combine (a group of copies that holds a third
of all rows arrives as one row per task) and one shuffle join back, which adaptive execution may
split where a group is hot.  The width of a round grows sixteenfold, so texts of n bytes end after
O(log n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

FIRST_BYTES = 64
GROWTH = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.  A null text counts as empty; a null id is
    a value of its own and never preferred.  Rows that repeat both id and text count in
    ``group_size`` and get the same answer.  Other columns of ``docs`` are ignored, an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    body = text_of(text_col).cast("binary")
    base = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.sha2(body, 256).alias("sha"),  # an output column and, with the id, the name of a row
        body.alias("rest"),
    )
    # Round 1 looks at prefixes only; texts travel only for rows whose prefix is shared.
    state = base.select("id", F.unhex("sha").alias("row"), F.octet_length("rest").alias("len"), "rest",
                        F.lit(None).cast("binary").alias("gid"))
    width, done, rounds = FIRST_BYTES, 0, []
    while True:
        chunk = F.substring("rest", 1, width)
        keyed = state.withColumn("chunk", chunk)
        key = ["len", "chunk"] if not rounds else ["gid", "len", "chunk"]
        groups = (
            keyed.groupBy(*key)
            .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"), F.min("row").alias("ng"))
            .where("n > 1")
        )
        split = keyed.drop("gid") if not rounds else keyed
        done += width
        joined = scratch.write(
            split.join(groups, key).select(
                "id", "row", "len", "keep", "n", F.col("ng").alias("gid"),
                F.expr(f"substring(rest, {width + 1})").alias("rest"),
            )
        )
        rounds.append(joined.where(F.col("len") <= done).select("id", "row", "keep", "n"))
        state = joined.where(F.col("len") > done).select("id", "row", "len", "rest", "gid")
        if state.isEmpty():
            break
        width *= GROWTH
    found = rounds[0]
    for r in rounds[1:]:
        found = found.unionByName(r)
    found = found.distinct().withColumnRenamed("id", "fid").withColumn("sha_", F.lower(F.hex("row")))
    rows = base.select("id", "sha")
    return rows.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("sha") == F.col("sha_")), "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("n").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
