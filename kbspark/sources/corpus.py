"""Corpus scan and generation sink."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions.text import basename, file_suffix
from kbspark.operators.chunking import validate_generation
from kbspark.sources.shared import exists

READABLE = {".txt": "text", ".md": "text", ".markdown": "text", ".html": "text", ".htm": "text", ".csv": "text", ".json": "text", ".parquet": "parquet"}


def read_corpus(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Documents under ``path``: whole files of a text suffix as (filename, content), tables for ``.parquet``.

    An unknown suffix is an error.
    """
    kind = READABLE.get(suffix)
    if kind is None:
        raise ValueError(f"no reader for {suffix}")
    if kind == "parquet":
        return spark.read.parquet(path)
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    files = files.select(basename(F.input_file_name()).alias("filename"), F.col("value").alias("content"))
    return files.where(file_suffix(F.col("filename")) == suffix)


def write_generation(chunks: DataFrame, path: str, index_id: str) -> None:
    """Write ``chunks`` as the immutable generation ``index_id``; a retry replaces this generation only."""
    chunks.withColumn("index_id", F.lit(index_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "index_id"
    ).parquet(path)


class GenerationSink:
    """Generations of chunks (doc_id, ...) under one path, of which at most one is active.

    A generation is published in two steps: it is written, then what can be read back of it is counted, and only if every document has as
    many chunks as expected does the pointer move.  The pointer is a table of switches, one small file each, written whole; readers
    take the latest, so they see the old generation until the new one is complete and checked.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def publish(self, chunks: DataFrame, index_id: str, expected: DataFrame) -> DataFrame:
        """Write ``chunks`` as ``index_id`` and make it active if its counts are those of ``expected`` (doc_id, expected).

        Gives the problems (doc_id, expected, stored, problem), none where it became active.  A retry replaces what it
        wrote before; the active generation can't be written again.
        """
        if index_id == self.active():
            raise ValueError(f"{index_id} is active and immutable")
        write_generation(chunks, f"{self.path}/generations", index_id)
        problems = validate_generation(self.read(index_id), expected)
        if problems.isEmpty():
            switch = self.spark.createDataFrame([(time.time_ns(), index_id)], "at long, index_id string")
            switch.coalesce(1).write.mode("append").parquet(f"{self.path}/active")
        return problems

    def active(self) -> str | None:
        if not exists(self.spark, f"{self.path}/active"):
            return None
        last = self.spark.read.parquet(f"{self.path}/active").orderBy(F.desc("at")).first()
        return last and last.index_id

    def read(self, index_id: str | None = None) -> DataFrame:
        """The chunks of a generation, by default the active one."""
        wanted = index_id or self.active()
        if wanted is None:
            raise ValueError("no generation is active")
        return self.spark.read.parquet(f"{self.path}/generations").where(F.col("index_id") == wanted).drop("index_id")
