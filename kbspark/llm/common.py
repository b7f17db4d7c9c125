"""Shared helpers of the training-data operators: scratch tables and column guards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Intermediate tables in the folder that all executors share.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset, a session in one
    process (``local[n]``, as in tests) uses a temporary folder; any other session is told to
    set it.  A table that has been written cuts the lineage, survives lost executors, and gives
    later plans exact sizes; the shuffle files that it took go when it is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="kbspark-")
        self.spark, self.root, self.n = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, *drop: DataFrame | None, batch: int | None = None) -> DataFrame:
        """Write ``df`` and return it as read back.

        ``drop``: tables that nothing else reads after this; ``batch``: rows sent to Python at once, for large rows.
        """
        path = f"{self.root}/{self.n}"
        self.n += 1
        wanted = {CLEANUP: "true"} | ({BATCH_ROWS: str(batch)} if batch else {})
        before = {k: self.spark.conf.get(k, None) for k in wanted}
        for k, v in wanted.items():
            self.spark.conf.set(k, v)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        for table in drop:
            self.drop(table)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that ``write`` returned and no later plan reads."""
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def text_of(name: str) -> Column:
    """The text column as a string, null counting as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(name: str, m: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``m``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % F.lit(m)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` bears it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
