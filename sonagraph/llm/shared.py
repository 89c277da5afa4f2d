"""Session helpers of the text operators: shared scratch tables and defensive column handling."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the ASCII controls tab..carriage return.
WORD_SPLIT = r"[\x20\x09-\x0D]+"

#: Spark drops a query's shuffle files when the query ends, not when the driver collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What one Arrow batch may hold: texts differ a thousandfold in length, so rows don't bound it.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.  Where that is unset, one below the
    warehouse, which the driver and all executors share as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def materialize(df: DataFrame, label: str, *done: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and any executor can
    reread the part of a lost one.  The shuffles behind it go with the write, and so do the scratch
    tables ``done``, which nothing reads any more."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sonagraph/{label}-{uuid.uuid4().hex}"
    with _set(spark, DROP_SHUFFLES, "true"), _set(spark, ARROW_BYTES, "4m"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    discard(*done)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables of ``materialize``."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def docs_of(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so clashing extra columns never reach an operator's internals."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (Spark doesn't tell case apart)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def row_key(*columns: str) -> Column:
    """64-bit identity of a row by content.  Repeated rows share it, and get the same result."""
    return F.xxhash64(*[F.col(c) for c in columns])


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression (a lambda over a one-element array), so that a
    higher-order function in ``body`` doesn't evaluate it again for every element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text column; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), "")
