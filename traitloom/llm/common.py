"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule: a word is a maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only in a local session, as in tests, a temporary folder stands in where that is unset; elsewhere each executor
    would write to a folder of its own, so that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='traitloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Paths in the shared folder that are still there, and those of tables that ``materialize`` gave.
_left: set[str] = set()
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/traitloom-{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(remove_rest, spark)
    _left.add(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)
    _left.discard(path)


def remove_rest(spark: SparkSession) -> None:
    try:
        for path in sorted(_left):
            remove(spark, path)
    except Exception:  # noqa: BLE001 - the JVM has gone before
        pass


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this holds, Python tasks get some MB of texts at a time; rows and results are the same."""
    held = {k: spark.conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove what ``materialize`` wrote for these tables, once all that reads them is written itself."""
    for t in tables:
        if path := _paths.pop(t, None):
            remove(t.sparkSession, path)


def words_in(text: Column) -> Column:
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def before(df: DataFrame, group: str, unit: Column, rows: Column, order: list, value: str, out: str, rows_per_bucket: int = 2_000) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``group`` that come earlier in ``order``.

    ``unit`` is a bigint in [0, 2^24), uniform over rows and monotone in ``order``; it cuts a group into
    ceil(``rows`` / ``rows_per_bucket``) ranges, so that no task sorts a whole group. Range totals get a prefix sum of
    their own (one small row a range), which is joined back. ``group`` has no nulls.
    """
    b = df.withColumn("_b", F.floor(unit * F.greatest(F.lit(1), F.ceil(rows / rows_per_bucket)) / F.lit(1 << 24)))
    w = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy(group, "_b").agg(F.sum(value).alias("_t"))
    totals = totals.select(group, "_b", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return b.join(totals, [group, "_b"]).withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_b", "_before")
