"""What the corpus operators share: scratch tables, paths and joins that stand hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.workers import shared_dir, ship

#: A key is hot from this share of the rows on, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001
HOT_LEAST = 500
#: Whether a query's shuffle files are removed when it ends, and not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; Hadoop deletes it when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, drop: Iterable[DataFrame] = ()) -> DataFrame:
    """df written as Parquet below the shared folder and reread: lineage is cut, and a lost executor loses nothing.

    Its shuffle files go as soon as it is written, and so do the scratch tables in ``drop``, which nothing may read any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with settings(spark, {_CLEANUP: "true"}):
        df.write.parquet(path)
    discard(*drop)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() gave and that nothing reads any more."""
    for t in tables:
        p = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._scratch)
        p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def lookup_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: list[str]) -> DataFrame:
    """Left join of rows with groups, which has one row per key and the number of its rows in column size.

    Keys with at least HOT_SHARE of the total rows (so at most 1 / HOT_SHARE keys, whatever the data) are broadcast;
    their rows take no part in the shuffle by key, but are dealt by a hash of the columns in spread.
    """
    values = [c for c in groups.columns if c != key]
    floor = max(HOT_LEAST, int(total * HOT_SHARE))
    hot = groups.where(F.col(size) >= floor).select(F.col(key), F.struct(*values).alias("_hot"))
    cold = groups.where(F.col(size) < floor).select(F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold"))
    out = rows.join(F.broadcast(hot), key, "left")
    kind, dealt = dict(rows.dtypes)[key], F.xxhash64(F.col(key), *spread)
    dealt = {"bigint": dealt, "binary": F.unhex(F.hex(dealt))}.get(kind, dealt.cast("string"))
    out = out.withColumn("_at", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(dealt))
    out = out.join(cold, (F.col("_at") == F.col("_cold_key")) & F.col("_hot").isNull(), "left")
    out = out.withColumn("_got", F.coalesce("_hot", "_cold"))
    return out.select(*rows.columns, *[F.col(f"_got.{v}").alias(v) for v in values])


def trim_memory() -> None:
    """Hands what a Python worker no longer uses back to the system, since workers live on after their task."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
