"""Samples on which pairs are found and programs are learned."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

T, DELTA, R = 4.0, 0.8, 0.1
#: Rows that are put in order together, about.
BUCKET_ROWS = 100_000


def sample_size(own: int, other: int, t: float = T, delta: float = DELTA, r: float = R) -> int:
    """Rows to draw of a table of ``own`` rows that joins one of ``other`` rows; all of them where the rate reaches 1."""
    if not own:
        return 0
    rate = 1 / own * math.sqrt(t * other / ((1 - delta) * r))
    return own if rate >= 1 else math.ceil(own * rate)


def draw(df: DataFrame, size: int, rid: str = "_rid", seed: int = 42) -> DataFrame:
    """``size`` rows with the smallest hashes of their ids: a top-k of each partition, then of those."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(rid).cast("string"), F.lit(str(seed)))), rid).limit(size)


def bucket(value: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending cuts are at most ``value``: a tree of comparisons with constants, the same in every job."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        at = (low + high) // 2
        return F.when(value < F.lit(cuts[at]), tree(low, at)).otherwise(tree(at + 1, high))

    return tree(0, len(cuts))


def interleaved(df: DataFrame, rows: int, share: float = 0.1, least: int = 20, most: int = 400, rid: str = "_rid") -> DataFrame:
    """Every n-th row in order so that ``share`` of the rows, between the two bounds, remain."""
    want = min(rows, max(least, min(most, math.ceil(rows * share))))
    if want >= rows:
        return df
    step = rows / want
    # row numbers of a global order without one task for all rows: counts of ranges first. The cuts are constants, as Spark's own
    # ranges come from a sample that differs from job to job
    n = min(256, rows // BUCKET_ROWS)
    cuts = sorted({int(c) for c in df.stat.approxQuantile(rid, [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    parted = df.withColumn("_part", bucket(F.col(rid), cuts))
    counts = {r["_part"]: r["n"] for r in parted.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(rid)) - 1 + offset
    taken = sorted({int(i * step) for i in range(want)})
    return parted.withColumn("_at", place).where(F.col("_at").isin(taken)).drop("_part", "_at")
