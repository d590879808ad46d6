"""A learned program on a stream: a stateless join of arriving rows with a static target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.operators.equijoin import unique_keys
from keyweave.plans.program import Program


def join_stream(rows: DataFrame, program: Program, columns: list[str], target: DataFrame) -> DataFrame:
    """rows with the tgt_rid of the one target row (_rid, value) whose value is the key that the program derives from the columns."""
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    keyed = rows.withColumn("value", program.to_column(cells)).where(F.col("value").isNotNull())
    return keyed.join(unique_keys(target), "value").drop("value")
