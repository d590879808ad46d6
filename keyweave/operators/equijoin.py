"""Joins on derived keys, and the aggregates they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.plans.program import Program

#: A derived key counts for a program's score from this length on.
MIN_KEY = 3
#: Joined rows that a task makes, about.
TASK_ROWS = 500_000


def value_frequency(values: DataFrame, value: str = "value") -> DataFrame:
    return values.groupBy(value).agg(F.count("*").alias("n"))


def first_row_per_value(values: DataFrame, value: str = "value", rid: str = "_rid") -> DataFrame:
    return values.groupBy(value).agg(F.min(rid).alias("first_rid"))


def unique_keys(values: DataFrame, value: str = "value", rid: str = "_rid") -> DataFrame:
    """The values of exactly one row, with that row: one aggregate, whose result the join can reuse as it is partitioned."""
    got = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(rid).alias("tgt_rid"), F.count("*").alias("_n"))
    return got.where(F.col("_n") == 1).drop("_n")


def transformed_equijoin(source: DataFrame, key: Column, target: DataFrame) -> DataFrame:
    """(src_rid, tgt_rid): source rows (_rid, _cells) whose derived key is the value of exactly one target row (_rid, value)."""
    derived = source.select(F.col("_rid").alias("src_rid"), key.alias("value")).where(F.col("value").isNotNull())
    return derived.join(unique_keys(target), "value").select("src_rid", "tgt_rid")


def injective_scores(source: DataFrame, programs: list[tuple[int, Program]], target: DataFrame) -> DataFrame:
    """pid and score: for how many keys of a program exactly one source row and exactly one target row have it.

    target: (tcol, _rid, value). programs: (target column, program) by pid. All programs are scored in one job.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("pid"), F.lit(c).alias("tcol"), p.to_column().alias("value")) for i, (c, p) in enumerate(programs)])
    derived = source.select(F.explode(keys).alias("_k")).select("_k.*").where(F.length("value") >= MIN_KEY)
    once = derived.groupBy("pid", "tcol", "value").agg(F.count("*").alias("_n")).where(F.col("_n") == 1).drop("_n")
    there = target.groupBy("tcol", "value").agg(F.count("*").alias("_m")).where(F.col("_m") == 1).drop("_m")
    return once.join(there, ["tcol", "value"]).groupBy("pid").agg(F.count("*").alias("score"))


def first_match_join(source: DataFrame, key: Column, target: DataFrame) -> DataFrame:
    """(src_rid, tgt_rid): source rows whose derived key is a target value, with the first target row that has it."""
    derived = source.select(F.col("_rid").alias("src_rid"), key.alias("value")).where(F.col("value").isNotNull())
    firsts = target.groupBy("value").agg(F.min("_rid").alias("tgt_rid"))
    return derived.join(firsts, "value").select("src_rid", "tgt_rid")


def many_to_many(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The join of two tables on a key that many rows of both have, in tasks sized by what they make and not by what they read:
    the rows of a key on the left are dealt to several tasks, those on the right go to each."""
    n, m = left.groupBy(key).agg(F.count("*").alias("_n")), right.groupBy(key).agg(F.count("*").alias("_m"))
    made = n.join(m, key).agg(F.sum(F.col("_n") * F.col("_m")).alias("all"), F.max(F.col("_n") * F.col("_m")).alias("most")).first()
    parts = (made["all"] or 0) // TASK_ROWS + 1
    salts = 4 * (made["most"] or 0) // TASK_ROWS + 1
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).repartition(parts, key, "_salt")
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(parts, key, "_salt")
    return a.join(b.hint("merge"), [key, "_salt"]).drop("_salt")
