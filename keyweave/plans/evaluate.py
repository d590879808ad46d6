"""Precision and recall of joined pairs, and aggregates over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyweave.functions.strings import join_cells
from keyweave.operators.equijoin import TASK_ROWS
from keyweave.sources.table import JoinTable

SOURCE_SEPARATOR, TARGET_SEPARATOR = "|", " | "


def fingerprints(pairs: DataFrame, source: JoinTable, target: JoinTable, source_names: list[str], target_names: list[str]) -> DataFrame:
    """Distinct (src_fp, tgt_fp) of pairs (src_rid, tgt_rid)."""
    s = source.df.select(F.col("_rid").alias("src_rid"), join_cells(F.col("_cells"), source.positions(source_names), SOURCE_SEPARATOR).alias("src_fp"))
    t = target.df.select(F.col("_rid").alias("tgt_rid"), join_cells(F.col("_cells"), target.positions(target_names), TARGET_SEPARATOR).alias("tgt_fp"))
    return pairs.join(s, "src_rid").join(t, "tgt_rid").select("src_fp", "tgt_fp").distinct()


def judged(produced: DataFrame, truth: DataFrame) -> DataFrame:
    """src_fp, tgt_fp, expected and ok of every distinct produced pair; truth: (src_fp, tgt_fp) with one target per source."""
    parts = produced.count() // TASK_ROWS + 1  # pairs may be many more than the rows they were made of
    right = truth.select("src_fp", F.col("tgt_fp").alias("expected")).repartition(parts, "src_fp")
    return produced.repartition(parts, "src_fp").distinct().join(right.hint("merge"), "src_fp", "left").withColumn("ok", F.coalesce(F.col("tgt_fp") == F.col("expected"), F.lit(False)))


def scores(produced: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: produced, truths, true_positives, precision, recall and f of distinct pairs."""
    got = judged(produced, truth).agg(F.count("*").alias("produced"), F.sum(F.col("ok").cast("long")).alias("_tp"))
    all_ = truth.distinct().agg(F.count("*").alias("truths"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = got.crossJoin(all_).withColumn("true_positives", F.coalesce("_tp", F.lit(0)))
    out = out.withColumns({"precision": ratio("true_positives", "produced"), "recall": ratio("true_positives", "truths")})
    return out.select("produced", "truths", "true_positives", "precision", "recall", f_score(F.col("precision"), F.col("recall")).alias("f"))


def f_score(p: F.Column, r: F.Column) -> F.Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def mismatches(produced: DataFrame, truth: DataFrame) -> DataFrame:
    return judged(produced, truth).where(~F.col("ok")).select("src_fp", "tgt_fp", "expected")


def method_averages(runs: DataFrame) -> DataFrame:
    """method, precision (over cases with a joined pair), recall (over all cases) and f of the averages; runs: (method, joined, precision, recall)."""
    avg = runs.groupBy("method").agg(F.coalesce(F.avg(F.when(F.col("joined") > 0, F.col("precision"))), F.lit(0.0)).alias("precision"), F.avg("recall").alias("recall"))
    return avg.withColumn("f", f_score(F.col("precision"), F.col("recall")))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run with the largest seq of each (pair_id, method)."""
    order = Window.partitionBy("pair_id", "method").orderBy(F.desc("seq"))
    return runs.withColumn("_k", F.row_number().over(order)).where(F.col("_k") == 1).drop("_k")


def median_times(runs: DataFrame) -> DataFrame:
    """method, size and the ms at half the number of repeats, rounded down, in sorted order."""
    ms = F.sort_array(F.collect_list("ms"))
    return runs.groupBy("method", "size").agg(F.get(ms, F.floor(F.count("*") / 2).cast("int")).alias("ms"))


def totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("runs"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def newest(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("seq")).limit(n)


def worst_first(runs: DataFrame, n: int = 20) -> DataFrame:
    """The n latest runs with the least recall, worst first, with their place from 1."""
    worst = latest_runs(runs).orderBy("recall", "precision", "pair_id", "method").limit(n)
    return worst.withColumn("place", F.row_number().over(Window.orderBy("recall", "precision", "pair_id", "method")))
