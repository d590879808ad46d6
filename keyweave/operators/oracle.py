"""The oracle fuzzy join: thirteen tokenisers, four distances and ten thresholds over the same nearest pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.functions.tokens import GRID_DISTANCES, GRID_TOKENISERS, distance, tokenise

THRESHOLDS = tuple(i / 10 for i in range(1, 11))


def nearest_values(source: DataFrame, target: DataFrame, tokenisers: tuple[str, ...] = GRID_TOKENISERS, distances: tuple[str, ...] = GRID_DISTANCES) -> DataFrame:
    """value, tok, dist, tgt_rid, d: the nearest target row of each distinct source value under each setting, the first among equals.

    A source value that shares no token with any is at distance 1 from the first target row. source and target: (_rid, value).
    Distinct values are compared, each with the first row that has it.
    """
    toks = F.array(*[F.struct(F.lit(k).alias("tok"), tokenise(F.col("value"), k).alias("set")) for k in tokenisers])
    once = lambda df: df.where(F.col("value").isNotNull()).groupBy("value").agg(F.min("_rid").alias("_rid"))
    side = lambda df: once(df).select("_rid", F.explode(toks).alias("_x")).select("_rid", "_x.tok", F.size("_x.set").alias("size"), F.explode_outer("_x.set").alias("token"))
    s, t = side(source), side(target)
    a = s.select("tok", "token", F.col("_rid").alias("first"), F.col("size").alias("na"))
    b = t.select("tok", "token", F.col("_rid").alias("tgt_rid"), F.col("size").alias("nb"))
    met = a.where(F.col("token").isNotNull()).join(b, ["tok", "token"]).groupBy("tok", "first", "tgt_rid").agg(F.count("*").alias("i"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    empty = a.where(F.col("na") == 0).join(b.where(F.col("nb") == 0).groupBy("tok").agg(F.min("tgt_rid").alias("tgt_rid")), "tok").select("tok", "first", "tgt_rid", F.lit(0).cast("long").alias("i"), F.lit(0).alias("na"), F.lit(0).alias("nb"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("dist"), distance(n, F.col("i"), F.col("na"), F.col("nb")).alias("d")) for n in distances]))
    found = met.unionByName(empty).select("tok", "first", "tgt_rid", each.alias("_e")).select("tok", "first", "tgt_rid", "_e.*")
    best = found.groupBy("tok", "dist", "first").agg(F.min(F.struct("d", "tgt_rid")).alias("_b")).select("tok", "dist", "first", "_b.d", "_b.tgt_rid")
    settings = F.explode(F.array(*[F.struct(F.lit(k).alias("tok"), F.lit(n).alias("dist")) for k in tokenisers for n in distances]))
    far = target.where(F.col("value").isNotNull()).agg(F.min("_rid").alias("far")).where(F.col("far").isNotNull())
    firsts = once(source).withColumnRenamed("_rid", "first")
    asked = firsts.select("value", "first", settings.alias("_e")).select("value", "first", "_e.*").join(best, ["tok", "dist", "first"], "left").crossJoin(F.broadcast(far))
    # at distance 1 the first target row of all comes before the others
    beyond = F.coalesce(F.col("d") >= 1, F.lit(True))
    return asked.select("value", "tok", "dist", F.when(beyond, F.col("far")).otherwise(F.col("tgt_rid")).alias("tgt_rid"), F.when(beyond, 1.0).otherwise(F.col("d")).alias("d"))


def nearest_rows(source: DataFrame, target: DataFrame, tokenisers: tuple[str, ...] = GRID_TOKENISERS, distances: tuple[str, ...] = GRID_DISTANCES) -> DataFrame:
    """tok, dist, src_rid, tgt_rid, d: the same for source rows, which get what their value got."""
    asked = nearest_values(source, target, tokenisers, distances)
    return source.select(F.col("_rid").alias("src_rid"), "value").join(asked, "value").select("tok", "dist", "src_rid", "tgt_rid", "d")


def cutoff(dist: F.Column, threshold: F.Column) -> F.Column:
    return F.when(dist == "INTERSECT", 1 / (1 + F.round(threshold * 10)) + 1e-12).otherwise(threshold)


def pairs_at(nearest: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """tok, dist, threshold, src_rid, tgt_rid of the pairs within every threshold; the distances are worked out once."""
    each = nearest.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return each.where(F.col("d") <= cutoff(F.col("dist"), F.col("threshold"))).drop("d")


def best_setting(source: DataFrame, target: DataFrame, truth: DataFrame, tokenisers: tuple[str, ...] = GRID_TOKENISERS, distances: tuple[str, ...] = GRID_DISTANCES) -> DataFrame:
    """tok, dist, threshold and f of the setting with the largest F-score against truth (src_rid, tgt_rid); the first of the grid among equals.

    Rows and true pairs are counted by value first, so that no row is taken through all settings.
    """
    true = truth.distinct()
    total = true.count()
    rows = source.where(F.col("value").isNotNull())
    held = rows.groupBy("value").agg(F.count("*").alias("_n"))
    # by merging: ids compress so well that Spark would send these rows through the driver
    right = true.join(rows.select(F.col("_rid").alias("src_rid"), "value").hint("merge"), "src_rid").groupBy("value", "tgt_rid").agg(F.count("*").alias("_tp"))
    near = nearest_values(source, target, tokenisers, distances).join(held, "value").join(right, ["value", "tgt_rid"], "left")
    by = pairs_at(near.groupBy("tok", "dist", "d").agg(F.sum("_n").alias("_n"), F.sum(F.coalesce("_tp", F.lit(0))).alias("_tp"))).groupBy("tok", "dist", "threshold").agg(F.sum("_n").alias("_n"), F.sum("_tp").alias("_tp"))
    f = F.when(F.col("_n") + total > 0, 2 * F.col("_tp") / (F.col("_n") + total)).otherwise(0.0)
    place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    return by.withColumn("f", f).orderBy(F.desc("f"), place(tokenisers, "tok"), place(distances, "dist"), "threshold").limit(1).select("tok", "dist", "threshold", "f")
