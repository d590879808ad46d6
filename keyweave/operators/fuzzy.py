"""Fuzzy joins whose distance threshold follows from how many partners a row may have.

Values are compared through their tokens: a pair that shares none is at distance 1, and no threshold reaches 1, so the join on
tokens loses nothing that comparing all pairs would find. Distinct values stand for all their rows, numbers for values.

A threshold lies below the least distance at which some row has a partner too many, so that nothing beyond that distance has to be
found. A few values compared with everything bound it from above, pairs nearer than the bound are found exactly, and the least of
their violating distances is the one sought. To be that near, two values must share so many tokens that those of either's rarest
tokens in common are one, two or three at least (prefix filter); they meet on all sets of so many.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyweave.functions.tokens import JOIN_TOKENISERS, RECOVERY_TOKENISERS, tokenise

#: Values that are compared with all others for a first bound, and values that better it.
PROBES, MORE_PROBES = 32, 4096
#: Pairs of values up to which all are compared.
FEW_PAIRS = 1_000_000
#: Distances up to which nearest values are looked for in turn.
LEVELS = (0.25, 0.5, 0.75, 1.0)
#: Most tokens in a set on which values meet, most sets of a value on average, and how much more than a set a pair costs.
MOST_SHARED, MOST_SETS, PAIR_COST = 3, 1000, 8


def distinct_values(rows: DataFrame) -> DataFrame:
    """value, first (row) and rows of (_rid, value)."""
    return rows.where(F.col("value").isNotNull()).groupBy("value").agg(F.min("_rid").alias("first"), F.count("*").alias("rows"))


def token_distances(source: DataFrame, target: DataFrame, tokeniser: str) -> DataFrame:
    """s, t, s_first, t_first, t_rows, d: Jaccard distances below 1 of distinct values, two blank values being at distance 0."""
    blank = ~F.col("value").rlike(r"[^\s]")
    side = lambda df: df.withColumn("_blank", blank).withColumn("_tok", F.when(blank, F.array(F.lit(""))).otherwise(tokenise(F.col("value"), tokeniser)))
    # blank values have the empty token, which no other value has
    s = side(source).select(F.col("value").alias("s"), F.col("first").alias("s_first"), F.size("_tok").alias("na"), F.explode("_tok").alias("token"))
    t = side(target).select(F.col("value").alias("t"), F.col("first").alias("t_first"), F.col("rows").alias("t_rows"), F.size("_tok").alias("nb"), F.explode("_tok").alias("token"))
    both = s.join(t, "token").groupBy("s", "t").agg(F.count("*").alias("i"), *[F.first(c).alias(c) for c in ("s_first", "t_first", "t_rows", "na", "nb")])
    d = F.when(F.col("s") == F.col("t"), 0.0).otherwise(1 - F.col("i") / (F.col("na") + F.col("nb") - F.col("i")))
    return both.select("s", "t", "s_first", "t_first", "t_rows", d.alias("d")).where(F.col("d") < 1)


def closed_threshold(violating: Column) -> Column:
    """What bisecting [0, 1] ten times for the loosest threshold below the smallest violating distance arrives at."""
    return F.when(violating.isNull(), F.lit(1023 / 1024)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1023.0), F.ceil(violating * 1024) - 1)) / 1024)


def nearest(distances: DataFrame, k: int = 1) -> DataFrame:
    """The k nearest target values of each source value, the first seen among equals."""
    order = Window.partitionBy("s").orderBy("d", "t_first")
    return distances.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def _overlap(x: int, y: int, limit: float, strict: bool) -> int:
    """Tokens that sets of x and y must share for a distance of at most ``limit``, or below it if ``strict``."""
    v = (1 - limit) * (x + y) / (2 - limit)
    return max(1, math.floor(v + 1e-9) + 1 if strict else math.ceil(v - 1e-9))


def _needs(own: Iterable[int], others: Iterable[int], limit: float, strict: bool) -> dict[int, int]:
    """The least overlap that a set of each size needs with a set of any size there is; sizes that nothing can match are left out."""
    out = {x: [o for y in others if (o := _overlap(x, y, limit, strict)) <= min(x, y)] for x in own}
    return {x: min(os) for x, os in out.items() if os}


class Tokens:
    """Distinct values of two tables under a tokeniser, ready to be joined by the rarest of their tokens."""

    def __init__(self, source: DataFrame, target: DataFrame, tokeniser: str) -> None:
        """source and target: what distinct_values() gives."""
        # blank values have the empty token, which no other value has
        blank = ~F.col("value").rlike(r"[^\s]")
        side = lambda df: df.withColumn("tokens", F.when(blank, F.array(F.lit(""))).otherwise(tokenise(F.col("value"), tokeniser)))
        s, t = side(source), side(target)
        spread = lambda df: df.select(F.col("first").alias("id"), F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
        held = lambda df: spread(df).groupBy("token").agg(F.count("*").alias("n"))
        common = held(t).join(held(s).select("token"), "token")
        met = lambda df: spread(df).join(common, "token").groupBy("id", "size").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "token"))), lambda x: F.xxhash64(x["token"])).alias("met"))
        self.source = s.select(F.col("value").alias("s"), F.col("first").alias("s_first"), F.col("tokens").alias("s_tokens"), F.size("tokens").alias("na")).persist()
        self.target = t.select(F.col("value").alias("t"), F.col("first").alias("t_first"), F.col("rows").alias("t_rows"), F.col("tokens").alias("t_tokens")).persist()
        # id, size and hashes of the tokens that the other side has too, the rarest first
        self.left, self.right = met(s).persist(), met(t).persist()
        self._right_shapes: dict[tuple[int, int], int] = {}

    def release(self) -> None:
        for df in (self.source, self.target, self.left, self.right):
            df.unpersist()

    @staticmethod
    def _shapes(side: DataFrame) -> dict[tuple[int, int], int]:
        """How many values have so many tokens, of which so many are in common."""
        return {(r["size"], r["m"]): r["n"] for r in side.groupBy("size", F.size("met").alias("m")).agg(F.count("*").alias("n")).collect()}

    @staticmethod
    def _sets(side: DataFrame, needs: dict[int, int], l: int) -> DataFrame:
        """id and sig of every set of ``l`` tokens among the rarest ones that two values with the overlap needed must share ``l`` of."""
        least = F.broadcast(side.sparkSession.createDataFrame([(k, max(v, l)) for k, v in needs.items()], "size int, need int"))
        x = side.join(least, "size").where(F.size("met") >= F.col("need")).select("id", F.slice("met", F.lit(1), F.greatest(F.size("met") - F.col("need") + l, F.lit(0))).alias("p"))
        x = x.select("id", "p", F.posexplode("p").alias("i", "x0"))
        for k in range(1, l):
            x = x.where(F.size("p") > F.col("i") + 1).select("id", "p", *[f"x{j}" for j in range(k)], F.expr("posexplode(slice(p, i + 2, size(p)))").alias("j", f"x{k}"), "i")
            x = x.withColumn("i", F.col("i") + 1 + F.col("j")).drop("j")
        return x.select("id", F.xxhash64(*[f"x{j}" for j in range(l)]).alias("sig"))

    def _few(self) -> bool:
        return self.source.count() * self.target.count() <= FEW_PAIRS

    def verify(self, met: DataFrame) -> DataFrame:
        """s, t, s_first, t_first, t_rows, d below 1 of distinct pairs (s_first, t_first)."""
        return self._distances(met.join(self.source, "s_first").join(self.target, "t_first"))

    @staticmethod
    def _distances(both: DataFrame) -> DataFrame:
        i = F.size(F.array_intersect("s_tokens", "t_tokens"))
        d = F.when(F.col("s") == F.col("t"), 0.0).otherwise(1 - i / (F.col("na") + F.size("t_tokens") - i))
        return both.select("s", "t", "s_first", "t_first", "t_rows", d.alias("d")).where(F.col("d") < 1)

    def probe(self, only: DataFrame) -> DataFrame:
        """The same for all pairs of few source values, only (s_first), with all target values."""
        return self._distances(self.target.crossJoin(F.broadcast(self.source.join(F.broadcast(only), "s_first", "left_semi"))))

    def within(self, limit: float, strict: bool = False, only: DataFrame | None = None) -> DataFrame:
        """All pairs with a distance of at most ``limit``, or below it if ``strict``, as verify() gives them; only: the source values (s_first) asked for."""
        left = self.left if only is None else self.left.join(only.select(F.col("s_first").alias("id")), "id", "left_semi")
        strict = strict or limit >= 1
        self._right_shapes = self._right_shapes or self._shapes(self.right)
        a, b = self._shapes(left), self._right_shapes
        needs = [_needs({x for x, _ in own}, {y for y, _ in other}, limit, strict) for own, other in ((a, b), (b, a))]
        if not all(needs):
            return self.verify(left.select(F.col("id").alias("s_first"), F.col("id").alias("t_first")).limit(0))
        best = None
        for l in range(1, MOST_SHARED + 1):
            sets = sum(n * math.comb(m - max(need[x], l) + l, l) for shapes, need in zip((a, b), needs, strict=True) for (x, m), n in shapes.items() if x in need and m >= max(need[x], l))
            if l > 1 and sets > MOST_SETS * (sum(a.values()) + sum(b.values())):
                break
            pairs = self._met(left, needs, l)
            count = lambda side, need, n, l=l: self._sets(side, need, l).groupBy("sig").agg(F.count("*").alias(n))
            met = count(left, needs[0], "x").join(count(self.right, needs[1], "y"), "sig").agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0
            if best is None or sets + PAIR_COST * met < best[0]:
                best = sets + PAIR_COST * met, pairs
            if met <= 2 * (sum(a.values()) + sum(b.values())):
                break
        found = self.verify(best[1])
        return found.where(F.col("d") < limit) if strict else found.where(F.col("d") <= limit)

    def _met(self, left: DataFrame, needs: list[dict[int, int]], l: int) -> DataFrame:
        """Pairs (s_first, t_first) that share ``l`` of their rarest tokens; sets that may do with fewer meet on one."""
        join = lambda a, b, n: self._sets(left, a, n).withColumnRenamed("id", "s_first").join(self._sets(self.right, b, n).withColumnRenamed("id", "t_first"), "sig").select("s_first", "t_first")
        pairs = join(*needs, l)
        small = [{k: v for k, v in x.items() if v < l} for x in needs]
        return (pairs.unionByName(join(*small, 1)) if all(small) else pairs).distinct()

    def nearest(self) -> tuple[DataFrame, float | None]:
        """(best, violating): the nearest target value of each source value, the first seen among equals, if it is nearer than
        ``violating``: the least distance at which a target value is the nearest of a second source value, None if there is none."""
        if self._few():
            best = nearest(self.probe(self.source.select("s_first"))).persist()
            return best, _second(best)
        open_, done, bound = self.source.select("s_first").persist(), None, None
        joined = lambda more: more if done is None else done.unionByName(more)
        for limit in LEVELS:
            if done is not None:
                if open_.isEmpty():
                    break
                bound = _second(joined(nearest(self.probe(_some(open_, PROBES)))))
            if bound is not None and bound <= limit:
                for few in (_some(open_, MORE_PROBES), open_):
                    found = nearest(self.within(bound, True, few)).persist()
                    bound = min(x for x in (bound, _second(joined(found))) if x is not None)
                return joined(found), bound
            done = joined(nearest(self.within(limit, limit >= 1, open_)).persist())
            bound = _second(done)
            if bound is not None:
                return done, bound
            open_ = open_.join(done.select("s_first"), "s_first", "left_anti").persist()
        return done, None

    def crowded(self) -> float | None:
        """The least distance at which some source value has a second target row; None if none has one."""
        every = self.source.select("s_first")
        least = lambda pairs: _crowded(pairs).agg(F.min("d")).first()[0]
        if self._few():
            return least(self.probe(every))
        bound = least(self.probe(_some(every, PROBES)))
        for few in (_some(every, MORE_PROBES), every):
            bound = min((x for x in (bound, least(self.within(1.0 if bound is None else bound, True, few))) if x is not None), default=None)
        return bound


def _some(ids: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` of the ids, by their hashes; only bounds depend on which."""
    return ids.orderBy(F.xxhash64("s_first"), "s_first").limit(most)


def _second(best: DataFrame) -> float | None:
    order = Window.partitionBy("t").orderBy("d", "s_first")
    return best.withColumn("_k", F.row_number().over(order)).where(F.col("_k") == 2).agg(F.min("d")).first()[0]


def closed(violating: float | None) -> float:
    """closed_threshold() of a number."""
    return 1023 / 1024 if violating is None else max(0, min(1023, math.ceil(violating * 1024) - 1)) / 1024


def top1_threshold(best: DataFrame) -> DataFrame:
    """threshold: the loosest at which no target value is the nearest of two source values."""
    order = Window.partitionBy("t").orderBy("d", "s_first")
    second = best.withColumn("_k", F.row_number().over(order)).where(F.col("_k") == 2)
    return second.agg(closed_threshold(F.min("d")).alias("threshold"))


def _crowded(distances: DataFrame) -> DataFrame:
    """The pairs with which a source value has two target rows or more."""
    order = Window.partitionBy("s").orderBy("d", "t_first").rowsBetween(Window.unboundedPreceding, 0)
    return distances.withColumn("_rows", F.sum("t_rows").over(order)).where(F.col("_rows") >= 2)


def recovery_threshold(distances: DataFrame) -> DataFrame:
    """threshold: the loosest at which every source value has at most one target row."""
    return _crowded(distances).agg(closed_threshold(F.min("d")).alias("threshold"))


def top1_join(source: DataFrame, target: DataFrame, tokenisers: tuple[str, ...] = JOIN_TOKENISERS) -> DataFrame:
    """(src_rid, tgt_rid, distance): every source row with the first row of its nearest target value, within the threshold of the
    tokeniser that covers most target rows (the first among equals). source and target: (_rid, value)."""
    s, t = distinct_values(source).persist(), distinct_values(target).persist()
    tried = []
    for name in tokenisers:
        best, violating = Tokens(s, t, name).nearest()
        kept = best.where(F.col("d") <= closed(violating)).select("s", F.col("t_first").alias("tgt_rid"), "d")
        tried.append((kept.select("tgt_rid").distinct().count() if len(tokenisers) > 1 else 0, kept))
    _, kept = max(tried, key=lambda x: x[0])
    rows = source.select(F.col("_rid").alias("src_rid"), F.col("value").alias("s"))
    return rows.join(kept, "s").select("src_rid", "tgt_rid", F.col("d").alias("distance"))


def recover(source: DataFrame, target: DataFrame, matched_source: DataFrame, matched_target: DataFrame, tokenisers: tuple[str, ...] = RECOVERY_TOKENISERS) -> tuple[DataFrame, float, bool]:
    """((src_rid, tgt_rid, distance), threshold, skipped): unmatched source rows with their nearest unmatched target row.

    The threshold comes from the full columns; the tokeniser that recovers most rows is used, the first among equals.
    matched_source and matched_target: (_rid). Nothing is recovered at a threshold of 0; skipped tells that no source or no target
    row is left to recover.
    """
    spark = source.sparkSession
    nothing = spark.createDataFrame([], "src_rid long, tgt_rid long, distance double")
    free_s = source.join(matched_source, "_rid", "left_anti").select(F.col("_rid").alias("src_rid"), F.col("value").alias("s")).persist()
    free_t = target.join(matched_target, "_rid", "left_anti").groupBy(F.col("value").alias("t")).agg(F.min("_rid").alias("tgt_rid")).persist()
    if free_s.isEmpty() or free_t.isEmpty():
        return nothing, 0.0, True
    s, t = distinct_values(source).persist(), distinct_values(target).persist()
    wanted, left = (x.join(free.select(F.col(c).alias("value")).distinct(), "value", "left_semi").persist() for x, free, c in ((s, free_s, "s"), (t, free_t, "t")))
    best = (0, nothing, 0.0)
    for name in tokenisers:
        full = Tokens(s, t, name)
        threshold = closed(full.crowded())
        full.release()
        if threshold <= 0:
            continue
        order = Window.partitionBy("s").orderBy("d", "tgt_rid")
        near = Tokens(wanted, left, name).within(threshold).join(free_t, "t").withColumn("_k", F.row_number().over(order)).where(F.col("_k") == 1)
        pairs = free_s.join(near.select("s", "tgt_rid", F.col("d").alias("distance")), "s").select("src_rid", "tgt_rid", "distance").persist()
        n = pairs.count()
        if n > best[0]:
            best = (n, pairs, threshold)
    return best[1], best[2], False
