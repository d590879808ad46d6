"""The whole join: find matching rows, learn a program, join on the key it derives, recover the rest."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from keyweave.operators.composite import split_keys
from keyweave.operators.discovery import joinable_pairs
from keyweave.operators.equijoin import transformed_equijoin
from keyweave.operators.fuzzy import recover
from keyweave.operators.sampling import draw, sample_size
from keyweave.plans.learn import Learned, learn, ranked_groups
from keyweave.sources.table import JoinTable

#: What the trace shows of demo matches, matched and unmatched rows.
DEMO, MATCHED, UNMATCHED = 3, 5, 3


@dataclass
class JoinResult:
    """pairs: (src_rid, tgt_rid), source first whichever direction won."""

    pairs: DataFrame
    program: str = ""
    forward_won: bool = True
    score: int = 0
    key_columns: int = 0
    trace: dict = field(default_factory=dict)

    def count(self) -> int:
        return self.trace.get("pairs", 0)


def _empty(t: JoinTable) -> DataFrame:
    return t.df.sparkSession.createDataFrame([], "src_rid long, tgt_rid long")


def _cell_values(t: JoinTable, column: int) -> DataFrame:
    return t.df.select("_rid", t.cell(column).alias("value"))


@dataclass
class _Search:
    """What the samples of a direction say: the best column pair, if any, and what was learned."""

    source: JoinTable
    target: JoinTable
    forward: bool
    rows: int = 0
    group: Row | None = None
    learned: Learned | None = None
    trace: dict = field(default_factory=dict)

    def rank(self) -> tuple[int, int]:
        """Score and key columns of the result that finish() gives."""
        if self.learned:
            return self.learned.score, len(self.learned.program.columns)
        return (-self.rows, 1) if self.group else (0, 0)

    def finish(self, fuzzy: bool) -> JoinResult:
        """Joins and recovers on the full tables."""
        if self.learned:
            return _apply(self.source, self.target, self.learned, fuzzy, self.trace)
        if self.group and fuzzy:
            return _fuzzy_only(self.source, self.target, self.group, self.rows, self.trace)
        return JoinResult(_empty(self.source), trace=self.trace)


def _search(source: JoinTable, target: JoinTable, forward: bool = True) -> _Search:
    """Samples, finds pairs and learns on the samples."""
    trace: dict = {}
    began = time.perf_counter()
    n, m = source.count(), target.count()
    take = lambda t, own, other: t if (k := sample_size(own, other)) >= own else t.with_df(draw(t.df, k))
    s, t = take(source, n, m), take(target, m, n)
    pairs = joinable_pairs(s, t).persist()
    try:
        ranked = ranked_groups(pairs)
        trace["discovery"] = [g.asDict() | {"top": [r.asDict() for r in pairs.where((F.col("scol") == g["scol"]) & (F.col("tcol") == g["tcol"]) & (F.col("place") <= 5)).orderBy("place").collect()]} for g in ranked[:5]]
        trace["discovery_ms"] = 1000 * (time.perf_counter() - began)
        if not ranked:
            return _Search(source, target, forward, n, trace=trace)
        began = time.perf_counter()
        learned = learn(pairs, s, t)
    finally:
        pairs.unpersist()
    trace["learning_ms"] = 1000 * (time.perf_counter() - began)
    return _Search(source, target, forward, n, ranked[0], learned, trace)


def one_direction(source: JoinTable, target: JoinTable, fuzzy: bool = True) -> JoinResult:
    """Samples, finds pairs and learns on the samples, then joins and recovers on the full tables."""
    return _search(source, target).finish(fuzzy)


def _apply(source: JoinTable, target: JoinTable, learned: Learned, fuzzy: bool, trace: dict) -> JoinResult:
    began = time.perf_counter()
    p = learned.program
    values = _cell_values(target, learned.target_column)
    equi = transformed_equijoin(source.df, p.to_column(), values).persist()  # counted, shown, recovered from and returned
    joined = equi.count()
    own = source.df.select("_rid", p.to_column().alias("value")).where(F.col("value").isNotNull())
    keyed = own.join(equi.select(F.col("src_rid").alias("_rid"), "tgt_rid"), "_rid", "left")
    # a row counts as unmatched if no row with its key is matched
    missed = keyed.groupBy("value").agg(F.count("tgt_rid").alias("met"), F.count("*").alias("rows"), F.min("_rid").alias("first")).where("met = 0")
    unkeyed = source.count() - own.count()
    trace["learning"] = {"program": str(p), "json": p.to_json(), "source_column": learned.source_column, "target_column": learned.target_column, "score": learned.score, "examples": learned.examples[:6], "steps": _steps(learned)}
    shown = keyed.where(F.col("tgt_rid").isNotNull()).orderBy("_rid").limit(MATCHED).collect()
    trace["application"] = {
        "matched": joined,
        "unmatched": (missed.agg(F.sum("rows")).first()[0] or 0) + unkeyed,
        "demo": [{"row": row, "key": p.apply(tuple(row)), "target": value} for row, value in learned.examples[:DEMO]],
        "matched_samples": [r.asDict() for r in shown],
        "unmatched_samples": [r.asDict() for r in missed.select("first", "value").orderBy("first").limit(UNMATCHED).collect()],
    }
    trace["join_ms"] = 1000 * (time.perf_counter() - began)
    if not joined:
        return JoinResult(_empty(source), str(p), score=learned.score, key_columns=len(p.columns), trace=trace | {"pairs": 0})
    pairs, total = equi, joined
    if fuzzy:
        began = time.perf_counter()
        more, threshold, skipped = recover(own, values.where(F.col("value").isNotNull()), equi.select(F.col("src_rid").alias("_rid")).distinct(), equi.select(F.col("tgt_rid").alias("_rid")).distinct())
        n = more.count()
        left = trace["application"]["unmatched"]
        trace["fuzzy"] = {"recovered": n, "threshold": threshold, "skipped": skipped, "unmatched_before": left, "unmatched_after": left - n, "samples": [r.asDict() for r in more.limit(5).collect()]}
        trace["fuzzy_ms"] = 1000 * (time.perf_counter() - began)
        pairs, total = equi.unionByName(more.select("src_rid", "tgt_rid")), joined + n
    return JoinResult(pairs, str(p), score=learned.score, key_columns=len(p.columns), trace=trace | {"pairs": total})


def _steps(learned: Learned) -> list[dict]:
    """What each operator adds to the first example's key."""
    row, out, steps = learned.examples[0][0], "", []
    for op in learned.program.ops:
        out += op.apply(row) or ""
        steps.append({"op": str(op), "so_far": out})
    return steps


def _fuzzy_only(source: JoinTable, target: JoinTable, group, rows: int, trace: dict) -> JoinResult:
    """No program: recovery on the raw values of the best column pair."""
    nobody = source.df.select("_rid").limit(0)
    own, other = _cell_values(source, group["scol"]), _cell_values(target, group["tcol"])
    pairs, threshold, skipped = recover(own.where(F.col("value").isNotNull()), other.where(F.col("value").isNotNull()), nobody, nobody)
    n = pairs.count()
    trace |= {"fuzzy": {"recovered": n, "threshold": threshold, "skipped": skipped}, "pairs": n}
    return JoinResult(pairs.select("src_rid", "tgt_rid"), "", score=-rows, key_columns=1, trace=trace)


def swapped(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("tgt_rid").alias("src_rid"), F.col("src_rid").alias("tgt_rid"))


def derived_join(source: JoinTable, target: JoinTable, fuzzy: bool = True) -> JoinResult:
    """Both directions; once more with split keys if neither derives a key. The best by score, key columns and size wins.

    Score and key columns are known before the full tables are joined, so only the directions that are best by them are.
    """
    tried = [_search(source, target), _search(target, source, False)]
    if all(x.learned is None or x.learned.score < 1 for x in tried):
        s, t = split_keys(source), split_keys(target)
        if s is not source or t is not target:
            tried += [x for x in (_search(s, t), _search(t, s, False)) if x.learned and x.learned.score >= 1]
    for rank in sorted({x.rank() for x in tried}, reverse=True):
        results = [(x.finish(fuzzy), x.forward) for x in tried if x.rank() == rank]
        result, forward = max(results, key=lambda x: x[0].count())
        if result.count():
            break
    else:
        return JoinResult(_empty(source), trace=tried[0].trace | {"inputs": _inputs(source, target), "pairs": 0})
    result.forward_won = forward
    result.pairs = result.pairs if forward else swapped(result.pairs)
    result.trace["inputs"] = _inputs(source, target)
    return result


def _inputs(*tables: JoinTable) -> list[dict]:
    """What the trace says of the original tables."""
    return [{"name": t.name, "rows": t.count(), "columns": t.width, "names": t.names, "keys": [t.names[k] for k in t.keys], "first": [r["_cells"] for r in t.df.orderBy("_rid").limit(5).collect()]} for t in tables]
