"""From matching rows to the best program: example sets, one job that learns on the executors, one that scores."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.operators.discovery import groups
from keyweave.operators.equijoin import injective_scores
from keyweave.plans.program import Program
from keyweave.plans.synth import learn_program
from keyweave.sources.table import JoinTable
from keyweave.workers import ship

TOP_MATCHES, EXAMPLES, SUBSETS, DRAWS, TOTAL = 20, 3, 12, 120, 512


@dataclass(frozen=True)
class Learned:
    program: Program
    source_column: int
    target_column: int
    score: int
    examples: list[tuple[list[str], str]]


def example_sets(n: int, size: int = EXAMPLES, most: int = SUBSETS, draws: int = DRAWS, seed: int = 42) -> list[tuple[int, ...]]:
    """Up to ``most`` distinct sets of ``size`` out of n; the one full set if n is no larger."""
    if n <= size:
        return [tuple(range(n))] if n else []
    rng, out = random.Random(seed), {}
    for _ in range(draws):
        out.setdefault(tuple(sorted(rng.sample(range(n), size))))
        if len(out) == most:
            break
    return list(out)


def ranked_groups(pairs: DataFrame) -> list:
    """The column pairs in order: mean score, then number of matches, then position."""
    return groups(pairs).orderBy(F.desc("mean_score"), F.desc("matches"), "scol", "tcol").collect()


def learn(pairs: DataFrame, source: JoinTable, target: JoinTable, total: int = TOTAL) -> Learned | None:
    """The program with the most keys that belong to one source row and one target row; None if nothing can be learned.

    At most TOP_MATCHES matches of a column pair are collected, and at most ``total`` example sets are tried, those of the
    best column pairs.
    """
    ranked = ranked_groups(pairs)
    if not ranked:
        return None
    order = {(g["scol"], g["tcol"]): i for i, g in enumerate(ranked)}
    top = pairs.where(F.col("place") <= TOP_MATCHES)
    s = source.df.select(F.col("_rid").alias("src_rid"), F.col("_cells").alias("row"))
    t = target.df.select(F.col("_rid").alias("tgt_rid"), F.col("_cells").alias("_t"))
    shown = top.join(s, "src_rid").join(t, "tgt_rid").select("scol", "tcol", "place", "row", F.expr("get(_t, tcol)").alias("value")).where(F.col("value").rlike(r"\S"))
    matches: dict[int, list] = {}
    for r in shown.orderBy("scol", "tcol", "place").collect():
        if (g := order.get((r["scol"], r["tcol"]))) is not None:
            matches.setdefault(g, []).append(([x or "" for x in r["row"]], r["value"]))
    tasks = [(g, i, json.dumps([matches[g][k] for k in subset])) for g in sorted(matches) for i, subset in enumerate(example_sets(len(matches[g])))][:total]
    if not tasks:
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [learn_program([(tuple(row), value) for row, value in json.loads(x)]) for x in b["examples"]]
            ok = [p is not None and not p.constant for p in found]
            if any(ok):
                yield pd.DataFrame({"g": b["g"][ok], "i": b["i"][ok], "program": [p.to_json() for p, k in zip(found, ok, strict=True) if k]})

    spark = source.df.sparkSession
    ship(spark)
    work = spark.createDataFrame(tasks, "g int, i int, examples string").repartition(min(len(tasks), 64))
    got = sorted(work.mapInPandas(run, "g int, i int, program string").collect())
    if not got:
        return None
    programs = [(ranked[r["g"]]["tcol"], Program.from_json(r["program"])) for r in got]
    distinct = list(dict.fromkeys(programs))
    scores = {r["pid"]: r["score"] for r in injective_scores(source.df, distinct, target.melted(target.keys or None).withColumnRenamed("col", "tcol").withColumnRenamed("v", "value")).collect()}
    best, best_score = None, -1
    for r, p in zip(got, programs, strict=True):  # in order of priority; only a larger score wins
        score = scores.get(distinct.index(p), 0)
        if score > best_score:
            best, best_score = r, score
    group = ranked[best["g"]]
    chosen = dict(((g, i), json.loads(x)) for g, i, x in tasks)[(best["g"], best["i"])]
    return Learned(Program.from_json(best["program"]), group["scol"], group["tcol"], best_score, chosen)
