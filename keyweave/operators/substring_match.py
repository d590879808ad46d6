"""Substring-formula matching: a target key is spelled by copies of parts of source columns and literals.

A formula grows on a small interleaved sample: columns are ranked by how much of the targets they spell, likely partners come from rare
q-grams, and pairs vote for the copy that explains their longest common substring. The formula then runs as a Column expression.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyweave.functions.strings import TO_END
from keyweave.functions.tokens import qgrams
from keyweave.operators.equijoin import first_match_join
from keyweave.operators.sampling import interleaved
from keyweave.sources.table import JoinTable

Q, CANDIDATES, VOTES, ITERATIONS, PASSES = 3, 5, 2, 8, 3


@dataclass(frozen=True)
class Copy:
    """``length`` characters (0: all) of a column from ``start``."""

    column: int
    start: int
    length: int = 0

    def apply(self, row: list[str]) -> str | None:
        v = row[self.column][self.start : self.start + self.length] if self.length else row[self.column][self.start :]
        return v if v and len(v) >= self.length else None

    def to_column(self, cells: Column) -> Column:
        v = F.get(cells, F.lit(self.column))
        if self.length:
            return F.when(F.length(v) >= self.start + self.length, F.substring(v, self.start + 1, self.length))
        return F.when(F.length(v) > self.start, F.substring(v, self.start + 1, TO_END))


@dataclass(frozen=True)
class Literal:
    text: str

    def apply(self, row: list[str]) -> str | None:
        return self.text or None

    def to_column(self, cells: Column) -> Column:
        return F.lit(self.text)


def formula_column(pieces: list[Copy | Literal], cells: Column | None = None) -> Column:
    cells = F.col("_cells") if cells is None else cells
    return F.concat(*[p.to_column(cells) for p in pieces])


def longest_common_substring(a: str, b: str) -> tuple[int, int, int]:
    """Start in a, start in b and length; the first maximum."""
    best, row = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                if new[j] > best[2]:
                    best = i - new[j], j - new[j], new[j]
        row = new
    return best


def rare_gram_matches(source: DataFrame, target: DataFrame, q: int = Q, top: int = CANDIDATES) -> DataFrame:
    """src_rid, tgt_rid, score, place: the ``top`` target values that share the rarest q-grams with each source value.

    A shared gram scores the square of log2(N / df), df counted over the N target rows. source and target: (_rid, value). Distinct
    values are scored: a target value has its number of rows and its ``top`` first ones, a source value's matches go to all its rows.
    """
    n = target.count()
    first = Window.partitionBy("value").orderBy("_rid")
    rows = target.where(F.col("value").isNotNull()).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= top).groupBy("value").agg(F.sort_array(F.collect_list("_rid")).alias("rids"))
    t = target.groupBy("value").agg(F.count("*").alias("rows")).join(rows, "value").select(F.col("rids")[0].alias("first"), "rids", "rows", F.explode(qgrams(F.col("value"), q)).alias("gram"))
    once = source.where(F.col("value").isNotNull()).groupBy("value").agg(F.min("_rid").alias("own"))
    s = once.select("own", F.explode(qgrams(F.col("value"), q)).alias("gram"))
    # a gram that all rows have scores nothing, but still makes a match
    idf = t.groupBy("gram").agg(F.pow(F.log2(F.lit(float(n)) / F.sum("rows")), 2).alias("w"))
    scored = s.join(idf, "gram").join(t.select("gram", "first"), "gram").groupBy("own", "first").agg(F.round(F.sum("w"), 9).alias("score"))  # sums of doubles differ in their last bits
    scored = scored.withColumn("_k", F.rank().over(Window.partitionBy("own").orderBy(F.desc("score")))).where(F.col("_k") <= top)
    rids = t.select("first", "rids").distinct()
    each = scored.join(rids, "first").select("own", "score", F.explode("rids").alias("tgt_rid"))
    best = each.withColumn("place", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "tgt_rid"))).where(F.col("place") <= top)
    whose = source.join(once, "value").select(F.col("_rid").alias("src_rid"), "own")
    return whose.join(best, "own").select("src_rid", "tgt_rid", "score", "place")


def _best_column(rows: list[list[str]], partners: dict[int, list[str]], width: int) -> int:
    """The column that spells the most of its likely targets: the cube of the mean length of common substrings of 3 or more."""
    def score(c: int) -> float:
        total = sum(n for i, r in enumerate(rows) for t in partners.get(i, [])[:1] if (n := longest_common_substring(r[c], t)[2]) >= 3)
        return (total / max(1, len(rows))) ** 3

    scores = [score(c) for c in range(width)]
    return max(range(width), key=lambda c: scores[c])


#: A formula while it grows: copies, literals and gaps (None) in turn.
Formula = list[Copy | Literal | None]


def _align(formula: Formula, row: list[str], target: str) -> list[str] | None:
    """What stands in each gap if the formula spells the target; None if it cannot."""
    gaps, at, open_ = [], 0, False
    for piece in formula:
        if piece is None:
            open_ = True
            continue
        text = piece.apply(row)
        if text is None:
            return None
        found = target.find(text, at) if open_ else (at if target.startswith(text, at) else -1)
        if found < 0:
            return None
        if open_:
            gaps.append(target[at:found])
        at, open_ = found + len(text), False
    if open_:
        gaps.append(target[at:])
    elif at != len(target):
        return None
    return gaps


def learn_formula(rows: list[list[str]], partners: dict[int, list[str]], targets: list[str], width: int) -> list[Copy | Literal] | None:
    """A formula without gaps, or None. partners: likely targets by row of the sample."""
    if not rows or not targets:
        return None
    first = _best_column(rows, partners, width)
    formula: Formula = [None]
    for turn in range(ITERATIONS):
        if None not in formula:
            break
        fit = partners if turn == 0 else {i: [t for t in targets if _align(formula, r, t) is not None][:CANDIDATES] for i, r in enumerate(rows)}
        votes: dict[tuple[int, Copy], set[int]] = {}
        for least in (3, 1):
            for i, r in enumerate(rows):
                for t in fit.get(i, []):
                    gaps = _align(formula, r, t)
                    for g, text in enumerate(gaps or []):
                        for c in [first] if turn == 0 else range(width):
                            a, b, n = longest_common_substring(r[c], text)
                            if n >= least:
                                votes.setdefault((g, Copy(c, a, n)), set()).add(i)
                                if a + n == len(r[c]):
                                    votes.setdefault((g, Copy(c, a)), set()).add(i)
            if votes:
                break
        involved = set().union(*votes.values()) if votes else set()
        won = min(votes, key=lambda v: (-len(votes[v]), v[0], v[1].column, v[1].start, v[1].length), default=None)
        if won is None or len(votes[won]) < max(VOTES, math.ceil(len(involved) / 2)):
            break
        formula = _splice(formula, won, rows, fit)
    return _with_literals(formula, rows, targets)


def _splice(formula: Formula, won: tuple[int, Copy], rows: list[list[str]], fit: dict[int, list[str]]) -> Formula:
    """The copy in the gap it won, with a gap on either side unless it always stands at the gap's edge."""
    gap, copy = won
    place = [i for i, p in enumerate(formula) if p is None][gap]
    before, after = set(), set()
    for i, r in enumerate(rows):
        for t in fit.get(i, []):
            text, made = (_align(formula, r, t) or [])[gap : gap + 1], copy.apply(r)
            if text and made and made in text[0]:
                at = text[0].find(made)
                before.add(at > 0)
                after.add(at + len(made) < len(text[0]))
    middle: Formula = [*([None] if True in before else []), copy, *([None] if True in after else [])]
    return [*formula[:place], *middle, *formula[place + 1 :]]


def _with_literals(formula: Formula, rows: list[list[str]], targets: list[str]) -> list[Copy | Literal] | None:
    """Gaps become the text that most rows have in them."""
    while None in formula:
        seen: Counter[str] = Counter()
        consistent = 0
        for r in rows:
            texts = {g[0] for t in targets if (g := _align(formula, r, t))}
            consistent += bool(texts)
            seen.update(texts)
        best = min(seen.items(), key=lambda x: (-x[1], x[0]), default=None)
        if best is None or best[1] < max(VOTES, consistent // 2):
            return None
        at = formula.index(None)
        formula = [*formula[:at], *([Literal(best[0])] if best[0] else []), *formula[at + 1 :]]
    return formula if any(isinstance(p, Copy) for p in formula) else None


def formula_join(source: JoinTable, target: JoinTable) -> tuple[DataFrame, list[list[Copy | Literal]]]:
    """(src_rid, tgt_rid) and the formulas of up to PASSES passes; each pass works on the rows that are not matched yet."""
    left, keys = source.df, target.values(target.keys or list(range(target.width)))
    found, formulas = None, []
    for _ in range(PASSES):
        sample = interleaved(left, left.count()).orderBy("_rid").collect()
        rest = interleaved(keys, keys.count()).orderBy("_rid").collect()
        if not sample or not rest:
            break
        rows = [[c or "" for c in r["_cells"]] for r in sample]
        spark = left.sparkSession
        whole = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "_rid long, value string")
        texts = spark.createDataFrame([(r["_rid"], r["value"]) for r in rest], "_rid long, value string")
        by_rid = {r["_rid"]: r["value"] for r in rest}
        partners: dict[int, list[str]] = {}
        for r in rare_gram_matches(whole, texts).orderBy("src_rid", "place").collect():
            partners.setdefault(r["src_rid"], []).append(by_rid[r["tgt_rid"]])
        formula = learn_formula(rows, partners, [r["value"] for r in rest], source.width)
        if formula is None:
            break
        pairs = first_match_join(left, formula_column(formula), keys)
        if pairs.isEmpty():
            break
        formulas.append(formula)
        found = pairs if found is None else found.unionByName(pairs)
        left = left.join(pairs.select(F.col("src_rid").alias("_rid")).distinct(), "_rid", "left_anti")
        keys = keys.join(pairs.select(F.col("tgt_rid").alias("_rid")).distinct(), "_rid", "left_anti")
    if found is None:
        found = source.df.sparkSession.createDataFrame([], "src_rid long, tgt_rid long")
    return found, formulas
