"""The eight join methods under their labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from keyweave.functions.strings import whole_row
from keyweave.operators import discovery, fuzzy, oracle, substring_match
from keyweave.plans.derived import derived_join
from keyweave.sources.table import JoinTable

Method = Callable[[JoinTable, JoinTable], DataFrame]


def fuzzy_on_keys(source: JoinTable, target: JoinTable) -> DataFrame:
    return fuzzy.top1_join(source.values(source.keys), target.values(target.keys)).select("src_rid", "tgt_rid")


def fuzzy_on_rows(source: JoinTable, target: JoinTable) -> DataFrame:
    rows = lambda t: t.df.select("_rid", whole_row(t.df["_cells"]).alias("value"))
    return fuzzy.top1_join(rows(source), rows(target)).select("src_rid", "tgt_rid")


def fuzzy_at(source: JoinTable, target: JoinTable, tokeniser: str = "WORD", distance: str = "JACCARD", threshold: float = 0.5) -> DataFrame:
    near = oracle.nearest_rows(source.values(source.keys), target.values(target.keys), (tokeniser,), (distance,))
    return oracle.pairs_at(near, (threshold,)).select("src_rid", "tgt_rid")


METHODS: dict[str, Method] = {
    "AJ": lambda s, t: derived_join(s, t).pairs,
    "AJ-E": lambda s, t: derived_join(s, t, fuzzy=False).pairs,
    "SM": lambda s, t: substring_match.formula_join(s, t)[0],
    "FJ-C": fuzzy_on_keys,
    "FJ-FR": fuzzy_on_rows,
    "FJ-O": fuzzy_at,
    "DQ-P": lambda s, t: discovery.direct_join(s, t, one_to_one=True),
    "DQ-R": lambda s, t: discovery.direct_join(s, t, one_to_one=False),
}
