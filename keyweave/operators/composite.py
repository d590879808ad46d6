"""Splits key columns that hold two values, such as a name and a remark in brackets."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyweave.functions.strings import literal_pattern
from keyweave.sources.table import JoinTable

MARKS = "([{,;:/|-"
COVERAGE = 0.8


def split_keys(table: JoinTable, coverage: float = COVERAGE) -> JoinTable:
    """The table with two more key columns for every key column and mark that most of its values hold; the same table if there is none."""
    if not table.keys:
        return table
    tests = [(k, m) for k in table.keys for m in MARKS]
    shares = table.df.agg(*[F.avg(F.coalesce(F.contains(table.cell(k), F.lit(m)), F.lit(False)).cast("int")).alias(f"s{i}") for i, (k, m) in enumerate(tests)]).first()
    chosen = [t for i, t in enumerate(tests) if (shares[f"s{i}"] or 0) >= coverage]
    if not chosen:
        return table
    cells, names, keys = [F.col("_cells")], list(table.names), list(table.keys)
    for k, m in chosen:
        parts = F.split(table.cell(k), literal_pattern(m), 2)
        for i in range(2):
            cells.append(F.array(F.regexp_replace(F.trim(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))), r"[)\]}]+$", "")))
            keys.append(len(names))
            names.append(f"{table.names[k]} {m} {i}")
    return JoinTable(table.df.select("_rid", F.concat(*cells).alias("_cells")), names, keys, table.name)
