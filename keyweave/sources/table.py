"""Tables to join: rows of string cells, addressed by position, with the positions that make up the key."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.functions.strings import java_trim, join_cells

#: Stands for a comma outside quotes while a CSV line is parsed.
_CUT = "\x01"


@dataclass(frozen=True)
class JoinTable:
    """df has _rid (long, ascending in the order of the rows) and _cells (array of strings)."""

    df: DataFrame
    names: list[str]
    keys: list[int] = field(default_factory=list)
    name: str = ""

    def __post_init__(self) -> None:
        if not self.names:
            raise ValueError("a table needs at least one column")
        if any(not 0 <= k < len(self.names) for k in self.keys):
            raise ValueError("key position out of range")

    @classmethod
    def from_df(cls, df: DataFrame, keys: Sequence[str] = (), rid: str | None = None, name: str = "") -> JoinTable:
        """rid: a column of distinct longs that orders the rows and is not one of the cells; without it the order of the scan."""
        names = [c for c in df.columns if c != rid]
        order = F.col(rid).cast("long") if rid else F.monotonically_increasing_id()
        cells = F.array(*[F.col(f"`{c}`").cast("string") for c in names])
        return cls(df.select(order.alias("_rid"), cells.alias("_cells")), names, [names.index(k) for k in keys], name)

    @classmethod
    def from_rows(cls, spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence[str]], keys: Sequence[str] = (), name: str = "") -> JoinTable:
        if any(len(r) != len(names) for r in rows):
            raise ValueError("rows differ in length")
        data = [(i, list(r)) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, "_rid long, _cells array<string>")
        return cls(df, list(names), [i for i, n in enumerate(names) if n in set(keys)], name)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, keys: Sequence[str] = (), name: str = "") -> JoinTable:
        """Blank lines are skipped, the first line is the header; short rows are padded with empty cells, long ones cut to the header.

        A quotation mark switches commas off and on and is dropped; there are no multi-line cells. Of several files each may begin with
        the header.
        """
        text = spark.read.text(path)
        lines = text.select(F.monotonically_increasing_id().alias("_rid"), "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        lines = lines.where(F.col("value").rlike(r"[^\x00-\x20]"))
        parts = F.transform(F.split("value", '"', -1), lambda s, i: F.when(i % 2 == 0, F.translate(s, ",", _CUT)).otherwise(s))
        cells = F.split(F.array_join(parts, ""), _CUT, -1)
        first = lines.select("_rid", F.transform(cells, lambda c: java_trim(c)).alias("_cells")).first()
        if first is None:
            raise ValueError("CSV is empty")
        names = [n.removeprefix("﻿") for n in first["_cells"]]
        padded = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: java_trim(F.coalesce(F.get(F.col("_all"), i), F.lit(""))))
        if len(text.inputFiles()) > 1:  # one row a file
            heads = lines.where(F.col("_block") == 0).groupBy("_file").agg(F.min_by(F.struct("_rid", F.transform(cells, lambda c: java_trim(c)).alias("_head")), "_rid").alias("_h"))
            lines = lines.join(heads.where(F.col("_h._head") == F.lit(first["_cells"])).select("_h._rid"), "_rid", "left_anti")
        rows = lines.where(F.col("_rid") != first["_rid"]).select("_rid", cells.alias("_all")).select("_rid", padded.alias("_cells"))
        return cls(rows, names, [i for i, n in enumerate(names) if n in set(keys)], name)

    @property
    def width(self) -> int:
        return len(self.names)

    def count(self) -> int:
        return self.df.count()

    def position(self, name: str) -> int:
        """The first column with the name."""
        return self.names.index(name)

    def cell(self, position: int) -> Column:
        return F.get(F.col("_cells"), F.lit(position))

    def with_df(self, df: DataFrame) -> JoinTable:
        return replace(self, df=df)

    def values(self, positions: Sequence[int], separator: str = " ") -> DataFrame:
        """_rid and the joined cells at the positions as value."""
        return self.df.select("_rid", join_cells(F.col("_cells"), list(positions), separator).alias("value"))

    def positions(self, names: Sequence[str]) -> list[int]:
        """The k-th use of a name stands for the k-th column with it."""
        used: dict[str, int] = {}
        out = []
        for n in names:
            at = [i for i, x in enumerate(self.names) if x == n]
            k = used.get(n, 0)
            used[n] = k + 1
            out.append(at[min(k, len(at) - 1)])
        return out

    def melted(self, positions: Sequence[int] | None = None) -> DataFrame:
        """A row (col, _rid, v) for every cell that is neither null nor empty."""
        positions = list(range(self.width)) if positions is None else list(positions)
        cells = F.explode(F.array(*[F.struct(F.lit(p).alias("col"), self.cell(p).alias("v")) for p in positions]))
        return self.df.select("_rid", cells.alias("_c")).select("_c.col", "_rid", "_c.v").where(F.col("v") != "")


def joined_rows(pairs: DataFrame, source: JoinTable, target: JoinTable) -> DataFrame:
    """The cells of both rows of each pair (src_rid, tgt_rid), flat, as columns c0, c1, …"""
    s = source.df.select(F.col("_rid").alias("src_rid"), F.col("_cells").alias("_s"))
    t = target.df.select(F.col("_rid").alias("tgt_rid"), F.col("_cells").alias("_t"))
    both = pairs.join(s, "src_rid").join(t, "tgt_rid")
    cells = [F.get("_s", F.lit(i)) for i in range(source.width)] + [F.get("_t", F.lit(i)) for i in range(target.width)]
    return both.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])


def csv_lines(pairs: DataFrame, source: JoinTable, target: JoinTable) -> tuple[str, DataFrame]:
    """The header line and a row ``line`` per pair, with cells quoted where they hold a comma, a quotation mark or a line end."""
    quote = lambda c: F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    rows = joined_rows(pairs, source, target)
    line = F.concat_ws(",", *[quote(F.coalesce(F.col(c), F.lit(""))) for c in rows.columns])
    py = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c
    return ",".join(py(n) for n in [*source.names, *target.names]), rows.select(line.alias("line"))


def write_csv(pairs: DataFrame, source: JoinTable, target: JoinTable, path: str) -> None:
    """Writes the joined rows below ``path``, one file per partition, each with the header."""
    header, lines = csv_lines(pairs, source, target)
    lines.withColumnRenamed("line", header).write.mode("overwrite").option("quote", "\u0000").option("escapeQuotes", False).option("header", True).option("sep", "\u0002").csv(path)
