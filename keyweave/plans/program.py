"""Transformation programs: a chain of operators over a row's cells whose outputs are concatenated."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyweave.functions import strings as S
from keyweave.functions.strings import Casing


@dataclass(frozen=True)
class Constant:
    text: str
    kind: str = "constant"

    def to_column(self, cells: Column) -> Column:
        return F.lit(self.text)

    def apply(self, row: Sequence[str]) -> str | None:
        return self.text

    def __str__(self) -> str:
        return f"Constant({self.text!r})"


@dataclass(frozen=True)
class Piece:
    """A substring of a cell, after as many nested splits as ``splits`` has (separator, part) pairs."""

    column: int
    start: int
    length: int = -1
    casing: Casing = Casing.NONE
    splits: tuple[tuple[str, int], ...] = ()
    kind: str = "piece"

    def to_column(self, cells: Column) -> Column:
        value = S.select_k(cells, self.column)
        for separator, part in self.splits:
            value = S.select_k(S.split(value, separator), part)
        return S.substring(value, self.start, self.length, self.casing)

    def value(self, row: Sequence[str]) -> str | None:
        value = S.py_select(list(row), self.column)
        for separator, part in self.splits:
            value = None if value is None else S.py_select(value.split(separator), part)
        return value

    def apply(self, row: Sequence[str]) -> str | None:
        value = self.value(row)
        return None if value is None else S.py_substring(value, self.start, self.length, self.casing)

    def __str__(self) -> str:
        inner = f"row[{self.column}]"
        for separator, part in self.splits:
            inner = f"Split({inner}, {separator!r})[{part}]"
        return f"Substring({inner}, {self.start}, {self.length}, {self.casing.name})"


def substr(column: int, start: int, length: int = -1, casing: Casing = Casing.NONE) -> Piece:
    return Piece(column, start, length, casing)


def split_substr(column: int, separator: str, part: int, start: int, length: int = -1, casing: Casing = Casing.NONE) -> Piece:
    return Piece(column, start, length, casing, ((separator, part),))


def split_split_substr(column: int, first: str, part: int, second: str, inner: int, start: int, length: int = -1, casing: Casing = Casing.NONE) -> Piece:
    return Piece(column, start, length, casing, ((first, part), (second, inner)))


Op = Constant | Piece


@dataclass(frozen=True)
class Program:
    """Concatenates what its operators give; null (None) as soon as one of them fails. No operator: the empty string."""

    ops: tuple[Op, ...] = ()

    def to_column(self, cells: Column | None = None) -> Column:
        cells = F.col("_cells") if cells is None else cells
        return F.concat(*[op.to_column(cells) for op in self.ops]) if self.ops else F.lit("")

    def apply(self, row: Sequence[str]) -> str | None:
        out = [op.apply(row) for op in self.ops]
        return None if None in out else "".join(out)

    @property
    def complexity(self) -> int:
        return len(self.ops)

    @property
    def columns(self) -> set[int]:
        """The source columns that are read."""
        return {op.column for op in self.ops if isinstance(op, Piece)}

    @property
    def constant(self) -> bool:
        return not self.columns

    def __str__(self) -> str:
        return " + ".join(map(str, self.ops)) or "<identity>"

    def to_json(self) -> str:
        return json.dumps([asdict(op) for op in self.ops])

    @classmethod
    def from_json(cls, text: str) -> Program:
        ops: list[Op] = []
        for x in json.loads(text):
            if x["kind"] == "constant":
                ops.append(Constant(x["text"]))
            else:
                ops.append(Piece(x["column"], x["start"], x["length"], Casing(x["casing"]), tuple((s, p) for s, p in x["splits"])))
        return cls(tuple(ops))
