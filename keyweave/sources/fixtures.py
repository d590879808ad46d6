"""Benchmark cases on disk: JSON descriptions, CSV tables and ground truths; and generators of synthetic cases."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.functions.strings import java_trim
from keyweave.sources.table import JoinTable


@dataclass(frozen=True)
class Case:
    pair_id: str
    source_file: str
    source_keys: list[str]
    target_file: str
    target_keys: list[str]
    truth_file: str
    truth_source_keys: list[str]
    truth_target_keys: list[str]

    def source(self, spark: SparkSession, data: str) -> JoinTable:
        return JoinTable.from_csv(spark, str(Path(data, self.source_file)), self.source_keys, "source")

    def target(self, spark: SparkSession, data: str) -> JoinTable:
        return JoinTable.from_csv(spark, str(Path(data, self.target_file)), self.target_keys, "target")

    def truth(self, spark: SparkSession, data: str) -> DataFrame:
        return ground_truth(JoinTable.from_csv(spark, str(Path(data, self.truth_file))), len(self.truth_source_keys))


def load_case(path: Path) -> Case:
    x = json.loads(path.read_text(encoding="utf-8"))
    s, t, g = x["source"], x["target"], x["ground_truth"]
    return Case(x["pair_id"], s["file"], s["key_columns"], t["file"], t["key_columns"], g["file"], g.get("source_key_columns", []), g.get("target_key_columns", []))


def list_cases(roots: list[str], data: str) -> list[Case]:
    """The cases below the roots whose tables are there, the first of equal ids; folders that begin with _ are left out."""
    out: dict[str, Case] = {}
    for root in map(Path, roots):
        for folder in sorted(p for p in root.iterdir() if p.is_dir() and not p.name.startswith("_")) if root.is_dir() else []:
            if (folder / "fixture.json").is_file():
                case = load_case(folder / "fixture.json")
                if all(Path(data, f).is_file() for f in (case.source_file, case.target_file)):
                    out.setdefault(case.pair_id, case)
    return list(out.values())


def find_case(roots: list[str], data: str, pair_id: str) -> Case:
    for case in list_cases(roots, data):
        if case.pair_id == pair_id:
            return case
    raise FileNotFoundError(pair_id)


def ground_truth(table: JoinTable, source_keys: int) -> DataFrame:
    """src_fp and tgt_fp: the first cells joined by |, the rest by " | "; of equal sources the last row counts, blank sides do not."""
    part = lambda a, n, sep: F.array_join(F.slice("_cells", a, n), sep)
    rows = table.df.select("_rid", part(1, source_keys, "|").alias("src_fp"), part(source_keys + 1, max(1, table.width - source_keys), " | ").alias("tgt_fp"))
    full = rows.where(F.col("src_fp").rlike(r"[^\s|]") & F.col("tgt_fp").rlike(r"[^\s|]"))
    return full.groupBy("src_fp").agg(F.max_by("tgt_fp", "_rid").alias("tgt_fp"))


def bibliography(df: DataFrame, columns: list[str], separator: str = " | ") -> tuple[JoinTable, JoinTable]:
    """A source of the columns and a target ``record`` that joins them; rows in which one is blank are left out."""
    text = [java_trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns]
    rows = df.select(*text)
    for c in columns:
        rows = rows.where(F.col(c) != "")
    rows = rows.withColumn("_rid", F.monotonically_increasing_id())
    source = JoinTable(rows.select("_rid", F.array(*columns).alias("_cells")), columns, list(range(len(columns))), "source")
    target = JoinTable(rows.select("_rid", F.array(F.concat_ws(separator, *columns)).alias("_cells")), ["record"], [0], "target")
    return source, target


def read_dblp(spark: SparkSession, path: str, tag: str = "article") -> DataFrame:
    """authors, title and year of the records of an XML bibliography."""
    df = spark.read.format("xml").option("rowTag", tag).schema("author array<string>, title string, year string").load(path)
    return df.select(F.array_join("author", ", ").alias("authors"), "title", "year")


#: Target columns of the synthetic cases over a table (first, last, hour, minute, second, year, title, author1).
SYNTHETIC = {
    "userid": "concat(substring(first, 1, 1), last)",
    "nameconcat": "concat(first, last)",
    "time": "concat_ws(':', hour, minute, second)",
    "citeseer": "concat_ws(' ', year, title, author1)",
}


def synthetic(df: DataFrame, case: str, keys: list[str], seed: int = 42) -> tuple[JoinTable, JoinTable]:
    """A source with four noise columns and a shuffled target derived from its columns; df: the source's columns and a unique long id."""
    h = lambda i: F.xxhash64("id", F.lit(seed + i))
    noise = [F.pmod(h(0), F.lit(100_000)).cast("string").alias("noise_num"), F.hex(h(1)).alias("noise_code"), F.concat(F.pmod(h(2), F.lit(999)).cast("string"), F.lit(" Main St")).alias("noise_addr"), F.timestamp_seconds(F.pmod(h(3), F.lit(10**9))).cast("string").alias("noise_ts")]
    columns = [c for c in df.columns if c != "id"]
    source = JoinTable.from_df(df.select("*", *noise), keys, "id", "source")
    target = df.select(F.pmod(h(4), F.lit(1 << 62)).alias("id"), F.expr(SYNTHETIC[case]).alias("target")) if columns else df
    return source, JoinTable.from_df(target, ["target"], "id", "target")
