"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyweave.llm import fingerprint, langid, linededup, neardup, packing, pii, segment, topk, urlfilter, warczip
from keyweave.llm.common import table
from keyweave.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans_query(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints_query(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top10_query(table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages_query(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.archives_query(table(spark, sf_dir, "pages"))


def op7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segments_query(table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.lines_query(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_query(table(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes_query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_fingerprints": op2_fingerprints,
    "op3_topk": op3_topk,
    "op4_url_filter": op4_url_filter,
    "op5_language": op5_language,
    "op6_warc": op6_warc,
    "op7_segments": op7_segments,
    "op8_lines": op8_lines,
    "op9_packing": op9_packing,
    "op10_neardup": op10_neardup,
}
