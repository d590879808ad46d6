"""Language ID with hyperdimensional profiles.

Every character has a random vector of +1 and -1, drawn from its code point. An n-gram binds the vectors of its
characters, each permuted by its place; a document bundles (adds up) the vectors of its n-grams; a language's
prototype bundles its training documents. The language of a document is the prototype with the largest cosine.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from keyweave.llm.common import materialize, trim_memory
from keyweave.workers import ship

DIMENSIONS = 1024
GRAM = 3
#: Bound on the labelled documents that a language's prototype is made of.
DOCS_PER_LANGUAGE = 1500
#: Languages whose shares are broadcast; of more than these the texts are joined by a shuffle.
SMALL = 10_000
UNKNOWN = "und"
_CACHED = 1 << 15  # n-gram vectors that a worker keeps


@functools.cache
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@functools.lru_cache(maxsize=1 << 14)
def letter(code: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=code)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams over lower-case letters, runs of anything else being one space, with their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    alpha = _alphabetic()[codes]
    if not alpha.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.where(alpha, codes, 32)
    codes = np.concatenate([[32], codes[alpha | np.concatenate([[False], alpha[:-1]])], [32]])
    if codes[-2] == 32:
        codes = codes[:-1]
    packed = codes[: len(codes) - GRAM + 1].copy()
    for i in range(1, GRAM):
        packed = packed << 21 | codes[i : len(codes) - GRAM + 1 + i]
    return np.unique(packed, return_counts=True)


class Encoder:
    """Document vectors; keeps the vectors of the n-grams seen last."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((_CACHED, DIMENSIONS), dtype=np.int8)

    def _row(self, gram: int) -> int:
        row = self.rows.get(gram)
        if row is None:
            row = self.rows[gram] = len(self.rows)
            v = np.ones(DIMENSIONS, dtype=np.int8)
            for place in range(GRAM):
                v = v * np.roll(letter(gram >> 21 * place & 0x1FFFFF), place)
            self.vectors[row] = v
        return row

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The document's vector in whole numbers; None without a letter."""
        found, counts = grams(text or "")
        if not len(found):
            return None
        out = np.zeros(DIMENSIONS, dtype=np.float64)
        for i in range(0, len(found), _CACHED // 4):
            part = found[i : i + _CACHED // 4].tolist()
            if len(self.rows) + len(part) > _CACHED:
                self.rows.clear()
            rows = [self._row(g) for g in part]
            n = counts[i : i + _CACHED // 4]
            kind = np.float32 if n.sum() < 1 << 24 else np.float64  # sums of whole numbers stay exact
            out += n.astype(kind) @ self.vectors[rows].astype(kind)
        return out


def training_rows(docs: DataFrame, limit: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """text and lang of at most ``limit`` labelled documents of each language outside the held-out fold, chosen by a hash of doc_id."""
    known = docs.select("text", "lang", "doc_id").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    share = materialize(known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(1.5 * limit) / F.count("*")).alias("share")), "languages")
    if share.count() <= SMALL:  # a name and a number each: texts need no shuffle by language, of which a few hold most
        share = F.broadcast(share)
    order = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    near = known.join(share, "lang").where(order < F.col("share") * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", F.xxhash64("text")))
    return near.withColumn("rank", rank).where(F.col("rank") <= limit).select("text", "lang")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(rows: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes by language, learned from text and lang of training rows (a bounded sample); DIMENSIONS numbers a language."""
    ship(rows.sparkSession)

    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, sums = Encoder(), {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                if (v := enc.bundle(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + v
        if sums:
            yield pd.DataFrame({"lang": list(sums), "sum": [v.tobytes() for v in sums.values()]})

    def total(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "sum": [sum(np.frombuffer(x) for x in part["sum"]).tobytes()]})

    got = rows.mapInPandas(bundles, "lang string, sum binary").groupBy("lang").applyInPandas(total, "lang string, sum binary").collect()
    return {r["lang"]: np.frombuffer(r["sum"]) for r in sorted(got, key=lambda r: r["lang"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """row (the columns of docs), lang_pred and score (the cosine, at least 0), one row per row of docs.

    Null text and text without a letter are ``und`` with score 0, as everything is when there is no prototype. Of equal
    cosines the first language by name wins. Only the text is looked at; texts of any length are read whole.
    """
    ship(docs.sparkSession)
    names, place = list(prototypes), docs.columns.index(text)
    unit = np.array([v / max(np.linalg.norm(v), 1e-9) for v in prototypes.values()]).reshape(len(names), DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder()
        for b in batches:
            langs, scores = [], []
            for t in pc.struct_field(b.column(0), [place]).to_pylist():
                v = enc.bundle(t) if names else None
                if v is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    cos = unit @ v / max(np.linalg.norm(v), 1e-9)
                    k = int(np.argmax(cos))
                    langs.append(names[k])
                    scores.append(min(1.0, max(0.0, float(cos[k]))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])
        del enc
        trim_memory()

    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return src.mapInArrow(run, StructType([src.schema[0], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def _size_class(text: Column) -> Column:
    """The binary order of magnitude of a text's length."""
    return F.floor(F.log2(F.greatest(F.length(text), F.lit(1)))).cast("int")


def least_scores(rows: DataFrame, prototypes: dict[str, np.ndarray], share: float = 0.01, of: float = 0.5, enough: int = 10) -> dict[int, float]:
    """By order of magnitude of the length: ``of`` times the cosine that all but ``share`` of the training rows reach. Orders with fewer
    than ``enough`` rows have none."""
    scored = predict(rows, prototypes).where(F.col("lang_pred") != UNKNOWN)
    got = scored.groupBy(_size_class(F.col("row.text")).alias("size")).agg(F.count("*").alias("n"), F.percentile("score", F.lit(share)).alias("low")).collect()
    return {r["size"]: of * r["low"] for r in got if r["n"] >= enough}


def languages_query(docs: DataFrame) -> DataFrame:
    """doc_id, whether the document is held out from learning, its language and the cosine."""
    d = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(d, fit(training_rows(docs))).select("row.doc_id", "row.held_out", "lang_pred", "score")


def reject_unknown(docs: DataFrame) -> DataFrame:
    """docs without those that have no letter, or whose best cosine is far below that of training rows of their length.

    If nothing can be learned, all documents with a letter stay. The columns stay as they are, whatever their names; repeated rows are
    judged alike, an empty table stays empty.
    """
    rows = materialize(training_rows(docs), "training")
    prototypes = fit(rows)
    if not prototypes:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    d, size = predict(docs, prototypes), _size_class(F.col("row.text"))
    low = F.lit(0.0)
    for k, v in sorted(least_scores(rows, prototypes).items()):  # longer texts score higher, so an order without rows takes the next shorter one's
        low = F.when(size >= k, v).otherwise(low)
    kept = d.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= low))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
