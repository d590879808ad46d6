"""Exact top-k search by inner product with vector-approximation files.

The approximation file is a table of its own: a row per chunk of vectors, with a byte for each component (its cell between the
chunk's least and greatest value in that dimension). A search meets blocks of the file with blocks of queries: one product of
cells and scaled queries bounds every score from below and above. Vectors whose upper bound is beneath a query's kth lower bound are
out; of the others the exact vectors are fetched and read from the best bound down until the kth result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyweave.llm.common import materialize
from keyweave.workers import ship

CELLS = 256
#: Vectors of a chunk; chunks and queries that meet in one task, about.
CHUNK, CHUNKS, QUERIES = 1024, 8, 2048
#: Queries whose bounds are held at once, and exact vectors read at a time.
_ROWS, _READ = 128, 64
SCALE = 1024
_LONG = 2**63 - 1


def whole(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(SCALE * x) of equally long vectors, as doubles: infinite beyond 1.7e305."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * np.stack(vectors).astype(np.float64))


def exact_scores(vectors: list[np.ndarray], query: np.ndarray) -> list[int]:
    """Inner products of floor(SCALE * x) in whole numbers of any size."""
    v, q = whole(vectors), whole([query])[0]
    if np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * v.shape[1] < 2.0**53:
        return [int(s) for s in v @ q]
    exact = lambda x: [int(np.floor(SCALE * y)) if abs(y) < 2.0**53 else SCALE * int(y) for y in np.asarray(x, np.float64).tolist()]
    own = exact(query)
    return [sum(a * b for a, b in zip(exact(x), own, strict=True)) for x in vectors]


def sortable(score: int) -> str:
    """Text in the order of the scores: sign, number of digits, digits; of a negative one the complement of each."""
    digits = str(abs(score))
    text = f"{len(digits):06d}{digits}"
    return "1" + text if score >= 0 else "0" + text.translate(str.maketrans("0123456789", "9876543210"))


class Chunk:
    """Cells of some vectors: component d of a vector in cell c lies between low + c * width and low + (c + 1) * width."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        self.cells, self.low, self.width = cells, low, width

    @classmethod
    def of(cls, vectors: np.ndarray) -> Chunk:
        with np.errstate(over="ignore", invalid="ignore"):
            low, high = vectors.min(axis=0), vectors.max(axis=0)
            width = (high / CELLS - low / CELLS) * (1 + 1e-9)
            cells = np.clip(np.nan_to_num((vectors - low) / np.where(width > 0, width, 1)), 0, CELLS - 1).astype(np.uint8)
        return cls(cells, low, width)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, [query, vector]; unbounded where doubles are too small."""
        with np.errstate(over="ignore", invalid="ignore"):
            step = queries * self.width
            slack = 1e-9 * (np.abs(queries) @ (np.abs(self.low) + CELLS * self.width))[:, None] + 1e-9
            lower = step @ self.cells.T.astype(np.float64) + (queries @ self.low + np.minimum(step, 0).sum(axis=1))[:, None]
            upper = lower + np.abs(step).sum(axis=1)[:, None] + slack
            lower = lower - slack
        return np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)


def approximation_file(vectors: DataFrame) -> DataFrame:
    """size, ids, hashes, cells, low and width of every chunk, as a table. vectors: vec_id, embedding and h1, h2 (its hash)."""

    def chunk(size: int, rows: pd.DataFrame) -> dict:
        c = Chunk.of(whole(rows["embedding"].tolist()))
        ids, hashes = rows["vec_id"].to_numpy(np.int64), rows[["h1", "h2"]].to_numpy(np.int64)
        return {"size": size, "ids": ids.tobytes(), "hashes": hashes.tobytes(), "cells": c.cells.tobytes(), "low": c.low.tobytes(), "width": c.width.tobytes()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        for batch in batches:
            for size, part in batch.groupby(batch["embedding"].map(len)):
                rows = pd.concat([*held.pop(size, []), part], ignore_index=True)
                full = len(rows) // CHUNK * CHUNK
                for i in range(0, full, CHUNK):
                    yield pd.DataFrame([chunk(size, rows.iloc[i : i + CHUNK])])
                if full < len(rows):
                    held[size] = [rows.iloc[full:]]
        for size, rows in held.items():
            yield pd.DataFrame([chunk(size, pd.concat(rows, ignore_index=True))])

    return materialize(vectors.mapInPandas(run, "size int, ids binary, hashes binary, cells binary, low binary, width binary"), "vector-approximations")


def _survivors(k: int):
    """Of a block of chunks and a block of queries: the vectors whose upper bound reaches the query's kth lower bound in the block."""

    def run(chunks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(chunks) and len(asked):
            ids = np.concatenate([np.frombuffer(x, np.int64) for x in chunks["ids"]])
            hashes = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in chunks["hashes"]])
            # of equal vectors none but those with the k + 1 least ids can be in a result
            order = np.lexsort([ids, hashes[:, 1], hashes[:, 0]])
            h = hashes[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)])
            nth = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            use = np.zeros(len(ids), dtype=bool)
            use[order[nth <= k]] = True
            parts, at = [], 0
            for x in chunks.itertuples():
                n = len(x.ids) // 8
                mine = use[at : at + n]
                at += n
                if mine.any():
                    parts.append(Chunk(np.frombuffer(x.cells, np.uint8).reshape(n, x.size)[mine], np.frombuffer(x.low), np.frombuffer(x.width)))
            ids, hashes = ids[use], hashes[use]
            for i in range(0, len(asked), _ROWS):
                own = asked["query_id"].to_numpy(np.int64)[i : i + _ROWS]
                q = whole(asked["vector"].tolist()[i : i + _ROWS])
                lower, upper = (np.concatenate(x, axis=1) for x in zip(*(c.bounds(q) for c in parts), strict=True))
                self = ids[None, :] == own[:, None]
                lower[self], upper[self] = -np.inf, -np.inf
                floor = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) >= k else np.full(len(own), -np.inf)
                a, b = np.nonzero((upper >= floor[:, None]) & ~self)
                out.append(pd.DataFrame({"query_id": own[a], "vec_id": ids[b], "h1": hashes[b, 0], "h2": hashes[b, 1], "lower": lower[a, b], "upper": upper[a, b]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "h1": [], "h2": [], "lower": [], "upper": []})

    return run


def _read(k: int):
    """The k best of a query's survivors, whose exact vectors are read from the best upper bound down."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("upper", ascending=False, kind="stable")
        upper, ids, query = part["upper"].to_numpy(), part["vec_id"].tolist(), part["vector"].iloc[0]
        best: list[tuple[int, int]] = []
        for i in range(0, len(part), _READ):
            if len(best) == k and upper[i] < -best[-1][0]:
                break
            scores = exact_scores(part["embedding"].tolist()[i : i + _READ], query)
            best = sorted(best + [(-s, v) for s, v in zip(scores, ids[i : i + _READ], strict=True)])[:k]
        rows = [(part["query_id"].iloc[0], j, v, max(-_LONG - 1, min(_LONG, -s))) for j, (s, v) in enumerate(best, 1)]
        return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])

    return run


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k highest scores of every query over the rows of df but its own, ties to the smaller id.

    Rows without id, and vectors that are null, empty or hold null or non-finite components, take no part; vectors are
    scored against those of equal length only. Rows of df with the query's id count as its own. A query id that occurs
    more than once is asked once, with its least vector. Repeated rows count each. No query or no vector gives no row. Scores are
    compared in whole numbers of any size, and shown as the nearest long.
    """
    ship(df.sparkSession)
    ok = lambda d: d.where(F.col(f"`{vec_id}`").isNotNull() & (F.size(f"`{vector}`") > 0) & F.forall(f"`{vector}`", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("embedding"))
    vectors = ok(df).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(3), "embedding")})
    asked = materialize(ok(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("vector")), "queries")
    file = approximation_file(vectors)
    across, down = -(-file.count() // CHUNKS) or 1, -(-asked.count() // QUERIES) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    chunks = file.withColumns({"c": F.pmod(F.xxhash64("ids"), F.lit(across)).cast("int"), "q": every(down)})
    blocks = asked.select("query_id", "vector", F.size("vector").alias("size"), F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int").alias("q"), every(across).alias("c"))
    key = ["size", "c", "q"]
    schema = "query_id long, vec_id long, h1 long, h2 long, lower double, upper double"
    found = materialize(chunks.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInPandas(_survivors(k), schema), "survivors")
    # the kth lower bound over all blocks
    best = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    floor = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(float("-inf")).alias("floor"))
    equal = Window.partitionBy("query_id", "h1", "h2").orderBy("vec_id")
    left = found.join(floor, "query_id").where(F.col("upper") >= F.col("floor")).withColumn("nth", F.row_number().over(equal)).where(F.col("nth") <= k)
    # as a table, so that Spark knows its size: where it is small it is broadcast, and the vectors are not shuffled
    left = materialize(left.select("query_id", "vec_id", "h1", "h2", "upper"), "fetched")
    exact = vectors.join(left.select("vec_id", "h1", "h2").distinct(), ["vec_id", "h1", "h2"], "left_semi")
    exact = exact.groupBy("vec_id", "h1", "h2").agg(F.first("embedding").alias("embedding"))
    read = left.join(exact, ["vec_id", "h1", "h2"]).join(asked, "query_id")
    return read.select("query_id", "vec_id", "upper", "embedding", "vector").groupBy("query_id").applyInPandas(_read(k), "query_id long, rank int, vec_id long, score long")


def top10_query(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, embeddings.where(F.col("vec_id") % 100 == 0), 10)
