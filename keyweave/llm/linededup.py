"""Line dedup with a log-template tree of fixed depth.

A line is parsed to a leaf of the tree: its number of tokens, then its first LEADING tokens. Tokens with a digit are variable
fields from the start. Below a leaf, a template is the rest of the line as it is, or with any two of PARTS parts of it
generalised to wildcards, so that lines whose fields vary in one or two places share a template. A template that recurs across
documents is dropped everywhere but in its first document. Only built-in Spark functions run.

Leaves that only one document has are left at once; of the others each distinct line makes its templates once. Keys that
stand for lines or templates have 128 bits or more.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import lookup_join, materialize

LEADING, PARTS = 3, 6
#: Tokens behind the leading ones that wildcards must leave as they are.
LEAST = 4
_NULL_ID = -(2**63)


def tokens(line: Column) -> Column:
    """White-space tokens; those with a digit are ``<*>``."""
    fields = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<!\S)\S*?[0-9]\S*", "<*>")).otherwise(line)
    return F.array_remove(F.split(fields, r"\s+"), "")


def _cut(n: Column, j: int) -> Column:
    """How many tokens of a line of n stand before its j-th part."""
    return F.floor((n - LEADING) * j / PARTS).cast("int") + LEADING


def parts(toks: Column) -> Column:
    """A hash of each part of the rest of a line; null where the line is too short for a wildcard."""
    n = F.size(toks)
    part = lambda j: F.hash(F.slice(toks, _cut(n, j) + 1, _cut(n, j + 1) - _cut(n, j)))
    return F.when(n > LEADING + LEAST, F.array(*[part(j) for j in range(PARTS)]))


def templates(leaf: Column, n: Column, part: Column) -> Column:
    """The keys of a line's templates with wildcards for two parts of it."""
    keys = []
    for a, b in combinations(range(PARTS), 2):
        left = n - LEADING - sum(_cut(n, j + 1) - _cut(n, j) for j in (a, b))
        same = [F.get(part, F.lit(j)) for j in range(PARTS) if j not in (a, b)]
        keys.append(F.when(left >= LEAST, F.unhex(F.md5(F.concat_ws(",", F.lit(f"{a}{b}"), n, leaf, *same)))))
    return F.when(part.isNotNull(), F.array_compact(F.array(*keys))).otherwise(F.array().cast("array<binary>"))


def parsed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc, rid (of equal rows the same), pos, line (a key), leaf, n and part of every line with a token."""
    rid = _row_id(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    # ids first: beside the generator they would be worked out for every line
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`"), F.lit(_NULL_ID)).alias("doc"), rid.alias("rid"), F.split(F.col(f"`{text}`"), "\n").alias("split"))
    lines = rows.select("doc", "rid", F.posexplode("split").alias("pos", "line"))
    # a condition on the tokens would be pushed below them and have lines parsed twice
    lines = lines.where(F.col("line").rlike(r"\S")).select("doc", "rid", "pos", tokens(F.col("line")).alias("toks"))
    n = F.size("toks")
    line = F.unhex(F.md5(F.concat_ws(" ", "toks")))
    return lines.select("doc", "rid", "pos", line.alias("line"), F.xxhash64(n, F.slice("toks", 1, LEADING)).alias("leaf"), n.alias("n"), parts(F.col("toks")).alias("part"))


def _row_id(doc_id: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), text)))


def repeated(lines: DataFrame) -> DataFrame:
    """doc, rid and pos of the lines of which an earlier document has a template. lines: what parsed() gives, as a table, which is deleted."""
    leaves = lines.groupBy("leaf").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("size")).where("low < high")
    met = lookup_join(lines, leaves.select("leaf", "low", "size"), "leaf", "size", lines.count(), ["rid", "pos"]).where(F.col("low").isNotNull())
    met = materialize(met.drop("low", "size"), "lines-met", drop=(lines,))
    total = met.count()
    once = met.groupBy("line").agg(*[F.first(c).alias(c) for c in ("leaf", "n", "part")], F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("size"))
    once = materialize(once, "lines-once")
    keyed = materialize(once.select("line", "first", "last", F.explode(templates(F.col("leaf"), F.col("n"), F.col("part"))).alias("key")), "line-templates")
    seen = keyed.groupBy("key").agg(F.min("first").alias("start"), F.max("last").alias("end"), F.count("*").alias("lines")).where("start < end and lines > 1")
    shared = lookup_join(keyed.select("line", "key"), seen.drop("end"), "key", "lines", keyed.count(), ["line"])
    earlier = shared.where(F.col("start").isNotNull()).groupBy("line").agg(F.min("start").alias("start"))
    origin = once.select("line", "first", "last", "size").join(earlier, "line", "left").withColumn("origin", F.least("first", "start"))
    hit = lookup_join(met.select("doc", "rid", "pos", "line"), origin.where("origin < last").select("line", "origin", "size"), "line", "size", total, ["rid", "pos"])
    return materialize(hit.where(F.col("origin") < F.col("doc")).select("doc", "rid", "pos"), "lines-repeated", drop=(met, once, keyed))


def _stripped(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """row (the columns of docs), text (what is left of it), n_lines and n_dropped (lines with a token that it had and lost)."""
    lines = materialize(parsed(docs, text, doc_id), "lines")  # read twice; parsing costs more than both reads
    gone = repeated(lines).groupBy("rid").agg(F.collect_set("pos").alias("gone"), F.count("*").alias("hits"))
    gone = gone.select("rid", "gone", (F.col("hits") / F.size("gone")).cast("long").alias("rows"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _row_id(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("rid"))
    out = lookup_join(rows, gone, "rid", "rows", docs.count(), ["row"])
    own = F.col("row").getField(text)
    split = F.split(own, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    left = F.get(F.transform(F.array(split), lambda s: F.array_join(F.transform(kept, lambda i: F.get(s, i)), "\n")), F.lit(0))
    full = F.size(F.filter(split, lambda p: p.rlike(r"\S")))
    counts = F.when(own.isNull(), 0).otherwise(full).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")
    return out.select("row", F.when(F.col("gone").isNull(), own).otherwise(left).alias("text"), *counts)


def drop_templates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", empty: bool = True) -> DataFrame:
    """docs with ``text`` less the lines of recurring templates; documents that lose all their lines stay only if ``empty``.

    Of the documents with a template the one with the smallest doc_id keeps its lines (rows without doc_id count as one
    document that comes first, rows with equal ids as one document). Lines without a token stay. Null text stays null.
    Repeated rows are treated alike, an empty table stays empty. All columns pass through, whatever their names.
    """
    d = _stripped(docs, text, doc_id)
    if not empty:
        d = d.where((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    return d.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def lines_query(docs: DataFrame) -> DataFrame:
    """doc_id, lines with a token, lines dropped, and length and digest of what is left of the text (null: empty)."""
    d = _stripped(docs.select("doc_id", "text"), "text", "doc_id")
    left = F.coalesce("text", F.lit(""))
    return d.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.length(left).cast("long").alias("n_chars"), F.sha2(left, 256).alias("text_sha256"))
