"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch is a table of cells (count, XOR of digests, XOR of check hashes); a digest goes to one cell in each of three
subtables. The sketches of two versions subtract cell by cell, common paragraphs cancel, and peeling cells that hold a
single digest recovers the paragraphs that differ. If peeling gets stuck, larger sketches are tried until one comes out.

A text's digests are dealt to shards, a power of two in number that follows the text; the fingerprint is the list of its shards'
sketches, each of the smallest size that can be peeled down to nothing. So a fingerprint holds all digests of its text and can be laid out
anew in any number of shards and cells: the likeness of two texts is a function of their fingerprints alone, and the work grows in
proportion to the text. Everything is an expression over arrays: no join, no shuffle and no Python run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A paragraph is a line, cut behind the first mark from LOW characters on, or at HIGH characters.
LOW, HIGH = 80, 128
PIECES = f"[^\n]{{{LOW - 1},{HIGH - 1}}}?[.,;:!?]|[^\n]{{1,{HIGH}}}"
#: Digests that a shard holds at most on average, and its cells of a subtable in the first try; each further try doubles them.
SHARD, CELLS = 4, 6
TRIES, ROUNDS = 12, 12
_CELL = "struct<c:bigint,k:bigint,h:bigint>"
#: Rows that ranges are cut at are chosen among about so many per range.
_SAMPLE = 16


def _bound(value: Column, f) -> Column:
    """f(value), with value worked out once, however often and in whatever inner function f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs. As a mark ends a paragraph, a change moves few of the cuts behind it."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(77))


def _places(d: Column, cells: Column) -> list[Column]:
    """The digest's cell in each of the three subtables."""
    return [(F.pmod(F.shiftrightunsigned(d, 16 * j + 8), cells) + j * cells).cast("int") for j in range(3)]


def sketch(ds: Column, cells: Column) -> Column:
    """The 3 * cells cells of an array of distinct digests."""
    placed = F.transform(ds, lambda d: F.struct(d.alias("d"), _check(d).alias("h"), *[p.alias(f"p{j}") for j, p in enumerate(_places(d, cells))]))
    empty = F.struct(*[F.lit(0).cast("bigint").alias(x) for x in "ckh"])
    added = lambda a, x: F.struct((a["c"] + 1).alias("c"), a["k"].bitwiseXOR(x["d"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h"))
    one = lambda xs, j: F.transform(F.sequence(j * cells, ((j + 1) * cells - 1).cast("int")), lambda i: F.aggregate(xs, empty, lambda a, x: F.when(x[f"p{j}"] == i, added(a, x)).otherwise(a)))
    return _bound(placed, lambda xs: F.concat(*[one(xs, j) for j in range(3)]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(cells: Column, size: Column) -> Column:
    """How many digests a sketch or a difference of sketches holds, counted by peeling; null if it gets stuck."""
    pure = lambda x: ((x["c"] == 1) | (x["c"] == -1)) & (_check(x["k"]) == x["h"])

    def without(cell: Column, i: Column, found: Column) -> Column:
        drop = lambda a, p: F.struct((a["c"] - p["c"]).alias("c"), a["k"].bitwiseXOR(p["k"]).alias("k"), a["h"].bitwiseXOR(p["h"]).alias("h"))
        return F.aggregate(found, cell, lambda a, p: F.when((p["p0"] == i) | (p["p1"] == i) | (p["p2"] == i), drop(a, p)).otherwise(a))

    def taken(cells: Column) -> Column:
        return F.array_distinct(F.transform(F.filter(cells, pure), lambda x: F.struct(x["c"].alias("c"), x["k"].alias("k"), x["h"].alias("h"), *[p.alias(f"p{j}") for j, p in enumerate(_places(x["k"], size))])))

    def round_(a: Column, _: Column) -> Column:
        # empty cells stay as they are; a pure cell's digest leaves its three cells
        left = lambda found: F.transform(a["cells"], lambda x, i: F.when((x["c"] == 0) & (x["k"] == 0), x).otherwise(without(x, i, found)))
        step = lambda found: F.when(F.size(found) == 0, F.struct(a["cells"].alias("cells"), a["n"].alias("n"), F.lit(True).alias("stop"))).otherwise(F.struct(left(found).alias("cells"), (a["n"] + F.size(found)).alias("n"), F.lit(False).alias("stop")))
        return F.when(a["stop"], a).otherwise(_bound(taken(a["cells"]), step))

    start = F.struct(cells.alias("cells"), F.lit(0).alias("n"), F.lit(False).alias("stop"))
    clear = lambda a: F.forall(a["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda a: F.when(clear(a), a["n"]))


def shards(n: Column) -> Column:
    """How many shards n digests are dealt to: the least power of two that leaves SHARD digests or fewer a shard on average."""
    return F.when(n > SHARD, F.pow(F.lit(2), F.ceil(F.log2(n / SHARD)))).otherwise(1).cast("int")


def _dealt(ds: Column, count: Column, f) -> Column:
    """f(number of the shard, digests) for every shard of ``count`` that has a digest; digests that are structs go by field d."""
    at = lambda x: F.pmod(x["d"], count).cast("int")
    ordered = F.sort_array(F.transform(ds, lambda x: F.struct(at(x).alias("s"), x.alias("x"))))

    def groups(xs: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | (F.get(xs, i)["s"] != F.get(xs, F.greatest(i - 1, F.lit(0)))["s"]))
        own = lambda start, end: _bound(F.slice(xs, start + 1, end - start), lambda g: f(F.get(g, F.lit(0))["s"], F.transform(g, lambda y: y["x"])))
        return _bound(first, lambda starts: F.transform(starts, lambda start, i: own(start, F.coalesce(F.get(starts, i + 1), F.size(xs)))))

    return _bound(ordered, groups)


def _first(f, kind: str) -> Column:
    """The first of f(cells) that is not null, cells growing from try to try."""
    cells = lambda i: (F.lit(CELLS) * F.pow(F.lit(2), i)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast(kind), lambda found, i: F.when(found.isNotNull(), found).otherwise(_bound(cells(i), f)))


def difference(a: Column, b: Column) -> Column:
    """How many digests only one of two texts has: the sketches of their shards, laid out for the larger text, subtracted and peeled."""
    tagged = lambda ds, side: F.transform(ds, lambda d: F.struct(d.alias("d"), F.lit(side).alias("side")))
    of = lambda group, side: F.transform(F.filter(group, lambda x: x["side"] == side), lambda x: x["d"])

    def one(_: Column, group: Column) -> Column:
        pair = F.struct(of(group, 0).alias("a"), of(group, 1).alias("b"))
        return _bound(pair, lambda p: _first(lambda cells: peel(subtract(sketch(p["a"], cells), sketch(p["b"], cells)), cells), "int"))

    both = F.concat(tagged(a, 0), tagged(b, 1))
    counts = _bound(shards(F.greatest(F.size(a), F.size(b))), lambda count: _dealt(both, count, one))
    return F.when(F.size(a) + F.size(b) == 0, 0).otherwise(F.aggregate(counts, F.lit(0), lambda n, x: n + x))


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two sets of paragraphs from their sizes and the size of their difference; 1 if both are empty."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise((both - difference(a, b)) / both)


def _as_text(cells: Column) -> Column:
    """The cells that are not empty as ``place:count:digest:check``, in hexadecimal."""
    written = F.transform(cells, lambda x, i: F.when(x["c"] != 0, F.concat_ws(":", F.hex(i), F.hex(x["c"]), F.hex(x["k"]), F.hex(x["h"]))))
    return F.array_join(written, ",")


def published(ds: Column) -> Column:
    """The fingerprint of a text with these digests: ``shards;shard=cells=…;shard=cells=…``, shards without a digest left out."""

    def one(number: Column, group: Column) -> Column:
        def attempt(own: Column, cells: Column) -> Column:
            return _bound(sketch(own, cells), lambda t: F.when(peel(t, cells).isNotNull(), F.concat_ws("=", F.hex(number), F.hex(cells), _as_text(t))))

        return _bound(F.transform(group, lambda x: x["d"]), lambda own: _first(lambda cells: attempt(own, cells), "string"))

    text = _bound(shards(F.size(ds)), lambda count: F.concat_ws(";", F.hex(count), F.array_join(_dealt(F.transform(ds, lambda d: F.struct(d.alias("d"))), count, one), ";")))
    return F.when(F.size(ds) == 0, "1").otherwise(text)


def fingerprint(text: Column) -> Column:
    """The published sketches of a text as hexadecimal text."""
    return _bound(digests(text), published)


def next_document(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, digests, next_text and next_digests: of the next document by descending doc_id, after the last of the first.

    Rows are ordered by (doc_id, hash of the text) and cut into ranges at such pairs, taken from a bounded sample; one shuffle
    deals each document to its range, and the first document of a range also to the range before it, which it follows. Null
    text counts as empty, null ids come last, documents with equal ids are ordered by a hash of their text. A lone document is its own
    next one.
    """
    spark = docs.sparkSession
    buckets = buckets or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = -(2**63)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(low)), F.xxhash64("text")
    d = d.select("doc_id", "text", key[0].alias("_id"), key[1].alias("_h"))
    total, first = d.agg(F.count("*"), F.max(F.struct("_id", F.bitwise_not("_h").alias("h")))).first()
    every = max(1, total // (buckets * _SAMPLE))
    got = sorted(map(tuple, d.where(F.pmod(F.xxhash64("_id", "_h"), F.lit(every)) == 0).select("_id", "_h").distinct().limit(8 * buckets * _SAMPLE).collect()), key=lambda r: (-r[0], r[1]))
    start = (first[0], ~first[1]) if first is not None else (0, 0)
    cuts = [start] + [x for x in got[_SAMPLE // 2 :: max(1, len(got) // buckets)] if x != start]
    ids, hashes = (F.split(F.lit(",".join(str(c[i]) for c in cuts)), ",").cast("array<bigint>") for i in (0, 1))  # folded to literals
    middle = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
    reached = lambda i: (F.get(ids, i) > F.col("_id")) | ((F.get(ids, i) == F.col("_id")) & (F.get(hashes, i) <= F.col("_h")))
    halve = lambda a, _: _bound(middle(a), lambda m: F.when(reached(m), F.struct(m.alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), m.alias("hi"))))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve, lambda a: a["lo"])
    d = d.withColumn("_b", found)
    here = F.struct(F.col("_b").alias("b"), F.lit(0).alias("follows"))
    before = F.struct(F.pmod(F.col("_b") - 1, F.lit(len(cuts))).alias("b"), F.lit(1).alias("follows"))
    cut = (F.get(ids, F.col("_b")) == F.col("_id")) & (F.get(hashes, F.col("_b")) == F.col("_h"))
    d = d.withColumn("_digests", digests(F.col("text"))).withColumn("_at", F.explode(F.when(cut, F.array(here, before)).otherwise(F.array(here))))
    order = Window.partitionBy(F.col("_at.b")).orderBy(F.col("_at.follows"), F.col("_id").desc(), "_h", "text")
    d = d.withColumn("_next", F.lead(F.struct("text", F.col("_digests").alias("digests"))).over(order)).where(F.col("_at.follows") == 0)
    return d.select("doc_id", "text", F.col("_digests").alias("digests"), F.col("_next.text").alias("next_text"), F.col("_next.digests").alias("next_digests"))


def fingerprints_query(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike its fingerprint is to that and to the next document's."""
    d = next_document(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    d = d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "digests", digests(F.col("edited")).alias("edited"), "next_digests")
    near = lambda c: likeness(F.col("digests"), F.col(c))
    return d.select("doc_id", "n_chars", "edited_sha256", published(F.col("digests")).alias("fingerprint"), published(F.col("edited")).alias("edited_fingerprint"), near("edited").alias("near_edited"), near("next_digests").alias("near_next"))
