"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. Shingles are SHINGLE words of the lower-cased text; the k-th use of a shingle in a text is an element of its own, so that sets of
   elements stand for term frequencies. An element weighs 1 to 1 + RARE, by the share of documents that have it (see
   inverse_frequencies).
2. Every document draws SAMPLES consistent weighted samples of its elements (Ioffe 2010); BANDS hashes of ROWS samples each are
   its keys.
3. Up to FULL texts with an equal key are all candidates of one another; texts of a hotter key are candidates with the key's most
   connected text. Candidates are verified by the exact weighted Jaccard similarity of their whole texts; connected components of
   the links, by hooking and pointer jumping over tables, are classes so far.
4. What the bands leave out is found exactly: two texts that are alike share an element of their prefixes, their first elements in
   the order of document frequencies (prefix filter). All texts with such an element in common that are not in one class yet and could
   be alike by their places in it (positional filter) are compared: up to FULL of them as pairs; more in blocks, two of which meet
   in a task that gives no more links than join its classes. So no table grows with the pairs of a group. Sketches meet first, which
   bound what two texts have in common from above; whole texts go only where these leave a partner.
   Components of these links join the classes to the final ones.

No link is missed: classes are the components of all pairs with a similarity of ``least`` or more.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.llm.common import HOT_LEAST, discard, lookup_join, materialize, settings, trim_memory
from keyweave.workers import ship

SHINGLE, SIMILARITY = 5, 0.8
BUCKETS = 1 << 18
ROWS, BANDS = 4, 16
SAMPLES = ROWS * BANDS
#: What a shingle of one document weighs more than one of all documents. Small, as the shingles that near copies share occur in many
#: documents and those in which they differ do not: large differences would push copies of a large group below SIMILARITY.
RARE = 0.1
#: The share of documents below which elements count as equally rare.
FLOOR = 0.01
#: Texts that are candidates each with each: of a band key, or of a prefix element.
FULL = 16
#: Elements and texts of a block, two of which are compared in a task.
BLOCK_ELEMENTS, BLOCK_TEXTS = 1 << 18, 1 << 10
#: Elements of more texts of two blocks are compared by a matrix product, others pair by pair.
_DENSE = 32
#: Prefix elements that a task sorts.
_DEALT = 1 << 19
_NULL_ID = -(2**63)
_BLOCK = 1 << 12  # buckets whose counts travel together
_CHUNK = 1024  # shingles whose samples are drawn at once; more do not fit a core's cache
_BLOOM = "spark.sql.optimizer.runtime.bloomFilter"
_BLOOM_BITS = 1 << 26  # as many as Spark allows


def normalized(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Hashes of all runs of SHINGLE words of a text from one polynomial prefix hash of its bytes."""

    _BASE = 0x9E3779B97F4A7C15
    _INVERSE = pow(_BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self.value = np.random.Generator(np.random.Philox(key=10)).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.power = self.back = np.empty(0, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power), 1 << 14)
            for name, base in (("power", self._BASE), ("back", self._INVERSE)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, text: str) -> np.ndarray:
        """The hashes of a text's elements, sorted. A text of fewer words has one shingle, an empty text none."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if not len(raw):
            return np.empty(0, np.uint64)
        self._grow(len(raw) + 1)
        prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.value[raw] * self.power[: len(raw)], out=prefix[1:])
        spaces = np.flatnonzero(raw == 32)
        starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(raw)]])
        k = min(SHINGLE, len(starts))
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
        found, n = np.unique(_mix((prefix[ends] - prefix[starts]) * self.back[starts]), return_counts=True)
        again = np.flatnonzero(n > 1)
        if not len(again):
            return found
        more = n[again] - 1
        use = np.arange(1, more.sum() + 1) - np.repeat(np.cumsum(more) - more, more)
        return np.unique(np.concatenate([found, _mix(np.repeat(found[again], more) + use.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))]))


@functools.cache
def _draws() -> tuple[np.ndarray, ...]:
    """Tables of r ~ Gamma(2, 1), 1 / r, ln c with c ~ Gamma(2, 1), and beta ~ U(0, 1), and a multiplier per sample."""
    g = np.random.Generator(np.random.Philox(key=2010))
    r, c, beta = g.gamma(2, 1, 1 << 16), g.gamma(2, 1, 1 << 16), g.random(1 << 16)
    r = np.maximum(r, 1e-3)
    tables = [x.astype(np.float32) for x in (r, 1 / r, np.log(c), beta)]
    return *tables, g.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)


@functools.cache
def _room() -> tuple[np.ndarray, ...]:
    """What samples() writes to: new arrays of this size would cost as much as what is worked out in them."""
    return tuple(np.empty(SAMPLES * _CHUNK, dtype=d) for d in (np.uint64, np.uint64, np.intp, np.intp, np.float32, np.float32, np.float32))


def weights(elements: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return idf[(elements % np.uint64(BUCKETS)).astype(np.int64)]


def samples(hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples; two sets agree in each with a probability of their weighted Jaccard similarity."""
    r, inverse, ln_c, beta, factor = _draws()
    best, out = np.full(SAMPLES, np.inf, dtype=np.float32), np.zeros(SAMPLES, dtype=np.uint64)
    ln_w = np.log(weight).astype(np.float32)
    row, held = np.arange(SAMPLES), _room()
    for i in range(0, len(hashes), _CHUNK):
        h = hashes[i : i + _CHUNK]
        drawn, more, at, at_r, t, b, ln_a = (x[: SAMPLES * len(h)].reshape(SAMPLES, len(h)) for x in held)
        # r, c and beta are looked up by bits of their own
        np.multiply(h[None, :], factor[:, None], out=drawn)
        np.right_shift(drawn, np.uint64(31), out=more)
        drawn ^= more
        drawn *= np.uint64(0xD6E8FEB86659FD93)
        np.right_shift(drawn, np.uint64(48), out=at_r.view(np.uint64))
        halves = drawn.view(np.uint16).reshape(SAMPLES, len(h), 4)
        at[:] = halves[:, :, 2]
        beta.take(at, out=b, mode="clip")
        inverse.take(at_r, out=t, mode="clip")
        t *= ln_w[None, i : i + _CHUNK]
        t += b
        np.floor(t, out=t)
        np.subtract(t, b, out=b)
        b += np.float32(1)
        r.take(at_r, out=ln_a, mode="clip")
        b *= ln_a
        at[:] = halves[:, :, 1]
        ln_c.take(at, out=ln_a, mode="clip")
        ln_a -= b
        k = np.argmin(ln_a, axis=1)
        least = ln_a[row, k]
        new = least < best
        best[new] = least[new]
        out[new] = _mix(h[k[new]] + t[row, k][new].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """The keys of samples [..., SAMPLES]."""
    keys, sample = np.arange(BANDS, dtype=np.uint64), sample.reshape(*sample.shape[:-1], BANDS, ROWS)
    for j in range(ROWS):
        keys = _mix(keys * np.uint64(31) + sample[..., j])
    return keys.view(np.int64)


def sketch(elements: np.ndarray) -> bytes:
    """How many elements have each beginning, in four bits; as many beginnings as a power of two of at least len(elements). Empty if four bits do not do."""
    bits = max(6, (len(elements) - 1).bit_length())
    n = np.bincount((elements >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return b"" if n.max() > 15 else (n[::2] | n[1::2] << 4).astype(np.uint8).tobytes()


def _counts(sketches: list[bytes], width: int) -> np.ndarray:
    """What sketches of one length count, [sketch, beginning], for ``width`` beginnings or fewer of them."""
    raw = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), -1)
    out = np.stack([raw & 15, raw >> 4], axis=2).reshape(len(raw), width, -1)
    return out[:, :, 0] if out.shape[2] == 1 else out.sum(axis=2, dtype=np.int32)


def _by_length(sketches: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    size = np.fromiter(map(len, sketches), dtype=np.int64, count=len(sketches))
    for n in np.unique(size[size > 0]).tolist():
        yield n, np.flatnonzero(size == n)


def common_at_most(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """At least as many elements as each of a's texts has in common with the one of b at its place."""
    out = np.full(len(a), np.inf)
    for n, i in _by_length(a):
        for m, j in _by_length([b[k] for k in i]):
            at, width = i[j].tolist(), 2 * min(n, m)
            out[at] = np.minimum(_counts([a[k] for k in at], width), _counts([b[k] for k in at], width)).sum(axis=1, dtype=np.int64)
    return out


def partners(a: list[bytes], b: list[bytes], able: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Those of the pairs [a, b] in ``able`` that may have ``least`` elements in common by their sketches."""
    out = able.copy()
    for n, i in _by_length(a):
        for m, j in _by_length(b):
            i_, j_ = i[able[np.ix_(i, j)].any(axis=1)], j[able[np.ix_(i, j)].any(axis=0)]
            if not len(i_):
                continue
            width = 2 * min(n, m)
            one, two = _counts([a[k] for k in i_], width), _counts([b[k] for k in j_], width)
            both = np.zeros((len(i_), len(j_)), dtype=np.float32)
            for k in range(1, int(min(one.max(), two.max())) + 1):  # the sum of minima is that of all k of how often both are at least k
                held = np.flatnonzero((one >= k).any(axis=0) & (two >= k).any(axis=0))
                both += (one[:, held] >= k).astype(np.float32) @ (two[:, held] >= k).astype(np.float32).T
            out[np.ix_(i_, j_)] &= both >= least[np.ix_(i_, j_)]
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two sets of (sorted elements, weights); an element weighs the same in both."""
    _, i, _ = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(a[1][i].sum())
    total = float(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def least_plain(least: float) -> float:
    """The least similarity of sets with weights of 1 to 1 + RARE that have a weighted similarity of ``least``."""
    return least / (least + (1 + RARE) * (1 - least))


def frequencies(texts: DataFrame) -> np.ndarray:
    """The documents with an element in it, of every bucket. texts: a row per text, which _n documents have."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, df = Shingles(), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text, n in zip(batch["_norm"], batch["_n"], strict=True):
                h = shingles(text)
                df[(h % np.uint64(BUCKETS)).astype(np.int64)] += n  # once for each bucket
        yield pd.DataFrame({"block": range(BUCKETS // _BLOCK), "df": [x.tobytes() for x in df.reshape(-1, _BLOCK)]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": part["block"].iloc[:1], "df": [sum(np.frombuffer(x, np.int64) for x in part["df"]).tobytes()]})

    df = np.zeros(BUCKETS, dtype=np.int64)
    for r in texts.select("_norm", "_n").mapInPandas(count, "block int, df binary").groupBy("block").applyInPandas(add, "block int, df binary").collect():
        df[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["df"], np.int64)
    return df


def idf_of(df: np.ndarray, total: int) -> np.ndarray:
    """1 + RARE * ln(share) / ln(FLOOR) of every bucket, share being the documents with an element in it, from FLOOR on, to all.

    Shares are looked at from FLOOR on only, where the elements of other texts that fall into the same bucket matter little: a
    bucket has about one in BUCKETS of each document's elements, 0.1 % of documents of 300 words, however many documents there are.
    """
    return 1 + RARE * np.log(np.clip(df / max(1, total), FLOOR, 1)) / np.log(FLOOR)


def inverse_frequencies(texts: DataFrame, total: int) -> np.ndarray:
    """The weights of all buckets by the texts of column _norm, a document each."""
    return idf_of(frequencies(texts.select("_norm", F.lit(1).cast("long").alias("_n"))), total)


def prefix(elements: np.ndarray, df: np.ndarray, plain: float) -> np.ndarray:
    """The first n - ceil(plain * n) + 1 of n sorted elements by (frequency of their bucket, element), an order of all elements.

    Two texts with a plain similarity of ``plain`` or more share one of these: the first of all that they share.
    """
    n = len(elements)
    order = np.argsort(df[(elements % np.uint64(BUCKETS)).astype(np.int64)], kind="stable")
    return elements[order[: n - math.ceil(plain * n - 1e-9) + 1]]


def sign(texts: DataFrame, df: np.ndarray, total: int, plain: float) -> DataFrame:
    """The texts but for _norm, with their band keys, number of elements, prefix (none without a word) and sketch, and how many of the
    prefix come before those that too many documents may have for one task."""
    idf, common = idf_of(df, total), max(HOT_LEAST, FLOOR * total)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingles()
        for batch in batches:
            drawn, sizes, first, rare, sketches = [np.empty((0, SAMPLES), dtype=np.uint64)], [], [], [], []
            for text in batch["_norm"]:
                h = shingles(text)
                if len(h):
                    drawn.append(samples(h, weights(h, idf))[None])
                sizes.append(len(h))
                sketches.append(sketch(h) if len(h) else b"")
                h = prefix(h, df, plain) if len(h) else h
                first.append(h.view(np.int64))
                rare.append(int((df[(h % np.uint64(BUCKETS)).astype(np.int64)] < common).sum()))
            keys = iter(band_keys(np.concatenate(drawn)))
            keys = [next(keys) if n else [] for n in sizes]
            yield batch.drop(columns="_norm").assign(_keys=keys, _size=sizes, _prefix=first, _rare=rare, _sketch=sketches)
        trim_memory()

    return texts.select("_node", "_least", "_n", "_norm").mapInPandas(run, "_node binary, _least long, _n long, _keys array<bigint>, _size long, _prefix array<bigint>, _rare int, _sketch binary")


def _each_with_each(rows: DataFrame, key: str) -> DataFrame:
    """Pairs (a, b) of the nodes of every key, each of which has few."""
    met = rows.groupBy(key).agg(F.collect_list("node").alias("met"))
    met = met.select(F.explode("met").alias("a"), "met")
    return met.select("a", F.explode(F.filter("met", lambda x: x > F.col("a"))).alias("b"))


def _could(size_a: Column, at_a: Column, size_b: Column, at_b: Column, share: float) -> Column:
    """Whether two texts whose first common element is at these places can have ``share`` of their sizes' sum in common."""
    return F.least(size_a - at_a, size_b - at_b) >= F.lit(share) * (size_a + size_b) - F.lit(1e-6)


def _first_word(digest: Column) -> Column:
    """What _words() gives, as a column."""
    return F.conv(F.concat(*[F.substring(F.hex(digest), 2 * i + 1, 2) for i in range(7, -1, -1)]), 16, -10).cast("long")


def _words(values: pd.Series) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join(values), dtype=np.int64).reshape(len(values), 2)[:, 0]


def shared_rare(prefixes: DataFrame) -> DataFrame:
    """s, t (the first eight bytes of the node) and ``at`` of the rare prefix elements that texts of several classes have.

    prefixes: _node, root, _prefix and _rare. Elements are dealt by themselves in packed arrays and sorted by numpy, _DEALT of them a task;
    none of these is an element of more than FLOOR of all documents.
    """
    names = ["s", "t", "r", "at"]
    parts = max(1, (prefixes.agg(F.sum("_rare")).first()[0] or 0) // _DEALT)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = batch["_rare"].to_numpy().cumsum() // _DEALT
            for _, b in batch.groupby(held):
                n = b["_rare"].to_numpy()
                s = np.concatenate([x[:k] for x, k in zip(b["_prefix"], n, strict=True)])
                t, r = _words(b["_node"]), _words(b["root"])
                # classes of one text are all zeros, which compress well
                cols = s, np.repeat(t, n), np.repeat(r ^ t, n), (np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                part = (_mix(s.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                own, first = np.unique(part[order], return_index=True)
                yield pd.DataFrame({"part": own} | {c: [y.tobytes() for y in np.split(x[order], first[1:])] for c, x in zip(names, cols, strict=True)})
        trim_memory()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([*batches, pd.DataFrame(columns=names)])
        s, t, r, at = (np.frombuffer(b"".join(got[c]), dtype=np.int32 if c == "at" else np.int64) for c in names)
        del got
        order = np.argsort(s, kind="stable")
        s, t, at, r = s[order], t[order], at[order], (r ^ t)[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else order
        if len(first):
            several = np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first)
            keep = np.repeat(several, np.diff(np.append(first, len(s))))
            yield pd.DataFrame({"s": s[keep], "t": t[keep], "at": at[keep]})
        trim_memory()

    dealt = prefixes.where("_rare > 0").select("_node", "root", "_prefix", "_rare").mapInPandas(deal, "part long, s binary, t binary, r binary, at binary")
    return dealt.repartition(parts, "part").drop("part").mapInPandas(meet, "s long, t long, at int")


def meetings(signed: DataFrame, nodes: DataFrame, plain: float) -> DataFrame:
    """node, size, its class so far (root, a hash), element s of its prefix at place ``at``, and n and load (number and sizes' sum) of
    the texts with s; where these are of several classes, and less the texts that cannot be alike to one of another class.

    Of elements that the same texts have, only the first counts: it has the lowest place in each. signed: what sign() gives; nodes: _node,
    _size and root.
    """
    share = plain / (1 + plain)
    own = nodes.select(F.col("_node").alias("node"), F.col("_size").alias("size"), F.xxhash64("root").alias("root"))
    light = nodes.select("_node", "root")
    rare = shared_rare(signed.select("_node", "_prefix", "_rare").join(light, "_node"))
    node_t = own.withColumn("t", _first_word(F.col("node")))
    rare = rare.join(node_t, "t").select("node", "size", "root", F.col("at").cast("long").alias("at"), "s")
    rest = F.slice("_prefix", F.col("_rare") + 1, F.size("_prefix"))
    common = signed.where(F.size("_prefix") > F.col("_rare")).select(F.col("_node").alias("node"), F.col("_rare").alias("skip"), F.posexplode(rest).alias("at", "s"))
    common = common.join(own, "node").select("node", "size", "root", (F.col("skip") + F.col("at")).cast("long").alias("at"), "s")
    rows = materialize(rare.unionByName(common), "elements")
    spare = F.col("size") - F.col("at") - F.lit(share) * F.col("size")  # what a partner's size times share may be at most
    held = rows.groupBy("s").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"), F.sum("at").alias("places"), F.sum("size").alias("load"),
        F.min("root").alias("low"), F.max("root").alias("high"), F.max(spare).alias("spare"), F.min("size").alias("least"),
    )
    held = held.where((F.col("n") > 1) & (F.col("low") != F.col("high")))
    held = held.groupBy("n", "who").agg(F.min_by(F.struct("s", "load", "spare", "least"), F.struct("places", "s")).alias("h"))
    held = materialize(held.select("h.s", "n", "h.load", "h.spare", "h.least"), "heads")
    out = lookup_join(rows, held.withColumnRenamed("spare", "most"), "s", "n", rows.count(), ["node"]).where(F.col("n").isNotNull())
    out = out.where((F.lit(share) * F.col("size") <= F.col("most") + F.lit(1e-6)) & (spare >= F.lit(share) * F.col("least") - F.lit(1e-6)))
    return materialize(out.select("node", "size", "root", "at", "s", "n", "load"), "meetings", drop=(rows, held))


def few_pairs(rows: DataFrame, plain: float) -> DataFrame:
    """Pairs (a, b) of different classes that could be alike, of the elements of at most FULL texts. rows: what meetings() gives."""
    met = rows.where(F.col("n") <= FULL).groupBy("s").agg(F.collect_list(F.struct("node", "size", "root", "at")).alias("met"))
    met = met.where(F.size("met") > 1).select(F.explode("met").alias("one"), "met")
    one = F.col("one")
    able = lambda x: (x["node"] > one["node"]) & (x["root"] != one["root"]) & _could(x["size"], x["at"], one["size"], one["at"], plain / (1 + plain))
    return met.select(F.col("one.node").alias("a"), F.explode(F.filter("met", able)).alias("b")).select("a", F.col("b.node").alias("b"))


def overlaps(sets: list[np.ndarray], idf: np.ndarray, cut: int) -> np.ndarray:
    """The weight that each of the first ``cut`` sets has in common with each of the others."""
    whose = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    found, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    weight = weights(found, idf).astype(np.float32)
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(at, kind="stable")  # by element, then set
    order = order[(count[at[order]] > 1) & (count[at[order]] <= _DENSE)]
    for step in range(1, _DENSE):
        same = np.flatnonzero(at[order[step:]] == at[order[:-step]]) if step < len(order) else order[:0]
        if not len(same):
            break
        low, high = order[same], order[same + step]
        out += np.bincount(whose[low] * len(sets) + whose[high], weight[at[low]], minlength=out.size).reshape(out.shape)
    out = out[:cut, cut:]
    column = np.full(len(found), -1)
    common = np.flatnonzero(count > _DENSE)
    column[common] = np.arange(len(common))
    for start in range(0, len(common), 4096):
        held = np.flatnonzero((column[at] >= start) & (column[at] < start + 4096))
        dense = np.zeros((len(sets), min(4096, len(common) - start)), dtype=np.float32)
        dense[whose[held], column[at[held]] - start] = np.sqrt(weight[at[held]])
        out += dense[:cut] @ dense[cut:].T
    return out


def joining(sets: list[np.ndarray], roots: np.ndarray, cut: int, idf: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Pairs of the first ``cut`` sets and the others that are alike, as many as join all classes that such pairs join."""
    weight = [weights(x, idf) for x in sets]
    total = np.array([w.sum() for w in weight])
    both = overlaps(sets, idf, cut)
    near = both / (total[:cut, None] + total[None, cut:] - both)
    label = np.unique(roots, return_inverse=True)[1]
    for i in np.flatnonzero((near >= least - 1e-3).any(axis=1)).tolist():
        # rounding may be wrong about those close to the threshold only, which come last
        for j in np.argsort(-near[i], kind="stable")[: int((near[i] >= least - 1e-3).sum())].tolist():
            k = cut + j
            if label[i] != label[k] and (near[i, j] >= least + 1e-3 or similarity((sets[i], weight[i]), (sets[k], weight[k])) >= least):
                label[label == label[k]] = label[i]
                yield i, k


def _halves(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The rows of both blocks that meet in a task."""
    if part["x"].iloc[0] == part["y"].iloc[0]:
        return np.arange(len(part)), np.arange(len(part))
    return np.flatnonzero(part["own"] == part["x"]), np.flatnonzero(part["own"] == part["y"])


def block_partners(rows: DataFrame, sketches: DataFrame, plain: float) -> DataFrame:
    """s, x, y, node, root and own of all texts that may be alike to another of blocks x and y of an element of more than FULL.

    own is the text's block. rows: what meetings() gives; sketches: _node and _sketch of their nodes.
    """
    share = plain / (1 + plain)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        first, second = _halves(part)
        found = np.zeros(len(part), dtype=bool)
        if len(first) and len(second) and part["root"].nunique() > 1:
            size, left, root = part["size"].to_numpy(), (part["size"] - part["at"]).to_numpy(), part["root"].to_numpy()
            need = share * (size[first, None] + size[None, second]) - 1e-6
            able = (root[first, None] != root[None, second]) & (np.minimum(left[first, None], left[None, second]) >= need)
            held = part["_sketch"].tolist()
            able = partners([held[i] for i in first], [held[i] for i in second], able, need)
            found[first] |= able.any(axis=1)
            found[second] |= able.any(axis=0)
        return part.loc[found, ["s", "x", "y", "node", "root", "own"]]

    rows = rows.where(F.col("n") > FULL)
    blocks = F.greatest(F.ceil(F.col("load") / F.lit(BLOCK_ELEMENTS)), F.ceil(F.col("n") / F.lit(BLOCK_TEXTS)))
    rows = rows.withColumn("blocks", blocks.cast("long")).withColumn("own", F.pmod(F.xxhash64("node", "s"), F.col("blocks")))
    rows = rows.hint("merge").join(sketches.withColumnRenamed("_node", "node"), "node")
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("s", "node", "root", "own", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "size", "at", "_sketch")
    return rows.groupBy("s", "x", "y").applyInPandas(run, "s long, x long, y long, node binary, root long, own long")


def block_links(rows: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Verified pairs (a, b) that join the classes of all alike texts of each two blocks. rows: what block_partners() gives."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        shingles = Shingles()
        part = part.sort_values("node")
        first, second = _halves(part)
        found: list[tuple[bytes, bytes]] = []
        root, node = part["root"].to_numpy(), part["node"].to_numpy()
        if len(first) and len(second) and len(np.unique(root)) > 1:
            own = [shingles(t) for t in part["_norm"]]
            at = np.concatenate([first, second])
            found = [(node[at[i]], node[at[j]]) for i, j in joining([own[i] for i in at], root[at], len(first), idf, least)]
        return pd.DataFrame(found, columns=["a", "b"])

    texts = texts.select(F.col("_node").alias("node"), "_norm")
    return rows.hint("merge").join(texts, "node").groupBy("s", "x", "y").applyInPandas(run, "a binary, b binary")


def may_be_alike(pairs: DataFrame, sketches: DataFrame, plain: float) -> DataFrame:
    """The pairs (a, b) that have enough in common by their sketches. sketches: _node, _size and _sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            most = common_at_most(b["_sketch_a"].tolist(), b["_sketch_b"].tolist())
            yield b.loc[most >= plain / (1 + plain) * b["_sizes"].to_numpy() - 1e-6, ["a", "b"]]

    one, two = (sketches.select(F.col("_node").alias(c), F.col("_size").alias(f"_size_{c}"), F.col("_sketch").alias(f"_sketch_{c}")) for c in "ab")
    both = pairs.hint("merge").join(one, "a").hint("merge").join(two, "b")
    return both.select("a", "b", "_sketch_a", "_sketch_b", (F.col("_size_a") + F.col("_size_b")).alias("_sizes")).mapInPandas(run, "a binary, b binary")


def missing_links(signed: DataFrame, nodes: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Verified pairs (a, b) of roots that join classes so far to the classes of all alike texts. As for meetings(). Deletes signed and texts."""
    plain = least_plain(least)
    rows = meetings(signed, nodes, plain)
    sketches = rows_of(signed, ["_node", "_size", "_sketch"], "sketches", rows.select("node"))
    discard(signed)
    few = materialize(_ordered(few_pairs(rows, plain)), "few")
    pairs = materialize(may_be_alike(few, sketches, plain), "pairs", drop=(few,))
    blocks = materialize(block_partners(rows, sketches.select("_node", "_sketch"), plain), "blocks", drop=(rows, sketches))
    own = texts_of(texts, pairs.select("a"), pairs.select("b"), blocks.select("node"))
    discard(texts)
    got = verified(pairs, own, idf, least).unionByName(block_links(blocks, own, idf, least))
    got = materialize(got, "missing", drop=(pairs, blocks, own))
    root = lambda c: nodes.select(F.col("_node").alias(c), F.col("root").alias(f"_{c}"))
    return got.join(root("a"), "a").join(root("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shared(nodes: DataFrame, total: int) -> DataFrame:
    """key, node and n of every node and band key that n > 1 nodes have."""
    rows = nodes.select(F.explode("_keys").alias("key"), F.col("_node").alias("node"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return materialize(lookup_join(rows, counts, "key", "n", total, ["node"]).where(F.col("n").isNotNull()), "shared")


def candidates(rows: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) of nodes with an equal band key: all of a key with at most FULL nodes, of a hotter one each with its centre.

    rows: what shared() gives. The centre is the node that shares most keys with most nodes, such as the text that edited copies
    were made from. The other pairs of hot keys are left to missing_links().
    """
    few = _each_with_each(rows.where(F.col("n") <= FULL).select("key", "node"), "key")
    rows = rows.where(F.col("n") > FULL)
    known = materialize(rows.join(rows.groupBy("node").agg(F.sum("n").alias("met")), "node").select("key", "node", "met"), "known")
    centres = known.groupBy("key").agg(F.max(F.struct("met", "node")).alias("top"), F.count("*").alias("n"))
    star = lookup_join(known.select("key", "node"), centres, "key", "n", total, ["node"]).select(F.col("top.node").alias("a"), F.col("node").alias("b"))
    return few.unionByName(star)


def links(rows: DataFrame, texts: DataFrame, idf: np.ndarray, total: int, least: float) -> DataFrame:
    """Verified pairs (a, b), a < b, of the candidates by band keys. Deletes rows."""
    pairs = materialize(_ordered(candidates(rows, total)), "candidates", drop=(rows,))
    own = texts_of(texts, pairs.select("a"), pairs.select("b"))
    return materialize(verified(pairs, own, idf, least), "verified", drop=(pairs, own))


def rows_of(table: DataFrame, columns: list[str], name: str, *nodes: DataFrame) -> DataFrame:
    """These columns of the nodes in ``nodes``, tables of one column, so that the others are not moved by every join.

    A Bloom filter of the nodes keeps the others out of this join's shuffle too. It is only built of what some filter chose.
    """
    need = nodes[0]
    for more in nodes[1:]:
        need = need.union(more)
    need = materialize(need.toDF("_node").distinct(), "need")
    n = max(1, need.count())
    bloom = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1g", "expectedNumItems": str(min(n, 4_000_000)), "numBits": str(min(max(1024, 8 * n), _BLOOM_BITS))}
    with settings(table.sparkSession, {f"{_BLOOM}.{k}": v for k, v in bloom.items()}):
        got = table.select(*columns).join(need.where(F.col("_node") >= F.lit(b"")), "_node", "left_semi")
        return materialize(got, name, drop=(need,))


def texts_of(texts: DataFrame, *nodes: DataFrame) -> DataFrame:
    """_node and _norm of the nodes in these tables."""
    return rows_of(texts, ["_node", "_norm"], "texts", *nodes)


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """The pairs whose texts have a similarity of ``least`` or more. texts: a row per _node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, kept = Shingles(), {}

        def of(node: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            if node not in kept:
                if len(kept) >= 512:
                    kept.clear()
                h = shingles(text)
                kept[node] = h, weights(h, idf)
            return kept[node]

        for b in batches:
            ok = [similarity(of(x, s), of(y, t)) >= least for x, y, s, t in zip(b["a"], b["b"], b["_text_a"], b["_text_b"], strict=True)]
            if any(ok):
                yield b.loc[ok, ["a", "b"]]
        kept.clear()
        trim_memory()

    one = texts.select(F.col("_node").alias("a"), F.col("_norm").alias("_text_a"))
    two = texts.select(F.col("_node").alias("b"), F.col("_norm").alias("_text_b"))
    # merge joins at every size: texts are never broadcast
    return pairs.hint("merge").join(one, "a").hint("merge").join(two, "b").mapInPandas(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node in links (a, b).

    Every round hooks each node to its least neighbour, shortens the paths until all end at a root, and goes on with the links
    between roots; links and labels stay tables throughout.
    """
    edges, labels = materialize(links.select("a", "b").where(F.col("a") != F.col("b")), "links"), None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")), "parents")
        while True:
            top = up.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            nxt = materialize(up.join(top, "root").select("node", F.col("_next").alias("root"), (F.col("root") != F.col("_next")).alias("_moved")), "parents")
            up = nxt.select("node", "root")
            if nxt.where("_moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            top = up.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            labels = materialize(labels.join(top, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "labels")
        at = [up.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in "ab"]
        edges = edges.join(at[0], "a").join(at[1], "b").where(F.col("_a") != F.col("_b"))
        edges = materialize(edges.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """_id, _node, class_id, class_size and _keeper of every document.

    class_id is the smallest doc_id of the documents that are linked, directly or through others, by a similarity of
    ``least`` or more. Texts that are equal but for case and white space are copies. Texts without a word (null ones too) are
    in a class of their own. Rows without doc_id take part and count as the smallest id, -2**63. _keeper marks
    the rows with the class's least (id, text digest), of which there is more than one only if a row is repeated.
    """
    ship(docs.sparkSession)
    norm = normalized(F.col(f"`{text}`"))
    texts = docs.select(F.coalesce(F.col(f"`{doc_id}`"), F.lit(_NULL_ID)).cast("long").alias("_id"), norm.alias("_norm"))
    texts = texts.withColumn("_node", F.unhex(F.md5("_norm")))
    ids = materialize(texts.select("_id", "_node"), "ids")
    total = ids.count()
    once = materialize(texts.groupBy("_node").agg(F.first("_norm").alias("_norm"), F.min("_id").alias("_least"), F.count("*").alias("_n")), "once")
    df = frequencies(once)
    idf = idf_of(df, total)
    signed = materialize(sign(once, df, total, least_plain(least)).where("_size > 0"), "signed")
    roots = components(links(shared(signed, total), once, idf, total, least))
    node = signed.select("_node", "_least", "_n", "_size").join(roots.withColumnRenamed("node", "_node"), "_node", "left")
    node = materialize(node.withColumn("root", F.coalesce("root", "_node")), "rooted")
    ends = components(missing_links(signed, node, once, idf, least)).select(F.col("node").alias("root"), F.col("root").alias("_end"))
    node = node.select("_node", "_least", "_n", "root").join(ends, "root", "left")
    node = materialize(node.select("_node", "_least", "_n", F.coalesce("_end", "root").alias("root")), "joined")
    whole = node.groupBy("root").agg(F.min(F.struct("_least", "_node")).alias("_first"), F.sum("_n").alias("class_size"), F.count("*").alias("_texts"))
    node = lookup_join(node, whole, "root", "_texts", total, ["_node"]).select("_node", "_n", "class_size", "_first")
    node = materialize(node, "classes")
    out = lookup_join(ids, node, "_node", "_n", total, ["_id"])
    alone = F.col("class_size").isNull()
    return out.select("_id", "_node", F.when(alone, F.col("_id")).otherwise(F.col("_first._least")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), (alone | (F.struct(F.col("_id").alias("_least"), "_node") == F.col("_first"))).alias("_keeper"))


def keep_one(docs: DataFrame, least: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one document of each class, the one with the smallest doc_id; the columns stay as they are, whatever their names."""
    kept = classes(docs, text, doc_id, least).where("_keeper").select("_id", "_node").distinct()
    own = F.col(f"`{text}`")
    key = F.coalesce(F.col(f"`{doc_id}`"), F.lit(_NULL_ID)).cast("long").alias("_id"), F.unhex(F.md5(normalized(own))).alias("_node")
    rows = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(kept, ["_id", "_node"], "left_semi")
    # of equal rows the one with the least text, and of these the first
    rows = rows.groupBy("_id", "_node").agg(F.min_by("row", F.coalesce(F.col("row").getField(text), F.lit(""))).alias("row"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def classes_query(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and class_size of every document."""
    null = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return classes(docs).select(null("_id").alias("doc_id"), null("class_id").alias("class_id"), "class_size")
