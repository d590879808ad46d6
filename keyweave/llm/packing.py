"""Lexical retrieval packing: every training window is filled with the unused documents that BM25 finds for its seed.

Documents are dealt to shards by their content: a tree of cuts, grown on a sample of their vectors of idf-weighted terms, leads documents with the
same rare terms to one leaf. A shard is one task's work: it builds an inverted index of its documents, whose terms are token ids, weighted with document frequencies and lengths of the whole corpus. The longest unused document
seeds a window; its best unused neighbours follow in order of score, and the last one is cut to fit, so that only a
shard's last window is not full. That one is cut into sequences with powers of two as lengths, which need no padding.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import materialize, trim_memory
from keyweave.workers import ship

WINDOW = 4096
END = 2
#: Tokens of a shard, about.
SHARD_TOKENS = 1 << 19
K1, B = 1.2, 0.75
#: Signed hashed terms that the tree sees of a document; sampled documents per shard that it grows on, and in all.
DIMENSIONS, SAMPLED, SAMPLED_MOST = 128, 64, 1 << 17
#: Words whose ids a worker remembers, about, and the characters of the longest of them.
_WORDS, _LONG = 300_000, 64
#: Characters of texts that are split and looked up together.
_CHARS = 2 << 20
#: Texts with rare white space, or with letters whose lower case depends on their neighbours or is longer, are left to the tokenizer.
_ODD = "[\x1c-\x1f\x85\xa0\u0130\u03a3\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Merges:
    """The merges of a word-end BPE, run for many words at once: rows of equally long words lose one symbol a step."""

    _NONE = np.iinfo(np.int32).max
    _BITS = 18

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        code = np.array([vocabulary[x] << 20 | vocabulary[y] for x, y in pairs], dtype=np.int64)
        self.code = np.append(code, -1)  # by rank; the last stands for no merge
        self.rank = np.append(np.arange(len(code), dtype=np.int32), self._NONE)
        self.tables, rest = [], np.arange(len(code))
        while len(rest):  # of the merges with one slot the last stays, the others go to the next table
            table = np.full(1 << self._BITS, len(code), dtype=np.int32)
            table[self._slot(code[rest], len(self.tables))] = rest
            self.tables.append(table)
            rest = rest[table[self._slot(code[rest], len(self.tables) - 1)] != rest]
        self.merged = np.array([vocabulary[x + y] for x, y in pairs], dtype=np.int64)
        # the printable stand-ins that byte-level vocabularies use for bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in set(plain)]
        char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}
        self.inner = np.array([vocabulary[char[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocabulary[char[b] + suffix] for b in range(256)], dtype=np.int64)

    def _slot(self, code: np.ndarray, table: int) -> np.ndarray:
        mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * table * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        return (mixed >> np.uint64(64 - self._BITS)).astype(np.int64)

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        code = (x << 20 | y).ravel()
        out = np.full(len(code), self._NONE, dtype=np.int32)
        left = None
        for k, table in enumerate(self.tables):
            some = code if left is None else code[left]
            at = table[self._slot(some, k)]
            hit = self.code[at] == some
            rank = np.where(hit, self.rank[at], self._NONE)
            if left is None:
                out = rank
            else:
                out[left] = np.minimum(out[left], rank)
            full = np.flatnonzero(~hit & (at != len(self.code) - 1))
            left = full if left is None else left[full]
            if not len(left):
                break
        return out.reshape(x.shape)

    def __call__(self, words: list[str], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids of all words one after another."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        order = np.argsort(size, kind="stable")
        data = np.frombuffer(b"".join([raw[i] for i in order]), dtype=np.uint8)
        lengths, first, held = np.unique(size[order], return_index=True, return_counts=True)
        sizes, done_ids, at_byte = np.zeros(len(words), dtype=np.int64), [], 0
        for n, start, count in zip(lengths.tolist(), first.tolist(), held.tolist(), strict=True):
            own = order[start : start + count]
            bytes_ = data[at_byte : at_byte + n * count].reshape(count, n)
            at_byte += n * count
            ids = np.concatenate([self.inner[bytes_[:, :-1]], self.last[bytes_[:, -1:]]], axis=1)
            rank = self._ranks(ids[:, :-1], ids[:, 1:])
            while len(own):
                at = np.argmin(rank, axis=1) if n > 1 else np.zeros(len(own), dtype=np.int64)
                best = rank[np.arange(len(own)), at] if n > 1 else np.full(len(own), self._NONE)
                done = best == self._NONE
                if done.any():
                    sizes[own[done]] = n
                    done_ids.append((own[done], ids[done].astype(kind)))
                    go = ~done
                    own, ids, rank, at, best = own[go], ids[go], rank[go], at[go], best[go]
                if not len(own):
                    break
                row, n = np.arange(len(own)), n - 1
                ids[row, at] = self.merged[best]
                column = np.arange(n)[None, :]
                ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
                column = column[:, : n - 1]
                rank = np.take_along_axis(rank, column + (column >= at[:, None]), axis=1)
                for j in (at - 1, at):
                    ok = (j >= 0) & (j < n - 1)
                    r, c = row[ok], j[ok]
                    rank[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
        starts, flat = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), dtype=kind)
        for own, ids in done_ids:
            flat[starts[own][:, None] + np.arange(ids.shape[1])] = ids
        return sizes, flat


class WordIds:
    """Token ids of texts under a lower-casing word-end BPE that drops white space, joined from remembered ids of their words.

    Arrow lower-cases, splits and numbers the words of many texts at once, with the marks after a word cut off; words of letters go through Merges, all others
    through the tokenizer itself, and so do whole texts with characters whose handling could differ.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.merges = _tokenizer(path), Merges(path)
        special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = re.compile(f"{_ODD}|{special}")
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self, keep: np.ndarray | None = None) -> None:
        """Drops all words but those with the slots in ``keep``."""
        if keep is None:
            self.known: dict[str, int] = {}
            self.start = self.size = self.hits = np.empty(0, dtype=np.int64)
            self.flat = np.empty(0, dtype=self.kind)
            return
        new = np.full(len(self.size), -1)
        new[keep] = np.arange(len(keep))
        self.known = {w: k for w, i in self.known.items() if (k := int(new[i])) >= 0}
        n = self.size[keep]
        self.flat = self.flat[np.repeat(self.start[keep] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        self.start, self.size, self.hits = np.cumsum(n) - n, n, self.hits[keep] // 2

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _learn(self, words: list[str]) -> np.ndarray:
        """The slots of new words. Long ones are not remembered."""
        plain = np.fromiter((len(w) <= _LONG and w.isalpha() for w in words), dtype=bool, count=len(words))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        size, flat = self.merges([words[i] for i in order[: plain.sum()]], self.kind)
        odd = [np.frombuffer(self._encode(words[i]), self.kind) for i in order[plain.sum() :]]
        size = np.concatenate([size, np.fromiter(map(len, odd), dtype=np.int64, count=len(odd))])
        first = len(self.size)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat, *odd])
        self.hits = np.concatenate([self.hits, np.zeros(len(words), dtype=np.int64)])
        slots = np.empty(len(words), dtype=np.int64)
        slots[order] = first + np.arange(len(words))
        self.known.update((w, k) for w, k in zip(words, slots.tolist(), strict=True) if len(w) <= _LONG)
        return slots

    def _plain(self, texts: list[str]) -> list[bytes]:
        low = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.string())), r"(\pL)([^\s\pL\pN]+)(\s|$)", r"\1 \2\3")
        split = pc.utf8_split_whitespace(low)
        del low
        words = split.flatten().dictionary_encode()
        if len(self.size) > _WORDS:  # words met in two runs or more stay, the most frequent half at most
            again = np.flatnonzero(self.hits > 1)
            self._forget(np.sort(again[np.argsort(-self.hits[again], kind="stable")[: _WORDS // 2]]))
        distinct = words.dictionary.to_pylist()
        get = self.known.get
        slot = np.fromiter((get(w, -1) for w in distinct), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = self._learn([distinct[i] for i in new])
        del distinct
        self.hits[slot] += 1
        code = words.indices.to_numpy()
        n = self.size[slot].astype(np.int32)[code]
        ends = np.cumsum(n, dtype=np.int64)
        shift = (self.start[slot][code] - (ends - n)).astype(np.int32)
        at = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        del words, split, code, ends
        out = self.flat[np.repeat(shift, n) + np.arange(at[-1], dtype=np.int32)].tobytes()
        at *= self.kind.itemsize
        return [out[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        odd = [not t.isascii() and not unicodedata.is_normalized("NFC", t) or bool(self.odd.search(t)) for t in texts]
        plain = iter(self._plain([t for t, o in zip(texts, odd, strict=True) if not o]))
        return [self._encode(t) if o else next(plain) for t, o in zip(texts, odd, strict=True)]


def tokenize(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id (as text), nth (which of the rows of a task with this id), ids (little-endian) and n of every document, END included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = WordIds(path), {}
        end = np.array([END], dtype=encode.kind).tobytes()
        for b in batches:
            start = 0
            for stop in _cuts(pc.utf8_length(b.column(1)).to_pylist()):
                part = b.slice(start, stop - start)
                start = stop
                ids = [x + end for x in encode(part.column(1).to_pylist())]
                nth = []
                for d in part.column(0).to_pylist():
                    nth.append(seen.get(d, 0))
                    seen[d] = nth[-1] + 1
                n = [len(x) // encode.kind.itemsize for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nth, pa.int64()), pa.array(ids, pa.binary()), pa.array(n, pa.int64())], ["doc_id", "nth", "ids", "n"])
        del encode, seen
        trim_memory()

    src = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return src.mapInArrow(run, "doc_id string, nth long, ids binary, n long")


def _cuts(sizes: list[int]) -> Iterator[int]:
    """Ends of runs of texts of about _CHARS characters together."""
    held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= _CHARS:
            yield i + 1
            held = 0
    if held or sizes and not sizes[-1]:
        yield len(sizes)


def document_frequencies(tokens: DataFrame, vocabulary: int, kind: np.dtype) -> np.ndarray:
    """In how many of all documents each token id occurs; one row per token id and task goes through the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, place = np.zeros(vocabulary, dtype=np.int64), np.zeros(vocabulary, dtype=np.int64)
        for b in batches:
            for x in b["ids"]:
                ids = np.frombuffer(x, kind)
                here = np.arange(len(ids))
                place[ids] = here
                df[ids[place[ids] == here]] += 1  # one of the places of each id is kept
        got = np.flatnonzero(df)
        if len(got):
            yield pd.DataFrame({"term": got, "df": df[got]})

    out = np.zeros(vocabulary, dtype=np.int64)
    for r in tokens.select("ids").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


@functools.cache
def _hashed(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.Philox(key=9))
    return g.integers(0, DIMENSIONS, vocabulary), g.choice([-1.0, 1.0], vocabulary)


def vectors(docs: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """A unit vector of DIMENSIONS numbers for each document: its terms (END excluded) with BM25's inverse document
    frequencies by signed hashing, 0 without a term."""
    place, sign = _hashed(len(idf))
    signed = sign * idf
    out = np.zeros((len(docs), DIMENSIONS), dtype=np.float32)
    for i, ids in enumerate(docs):
        out[i] = np.bincount(place[ids[:-1]], weights=signed[ids[:-1]], minlength=DIMENSIONS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Tree:
    """Cuts of a sample across its main direction at the widest gap near the middle, until each leaf has about one shard's tokens.

    A leaf that stays larger, for the sake of many equal documents, has several shards, and its documents are dealt by a hash.
    """

    def __init__(self, x: np.ndarray, size: np.ndarray, shards: int) -> None:
        self.direction, self.cut, self.below, self.first, self.parts = [], [], [], [], []
        self.shards, whole = 0, max(1, int(size.sum()))
        todo = [(np.arange(len(x)), shards, -1, 0)]
        while todo:
            at, k, parent, side = todo.pop()
            split = self._split(x[at]) if k > 1 and len(at) > 1 else None
            if split is None:
                here = max(1, round(float(size[at].sum()) * shards / whole))
                node = ~len(self.first)
                self.first.append(self.shards)
                self.parts.append(here)
                self.shards += here
            else:
                node, (direction, cut, left) = len(self.cut), split
                self.direction.append(direction)
                self.cut.append(cut)
                self.below.append([0, 0])
                share = float(size[at[left]].sum()) / max(1, float(size[at].sum()))
                n = min(k - 1, max(1, round(k * share)))
                todo += [(at[~left], k - n, node, 1), (at[left], n, node, 0)]
            if parent >= 0:
                self.below[parent][side] = node
        self.root = 0 if self.cut else ~0
        self.direction, self.cut, self.below = np.array(self.direction, np.float32), np.array(self.cut), np.array(self.below)
        self.first, self.parts = np.array(self.first), np.array(self.parts)

    @staticmethod
    def _split(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
        """Direction, cut and which rows lie below; None if all rows are equal."""
        centred = x - x.mean(axis=0)
        spread = centred.T @ centred
        direction = np.linalg.eigh(spread.astype(np.float64))[1][:, -1].astype(np.float32)
        place = (x * direction).sum(axis=1)
        order = np.sort(place)
        low, high = len(x) * 7 // 20, max(len(x) * 13 // 20, len(x) * 7 // 20 + 1)
        gaps = np.diff(order)
        if gaps[low:high].max(initial=0) < 1e-5:  # equal documents in the middle: cut beside them
            low, high = 0, len(gaps)
        k = low + int(np.argmax(gaps[low:high]))
        if gaps[k] < 1e-5:
            return None
        cut = float(order[k] + order[k + 1]) / 2
        return direction, cut, place <= cut

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root)
        while len(at := np.flatnonzero(node >= 0)):
            here = node[at]
            above = (x[at] * self.direction[here]).sum(axis=1) > self.cut[here]
            node[at] = self.below[here, above.astype(np.int64)]
        return ~node


def content_tree(tokens: DataFrame, idf: np.ndarray, kind: np.dtype, count: int, shards: int) -> Tree:
    """The tree of a bounded sample of tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = vectors([np.frombuffer(i, kind) for i in b["ids"]], idf).astype(np.float16)
            yield pd.DataFrame({"n": b["n"], "x": [v.tobytes() for v in x]})

    every = max(1, count // min(shards * SAMPLED, SAMPLED_MOST))
    some = tokens.where(F.pmod(F.xxhash64("doc_id", "nth", F.lit(9)), F.lit(every)) == 0).select("ids", "n")
    got = sorted((bytes(r["x"]), r["n"]) for r in some.mapInPandas(run, "n long, x binary").collect())
    x = np.frombuffer(b"".join(v for v, _ in got), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
    return Tree(x, np.array([n for _, n in got], dtype=np.int64), shards)


class Index:
    """BM25 scores of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.terms = []
        weights = []
        for ids in docs:
            t, tf = np.unique(ids[:-1], return_counts=True)
            self.terms.append(t)
            weights.append(idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean)))
        term = np.concatenate(self.terms).astype(np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(t) for t in self.terms])
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], np.concatenate(weights)[order].astype(np.float64)
        self.start = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        t = self.terms[seed]
        low, n = self.start[t], self.start[t + 1] - self.start[t]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=len(self.terms))


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every id of the documents once."""
    out: list[tuple[int, int, int, int, int]] = []
    start, left = np.zeros(len(docs), dtype=np.int64), np.array([len(d) for d in docs], dtype=np.int64)
    sequence = 0
    for k in np.flatnonzero(left >= window).tolist():
        while left[k] >= window:
            out.append((k, int(start[k]), window, sequence, 0))
            start[k], left[k], sequence = start[k] + window, left[k] - window, sequence + 1
    index = Index(docs, idf, mean)
    last: list[tuple[int, int, int]] = []
    for seed in np.argsort(-left, kind="stable").tolist():
        if not left[seed]:
            continue
        free, pieces = window, []
        scores = index.scores(seed)
        scores[seed] = np.inf
        pool = np.flatnonzero(left)
        for k in pool[np.argsort(-scores[pool], kind="stable")].tolist():
            take = min(int(left[k]), free)
            pieces.append((k, int(start[k]), take))
            start[k], left[k], free = start[k] + take, left[k] - take, free - take
            if not free:
                break
        if free:
            last = pieces
        else:
            at = 0
            for k, s, n in pieces:
                out.append((k, s, n, sequence, at))
                at += n
            sequence += 1
    rest, at = sum(n for _, _, n in last), 0
    size = 1 << rest.bit_length() - 1 if rest else 0
    for k, s, n in last:
        while n:
            take = min(n, size - at)
            out.append((k, s, take, sequence, at))
            s, n, at, rest = s + take, n - take, at + take, rest - take
            if at == size:
                sequence, at, size = sequence + 1, 0, 1 << rest.bit_length() - 1 if rest else 0
    return out


def with_shards(tokens: DataFrame, idf: np.ndarray, kind: np.dtype, count: int, shards: int) -> DataFrame:
    """tokens with the shard of every document, of which there are about ``shards``."""
    if shards == 1:
        return tokens.select("*", F.lit(0).cast("long").alias("shard"))
    tree = content_tree(tokens, idf, kind, count, shards)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaf = tree.leaves(vectors([np.frombuffer(i, kind) for i in b["ids"]], idf))
            yield b.drop(columns="dealt").assign(shard=tree.first[leaf] + b["dealt"].to_numpy() % tree.parts[leaf])
        trim_memory()

    dealt = F.pmod(F.xxhash64("doc_id", "nth"), F.lit(1 << 32)).alias("dealt")
    return tokens.select("*", dealt).mapInPandas(run, "doc_id string, nth long, ids binary, n long, shard long")


def pack_documents(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of every piece of every document.

    Null text counts as empty: such a document is the one id END. Repeated rows are documents of their own; rows without
    doc_id are packed like the others. Sequences are full windows or have a power of two as length. ``window`` is a power of
    two itself. An empty table gives no piece.
    """
    ship(docs.sparkSession)
    path = path or tokenizer_path()
    vocabulary = _tokenizer(path).get_vocab_size()
    kind = WordIds(path).kind
    tokens = materialize(tokenize(docs, path, text, doc_id), "tokens")
    count, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(tokens, vocabulary, kind)
    idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
    mean, shards = total / max(1, count), max(1, -(-total // shard_tokens))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "nth", "ids"], na_position="last", ignore_index=True)
        own = [np.frombuffer(x, kind) for x in part["ids"]]
        pieces = pack(own, idf, mean, window)
        d, s, n, q, o = (list(x) for x in zip(*pieces, strict=True))
        cut = [own[i][a : a + m].astype("<u4").tobytes() for i, a, m in zip(d, s, n, strict=True)]
        base = int(part["shard"].iloc[0]) << 32
        out = {"doc_id": part["doc_id"].to_numpy()[d], "start": s, "length": n, "ids_crc32": [zlib.crc32(x) for x in cut], "doc_tokens": part["n"].to_numpy()[d], "sequence_id": [base + x for x in q], "offset": o}
        return pd.DataFrame(out | ({"ids": cut} if with_ids else {}))

    dealt = with_shards(tokens, idf, kind, count, shards)
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    packed = dealt.groupBy("shard").applyInPandas(run, schema)
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))


def packing_query(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
