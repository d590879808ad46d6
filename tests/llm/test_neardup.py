from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from keyweave.llm import neardup


def shingles(text: str | None) -> set:
    """Runs of five words, each with the number of its use in the text."""
    w = (text or "").lower().split()
    k, used, out = min(5, len(w)), defaultdict(int), set()
    for i in range(len(w) - k + 1 if w else 0):
        s = tuple(w[i : i + k])
        used[s] += 1
        out.add((s, used[s]))
    return out


def brute_classes(texts: dict[int, str]) -> dict[int, int]:
    """Components of all pairs with a weighted Jaccard similarity of 0.8 or more, with exact document frequencies."""
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    weight = {x: 1 + 0.1 * math.log(max(0.01, len(d) / len(texts))) / math.log(0.01) for x, d in by.items()}
    total = lambda s: sum(weight[x] for x in s)
    for a, b in {(a, b) for v in by.values() for a in v for b in v if a < b}:
        if total(sets[a] & sets[b]) / total(sets[a] | sets[b]) >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def test_classes_equal_brute_force(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes_query(documents).collect()}
    assert got == brute_classes(texts)


def test_a_large_group_of_edited_copies(spark):
    """Every copy has edits of its own; copies are less alike than each is to the text they come from."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]
    rows = [(1000, " ".join(base))]
    for i in range(300):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(300)] = word()
        rows.append((i, " ".join(w)))
    common = " ".join(word() for _ in range(60))
    rows += [(2000 + i, common + " " + " ".join(word() for _ in range(200))) for i in range(200)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in (*range(300), 1000)} == {0} and all(got[i] == i for i in range(2000, 2200))


def test_pairs_within_texts_that_share_a_passage(spark):
    """All texts share 255 of 300 shingles, too few to be copies of one another; each has one copy, which shares 16 more."""
    rng = random.Random(7)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(n)]
    passage, rows = words(259), []
    for i in range(400):
        pair = words(16)
        rows += [(2 * i + j, " ".join(passage + pair + words(29))) for j in range(2)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d in range(800)}


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(0)
    near = []
    for _ in range(60):
        h = np.sort(rng.integers(0, 2**63, 400, dtype=np.uint64))
        w = rng.random(400) + 0.5
        a, b = np.arange(400) < 360, np.arange(400) >= 40
        want = w[a & b].sum() / w.sum()
        near.append(np.mean(neardup.samples(h[a], w[a]) == neardup.samples(h[b], w[b])) - want)
    assert abs(np.mean(near)) < 0.02


def test_shingle_hashes():
    s = neardup.Shingles()
    assert len(s("a b c d e a b c d e a")) == len(shingles("a b c d e a b c d e a")) == 7 and len(s("")) == 0 and len(s("one two")) == 1
    assert len(np.intersect1d(s("x a b c d e"), s("a b c d e y"))) == 1
    assert len(np.intersect1d(s(" ".join("a" * 40)), s(" ".join("a" * 30)))) == 26


def test_links_of_common_elements_only(spark):
    """Texts drop different sentences of one long text, and no text is the whole: all they share is common to many of them."""
    rng = random.Random(11)
    words = [["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(10)] for _ in range(40)]
    rows = [(i, " ".join(w for k, s in enumerate(words) if k not in set(random.Random(i).sample(range(40), 5)) for w in s)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes_query(df).collect()}
    # many pairs are close to the threshold, so all are compared with the very weights that the operator has
    idf = neardup.inverse_frequencies(df.select(F.col("text").alias("_norm")), len(rows))
    sets = [(h, neardup.weights(h, idf)) for h in (neardup.Shingles()(t) for _, t in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if neardup.similarity(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    # few texts may be left out of their class, none is in a class with another
    wrong = [d for d, c in got.items() if root[d] != root[c]]
    assert not wrong and len(set(root)) <= len(set(got.values())) <= 1.05 * len(set(root)) and 10 < len(set(root)) < 150


def pair_without_a_key(seed: int) -> list[str]:
    """Two texts that share 86 of 106 shingles."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    w = [word() for _ in range(100)]
    return [" ".join(w), " ".join(w[:90] + [word() for _ in range(10)])]


def test_a_pair_that_shares_no_band_key(spark):
    texts = pair_without_a_key(1924)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = neardup.inverse_frequencies(df.select(F.col("text").alias("_norm")), 2)
    sets = [(h, neardup.weights(h, idf)) for h in map(neardup.Shingles(), texts)]
    assert neardup.similarity(*sets) >= 0.8
    assert not len(np.intersect1d(*(neardup.band_keys(neardup.samples(*s)) for s in sets)))
    assert {r["class_id"] for r in neardup.classes_query(df).collect()} == {0}


def test_all_links_of_common_elements(spark):
    """As above, of more texts than a task gets at once and exactly; all elements are too common to be sorted in one task."""
    rng = random.Random(11)
    words = [["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(10)] for _ in range(40)]
    rows = [(i, " ".join(w for k, s in enumerate(words) if k not in set(random.Random(i).sample(range(40), 6)) for w in s)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes_query(df).collect()}
    idf = neardup.inverse_frequencies(df.select(F.col("text").alias("_norm")), len(rows))
    sets = [neardup.Shingles()(t) for _, t in rows]
    found = np.unique(np.concatenate(sets))
    has = np.stack([np.isin(found, s, assume_unique=True) for s in sets]).astype(float)
    both = (has * neardup.weights(found, idf)) @ has.T
    alike = both / (both.diagonal()[:, None] + both.diagonal()[None] - both) >= 0.8
    root = np.arange(len(rows))
    while True:
        least = np.where(alike, root[None], len(rows)).min(axis=1)
        if (least == root).all():
            break
        root = least
    assert got == dict(enumerate(root.tolist())) and sum(map(len, sets)) > neardup.BLOCK_ELEMENTS and 1 < len(set(root.tolist())) < 900


def test_blocks_give_no_more_links_than_join_classes():
    """Alike and unlike sets of both ways of counting, against the similarity of each pair."""
    rng = np.random.default_rng(3)
    idf = 1 + 0.1 * rng.random(neardup.BUCKETS)
    base = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.93], rng.integers(0, 2**63, rng.integers(1, 30), dtype=np.uint64)])) for b in (base, base, base[:200]) for _ in range(25)]
    sets += [np.unique(np.concatenate([s[:-2], rng.integers(0, 2**63, 2, dtype=np.uint64)])) for s in sets[:20]]
    pairs = {(i, j) for i in range(50) for j in range(50, len(sets)) if neardup.similarity(*((sets[x], neardup.weights(sets[x], idf)) for x in (i, j))) >= 0.8}
    both = neardup.overlaps(sets, idf, 50)
    want = [[neardup.weights(np.intersect1d(a, b), idf).sum() for b in sets[50:]] for a in sets[:50]]
    assert np.allclose(both, want, rtol=1e-4)
    got = set(neardup.joining(sets, np.arange(len(sets)), 50, idf, 0.8))
    assert got <= pairs and len(got) < len(pairs)

    def classes(links):
        root = list(range(len(sets)))
        for i, j in links:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
        return root

    assert classes(got) == classes(pairs) and len(got) == len(sets) - len(set(classes(got)))


def test_clashing_columns_pass_through(spark):
    names = ["doc_id", "text", "_id", "_node", "_nth", "row", "a.b"]
    df = spark.createDataFrame([(i, "same text here", *["keep"] * 5) for i in (3, 1, 2)], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    assert [r[:] for r in neardup.keep_one(df).collect()] == [(1, "same text here", *["keep"] * 5)] and neardup.keep_one(df).columns == names


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102), (7, 7)]
    key = lambda i: i.to_bytes(4, "big")
    got = {int.from_bytes(r[0], "big"): int.from_bytes(r[1], "big") for r in neardup.components(spark.createDataFrame([(key(a), key(b)) for a, b in chain], "a binary, b binary")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes_query(odd_docs).collect()]
    assert rows.count((2, None, 3)) == 2 and (1, 1, 1) in rows and (5, 5, 1) in rows and len(rows) == 8
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 6
    assert neardup.classes_query(odd_docs.limit(0)).count() == 0 and neardup.keep_one(odd_docs.limit(0)).count() == 0


def test_sketches_never_say_too_little():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(pool[: rng.integers(20, 3000)], rng.integers(1, 900))) for _ in range(60)] + [np.arange(40, dtype=np.uint64)]
    held = [neardup.sketch(x) for x in sets]
    assert held[-1] == b"" and all(held[:-1])  # four bits do not hold 40 elements of one beginning
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    i, j = np.divmod(np.arange(both.size), len(sets))
    most = neardup.common_at_most([held[x] for x in i], [held[x] for x in j]).reshape(both.shape)
    assert (most >= both).all() and np.isinf(most[-1]).all() and (most[:-1, :-1] < 0.6 * np.add.outer(*[[len(x) for x in sets[:-1]]] * 2)).mean() > 0.9
    able = rng.random(both.shape) < 0.7
    got = neardup.partners(held, held, able, both + 5.0)
    assert (got == (able & (most >= both + 5))).all()


def test_texts_that_share_passages_only_are_not_sent(spark, monkeypatch):
    """Every passage of 60 words is in 20 texts of two. Sketches tell these apart; before, each of them went whole to the blocks."""
    sent = []
    texts = [" ".join([f"a{i}x{w}" for w in range(60)] + [f"b{j}x{w}" for w in range(60)]) for i in range(20) for j in range(20)]
    texts += ["one " + texts[0], "one two " + texts[0]]
    write = neardup.materialize

    def watched(df, name, *args, **kwargs):
        out = write(df, name, *args, **kwargs)
        sent.append((name, out.count()))
        return out

    monkeypatch.setattr(neardup, "materialize", watched)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes_query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i if i < 400 else 0 for i in range(402)}
    assert [n for name, n in sent if name == "meetings"][0] >= 400 and [n for name, n in sent if name == "texts"][-1] == 0
