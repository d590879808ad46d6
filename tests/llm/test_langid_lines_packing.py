from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyweave.llm import langid, linededup, packing


def test_held_out_accuracy(documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    rows = langid.languages_query(documents).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_bundles_add_up():
    e = langid.Encoder()
    a = e.bundle("Ab, c")
    grams, counts = langid.grams("Ab, c")
    assert counts.sum() == len(" ab c ") - 2 and (langid.Encoder().bundle("ab -- c!") == a).all()
    assert e.bundle(None) is None and e.bundle("12 .. 3") is None and len(grams) == 4


def test_languages_equal_brute_force(documents):
    """Every letter's vector drawn, permuted, bound and bundled again for each n-gram, without caches or blocks."""
    rows = documents.select("doc_id", "text", "lang").collect()

    def vector(text):
        clean = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        if not clean.strip():
            return None
        clean, out, cache = " " + " ".join(clean.split()) + " ", np.zeros(langid.DIMENSIONS), {}
        for i in range(len(clean) - 2):
            g = clean[i : i + 3]
            if g not in cache:
                cache[g] = np.prod([np.roll(np.random.Generator(np.random.Philox(key=ord(c))).integers(0, 2, langid.DIMENSIONS, dtype=np.int8) * 2 - 1, 2 - k) for k, c in enumerate(g)], axis=0)
            out += cache[g]
        return out

    vectors = {r["doc_id"]: vector(r["text"]) for r in rows}
    sums = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and vectors[r["doc_id"]] is not None:
            sums[r["lang"]] += vectors[r["doc_id"]]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.languages_query(documents).collect()}
    for d, v in vectors.items():
        if v is None:
            assert got[d] == ("und", 0.0)
        else:
            cos = {k: v @ s / np.linalg.norm(s) / np.linalg.norm(v) for k, s in sums.items()}
            assert abs(got[d][1] - max(0.0, max(cos.values()))) < 1e-9 and cos[got[d][0]] >= max(cos.values()) - 1e-9


def test_noise_and_unknown_languages_go(spark, documents):
    """Letter noise goes; labelled documents stay, those of the held-out fold too."""
    rng = np.random.default_rng(8)
    noise = [(10**6 + i, "".join(rng.choice(list("qxzjkvwy"), 400)), None, None, 400) for i in range(20)]
    docs = documents.unionByName(spark.createDataFrame(noise, documents.schema))
    kept = {r["doc_id"] for r in langid.reject_unknown(docs).select("doc_id").collect()}
    clean = {r["doc_id"] for r in documents.where("text rlike '\\\\p{L}' and lang is not null").collect()}
    assert not kept & {n[0] for n in noise} and len(clean - kept) <= 0.01 * len(clean)


def test_language_stage_keeps_clashing_columns(spark):
    names = ["doc_id", "text", "lang", "lang_pred", "score", "row", "a.b"]
    df = spark.createDataFrame([(i, "some text", "en", *["keep"] * 4) for i in range(8)], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = langid.reject_unknown(df)
    assert out.columns == names and {r[3:] for r in out.collect()} == {("keep",) * 4} and out.count() == 8
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert langid.reject_unknown(unlabelled).count() == 8


def test_languages_of_odd_rows(odd_docs):
    rows = langid.languages_query(odd_docs).collect()
    assert sum(r["lang_pred"] == "und" for r in rows) == 3
    assert {r["doc_id"] for r in rows} == {None, 1, 2, 4, 5, 2**53 + 1}
    assert langid.languages_query(odd_docs.limit(0)).count() == 0
    assert langid.reject_unknown(odd_docs).count() == 5 and langid.reject_unknown(odd_docs).columns == odd_docs.columns


def dropped(spark, rows):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in linededup.lines_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_templates_generalise_two_places(spark):
    line = "Posted by user {} on the great board about topic {} with many replies and views"
    rows = [(1, "first\n" + line.format("ann", "cats")), (2, line.format("ann", "dogs")), (3, line.format("bob", "mice")), (4, "a line that no other document has, whatever else it may say today\n" + line.format("cy", "cats"))]
    rows += [(5, line.format("dan", "fish").replace("great", "small").replace("many", "few").replace("views", "likes"))]
    assert dropped(spark, rows) == {1: (2, 0), 2: (1, 1), 3: (1, 1), 4: (2, 1), 5: (1, 0)}


def test_short_lines_recur_in_two_documents(spark):
    rows = [(1, "Read more 12"), (2, "Read more 13\nAll rights reserved by Ann and all of her friends"), (3, "All rights reserved by Bob and all of her friends\nRead on"), (4, "Read less\nRead less")]
    assert dropped(spark, rows) == {1: (1, 0), 2: (2, 1), 3: (2, 1), 4: (2, 0)}


def test_a_hot_leaf(spark):
    """Thousands of different lines share a leaf, most of them a template; those without one stay."""
    rows = [(i, f"User number one {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} has sent a kind message to us all") for i in range(2000)]
    rows += [(5000 + i, "User number one " + " ".join(f"w{chr(97 + i)}{chr(97 + k)}" for k in range(9))) for i in range(20)]
    got = dropped(spark, rows)
    assert sum(d for _, d in got.values()) == 1999 and got[0] == (1, 0) and all(got[5000 + i] == (1, 0) for i in range(20))


def test_lines_of_odd_rows(odd_docs):
    rows = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in linededup.lines_query(odd_docs).collect()}
    assert (2, 1, 1) in rows and (None, 1, 0) in rows and (5, 0, 0) in rows
    assert linededup.lines_query(odd_docs.limit(0)).count() == 0


def test_lines_keep_clashing_columns(spark):
    names = ["doc_id", "text", "row", "rid", "gone", "rows", "doc", "n_lines", "_lines", "a.b"]
    df = spark.createDataFrame([(i, "one line of many\nown " + "xyz"[i], *["keep"] * 8) for i in range(3)], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = linededup.drop_templates(df)
    assert out.columns == names and {r[:] for r in out.collect()} == {(0, "one line of many\nown x", *["keep"] * 8), (1, "own y", *["keep"] * 8), (2, "own z", *["keep"] * 8)}


def covered(rows, ids: dict) -> int:
    """Checks that the pieces cover every id once and that sequences have no gaps; the padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for d, p in pieces.items():
        assert [s for s, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]] and sum(n for _, n in p) == len(ids[d])
    padding = 0
    for p in sequences.values():
        total = sum(n for _, n in p)
        assert [s for s, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]] and total <= packing.WINDOW
        padding += packing.WINDOW - total if total & total - 1 else 0
    return padding


def test_packing_covers_every_token(documents):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = {r["doc_id"]: np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4") for r in documents.select("doc_id", "text").collect()}
    assert covered(packing.packing_query(documents).collect(), ids) == 0
    small = packing.pack_documents(documents, shard_tokens=20_000).collect()
    assert covered(small, ids) == 0 and len({r["sequence_id"] >> 32 for r in small}) > 3


def test_neighbours_fill_the_window():
    rng = np.random.default_rng(2)
    topics = [rng.integers(10 + 100 * t, 110 + 100 * t, size=(8, 300)) for t in range(4)]
    docs = [np.append(d, 2) for pair in zip(*topics, strict=True) for d in pair]
    df = np.zeros(500, dtype=int)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    first = [d % 4 for d, _, _, s, _ in packing.pack(docs, idf, 301.0, window=2048) if s == 0]
    assert len(set(first)) == 1 and len(first) == 7


def test_neighbours_by_brute_force_bm25():
    """Scores equal the plain formula, and every window takes the unused documents in the order of their seed's scores."""
    rng = np.random.default_rng(4)
    docs = [np.append(rng.zipf(1.3, rng.integers(5, 90)) % 300 + 10, 2) for _ in range(60)]
    df = np.zeros(400, dtype=int)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    mean = np.mean([len(d) for d in docs])

    def bm25(q, d):
        tf = Counter(d[:-1].tolist())
        return sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(q[:-1].tolist()) if t in tf)

    index = packing.Index(docs, idf, mean)
    scores = [[bm25(q, d) for d in docs] for q in docs]
    assert all(np.allclose(index.scores(k), scores[k]) for k in range(len(docs)))
    left, windows = {k: len(d) for k, d in enumerate(docs)}, defaultdict(list)
    for d, _, n, s, o in packing.pack(docs, idf, mean, window=256):
        windows[s].append((o, d, n))
    for s in sorted(windows)[: sum(len(d) for d in docs) // 256]:
        pieces = [(d, n) for _, d, n in sorted(windows[s])]
        seed = max(left, key=lambda k: (len(docs[k]), -k))  # the longest document that is not used up
        order = [seed, *sorted((k for k in left if k != seed), key=lambda k: (-scores[seed][k], k))]
        want, free = [], 256
        for k in order:
            if free and left[k]:
                want.append((k, min(left[k], free)))
                free -= want[-1][1]
        assert pieces == want
        for k, n in pieces:
            left[k] -= n
            if not left[k]:
                del left[k]


def test_shards_hold_documents_of_a_topic(spark):
    """Where the documents need many shards, windows still hold documents of one topic, and equal documents spread over shards."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 7))
    topics = [[word() for _ in range(60)] for _ in range(16)]
    rows = [(24 * t + i, " ".join(rng.choice(topic, 40))) for t, topic in enumerate(topics) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, window=512, shard_tokens=1 << 12).collect()
    assert len({r["sequence_id"] >> 32 for r in got}) >= 8
    same = {}
    for r in got:
        same.setdefault(r["sequence_id"], []).append(r["doc_id"] // 24)
    assert sum(max(map(v.count, v)) for v in same.values()) >= 0.85 * len(got)
    equal = spark.createDataFrame([(i, rows[0][1]) for i in range(400)], "doc_id long, text string")
    assert len({r["sequence_id"] >> 32 for r in packing.pack_documents(equal, window=512, shard_tokens=1 << 12).collect()}) >= 8


def test_word_ids_equal_the_tokenizer():
    w = packing.WordIds(packing.tokenizer_path())
    odd = ["it's", "don't", "ÀÉ", "ǅ", "ﬁ", "日本語", "naïve,", "a" * 64, "a" * 80 + ".", "Straße.", "ΣΑΣ", "İx", ".", "...", "12 a1", "ªº", "", " ", "  a  b ", "a.. b., c.\nd!\n\n", "a.\tb", "<|endoftext|> x", "a\x1cb", "a\xa0b", "l'été. c'est, d'", "é", "x,y. z", "end%%% of"]
    assert w(odd) == [w._encode(x) for x in odd]


def test_packing_odd_rows(odd_docs):
    rows = packing.packing_query(odd_docs).collect()
    assert sum(r["length"] for r in rows if r["start"] == 0 and r["doc_tokens"] == 1) == 3
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) % 2 == 0 and packing.packing_query(odd_docs.limit(0)).count() == 0
