from __future__ import annotations

import math
from collections import Counter

import numpy as np
import sentencepiece

from keyweave.llm import segment

P = segment.pieces(segment.model_path())


def listed(text: str) -> dict[tuple[int, ...], float]:
    """Every segmentation of a text with its log-probability."""
    by = {P.text[i]: i for i in range(len(P.text)) if P.log_p[i] > P.log_p[-1] + 1e-9}
    word, out = segment.SPACE + text.replace(" ", segment.SPACE), {}

    def walk(i: int, ids: tuple[int, ...], log_p: float) -> None:
        if i == len(word):
            out[ids] = log_p
        for j in range(i + 1, min(len(word), i + P.longest) + 1):
            if (k := by.get(word[i:j])) is not None:
                walk(j, (*ids, k), log_p + P.log_p[k])

    walk(0, (), 0.0)
    z = math.log(sum(map(math.exp, out.values())))
    return {k: v - z for k, v in out.items()}


def seeds(n: int) -> np.ndarray:
    return segment._mix(np.arange(n, dtype=np.uint64) + np.uint64(99))


def test_samples_follow_the_distribution_without_replacement():
    n = 4000
    for text in ("the cat", "hello"):
        full = listed(text)
        first, second, weighted = Counter(), Counter(), Counter()
        for _, rank, log_p, _, score, ids in segment.encode(P, [text] * n, seeds(n), 2):
            key = tuple(ids.tolist())
            assert abs(full[key] - log_p) < 1e-6
            (first if rank == 1 else second)[key] += 1
            weighted[key] += 1 / score
        p = {k: math.exp(v) for k, v in full.items()}
        for k in sorted(p, key=p.get)[-3:]:
            expected = sum(p[a] * p[k] / (1 - p[a]) for a in p if a != k)
            assert abs(first[k] / n - p[k]) < 0.03 and abs(second[k] / n - expected) < 0.04
            assert abs(weighted[k] / n - 1) < 0.35 or p[k] < 0.02  # inclusion scores make counts unbiased


def test_all_segmentations_come_out_once_and_best_first():
    for text, size in (("ab", None), ("a", None), ("the ca", None)):
        full = listed(text)
        got = list(segment.encode(P, [text], seeds(1), len(full) + 3))
        assert {tuple(g[5].tolist()) for g in got} == full.keys() and len(got) == len(full)
        values = [g[3] for g in got]
        assert values == sorted(values, reverse=True) and got[-1][4] == 1.0


def test_round_trip_and_seeds():
    sp = sentencepiece.SentencePieceProcessor(model_file=segment.model_path())
    texts = ["The cat, sat; on 12 mats.", "  a b  ", "x\ny é日本🎉  z ", "", "\n", "w" * 500, "ﬁ ① Å\t\x00a"]
    once = list(segment.encode(P, texts, seeds(len(texts)), 3))
    for i, _, _, _, _, ids in once:
        assert P.decode(ids.tolist()) == texts[i] == sp.decode(ids.tolist())
    alone = [g for i, t in enumerate(texts) for g in segment.encode(P, [t], seeds(len(texts))[i : i + 1], 3)]
    assert [(g[1], g[5].tolist()) for g in sorted(once, key=lambda g: (g[0], g[1]))] == [(g[1], g[5].tolist()) for g in alone]


def test_query(documents, odd_docs):
    rows = segment.segments_query(documents).collect()
    assert all(r["decoded"] for r in rows) and len({(r["doc_id"], r["ids_crc32"], r["n_pieces"]) for r in rows}) == len(rows)
    odd = segment.segments_query(odd_docs).collect()
    assert all(r["decoded"] for r in odd) and sum(r["n_pieces"] == 0 for r in odd) == 2
    assert segment.segments_query(odd_docs.limit(0)).count() == 0
    back = segment.decode(segment.sample(odd_docs.where("doc_id = 5")))
    assert {r["text"] for r in back.collect()} == {"\n\n \n"}


def test_query_walks_down_from_several_paths(documents):
    """The second sample always leaves the first's path; only later ones choose among paths."""
    texts = [r["text"] or "" for r in documents.select("text").limit(100).collect()]
    distinct, words, text = segment.split_words(P, texts)
    search, chosen = segment.Search(segment.Lattices(P, distinct), words, text, len(texts), seeds(len(texts))), np.zeros(len(texts), dtype=bool)
    for _ in range(segment.SAMPLES - 1):
        value, whose = search.front()
        chosen |= np.isfinite(value) & (whose > 0)
        search.more()
    assert chosen.mean() > 0.9
    rows = Counter(r["doc_id"] for r in segment.segments_query(documents).select("doc_id").collect())
    assert max(rows.values()) == segment.SAMPLES and sum(n == segment.SAMPLES for n in rows.values()) > 0.9 * len(rows)


def test_third_samples_follow_the_distribution():
    n, text = 6000, "the cat"
    p, got = {k: math.exp(v) for k, v in listed(text).items()}, Counter()
    for _, rank, _, _, _, ids in segment.encode(P, [text] * n, seeds(n), 3):
        got[tuple(ids.tolist())] += rank == 3
    for k in sorted(p, key=p.get)[-4:]:
        rest = [a for a in p if a != k]
        expected = sum(p[a] * p[b] / (1 - p[a]) * p[k] / (1 - p[a] - p[b]) for a in rest for b in rest if a != b)
        assert abs(got[k] / n - expected) < 0.03


def test_random_numbers_are_drawn_once_a_piece(monkeypatch):
    """Two a piece, one of them for the value of what leaves there, with logarithms and tables of steps, took most of the time."""
    text, mixed, mix = " ".join(f"word{i} of the cat" for i in range(500)), [0], segment._mix

    def counted(x):
        mixed[0] += x.size
        return mix(x)

    monkeypatch.setattr(segment, "_mix", counted)
    made = [g[5] for g in segment.encode(P, [text], mix(np.arange(1, dtype=np.uint64)), segment.SAMPLES)]
    assert len(made) == segment.SAMPLES and {P.decode(ids) for ids in made} == {text}
    assert mixed[0] < 1.1 * sum(map(len, made))


def test_all_segmentations_come_out_behind_steps_without_another_way():
    full = listed("the ca")
    got = list(segment.encode(P, ["\n" * 3000 + " the ca"], seeds(1), len(full) + 3))
    assert len({tuple(g[5].tolist()) for g in got}) == len(got) == len(full) and got[-1][4] == 1.0


def test_samples_do_not_depend_on_windows(monkeypatch):
    """What lies behind a window is one mass, worked out from the whole path; a draw that leads there widens the window."""
    texts, rows, widened, window = ["the cat sat on the mat " * 4, "\n" * 200 + "hello, a b c", "x " * 90 + "information"] * 100, [], [0], segment.Search._window
    monkeypatch.setattr(segment.Search, "_window", lambda self, path: (widened.__setitem__(0, widened[0] + 1), window(self, path))[1])
    for fall in (0.0, 1e9):
        monkeypatch.setattr(segment.Search, "_FALL", fall)
        rows.append(list(segment.encode(P, texts, seeds(len(texts)), segment.SAMPLES)))
        if fall == 0:
            assert widened[0] > segment.SAMPLES
    for a, b in zip(*rows, strict=True):
        assert a[:2] == b[:2] and np.allclose(a[2:5], b[2:5], atol=1e-6) and np.array_equal(a[5], b[5])
