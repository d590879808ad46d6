from __future__ import annotations

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from keyweave.llm import fingerprint as fp


def parts(text: str) -> set[str]:
    return set(re.findall(r"[^\n]{79,127}?[.,;:!?]|[^\n]{1,128}", text))


def recovered(fingerprint: str) -> set[int]:
    """The digests in a fingerprint, peeled by a plain loop that knows nothing of the text."""
    out, sign = set(), lambda x: x - (x >> 63 << 64)
    for shard in fingerprint.split(";")[1:]:
        _, size, cells = shard.split("=")
        size, table = int(size, 16), {}
        for cell in cells.split(","):
            at, c, k, h = (int(x, 16) for x in cell.split(":"))
            table[at] = [c, k, h]
        while pure := next((x for x in table.values() if x[0] == 1), None):
            k, h = pure[1:]
            out.add(sign(k))
            for j in range(3):
                x = table[(k >> 16 * j + 8) % size + j * size]
                x[0], x[1], x[2] = x[0] - 1, x[1] ^ k, x[2] ^ h
        assert all(x == [0, 0, 0] for x in table.values())
    return out


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_query_equals_brute_force(documents):
    rows = sorted(documents.select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in fp.fingerprints_query(documents).collect()}
    by_text: dict[str, set] = {}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        text, nxt, out = r["text"] or "", rows[(i + 1) % len(rows)]["text"] or "", got[r["doc_id"]]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert out["n_chars"] == len(text) and out["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert out["near_edited"] == pytest.approx(dice(parts(text), parts(edited)))
        assert out["near_next"] == pytest.approx(dice(parts(text), parts(nxt)))
        by_text.setdefault(text, set()).add(out["fingerprint"])
        # the published fingerprints alone give the same
        own, other = recovered(out["fingerprint"]), recovered(out["edited_fingerprint"])
        assert len(own) == len(parts(text)) and out["near_edited"] == pytest.approx(dice(own, other))
        assert out["near_next"] == pytest.approx(dice(own, recovered(got[rows[(i + 1) % len(rows)]["doc_id"]]["fingerprint"])))
    assert all(len(x) == 1 for x in by_text.values())


def test_larger_sketches_recover_large_differences(spark):
    texts = [("\n".join(f"a{i}" for i in range(n)), "\n".join(f"a{i}" for i in range(k, n + k))) for n, k in ((0, 0), (3, 1), (40, 2), (400, 400), (1500, 30))]
    df = spark.createDataFrame(texts, "a string, b string").select(fp.digests(F.col("a")).alias("x"), fp.digests(F.col("b")).alias("y"))
    d = fp.difference(F.col("x"), F.col("y"))
    assert [r[0] for r in df.select(d).collect()] == [0, 2, 4, 800, 60]


def test_many_lines_take_linear_time(spark):
    small, large = 20_000, 200_000
    text = lambda n: spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("line number "), i.cast("string"))), "\n").alias("text"))
    times = {}
    for n in (100, small, large):
        began = time.monotonic()
        assert len(recovered(text(n).select(fp.fingerprint(F.col("text")).alias("f")).first()["f"])) == n
        times[n] = time.monotonic() - began
    assert times[large] < 20 * times[small] + 5


def test_an_inserted_character_changes_little(spark):
    text = " ".join(f"Sentence {i} says a thing or two about number {i * 7}, and then it ends." for i in range(60))
    df = spark.createDataFrame([(text, "x" + text)], "a string, b string")
    assert df.select(fp.likeness(fp.digests(F.col("a")), fp.digests(F.col("b")))).first()[0] > 0.9


def test_ranges_of_ids(spark):
    """Any cut into ranges finds the same next documents; nulls come last, equal ids are ordered by text."""
    rows = [(i * 7 % 101, f"t{i}") for i in range(101)] + [(None, "n"), (50, "z"), (50, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {r[0]: r[1] for r in spark.createDataFrame(sorted({(t,) for _, t in rows}), "t string").select("t", F.xxhash64("t")).collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), hashed[r[1]]))
    want = sorted((str(a[0]), a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    for buckets in (1, 3, 40):
        assert sorted((str(r[0]), r[1], r[2]) for r in fp.next_document(df, buckets).select("doc_id", "text", "next_text").collect()) == want


def test_odd_rows(odd_docs):
    rows = fp.fingerprints_query(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["near_edited"] <= 1 for r in rows)
    assert fp.fingerprints_query(odd_docs.limit(0)).count() == 0
