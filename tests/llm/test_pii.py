from __future__ import annotations

import hashlib
import re
import time

from pyspark.sql import functions as F

from keyweave.llm import pii

_LUHN = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
_BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and _LUHN(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}
HARD = ["a@b.c_d@e.f x 1.2.3.4.5.6.7.8 999.1.1.1 000255.1.2.03", "4111 1111 1111 1111 " * 40 + " é😀 x@y.zz " * 30, "a" * 30_000, "1" * 30_000, "1." * 3_000, "a.a" * 9_000 + "@b", "+1 " * 5_000 + "+44 20 7946 0958 end", "@", "a@b", "+1-()-2"]


def brute(text: str) -> dict[str, list[str]]:
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if ok(m.group())] for k, (p, ok) in _BASE.items()}


def check(df) -> None:
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in pii.spans_query(df).collect():
        want = brute(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(v) for v in want.values()]
        assert r["base_sha256"] == hashlib.sha256(",".join(x for v in want.values() for x in v).encode()).hexdigest()


def test_base_spans_equal_the_plain_patterns(spark, documents):
    check(documents)
    check(spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string"))


def test_checksums_and_context_add_spans(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00; my ssn 123-45-6789 " + "." * 60 + " 123-45-6780"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.pii_spans(df).first()["pii"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["DE89 3704 0044 0532 0130 00", "123-45-6789"]
    assert all(0 < s["score"] <= 1 for s in spans)
    assert pii.redact(df).first()["text"].count("[") == 2


def test_running_sum_of_many(spark):
    df = spark.range(1).selectExpr("transform(sequence(1, 1000), x -> cast(x as int)) as n").select(pii.running_sum(F.col("n")).alias("s"))
    assert df.first()["s"] == [i * (i + 1) // 2 for i in range(1, 1001)]


def test_secrets(spark):
    key, plain = "AKIA" + "ABCD1234EFGH5678", "0123456789abcdef0123456789abcdef01234567"
    text = f"use {key} here; " + ". " * 40 + f"token = \"{plain}\" there. " + "x " * 40 + plain + " and anhorriblylongwordwithnodigit"
    spans = pii.pii_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["pii"]
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in spans] == [("key", key), ("secret", plain)]


def test_many_matches_take_linear_time(spark):
    """A hundred thousand addresses and cards in one text."""
    text = "a@b.cc 4111111111111111, " * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    got = pii.spans_query(df).first()
    assert (got["n_email"], got["n_card"]) == (100_000, 100_000) and got["spans"].endswith(f"card:{len(text) - 18}:{len(text) - 2}")
    assert pii.redact(df).first()["text"] == "[EMAIL] [CARD], " * 100_000
    assert time.monotonic() - began < 60


def test_clashing_columns_pass_through(spark):
    names = ["doc_id", "text", "_m", "_g", "_ok", "_ends", "_text", "_pii", "x.y"]
    df = spark.createDataFrame([(1, "a@b.cc", *["keep"] * 7)], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    assert pii.redact(df).first() == (1, "[EMAIL]", *["keep"] * 7)
    out = pii.pii_spans(df)
    assert out.columns == [*names, "pii"] and out.first()[2:9] == ("keep",) * 7


def test_odd_rows(odd_docs):
    rows = pii.spans_query(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["spans"] == "" for r in rows)
    assert pii.redact(odd_docs).columns == odd_docs.columns
    assert pii.spans_query(odd_docs.limit(0)).count() == 0
