from __future__ import annotations

import base64
import hashlib
import io
import math
import random
import re
import zipfile

import numpy as np
import pytest

from keyweave.llm import queries, topk, urlfilter, warczip
from keyweave.llm.oracles import ORACLES
from tests.oracle import assert_same, views


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), ORACLES[name], views(sf_dir))


@pytest.mark.parametrize("scale", [300, 1e-3, 1e12, 1e150])
def test_bounds_enclose_scores(scale):
    rng = np.random.default_rng(1)
    vectors, queries_ = np.floor(rng.normal(size=(200, 8)) * scale), np.floor(rng.normal(size=(5, 8)) * scale)
    vectors[:, 3] = 7
    lower, upper = topk.Chunk.of(vectors).bounds(queries_)
    exact = queries_ @ vectors.T
    assert (lower <= exact).all() and (exact <= upper).all()
    assert scale != 300 or ((upper - lower) < 0.05 * np.abs(exact).max()).all()


def brute_top_k(rows: list, k: int) -> set:
    floor = lambda x: x if abs(x) >= 2**53 else math.floor(1024 * x) / 1024
    vectors = [(i, [int(1024 * floor(x)) if abs(x) < 2**53 else 1024 * int(x) for x in v]) for i, v in rows]
    out = set()
    for q, a in vectors:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors if i != q and len(a) == len(b))[:k]
            out |= {(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best, 1)}
    return out


def test_top_k_in_blocks_equals_brute_force(spark, monkeypatch):
    """Equal vectors in number, ties, huge components, and more blocks than one of each kind."""
    monkeypatch.setattr(topk, "CHUNK", 16)
    monkeypatch.setattr(topk, "CHUNKS", 2)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in (np.ones(4) if i % 3 == 0 else rng.integers(-3, 4, 4) / 2)]) for i in range(600)]
    rows += [(1000 + i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(0, 30)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top10_query(df).collect()} == brute_top_k(rows, 10)


def test_top_k_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [9.0, 9.0]), (3, [1.0, 2.0]), (4, None), (5, [3.0]), (6, [2.0, 3.0]), (7, [1.0, None]), (8, [1.0, float("nan")]), (9, []), (100, [5.0]), (200, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top10_query(df).collect()) == [(0, 1, 6, 8 << 20), (0, 2, 3, 5 << 20), (100, 1, 5, 15 << 20)]
    assert topk.top10_query(df.limit(0)).count() == 0
    large = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e300])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top10_query(large).collect()) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_automaton_equals_regular_expressions():
    rng = random.Random(5)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?"]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    machine = urlfilter.Automaton.of(globs)
    assert len(machine.start) > 2
    texts = ["".join(rng.choice("ab/.é") for _ in range(rng.randrange(14))) for _ in range(400)] + ["", "a" * 500]
    star = re.compile(r"\*\*|\*|\?|.", re.S)
    # three stars read as two and one
    plain = [re.compile("".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in star.findall(g)), re.S) for g in globs]
    assert machine.first(texts).tolist() == [next((i for i, p in enumerate(plain) if p.fullmatch(t)), -1) for t in texts]


def test_urls(spark):
    urls = [None, "", "x", "http://NET/", "http://net", "http://a.NET/b?c", "http://my.net:80/", "http://u.example.net/en/x", "http://example.net/EN/", "https://xnet/", "ftp://w.org/fr/#y", "http://a.com/x.net/y", "http://h/a/cgi-bin/b", "http://e.com/a.exe", "http://" + "a" * 3000 + ".net/" + "b" * 3000]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r["rule"], r["verdict"]) for r in urlfilter.judge(df).orderBy("page_id").collect()]
    assert got == [(None, "allow")] * 3 + [("net/", "block"), (None, "allow"), ("net/", "block"), (None, "allow"), ("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"), (None, "block"), (None, "block"), ("net/", "block")]
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "u\n", None), (2, None, ""), (None, "x", "abc"), (None, "x", "abc"), (3, "é", "é" * 1000), (3, "é", "é" * 1000), (9, "z", "abc"), (2**60 + 1, "w", "q\r\n\r\nr")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for zip64 in (False, True):
        folder = f"file://{tmp_path}/{zip64}"
        got = warczip.read_archives(warczip.write_archives(df, folder, zip64=zip64), payloads=True).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["record_type"] == "response":
                assert r["payload_digest"] == base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() and r["refers_to"] is None
        kinds = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got)
        assert kinds == sorted([("1", "revisit", "2"), ("2", "response", "None"), ("None", "revisit", "9"), ("None", "revisit", "9"), ("3", "response", "None"), ("3", "response", "None"), ("9", "response", "None"), (str(2**60 + 1), "response", "None")])
    assert warczip.archives_query(df.limit(0)).count() == 0


def test_zip_directories():
    for big in (False, True):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
            for name in ("a/b", "c"):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=big) as f:
                    f.write(name.encode() * 10)
            z.comment = b"a remark"
        raw = data.getvalue()
        read = lambda at, n, raw=raw: raw[at : at + n]
        found = warczip.members(read, len(raw))
        assert list(found) == ["a/b", "c"]
        assert all(read(warczip.data_offset(read, m), m.size) == n.encode() * 10 for n, m in found.items())
    with pytest.raises(ValueError):
        warczip.members(lambda at, n: b"x" * n, 10)


def test_zip64_directory_end():
    """More than 65,535 members put the directory's place into the ZIP64 record."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        for i in range(65_600):
            z.writestr(zipfile.ZipInfo(str(i)), b"")
    raw = data.getvalue()
    assert len(warczip.members(lambda at, n: raw[at : at + n], len(raw))) == 65_600


def test_hadoop_paths_name_their_store(tmp_path):
    assert warczip.uri("s3a://b/k") == "s3://b/k" and warczip.uri("dbfs:/x/y") == "file:///dbfs/x/y" and warczip.uri("/x") == "file:///x" and warczip.uri("file:/x") == "file:///x"
    with pytest.raises(ValueError, match="no file system"):
        warczip.filesystem("nosuch://x/y")


def test_url_filter_keeps_clashing_columns(spark):
    df = spark.createDataFrame([("https://a.example.com/de/x", *["keep"] * 5)], "url string, _host string, _path string, k string, row string, `a.b` string")
    out = urlfilter.judge(df)
    assert out.columns == [*df.columns, "host", "path", "rule", "verdict"] and out.first()[1:] == (*["keep"] * 5, "a.example.com", "/de/x", "example.com/de/", "block")
