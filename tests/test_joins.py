from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from keyweave.operators import discovery, fuzzy, substring_match
from keyweave.plans.derived import derived_join
from keyweave.plans.learn import example_sets
from keyweave.plans.methods import METHODS
from keyweave.plans.synth import learn_program
from keyweave.sources.table import JoinTable
from keyweave.streaming.apply import join_stream

PRESIDENTS = ["Barack Obama", "George W. Bush", "Bill Clinton", "George H. W. Bush", "Ronald Reagan"]
RATED = ["Obama, Barack(1961-)", "Bush, George W.(1946-)", "Clinton, Bill(1946-)", "Bush, George H. W.(1924-)", "Reagan, Ronald(1911-2004)"]


def one_column(spark, name, values) -> JoinTable:
    return JoinTable.from_rows(spark, [name], [[v] for v in values], [name])


def matched(result, source, target) -> set[tuple[str, str]]:
    s = {r["_rid"]: r["_cells"][0] for r in source.df.collect()}
    t = {r["_rid"]: r["_cells"][0] for r in target.df.collect()}
    return {(s[r[0]], t[r[1]]) for r in result.collect()}


def test_learns_and_generalises():
    p = learn_program([((RATED[0],), PRESIDENTS[0]), ((RATED[1],), PRESIDENTS[1]), ((RATED[2],), PRESIDENTS[2])])
    assert p.apply((RATED[4],)) == PRESIDENTS[4] and p.complexity <= 6
    mails = [(("Sumit", "Chowdhury"), "schowdhury@forsyth.k12.ga.us"), (("Michelle", "Payne"), "mpayne@forsyth.k12.ga.us"), (("Ann", "Lee"), "alee@forsyth.k12.ga.us")]
    assert learn_program(mails).apply(("Bob", "Ray")) == "bray@forsyth.k12.ga.us"
    assert learn_program([(("a",), "FIXED"), (("b",), "FIXED"), (("c",), "FIXED")]).constant
    assert learn_program([(("abc",), "xyz"), (("def",), "uvw")]) is None and learn_program([]) is None


def test_learns_lengths_beyond_the_shortest_example():
    names = [(("Li",), "Li"), (("Smithson",), "Smit"), (("Johnson",), "John")]
    assert learn_program(names).apply(("Washington",)) == "Wash"
    logins = [(("Ann", "Li"), "ali"), (("Bob", "Smithson"), "bsmith"), (("Cy", "Johnson"), "cjohns")]
    assert learn_program(logins).apply(("Dan", "Washington")) == "dwashi"
    parts = [(("Li, Ann",), "LI-an"), (("Smithson, Bobby",), "SMIT-bo"), (("Johnson, Cyril",), "JOHN-cy")]
    assert learn_program(parts).apply(("Washington, Dave",)) == "WASH-da"


def test_search_gives_up_on_what_no_operator_supplies():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ,-") for _ in range(n))
    began = time.monotonic()
    for _ in range(20):
        learn_program([((word(30), word(20)), word(25)) for _ in range(3)])
    assert time.monotonic() - began < 30


def test_example_sets():
    sets = example_sets(20)
    assert len(sets) == len(set(sets)) == 12 and all(len(s) == 3 for s in sets)
    assert example_sets(2) == [(0, 1)] and example_sets(0) == []


def test_optimal_grams(spark):
    s, t = one_column(spark, "p", PRESIDENTS), one_column(spark, "q", RATED)
    best = {r["v"]: r for r in discovery.optimal_grams(s.melted(), t.melted()).collect()}
    assert best["Barack Obama"]["gram"] == "Barack" and best["Barack Obama"]["score"] == 1.0
    assert best["George W. Bush"]["gram"] == "George W."


def test_figures(spark):
    s, t = one_column(spark, "President", PRESIDENTS), one_column(spark, "President", RATED)
    assert set(zip(PRESIDENTS, RATED, strict=True)) <= matched(derived_join(s, t).pairs, s, t)
    a = JoinTable.from_rows(spark, ["First", "Second"], [["FOO", "001"], ["BAR", "002"], ["BAZ", "003"]])
    b = one_column(spark, "Key", ["FOO-001", "BAR-002", "BAZ-003"])
    assert derived_join(a, b).pairs.count() == 3
    none = derived_join(one_column(spark, "A", ["apple", "banana", "cherry"]), one_column(spark, "B", ["111", "222", "333"]))
    assert none.pairs.count() == 0 and none.trace["inputs"][0]["rows"] == 3


def test_fuzzy_goldens(spark):
    values = lambda vs: spark.createDataFrame(list(enumerate(vs)), "_rid long, value string")
    got = fuzzy.top1_join(values(["mpayne@forsyth.k12.ga.us"]), values(["mipayne@forsyth.k12.ga.us"])).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0.125)]
    assert [tuple(r) for r in fuzzy.top1_join(values(["sales"]), values(["sales", "sales dept"])).collect()] == [(0, 0, 0.0)]
    assert fuzzy.top1_join(values(["George Bush", "George W. Bush"]), values(["Bush, George W."])).count() <= 1
    assert fuzzy.top1_join(values([" ", ""]), values([""])).count() == 2  # a threshold of 0 keeps what is at distance 0
    assert fuzzy.top1_join(values([]), values(["a"])).count() == 0


def test_closed_threshold_is_what_bisection_finds(spark):
    rng = random.Random(3)
    ds = [None, 0.0, 1.0, 1 / 1024, *[rng.random() for _ in range(300)], *[i / 16 for i in range(17)]]

    def bisected(d):
        low, high = 0.0, 1.0
        while high - low > 0.001:
            mid = (low + high) / 2
            low, high = (mid, high) if d is None or mid < d else (low, mid)
        return low

    rows = spark.createDataFrame([(i, d) for i, d in enumerate(ds)], "i int, d double").select("i", fuzzy.closed_threshold(F.col("d")).alias("t")).collect()
    for r in rows:
        assert r["t"] == pytest.approx(bisected(ds[r["i"]]), abs=1e-12), ds[r["i"]]


def test_substring_formula(spark):
    rows = [["anna", "lindgren"], ["bob", "marley"], ["carla", "bruni"], ["dora", "maarov"], ["erik", "satieson"]]
    s = JoinTable.from_rows(spark, ["f", "l"], rows)
    t = one_column(spark, "login", [f"{a[0]}-{b}" for a, b in rows])
    pairs, formulas = substring_match.formula_join(s, t)
    assert {tuple(r) for r in pairs.collect()} == {(i, i) for i in range(5)} and formulas
    assert substring_match.longest_common_substring("xabcx", "yabcyab") == (1, 1, 3)
    assert substring_match.Copy(0, 1, 3).apply(["abc"]) is None and substring_match.Copy(0, 3).apply(["abc"]) is None


def test_every_method_runs(spark):
    s, t = one_column(spark, "a", ["red fox", "blue whale", "grey wolf"]), one_column(spark, "b", ["the red fox", "the blue whale", "the grey wolf"])
    for name in ("FJ-C", "FJ-FR", "FJ-O", "DQ-P", "DQ-R"):
        assert matched(METHODS[name](s, t), s, t) == {("red fox", "the red fox"), ("blue whale", "the blue whale"), ("grey wolf", "the grey wolf")}, name


def test_stream_joins_a_static_target(spark, tmp_path):
    spark.createDataFrame([(i, f"user{i}") for i in range(6)], "id long, name string").write.parquet(str(tmp_path / "in"))
    target = spark.createDataFrame([(10, "U-3"), (11, "U-4"), (12, "U-4")], "_rid long, value string")
    from keyweave.plans.program import Constant, Program, substr

    rows = spark.readStream.schema("id long, name string").parquet(str(tmp_path / "in"))
    out = join_stream(rows, Program((Constant("U-"), substr(0, 4))), ["name"], target)
    q = out.writeStream.format("memory").queryName("joined").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["id"], r["tgt_rid"]) for r in spark.table("joined").collect()] == [(3, 10)]
