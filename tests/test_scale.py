"""What larger tables showed: results that depended on the size, and steps that grew faster than the tables."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from keyweave.operators import discovery, equijoin, fuzzy, oracle, sampling
from keyweave.plans import derived, evaluate
from keyweave.sources.table import JoinTable


def test_interleaved_sample_takes_every_nth_row(spark, tmp_path):
    """With so many rows and partitions Spark's own ranges differ from job to job."""
    rows, before = 900_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.range(rows, numPartitions=1).select((F.col("id") * 3).alias("_rid"), F.md5(F.col("id").cast("string")).alias("x")).write.parquet(f"{tmp_path}/t")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 48)
        got = sorted(r["_rid"] for r in sampling.interleaved(spark.read.parquet(f"{tmp_path}/t"), rows).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == [3 * int(i * (rows / 400)) for i in range(400)]


def _grams(v: str) -> list[tuple[int, str]]:
    return [(i, v[i:j]) for i in range(len(v)) for j in range(i + 3, len(v) + 1)]


def _rarest(source: list[tuple[int, str]], target: list[tuple[int, str]]) -> dict[str, tuple]:
    """v: gram, n, m, first row of the gram in the target."""
    n, m = (Counter(g for _, v in rows for _, g in _grams(v)) for rows in (source, target))
    out = {}
    for v in {v for _, v in source}:
        longest = {}
        for at, g in _grams(v):
            if g in m and len(g) > len(longest.get(at, "")):
                longest[at] = g
        if longest:
            g = min(longest.items(), key=lambda x: (n[x[1]] * m[x[1]], x[0]))[1]
            out[v] = g, n[g], m[g], min(i for i, x in target if g in x)
    return out


def test_grams_that_many_rows_hold_and_parts_of_few(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 9)))
    source, target = ([(i, word()) for i in range(200)] for _ in range(2))
    s, t = (spark.createDataFrame([(0, i, v) for i, v in rows], "col int, _rid long, v string") for rows in (source, target))
    before = discovery.optimal_grams(s, t)
    before.collect()
    plan = before._jdf.queryExecution().executedPlan().toString()
    # tables of grams are joined by merging, whatever Spark thinks of their size: what is broadcast passes through the driver
    assert plan.split("== Initial Plan")[0].count("SortMergeJoin") >= 3
    monkeypatch.setattr(discovery, "HOT", 12)
    monkeypatch.setattr(discovery, "PART_GRAMS", 300)
    for df in (before, discovery.optimal_grams(s, t)):
        assert {r["v"]: (r["gram"], r["n"], r["m"], r["tgt_rid"]) for r in df.collect()} == _rarest(source, target)


def test_keys_are_split_whatever_the_size(spark):
    """Only the names before the brackets can be derived from each other; tables of more than 1000 rows were not split."""
    word = lambda i: F.initcap(F.translate(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(i))), 1, 7), "0123456789", "ghijklmnop"))
    first, last = word("a"), word("b")
    rows = spark.range(1100).select("id", F.concat(first, F.lit(" "), last, F.lit(" ("), F.col("id") % 5, F.lit(")")).alias("a"), F.concat(last, F.lit(", "), first, F.lit(" (1"), F.col("id") % 7, F.lit("-)")).alias("b"))
    s, t = (JoinTable.from_df(rows.select("id", c), [c], "id") for c in "ab")
    assert {tuple(r) for r in derived.derived_join(s, t, fuzzy=False).pairs.collect()} == {(i, i) for i in range(1100)}


def _jaccard(a: str, b: str, q: int) -> float:
    x, y = ({v[i : i + q] for i in range(len(v) - q + 1)} if len(v) >= q else {v} for v in (a, b))
    return 0.0 if a == b else 1 - len(x & y) / (len(x) + len(y) - len(x & y))


def test_thresholds_and_nearest_values_without_all_pairs(spark, monkeypatch):
    """Few pairs are compared, and the results are those of all pairs."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(1, 12)))
    source = [(i, word()) for i in range(300)]
    target = [(i, v + rng.choice(["", "", " x"])) for i, v in source if i % 7] + [(1000 + i, word()) for i in range(50)]
    s, t = (fuzzy.distinct_values(spark.createDataFrame(rows, "_rid long, value string")).persist() for rows in (source, target))
    first = lambda rows: {v: min(i for i, x in rows if x == v) for _, v in rows}
    ss, ts, rows = first(source), first(target), Counter(v for _, v in target)
    monkeypatch.setattr(fuzzy, "FEW_PAIRS", 0)
    monkeypatch.setattr(fuzzy, "MORE_PROBES", 64)
    asked: list[int] = []
    verify = fuzzy.Tokens.verify
    monkeypatch.setattr(fuzzy.Tokens, "verify", lambda self, met: (asked.append(met.count()), verify(self, met))[1])
    for q in (2, 3):
        ds = {a: sorted((d, ts[b], b) for b in ts if (d := _jaccard(a, b, q)) < 1) for a in ss}
        seconds = []
        for near in ds.values():
            held = 0
            for d, _, b in near:
                held += rows[b]
                if held >= 2:
                    seconds.append(d)
                    break
        best = {a: near[0] for a, near in ds.items() if near}
        held = Counter()
        violating = None
        for d, _, a in sorted((best[a][0], ss[a], a) for a in best):
            held[best[a][2]] += 1
            if held[best[a][2]] == 2:
                violating = d
                break
        tokens = fuzzy.Tokens(s, t, f"q{q}")
        assert tokens.crowded() == min(seconds)
        got, found = tokens.nearest()
        assert found == violating
        assert {(r["s"], r["t"]) for r in got.collect() if r["d"] < found} == {(a, near[2]) for a, near in best.items() if near[0] < found}
        for limit in (0.3, 0.6, 0.9):
            want = {(a, b) for a, near in ds.items() for d, _, b in near if d <= limit}
            assert {(r["s"], r["t"]) for r in tokens.within(limit).collect()} == want
    assert asked and min(asked) < 1000


def test_best_setting_counts_by_value(spark):
    """Rows with equal values are counted, not taken through every setting, and the score is that of the pairs."""
    source = spark.createDataFrame([(i, f"name {i % 5}") for i in range(40)] + [(99, None)], "_rid long, value string")
    target = spark.createDataFrame([(i, f"NAME {i} x") for i in range(5)], "_rid long, value string")
    truth = source.select(F.col("_rid").alias("src_rid"), (F.col("_rid") % 5).alias("tgt_rid")).where("src_rid % 3 > 0")
    pairs = oracle.pairs_at(oracle.nearest_rows(source, target)).collect()
    true, n, tp = {tuple(r) for r in truth.collect()}, Counter(), Counter()
    for r in pairs:
        key = r["tok"], r["dist"], r["threshold"]
        n[key] += 1
        tp[key] += (r["src_rid"], r["tgt_rid"]) in true
    place = lambda k: (oracle.GRID_TOKENISERS.index(k[0]), oracle.GRID_DISTANCES.index(k[1]), k[2])
    best = min(n, key=lambda k: (-2 * tp[k] / (n[k] + len(true)), place(k)))
    got = oracle.best_setting(source, target, truth).collect()
    assert [tuple(r) for r in got] == [(*best, 2 * tp[best] / (n[best] + len(true)))]


def test_pairs_of_common_keys_are_dealt_to_tasks(spark, monkeypatch):
    """One key joins 300 rows with 200: no task may make them all, whatever Spark thinks of the small tables."""
    for module in (equijoin, evaluate):
        monkeypatch.setattr(module, "TASK_ROWS", 5000)
    a = spark.range(300).select(F.col("id").cast("string").alias("src_fp"), F.substring(F.concat(F.lit("k"), F.col("id").cast("string")), 1, 1).alias("k"))
    b = spark.range(200).select(F.col("id").cast("string").alias("tgt_fp"), F.substring(F.concat(F.lit("k"), F.col("id").cast("string")), 1, 1).alias("k"))
    joined = equijoin.many_to_many(a, b, "k").select("src_fp", "tgt_fp")
    sizes = [r["count"] for r in joined.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    assert sum(sizes) == joined.distinct().count() == 60_000 and max(sizes) <= 20_000
    truth = a.select("src_fp", F.col("src_fp").alias("tgt_fp"))
    judged = evaluate.judged(joined.unionByName(joined), truth)
    sizes = [r["count"] for r in judged.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) <= 20_000 and judged.where("ok").count() == 200
