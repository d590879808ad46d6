"""Times join methods over growing bibliographies: sizes x methods x repeats, with the median of each; a JSON line per size and method.

    python scalability.py [sizes] [methods] [repeats] [seconds]      e.g. 1000,10000,100000 AJ,FJ-C,FJ-O,SM 3 300

A method that takes more than the given seconds is reported as a timeout and left out for larger sizes.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, n: int) -> DataFrame:
    """n invented publications: title, authors, year."""
    word = lambda i: F.translate(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(i))), 1, 7), "0123456789", "ghijklmnop")
    authors = F.concat(F.initcap(word("a")), F.lit(" "), F.initcap(word("b")))
    return spark.range(n).select("id", F.initcap(F.concat_ws(" ", word("t"), word("u"), word("v"))).alias("title"), authors.alias("authors"), (F.col("id") % 40 + 1980).cast("string").alias("year"))


def timed(spark: SparkSession, method, source, target, seconds: float) -> tuple[float | None, int]:
    """Milliseconds (None: timeout) and joined pairs of one run."""
    late, tag = threading.Event(), "scalability"
    timer = threading.Timer(seconds, lambda: (late.set(), spark.interruptTag(tag)))
    spark.addTag(tag)
    timer.start()
    began = time.perf_counter()
    try:
        n = method(source, target).count()
        return 1000 * (time.perf_counter() - began), n
    except Exception:
        if late.is_set():
            return None, 0
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)


def main(sizes: str = "1000,10000,100000", methods: str = "AJ,FJ-C,FJ-O,SM", repeats: str = "3", seconds: str = "300") -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from keyweave.plans.methods import METHODS
    from keyweave.sources.fixtures import bibliography

    gone = set()
    for size in map(int, sizes.split(",")):
        source, target = bibliography(records(spark, size).drop("id"), ["title", "authors", "year"])
        for name in methods.split(","):
            if name in gone:
                continue
            runs = []
            for _ in range(int(repeats)):
                ms, n = timed(spark, METHODS[name], source, target, float(seconds))
                if ms is None:
                    gone.add(name)
                    break
                runs.append((ms, n))
            out = {"size": size, "method": name, "cpus": int(cpus)}
            out |= {"timeout": float(seconds)} if name in gone else {"median_ms": round(sorted(m for m, _ in runs)[len(runs) // 2]), "pairs": runs[0][1]}
            print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
