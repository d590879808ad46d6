from __future__ import annotations

import gc
import os
import time

from pyspark.sql import functions as F

import corpus_pipeline
from keyweave.llm import common, linededup, neardup


def local_bytes(spark) -> int:
    """Bytes of shuffle files."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(os.path.getsize(f"{d}/{x}") for top in env.localDirsString() for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_"))



def settled(spark, most: int) -> bool:
    """Whether no more than so many bytes of shuffle files stay; they are removed in the background."""
    for _ in range(50):
        if local_bytes(spark) <= most:
            return True
        time.sleep(0.1)
    return False


def test_shuffle_files_go_with_the_write(spark):
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    before, setting = local_bytes(spark), spark.conf.get(common._CLEANUP)
    rows = spark.range(200_000).groupBy(F.md5(F.col("id").cast("string")).alias("k")).agg(F.first("id").alias("id"))
    got = common.materialize(rows, "shuffled")
    assert settled(spark, before + 100_000) and got.count() == 200_000 and spark.conf.get(common._CLEANUP) == setting
    again = common.materialize(got, "again", drop=(got,))
    assert not os.path.exists(got._scratch.removeprefix("file:")) and again.count() == 200_000 and rows.count() == 200_000


def test_near_duplicates_leave_no_text_behind(spark, documents):
    before = {x: 1 for x in os.listdir(common.shared_dir(spark).removeprefix("file:"))}
    assert neardup.classes_query(documents).count() == documents.count()
    left = {x.rsplit("-", 1)[0] for x in os.listdir(common.shared_dir(spark).removeprefix("file:")) if x not in before}
    assert {"ids", "classes"} <= left and not left & {"once", "signed", "texts", "shared", "candidates", "elements", "heads", "meetings", "few", "need"}


def test_lines_leave_no_line_behind(spark, documents):
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert linededup.lines_query(documents).count() == documents.count()
    assert {x.rsplit("-", 1)[0] for x in os.listdir(folder) if x not in before} == {"lines-repeated"}


def test_pipeline_keeps_one_stage(spark, sf_dir):
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [x.rsplit("-", 1)[0] for x in os.listdir(folder) if x not in before and x.startswith("stage-")] == ["stage-private"]
