"""Runs of methods on cases, one at a time in the background, with their results, CSV and traces."""

from __future__ import annotations

import itertools
import json
import threading
import time
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.operators import oracle
from keyweave.plans import evaluate
from keyweave.plans.derived import derived_join
from keyweave.plans.methods import METHODS
from keyweave.sources.fixtures import Case, find_case, list_cases
from keyweave.sources.table import csv_lines
from keyweave.workers import shared_dir

SUMMARY = "seq long, pair_id string, method string, joined long, truths long, true_positives long, precision double, recall double, f double, ms double, forward_won boolean, program string"


class RunTimeout(Exception):
    pass


@dataclass
class Run:
    seq: int
    summary: dict
    trace: dict
    header: str
    lines: DataFrame

    @property
    def csv(self) -> str:
        """The joined rows with a header, fetched when asked for; empty if there is no pair."""
        lines = [r["value"] for r in self.lines.collect()]
        return "\n".join([self.header, *lines]) + "\n" if lines else ""


class Service:
    """Jobs queue on one thread, so that their times do not overlap. Results are files below ``store``, from which a new service
    takes them up again, until cleared."""

    def __init__(self, spark: SparkSession, roots: list[str], data: str, timeout: float = 300.0, store: str | None = None) -> None:
        self.spark, self.roots, self.data, self.timeout = spark, roots, data, timeout
        self.store = (store or f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}").rstrip("/")
        self.pool, self.jobs, self.settings = ThreadPoolExecutor(1), {}, {}
        self.runs = {r.seq: r for r in self._stored()}
        self.ids = itertools.count(1 + max(self.runs, default=0))

    def _stored(self) -> list[Run]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.store)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder) or not len(files.listStatus(folder)):
            return []
        return [self._run(json.loads(r["value"])) for r in self.spark.read.text(f"{self.store}/*/run").collect()]

    def _run(self, kept: dict) -> Run:
        lines = self.spark.read.schema("value string").text(f"{self.store}/{kept['summary']['seq']}/csv")
        return Run(kept["summary"]["seq"], kept["summary"], kept["trace"], kept["header"], lines)

    def cases(self) -> list[dict]:
        out = []
        for c in list_cases(self.roots, self.data):
            s, t = c.source(self.spark, self.data), c.target(self.spark, self.data)
            out.append({"pair_id": c.pair_id, "source": {"rows": s.count(), "columns": s.width}, "target": {"rows": t.count(), "columns": t.width}})
        return out

    def submit(self, pair_id: str, method: str = "AJ") -> int:
        job = next(self.ids)
        self.jobs[job] = (time.time(), self.pool.submit(self.run, pair_id, method, job))
        return job

    def job_status(self, job: int) -> dict:
        began, future = self.jobs[job]
        state: Future = future
        if not state.done():
            return {"status": "running", "elapsed": time.time() - began}
        return {"status": "error", "error": str(state.exception())} if state.exception() else {"status": "done", "result": state.result().seq}

    def system_info(self) -> dict:
        conf, heap = self.spark.sparkContext.getConf(), self.spark._jvm.java.lang.Runtime.getRuntime()
        return {"heap_max": heap.maxMemory(), "heap_used": heap.totalMemory() - heap.freeMemory(), "driver_memory": conf.get("spark.driver.memory", ""), "executor_memory": conf.get("spark.executor.memory", ""), "parallelism": self.spark.sparkContext.defaultParallelism, "timeout": self.timeout}

    def run(self, pair_id: str, method: str, seq: int | None = None) -> Run:
        """Runs a method on a case and keeps the result; Spark jobs are cancelled after the timeout."""
        case = find_case(self.roots, self.data, pair_id)
        seq = next(self.ids) if seq is None else seq
        s, t, truth = case.source(self.spark, self.data), case.target(self.spark, self.data), case.truth(self.spark, self.data)
        began, tag, trace, late = time.perf_counter(), f"keyweave-{seq}", {}, threading.Event()
        timer = threading.Timer(self.timeout, lambda: (late.set(), self.spark.interruptTag(tag)))
        self.spark.addTag(tag)
        timer.start()
        try:
            result = None
            if method in ("AJ", "AJ-E"):
                result = derived_join(s, t, fuzzy=method == "AJ")
                pairs, trace = result.pairs, result.trace
            elif method == "FJ-O" and case.pair_id in self.settings:
                tok, dist, threshold = self.settings[case.pair_id]
                pairs = oracle.pairs_at(oracle.nearest_rows(s.values(s.keys), t.values(t.keys), (tok,), (dist,)), (threshold,)).select("src_rid", "tgt_rid")
            else:
                pairs = METHODS[method](s, t)
            pairs = pairs.persist()
            pairs.count()
            ms = 1000 * (time.perf_counter() - began)
            got = evaluate.scores(evaluate.fingerprints(pairs, s, t, case.source_keys, case.target_keys), truth).first()
            header, lines = csv_lines(pairs, s, t)
            lines.write.mode("overwrite").text(f"{self.store}/{seq}/csv")
            pairs.unpersist()
        except Exception as e:
            if late.is_set():
                raise RunTimeout(f"{method} took more than {self.timeout} s") from e
            raise
        finally:
            timer.cancel()
            self.spark.removeTag(tag)
        summary = {"seq": seq, "pair_id": pair_id, "method": method, "joined": got["produced"], "truths": got["truths"], "true_positives": got["true_positives"], "precision": got["precision"], "recall": got["recall"], "f": got["f"], "ms": ms, "forward_won": bool(result.forward_won) if result else None, "program": result.program if result else None}
        kept = json.dumps({"summary": summary, "trace": trace, "header": header}, default=str)
        self.spark.createDataFrame([(kept,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.store}/{seq}/run")
        self.runs[seq] = self._run(json.loads(kept))
        return self.runs[seq]

    def tune_oracle(self, pair_ids: list[str]) -> tuple[str, str, float]:
        """The setting with the best mean F-score over the cases, which FJ-O then runs with on them."""
        every = None
        for pair_id in pair_ids:
            case = find_case(self.roots, self.data, pair_id)
            s, t = case.source(self.spark, self.data), case.target(self.spark, self.data)
            pairs = oracle.pairs_at(oracle.nearest_rows(s.values(s.keys), t.values(t.keys)))
            truth = case.truth(self.spark, self.data)
            n = truth.count()
            sf = s.values(s.positions(case.source_keys), "|").select(F.col("_rid").alias("src_rid"), F.col("value").alias("src_fp"))
            tf = t.values(t.positions(case.target_keys), " | ").select(F.col("_rid").alias("tgt_rid"), F.col("value").alias("tgt_fp"))
            named = pairs.join(sf, "src_rid").join(tf, "tgt_rid").select("tok", "dist", "threshold", "src_fp", "tgt_fp").distinct()
            ok = named.join(truth.withColumn("_ok", F.lit(1)), ["src_fp", "tgt_fp"], "left").groupBy("tok", "dist", "threshold").agg((2 * F.count("_ok") / (F.count("*") + n)).alias("f"))
            every = ok if every is None else every.unionByName(ok)
        place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
        mean = every.groupBy("tok", "dist", "threshold").agg((F.sum("f") / len(pair_ids)).alias("f"))
        best = mean.orderBy(F.desc("f"), place(oracle.GRID_TOKENISERS, "tok"), place(oracle.GRID_DISTANCES, "dist"), "threshold").first()
        setting = best["tok"], best["dist"], best["threshold"]
        self.settings |= dict.fromkeys(pair_ids, setting)
        return setting

    def results(self) -> DataFrame:
        """All summaries, newest first."""
        rows = [tuple(r.summary[c.split()[0]] for c in SUMMARY.split(", ")) for r in self.runs.values()]
        return self.spark.createDataFrame(rows, SUMMARY).orderBy(F.desc("seq"))

    def result(self, seq: int) -> Run:
        return self.runs[seq]

    def clear(self) -> None:
        self.runs.clear()
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.store)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
