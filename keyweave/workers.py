"""Lets Python workers import this package where the driver only has it on its own path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in workers: on this machine by their PYTHONPATH, on a cluster as a file that Spark hands to
    the executors, once an application."""
    context = spark.sparkContext
    if context.master.startswith("local"):
        environment, root = context.environment, str(_PACKAGE.parent)
        known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in known:
            environment["PYTHONPATH"] = os.pathsep.join([*known, root])
    elif context.applicationId not in _shipped:
        path = Path(tempfile.mkdtemp(prefix="keyweave-")) / "keyweave-package.zip"  # the driver's own copy, from which Spark serves it
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(_PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(_PACKAGE.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset on a local master, a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="keyweave-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")
