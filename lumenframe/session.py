"""Session settings that queries need wherever they are started."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: For Python workers, which stay from one stage to the next: blocks of 1 MB and more go back to the system once freed.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20)}


def lean_workers(spark: SparkSession) -> SparkSession:
    """Python workers started from now on give memory back; what the session has set stays."""
    for k, v in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(k, v)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from the folder it was loaded from."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), ROOT) if x)
    return lean_workers(spark)
