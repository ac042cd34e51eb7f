"""Gapped k-mer analytics on Spark."""

from __future__ import annotations

from pathlib import Path


#: Rows that Arrow passes to Python at once; rows here hold long texts.
ARROW_ROWS = 2000
#: Python workers give large arrays back to the system when they are done with them.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def ship(spark) -> None:
    """Let Python workers import this package from where the driver has it, bound Arrow's batches, and have workers return memory.

    On a cluster install the package on the nodes or pass it with ``--py-files``;
    this only covers workers that see the driver's file system.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows, min(ARROW_ROWS, int(spark.conf.get(rows))))
    for name, value in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(name, value)
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
