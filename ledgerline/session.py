"""Session construction and the shared scratch folder.

On a cluster the shared folder is whatever the deployment names in
``spark.checkpoint.dir``; we only invent one (under /tmp) when running in local
mode with the setting absent, as in tests.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def _default_driver_memory() -> str:
    """About 60% of physical memory, at most 16g (local mode: the driver is the executor)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        gb = max(1, min(16, int(total * 0.6 / 2**30)))
        return f"{gb}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def build_session(master: str | None = None, app: str = "ledgerline", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with AQE, UTC and Arrow on and the web page off.

    A master is only set if one is asked for (argument or LEDGERLINE_MASTER) or if nobody else can have set it, that is
    outside spark-submit; the shuffle partitions likewise, so a cluster keeps its own settings."""
    master = master or os.environ.get("LEDGERLINE_MASTER")
    if master is None and "PYSPARK_GATEWAY_PORT" not in os.environ:
        master = f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    if shuffle_partitions is None and master is not None and master.startswith("local"):
        shuffle_partitions = 8
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master is not None:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEM") or _default_driver_memory())
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors for materialised tables and checkpoints.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). When unset,
    only a local-mode session may fall back to a fresh scratch folder under /tmp.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        return d.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    key = sc.applicationId
    if key not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[key] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(_LOCAL_SCRATCH[key] + "/ckpt")
    return _LOCAL_SCRATCH[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder (never reused, never cleaned by us)."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def sweep(spark: SparkSession) -> None:
    """Has the driver's JVM collect garbage: Spark deletes the shuffle files of finished queries only when their plans are
    collected, which a driver with free memory puts off (spark.cleaner.periodicGC.interval, 30 minutes)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
