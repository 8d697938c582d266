"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import scratch_path

#: Rows per Arrow batch sent to Python: with texts of 100 KB a batch stays near 50 MB.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{tag}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def python_tasks(spark: SparkSession) -> None:
    """Before Python runs in tasks: let workers import this package and keep Arrow batches of texts small.

    Batches are sized in rows, not bytes. On a cluster the package must stand at the same path or be installed.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def binary_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def deal_out(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by ``cols``; the number of partitions is the session's."""
    return df.repartition(*[F.col(c) for c in cols])


def join_labels(rows: DataFrame, labels: DataFrame, key: str, times: str, most: int = 1000) -> DataFrame:
    """``rows`` with the label of their ``key``; ``labels`` has one row per key and says in ``times`` how many rows it has.

    Keys with more than one in ``most`` of all rows, fewer than ``most`` keys, are broadcast; all others are joined by
    shuffle, where no key brings more than that share into one task.
    """
    total = labels.agg(F.sum(times)).first()[0] or 0
    hot = labels.where(F.col(times) * most > total).drop(times)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(labels.where(F.col(times) * most <= total).drop(times), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Cut batches sorted by ``key`` into pieces that hold whole runs of equal keys.

    Yields (starts, arrays): ``starts`` are the run starts plus the end. A run longer than a batch is carried over,
    so callers must have bounded the runs.
    """
    held: list[list[np.ndarray]] = []
    last = None

    def cut(parts):
        arrays = [np.concatenate(x) for x in zip(*parts)]
        k = arrays[0]
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
        return starts, arrays

    for b in batches:
        if not b.num_rows:
            continue
        arrays = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in [key, *columns]]
        k = arrays[0]
        change = int(np.searchsorted(k, k[-1], side="left")) if k[0] != k[-1] else 0
        if held and k[0] != last or change:
            first = [a[:change] for a in arrays]
            if held and k[0] != last:
                yield cut(held)
                held = []
            if change:
                yield cut([*held, first])
                held = []
        held.append([a[change:] for a in arrays])
        last = k[-1]
    if held:
        yield cut(held)
