"""Nearest neighbours by a block matrix join with int8 tiles and exact re-scoring."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import python_tasks, table

#: Vectors per candidate block and per query block; a tile holds one of each.
CANDIDATE_BLOCK, QUERY_BLOCK = 16384, 2048
#: Queries multiplied at once inside a tile (bounds the product matrix to 16384 x 128 numbers).
STRIP = 128
#: Room for float32 rounding on top of the quantisation error.
SLACK = 4e-6


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as int8 codes: codes, scale, length of the coded vector, length of what coding lost."""
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.sqrt((coded * coded).sum(1)), np.sqrt(((unit - coded) ** 2).sum(1))


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 codes, exact: float32 holds the whole sums of up to 1024 products of 127 x 127."""
    out = None
    for k in range(0, a.shape[1], 1024):
        part = a[:, k:k + 1024].astype(np.float32) @ b[:, k:k + 1024].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of row pairs in double precision, added up in the order of the components."""
    dot, na, nb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        x, y = a[:, j], b[:, j]
        dot += x * y
        na += x * x
        nb += y * y
    return dot / (np.sqrt(na) * np.sqrt(nb))


def tile_top(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k nearest ids of one candidate block for each query of one query block, as (query, candidate, cosine).

    An id counts once, with its best vector. A pair survives if its upper bound reaches the k-th largest of the ids' best
    lower bounds, so no true neighbour is lost.
    """
    by = np.argsort(cid, kind="stable")
    cid, c = cid[by], c[by]
    starts = np.flatnonzero(np.append(True, cid[1:] != cid[:-1]))
    cc, cs, _, ce = quantise(c)
    for at in range(0, len(qid), STRIP):
        ids, x = qid[at:at + STRIP], q[at:at + STRIP]
        qc, qs, ql, qe = quantise(x)
        near = int8_product(qc, cc) * (qs[:, None] * cs[None, :])
        slack = qe[:, None] + ql[:, None] * ce[None, :] + SLACK
        for i, (lo, hi) in enumerate(zip(np.searchsorted(cid, ids, "left"), np.searchsorted(cid, ids, "right"))):
            near[i, lo:hi] = -np.inf
        low = near - slack
        if len(starts) < len(cid):
            low = np.maximum.reduceat(low, starts, axis=1)
        if len(starts) > k:
            least = np.partition(low, len(starts) - k, axis=1)[:, len(starts) - k]
        else:
            least = np.full(len(ids), -np.inf)
        near += slack
        for i in range(len(ids)):
            keep = np.flatnonzero((near[i] >= least[i]) & (near[i] > -np.inf))
            if len(keep):
                exact = cosines(np.broadcast_to(x[i], (len(keep), x.shape[1])), c[keep])
                found = cid[keep]
                first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
                for less, j in heapq.nsmallest(k, zip(-np.maximum.reduceat(exact, first), found[first])):
                    yield int(ids[i]), int(j), float(-less)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the largest cosine for each query, ties to the smaller id.

    Rows whose id is null or whose vector is null, empty, zero or holds null or non-finite components take no part.
    Equal rows (same id and vector) count once; rows with the query's id are its own and no candidates; if an id stands
    on several vectors, its best cosine counts. Vectors of different lengths are not compared. Empty input gives an
    empty result.

    Candidates and queries are dealt into blocks by id and vector, so an id on many vectors is spread; every (query block,
    candidate block) tile is one group, so memory doesn't grow with the data. Every candidate goes to each query block (an
    exact block join reads both sides in full). Tiles give k rows per query, which a window merges.
    """
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"), is_query.alias("q")) \
        .where("id is not null and size(x) > 0 and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('inf')) and exists(x, e -> e <> 0)") \
        .groupBy("id", "x").agg(F.max("q").alias("q"))
    python_tasks(vectors.sparkSession)
    n, n_q = x.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    blocks, q_blocks = -(-n // CANDIDATE_BLOCK) or 1, -(-n_q // QUERY_BLOCK) or 1
    dealt = x.withColumn("dim", F.size("x"))
    cand = dealt.select("id", "x", "dim", F.pmod(F.xxhash64("id", "x", F.lit(1)), F.lit(blocks)).alias("cb"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"))
    ask = dealt.where("q").select("id", "x", "dim", F.pmod(F.xxhash64("id", "x", F.lit(2)), F.lit(q_blocks)).alias("qb"),
                                  F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("cb"))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        def read(t):
            ids = t.column("id").to_numpy()
            flat = t.column("x").combine_chunks()
            flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([y.flatten() for y in flat.chunks])
            return ids, flat.to_numpy(zero_copy_only=False).reshape(len(ids), -1)

        found = []
        if left.num_rows and right.num_rows:
            (qid, q), (cid, c) = read(right), read(left)
            found = list(tile_top(qid, q, cid, c, k))
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()),
                         "score": pa.array([f[2] for f in found], pa.float64())})

    tiles = cand.groupBy("dim", "cb", "qb").cogroup(ask.groupBy("dim", "cb", "qb")) \
        .applyInArrow(tile, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tiles.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")) \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
             AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_inner_product(q.x, c.x) / (sqrt(list_inner_product(q.x, q.x)) * sqrt(list_inner_product(c.x, c.x))) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op8_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
