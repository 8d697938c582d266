"""Periodic runs of words inside a text, found by descending-LCP Kruskal over suffix classes."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_texts, python_tasks, table
from .words import shingle_hashes

#: A run has at least so many words and periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of short documents that are searched at once; a longer document is searched alone.
GROUP_WORDS = 1 << 19
#: Positions in one block of an ordered set.
BLOCK = 2048

_BREAK = re.compile(rb"[ \t-\r]")


# ---- suffixes --------------------------------------------------------------------------------------------------

def suffix_levels(ids: np.ndarray) -> list[np.ndarray]:
    """Prefix doubling: for each k the rank of every 2**k-gram, until all differ; the last one ranks the suffixes.

    Equal grams share the rank of the first of them, so only positions that still share one are sorted again.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.append(True, np.diff(ids[order]) != 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    levels, reach = [rank.astype(np.int32)], 1
    while True:
        active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(active):
            return levels
        after = active + reach
        key = rank[active] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        old = rank[active]
        at = np.arange(len(active))
        whole = np.maximum.accumulate(np.where(np.append(True, np.diff(old) != 0), at, 0))
        part = np.maximum.accumulate(np.where(np.append(True, np.diff(key) != 0), at, 0))
        rank = rank.copy()
        rank[active] = old + part - whole
        levels.append(rank.astype(np.int32))
        reach *= 2


def suffix_links(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order that share ``least`` words or more, by descending LCP: (position, position, LCP)."""
    order = np.empty(len(levels[-1]), np.int64)
    order[levels[-1]] = np.arange(len(order))
    gram = levels[min(len(levels) - 1, least.bit_length() - 1)]
    near = np.flatnonzero(gram[order[:-1]] == gram[order[1:]])
    a, b = order[near], order[near + 1]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        x, y = a + lcp, b + lcp
        inside = np.maximum(x, y) < len(order)
        same = inside & (levels[k][np.where(inside, x, 0)] == levels[k][np.where(inside, y, 0)])
        lcp += same.astype(np.int64) << k
    keep = np.flatnonzero(lcp >= least)
    keep = keep[np.argsort(-lcp[keep], kind="stable")]
    return a[keep], b[keep], lcp[keep]


class Positions:
    """An ordered set of positions in blocks, so that adding one stays cheap in a set of millions."""

    __slots__ = ("blocks", "size")

    def __init__(self, x: int) -> None:
        self.blocks, self.size = [[x]], 1

    def add(self, x: int) -> tuple[int, int]:
        """Adds ``x``; its neighbours (-1: none)."""
        blocks, k = self.blocks, 0
        if len(blocks) > 1:
            k = max(0, bisect_right(blocks, x, key=itemgetter(0)) - 1)
        b = blocks[k]
        at = bisect_right(b, x)
        left = b[at - 1] if at else -1
        right = b[at] if at < len(b) else blocks[k + 1][0] if k + 1 < len(blocks) else -1
        b.insert(at, x)
        self.size += 1
        if len(b) > BLOCK:
            blocks[k:k + 1] = [b[:BLOCK // 2], b[BLOCK // 2:]]
        return left, right


def find_runs(ids: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run with ``least`` words and ``times`` smallest periods, by start and period.

    Suffixes are united by decreasing LCP, the smaller ordered set into the larger one. Two positions that become
    neighbours at an LCP of at least their distance p start a stretch of period p that reaches LCP + p words; any smaller
    period would have put a position between them earlier, so p is the smallest. The leftmost such pair of a run gives it
    whole, and each run has exactly one. A run of interest has an LCP of ``floor`` at least, where uniting stops.
    """
    floor = -(-least * (times - 1) // times)
    if len(ids) <= floor:
        return []
    home: dict[int, Positions] = {}
    seeds: list[tuple[int, int, int]] = []
    for a, b, lcp in zip(*(x.tolist() for x in suffix_links(suffix_levels(ids), floor))):
        big = home.get(a) or home.setdefault(a, Positions(a))
        low = home.get(b) or home.setdefault(b, Positions(b))
        if big.size < low.size:
            big, low = low, big
        new = list(chain.from_iterable(low.blocks))
        furthest, before, last = lcp // (times - 1), -1, len(new) - 1
        for i, x in enumerate(new):
            left, right = big.add(x)
            home[x] = big
            if left != before and left >= 0 and x - left <= furthest:
                seeds.append((left, x - left, lcp))
            if right >= 0 and right - x <= furthest and (i == last or right < new[i + 1]):
                seeds.append((x, right - x, lcp))
            before = x
    if not seeds:
        return []
    start, period, lcp = np.array(seeds, np.int64).T
    leftmost = (start == 0) | (ids[start - 1] != ids[start + period - 1])
    keep = leftmost & (lcp + period >= least)
    return sorted(zip(start[keep].tolist(), (lcp + period)[keep].tolist(), period[keep].tolist()), key=itemgetter(0, 2))


# ---- documents -------------------------------------------------------------------------------------------------

def _parts(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut at white space."""
    at = 0
    while at < len(raw):
        found = _BREAK.search(raw, at + size)
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def _numbered(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, equal for equal words, and the distinct words by number."""
    seen: dict[bytes, int] = {}
    ids = [np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) for words in map(bytes.split, _parts(raw))]
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), list(seen)


def _suspects(ids: list[np.ndarray], floor: int) -> list[int]:
    """Documents in which some ``floor`` words in a row come twice, by hashes: all others have no run."""
    offset = np.cumsum([0] + [int(x.max()) + 1 if len(x) else 0 for x in ids])
    flat = np.concatenate([x + o for x, o in zip(ids, offset)]).astype(np.uint64)
    grams = shingle_hashes(flat, floor)
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    ends = np.cumsum([len(x) for x in ids])
    return np.unique(np.searchsorted(ends, np.flatnonzero(np.isin(grams, np.unique(twice))), side="right")).tolist()


def _collapsed(raw: bytes, ids: np.ndarray, words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(b" ".join(p.split()) for p in _parts(raw) if p.strip())
    edges = np.zeros(len(ids) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[i] for i in ids[np.cumsum(edges[:-1]) == 0].tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), collapsed: the text with each run cut to its first period.

    Words are separated by ASCII white space. A run is a maximal stretch with smallest period q, at least ``least`` words
    and ``times`` * q words long. Null and empty texts have no words, no runs and an empty collapsed text; a null doc_id
    stays null; repeated rows are handled each. Runs may overlap; a word goes if any run has it after its first period.
    Empty input gives an empty result. Only doc_id and text are read.

    Documents don't meet, so there is no shuffle; a text is read as a whole by one task, as numbers of its words.
    """
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    floor = -(-least * (times - 1) // times)

    def solve(held: list[tuple]) -> pa.RecordBatch:
        numbered = [_numbered(raw) for _, raw in held]
        ids = [x for x, _ in numbered]
        runs: list[list] = [[] for _ in held]
        if which := _suspects(ids, floor):
            # documents one after another; their words are told apart, so no repeat crosses an end
            offset = np.cumsum([0] + [int(ids[d].max()) + 1 for d in which])
            begin = np.cumsum([0] + [len(ids[d]) for d in which])
            for start, length, period in find_runs(np.concatenate([ids[d] + o for d, o in zip(which, offset)]), least, times):
                k = int(np.searchsorted(begin, start, side="right")) - 1
                runs[which[k]].append((start - int(begin[k]), length, period))
        flat = list(chain.from_iterable(runs))
        fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r) for r in runs]), pa.int32()),
                                         pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
        texts = pa.array([_collapsed(raw, x, words, r) for (_, raw), (x, words), r in zip(held, numbered, runs)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), lists, texts],
                                          names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for row in zip(b.column(0).to_pylist(), binary_texts(b.column(1))):
                if held and size + len(row[1]) > 6 * GROUP_WORDS:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
            if held:
                yield solve(held)

    python_tasks(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


# ---- query -----------------------------------------------------------------------------------------------------

def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, the text of every document with crc32(doc_id) divisible by 10 made periodic from a word on.

    With n words, g = crc32 div 10, a = g mod n and p = 1 + (n - a) div (3 + g mod 8), word i >= a is word a + (i - a) mod p.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h")) \
        .withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))) \
        .withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10")) \
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))) \
        .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    return planted.select("doc_id", F.when(F.col("n") > 0, F.expr(
        "array_join(transform(sequence(0, n - 1), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all runs and collapsed texts, and the run with most periods (ties: smallest start, then period)."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.expr("reduce(runs, cast(null as struct<start: long, length: long, period: long>), "
                  "(b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
