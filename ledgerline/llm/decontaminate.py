"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .bloom import bloom, maybe_in
from .common import binary_texts, materialize, python_tasks, table

#: Words of a seed, which is also the shortest tile, and the part of a test's words that tiles must cover.
SEED, COVERAGE = 5, 0.6
#: Bytes of text hashed at once; a longer text is hashed in parts that end at word breaks.
CHUNK = 1 << 20
#: Tasks over which the texts with one seed are spread.
SALTS = 8

_BREAK = np.zeros(256, bool)
_BREAK[[i for i in range(128) if not chr(i).isalnum()]] = True
#: Ranges of characters beyond ASCII that also part words: spaces, quotation marks, general and full-width punctuation.
_PUNCTUATION = ((0xA0, 0xA1), (0xAB, 0xAB), (0xBB, 0xBB), (0xBF, 0xBF), (0x2000, 0x206F), (0x3000, 0x3003), (0x3008, 0x3011), (0xFF01, 0xFF0F))
_OTHER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _PUNCTUATION) + "]")


def plain(raw: bytes) -> bytes:
    """Lower-cased text in which every character between words is a byte below 128 that is no letter or digit."""
    if raw.isascii():
        return raw
    text = raw.decode("utf-8").lower()
    text = _OTHER.sub(" ", text)
    return text.encode("utf-8")


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, number of the text of each)."""
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    start, end = W.word_spans(flat, _BREAK)
    owner = np.searchsorted(np.cumsum([0] + [len(t) + 1 for t in texts]), start, "right") - 1
    return W.word_hashes(flat, start, end), owner


def text_words(raw: bytes) -> np.ndarray:
    """Word hashes of one text of any length; a word longer than a part is hashed whole."""
    out, at = [], 0
    flat = np.frombuffer(raw, np.uint8)
    while at < len(raw):
        end = at + CHUNK
        if end < len(raw):
            breaks = np.flatnonzero(_BREAK[flat[at:end]])
            while not len(breaks) and end < len(raw):  # inside a word that is longer than the part
                breaks = np.flatnonzero(_BREAK[flat[end:end + CHUNK]]) + (end - at)
                end += CHUNK
            end = at + int(breaks[-1 if breaks[-1] < CHUNK else 0]) + 1 if len(breaks) else len(raw)
        out.append(hashed_words([raw[at:end]])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def seed_hashes(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of all seeds that stand in one text."""
    h = W.shingle_hashes(words, SEED)
    ok = np.flatnonzero(owner[:len(h)] == owner[SEED - 1:]) if len(h) else np.zeros(0, np.int64)
    return h[ok], ok


# ---- tiling ----------------------------------------------------------------------------------------------------

def tiles(test: np.ndarray, fragments: list[np.ndarray], least: int = SEED) -> list[tuple[int, int, int, int]]:
    """Greedy string tiling: (start in test, fragment, start in fragment, words), longest first, none overlapping.

    Each pass hashes all unmarked runs of the search length (Karp-Rabin), extends equal ones to the longest match and
    marks matches, longest first; the search length goes to a longer match at once, else it is halved down to ``least``.
    """
    free_t = np.ones(len(test), bool)
    free_f = [np.ones(len(f), bool) for f in fragments]
    out: list[tuple[int, int, int, int]] = []
    size = max(least, min(len(test), max(map(len, fragments), default=0)))

    def open_runs(words: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(words) < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(np.convolve(free, np.ones(size, np.int64), "valid") == size)
        return W.run_hashes(words, at, at + size), at

    while True:
        matches: list[tuple[int, int, int, int]] = []
        where = defaultdict(list)
        for h, at in zip(*open_runs(test, free_t)):
            where[int(h)].append(int(at))
        longest = 0
        for n, f in enumerate(fragments):
            for h, b in zip(*open_runs(f, free_f[n])):
                for a in where.get(int(h), ()):
                    k, b = 0, int(b)
                    while a + k < len(test) and b + k < len(f) and test[a + k] == f[b + k] and free_t[a + k] and free_f[n][b + k]:
                        k += 1
                    if k >= size:
                        matches.append((k, a, n, b))
                        longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        for k, a, n, b in sorted(matches, key=lambda m: (-m[0], *m[1:])):
            if free_t[a:a + k].all() and free_f[n][b:b + k].all():
                free_t[a:a + k] = False
                free_f[n][b:b + k] = False
                out.append((a, n, b, k))
        if size == least:
            # matches cut short by a longer tile may still hold a run of ``least``: passes go on until none is found
            if not matches:
                return out
        else:
            size = max(least, size // 2)


# ---- Spark -----------------------------------------------------------------------------------------------------

def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """item_id, words (hashes) of the test items with an id and SEED words or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [hashed_words([plain(t)])[0].view(np.int64) for t in binary_texts(b.column(1))]
            keep = [i for i, x in enumerate(lists) if len(x) >= SEED]
            if keep:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array([lists[i] for i in keep], pa.list_(pa.int64()))], names=["item_id", "words"])

    python_tasks(benchmark.sparkSession)
    return benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "item_id long, words array<long>")


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """seed, item_id, at: every run of SEED words of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, words in zip(b.column(0).to_pylist(), b.column(1)):
                h = W.shingle_hashes(words.values.to_numpy().view(np.uint64), SEED).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), item, np.int64)), pa.array(np.arange(len(h), dtype=np.int32))],
                                                 names=["seed", "item_id", "at"])

    return items.mapInArrow(run, "seed long, item_id long, at int")


def suspicious_fragments(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """One row per text with a run of words that may be a seed: key, doc_id, seeds (distinct), fragments (their words' hashes).

    Tiles only hold seeds, so the runs of consecutive seeds are all of a text that tiling needs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 40
        for b in batches:
            ids, raws = b.column(0).to_pylist(), binary_texts(b.column(1))
            texts = [plain(raw) for raw in raws]
            found: dict[int, tuple[list, list]] = {}
            at = 0
            while at < len(texts):  # many short texts at once, or a long one by itself
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                    size += len(texts[end])
                    end += 1
                if size > CHUNK:
                    words = text_words(texts[at])
                    owner = np.zeros(len(words), np.int64)
                else:
                    words, owner = hashed_words(texts[at:end])
                h, first = seed_hashes(words, owner)
                hit = maybe_in(bits, h)
                h, first = h[hit], first[hit]
                if len(h):
                    new = np.flatnonzero(np.concatenate(([True], (np.diff(first) > 1) | (np.diff(owner[first]) > 0))))
                    for lo, hi in zip(new, np.append(new[1:], len(h))):
                        seeds, frags = found.setdefault(at + int(owner[first[lo]]), ([], []))
                        seeds.append(h[lo:hi])
                        frags.append(words[first[lo]:first[hi - 1] + SEED].view(np.int64))
                at = end
            if found:
                order = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([serial + r for r in order], pa.int64()), pa.array([ids[r] for r in order], pa.int64()),
                     pa.array([np.unique(np.concatenate(found[r][0])).view(np.int64) for r in order], pa.list_(pa.int64())),
                     pa.array([[f.tolist() for f in found[r][1]] for r in order], pa.list_(pa.list_(pa.int64())))],
                    names=["key", "doc_id", "seeds", "fragments"])
            serial += b.num_rows

    python_tasks(docs.sparkSession)
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "key long, doc_id long, seeds array<long>, fragments array<array<long>>")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest): documents that hold most of a test item, in whatever order.

    A pair is reported if tiles of at least 5 words cover 0.6 of the item's words. Words are runs of letters, digits and
    characters beyond ASCII that are no punctuation, lower-cased. Null or empty texts and items with fewer than 5 words
    match nothing; rows with a null id take no part. Of rows with one doc_id, or items with one item_id, the best match
    counts. Empty input gives an empty result. Only doc_id, text and item_id are read.

    A filter of fixed size keeps texts without seeds in their tasks; the join of seeds behind it is exact. Only pairs
    whose shared seeds could reach the coverage are tiled, each pair by itself.
    """
    items = materialize(benchmark_words(benchmark), "benchmark-words").withColumn("item", F.monotonically_increasing_id())
    items = materialize(items, "benchmark-items")
    seeds = materialize(benchmark_seeds(items.select("item", "words")).withColumnRenamed("item_id", "item"), "benchmark-seeds")
    texts = materialize(suspicious_fragments(docs, bloom(seeds, "seed")), "fragments")
    salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = texts.select("key", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"), F.explode("seeds").alias("seed")).join(salted, ["seed", "salt"])
    # words of the item that its shared seeds cover: each reaches to the next one, SEED words at most
    starts = F.array_sort(F.collect_set("at"))
    reach = F.aggregate(starts, F.struct(F.lit(-SEED).alias("last"), F.lit(0).alias("n")), lambda acc, at: F.struct(
        at.alias("last"), (acc["n"] + F.least(at - acc["last"], F.lit(SEED))).alias("n")))["n"]
    bound = shared.groupBy("key", "item").agg(reach.alias("most"))
    pairs = bound.join(items, "item").where(F.col("most") >= F.lit(coverage) * F.size("words")) \
        .join(texts.select("key", "doc_id", "fragments"), "key").select("doc_id", "item_id", "words", "fragments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, item, words, frags in zip(*(c.to_pylist() for c in b.columns)):
                found = tiles(np.array(words, np.int64).view(np.uint64), [np.array(f, np.int64).view(np.uint64) for f in frags])
                share = sum(t[3] for t in found) / len(words)
                if share >= coverage:
                    out.append((doc, item, share, len(found), max(t[3] for t in found)))
            if out:
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["doc_id", "item_id", "coverage", "n_tiles", "longest"])

    best = F.max(F.struct("coverage", "n_tiles", "longest")).alias("best")
    return pairs.mapInArrow(run, "doc_id long, item_id long, coverage double, n_tiles int, longest int") \
        .groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no test item; rows with a null doc_id stay."""
    bad = materialize(contaminated(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def op3_string_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
