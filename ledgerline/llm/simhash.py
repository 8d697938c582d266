"""SimHash near-dedup with Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_texts, deal_out, join_labels, materialize, python_tasks, sorted_runs, table
from .components import connected_components

#: Shingle length in words, most differing bits of a link, seed of XXH64.
WORDS, BITS, SEED = 3, 2, 42
#: Fingerprints in one bucket that are compared directly; larger buckets are dealt anew by finer keys.
BUCKET = 2048
#: The fingerprint's segments, each at most 23 bits: (shift, width).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: (exact segment, decoded segment): whatever way two errors fall, one of these pairs has none and at most one.
PAIRS = ((0, 1), (1, 2), (2, 0))
#: Generator polynomial of the binary (23, 12) Golay code, a fixed value.
GENERATOR = 0b101011100011
#: Pieces of the finer keys; leaving out two of 13 leaves at most 10 bits free, so at most 1024 fingerprints a key.
PIECES = 13


# ---- fingerprints ----------------------------------------------------------------------------------------------

def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED, chunk: int = 1 << 15) -> int:
    """64-bit SimHash over word shingles, repeats included; zero if the text has no word."""
    parts = text.lower().split()  # on bytes: A-Z only, and the separators are 0x20 and 0x09-0x0D
    if not parts:
        return 0
    if len(parts) < words:
        words = len(parts)
    n = len(parts) - words + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, chunk):
        some = parts[at:at + chunk + words - 1]
        line = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        m = len(some) - words + 1
        h = b"".join([digest(line[a:b], seed) for a, b in zip(starts[:m].tolist(), (ends[words - 1:] - 1).tolist())])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(m, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, more: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), and ``more``, a column of longs that is passed on."""
    also = [more] if more else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in binary_texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *also])

    python_tasks(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *also) \
        .mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{x} long" for x in also)]))


# ---- Golay code ------------------------------------------------------------------------------------------------

class Golay:
    """Decoder of the perfect (23, 12) code: every 23-bit word lies within 3 bits of just one codeword.

    Two words at most one bit apart share a key if a word within 2 bits of its codeword gets that codeword alone, and a
    word 3 bits away gets all codewords up to 4 bits away (six of them).
    """

    def __init__(self) -> None:
        rows = np.array([self._syndrome(1 << i) for i in range(23)], np.uint32)
        self.part = np.zeros((3, 256), np.uint32)
        for byte in range(3):
            for bit in range(min(8, 23 - 8 * byte)):
                has = (np.arange(256) >> bit) & 1 == 1
                self.part[byte, has] ^= rows[8 * byte + bit]
        self.lead = np.zeros(2048, np.uint32)
        self.weight = np.zeros(2048, np.int8)
        fours: list[list[int]] = [[] for _ in range(2048)]
        for w in range(1, 5):
            for c in combinations(range(23), w):
                error = sum(1 << i for i in c)
                s = int(self.syndrome(np.array([error], np.uint32))[0])
                if w < 4:
                    self.lead[s], self.weight[s] = error, w
                else:
                    fours[s].append(error)
        self.four = np.array([f or [0] * 5 for f in fours], np.uint32)

    @staticmethod
    def _syndrome(word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.part[0, x & 255] ^ self.part[1, (x >> 8) & 255] ^ self.part[2, x >> 16]

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index): the 12-bit indices of the codewords near each word."""
        s = self.syndrome(x)
        far = np.flatnonzero(self.weight[s] == 3)
        near = x ^ self.lead[s]
        more = (x[far, None] ^ self.four[s[far]]).ravel()
        return np.concatenate([np.arange(len(x)), np.repeat(far, 5)]), np.concatenate([near, more]) >> 11


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of fingerprints: an exact segment and a nearby codeword index of another."""
    seg = [((fp >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.uint32) for a, w in SEGMENTS]
    keys, rows = [], []
    for k, (exact, decoded) in enumerate(PAIRS):
        row, index = golay().keys(seg[decoded])
        keys.append(np.int64(k) << 36 | seg[exact][row].astype(np.int64) << 12 | index.astype(np.int64))
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def fine_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): all but two of 13 pieces. Two errors lie in at most two pieces, and a key leaves at most 10 bits free.

    The key is the fingerprint without those pieces, mixed with the number of the choice; if two keys ever met, the
    bucket would only hold more pairs to compare.
    """
    edges = [64 * i // PIECES for i in range(PIECES + 1)]
    keys = []
    for n, (i, j) in enumerate(combinations(range(PIECES), 2)):
        free = sum(((1 << (edges[p + 1] - edges[p])) - 1) << edges[p] for p in (i, j))
        keys.append(((fp & ~np.uint64(free)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93))
    return np.concatenate(keys).view(np.int64), np.tile(np.arange(len(fp)), len(keys))


# ---- links -----------------------------------------------------------------------------------------------------

def spanning_links(fp: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links (index pairs) that join exactly what chains of at most ``bits`` differing bits join, at most len - 1 of them."""
    todo, out = np.arange(1, len(fp)), []
    front = [0]
    while front or len(todo):
        if not front:
            front, todo = [int(todo[0])], todo[1:]
        at = front.pop()
        near = np.bitwise_count(fp[todo] ^ fp[at]) <= bits
        hit = todo[near].tolist()
        out += [(at, x) for x in hit]
        front += hit
        todo = todo[~near]
    return out


def _keyed(fps: DataFrame, make) -> DataFrame:
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 4096):
                some = fp[at:at + 4096]
                key, row = make(some.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(some[row], pa.int64())], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _linked(keys: DataFrame, bits: int) -> DataFrame:
    """Links inside buckets of bounded size: (src, dst)."""
    def run(batches):
        for starts, (_, fp) in sorted_runs(batches, "key", ["fp"]):
            fp = fp.view(np.uint64)
            src, dst = [], []
            n = np.diff(starts)
            two = starts[:-1][n == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
            src.append(fp[near])
            dst.append(fp[near + 1])
            for a, m in zip(starts[:-1][n > 2].tolist(), n[n > 2].tolist()):
                if got := spanning_links(fp[a:a + m], bits):
                    i, j = np.array(got).T
                    src.append(fp[a + i])
                    dst.append(fp[a + j])
            s, d = np.concatenate(src).view(np.int64), np.concatenate(dst).view(np.int64)
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(d)], names=["src", "dst"])

    return deal_out(keys, "key").sortWithinPartitions("key").mapInArrow(run, "src long, dst long")


def fingerprint_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Spanning links (src, dst) among distinct fingerprints ``fp`` that differ in at most 2 bits.

    Buckets above BUCKET fingerprints are found by a count and leave for finer keys, whose buckets can't be large;
    nothing is capped, and no bucket's pairs are emitted.
    """
    if bits > BITS:
        raise ValueError("the keys hold for at most 2 differing bits")
    keys = materialize(_keyed(fps, golay_keys), "simhash-keys")
    hot = materialize(keys.groupBy("key").count().where(F.col("count") > BUCKET).select("key"), "simhash-hot")
    fine = _keyed(keys.join(hot, "key", "left_semi").select("fp").distinct(), fine_keys)
    return _linked(keys.join(hot, "key", "left_anti"), bits).unionByName(_linked(fine, bits))


def _labels(each: DataFrame, bits: int) -> DataFrame:
    """fp, rows (how many have it), component (its smallest fingerprint), component_id (its smallest doc_id) of rows (doc_id, fp)."""
    fps = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "simhash-distinct")
    comp = materialize(connected_components(fingerprint_links(fps, bits)), "simhash-components")
    smallest = fps.join(comp, fps.fp == comp.node).groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = comp.join(smallest, "component").select(F.col("node").alias("fp"), "component", "component_id")
    return materialize(fps.join(named, "fp", "left").select("fp", "rows", F.coalesce("component", "fp").alias("component"),
                                                            F.coalesce("component_id", "first_id").alias("component_id")), "simhash-labels")


def simhash_groups(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and wordless texts have fingerprint zero and are linked like any other. Equal fingerprints are grouped before
    any key is made, so copies cost nothing later. Repeated rows stay; a null doc_id keeps its row, never names a
    component, and its component_id is null if its component has no other id. Empty input gives an empty result.
    """
    each = materialize(fingerprints(docs, words), "simhash")
    return join_labels(each, _labels(each, bits), "fp", "rows").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Documents without near copies: of each component the row with the smallest doc_id stays (of repeats of it, one).

    Different texts under one doc_id are rows of their own: which of them stay is decided component by component. Rows
    with a null doc_id stay only if their component has no id at all, then all of them.
    """
    names = docs.columns
    rows = docs.withColumn("__row", F.xxhash64(*names, *(F.col(c).isNull() for c in names)))
    each = materialize(fingerprints(rows, words, "__row"), "simhash")
    labelled = join_labels(each, _labels(each, bits), "fp", "rows")
    first = labelled.where("doc_id is not null").groupBy("component").agg(F.min(F.struct("doc_id", "__row")).alias("first")).select("first.*").distinct()
    kept = rows.dropDuplicates(["doc_id", "__row"]).join(materialize(first, "simhash-first"), ["doc_id", "__row"], "left_semi")
    loose = materialize(labelled.where("component_id is null").select("__row").distinct(), "simhash-loose")
    if loose.limit(1).count():
        kept = kept.unionByName(rows.where("doc_id is null").join(loose, "__row", "left_semi").select(*rows.columns))
    return kept.select(*names)


def op10_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
