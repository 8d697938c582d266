"""Packing of token pieces by linear grouping, configurations and best fit."""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_texts, materialize, python_tasks, table

CAPACITY, END_ID = 1024, 2
#: Lengths above this are large. Plans are tried with so many equal-cardinality groups of them, and with configurations
#: of two that leave so much room at most (the capacity: always the largest that fits).
SMALL, GROUPS, SLACKS = CAPACITY // 8, (64, 256, CAPACITY - CAPACITY // 8), (0, 4, 16, 64, CAPACITY)
#: Rows of one length that one ranking task takes.
RANK_ROWS = 1_000_000


# ---- tokens ----------------------------------------------------------------------------------------------------

class ByteTokenizer:
    """Ids of a byte-level BPE file without added special tokens.

    tiktoken gives the same ids from the same vocabulary several times faster. It is used for texts below U+0200 without
    special strings, where both libraries' character classes agree; all other texts go through tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.whole = path, None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [s.encode() for s in special]

    def ids(self, raw: bytes) -> np.ndarray:
        if not raw:
            return np.zeros(0, "<u4")
        text = raw.decode("utf-8")
        if np.frombuffer(raw, np.uint8).max() < 0xC8 and not any(s in raw for s in self.special):
            parts = [np.array(self.fast.encode_ordinary(t), "<u4") for t in _cuts(text)]
            return parts[0] if len(parts) == 1 else np.concatenate(parts)
        if self.whole is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")


def _cuts(text: str, least: int = 1 << 20) -> Iterator[str]:
    """Parts of a very long text, cut before a single space between a non-space and a letter: a pre-token always starts there."""
    while len(text) > 2 * least:
        at = text.find(" ", least)
        while at > 0 and (text[at - 1].isspace() or not text[at + 1:at + 2].isalpha()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[:at]
        text = text[at:]
    yield text


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, the longer ones cut.

    Cuts leave pieces of ``capacity`` ids; what doesn't divide evenly is the first piece.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = ByteTokenizer(path)
        tok = _TOKENIZERS[path]
        for b in batches:
            out: list[tuple] = []
            for doc, raw in zip(b.column(0).to_pylist(), binary_texts(b.column(1))):
                ids = np.append(tok.ids(raw), np.array(end_id, "<u4"))
                ends = list(range(len(ids) % capacity or capacity, len(ids) + 1, capacity)) if len(ids) > capacity else [len(ids)]
                for piece, (at, end) in enumerate(zip([0, *ends], ends)):
                    out.append((doc, piece, at, end - at, zlib.crc32(ids[at:end].astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    python_tasks(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


# ---- plan on the histogram of lengths --------------------------------------------------------------------------

def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Large lengths, longest first, in groups of about equal cardinality: (rounded-up length, [(length, items)])."""
    size = max(1, -(-sum(counts.values()) // groups))
    out: list[tuple[int, list]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = size
            take = min(left, room)
            out[-1][1].append((length, take))
            left, room = left - take, room - take
    merged: dict[int, list] = {}
    for top, items in out:  # a length that fills several groups is one size
        merged.setdefault(top, []).extend(items)
    return list(merged.items())


def configuration(sizes: list[int], left: list[int], first: int, capacity: int, slack: int) -> dict[int, int]:
    """A configuration that holds one of size ``first``: number by size.

    The largest size that fits is added as long as that leaves at most ``slack``, or if ``slack`` is the capacity; else
    the fullest configuration of all is found.
    """
    room, number, tried = capacity - sizes[first], {first: 1}, {first: 1}
    for i in range(first, len(sizes)):
        while sizes[i] <= room and left[i] > tried.get(i, 0):
            tried[i] = tried.get(i, 0) + 1
            room -= sizes[i]
            if room <= slack and sum(tried.values()) == 2:
                return tried
    return tried if slack >= capacity or not room else fullest(sizes, left, first, capacity, number)


def fullest(sizes: list[int], left: list[int], first: int, capacity: int, number: dict[int, int]) -> dict[int, int]:
    """Numbers of each size in the fullest configuration that holds one of size ``first`` (a bounded knapsack)."""
    room = capacity - sizes[first]
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    steps: list[tuple[int, np.ndarray]] = []
    for i in range(first, len(sizes)):
        s = sizes[i]
        copies = min(left[i] - (i == first), room // s)
        for _ in range(copies):
            more = np.zeros_like(reach)
            more[s:] = reach[:-s]
            more &= ~reach
            if not more.any():
                break
            steps.append((i, more))
            reach = reach | more
        if reach[room]:
            break
    at = int(np.flatnonzero(reach)[-1])
    for i, new in reversed(steps):
        if at and new[at]:
            number[i] = number.get(i, 0) + 1
            at -= sizes[i]
    return number


def plan(histogram: dict[int, int], capacity: int = CAPACITY, small: int = SMALL) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences over some numbers of groups and some slacks of a configuration."""
    def sequences(slots):
        return max((s[2] + s[3] for s in slots), default=0)

    return min((one_plan(histogram, capacity, small, g, s) for g in GROUPS for s in SLACKS), key=sequences)


def one_plan(histogram: dict[int, int], capacity: int, small: int, groups: int, slack: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, items, first sequence, offset): items of a length by rank go to consecutive sequences.

    Large lengths are grouped and rounded up; the largest size left takes its fullest configuration as often as supply
    lasts; the actual lengths replace the rounded ones; small lengths, longest first, go where least room is left. The
    histogram has at most ``capacity`` entries, so the plan is bounded however many items there are.
    """
    grouped = linear_groups({x: n for x, n in histogram.items() if x > small and n > 0}, groups)
    sizes = [g[0] for g in grouped]
    left = [sum(n for _, n in g[1]) for g in grouped]
    queue = [list(g[1]) for g in grouped]
    runs: list[tuple[int, list[int]]] = []  # identical sequences: how many, lengths inside
    for first in range(len(sizes)):
        while left[first]:
            number = configuration(sizes, left, first, capacity, slack)
            slots = [i for i, n in sorted(number.items()) for _ in range(n)]
            times = min(left[i] // n for i, n in number.items())
            for i, n in number.items():
                left[i] -= n * times
            while times:  # substitute actual lengths, in stretches in which no slot changes its length
                wants = defaultdict(int)
                for i in slots:
                    wants[i] += 1
                m = min(times, *(max(1, queue[i][0][1] // n) for i, n in wants.items()))
                lengths = []
                for i in slots:
                    length, n = queue[i][0]
                    take = min(m, n)
                    if take < m:
                        m = take
                    lengths.append(length)
                # with one sequence a slot may cross into the next length
                if m == 1 or any(queue[i][0][1] < m * n for i, n in wants.items()):
                    m, lengths = 1, []
                    for i in slots:
                        length, n = queue[i][0]
                        lengths.append(length)
                        queue[i][0] = (length, n - 1)
                        if n == 1:
                            queue[i].pop(0)
                else:
                    for i, n in wants.items():
                        length, have = queue[i][0]
                        queue[i][0] = (length, have - m * n)
                        if have == m * n:
                            queue[i].pop(0)
                runs.append((m, lengths))
                times -= m
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for n, lengths in runs:
        by_room[capacity - sum(lengths)].append((n, lengths))
    rooms = sorted(by_room)
    for length in sorted((x for x, n in histogram.items() if x <= small and n > 0), reverse=True):
        todo = histogram[length]
        while todo:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = min(todo, capacity // length)
                n, lengths, room = todo // each, [], capacity
            else:
                room = rooms[k]
                n, lengths = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(k)
                    del by_room[room]
                each = min(todo, room // length)
                if n > todo // each:
                    if room not in by_room:
                        bisect.insort(rooms, room)
                    by_room[room].append((n - todo // each, lengths))
                    n = todo // each
            todo -= n * each
            if (rest := room - length * each) not in by_room:
                bisect.insort(rooms, rest)
            by_room[rest].append((n, [*lengths, *[length] * each]))
    out, rank, sequence = [], defaultdict(int), 0
    for room in rooms:
        for n, lengths in by_room[room]:
            offset = 0
            for length in lengths:
                out.append((length, rank[length], n, sequence, offset))
                rank[length] += n
                offset += length
            sequence += n
    return out


# ---- assignment ------------------------------------------------------------------------------------------------

def ranked(pieces: DataFrame, most: int) -> DataFrame:
    """Adds ``rank`` of each piece among those of its length, from 0.

    Rows of a length are split into parts by a hash, so a length that holds most rows is ranked by many tasks; ``most``
    is the largest number of rows of one length.
    """
    parts = max(16, -(-most // RANK_ROWS))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    in_part = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    return salted.withColumn("in_part", F.row_number().over(in_part)).join(before, ["length", "part"]) \
        .withColumn("rank", F.col("before") + F.col("in_part") - 1).drop("part", "in_part", "before")


def assign(pieces: DataFrame, slots: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Adds sequence_id and offset to ranked pieces; the plan travels with the tasks, its size is bounded by the capacity."""
    slots = sorted(slots)
    lengths = np.array([s[0] for s in slots], np.int64)
    rest = np.array([s[1:] for s in slots], np.int64).reshape(-1, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                lo, hi = np.searchsorted(lengths, [x, x + 1])
                at = np.flatnonzero(length == x)
                k = lo + np.searchsorted(rest[lo:hi, 0], rank[at], "right") - 1
                seq[at], off[at] = rest[k, 2] + rank[at] - rest[k, 0], rest[k, 3]
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in its sequence).

    Null and empty texts are one piece with the end id alone. Repeated rows are packed each. A null doc_id stays null.
    Pieces of equal length are exchangeable; ties go by doc_id. Empty input gives an empty result. Only doc_id and text
    are read. The driver sees the histogram of at most ``capacity`` lengths.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = materialize(token_pieces(docs, path, capacity, end_id), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    return assign(ranked(pieces, max(histogram.values(), default=0)), plan(histogram, capacity, capacity // 8))


def op2_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
