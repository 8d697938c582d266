"""Packing into sequences of near-equal attention cost: descending documents, each to the cheapest sequence with room."""

from __future__ import annotations

import heapq
import json
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_texts, materialize, python_tasks, table
from .tokencount import ODD, WordTokenizer

CAPACITY, END_ID = 2048, 1
#: Model width at which attention is weighed: a token's linear work is 24 width**2, a pair of tokens costs 4 width.
WIDTH = 1024
#: Ids between tasks.
NARROW = "<u2"
#: Control characters that the libraries take for white space or not; one of them stands between texts.
CONTROL = re.compile(b"[\x1c-\x1f]")
#: Rows of one length and bytes of ids that one ranking task takes, and pre-tokens whose ids a task remembers.
RANK_ROWS, RANK_BYTES, REMEMBERED = 1_000_000, 64 << 20, 400_000


def attention_cost(length: int, width: int = WIDTH) -> float:
    """Estimated cost of one piece, in tokens' linear work: linear in its length plus the square from attention inside it."""
    return length + length * length / (6 * width)


# ---- tokens ----------------------------------------------------------------------------------------------------

class MarkedBytes:
    """The word file's merges on marked text: each byte is a character, and another one where it ends a pre-token.

    The file has every byte once inside a word and once at a word's end. With both as characters of their own, many texts
    are one string whose pre-tokens end at marks, and tiktoken merges them all in one call: bytes of a character first,
    then by the file's order of merges. A character that no such text has stands between texts.
    """

    INSIDE, END, LIMIT, BETWEEN, BORDER = 0x100, 0x200, 0x200, 31, chr(0x300)

    def __init__(self, spec: dict) -> None:
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        inside = str.maketrans({c: chr(b if b < 0x80 else self.INSIDE + b) for b, c in shown.items()})
        ending = {c: chr(self.END + b) for b, c in shown.items()}
        marked = {t: (t[:-5].translate(inside) + ending[t[-5]] if t.endswith("</w>") else t.translate(inside)).encode() for t in spec["model"]["vocab"]}
        ranks = {bytes([x]): x for x in range(256)}
        for t in [*(m for t, m in marked.items() if len(t.removesuffix("</w>")) == 1), self.BORDER.encode()]:
            ranks.setdefault(t, len(ranks))
        for left, right in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]):
            ranks.setdefault(marked[left + right], len(ranks))
        self.border = ranks[self.BORDER.encode()]
        self.ids = np.zeros(len(ranks), "<u4")
        for t, i in spec["model"]["vocab"].items():
            if (k := ranks.get(marked[t])) is not None:
                self.ids[k] = i
        self.bpe = tiktoken.Encoding("marked", pat_str="[^\u0200-\u0300 ]*[\u0200-\u02ff]|\u0300", mergeable_ranks=ranks, special_tokens={})
        # 0 white space, 1 letters, 2 single numbers, 3 the rest, 4 between texts
        kind = [0 if chr(c).isspace() else 1 if re.match("[^\\W\\d_²³¹¼-¾]", chr(c)) else 2 if re.match("[\\d²³¹¼-¾]", chr(c)) else 3 for c in range(self.LIMIT)]
        kind[self.BETWEEN] = 4
        self.kind = np.array(kind, np.int8)
        # a byte as a character: inside a pre-token, and with 256 more at its end
        codes = [32 if x < 0x80 and kind[x] == 0 else x if x < 0x80 else self.INSIDE + x for x in range(256)] + [self.END + x for x in range(256)]
        codes[256 + self.BETWEEN] = ord(self.BORDER)
        self.codes = np.array(codes, "<u4")

    def marks(self, text: np.ndarray) -> np.ndarray:
        """Whether a character ends a pre-token: runs of letters, single numbers, runs of the rest, short forms with an apostrophe."""
        kind = self.kind[text]
        end = (kind == 2) | (kind == 4)
        end[:-1] |= kind[:-1] != kind[1:]
        end[-1] = True
        end &= kind != 0
        if len(at := np.flatnonzero(text == 39)):
            at = at[(at == 0) | (kind[at - 1] != 3)]
            far = np.append(text, [0, 0])
            one, two = far[at + 1], far[at + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            end[at[short | long]] = False
            end[at[short] + 1] = True
            end[at[long] + 2] = True
        return end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of lower-cased texts below U+0200 without the character between texts."""
        text = chr(self.BETWEEN).join(texts)
        if not text:
            return [np.zeros(0, "<u4") for _ in texts]
        raw = np.frombuffer(text.encode(), np.uint8)
        if text.isascii():
            code = self.codes[raw + (self.marks(raw).view(np.uint8) * np.uint16(256))]
        else:
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            last = np.cumsum(1 + (points >= 0x80)) - 1
            end = np.zeros(len(raw), np.uint16)
            end[last[self.marks(points)]] = 256
            code = self.codes[raw + end]
            wide = last[(points >= 0x80) & (self.kind[points] == 0)]
            code[wide] = code[wide - 1] = 32
        found = self.bpe.encode_ordinary(code.tobytes().decode("utf-32-le"))
        ranks = np.fromiter(found, np.int32, len(found))
        cuts = np.flatnonzero(ranks == self.border)
        ids = self.ids[ranks]
        return [ids[a:b] for a, b in zip(np.append(0, cuts + 1), np.append(cuts, len(ids)))]


class WordIds:
    """Ids of texts without added special tokens, as the library has them. Texts below U+0200 are marked and merged many at
    once; each distinct pre-token of all others goes through the library once."""

    TOGETHER = 1 << 20

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.words = path, None
        self.fast = MarkedBytes(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.known: dict[str, list[int]] = {}

    def _slow(self, raw: bytes) -> np.ndarray:
        if self.words is None:
            self.words = WordTokenizer(self.path)
        words = self.words.words(raw)[0]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in set(words) if w not in self.known]
        self.known.update(zip(new, (e.ids for e in self.words.lib.encode_batch_fast(new, add_special_tokens=False))))
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, words)), "<u4")

    def ids(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text, in order; short texts are merged together, a bounded number of bytes at once."""
        out: dict[int, np.ndarray] = {}
        ready, groups = 0, ([], [])  # ASCII texts, others

        def merge(group: list[tuple[int, str]]) -> None:
            out.update(zip((k for k, _ in group), self.fast.encode([t for _, t in group])))
            group.clear()

        waiting = [0, 0]
        for k, raw in enumerate(raws):
            if b"<|" in raw and len(parts := self.split.split(raw.decode("utf-8"))) > 1:
                plain = self.ids([p.encode() for p in parts[::2]])
                out[k] = np.concatenate([x for p, s in zip(plain, [*parts[1::2], None]) for x in (p, *([np.array([self.special[s]], "<u4")] if s else []))])
            elif (ascii := raw.isascii()) and not CONTROL.search(raw) or not ascii and np.frombuffer(raw, np.uint8).max() < 0xC8 and not ODD.search(raw) \
                    and max(raw.decode("utf-8").lower()) < chr(MarkedBytes.LIMIT):
                groups[ascii].append((k, raw.decode("utf-8").lower()))
                waiting[ascii] += len(raw)
                if waiting[ascii] > self.TOGETHER:
                    merge(groups[ascii])
                    waiting[ascii] = 0
            else:
                out[k] = self._slow(raw)
            while ready in out:
                yield out.pop(ready)
                ready += 1
        for group in groups:
            if group:
                merge(group)
        for k in range(ready, len(raws)):
            yield out.pop(k)


_LOADED: dict[str, WordIds] = {}


def token_stretches(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """row, doc_id, start, length, doc_tokens, ids: each document's ids and the end id, the longer ones every ``capacity`` ids.

    ``row`` tells rows apart: the task and the row's place in it, fixed once the table is written. ids are 16-bit here:
    the file has 49,408 tokens.
    """
    schema = "row long, doc_id long, start long, length int, doc_tokens long, ids binary"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in _LOADED:
            _LOADED[path] = WordIds(path)
        tok, row = _LOADED[path], TaskContext.get().partitionId() << 36
        for b in batches:
            out: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), tok.ids(binary_texts(b.column(1)))):
                ids = np.append(ids, np.array(end_id, "<u4")).astype(NARROW)
                for at in range(0, len(ids), capacity):
                    part = ids[at:at + capacity]
                    out.append((row, doc, at, len(part), len(ids), part.tobytes()))
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types],
                                             names=["row", "doc_id", "start", "length", "doc_tokens", "ids"])

    python_tasks(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


# ---- plan on the histogram of lengths --------------------------------------------------------------------------

Part = tuple[int, int, int, int, int]  # first rank, items, length of the part, first sequence, offset


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = WIDTH) -> dict[tuple[int, int], list[Part]]:
    """Where stretches go, by (length, start inside the stretch): items by rank go to consecutive sequences.

    Room is made for exactly all tokens: full sequences, and one for each power of two in the remainder. Longest first,
    items go to the cheapest sequence with room for them; sequences that look alike are handled as one class, so the work
    depends on the lengths, not on the number of documents. An item that fits nowhere fills the largest room left with its
    first part, and the rest of it queues with its own length.
    """
    total = sum(length * n for length, n in histogram.items())
    rooms: list[list[tuple[float, int, int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (cost, first sequence, how many, offset)
    best = np.full(capacity + 1, np.inf)

    def put(room: int, cost: float, first: int, n: int, offset: int) -> None:
        if room and n:
            heapq.heappush(rooms[room], (cost, first, n, offset))
            best[room] = rooms[room][0][0]

    def take(room: int) -> tuple[float, int, int, int]:
        found = heapq.heappop(rooms[room])
        best[room] = rooms[room][0][0] if rooms[room] else np.inf
        return found

    put(capacity, 0.0, 0, total // capacity, 0)
    at = total // capacity
    for k in range(capacity.bit_length()):
        if total % capacity >> k & 1:
            put(1 << k, 0.0, at, 1, 0)
            at += 1
    out: dict[tuple[int, int], list[Part]] = defaultdict(list)
    queue = [(-length, length, 0, 0, n) for length, n in histogram.items() if n]  # what is left: whose, start, first rank, how many
    heapq.heapify(queue)
    while queue:
        left, length, start, rank, n = heapq.heappop(queue)
        left = -left
        room = left + int(np.argmin(best[left:]))
        if best[room] == np.inf:
            room = int(np.flatnonzero(best < np.inf)[-1])
        cost, first, have, offset = take(room)
        times, size = min(n, have), min(left, room)
        out[length, start].append((rank, times, size, first, offset))
        put(room, cost, first + times, have - times, offset)
        put(room - size, cost + attention_cost(size, width), first, times, offset + size)
        if n > times:
            heapq.heappush(queue, (-left, length, start, rank + times, n - times))
        if left > size:
            heapq.heappush(queue, (size - left, length, start + size, rank, times))
    return {k: sorted(v) for k, v in out.items()}


# ---- assignment ------------------------------------------------------------------------------------------------

def ranked(stretches: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds ``rank`` among the stretches of equal length, from 0. A length with many rows is ranked by many tasks, and tasks
    grow in number with the ids."""
    parts = max(16, -(-max(histogram.values(), default=0) // RANK_ROWS))
    size = sum(2 * length * n for length, n in histogram.items())
    tasks = max(int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANK_BYTES))
    salted = stretches.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).repartition(tasks, "length", "part")
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    in_part = F.row_number().over(Window.partitionBy("length", "part").orderBy("row"))
    return salted.withColumn("in_part", in_part).join(before, ["length", "part"]) \
        .withColumn("rank", F.col("before") + F.col("in_part") - 1).select("doc_id", "start", "length", "doc_tokens", "ids", "rank")


def placed(stretches: DataFrame, where: dict[tuple[int, int], list[Part]]) -> DataFrame:
    """Ranked stretches as pieces with their sequence; the plan travels with the tasks, its size is bounded by the capacity."""
    schema = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
    types = [*[pa.int64()] * 4, pa.binary(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    ranks = {k: [p[0] for p in v] for k, v in where.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, start, length, tokens, ids, rank in zip(*(c.to_pylist() for c in b.columns)):
                at = 0
                while at < length:
                    first, _, size, sequence, offset = where[length, at][bisect_right(ranks[length, at], rank) - 1]
                    out.append((doc, start + at, size, tokens, np.frombuffer(ids, NARROW, size, 2 * at).astype("<u4").tobytes(), sequence + rank - first, offset))
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    return stretches.mapInArrow(run, schema)


def pack_balanced(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, ids (little-endian 32-bit), sequence_id, offset (gapless from 0).

    Sequences are full, or filled powers of two, so nothing is padded; documents longer than a sequence are cut, and some
    that no longer fit anywhere. Null and empty texts are the end id alone. Repeated rows are packed each. A null doc_id
    stays null. Stretches of equal length are exchangeable. Empty input gives an empty result. Only doc_id and text are
    read. The driver sees the histogram of at most ``capacity`` lengths.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    stretches = materialize(token_stretches(docs, path, capacity, end_id), "stretches")
    histogram = {r[0]: r[1] for r in stretches.groupBy("length").count().collect()}
    return placed(ranked(stretches, histogram), plan(histogram, capacity, width))


def op12_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_balanced(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
