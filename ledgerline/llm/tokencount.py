"""Token counts from distinct pre-tokens."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_texts, deal_out, materialize, python_tasks, table

LIMIT = 2048
#: A block of documents closes at so many bytes of text or documents.
BLOCK_BYTES, BLOCK_DOCS = 24 << 20, 50_000

#: The word file's split pattern for characters below U+0200 (letters, single numbers, runs of the rest).
PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼-¾]+|[\\d²³¹¼-¾]|(?:[^\\s\\w]|_)+")
#: Characters on which the libraries' white space differs from Python's.
ODD = re.compile(b"[\x1c-\x1f]|\xc2\x85")


class WordTokenizer:
    """Pre-tokens of a text, and the number of pieces of a pre-token, as the library has them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, self.specials)))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}

    def words(self, raw: bytes) -> tuple[list[str], int]:
        """(pre-tokens, special strings). Texts below U+0200 are split here, all others by the library's own parts."""
        text = raw.decode("utf-8")
        specials = 0
        parts = [text]
        if "<|" in text:
            parts = self.special.split(text)
            specials = len(parts) - 1
        if np.frombuffer(raw, np.uint8).max() < 0xC8 and not ODD.search(raw):
            return [w for p in parts for w in PLAIN.findall(p.lower())], specials
        out = []
        for p in parts:
            for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(p)):
                out.append(bytes(self.back[c] for c in w).decode("utf-8"))
        return out, specials

    def pieces(self, words: list[str]) -> list[int]:
        return [len(e) for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]


_LOADED: dict[str, WordTokenizer] = {}


def _loaded(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def frequency_blocks(docs: DataFrame, path: str) -> DataFrame:
    """One row per block of documents: its distinct pre-tokens and, per document, (ordinal, times) of each.

    Columns: block, doc_id, n_bytes, specials, pairs (arrays by document), freq (compressed steps from ordinal to ordinal
    and times), words.
    """
    names = ["block", "doc_id", "n_bytes", "specials", "pairs", "freq", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, pack, seen = _loaded(path), zstandard.ZstdCompressor(1), 0
        first = TaskContext.get().partitionId() << 32

        def flush():
            nonlocal seen, held
            ids, size, special, pairs, ordinal, times, words, _ = held
            o = np.concatenate(ordinal) if ordinal else np.zeros(0, np.uint32)
            t = np.concatenate(times) if times else np.zeros(0, np.uint32)
            planes = np.concatenate([x.view(np.uint8).reshape(-1, 4).T.ravel() for x in (o, t)])
            row = [pa.array([first + seen], pa.int64()), *(pa.array([x], pa.list_(pa.int64())) for x in (ids, size, special, pairs)),
                   pa.array([pack.compress(planes.tobytes())], pa.binary()), pa.array([list(words)], pa.list_(pa.string()))]
            seen += 1
            held = fresh()
            return pa.RecordBatch.from_arrays(row, names=names)

        def fresh():
            return [[], [], [], [], [], [], {}, 0]

        held = fresh()
        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), binary_texts(b.column(1))):
                words, special = tok.words(raw) if raw else ([], 0)
                times = Counter(words)
                voc = held[6]
                ordinal = np.fromiter((voc.setdefault(w, len(voc)) for w in times), np.uint32, len(times))
                order = np.argsort(ordinal)
                held[4].append(np.diff(ordinal[order], prepend=np.uint32(0)))
                held[5].append(np.fromiter(times.values(), np.uint32, len(times))[order])
                for k, v in enumerate((doc, len(raw), special, len(times))):
                    held[k].append(v)
                held[7] += len(raw)
                if held[7] >= BLOCK_BYTES or len(held[0]) >= BLOCK_DOCS:
                    yield flush()
        if held[0]:
            yield flush()

    python_tasks(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "block long, doc_id array<long>, n_bytes array<long>, specials array<long>, pairs array<long>, freq binary, words array<string>")


def counted_once(words: DataFrame, path: str) -> DataFrame:
    """(block, pos, word) to (block, pos, n): sorted by pre-token, each distinct one is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, last = _loaded(path), (None, 0)
        for b in batches:
            if not b.num_rows:
                continue
            d = b.column(2).dictionary_encode()
            distinct = d.dictionary.to_pylist()
            known = distinct[0] == last[0]
            n = [last[1]] * known + tok.pieces(distinct[known:])
            last = (distinct[-1], n[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(n, np.int64)[d.indices.to_numpy()])], names=["block", "pos", "n"])

    return deal_out(words, "word").sortWithinPartitions("word").mapInArrow(run, "block long, pos int, n long")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and tokens. Special strings inside texts count as one token each, as the library
    takes them. Repeated rows stay; a null doc_id stays null. Empty input gives an empty result. Only doc_id and text are
    read. No document's ids are ever built: blocks of documents send their distinct pre-tokens, get back the pieces of
    each, and sum times x pieces. Blocks are bounded by bytes, a document longer than that is a block alone.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    blocks = materialize(frequency_blocks(docs, path), "token-blocks")
    words = blocks.select("block", F.posexplode("words").alias("pos", "word"))
    counts = counted_once(words, path)

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.zeros(right.num_rows, np.int64)
        n[right.column("pos").to_numpy()] = right.column("n").to_numpy()
        ids, size, special, pairs = (left.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("doc_id", "n_bytes", "specials", "pairs"))
        docs_out = left.column("doc_id")[0].values
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(left.column("freq")[0].as_py()), np.uint8)
        half = len(planes) // 2
        steps, times = (np.ascontiguousarray(x.reshape(4, -1).T).view(np.uint32).ravel() for x in (planes[:half], planes[half:]))
        ends = np.cumsum(pairs)
        upto = np.concatenate(([0], np.cumsum(steps, dtype=np.int64)))
        ordinal = upto[1:] - np.repeat(upto[ends - pairs], pairs)
        sums = np.concatenate(([0], np.cumsum(n[ordinal] * times.astype(np.int64))))
        tokens = sums[ends] - sums[ends - pairs] + special
        return pa.table({"doc_id": docs_out.cast(pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})

    sums = blocks.drop("words").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
