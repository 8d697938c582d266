"""Substring dedup by paragraph MinHash banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .bloom import bloom, maybe_in
from .common import binary_texts, deal_out, join_labels, materialize, python_tasks, sorted_runs, table
from .components import connected_components

#: Words of a shingle and least Jaccard similarity of linked paragraphs.
SHINGLE, SIMILARITY = 5, 0.8
#: A paragraph has at least so many words; longer ones than LONG are cut.
SHORT, LONG = 6, 16
#: Repeated paragraphs of one source in a row are a passage from so many words on: of 50 words that another document has,
#: a match may miss the paragraph at either end.
PASSAGE = 16
#: Paragraphs in a band's bucket that are paired at once; those of larger buckets are compared under exact prefix keys.
FEW = 17
#: Paragraphs under one prefix key that one task compares; larger buckets are dealt out as pairs of blocks of this size.
BUCKET = 2048
#: Counters that put word 5-grams in order, rare ones first: a fixed number whatever the data.
COUNTERS = 1 << 18
#: Texts read at once: bytes.
CHUNK = 1 << 20


def bands(similarity: float = SIMILARITY, recall: float = 0.95, most: int = 64) -> tuple[int, int]:
    """(bands, rows) with the fewest hashes that find a pair at the threshold with at least ``recall``.

    Word 5-grams are rare enough in other texts that bands of one row already tell paragraphs apart; more rows would need
    many more bands for the same recall.
    """
    options = []
    for rows in range(1, 9):
        for n in range(1, most + 1):
            if 1 - (1 - similarity ** rows) ** n >= recall:
                options.append((n * rows, n, rows))
                break
    return min(options)[1:]


def _chunks(docs: list[int], texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(document, how it goes on from the part before, text) lists of bounded size; long texts are cut at line or word ends.

    Going on is 0 for the start of a text, 1 for a later part of it, 2 for one that starts inside a word: a word that fills
    a whole part is cut.
    """
    ids: list[int] = []
    goes_on: list[int] = []
    some: list[bytes] = []
    size = 0
    for doc, text in zip(docs, texts):
        part = 0
        while True:
            end = len(text)
            if end > CHUNK:
                end = max(text.rfind(b"\n", 0, CHUNK), 0) or max(text.rfind(b" ", 0, CHUNK), 0) or CHUNK
            ids.append(doc)
            goes_on.append(part)
            some.append(text[:end])
            size += end
            part = 1 if text[end - 1:end].isspace() or text[end:end + 1].isspace() else 2
            text = text[end:]
            if size >= CHUNK:
                yield ids, goes_on, some
                ids, goes_on, some, size = [], [], [], 0
            if not text:
                break
    if ids:
        yield ids, goes_on, some


def paragraph_arrays(docs: list[int], texts: list[bytes], n_bands: int) -> Iterator[dict[str, np.ndarray]]:
    """Paragraphs of SHORT words or more: row of the text, number in it, first word, words, hash, MinHash per band.

    Short lines in a row are joined; only what has fewer words between two paragraphs or text ends is none.
    Also span: the bytes of the chunk that hold the paragraph, under ``flat``.
    """
    n_held = words_held = 0  # paragraphs and words of the text before the part at hand
    for ids, goes_on, some in _chunks(docs, texts):
        flat = np.frombuffer(b"\n".join(some) + b"\n", np.uint8)
        start, end = W.word_spans(flat)
        h = W.word_hashes(flat, start, end)
        offset = np.cumsum([0] + [len(t) + 1 for t in some])
        last = np.flatnonzero(W.paragraphs(flat, start, end, h, SHORT, LONG, offset))
        first = np.concatenate(([0], last[:-1] + 1))[:len(last)]
        size = last - first + 1
        text = np.searchsorted(offset, start[first], "right") - 1
        word0 = np.searchsorted(start, offset)
        keep = size >= SHORT
        n_kept = np.bincount(text[keep], minlength=len(some))
        before = np.zeros((2, len(some)), np.int64)
        for i, (on, n, words) in enumerate(zip(goes_on, n_kept.tolist(), np.diff(word0).tolist())):
            if not on:
                n_held = words_held = 0
            before[:, i] = n_held, words_held - (on == 2)
            n_held, words_held = n_held + n, words_held + words - (on == 2)
        number = np.cumsum(keep) - 1 + (before[0] - np.cumsum(n_kept) + n_kept)[text]
        word = first + (before[1] - word0[:-1])[text]
        first, last, size = first[keep], last[keep], size[keep]
        if not len(first):
            continue
        out = {"text": text[keep], "number": number[keep], "word": word[keep], "size": size, "hash": W.run_hashes(h, first, last + 1),
               "lo": start[first], "hi": end[last], "flat": flat, "doc": np.array(ids, np.int64)[text[keep]]}
        shingle = W.shingle_hashes(h, SHINGLE)
        within = np.zeros(len(h) + 1, np.int32)
        np.add.at(within, first, 1)
        np.add.at(within, np.maximum(last - SHINGLE + 2, first), -1)
        valid = np.cumsum(within)[:len(shingle)] > 0
        place = np.concatenate(([0], np.cumsum(valid)))
        for k in range(n_bands):
            x = W.mix(shingle[valid] + np.uint64(0x632BE59BD9B4E019) * np.uint64(k + 1))
            out[f"m{k}"] = np.minimum.reduceat(x, place[first]) if len(x) else np.zeros(len(first), np.uint64)
        yield out


def paragraph_rows(docs: DataFrame, n_bands: int) -> DataFrame:
    """doc_id, copy (a hash of the text), number, word, size, hash, m0, m1, ... of all paragraphs of documents with an id."""
    names = ["doc_id", "copy", "number", "word", "size", "hash", *[f"m{k}" for k in range(n_bands)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in paragraph_arrays(list(range(b.num_rows)), binary_texts(b.column(1)), n_bands):
                cols = [b.column(0).take(pa.array(p["doc"])), b.column(2).take(pa.array(p["doc"])), *(pa.array(p[c].astype(np.int32)) for c in names[2:5]),
                        *(pa.array(p[c].view(np.int64)) for c in names[5:])]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    python_tasks(docs.sparkSession)
    return _with_id(docs).withColumn("copy", F.xxhash64("text")) \
        .mapInArrow(run, "doc_id long, copy long, number int, word int, size int, hash long, " + ", ".join(f"m{k} long" for k in range(n_bands)))


def _with_id(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def band_keys(rows: DataFrame, n_bands: int) -> DataFrame:
    """(key, hash) for every band: its MinHash. Repeats go before the shuffle, task by task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush():
            h, *m = (np.concatenate(x) for x in zip(*held))
            one = np.unique(h, return_index=True)[1]
            held.clear()
            for k in range(n_bands):
                yield pa.RecordBatch.from_arrays([pa.array(m[k][one]), pa.array(h[one])], names=["key", "hash"])

        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            if sum(len(x[0]) for x in held) >= 200_000:
                yield from flush()
        if held:
            yield from flush()

    return rows.select("hash", *[f"m{k}" for k in range(n_bands)]).mapInArrow(run, "key long, hash long")


def colliding(rows: DataFrame, n_bands: int) -> DataFrame:
    """(a, b): different paragraphs that share a band key; b is null for a paragraph of a bucket above FEW.

    Buckets up to FEW give all their pairs. The members of larger ones are only named here, so rows grow with them, not
    with their square; ``hot_links`` compares them. Buckets are read as a stream, so none is ever held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.zeros(0, np.int64)] * 3  # key, hash and place in its bucket of the last FEW members read
        for b in batches:
            key, h = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("key", "hash"))
            k_all, h_all = np.concatenate((tail[0], key)), np.concatenate((tail[1], h))
            old = len(tail[0])
            fresh = np.concatenate((np.ones(min(1, len(k_all)), bool), (k_all[1:] != k_all[:-1]) | (h_all[1:] != h_all[:-1])))
            fresh[:old] = True
            key, h = key[fresh[old:]], h[fresh[old:]]  # repeats from other tasks count once
            k_all, h_all = k_all[fresh], h_all[fresh]
            if not len(key):
                continue
            pos = np.arange(len(k_all))
            new = np.concatenate(([True], k_all[1:] != k_all[:-1]))
            rank = pos - np.maximum.accumulate(np.where(new, pos, 0))
            if old:
                rank += np.where(np.cumsum(new) == 1, tail[2][0], 0)
            src, dst = [], []
            for d in range(1, FEW):
                at = np.flatnonzero((rank >= d) & (rank < FEW) & (pos >= max(old, d)))
                src.append(h_all[at - d])
                dst.append(h_all[at])
            hot = np.flatnonzero((rank >= FEW) & (pos >= old))
            first = hot[rank[hot] == FEW]
            hot = h_all[np.concatenate([hot, *(first - d for d in range(1, FEW + 1))])]
            tail = [x[-FEW:] for x in (k_all, h_all, rank)]
            s, d = np.concatenate(src), np.concatenate(dst)
            if len(s) + len(hot):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((np.minimum(s, d), hot))), pa.concat_arrays([pa.array(np.maximum(s, d)), pa.nulls(len(hot), pa.int64())])], names=["a", "b"])

    keys = deal_out(band_keys(rows, n_bands), "key").sortWithinPartitions("key", "hash")
    return keys.mapInArrow(run, "a long, b long").distinct()


def paragraph_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash, shingles (sorted hashes of the paragraph's word 5-grams) of the wanted paragraphs, read again from the texts.

    A filter of fixed size keeps other paragraphs in their tasks; the join behind it is exact.
    """
    bits = bloom(wanted, "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in paragraph_arrays(b.column(0).to_pylist(), binary_texts(b.column(1)), 0):
                hit = np.flatnonzero(maybe_in(bits, p["hash"]))
                hit = hit[np.unique(p["hash"][hit], return_index=True)[1]]
                lists = []
                for i in hit.tolist():
                    part = p["flat"][p["lo"][i]:p["hi"][i]]
                    s, e = W.word_spans(part)
                    lists.append(np.unique(W.shingle_hashes(W.word_hashes(part, s, e), SHINGLE)).view(np.int64))
                if lists:
                    yield pa.RecordBatch.from_arrays([pa.array(p["hash"][hit].view(np.int64)), pa.array(lists, pa.list_(pa.int64()))], names=["hash", "shingles"])

    return _with_id(docs).mapInArrow(run, "hash long, shingles array<long>").join(wanted, "hash", "left_semi") \
        .groupBy("hash").agg(F.first("shingles").alias("shingles"))


def spanning_links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (index pairs) that join exactly what chains of sets with at least this Jaccard similarity join, at most len - 1."""
    size = np.array([len(x) for x in sets])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), np.int32)
    todo, front, out = np.arange(1, len(sets)), [0], []
    while front or len(todo):
        if not len(todo):
            break
        if not front:
            front, todo = [int(todo[0])], todo[1:]
            continue
        at = front.pop()
        own = flat[start[at]:start[at] + size[at]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], start)[todo]
        mark[own] = 0
        near = both >= similarity * (size[at] + size[todo] - both)
        hit = todo[near].tolist()
        out += [(at, x) for x in hit]
        front += hit
        todo = todo[~near]
    return out


def _counters(texts: DataFrame) -> np.ndarray:
    """How many word 5-grams of the paragraphs fall on each of COUNTERS counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for r in texts.select("shingles").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["at"]] = r["n"]
    return out


def hot_links(texts: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(src, dst): links that join exactly the paragraphs (hash, shingles) that chains of similar ones join.

    Of two sets at Jaccard similarity s, in whatever order of all 5-grams, the first n - ceil(s n) + 1 of each (n its size)
    have one in common. Rare 5-grams come first, so these prefix keys are shared by few. A bucket above ``bucket`` is cut
    into blocks by hash, and each pair of blocks is dealt out on its own: every pair under a key is compared.
    """
    counts = _counters(texts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, row = [], []
            for i, x in enumerate(b.column(1).to_numpy(zero_copy_only=False)):
                n = counts[x & (COUNTERS - 1)]
                first = np.lexsort((x, n))[:len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1]
                first = first[n[first] > 1]  # what one paragraph alone has is no key
                key.append(x[first])
                row += [i] * len(first)
            if row:
                got = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), got.column(0), got.column(1)], names=["key", "hash", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, (_, h, sets) in sorted_runs(batches, "key", ["hash", "shingles"]):
            src, dst = [], []
            for a, z in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if z - a > 1 and (got := spanning_links(list(sets[a:z]), similarity)):
                    i, j = np.array(got).T
                    src.append(h[a + i])
                    dst.append(h[a + j])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])

    kind = "key long, hash long, shingles array<long>"
    keys = materialize(texts.select("hash", "shingles").mapInArrow(prefixes, kind), "paragraph-prefixes")
    large = materialize(keys.groupBy("key").count().where(F.col("count") > bucket)
                        .select("key", F.ceil(F.col("count") / bucket).cast("int").alias("blocks")), "paragraph-large")
    cells = keys.join(large, "key").withColumn("block", F.expr("cast(pmod(xxhash64(hash), blocks) as int)")) \
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).where("other <> block") \
        .select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "hash", "shingles")
    both = keys.join(large, "key", "left_anti").unionByName(cells)
    return deal_out(both, "key").sortWithinPartitions("key").mapInArrow(run, "src long, dst long")


def linked(docs: DataFrame, found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(src, dst): colliding paragraphs whose exact Jaccard similarity of word 5-grams reaches the threshold; of large
    buckets, links that join the same."""
    wanted = materialize(found.select(F.explode(F.array("a", "b")).alias("hash")).where("hash is not null").distinct(), "paragraph-wanted")
    texts = materialize(paragraph_texts(docs, wanted), "paragraph-texts")
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = found.join(texts.select(F.col("hash").alias("a"), F.col("shingles").alias("sa")), "a") \
        .join(texts.select(F.col("hash").alias("b"), F.col("shingles").alias("sb")), "b") \
        .where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    hot = texts.join(found.where("b is null").select(F.col("a").alias("hash")), "hash", "left_semi")
    return pairs.unionByName(hot_links(materialize(hot, "paragraph-hot"), similarity))


def paragraph_runs(hits: DataFrame, most: int) -> DataFrame:
    """gram, n, doc_id, copy, number: every run of 2 to ``most`` paragraphs of shared classes, by its first one.

    ``hits`` has doc_id, copy, number, class_id; the gram is a hash of the classes in their order.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (doc, copy, number, cls) in sorted_runs(batches, "doc_id", ["copy", "number", "class_id"]):
            once = np.concatenate(([True], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (number[1:] != number[:-1])))
            doc, copy, number, cls = doc[once], copy[once], number[once], cls[once].view(np.uint64)
            gram = cls.copy()
            for n in range(2, most + 1):
                if len(doc) < n:
                    break
                whole = np.flatnonzero((doc[n - 1:] == doc[:1 - n]) & (copy[n - 1:] == copy[:1 - n]) & (number[n - 1:] - number[:1 - n] == n - 1))
                gram = W.mix(gram[:len(cls) - n + 1] * np.uint64(W.MULTIPLIER) + cls[n - 1:])
                if len(whole):
                    yield pa.RecordBatch.from_arrays([pa.array(gram[whole].view(np.int64)), pa.array(np.full(len(whole), n, np.int32)), pa.array(doc[whole]),
                                                      pa.array(copy[whole]), pa.array(number[whole])], names=["gram", "n", "doc_id", "copy", "number"])

    return deal_out(hits.select("doc_id", "copy", "number", "class_id"), "doc_id").sortWithinPartitions("doc_id", "copy", "number") \
        .mapInArrow(run, "gram long, n int, doc_id long, copy long, number int")


def repeated_passages(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """Passages that an earlier document already has, one row each: doc_id, word, n_words, kept_doc_id, class_id.

    Paragraphs are linked if they are equal or reach Jaccard similarity 0.8 on word 5-grams; linked ones are one class, and
    the document of a class with the smallest doc_id keeps it. Paragraphs in a row (what has fewer than 6 words between
    them doesn't count) of ``passage`` words together are repeated if one earlier document holds their classes in the same
    order in a row, or keeps them all. For that, runs of paragraphs just long enough for ``passage`` words are compared, as
    every longer run consists of such ones: the smallest doc_id that holds a run is its source, whatever other documents
    hold its single paragraphs. Repeated runs that touch are one row as long as their source is the same, the longest run
    naming it: the first word, counted in the text, and the words up to the end. class_id is the smallest of the
    passage's classes.

    Null and empty texts hold nothing. Documents with a null doc_id take no part. Rows with one doc_id are one document and
    don't repeat each other. Empty input gives an empty result. Only doc_id and text are read. Texts above 1 MB are read
    in parts cut at line ends.
    """
    n_bands, _ = bands()
    rows = materialize(paragraph_rows(docs, n_bands), "paragraphs")
    found = materialize(colliding(rows, n_bands), "paragraph-pairs")
    near = materialize(connected_components(linked(docs, found)), "paragraph-classes")
    owners = rows.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("times")) \
        .join(near, F.col("hash") == F.col("node"), "left").where("lo <> hi or node is not null") \
        .select("hash", "lo", "hi", "times", F.coalesce("component", "hash").alias("class_id"))
    owners = materialize(owners, "paragraph-owners")
    kept = owners.groupBy("class_id").agg(F.min("lo").alias("kept"), F.max("hi").alias("hi")).where("kept <> hi").select("class_id", "kept")
    repeated = materialize(owners.join(kept, "class_id").select("hash", "class_id", "kept", "times"), "paragraph-repeated")
    hits = materialize(join_labels(rows.select("doc_id", "copy", "number", "word", "size", "hash"), repeated, "hash", "times").drop("hash"), "paragraph-hits")
    runs = materialize(paragraph_runs(hits, -(-passage // SHORT)), "paragraph-runs")
    sources = materialize(runs.groupBy("gram").agg(F.min("doc_id").alias("kept"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("times"))
                          .where("kept <> hi").select("gram", "kept", "times"), "paragraph-sources")
    none = F.lit(0)
    seeds = join_labels(runs, sources, "gram", "times").where("doc_id <> kept").select("doc_id", "copy", "number", "n", none.alias("word"), none.alias("size"), none.cast("long").alias("class_id"), "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (doc, copy, number, n, word, size, cls, keep) in sorted_runs(batches, "doc_id", ["copy", "number", "n", "word", "size", "class_id", "kept"]):
            once = (n == 1) & np.concatenate(([True], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (number[1:] != number[:-1])))
            place = np.cumsum(once) - 1  # a paragraph's row stands before its runs
            wide = {k: np.flatnonzero(n == k) for k in np.unique(n[n > 1]).tolist()}
            wide = {k: (place[at], keep[at]) for k, at in wide.items()}
            doc, copy, number, word, size, cls, keep = (x[once] for x in (doc, copy, number, word, size, cls, keep))
            total = np.concatenate(([0], np.cumsum(size)))
            apart = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (np.diff(number) != 1)
            source, is_in = keep.copy(), np.zeros(len(doc), bool)
            at = np.flatnonzero(np.concatenate(([True], apart | (keep[1:] != keep[:-1]) | (doc[1:] == keep[1:]))))
            end = np.append(at[1:], len(doc))
            is_in |= np.repeat((doc[at] != keep[at]) & (total[end] - total[at] >= passage), end - at)
            for k, (at, held) in wide.items():
                ok = total[at + k] - total[at] >= passage
                for i in range(k):
                    source[at[ok] + i], is_in[at[ok] + i] = held[ok], True
            new = np.concatenate(([True], apart | (source[1:] != source[:-1]) | (is_in[1:] != is_in[:-1])))
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(doc)) - 1
            least = np.minimum.reduceat(cls, at)
            hit = np.flatnonzero(is_in[at])
            if len(hit):
                at, last = at[hit], last[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[at]), pa.array(word[at].astype(np.int32)), pa.array((word[last] + size[last] - word[at]).astype(np.int32)),
                     pa.array(source[at]), pa.array(least[hit])], names=["doc_id", "word", "n_words", "kept_doc_id", "class_id"])

    both = hits.select("doc_id", "copy", "number", F.lit(1).alias("n"), "word", "size", "class_id", "kept").unionByName(seeds)
    return deal_out(both, "doc_id").sortWithinPartitions("doc_id", "copy", "number", "n") \
        .mapInArrow(run, "doc_id long, word int, n_words int, kept_doc_id long, class_id long")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without words first .. first + n - 1 of each span; the lines stay, emptied ones go."""
    import re

    at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, done = [], 0
    for first, n in sorted(spans):
        lo, hi = at[first][0], at[min(first + n, len(at)) - 1][1]
        if lo >= done:
            out.append(text[done:lo])
            done = hi
    out.append(text[done:])
    return "\n".join(x for x in (line.strip(" ") for line in "".join(out).split("\n")) if x)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Documents without their repeated passages, with n_chars counted anew; a document with nothing left goes.

    Texts are shuffled once, by doc_id, at every size: the passages join by a merge join.
    """
    spans = repeated_passages(docs).groupBy("doc_id").agg(F.collect_list(F.struct("word", "n_words")).alias("__spans"))
    spans = materialize(spans, "paragraph-spans")
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b.column(len(names))
            cols = list(b.columns[:len(names)])
            hit = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                text = cols[names.index("text")].to_pylist()
                count = cols[names.index("n_chars")].to_pylist()
                keep = np.ones(b.num_rows, bool)
                for i in hit.tolist():
                    text[i] = without_words(text[i], [(x["word"], x["n_words"]) for x in gone[i].as_py()])
                    count[i], keep[i] = len(text[i]), bool(text[i])
                cols[names.index("text")], cols[names.index("n_chars")] = pa.array(text, pa.string()), pa.array(count, pa.int64())
                cols = [c.filter(pa.array(keep)) for c in cols]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    python_tasks(docs.sparkSession)
    return docs.join(spans.hint("merge"), "doc_id", "left").select(*names, "__spans").mapInArrow(run, schema)


def op5_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
