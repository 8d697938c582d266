"""Language identification by a bidirectional gated recurrent network over bytes, trained and run in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_texts, python_tasks, table

#: Hidden units of each direction; bytes of one window; windows run at once.
HIDDEN, WINDOW, TILE = 8, 64, 4096
#: Bounds of the training sample: documents of a language, windows of a document, languages.
TRAIN_DOCS, TRAIN_WINDOWS, MAX_LANGUAGES = 400, 6, 250
STEPS, BATCH, RATE = 500, 192, 0.02
#: A text whose mean probability of its label is lower is rejected by ``accepted``.
LEAST_SCORE = 0.4
UNKNOWN = "und"
LETTER = re.compile(b"[A-Za-z]")


# ---- network ---------------------------------------------------------------------------------------------------

def new_network(classes: int, rng: np.random.Generator, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Parameters in float32. Per direction d (f, b): x_d has a row of gate inputs for each byte, u_d and c_d are recurrent."""
    p = {"out": rng.normal(0, 0.3, (2 * hidden, classes)), "bias": np.zeros(classes)}
    for d in "fb":
        p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
        p["u" + d] = rng.normal(0, 0.3, (hidden, 2 * hidden))
        p["c" + d] = rng.normal(0, 0.3, (hidden, hidden))
    return {k: v.astype(np.float32) for k, v in p.items()}


def direction(x: np.ndarray, p: dict, d: str) -> tuple[np.ndarray, list]:
    """States of one direction for bytes ``x`` of shape (time, windows), and what backpropagation needs of each step.

    Gates are (1 + tanh(a)) / 2, the logistic function of 2a.
    """
    u, c = p["u" + d], p["c" + d]
    size = c.shape[0]
    h = np.zeros((x.shape[1], size), np.float32)
    states, trace = np.empty((*x.shape, size), np.float32), []
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        a = p["x" + d][x[t]]
        g = (np.tanh(h @ u + a[:, :2 * size]) + 1) / 2
        r, z = g[:, :size], g[:, size:]
        n = np.tanh((r * h) @ c + a[:, 2 * size:])
        trace.append((t, h, r, z, n))
        h = h + z * (n - h)
        states[t] = h
    return states, trace


def states_only(x: np.ndarray, p: dict, d: str) -> np.ndarray:
    """The states of ``direction``, computed in place gate by gate; ``x`` holds whole numbers fit for indexing."""
    size = p["c" + d].shape[0]
    at = [np.ascontiguousarray(p["x" + d][:, k * size:(k + 1) * size]) for k in range(3)]
    ur, uz = (np.ascontiguousarray(p["u" + d][:, k * size:(k + 1) * size]) for k in range(2))
    c = p["c" + d] * np.float32(0.5)
    h = np.zeros((x.shape[1], size), np.float32)
    states = np.empty((*x.shape, size), np.float32)
    r, z, n, a = (np.empty_like(h) for _ in range(4))
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        for out, left, right, k in ((r, h, ur, 0), (z, h, uz, 1), (n, r, c, 2)):
            np.matmul(left, right, out=out)
            out += np.take(at[k], x[t], 0, out=a, mode="clip")
            np.tanh(out, out=out)
            if k < 2:
                out += 1
            if k == 0:
                r *= h
        z *= 0.5
        n -= h
        n *= z
        h = np.add(h, n, out=states[t])
    return states


def probabilities(x: np.ndarray, p: dict) -> np.ndarray:
    """Label probabilities of every position: (classes, time, windows)."""
    size, x = p["cf"].shape[0], x.astype(np.intp)
    logits = np.ascontiguousarray(p["out"][:size].T) @ states_only(x, p, "f").reshape(-1, size).T
    logits += np.ascontiguousarray(p["out"][size:].T) @ states_only(x, p, "b").reshape(-1, size).T
    logits += p["bias"][:, None]
    np.clip(logits, -40, 40, out=logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits.reshape(-1, *x.shape)


def gradients(x: np.ndarray, y: np.ndarray, valid: np.ndarray, p: dict) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over valid positions and its gradients, by backpropagation through time."""
    size = p["cf"].shape[0]
    runs = {d: direction(x, p, d) for d in "fb"}
    both = np.concatenate([runs["f"][0], runs["b"][0]], -1)
    logits = both @ p["out"] + p["bias"]
    logits -= logits.max(-1, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(-1, keepdims=True)
    weight = (valid / valid.sum()).astype(np.float32)
    w = np.arange(x.shape[1])
    loss = float(-(np.log(prob[:, w, y] + 1e-9) * weight).sum())
    delta = prob
    delta[:, w, y] -= 1
    delta *= weight[..., None]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["out"] = np.einsum("tbi,tbc->ic", both, delta)
    g["bias"] = delta.sum((0, 1))
    for d, back in (("f", p["out"][:size].T), ("b", p["out"][size:].T)):
        u, c = p["u" + d], p["c" + d]
        carry = np.zeros((x.shape[1], size), np.float32)
        for t, h, r, z, n in reversed(runs[d][1]):
            dh = delta[t] @ back + carry
            dn = dh * z * (1 - n * n)
            dz = dh * (n - h) * 2 * z * (1 - z)
            drh = dn @ c.T
            dr = drh * h * 2 * r * (1 - r)
            gate = np.concatenate([dr, dz], 1)
            g["c" + d] += (r * h).T @ dn
            g["u" + d] += h.T @ gate
            np.add.at(g["x" + d], x[t], np.concatenate([gate, dn], 1))
            carry = dh * (1 - z) + drh * r + gate @ u.T
    return loss, g


def train(x: np.ndarray, valid: np.ndarray, y: np.ndarray, classes: int, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over random batches of windows; x and valid have shape (windows, WINDOW)."""
    rng = np.random.default_rng(seed)
    p = new_network(classes, rng)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for i in range(1, steps + 1):
        some = rng.integers(0, len(x), BATCH)
        _, g = gradients(x[some].T, y[some], valid[some].T, p)
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = RATE * (1 - i / (steps + 1))
        for k, a in g.items():
            a *= min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] -= (rate * (m[k] / (1 - 0.9 ** i)) / (np.sqrt(v[k] / (1 - 0.99 ** i)) + 1e-8)).astype(np.float32)
    return p


# ---- texts -----------------------------------------------------------------------------------------------------

def has_letter(raw: bytes) -> bool:
    return bool(LETTER.search(raw)) or any(ch.isalpha() for ch in raw.decode("utf-8"))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all texts in windows: bytes (n, WINDOW), valid bytes of each, its text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = -(-sizes // WINDOW)
    flat = np.frombuffer(b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, count)), np.uint8)
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return flat.reshape(-1, WINDOW), np.minimum(WINDOW, sizes[owner] - place * WINDOW), owner


def pooled(texts: list[bytes], p: dict) -> np.ndarray:
    """Mean of all positions' label probabilities for each non-empty text."""
    x, valid, owner = windows(texts)
    total = np.zeros((len(texts), len(p["bias"])))
    for at in range(0, len(x), TILE):
        v = valid[at:at + TILE]
        prob = probabilities(np.ascontiguousarray(x[at:at + TILE].T), p)
        if v.min() < WINDOW:
            prob *= np.arange(WINDOW)[:, None] < v
        np.add.at(total, owner[at:at + TILE], prob.sum(1, dtype=np.float64).T)
    return total / np.array([[max(1, len(t))] for t in texts])


# ---- Spark -----------------------------------------------------------------------------------------------------

def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, docs_per_language: int = TRAIN_DOCS, steps: int = STEPS) -> tuple[list[str], dict[str, np.ndarray]]:
    """(languages, network) from a bounded sample of documents that aren't held out.

    The sample takes the documents of each non-null lang with the smallest hashes of doc_id, at most
    ``docs_per_language`` (of rows with one doc_id and lang, one), and from each TRAIN_WINDOWS windows spread over its
    bytes; of more than MAX_LANGUAGES languages those with most documents are learned. A count of each language's ids
    says up to which hash its rows can matter, so all others stay in their tasks.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("ids"), "lang").limit(MAX_LANGUAGES)
    spread = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)),
                         lambda i: F.substring(F.col("text").cast("binary"), (F.greatest(F.octet_length("text") - WINDOW, F.lit(0)) * i / TRAIN_WINDOWS).cast("int") + 1, F.lit(WINDOW)))
    mixed = F.xxhash64("doc_id")
    near = known.join(F.broadcast(sizes), "lang").where((mixed / 2.0 ** 64 + 0.5) * F.col("ids") < 2 * docs_per_language + 100)
    once = near.select("doc_id", "lang", mixed.alias("mixed"), spread.alias("parts")).groupBy("lang", "mixed", "doc_id").agg(F.min("parts").alias("parts"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("mixed", "doc_id"))
    rows = once.withColumn("rank", rank).where(F.col("rank") <= docs_per_language).select("lang", "parts").collect()
    names = sorted({r.lang for r in rows})
    if not names:
        return [], {}
    raw = [(bytes(w), names.index(r.lang)) for r in sorted(rows, key=lambda r: (r.lang, r.parts)) for w in r.parts if w]
    x, valid, _ = windows([w for w, _ in raw])
    return names, train(x, np.arange(WINDOW) < valid[:, None], np.array([y for _, y in raw]), len(names), steps)


def predictions(texts: list[bytes], names: list[str], network: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text by its bytes alone."""
    label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    read = [i for i, t in enumerate(texts) if names and t and has_letter(t)]
    if read:
        prob = pooled([texts[i] for i in read], network)
        for i, k, s in zip(read, prob.argmax(1), prob.max(1)):
            label[i], score[i] = names[k], min(1.0, float(s))
    return label, score


def identify(docs: DataFrame, names: list[str], network: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, score = predictions(binary_texts(b.column(2)), names, network)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(label, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    python_tasks(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, all columns as they are, that the network gives a language with a score of at least ``least``.

    Texts without a letter and null texts go. If there is no language to learn, every text with a letter stays.
    """
    names, network = learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = binary_texts(b.column(b.schema.get_field_index("text")))
            if names:
                keep = predictions(texts, names, network)[1] >= least
            else:
                keep = np.array([bool(t) and has_letter(t) for t in texts])
            yield b.filter(pa.array(keep))

    python_tasks(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def label_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of doc_id as text mod 4 is 2), lang_pred, score.

    Null texts, texts without a letter and, if nothing can be learned, all texts are ``und`` with score 0. A null doc_id
    is not held out and not learned from. Whole texts are read in windows of 64 bytes; the network labels every byte and
    a text's score is the mean probability of its label over all bytes. Repeated rows stay. Empty input gives an empty
    result. Only doc_id, text and, for learning, lang are read.
    """
    return identify(docs, *learn(docs))


def op9_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_documents(table(spark, sf_dir, "documents"))
