"""Periodic runs, cost-balanced packing and the Merkle manifest against brute force, with nulls, ties, repeats and long texts."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from test_text_operators import SF, odd_rows


# ---- periodic runs ---------------------------------------------------------------------------------------------

def brute_runs(w, least, times):
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - p:
            if w[i] == w[i + p]:
                j = i
                while j < len(w) - p and w[j] == w[j + p]:
                    j += 1
                seg = w[i:j + p]
                if len(seg) >= max(least, times * p) and not any(seg[q:] == seg[:-q] for q in range(1, p)):
                    out.append((i, len(seg), p))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    from ledgerline.llm.periodic import find_runs
    rng = random.Random(1)
    for _ in range(250):
        n, k = rng.randint(1, 130), rng.choice([1, 2, 3, 50])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(n), rng.randint(1, 12)
            for i in range(a + p, min(n, a + rng.randint(1, 80))):
                w[i] = w[i - p]
        for least, times in ((24, 3), (8, 2), (2, 2)):
            assert find_runs(np.array(w), least, times) == brute_runs(w, least, times), w


def test_ordered_sets_in_blocks(monkeypatch):
    from ledgerline.llm import periodic as R
    monkeypatch.setattr(R, "BLOCK", 4)
    s, have, rng = R.Positions(500), [500], random.Random(2)
    for x in rng.sample([x for x in range(1000) if x != 500], 300):
        have = sorted([*have, x])
        k = have.index(x)
        assert s.add(x) == (have[k - 1] if k else -1, have[k + 1] if k + 1 < len(have) else -1)
    for n in (1, 4000):
        assert R.find_runs(np.tile(np.arange(n), 8000 // n if n == 1 else 3)) == [(0, 8000 if n == 1 else 12000, n)]
    w = np.concatenate([np.zeros(3000, int), [1], np.zeros(3000, int)])
    assert R.find_runs(w) == [(0, 3000, 1), (3001, 3000, 1)]


def planted(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def digests(w):
    runs = brute_runs(w, 24, 3)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_documents(spark, monkeypatch):
    from ledgerline.llm import catalog
    from ledgerline.llm import periodic as R
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    more = [(None, "a b " * 30), (9001, None), (9002, ""), (9003, "\t\n "), (9004, "x\x0by z " * 20), (9005, ("é ü " * 15) + "end"), (9005, ("é ü " * 15) + "end"),
            (9006, " ".join(rng.choice("ab") for _ in range(600))), (9007, "one\xa0word " * 40)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    monkeypatch.setattr(R, "table", lambda *a: docs.selectExpr("*", "1 as h", "'x' as w", "2 as n"))
    got = catalog.QUERIES["op11_periodic_runs"](spark, SF).collect()
    want = sorted(((r.doc_id, *digests(planted(r.doc_id, r.text))) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got), key=repr) == want
    assert sum(r.n_runs > 0 for r in got) > 15
    assert R.periodic_runs(docs.limit(0)).count() == 0
    kept = {r.doc_id: (r.n_words, r.collapsed, [tuple(x) for x in r.runs]) for r in R.periodic_runs(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    assert kept[None] == (60, "a b", [(0, 60, 2)]) and kept[9005] == (31, "é ü end", [(0, 30, 2)]) and kept[9001] == (0, "", [])


def test_long_text_is_read_whole(spark):
    from ledgerline.llm.periodic import _parts, periodic_runs
    rng = random.Random(5)
    base = [f"w{rng.randrange(10 ** 9)}" for _ in range(60_000)]
    text = " ".join(base) + "\n" + " ".join(base) + "\t" + " ".join(base) + " " + "z" * 3_000_000 + " end"
    assert b"".join(_parts(text.encode())) == text.encode() and len(list(_parts(text.encode()))) == 3
    r = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 180_000, 60_000)] and r.collapsed == " ".join(base) + " " + "z" * 3_000_000 + " end"


# ---- cost-balanced packing -------------------------------------------------------------------------------------

def test_ids_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    from ledgerline.llm.balanced import WordIds
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own, rng = Tokenizer.from_file(path), WordIds(path), random.Random(0)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDE'''  \n\t.,!?_-0123456789éüßñÅÇøı²½ªº\xa0\x85\x1c\x1fǅİſ日本Ω<|>$%"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["don't we'll I've they're it's 'tis ''s 's's'll", "x'RE'Ve'M", "<|endoftext|>a<|startoftext|>", "<|endoftext|>", "a'", "'", "'r", "'l", "l'l'l", "", "  "]
    texts += [w.removesuffix("</w>") for w in list(lib.get_vocab())[:20000]]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 18))) for _ in range(20000)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.ids([t.encode() for t in texts])] == want


def test_plan_fills_everything():
    from ledgerline.llm.balanced import plan
    rng = random.Random(4)
    for _ in range(60):
        cap = rng.choice([8, 64, 2048])
        hist = {rng.randint(1, cap): rng.choice([1, 2, 30, 5000]) for _ in range(rng.randint(1, 40))}
        used: dict[int, list] = {}
        placed = plan(hist, cap)
        for length, n in hist.items():
            starts, at = {0}, 0
            for rank in {0, n // 2, n - 1}:  # every rank is covered from 0 to its length without a gap
                at = 0
                while at < length:
                    hit = [p for p in placed[length, at] if p[0] <= rank < p[0] + p[1]]
                    assert len(hit) == 1
                    at += hit[0][2]
                assert at == length
        for parts in placed.values():
            for _, times, size, first, offset in parts:
                for s in range(first, first + times):
                    used.setdefault(s, []).append((offset, size))
        total = sum(a * b for a, b in hist.items())
        sizes = []
        for s in used.values():
            at = 0
            for offset, size in sorted(s):
                assert offset == at
                at += size
            sizes.append(at)
        assert sum(sizes) == total and sorted(used) == list(range(len(used)))
        assert all(x == cap or x & (x - 1) == 0 for x in sizes) and sum(x != cap for x in sizes) <= cap.bit_length()
    assert plan({}) == {}


def test_descending_documents_go_to_the_cheapest_sequence():
    """The class-wise plan gives the sequences that placing one document after another gives."""
    from ledgerline.llm.balanced import attention_cost, plan
    hist = {700: 5, 500: 6, 300: 9, 120: 7, 9: 40}
    total = sum(a * b for a, b in hist.items())
    room = [2048] * (total // 2048) + [1 << k for k in range(12) if total % 2048 >> k & 1]
    cost = [0.0] * len(room)
    for length in (700, 500):
        for _ in range(hist[length]):
            s = min((i for i in range(len(room)) if room[i] >= length), key=lambda i: (cost[i], room[i]))
            room[s] -= length
            cost[s] += attention_cost(length)
    got = [0.0] * len(room)
    for (length, start), parts in plan(hist).items():
        if length >= 500:
            for _, times, size, first, _ in parts:
                for s in range(first, first + times):
                    got[s] += attention_cost(size)
    assert sorted(got) == pytest.approx(sorted(cost))


def test_balanced_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    from ledgerline.llm.balanced import pack_balanced
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(odd_rows(spark).selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"]))
    rows = pack_balanced(docs.withColumn("length", docs.n_chars)).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = np.array(lib.encode(texts[doc] or "", add_special_tokens=False).ids + [1], "<u4")
        parts.sort(key=lambda r: r.start)
        assert b"".join(r.ids for r in parts) == ids.tobytes() and {r.doc_tokens for r in parts} == {len(ids)}
        assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        ends = np.cumsum([0] + [r.length for r in parts])
        assert [r.offset for r in parts] == ends[:-1].tolist() and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0)
    twice = pack_balanced(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], "doc_id long, text string")).collect()
    assert sum(r.length for r in twice) == 4 + 4 + 1 and sum(r.doc_id is None for r in twice) == 1
    assert pack_balanced(docs.limit(0)).count() == 0


# ---- manifest --------------------------------------------------------------------------------------------------

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, k):
    out = []
    for nodes in levels[:-1]:
        first = k - k % 8
        out.append(("".join(nodes[first:k]), "".join(nodes[k + 1:first + 8])))
        k //= 8
    return out


@pytest.mark.parametrize("height, sizes", [(1, {"en": 700, None: 3, "de": 65, "ø": 1, "z": 9}), (2, {"en": 130}), (1, {str(i): 1 + i % 3 for i in range(100)}), (4, {"a": 20, "": 2})])
def test_manifest_equals_brute_force(spark, height, sizes):
    from pyspark.sql import functions as F
    from ledgerline.llm.merkle import folded, manifest
    rng = random.Random(height)
    rows = [(lang, i, sha(f"{lang}{i}")) for lang, n in sizes.items() for i in rng.sample(range(10 ** 6), n)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, digest string").withColumn("grp", F.lit("x")).repartition(7)
    got = {(r.lang, r.doc_id): r for r in manifest(df.withColumn("was", F.col("lang")).withColumnRenamed("was", "lang2"), F.col("lang"), ["doc_id"], "digest", ["doc_id", "lang"], height)
           .withColumn("root_again", folded(F.col("leaf"), F.col("proof"))).collect()}
    trees = {lang: (ids := sorted(i for g, i, _ in rows if g == lang), tree([sha(f"{lang}{i}") for i in ids])) for lang in sizes}
    order = sorted(sizes, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][1][-1][0] for g in order])
    assert len(got) == len(rows)
    for k, g in enumerate(order):
        ids, levels = trees[g]
        for at, i in enumerate(ids):
            r = got[g, i]
            assert (r.leaf, r.subroot, r.root, r.root_again) == (levels[0][at], levels[-1][0], top[-1][0], top[-1][0])
            assert [(s.left, s.right) for s in r.proof] == path(levels, at) + path(top, k)


def test_manifest_of_odd_documents(spark, monkeypatch):
    from ledgerline.llm import catalog
    from ledgerline.llm import merkle as M
    docs = odd_rows(spark).drop("size", "hash", "slot")
    monkeypatch.setattr(M, "table", lambda *a: docs)
    got = catalog.QUERIES["op13_butterfly_manifest"](spark, SF).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = {(r.doc_id, r.text): sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))) for r in docs.collect()}
    assert sorted(r.leaf for r in got) == sorted([*leaf.values(), leaf[4, "one"]]) and len({r.root for r in got}) == 1
    for r in got:
        text = next(t for (i, t), d in leaf.items() if d == r.leaf)
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and (text or "") != (text or "").lower()
        assert r.verified == (not changed) == (r.folded_root == r.root)
    monkeypatch.setattr(M, "table", lambda *a: docs.limit(0))
    assert catalog.QUERIES["op13_butterfly_manifest"](spark, SF).count() == 0
    one = docs.where("doc_id = 6")
    monkeypatch.setattr(M, "table", lambda *a: one)
    r, = catalog.QUERIES["op13_butterfly_manifest"](spark, SF).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("")
