"""Operators on documents against brute force on small tables, with nulls, empty texts, repeats and clashing columns."""
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def odd_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 3), (4, "one", None, "a", 3), (4, "one", None, "a", 3),
            (None, "null id here", "fr", None, None), (5, "...!!! 123 ###", "de", "b", 9), (6, "word " * 4000, "en", "b", None)]
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", size int, hash string, slot double")


# ---- packing ---------------------------------------------------------------------------------------------------

def check_packing(rows, texts):
    from tokenizers import Tokenizer
    import public_tokenizers

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = np.array(lib.encode(texts[doc] or "", add_special_tokens=False).ids + [2], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert all(r.length == 1024 for r in parts[1:])
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_seq), sum(r.length for r in rows)


def test_packing_real_documents(docs, texts):
    from ledgerline.llm.packing import pack
    sequences, tokens = check_packing(pack(docs).collect(), texts)
    assert sequences <= 1.02 * -(-tokens // 1024) + 1


def test_packing_odd_rows(spark):
    from ledgerline.llm.packing import pack
    rows = pack(odd_rows(spark)).collect()
    assert sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert [r.length for r in rows if r.doc_id in (1, 2)] == [1, 1]
    assert pack(odd_rows(spark).limit(0)).count() == 0


def test_tokenizer_paths_agree():
    from ledgerline.llm.packing import ByteTokenizer, _cuts
    from tokenizers import Tokenizer
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    fast, lib = ByteTokenizer(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    pool = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "1", "23", "²", "½", ".", "!!", "<|endoftext|>", "漢", "🙂", "\u0301", "ﬁ", "\x1c", "\x85", "word", "Ñ"]
    for _ in range(300):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))
        assert fast.ids(t.encode()).tolist() == lib.encode(t, add_special_tokens=False).ids, t
    long = "".join(rng.choice(["ab ", "c, ", "d\n", "1 ", "  e "]) for _ in range(3000))
    parts = list(_cuts(long, 100))
    assert len(parts) > 5 and "".join(parts) == long
    assert sum((lib.encode(p).ids for p in parts), []) == lib.encode(long).ids


def test_plan_packs_as_well_as_best_fit():
    import bisect
    from ledgerline.llm.packing import plan
    rng = np.random.default_rng(5)
    for n in (1, 7, 300, 3000):
        lengths, counts = np.unique(rng.integers(1, 1025, n), return_counts=True)
        h = dict(zip(lengths.tolist(), counts.tolist()))
        slots = plan(h)
        assert {x: sum(s[2] for s in slots if s[0] == x) for x in h} == h
        rooms, best = [], 0
        for x in sorted((x for x in h for _ in range(h[x])), reverse=True):
            k = bisect.bisect_left(rooms, x)
            best += k == len(rooms)
            bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else 1024) - x)
        used = max(s[2] + s[3] for s in slots)
        assert used <= 1.01 * best + 1


# ---- token counts ----------------------------------------------------------------------------------------------

def test_token_counts(spark, docs, texts):
    from ledgerline.llm.tokencount import count_tokens
    from tokenizers import Tokenizer
    import public_tokenizers
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    more = {100000 + i: t for i, t in enumerate([None, "", "A<|endoftext|>b <|startoftext|>", "don't 'S ²x½ a_b", "İstanbul ẞ ΑΣ Σ", "e\u0301 ﬁ 漢字 ١٢", "\x1ca\x85b", "x" * 5000])}
    extra = spark.createDataFrame([(k, t, None, None, None) for k, t in more.items()] + [(None, "a b", None, None, None)] * 2, SCHEMA)
    got = count_tokens(docs.unionByName(extra)).collect()
    assert sum(r.doc_id is None for r in got) == 2
    want = {**texts, **more, None: "a b"}
    for r in got:
        t = want[r.doc_id] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048), t[:80]
    assert len(got) == len(texts) + len(more) + 2
    assert count_tokens(docs.limit(0)).count() == 0


# ---- sharding --------------------------------------------------------------------------------------------------

def test_sharding(spark, docs, texts):
    from ledgerline.llm.sharding import shard_documents
    rows = shard_documents(spark, docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    total = [0] * 8
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        total[r.shard] += r.size
    assert max(total) - min(total) <= 0.02 * max(total)
    odd = shard_documents(spark, odd_rows(spark)).collect()
    assert len(odd) == 8 and sorted(r.size for r in odd if r.doc_id in (1, 2)) == [1, 1]
    assert shard_documents(spark, docs.limit(0)).count() == 0


def test_equal_texts_share_a_shard_unless_too_heavy(spark, monkeypatch):
    from ledgerline.llm import sharding as S
    rng = random.Random(8)
    texts = [" ".join(str(rng.random()) for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000 + i, texts[5]) for i in range(200)] + [(20_000 + i, None) for i in range(50)]
    rows += [(30_000, "heavy " * 9)] * 4000  # one row repeated: far above the mean load
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.shard_documents(spark, df).collect()
    where: dict[int, set] = {}
    load = [0] * 8
    for r in got:
        where.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        load[r.shard] += r.size
    assert len(where[zlib.crc32(b"heavy " * 9), 55]) == 8
    assert all(len(v) == 1 for k, v in where.items() if k[1] != 55) and max(load) - min(load) <= 0.05 * max(load)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


# ---- simhash ---------------------------------------------------------------------------------------------------

def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    parent = {i: i for i in prints}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_simhash_groups(spark, docs, texts):
    from ledgerline.llm.simhash import keep_one_per_group, simhash_groups
    more = {900 + i: t for i, t in enumerate([None, "", "  ", "A b", "a B", "ÀÉ x"])}
    all_docs = docs.unionByName(spark.createDataFrame([(k, t, None, None, None) for k, t in more.items()], SCHEMA))
    prints = {k: plain_fingerprint(t) for k, t in {**texts, **more}.items()}
    want = classes(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(all_docs).collect()}
    assert got == {k: (f"{p:016x}", want[k]) for k, p in prints.items()}
    assert {r.doc_id for r in keep_one_per_group(all_docs).collect()} == set(want.values())
    assert simhash_groups(docs.limit(0)).count() == 0
    assert simhash_groups(odd_rows(spark)).count() == 8


def test_keys_lose_no_link_and_hot_buckets_split(spark, monkeypatch):
    from ledgerline.llm import simhash as S
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))]
    y = x ^ np.array(flips, np.uint64)
    for make in (S.golay_keys, S.fine_keys):
        (ka, ra), (kb, rb) = make(x), make(y)
        a, b = set(zip(ra.tolist(), ka.tolist())), set(zip(rb.tolist(), kb.tolist()))
        assert {r for r, _ in a & b} == set(range(300))
    monkeypatch.setattr(S, "BUCKET", 4)
    base = int(x[0])
    near = sorted({base ^ (1 << i) ^ (1 << j) for i in range(0, 60, 7) for j in range(0, 60, 9)} | {base ^ 0xFFFF})
    fps = spark.createDataFrame([(int(np.array(v, np.uint64).view(np.int64)),) for v in near], "fp long")
    links = S.fingerprint_links(fps).collect()
    parent = {v: v for v in near}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for r in links:
        a, b = (int(np.array(v).view(np.uint64)) for v in (np.int64(r.src), np.int64(r.dst)))
        assert (a ^ b).bit_count() <= 2
        parent[root(a)] = root(b)
    want = classes(dict(enumerate(near)))
    assert len({root(v) for v in near}) == len(set(want.values()))


def test_components(spark):
    from ledgerline.llm.components import connected_components
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60) if i % 13] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(35)] + [(7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(links, "src long, dst long")).collect())
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {n: root(n) for n in list(parent)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---- substring dedup -------------------------------------------------------------------------------------------

def prose(rng, n):
    out, k = [], 0
    for _ in range(n):
        k -= 1
        w = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
        if k <= 0:
            k = rng.randint(4, 14)
            if out:
                out[-1] += "."
            w = w.capitalize()
        out.append(w)
    return out


def test_passages_across_documents(spark):
    from ledgerline.llm.substrings import remove_repeats, repeated_passages
    rng = random.Random(4)
    passage = " ".join(prose(rng, 70)) + "."
    rows = [(i, " ".join(prose(rng, 120)) + " " + passage + " " + " ".join(prose(rng, 60)), None, None, None) for i in (3, 5, 8)]
    rows += [(i, " ".join(prose(rng, 150)), None, None, None) for i in (1, 2, 10)]
    rows += [(11, None, None, None, None), (12, "", None, None, None), (None, passage, None, None, None), (13, "All rights reserved.", None, None, None),
             (14, "All rights reserved.", None, None, None), (20, passage, None, None, None), (20, passage, None, None, None)]
    docs = spark.createDataFrame([(*r, 1, "h") for r in rows], SCHEMA + ", word int, hash string")
    got = repeated_passages(docs).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(5, 3), (8, 3), (20, 3)}
    assert all(r.n_words >= 40 for r in got)
    left = {r.doc_id: r.text for r in remove_repeats(docs).collect()}
    assert left[3] == rows[0][1] and left[1] == rows[3][1] and 13 in left and 14 in left
    assert passage[80:-120] not in left[5] and left[5].split()[:100] == rows[1][1].split()[:100] and left[5].split()[-50:] == rows[1][1].split()[-50:]
    assert repeated_passages(docs.limit(0)).count() == 0


def test_near_paragraphs_are_verified(spark):
    from ledgerline.llm.substrings import bands, repeated_passages
    n, r = bands(0.8, 0.95)
    assert 1 - (1 - 0.8 ** r) ** n >= 0.95
    rng = random.Random(9)
    lines = [prose(rng, 24) for _ in range(4)]
    one = "\n".join(" ".join(x).replace(".", "") for x in lines)
    near = "\n".join(" ".join(x[:-1] + ["changed"]).replace(".", "") for x in lines)  # Jaccard 19 / 21
    far = "\n".join(" ".join(x[:9] + ["changed"] + x[10:]).replace(".", "") for x in lines)  # Jaccard 15 / 25
    docs = spark.createDataFrame([(1, one), (2, near), (3, far)], "doc_id long, text string")
    assert {(x.doc_id, x.kept_doc_id) for x in repeated_passages(docs).collect()} == {(2, 1)}


# ---- decontamination -------------------------------------------------------------------------------------------

def test_tiles_cover_reordered_text():
    from ledgerline.llm.decontaminate import tiles
    test = np.arange(100, 140, dtype=np.uint64)
    frag = np.concatenate((test[20:], [1, 2], test[:20])).astype(np.uint64)
    found = tiles(test, [frag])
    assert sorted((a, k) for a, _, _, k in found) == [(0, 20), (20, 20)]
    same = np.full(30, 7, np.uint64)
    found = tiles(same, [same[:12], same[:7]])
    covered = sorted(a + i for a, _, _, k in found for i in range(k))
    assert covered == sorted(set(covered)) and len(covered) == 19


def test_decontamination(spark):
    from ledgerline.llm.decontaminate import contaminated, without_contaminated
    rng = random.Random(6)
    items = {i: prose(rng, 40) for i in range(6)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(7, None), (8, "two words"), (None, "a b c d e f g")], "item_id long, text string")
    filler = lambda n: prose(rng, n)
    w = items[2]
    rows = [(1, " ".join(filler(50) + items[0] + filler(20))), (2, " ".join(filler(30) + w[25:] + filler(9) + w[12:25] + ["x"] + w[:12])),
            (3, " ".join(filler(20) + items[1][:15] + filler(20))), (4, " ".join(items[3]).upper() + "!!"), (5, None), (6, ""), (9, " ".join(filler(200))),
            (4, "clean row of a repeated id"), (None, " ".join(items[0])), (10, "two words"), (11, "“" + "” “".join(items[5]) + "”")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, seed int, key string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 2), (4, 3), (11, 5)}
    assert got[(2, 2)].coverage == 1.0 and got[(2, 2)].n_tiles == 3 and got[(1, 0)].n_tiles == 1
    assert sorted(r.doc_id for r in without_contaminated(docs, bench).collect() if r.doc_id) == [3, 5, 6, 9, 10]
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("between", [" ", "\n", "\t", "-", None])
def test_no_tile_breaks_at_part_borders(spark, monkeypatch, between):
    """The word hashes of a text read in parts are those of the whole text, for any word break and for one endless word."""
    from ledgerline.llm import decontaminate as D
    rng = random.Random(9)
    words = [rng.choice(["a", "bb", "ccc" * 9, "dddd", "x" * rng.randint(1, 90)]) for _ in range(400)]
    text = (between or "").join(words).encode()
    whole = D.hashed_words([text])[0]
    for chunk in (7, 32, 64, 333, len(text) - 1, len(text), 10 ** 6):
        monkeypatch.setattr(D, "CHUNK", chunk)
        assert (D.text_words(text) == whole).all()
    monkeypatch.undo()
    if between:  # an item laid over the border of 1 MB
        item = prose(rng, 8)
        lead = between.join(["lorem"] * (((1 << 20) - 20) // (5 + len(between))))
        docs = spark.createDataFrame([(1, lead + between + between.join(item) + between + lead)], "doc_id long, text string")
        got, = D.contaminated(docs, spark.createDataFrame([(3, " ".join(item))], "item_id long, text string")).collect()
        assert (got.doc_id, got.item_id, got.coverage, got.n_tiles) == (1, 3, 1.0, 1)


# ---- language --------------------------------------------------------------------------------------------------

def test_gradients_match_differences():
    from ledgerline.llm import langid as L
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in L.new_network(3, rng, 4).items()}
    x, y, valid = rng.integers(97, 105, (9, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1]), np.ones((9, 5), bool)
    valid[6:, 2] = False
    _, g = L.gradients(x, y, valid, p)
    for k in p:
        i = (int(x[4, 1]), 5) if k[0] == "x" else tuple(int(rng.integers(0, s)) for s in p[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        assert abs(g[k][i] - (L.gradients(x, y, valid, up)[0] - L.gradients(x, y, valid, down)[0]) / 2e-2) < 1e-4, k


def test_fast_states_equal_plain_states():
    from ledgerline.llm import langid as L
    p = L.new_network(3, np.random.default_rng(1))
    x = np.random.default_rng(2).integers(0, 256, (20, 7)).astype(np.uint8)
    for d in "fb":
        assert np.allclose(L.direction(x, p, d)[0], L.states_only(x.astype(np.intp), p, d), atol=1e-5)


def test_language_accuracy_and_odd_texts(spark):
    from ledgerline.llm.langid import accepted, label_documents
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    odd = odd_rows(spark).where("doc_id is null or doc_id in (1, 2, 3, 5)").selectExpr("doc_id + 1000000 as doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    rows = label_documents(docs.unionByName(odd)).collect()
    test = [r for r in rows if r.held_out and r.doc_id in lang]
    assert len(test) > 100 and np.mean([r.lang_pred == lang[r.doc_id] for r in test]) > 0.95
    for r in rows:
        if r.doc_id in (1000001, 1000002, 1000003, 1000005):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    # repeated rows of one id, a language of copies and many languages don't crowd out a language
    from ledgerline.llm.langid import learn
    crowd = docs.select("doc_id", "text", "lang").unionByName(spark.range(20_000).selectExpr("0 as doc_id", "'same row' as text", "'xx' as lang")) \
        .unionByName(spark.range(20_000).selectExpr("id % 3 + 1000000 as doc_id", "'other words here' as text", "'yy' as lang"))
    assert set(learn(crowd, steps=1)[0]) == set(lang.values()) - {None} | {"xx", "yy"}
    nothing = label_documents(docs.selectExpr("doc_id", "text", "cast(null as string) lang").limit(5)).collect()
    assert [r.lang_pred for r in nothing] == ["und"] * 5
    assert accepted(docs.selectExpr("doc_id", "text", "cast(null as string) lang").limit(5)).count() == 5
