"""Substring dedup against brute force: long texts, hot buckets, short lines, sources of whole runs."""
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, letters="abcdefghijklmnop"):
    out, k = [], 0
    for _ in range(n):
        k -= 1
        w = "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
        if k <= 0:
            k = rng.randint(7, 14)
            if out:
                out[-1] += "."
            w = w.capitalize()
        out.append(w)
    return out


# ---- positions in long texts -----------------------------------------------------------------------------------

def test_positions_in_texts_of_many_parts(monkeypatch):
    from ledgerline.llm import substrings as S
    rng = random.Random(1)
    lines = [" ".join(prose(rng, rng.randint(1, 30))) for _ in range(900)]
    texts = ["\n".join(lines[:20]), "\n".join(lines), "", "\n".join(lines[:300]) + "\n" + " " * 9000 + "\n".join(lines[300:]), "a b " + "x" * 9000 + " " + lines[1],
             "\n".join(lines[:50])]
    raw = [t.encode() for t in texts]
    whole = [[(int(n), int(w), int(h)) for p in S.paragraph_arrays([7], [t], 0) for n, w, h in zip(p["number"], p["word"], p["hash"])] for t in raw]
    monkeypatch.setattr(S, "CHUNK", 1 << 12)
    got = {i: [] for i in range(len(raw))}
    for p in S.paragraph_arrays(list(range(len(raw))), raw, 0):
        for d, n, w, z, h, lo, hi in zip(*(p[c].tolist() for c in ("doc", "number", "word", "size", "hash", "lo", "hi"))):
            got[d].append((n, w, h))
            said = p["flat"][lo:hi].tobytes().decode().split()
            if d != 4:
                assert texts[d].split()[w:w + z] == said
    assert got.pop(4)[-1][:2] == whole[4][-1][:2]  # its first paragraph holds the cut word
    whole[4] = None
    assert got == {i: x for i, x in enumerate(whole) if x is not None}


def test_repeats_are_cut_out_of_texts_of_megabytes(spark):
    from ledgerline.llm.substrings import remove_repeats
    rng = random.Random(2)
    passage = " ".join(prose(rng, 80)) + "."
    parts = ["\n".join(" ".join(prose(rng, 20)) for _ in range(9000)) for _ in range(4)]
    text = ("\n" + passage + "\n").join(parts)
    assert len(text) > 3 << 20
    docs = spark.createDataFrame([(1, passage, None, None, len(passage)), (2, text, None, None, len(text))], SCHEMA)
    left = {r.doc_id: r.text for r in remove_repeats(docs).collect()}
    assert left == {1: passage, 2: "\n".join(parts)}


# ---- large buckets ---------------------------------------------------------------------------------------------

def shingles(words):
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def joined(sets, similarity=0.8):
    """The components of all sets that are similar enough, by comparing all of them."""
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return {frozenset(k for k, g in enumerate(group) if g == x) for x in set(group)}


def family(rng, n):
    """Paragraphs that share their first words; most have near copies that differ at the end."""
    common = [f"c{i}" for i in range(6)]
    out = []
    while len(out) < n:
        own = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 9))]
        for _ in range(rng.randint(1, 3)):
            out.append(common + own + [f"e{rng.randrange(10 ** 6)}"])
    return out[:n]


def test_every_pair_of_a_large_bucket_is_compared(spark):
    from ledgerline.llm.components import connected_components
    from ledgerline.llm.substrings import bands, colliding, hot_links, linked, paragraph_rows
    rng = random.Random(3)
    words = family(rng, 300)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    n_bands, _ = bands()
    rows = paragraph_rows(docs, n_bands)
    ids = {r["hash"]: r.doc_id for r in rows.select("hash", "doc_id").collect()}
    assert len(ids) == len(words)
    # all paragraphs under one key in every band: then nothing but the cap could leave a pair out
    hot = rows.select("hash", *[F_lit(k) for k in range(n_bands)])
    found = colliding(hot.repartition(5), n_bands)
    assert found.where("b is null").select("a").distinct().count() == len(words)
    want = {g for g in joined([shingles(w) for w in words]) if len(g) > 1}
    assert len(want) > 50

    def groups(links):
        out = {}
        for r in connected_components(links).collect():
            out.setdefault(r.component, set()).add(ids[r.node])
        return {frozenset(g) for g in out.values()}

    assert groups(linked(docs, found)) == want
    numbers = {}
    sets = spark.createDataFrame([(h, sorted(numbers.setdefault(x, 7919 * len(numbers)) for x in shingles(words[i]))) for h, i in ids.items()], "hash long, shingles array<long>")
    assert groups(hot_links(sets, bucket=20)) == want


def F_lit(k):
    from pyspark.sql import functions as F
    return F.lit(k).cast("long").alias(f"m{k}")


def test_buckets_up_to_the_bound_give_all_pairs(spark):
    from ledgerline.llm.substrings import FEW, colliding
    sizes = {10: 2, 20: FEW - 1, 30: FEW, 40: FEW + 1, 50: 3 * FEW, 60: 1000, 70: 5}
    rows = [(key * 10_000 + i, key) for key, n in sizes.items() for i in range(n)]
    some = spark.createDataFrame(rows * 3, "hash long, m0 long").repartition(7)
    got = {(r.a, r.b) for r in colliding(some, 1).collect()}
    want = {(k * 10_000 + i, k * 10_000 + j) for k, n in sizes.items() if n <= FEW for i in range(n) for j in range(i + 1, n)}
    hot = {k * 10_000 + i for k, n in sizes.items() if n > FEW for i in range(n)}
    assert {a for a, b in got if b is None} == hot
    assert want <= got and all(a // 10_000 == b // 10_000 for a, b in got if b is not None)


# ---- short lines -----------------------------------------------------------------------------------------------

def in_lines(rng, words, most=5):
    out, at = [], 0
    while at < len(words):
        n = rng.randint(1, most)
        out.append(" ".join(words[at:at + n]))
        at += n
    return "\n".join(out)


def test_short_lines_are_joined(spark):
    from ledgerline.llm.substrings import SHORT, paragraph_arrays, repeated_passages
    rng = random.Random(5)
    verse, passage = in_lines(rng, prose(rng, 60)), in_lines(rng, prose(rng, 90))
    rows = [(1, verse), (2, in_lines(rng, prose(rng, 70)) + "\n" + passage + "\n" + in_lines(rng, prose(rng, 40))), (3, in_lines(rng, prose(rng, 80))),
            (4, in_lines(rng, prose(rng, 55)) + "\n\n" + passage + "\n" + in_lines(rng, prose(rng, 66))), (5, verse), (6, "a b c"), (7, "d e f"), (8, "a b c")]
    for doc, text in rows:  # nothing is left out and nothing joined over texts
        p = [p for p in paragraph_arrays([doc], [text.encode()], 0)]
        assert sum(int(x["size"].sum()) for x in p) == (len(text.split()) if len(text.split()) >= SHORT else 0)
    together = [x for p in paragraph_arrays([d for d, _ in rows], [t.encode() for _, t in rows], 0) for x in p["doc"].tolist()]
    assert set(together) == {1, 2, 3, 4, 5}
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(4, 2), (5, 1)}
    assert next(r.n_words for r in got if r.doc_id == 5) == 60 and sum(r.n_words for r in got if r.doc_id == 4) >= 40


# ---- sources of passages ---------------------------------------------------------------------------------------

def test_a_passage_of_lines_that_others_hold_singly(spark):
    from ledgerline.llm.substrings import remove_repeats, repeated_passages
    rng = random.Random(8)
    line = lambda: " ".join(prose(rng, 9)).replace(".", "")
    passage = [line() for _ in range(7)]
    text = lambda *lines: "\n".join(lines)
    filler = lambda: [line() + " " + line() for _ in range(6)]
    rows = [(i, text(*filler(), x, *filler())) for i, x in enumerate(passage)]  # each line has another first holder
    a, b, c = filler(), filler(), filler()
    rows += [(10, text(*a, *passage, *b)), (20, text(*c, *passage, *a[:1])), (20, text(*c, *passage, *a[:1])), (30, text(passage[3], *filler(), passage[5]))]
    docs = spark.createDataFrame([(i, x, None, None, len(x)) for i, x in rows], SCHEMA)
    got = {(r.doc_id, r.word, r.n_words, r.kept_doc_id) for r in repeated_passages(docs).collect()}
    first = len(text(*c).split())
    assert got == {(20, first, 81, 10)}
    left = {r.doc_id: r.text for r in remove_repeats(docs).collect()}
    assert left.pop(20) == text(*c)
    assert left == {i: x for i, x in rows if i != 20}
