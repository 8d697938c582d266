"""Pages, urls, vectors and the entry against brute force, with nulls, empty and broken input."""
import math

import numpy as np
import pytest

SF = "/root/testdata/sf0.01"


# ---- html ------------------------------------------------------------------------------------------------------

CASES = [
    ("<body><nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>One\n <b>two</b><p>three</p></article><footer>f</footer>", "T & U\nOne two\nthree"),
    ("<div class='content'><p>a</p><div class=\"ad\">buy</div><p>b<br>c</p></div><div id=comments><p>first</p></div>", "a\nb c"),
    ("<article><p>x &lt;b&gt; &#8364;&nbsp;1</p><aside>no</aside><form><input><p>no</p></form><script>if(a<b){'</p>'}</script><ul><li>i<li>j</ul>", "x <b> € 1\ni\nj"),
    ("<article><!-- <p>no</p> --><table><tr><td>1<td>2</table><p hidden>no</p><p style='display:none'>no</p>end", "1\n2\nend"),
    ("<article><p>cut off &am", "cut off &am"),
    ("<article><div class='entry-header'><h1>T</h1></div><p>a</p><div class='commentList'><p>no</p></div><div class='siteFooter'>no</div></article>", "T\na"),
    ("<body><div id=topNav>x y z</div><div class=w><h2>Title</h2><div class=t><section><p>one two three four</p></section><section><p>five six</p></section></div></div>",
     "Title\none two three four\nfive six"),
    ("<article><p>a</p><section class='discussion'><p>we discuss</p></section><p class='more'>b</p><div id='search-results-analysis'><p>c</p></div>"
     "<table class='form'><tr><td>d</table><div class='comments'><p>no</p></div><nav class=more>no</nav></article>", "a\nwe discuss\nb\nc\nd"),
    ("<main><p>text</p></main><article class='comment'><p>first!</p></article><article class='related-card'><p>next</p></article>", "text"),
    ("<article class='post related-on has-comments'><p>text</p><article class=comment><p>no</p></article></article>", "text"),
    ("no markup at all", "no markup at all"),
    ("", ""),
    (None, ""),
]


def test_main_text_cases():
    from ledgerline.llm.htmltext import main_text
    for page, want in CASES:
        assert main_text(page or "", set(), set()) == want, page


def test_extraction_with_template(spark):
    from ledgerline.llm.htmltext import extract, templates
    rows = [(i, f"http://h.example/{i}", f"<body><div class=top>Site {i}</div><div class=box><p>Follow us on the web</p><p>Text number {i} of this page, long enough to be the main one.</p>"
             f"<p>More {i}.</p></div><div class=low><span>Written by {i}</span></div></body>") for i in range(12)]
    rows += [(50, "http://few.example/a", "<body><main><p>only</p></main></body>"), (51, None, None), (52, "nothing", ""), (51, None, None),
             (53, "http://h.example/x", "<body><div class=box><p>Follow us on the web</p><p>Cut")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r for r in extract(pages).collect()}
    for i in range(12):
        assert got[i].text == f"Text number {i} of this page, long enough to be the main one.\nMore {i}."
        assert got[i].n_chars == len(got[i].text)
    assert got[50].text == "only" and got[51].text == "" and got[52].text == "" and got[53].text == "Cut"
    assert extract(pages).where("page_id = 51").count() == 2
    assert extract(pages.limit(0)).count() == 0
    assert templates(pages).where("host = 'h.example'").first() is not None


def test_a_host_of_near_copies_keeps_its_articles(spark):
    from ledgerline.llm.htmltext import extract
    same = [f"Paragraph {k} that nearly all pages of the host share." for k in range(4)]
    page = lambda i: "<body><nav>Home</nav><article><h1>Title</h1>" + "".join(f"<p>{x}</p>" for x in [*same[:2], f"Only page {i} says so.", *same[2:]]) + "</article></body>"
    rows = [(i, f"http://copies.example/{i}", page(i)) for i in range(10)] + [(10, "http://copies.example/10", "<article><p>Another text.</p></article>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: "\n".join(["Title", *same[:2], f"Only page {i} says so.", *same[2:]]) for i in range(10)}, 10: "Another text."}


def test_doubtful_names_drop_what_the_template_has(spark):
    from ledgerline.llm.htmltext import extract
    rows = [(i, f"http://d.example/{i}", f"<body><article><p>Story {i} has text.</p><div class=more>Read more stories here</div><div class=discussion><p>We discuss {i}.</p></div></article>") for i in range(8)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} has text.\nWe discuss {i}." for i in range(8)}


def test_extraction_of_real_pages(spark):
    import html
    import re
    from ledgerline.llm.htmltext import extract
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", re.sub(r"<[^>]*$", "", inner))
        want = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in parts]
        assert got[r.page_id] == "\n".join(x for x in want if x)


# ---- urls ------------------------------------------------------------------------------------------------------

def test_url_verdicts(spark):
    from ledgerline.llm.urlfilter import RULES, judge
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = [(9001, None), (9002, "no scheme"), (9003, "HTTP://A.EXAMPLE.ORG/en/1x?q#f"), (9004, "x://a.org"), (9005, "ftp://B.com/de/#/"), (9006, "http://notcom/fr/"),
           (9007, "http://sub.example.org/es/"), (9008, "http://ÉX.com/fr/a"), (9001, None), (9009, "a://" + "x" * 5000)]
    rows = pages.select("page_id", "url").unionByName(spark.createDataFrame(odd, "page_id long, url string")).selectExpr("*", "'h' as host", "1 as label", "2 as suffix")
    urls = [(r.page_id, r.url) for r in rows.collect()]
    got = judge(rows).collect()
    assert len(got) == len(urls)
    by_id = {r.page_id: r for r in got}
    trees = []
    for page, url in urls:
        r = by_id[page]
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score > 0.5 else "allow"))
        if verdict:
            trees.append((verdict == "block", r.score))
    y, s = (np.array(x, float) for x in zip(*trees))
    assert s[y == 1].mean() > s[y == 0].mean() + 0.2
    assert judge(rows.limit(0)).count() == 0
    assert {r.verdict for r in judge(rows.where("page_id = 9001")).collect()} == {"allow"}


def test_trees_on_unseen_urls(spark):
    from pyspark.sql import functions as F
    from ledgerline.llm.urlfilter import block_share, learn, lexical, suffix_statistics, with_vector
    rows = [(i, f"http://{'ad' * (i % 5)}{'x' if i % 2 else 'y'}{i % 97}.{'biz' if i % 2 else 'info'}/{'a/' * (i % 4)}{i * 7919 if i % 2 else 'page'}") for i in range(1200)]
    full = lexical(spark.createDataFrame(rows, "page_id long, url string")).withColumn("label", F.when(F.col("page_id") % 2 == 1, "block").otherwise("allow"))
    train, test = full.where("page_id % 3 < 2"), full.where("page_id % 3 = 2")
    share = block_share(train)
    model = learn(train, suffix_statistics(train, share), share)
    right = model.transform(with_vector(test, suffix_statistics(train, share), share)).where("(prediction = 1) = (label = 'block')").count()
    assert right >= 0.97 * test.count()


# ---- neighbours ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block, strip", [(16384, 128), (37, 3)])
def test_nearest_equals_brute_force(spark, monkeypatch, block, strip):
    from pyspark.sql import functions as F
    from ledgerline.llm import neighbours as N
    monkeypatch.setattr(N, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(N, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 12)).astype(np.float32)
    x[40:60] = x[40]
    rows = [(i, [float(v) for v in x[i]]) for i in range(160)]
    rows += [(200, [0.0] * 12), (250, None), (300, [1.0] * 11 + [None]), (350, [1.0] * 11 + [math.nan]), (400, [math.inf] * 12), (450, []), (None, [1.0] * 12), (500, [1.0, 2.0]),
             rows[0], rows[7]]
    got = {}
    for r in N.nearest(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, x int"), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 160, 10))
    d = x.astype(float)
    d /= np.sqrt((d * d).sum(1))[:, None]
    for q, found in got.items():
        want = sorted(((-round(float(d[q] @ d[j]), 9), j) for j in range(160) if j != q))[:5]
        assert [(r, j) for r, j, _ in sorted(found)] == [(k + 1, j) for k, (_, j) in enumerate(want)]
        assert all(abs(s + w) < 1e-8 for (_, _, s), (w, _) in zip(sorted(found), want))


def test_an_id_on_many_vectors_counts_once(spark, monkeypatch):
    from pyspark.sql import functions as F
    from ledgerline.llm import neighbours as N
    rng = np.random.default_rng(5)
    q = rng.normal(size=6)
    rows = [(0, q), (0, -q), *[(7, q + rng.normal(size=6) * 1e-3) for _ in range(12)], (7, -q), *[(i, q + rng.normal(size=6)) for i in range(10, 16)], (3, 2 * q), (4, 4 * q), (10, rng.normal(size=6))]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "vec_id long, embedding array<double>")
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    best = {}
    for i, x in rows:
        for j, y in rows:
            if i == 0 and j != 0:
                best[j] = max(best.get(j, -2.0), cos(x, y))
    want = sorted(((-round(s, 12), j) for j, s in best.items()))[:5]
    for block in (16384, 4):
        monkeypatch.setattr(N, "CANDIDATE_BLOCK", block)
        got = sorted((r.rank, r.vec_id, r.score) for r in N.nearest(df, F.col("vec_id") == 0).collect())
        assert [(r, j) for r, j, _ in got] == [(k + 1, j) for k, (_, j) in enumerate(want)]
        assert all(abs(s + w) < 1e-9 for (_, _, s), (w, _) in zip(got, want))
    ids, x = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    assert sorted(j for _, j, _ in N.tile_top(ids[:1], x[:1], ids, x, 5)) == sorted(j for _, j in want)


def test_error_bounds_hold():
    from ledgerline.llm.neighbours import SLACK, cosines, int8_product, quantise
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(50, 1500)), rng.normal(size=(60, 1500)) ** 3
    (ca, sa, la, ea), (cb, sb, _, eb) = quantise(a), quantise(b)
    assert (int8_product(ca, cb) == ca.astype(np.int64) @ cb.astype(np.int64).T).all()
    near = int8_product(ca, cb) * (sa[:, None] * sb[None, :])
    true = np.array([cosines(np.broadcast_to(r, b.shape), b) for r in a])
    assert (np.abs(near - true) <= ea[:, None] + la[:, None] * eb[None, :] + SLACK).all()


def test_no_vectors(spark):
    from pyspark.sql import functions as F
    from ledgerline.llm.neighbours import nearest
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).count() == 0


# ---- entry -----------------------------------------------------------------------------------------------------

def test_queries_are_registered():
    import __spark_entry__ as E
    q = E.queries()
    assert {int(k[2:].split("_")[0]) for k in q if k.startswith("op") and k[2].isdigit()} == set(range(1, 14)) and "pipeline" in q


def test_pipeline_stages(spark):
    """Every stage on what its predecessor kept, against brute force."""
    import re
    import sys
    import os
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from test_text_operators import check_packing, classes, plain_fingerprint
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(5001, None, None, None, None), (5002, "12 !! 34", "en", "x", 8), (5003, "", "en", "x", 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    kept = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, sf), name)
        assert docs.columns == P.DOCUMENT_COLUMNS
        kept.append({r.doc_id: r.text for r in docs.collect()})
    start, spoken, single, cut, clean = kept
    assert set(start) - set(spoken) >= {5001, 5002, 5003} and len(spoken) >= 0.97 * len(start)
    assert set(single) == set(classes({k: plain_fingerprint(t) for k, t in spoken.items()}).values())
    assert set(cut) <= set(single) and all(set(cut[k].split()) <= set(single[k].split()) for k in cut)
    assert sum(cut[k] == single[k] for k in cut) >= 0.7 * len(single)
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    bad = set()
    for k, t in cut.items():
        w = words(t)
        seen = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        for item in items.values():
            hit = {i + d for i in range(len(item) - 4) if tuple(item[i:i + 5]) in seen for d in range(5)}
            if len(hit) >= 0.6 * len(item):
                bad.add(k)
    assert set(clean) == set(cut) - bad
    check_packing(P.STAGES[-1][1](spark, docs, sf).collect(), clean)
