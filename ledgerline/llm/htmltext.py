"""Main text of web pages by their markup, and by texts and places from token equivalence classes."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_texts, materialize, python_tasks, table

#: A class is large and frequent enough from so many tokens and from this part of the host's pages on (at least MIN_PAGES).
MIN_TOKENS, MIN_SHARE, MIN_PAGES = 2, 0.5, 5
#: A text is part of the template only if this part of the host's pages have it at the same place.
TEXT_SHARE = 0.8

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
MARKED = re.compile("class|id|role|hidden|style", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

# Fixed values of the HTML standard.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
          "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "nobr"}
#: Tags at whose start an open one of the second set ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
HEADING = re.compile(r">h[1-6](?:[.][^>]*)?$")
SECTIONS = {"html", "body", "nav", "header", "footer", "aside", "article", "main", "section", "div", "form", "ul", "ol", "table"}

#: End tags that may close an open table cell.
TABLES = SECTIONS | {"tr", "tbody", "thead", "tfoot", "td", "th"}

#: Elements, and words in class, id and role, that mark a part of a page as something else than its article.
NO_TEXT = {"head", "script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "audio", "video", "map", "select", "textarea", "button",
           "nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "datalist", "title", "noembed", "noframes", "xmp"}
ROLES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "outbrain", "taboola",
         "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pager", "pagination", "toc", "skip", "header", "masthead", "topbar", "footer",
         "contentinfo", "copyright", "colophon", "sidebar", "aside", "complementary", "widget", "widgets", "related", "recommended", "popular", "trending", "more",
         "comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "alert",
         "popup", "modal", "overlay", "dialog", "newsletter", "subscribe", "subscription", "signup", "login", "search", "searchbox", "form", "share", "sharing",
         "social", "toolbar", "tags", "hidden"}
ROLE_STARTS = ("advert", "comment", "sidebar", "cookie", "newsletter", "breadcrumb", "sponsor", "footer", "navbar", "subscri")
ROLE_ENDS = ("nav", "menu", "footer", "sidebar", "advert", "comments")
ARTICLE = {"article", "main"}
#: Names that ordinary parts of an article have too: inside one they only count for texts that the host's template has.
DOUBTFUL = {"discussion", "more", "form", "search"}
#: An article element is a comment or a card for another article if a class starts with one of these and none with the others.
CARDS = {"comment", "comments", "reply", "related", "recommended", "promo", "ad", "advert", "sponsored"}
POSTS = {"post", "entry", "story", "content", "main", "hentry", "article"}


@functools.lru_cache(4096)
def marks(name: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """(step of the path, whether the element is no part of an article, whether only for being a header, whether it says
    it is the article, whether only by doubtful names). Names are taken apart at hyphens, underscores and inner capitals."""
    names = ["".join(x or "" for x in m.groups()) for m in NAMES.finditer(attributes)] if attributes else []
    words = {w.lower() for n in names for w in WORD.findall(n)}
    starts = {w[0].lower() for n in names for token in n.split() if (w := WORD.findall(token))}
    card = bool(starts & CARDS) and not starts & POSTS
    says = (name in ARTICLE or (name in SECTIONS and bool(words & ARTICLE))) and not card
    roles = {w for w in words if w in ROLES or w.startswith(ROLE_STARTS) or w.endswith(ROLE_ENDS)} if not says and name not in ("html", "body") else set()
    hidden = bool(attributes and HIDDEN.search(attributes))
    header = not hidden and (roles <= {"header"} if name == "header" else roles == {"header"} and name not in NO_TEXT)
    doubt = bool(roles) and roles <= DOUBTFUL and name not in NO_TEXT and not hidden
    return f">{name}" + "".join(f".{w}" for w in sorted(words)), name in NO_TEXT or bool(roles) or hidden, header, says, doubt


class Element:
    """An open element: its name and place in the tree."""

    __slots__ = ("name", "path", "dead", "article", "doubt", "inline")

    def __init__(self, name: str, attributes: str, above: Element | None) -> None:
        if attributes and not MARKED.search(attributes):
            attributes = ""
        step, dead, header, says, doubt = marks(name, attributes)
        self.name = name
        self.inline = name in INLINE
        if above is None:
            self.path, self.dead, self.article, self.doubt = step, dead, says, False
        else:
            self.path = above.path + step
            self.doubt = above.doubt or doubt and above.article
            self.dead = above.dead or dead and not ((header or doubt) and above.article)
            self.article = above.article or says


def blocks(page: str) -> Iterator[tuple[str, str, bool, int]]:
    """A page's tokens in order: (path, text, in a part that is no article, in an element that says it is the article: 2, or
    1 if a doubtful name inside it says otherwise).

    Start tags come with an empty text, blocks of text with the path of the innermost element that is not inline. Broken
    markup is read as browsers do in the common cases: omitted end tags, stray end tags, a page that breaks off.
    """
    stack: list[Element] = []
    text: list[str] = []
    home: Element | None = None
    at, n = 0, len(page)

    def block() -> Element | None:
        return next((e for e in reversed(stack) if not e.inline), None)

    def close() -> tuple[str, str, bool, int] | None:
        """The block of text that ends here."""
        nonlocal home
        joined = "".join(text)
        if "&" in joined:
            joined = html.unescape(joined)
        joined = " ".join(joined.split())
        text.clear()
        where, home = home, None
        if joined:
            return (where.path if where else ""), joined, bool(where and where.dead), bool(where and where.article) * (1 if where and where.doubt else 2)
        return None

    def add(piece: str) -> None:
        nonlocal home
        if not stack or not stack[-1].dead:
            home = home or block()
            text.append(piece)

    while at < n:
        less = page.find("<", at)
        if less < 0:
            add(page[at:])
            break
        if less > at:
            add(page[at:less])
        m = TOKEN.match(page, less)
        if m is None:
            add("<")
            at = less + 1
            continue
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):  # an end tag closes what stands open inside its element; a stray one says nothing
            if name == "br":
                add(" ")
                continue
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if k is None or (name not in TABLES and any(e.name in ("td", "th") for e in stack[k:])):
                continue
            if name not in INLINE or not all(e.inline for e in stack[k:]):
                if name in INLINE:  # a block stands open inside: only the inline element itself ends
                    del stack[k]
                    continue
                if text and (done := close()):
                    yield done
            del stack[k:]
            continue
        if name not in INLINE:
            if text and (done := close()):
                yield done
            if name in ENDS_P:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == "p" or stack[i].name in SECTIONS), None)
                if k is not None and stack[k].name == "p":
                    del stack[k:]
                else:  # inline elements left open by a paragraph don't reach into the next block's path
                    while stack and stack[-1].inline:
                        stack.pop()
            for other in CLOSES.get(name, ()):
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == other or stack[i].name in ("ul", "ol", "dl", "table", "select")), None)
                if k is not None and stack[k].name == other:
                    del stack[k:]
        elif name in ("br", "img", "wbr"):
            if name == "br":
                add(" ")
            continue
        e = Element(name, m.group(3) or "", stack[-1] if stack else None)
        if name not in INLINE:
            yield e.path, "", e.dead, e.article
        if name in VOID or (m.group(3) or "").endswith("/") and name not in SECTIONS | {"p"}:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(e)
    if text and (done := close()):
        yield done


def token_id(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") - (1 << 63)


def host_of_url() -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"://([^/?#]*)", 1))


def occurrences(pages: DataFrame) -> DataFrame:
    """host, page (a number of the page), token, kind, times, chars: each page's distinct tokens and how often it has each.

    Tokens are start tags by their place in the tree and blocks of text by place and text, so equal tags in other places
    are other tokens.
    """
    names = ["host", "page", "token", "path", "is_text", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in names}
            for host, page, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), binary_texts(b.column(2))):
                seen: dict[tuple[int, int, bool], int] = {}
                for path, text, dead, _ in blocks(raw.decode("utf-8", "replace")):
                    if text and dead:
                        continue
                    key = (token_id(path, text), token_id(path, ""), bool(text))
                    seen[key] = seen.get(key, 0) + 1
                for (token, path, is_text), n in seen.items():
                    for k, v in zip(names, (host, page, token, path, is_text, n)):
                        out[k].append(v)
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, types)], names=names)

    python_tasks(pages.sparkSession)
    return pages.select(host_of_url().alias("host"), F.xxhash64("url", "page_id", "html").alias("page"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")) \
        .mapInArrow(run, "host string, page long, token long, path long, is_text boolean, times long")


def templates(pages: DataFrame) -> DataFrame:
    """host, text_tokens, slots: the host's template.

    Occurrence vectors (times a token stands in each page) are compared by their page count, sum and a sum of hashes over
    (page, times), all gathered by partial sums, so no vector is ever held. Tokens with one vector form a class. A class
    is valid if it is frequent and large. Classes are not ordered or nested: text_tokens are the texts of valid classes on
    TEXT_SHARE of the host's pages, slots are the start tags of valid classes, as a flat set of places. A layout that fewer
    than MIN_SHARE of a host's pages have gives no class, and its unmarked menus and notices are not known as template.
    """
    each = occurrences(pages)
    n_pages = pages.groupBy(host_of_url().alias("host")).agg(F.count(F.lit(1)).alias("pages"))
    vector = each.groupBy("host", "token", "path", "is_text").agg(
        F.count(F.lit(1)).alias("in_pages"), F.sum("times").alias("total"),
        F.sum(F.xxhash64("page", "times").cast("decimal(20,0)")).alias("mark")).join(n_pages, "host")
    same = Window.partitionBy("host", "in_pages", "total", "mark")
    classed = vector.where((F.col("in_pages") >= MIN_PAGES) & (F.col("in_pages") >= MIN_SHARE * F.col("pages"))) \
        .withColumn("members", F.count(F.lit(1)).over(same))
    valid = (F.col("members") >= MIN_TOKENS) | (F.col("in_pages") == F.col("pages"))
    fixed = F.col("is_text") & (F.col("in_pages") >= TEXT_SHARE * F.col("pages")) & (F.col("total") == F.col("in_pages"))
    return classed.where(valid).groupBy("host").agg(
        F.collect_set(F.when(fixed, F.col("token"))).alias("text_tokens"),
        F.collect_set(F.when(~F.col("is_text"), F.col("token"))).alias("slots"))


def main_text(page: str, text_tokens: set[int], slots: set[int]) -> str:
    """The blocks of the article, one a line.

    Blocks in parts that are marked as something else go. If an element says it is the article, its blocks are the text,
    all of them: what near copies on one host share is no template. Names that parts of an article may have as well (a
    discussion, a table form) drop only what the host's template has. Else texts of the template go, and the text is the slot of the template with the most text of its own: places inside a
    template token, among them the blocks' innermost one that holds at least half of the page's remaining text, and a heading
    right before it.
    """
    found = [(path, text, article) for path, text, dead, article in blocks(page) if text and not dead]
    if any(a for *_, a in found):
        found = [f for f in found if f[2]]
    rest = [f for f in found if f[2] == 2 or token_id(f[0], f[1]) not in text_tokens]
    # on a page that shares all its texts with its host's pages nothing would be left: then they are its article
    found = rest or found
    if found and not found[0][2]:
        size: dict[str, int] = {}
        for path, text, _ in found:
            parts = path.split(">")
            for k in range(2, len(parts) + 1):
                place = ">".join(parts[:k])
                size[place] = size.get(place, 0) + len(text)
        total = sum(len(f[1]) for f in found)
        inside = [p for p in size if 2 * size[p] >= total and (not slots or token_id(p, "") in slots)]
        best = max(inside, key=lambda p: (p.count(">"), size[p]), default="")
        if best.rsplit(">", 1)[-1].split(".")[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td"):
            best = best.rsplit(">", 1)[0]
        kept = [i for i, f in enumerate(found) if f[0] == best or f[0].startswith(best + ">")] if best else []
        if kept and kept[0] and HEADING.search(found[kept[0] - 1][0]):  # a heading right before the text is its title
            kept.insert(0, kept[0] - 1)
        found = [found[i] for i in kept] or found
    return "\n".join(f[1] for f in found)


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars (code points).

    A null or empty html gives an empty text. The host is what stands between :// and the next of / ? #; pages without
    one share the host ''. Hosts with few pages have no template: their pages are read by their markup alone. Character
    references are decoded, white space inside a block becomes one space. Repeated rows stay. Empty input gives an empty
    result. Only page_id, url and html are read. Templates hold a bounded number of tokens a host and join by host;
    Spark broadcasts them only if their table is measured small, else pages are shuffled by host.
    """
    by_host = materialize(templates(pages), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set[int], set[int]]] = {}
        for b in batches:
            texts = []
            for host, raw, tokens, slots in zip(b.column(2).to_pylist(), binary_texts(b.column(3)), b.column(4), b.column(5)):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = (set(tokens.as_py() or ()), set(slots.as_py() or ()))
                texts.append(main_text(raw.decode("utf-8", "replace"), *known[host]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of_url().alias("host"), F.col("html").cast("string").alias("html"))
    return rows.join(by_host, "host", "left").select("page_id", "url", "host", "html", "text_tokens", "slots") \
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
