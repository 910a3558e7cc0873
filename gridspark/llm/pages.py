"""Main text of web pages by removal of what the pages of a site share.

Each page is read into a tree.  Element subtrees are hashed and Spark counts, per host, on how many different pages each
stands; those that recur on many pages of the host are templates and deleted, besides what tags, roles and class names mark as
no text of the article.  What is left of the article, or of the body where no article is marked, is the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.session import stored

#: A subtree is a template when it stands on so many different pages of the host, or on the square root of their number if that is more.
LEAST_PAGES = 10

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes head nav header footer aside form noscript template button "
                    "select option datalist dialog menu svg canvas object audio video map input".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup msubsup "
                   "munder mover munderover semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                     "h5 h6 header hgroup hr main menu nav ol p pre section search summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"},
          "tbody": {"table"}, "option": {"select"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre li dd dt td th figcaption caption".split())
MAIN = frozenset("article main".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
# Parts of class names and ids that mark what is no text of the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu "
                  "breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices popup modal "
                  "overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies disqus related "
                  "recommended recommendations widget toolbar pagination pager search skip skiplink copyright".split())

# Marks that no wrapper of an article has, and words before a mark that say what a page has, not what a part is.
APART = frozenset("comment comments reply replies disqus related recommended recommendations".split())
MODIFIERS = frozenset("has no with without is not hide show js".split())
#: A part with a class name, id or form tag that marks it stays when it holds prose and so much of the text: it wraps the article.
WRAPPER_SHARE = 0.7
PLAIN, NAMED, APART_FROM, DROP = 0, 1, 2, 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
                    r"|<([a-zA-Z][^\s/>]*)((?:\s+|/(?!>)|[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|[\"'=])*)\s*/?(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_PARTS = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Element:
    tag: str
    attributes: str
    parent: Element | None
    children: list = field(default_factory=list)
    digest: int = 0
    mark: int = -1
    size: int = 0
    prose: bool = False


def parse(html: str) -> Element:
    """The tree of a page; what is not closed closes with its parent, as browsers have it for paragraphs and list items."""
    root = now = Element("#root", "", None)
    at, n, low = 0, len(html), None
    open_tags: Counter = Counter()

    def leave(to: Element, now: Element) -> Element:
        while now is not to:
            open_tags[now.tag] -= 1
            now = now.parent
        return to

    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            break
        if m.start() > at:
            now.children.append(html[at:m.start()])
        at = m.end()
        if close := m.group(1):
            close = close.lower()
            if open_tags[close]:
                up = now
                while up.tag != close:
                    up = up.parent
                now = leave(up.parent, now)
            elif close == "p":
                now.children.append(Element("p", "", now))
        elif tag := m.group(2):
            tag = tag.lower()
            if tag in CLOSES_P and open_tags["p"]:
                now = leave(_closed(now, {"p"}, {"button", "table", "td", "th", "caption"}), now)
            if tag in SIBLINGS and any(open_tags[x] for x in SIBLINGS[tag]):
                now = leave(_closed(now, SIBLINGS[tag], SCOPES[tag]), now)
            new = Element(tag, m.group(3) or "", now)
            now.children.append(new)
            if tag in RAW:
                low = low if low is not None else html.lower()
                end = low.find(f"</{tag}", at) if tag != "plaintext" else -1
                end = n if end < 0 else end
                new.children.append(html[at:end])
                close_at = low.find(">", end)
                at = n if close_at < 0 else close_at + 1
            elif tag not in VOID:
                now = new
                open_tags[tag] += 1
    if at < n:
        now.children.append(html[at:])
    return root


def _closed(now: Element, tags: set[str], scope: set[str]) -> Element:
    """The place above the topmost open element among ``tags`` below the nearest of ``scope``."""
    up, found = now, None
    while up.parent is not None and up.tag not in scope:
        if up.tag in tags:
            found = up
        up = up.parent
    return found.parent if found is not None else now


def _attributes(e: Element) -> dict[str, str]:
    return {m[0].lower(): unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(e.attributes)} if e.attributes.strip(" /\n\t\r") else {}


def mark_of(e: Element) -> int:
    """Whether an element is no text of the article: by its tag, role or style, as a part apart from it, or by its name only."""
    if e.mark < 0:
        e.mark = _mark(e)
    return e.mark


def _mark(e: Element) -> int:
    if e.tag in DROPPED and e.tag != "form":
        return DROP
    of = _attributes(e)
    if of:
        role = of.get("role", "").lower()
        if (role in DROPPED_ROLES and role != "form") or "hidden" in of or of.get("aria-hidden", "").lower() == "true":
            return DROP
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", of.get("style", ""), re.I):
            return DROP
    if e.tag in ("body", "html"):
        return PLAIN
    marks = {m for a in ("class", "id") for name in of.get(a, "").split() for m in _marks(name)}
    if marks & APART:
        return APART_FROM
    named = marks and e.tag not in MAIN
    return NAMED if named or e.tag == "form" or of.get("role", "").lower() == "form" else PLAIN


def _marks(name: str) -> set[str]:
    """The marks in one class name or id; what follows a modifier says how the page is laid out."""
    parts = _PARTS.findall(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower())
    return {x for k, x in enumerate(parts) if x in MARKS and not (k and parts[k - 1] in MODIFIERS)}


def weigh(root: Element) -> None:
    """Note for every element how many characters of text stand in it that are not dropped, and whether prose does."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in x.children if not isinstance(c, str) and mark_of(c) < APART_FROM)
    for x in reversed(order):
        x.size, x.prose = 0, x.tag in PROSE
        for c in x.children:
            if isinstance(c, str):
                x.size += len(unescape(c).strip())
            elif mark_of(c) < APART_FROM:
                x.size += c.size
                x.prose |= c.prose


def left_out(e: Element, base: Element) -> bool:
    """Whether a part of ``base`` is no text of the article; a name does not count where the part is most of it."""
    mark = mark_of(e)
    return mark >= APART_FROM or (mark == NAMED and not (e.prose and e.size >= WRAPPER_SHARE * base.size))


def _is_main(e: Element) -> bool:
    return e.tag in MAIN or (bool(e.attributes) and _attributes(e).get("role", "").lower() in ("main", "article"))


def digest(e: Element) -> int:
    """Hashes of all subtrees, over tags, attributes and text, kept on the elements; returns that of ``e``."""
    import xxhash

    order, stack = [], [e]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in x.children if not isinstance(c, str))
    for x in reversed(order):
        parts = [x.tag, " ".join(x.attributes.split())]
        parts += [" ".join(c.split()) if isinstance(c, str) else f"\1{c.digest}" for c in x.children]
        x.digest = xxhash.xxh3_64_intdigest("\0".join(parts)) - 2**63
    return e.digest


def _outermost(root: Element, wanted, through) -> list[Element]:
    """The outermost elements that are wanted, in page order, below elements that may be gone through."""
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if x is not root and not through(x):
            continue
        if x is not root and wanted(x):
            found.append(x)
        else:
            stack.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return found


def main_part(root: Element) -> list[Element]:
    """The outermost articles, or else the first main element, or else the whole page; ``root`` must be weighed.

    Articles below parts that their names mark are taken where those outside hold less than half as much text: then the names
    belong to wrappers.
    """
    for wanted, most in ((lambda x: x.tag == "article", None), (_is_main, 1)):
        inside = _outermost(root, wanted, lambda x: mark_of(x) < APART_FROM)[:most]
        plain = _outermost(root, wanted, lambda x: mark_of(x) == PLAIN or wanted(x) and mark_of(x) < APART_FROM)[:most]
        found = plain if 2 * sum(x.size for x in plain) >= sum(x.size for x in inside) and plain else inside
        if found:
            return found
    return [root]


def _with_text(root: Element) -> list[Element]:
    """The elements that hold text and are not left out, parents first."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(c for c in x.children if not isinstance(c, str) and c.size and not left_out(c, root))
    return order


def candidates(root: Element) -> Iterator[int]:
    """Hashes of the subtrees that may be templates: blocks that hold text, but inside an article only those without prose.

    ``root`` must be weighed.  Paragraphs of an article may recur because the article does; what recurs beside them is furniture.  Words of a sentence and
    headings recur because the language does, so that inline elements and headings go only with a block that holds them.
    """
    mains = {id(x) for x in main_part(root) if x is not root}
    inside: set[int] = set()
    for x in _with_text(root):
        if id(x) in mains or (x.parent is not None and id(x.parent) in inside):
            inside.add(id(x))
        if x is root or not x.size or x.tag in ("html", "body") or x.tag in INLINE or x.tag in HEADINGS or id(x) in mains:
            continue
        if id(x) not in inside or not x.prose:
            yield x.digest


def _parts_text(e: Element) -> bool:
    """Whether an element that is left out still parts the text before it from the text behind it."""
    return e.tag not in INLINE and (e.tag not in DROPPED or e.tag in CLOSES_P)


def text_of(root: Element, templates: frozenset[int] | set[int]) -> str:
    """Texts of the blocks of the main part, white space made one blank, joined by a blank, also where a block is left out.

    ``root`` must be weighed.
    """
    parts: list[str] = []
    mains = main_part(root)
    keep = {id(m) for m in mains}
    stack: list = list(reversed(mains))
    base = root
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(unescape(x))
            continue
        if id(x) in keep:
            base = x
        elif left_out(x, base) or x.digest in templates:
            if _parts_text(x):
                parts.append(" ")
            continue
        block = x.tag not in INLINE
        if block:
            parts.append(" ")
            stack.append(" ")
        stack.extend(reversed(x.children))
    return " ".join("".join(parts).split())


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without the port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, found, whole = [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            root = parse(html or "")
            weigh(root)
            page, of = digest(root), {None, *candidates(root)}
            hosts += [host] * len(of)
            whole += [page] * len(of)
            found += of
        yield pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "hash": pa.array(found, pa.int64()),
                                          "page": pa.array(whole, pa.int64())})


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host`` and ``hash`` of the subtrees that recur; ``pages`` has ``host`` and ``html``.

    Copies of a page count once, in the size of a host too.  The share of the pages that makes a template falls with the size of
    the host, so that a box of one section of a large site goes.  Counts are combined before they are shuffled, so a host with a
    third of all pages is no burden.
    """
    # a row per subtree, and one without a hash that counts the pages
    seen = pages.select("host", "html").mapInArrow(_hashes, "host string, hash long, page long")
    once = seen.select("host", "hash", "page").distinct()
    counts = once.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("hash").isNull() | (F.col("n") >= least_pages))
    # stored, so that the pages are parsed once for both sides
    counts = stored(counts, "page-counts")
    sizes = counts.where("hash IS NULL").select("host", F.col("n").alias("pages"))
    return counts.where("hash IS NOT NULL").join(sizes, "host").where(F.col("n") >= F.sqrt("pages")).select("host", "hash")


def extract(df: DataFrame, html: str = "html", url: str = "url", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry`` with ``text``, the main text of each page, and ``n_chars``.

    A null or empty page has an empty text.  Rows are pages of their own, whatever their ids; a null URL is the empty host.
    Most sites have few templates; their lists are stored, so that Spark knows whether to send them to the pages.
    """
    picked = df.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    # a list per host, no longer than the elements of its pages over the least number of pages
    listed = stored(templates(picked).groupBy("host").agg(F.sort_array(F.collect_set("hash")).alias("templates")), "page-templates")
    met = picked.join(listed, "host", "left").select(*(f"_c{i}" for i in range(len(carry))), "html", "templates")
    kept = [T.StructField(f"_c{i}", df.schema[c].dataType) for i, c in enumerate(carry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, of in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist()):
                root = parse(page or "")
                weigh(root)
                if of:
                    digest(root)
                texts.append(text_of(root, frozenset(of or ())))
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in kept} | {"text": pa.array(texts, pa.string())})

    out = met.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())]))
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), "text", F.length("text").cast("bigint").alias("n_chars"))
