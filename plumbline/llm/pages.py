"""Main text of web pages: site templates counted by host and removed, then boilerplate elements, then blocks of text."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, free_name, materialise

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp".split())
#: Elements that end an open paragraph and hold blocks of their own.
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody thead tfoot tr caption ul".split()
)
#: What a new element closes: its siblings, up to the element that holds them.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
_DROP_TAGS = frozenset("nav footer aside form script style noscript template iframe svg math canvas object button select textarea dialog menu search head title".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
_DROP_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    notices popup modal overlay newsletter subscribe subscription signup sidebar nav navbar navigation menu menus breadcrumb
    breadcrumbs header masthead footer comment comments disqus respond replies share sharing social related recommended
    recommendations widget widgets pagination pager toolbar login search skip""".split()
)
_MAIN_NAMES = frozenset("content main post entry article story body-text article-body post-content entry-content".split())
_CONTAINERS = frozenset("div section nav aside header footer ul ol dl table form menu details fieldset center search dialog".split())
#: Inside an article: blocks too, but not its lines (paragraphs, headings, items, rows).
_COUNTED = _CONTAINERS | frozenset("address article blockquote figcaption figure hr legend pre summary".split())
_PART = re.compile(r"[A-Za-z]+")


#: Of names made of several words, these at either end say enough by themselves inside an article.
_SURE_NAMES = frozenset("advert adverts advertisement advertising sponsored cookie cookies gdpr newsletter disqus breadcrumb breadcrumbs comments ads".split())


class Node:
    __slots__ = ("attributes", "children", "hash", "parent", "size", "tag")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        #: Characters of text outside dropped elements, and the subtree's hash: see measured().
        self.size, self.hash = 0, 0

    def get(self, name: str) -> str | None:
        """An attribute's value; empty if it has none; None if it is not there."""
        if name not in self.attributes.lower():
            return None
        for k, v in _ATTRIBUTE.findall(self.attributes):
            if k.lower() == name:
                return html.unescape(v[1:-1] if v[:1] in ("'", '"') else v)
        return None

    def names(self) -> list[str]:
        """Class names and id, in lower case."""
        return f"{self.get('class') or ''} {self.get('id') or ''}".lower().split() if self.attributes else []

    def elements(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))


def parse(source: str) -> Node:
    """The element tree of a page. Open paragraphs, list items and cells end where HTML says; strange end tags are ignored."""
    top = Node("#page", "", None)
    node, at, lower = top, 0, None
    opened: Counter[str] = Counter()

    def leave(last: Node) -> Node:
        """Closes the open elements up to and with last."""
        x = node
        while x is not last:
            opened[x.tag] -= 1
            x = x.parent
        opened[last.tag] -= 1
        return last.parent

    while True:
        m = _TAG.search(source, at)
        if m is None:
            break
        if m.start() > at:
            node.children.append(source[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if opened[name]:
                found = node
                while found.tag != name:
                    found = found.parent
                node = leave(found)
            continue
        if name in _BLOCK and opened["p"]:
            found = node
            while found is not top and found.tag not in ("p", "table", "button", "td", "th", "li", "div", "article", "section", "body"):
                found = found.parent
            if found.tag == "p":
                node = leave(found)
        if name in _CLOSES and any(opened[x] for x in _CLOSES[name][0]):
            ends, limit = _CLOSES[name]
            found, last = node, None
            while found is not top and found.tag not in limit:
                if found.tag in ends:
                    last = found
                found = found.parent
            if last is not None:
                node = leave(last)
        child = Node(name, m[3], node)
        node.children.append(child)
        if name in _VOID or m[3].endswith("/") and name not in _BLOCK and name not in _RAW:
            continue
        if name in _RAW:
            lower = source.lower() if lower is None else lower
            end = lower.find(f"</{name}", at) if len(lower) == len(source) else -1
            if end < 0:
                close = re.compile(f"</{name}", re.I).search(source, at)
                end = close.start() if close else len(source)
            child.children.append(source[at:end])
            after = source.find(">", end)
            at = len(source) if after < 0 else after + 1
            continue
        node = child
        opened[name] += 1
    node.children.append(source[at:])
    return measured(top)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def measured(top: Node) -> Node:
    """Sets sizes and hashes of all elements, children first.

    A hash is signed, of 64 bits, and made of tag, class and id, texts with single spaces, and the children's hashes in order.
    """
    for node in reversed(list(top.elements())):
        h = xxhash.xxh64(f"{node.tag}\x04{' '.join(node.names())}\x04".encode("utf-8", "surrogatepass"))
        for c in node.children:
            if isinstance(c, str):
                node.size += len(c.strip())
                h.update(" ".join(c.split()).encode("utf-8", "surrogatepass") + b"\x03")
            else:
                node.size += 0 if c.tag in _DROP_TAGS else c.size
                h.update(b"\x01" + c.hash.to_bytes(8, "little", signed=True))
        node.hash = _signed(h.intdigest())
    return top


def signature(node: Node) -> int:
    """A hash of an element's tag, class and id alone: the slot that it fills on its site's pages."""
    return _signed(xxhash.xxh64_intdigest(f"slot\x04{node.tag}\x04{' '.join(node.names())}".encode("utf-8", "surrogatepass")))


def _suspect(node: Node) -> bool:
    """Whether a name of several words begins or ends like that of a boilerplate element: inside an article, that
    alone (as of related-work or search-results) doesn't tell, so the slot must recur on the host's pages."""
    if node.tag in ("html", "body", "main"):
        return False
    for name in node.names():
        parts = _PART.findall(name)
        if len(parts) > 1 and (parts[0] in _DROP_NAMES or parts[-1] in _DROP_NAMES) and parts[-1] != "header":
            return True
    return False


def _dropped(node: Node, inside: bool) -> bool:
    """Whether an element is no part of an article by its name, role, class or id; inside: it stands in the article."""
    tag = node.tag
    if tag in _DROP_TAGS or (tag == "header" and not inside):
        return True
    if not node.attributes or tag in ("html", "body", "main"):
        return False
    if node.get("hidden") is not None or (node.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", (node.get("style") or "").lower()):
        return True
    role = (node.get("role") or "").lower()
    if role in _DROP_ROLES:
        return not (inside and role == "banner")
    for name in node.names():
        parts = _PART.findall(name)
        if not parts or (inside and parts[-1] == "header"):
            continue
        ends = {parts[0], parts[-1]}
        if ends <= _DROP_NAMES or ends & (_SURE_NAMES if inside else _DROP_NAMES):
            return True
    return False


def _size(node: Node) -> int:
    return node.size


def _kept(node: Node, wanted) -> list[Node]:
    """Outermost elements that are wanted and stand in no dropped one."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if x is not node and _dropped(x, False):
            continue
        if wanted(x):
            out.append(x)
            continue
        stack.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return out


def article_of(top: Node) -> Node:
    """The element that holds the article: the largest <article>, the main element where that has much more, an element named for content, or all."""
    articles = _kept(top, lambda x: x.tag == "article")
    mains = _kept(top, lambda x: x.tag == "main" or (x.get("role") or "").lower() == "main")
    best = max(articles, key=_size, default=None)
    main = max(mains, key=_size, default=None)
    if main is not None:
        inner = max(_kept(main, lambda x: x.tag == "article"), key=_size, default=None)
        return inner if inner is not None and 2 * _size(inner) >= _size(main) else main
    if best is not None:
        return best
    named = _kept(top, lambda x: x.tag in ("div", "section", "td") and any(n in _MAIN_NAMES for n in x.names()))
    found = max(named, key=_size, default=None)
    return found if found is not None and 3 * _size(found) >= _size(top) else top


def template_parts(top: Node, root: Node) -> list[tuple[Node, bool]]:
    """Elements that may be of a site's template, and whether they are inside the article: containers beside the article's
    ancestors, blocks of the article that hold less than half of it (any, if all of the page is its article), and dropped
    elements as a whole."""
    above, x = set(), root
    while x is not None:
        above.add(id(x))
        x = x.parent
    half = _size(root) / 2
    out, stack = [], [(top, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node is root
        if id(node) not in above and node.tag not in ("head", "script", "style"):
            whole = _dropped(node, inside)
            counted = node.tag in _COUNTED and (root.parent is None or _size(node) < half) if inside else node.tag in _CONTAINERS
            if whole or counted:
                out.append((node, inside))
            if whole:
                continue
        stack.extend((c, inside) for c in reversed(node.children) if not isinstance(c, str))
    return out


def suspects(root: Node) -> list[Node]:
    """Elements of an article that only a name of several words speaks against."""
    return [x for x in root.elements() if x is not root and x.attributes and _suspect(x) and not _dropped(x, True)]


def text_of(root: Node, gone: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of an article, joined by line ends; gone: identities of elements to leave out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            block = " ".join(html.unescape("".join(run)).split())
            if block:
                out.append(block)
            run.clear()

    stack: list[Node | str | None] = [root]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif id(x) in gone or (x is not root and _dropped(x, True)):
            if x.tag in _BLOCK:
                flush()
        elif x.tag in ("br", "td", "th"):
            run.append(" ")
            stack.extend(reversed(x.children))
        else:
            if x.tag in _BLOCK or x.tag == "#page":
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return "\n".join(out)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port (null or none: empty)."""
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(part)


def site_templates(parts: DataFrame, min_pages: int) -> DataFrame:
    """(host, hash) of subtrees that stand in at least min_pages different contents of a host.

    parts has a row (host, hash, content) for each distinct part of a page; content is a hash of what copies share.
    """
    seen = parts.select("host", "hash", "content").distinct()
    return seen.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "hash")


def main_text(df: DataFrame, *, url: str = "url", source: str = "html", out: str = "text", min_pages: int = 5) -> DataFrame:
    """Replaces the source of pages by their main text (empty if there is none).

    First each page's containers outside its article's own ancestors are hashed as subtrees and counted by host;
    subtrees in min_pages different pages of the host (site_templates) go. Copies of a page count once, and for blocks
    inside an article pages with the same article do. Paragraphs, headings, items and rows of an article are never taken
    for templates, nor are blocks with half of its text. Elements of an article whose class or id of several words only begins
    or ends like a boilerplate name (related-work, ad-slot) go where their tag, class and id recur in min_pages different
    articles of the host, and stay elsewhere. Then menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go,
    by element, role, class or id. Null sources count as empty; null URLs share an empty host. Repeated rows and rows
    with equal keys are kept. Other columns stay; one that had the name out is replaced.
    """
    df = df if out in (url, source) else df.drop(out)
    others = [f.name for f in df.schema if f.name != source]
    page = F.xxhash64(F.col(url), F.col(source))
    wide = df.select(page.alias("page"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(source), F.lit("")).alias("_source"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "_source"):
                rows: list[tuple] = []
                for host, key, own in zip(part.column("host").to_pylist(), part.column("page").to_pylist(), part.column("_source").to_pylist(), strict=True):
                    top = parse(own)
                    root = article_of(top)
                    whole = xxhash.xxh64_intdigest(own.encode("utf-8", "surrogatepass")) >> 1
                    found = {(x.hash, root.hash if inside else whole) for x, inside in template_parts(top, root)}
                    found |= {(signature(x), root.hash) for x in suspects(root)}
                    rows += [(host, key, h, c) for h, c in found]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["host", "page", "hash", "content"])

    parts = materialise(wide.mapInArrow(hashes, "host string, page long, hash long, content long"), "page-parts")
    templates = site_templates(parts, min_pages)
    gone = parts.join(templates, ["host", "hash"]).groupBy("page").agg(F.collect_set("hash").alias("gone"))
    own, body, spot = (free_name(others, n) for n in ("page", "source", "gone"))
    gone = gone.select(F.col("page").alias(own), F.col("gone").alias(spot))
    joined = df.select(*others, F.coalesce(F.col(source), F.lit("")).alias(body), page.alias(own)).join(gone, own, "left").select(*others, body, spot)
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(out, T.StringType(), False)])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, body):
                texts = []
                for text, drop in zip(part.column(body).to_pylist(), part.column(spot).to_pylist(), strict=True):
                    top = parse(text)
                    root = article_of(top)
                    known = set(drop or ())
                    away = {id(x) for x, _ in template_parts(top, root) if x.hash in known} if known else set()
                    away |= {id(x) for x in suspects(root) if signature(x) in known} if known else set()
                    texts.append(text_of(root, away))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + [pa.array(texts, pa.string())], [*others, out])

    return joined.mapInArrow(extract, schema)
