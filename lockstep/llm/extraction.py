"""Operator 5, HTML extraction with wrappers inferred per host.

A page is read into a stream of block tags with text slots between them, nested by its tags; inline tags vanish, elements that are never article text
(menus, forms, adverts, comments, ...) stay as closed leaves: by tag, or as containers by whole words of class and role; an id counts if it
names reader comments, others on a div outside articles alone. Headings, paragraphs and other text blocks are never closed by words. A wrapper is a union-free regular expression over such streams. Pages of a
host are aligned one after the other: a sibling that only one side has becomes optional, runs of like siblings or like groups of up to four
become one repeated group, and texts that differ become slots. The wrapper's counts then show the region that holds the varying text, and
which texts nine tenths of the host's pages have alike; every page's article is read from that region without those slots (none is left out
inside an article or main element, nor on hosts of fewer than ``FEW_PAGES`` pages, nor where a page has nothing else, as where most are copies). A page without the region is read by a wrapper of its own.

Bounds. Nesting is kept to ``DEPTH`` levels, as browsers keep it to some hundred: what is deeper belongs to the element at that level, in order.
A wrapper has at most ``MOST_CHILDREN`` siblings an element and ``MOST_NODES`` nodes: the rarest others become one remainder that keeps their
weight; a slot counts the ``MOST_TEXTS`` texts that most pages have there (the others in turn give way, so a text on over half of the pages is never
lost). Wrappers are merged within each batch of the scan, then in rounds: each round deals a host's wrappers to so many salts that a task gets about
``WIDTH`` of them, until one is left. So a host with a third of all pages costs each task some ``WIDTH`` small trees. Region paths are
broadcast up to ``BROADCAST_HOSTS`` hosts and joined by a shuffle beyond.

Defined results: null html is empty and gives empty text; a null URL belongs to the host without name; unclosed and wrongly nested tags are
closed as browsers do for blocks; a cut page is read to its end; repeated rows are rows; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.llm.encoding import slices
from lockstep.llm.urls import url_host
from lockstep.sources.shared import dropped, written

BROADCAST_HOSTS, DEPTH, MOST_CHILDREN, MOST_NODES, MOST_TEXTS, WIDTH, FEW_PAGES = 50_000, 100, 64, 2000, 16, 64, 5
_REST = "~"  # the remainder of an element's rare children
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "svg", "annotation", "annotation-xml"}
_INLINE = set("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr
    math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics""".split())
_VOID = {"area", "base", "col", "embed", "hr", "link", "meta", "param", "track", "input"}
_CLOSED_BY_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dt", "dd", "figcaption", "#"}
#: Elements, and words in class or role of containers, that are never article text; and ids of reader comments.
_NEVER = set("nav footer aside form head menu dialog button select fieldset object canvas audio video".split())
_WORDS = set(
    """ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs
    sidebar aside complementary footer contentinfo masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall share sharing social
    related recommended recommendations pagination pager login signup signin search toolbar widget widgets disqus comment comments commentlist replies respond skip""".split()
)
_COMMENT_IDS = {"comment", "comments", "disqus", "disqusthread", "respond"}
_CONTAINERS = {"div", "section", "header", "ul", "ol", "dl", "table", "figure", "ins", "details"}
_KEPT_WORDS = {"content", "main", "wrapper", "container", "with", "no", "has", "body"}


class Node:
    """An element, a group of siblings or a text slot (label ``#``); ``many`` is one of ``1 ? + *``. A slot of a page has its text,
    one of a wrapper the number of pages by checksum of text (and -1 if some have given way)."""

    __slots__ = ("label", "many", "pages", "chars", "text", "children")

    def __init__(self, label: str, many: str = "1", pages: int = 1, chars: int = 0, text: object = None, children: list[Node] | None = None):
        self.label, self.many, self.pages, self.chars, self.text, self.children = label, many, pages, chars, text, children or []

    def packed(self) -> list:
        texts = sorted(self.text.items()) if isinstance(self.text, dict) else None
        return [self.label, self.many, self.pages, self.chars, texts, [c.packed() for c in self.children]]

    @staticmethod
    def unpacked(x: list) -> Node:
        return Node(*x[:4], None if x[4] is None else dict(map(tuple, x[4])), [Node.unpacked(c) for c in x[5]])


def _label(tag: str, attributes: str, inside: bool) -> str:
    """Tag and first class without digits; ``tag!`` if it is never article text. ``inside``: under article or main."""
    if tag in _NEVER or tag == "header" and not inside:
        return tag + "!"
    if not attributes.strip() or tag in ("html", "body"):
        return tag
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if tag in _CONTAINERS:
        words = set(re.findall(r"[a-z]+", f"{found.get('class', '')} {found.get('role', '')}".lower()))
        name = re.sub(r"[^a-z]+", "", found.get("id", "").lower())
        # ids are often made from headings, so others than those of comments count for divs outside articles only
        if words & _WORDS and not words & _KEPT_WORDS or name in _COMMENT_IDS or tag == "div" and not inside and name in _WORDS:
            return tag + "!"
    if tag not in ("main", "article"):
        if found.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|$)", re.sub(r"\"[^\"]*\"|'[^']*'", '""', attributes)) or "display:none" in found.get("style", "").replace(" ", ""):
            return tag + "!"
    first = re.sub(r"[^a-z]+", "-", found.get("class", "").split(" ")[0].lower()).strip("-")
    return f"{tag}.{first}" if first else tag


def read_page(page: str) -> Node:
    """The tree of a page; text slots hold their text, white space folded."""
    root = Node("")
    stack, tags, run = [root], [""], []

    def end_run() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text and not stack[-1].label.endswith("!"):
                stack[-1].children.append(Node("#", chars=len(text), text=text))

    def close(k: int) -> None:
        end_run()
        del stack[k:], tags[k:]

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            run.append(page[at:])
            break
        if m.start() > at:
            run.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else size
            continue
        if tag in _INLINE:
            if tag == "br":
                run.append(" ")
            continue
        if closing:
            if tag in tags:
                close(len(tags) - 1 - tags[::-1].index(tag))
            else:
                end_run()
            continue
        if tags[-1] == "p":
            close(len(tags) - 1)
        if tag in _CLOSED_BY_LIKE:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] in _CLOSED_BY_LIKE[tag]:
                    close(k)
                    break
                if tags[k] in ("ul", "ol", "dl", "table", "select"):
                    break
        end_run()
        if tag in _VOID:
            continue
        if stack[-1].label.endswith("!"):
            node = stack[-1]
        elif len(stack) > DEPTH and not _label(tag, attributes, True).endswith("!"):
            node = stack[-1]
        else:
            node = Node(_label(tag, attributes, "article" in tags or "main" in tags))
            stack[-1].children.append(node)
        stack.append(node)
        tags.append(tag)
    close(1)
    return root


def _shape(node: Node) -> tuple:
    """What siblings must share to be taken for a repetition: the label, and for an element that holds others their labels."""
    return node.label if node.label.split(".")[0] in _TEXT_BLOCKS else (node.label, *sorted({c.label for c in node.children}))


def fold(children: list[Node]) -> list[Node]:
    """Siblings with runs of like ones, then of like groups of two to four, made repeated."""
    for width in range(1, 5):
        out: list[Node] = []
        at = 0
        while at < len(children):
            names = [c.label for c in children[at : at + width]]
            shapes = [_shape(c) for c in children[at : at + width]]
            n = 1
            while len(names) == width and [_shape(c) for c in children[at + n * width : at + (n + 1) * width]] == shapes:
                n += 1
            if n == 1:
                out.append(children[at])
                at += 1
                continue
            groups = [children[at + k * width : at + (k + 1) * width] for k in range(n)]
            groups = [g[0] if width == 1 else Node("(" + " ".join(names) + ")", children=g) for g in groups]
            whole = reduce(lambda a, b: merge(a, b, same_page=True), groups)
            whole.many = "*" if all(g.many in "?*" for g in groups) else "+"
            out.append(whole)
            at += n * width
        children = out
    return children


def checksum(text: str) -> int:
    return crc32(text.encode("utf-8", "replace"))


def skeleton(node: Node) -> Node:
    """A page's tree as a wrapper: texts as checksums, repeats folded."""
    if node.label == "#":
        return Node("#", chars=node.chars, text={checksum(node.text): 1})
    return Node(node.label, children=_few(fold([skeleton(c) for c in node.children])))


def _few(children: list[Node]) -> list[Node]:
    """At most ``MOST_CHILDREN`` siblings: of more, those that the most pages have, and one remainder."""
    if len(children) <= MOST_CHILDREN:
        return children
    ranked = sorted(range(len(children)), key=lambda i: (children[i].label == _REST, -children[i].pages, i))
    kept = set(ranked[: MOST_CHILDREN - 1])
    rest = [c for i, c in enumerate(children) if i not in kept]
    return [*(c for i, c in enumerate(children) if i in kept), _remainder(rest)]


def _remainder(nodes: list[Node]) -> Node:
    return Node(_REST, "*", max(n.pages for n in nodes), sum(map(_chars, nodes)))


def _chars(node: Node) -> int:
    return 0 if node.label.endswith("!") else node.chars + sum(map(_chars, node.children))


def bounded(wrapper: Node) -> Node:
    """The wrapper with at most about ``MOST_NODES`` nodes, level by level; below, an element has its remainder alone."""
    level, left = [wrapper], MOST_NODES
    while level:
        following = []
        for node in level:
            if left < len(node.children):
                node.children = [_remainder(node.children)]
            left -= len(node.children)
            following += node.children
        level = following
    return wrapper


def _aligned(a: list[Node], b: list[Node]) -> Iterator[tuple[Node | None, Node | None]]:
    """Pairs of like siblings in order, as many as can be; others alone."""
    start = 0
    while start < min(len(a), len(b)) and a[start].label == b[start].label:
        yield a[start], b[start]
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end].label == b[-1 - end].label:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].label == y[j].label else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i].label == y[j].label:
            yield x[i], y[j]
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            yield x[i], None
            i += 1
        else:
            yield None, y[j]
            j += 1
    yield from zip(a[len(a) - end :], b[len(b) - end :], strict=True)


def merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """The wrapper of both: mismatches become optional, other texts become slots."""
    optional, repeated = a.many in "?*" or b.many in "?*", a.many in "+*" or b.many in "+*"
    many = "*" if optional and repeated else "+" if repeated else "?" if optional else "1"
    children = []
    for x, y in _aligned(a.children, b.children):
        if x and y:
            children.append(merge(x, y, same_page))
        else:
            one = x or y
            one.many = "*" if one.many in "+*" else "?"
            children.append(one)
    if same_page or len(children) > max(len(a.children), len(b.children)):
        children = fold(children)
    children = _few(children)
    return Node(a.label, many, a.pages if same_page else a.pages + b.pages, a.chars + b.chars, _counted(a.text, b.text, same_page), children)


def _counted(a: dict[int, int] | None, b: dict[int, int] | None, same_page: bool) -> dict[int, int] | None:
    """The pages of each text of a slot. Where there are too many texts all lose what the first one too many has."""
    if a is None or b is None:
        return a or b
    out = dict(a)
    for k, n in b.items():
        out[k] = max(out.get(k, 0), n) if same_page or k < 0 else out.get(k, 0) + n
    if len(out) > MOST_TEXTS + 1:
        ranked = sorted(((n, k) for k, n in out.items() if k >= 0), reverse=True)
        least = ranked[MOST_TEXTS][0]
        out = {k: n - least for n, k in ranked[:MOST_TEXTS] if n > least} | {-1: 1}
    return out


def _weight(node: Node) -> float:
    """Characters of article text under a node; text that is the same on several pages counts a tenth."""
    if node.label.endswith("!"):
        return 0.0
    own = node.chars * (1.0 if node.pages < 2 or _unlike(node) else 0.1)
    total = own + sum(map(_weight, node.children))
    return 5 * total if re.match(r"(article|main)\b", node.label) else total


def _unlike(node: Node) -> bool:
    """Whether the texts of a slot or remainder differ: one of them is on half of its pages at most."""
    return node.label == _REST or node.text is not None and any(k < 0 or 2 * n <= node.pages for k, n in node.text.items())


def _varies(node: Node) -> bool:
    """Whether a node holds text that is not closed and not the same on several pages."""
    if node.label.endswith("!"):
        return False
    return node.chars > 0 and (node.pages < 2 or _unlike(node)) or any(map(_varies, node.children))


def region(wrapper: Node) -> list[str]:
    """The labels that lead to the smallest element, not repeated, outside which no text varies. Outside an article or main that most
    pages have and that holds most of the text, other text may vary; nothing inside one is left out."""
    path, node = [], wrapper
    while not re.match(r"(article|main)\b", node.label):
        inner = [c for c in node.children if not c.label.endswith("!")]
        best = max(inner, key=_weight, default=None)
        if best is None or best.many in "+*" or best.label.split(".")[0] in _TEXT_BLOCKS:
            return path
        named = _named(best) and 2 * best.pages > wrapper.pages and _weight(best) >= 0.7 * sum(map(_weight, inner))
        if not named and any(_varies(c) for c in inner if c is not best):
            return path
        path.append(best.label)
        node = best
    return path


def _named(node: Node) -> bool:
    """Whether a node is an article or main, or holds one."""
    return bool(re.match(r"(article|main)\b", node.label)) or any(_named(c) for c in node.children if not c.label.endswith("!"))


def constants(wrapper: Node, path: list[str]) -> list[int]:
    """Checksums of the texts in the region that nine tenths of the host's pages have; none inside an article or main."""
    if wrapper.pages < FEW_PAGES or any(re.match(r"(article|main)\b", label) for label in path):
        return []
    found, waiting = set(), _reached(wrapper, path)
    while waiting:
        node = waiting.pop()
        if node.text is not None:
            found |= {k for k, n in node.text.items() if k >= 0 and 10 * n >= 9 * wrapper.pages}
        if not node.label.endswith("!") and not re.match(r"(article|main)\b", node.label):
            waiting += node.children
    return sorted(found)


def _texts(node: Node, left_out: set[int], inside: bool = False) -> Iterator[str]:
    inside = inside or bool(re.match(r"(article|main)\b", node.label))
    for c in node.children:
        if c.label == "#":
            if inside or not left_out or checksum(c.text) not in left_out:
                yield c.text
        elif not c.label.endswith("!"):
            yield from _texts(c, left_out, inside)


def article(page: str, path: list[str] | None, left_out: list[int] = ()) -> str:
    """The article's blocks, joined by an empty line."""
    root = read_page(page)
    found = _reached(root, path) if path is not None else []
    own = [t for node in found for t in _texts(node, set(left_out))] or [t for node in found for t in _texts(node, set())]
    return "\n\n".join(own if found else (t for node in _reached(root, region(skeleton(root))) for t in _texts(node, set())))


def _reached(root: Node, path: list[str]) -> list[Node]:
    """All elements that the path's labels lead to, in the page's order."""
    nodes = [root]
    for label in path:
        nodes = [c for node in nodes for c in node.children if c.label == label]
    return nodes


def _combined(rows: Iterator[tuple[str, Node]]) -> pa.RecordBatch:
    by: dict[str, Node] = {}
    for host, tree in rows:
        by[host] = bounded(merge(by[host], tree) if host in by else tree)
    return pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([json.dumps(t.packed()) for t in by.values()], pa.string())], names=["host", "wrapper"])


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON) of ``host, html``; every page is aligned."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 32 << 20):
                yield _combined((h, skeleton(read_page(x))) for h, x in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True))

    def join(part: pa.Table) -> pa.Table:
        rows = sorted(zip(part.column("host").to_pylist(), part.column("wrapper").to_pylist(), strict=True))
        return pa.Table.from_batches([_combined((h, Node.unpacked(json.loads(w))) for h, w in rows)])

    shape = "host string, wrapper string"
    parts = written(pages.select("host", "html").mapInArrow(scan, shape), "wrappers")
    salts = -(-(parts.groupBy("host").count().agg(F.max("count")).first()[0] or 1) // WIDTH)
    while True:
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
        joined = salted.groupBy("host", "salt").applyInArrow(join, shape)
        if salts == 1:
            return joined
        old, parts = parts, written(joined, "wrappers")
        dropped(old)
        salts = -(-salts // WIDTH)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``page_id, url, html``."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), url_host(F.col("url")).alias("host"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wrappers_here = [Node.unpacked(json.loads(w)) for w in b.column("wrapper").to_pylist()]
            paths = [json.dumps([path := region(w), constants(w, path)]) for w in wrappers_here]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(paths, pa.string())], names=["_host", "path"])

    paths = written(wrappers(plain).mapInArrow(choose, "_host string, path string"), "wrappers")
    right = F.broadcast(paths) if paths.count() <= BROADCAST_HOSTS else paths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [article(x, *(json.loads(p) if p else [None])) for x, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = plain.join(right, plain["host"] == right["_host"], "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
