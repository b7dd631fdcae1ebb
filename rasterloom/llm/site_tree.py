"""HTML extraction with site style trees.

The pages of one host are merged into a style tree: a node is an element's
path of tags and classes, whatever its position among its siblings. A node's
presentation importance is the entropy of the child sequences it has on the
host's pages, its content importance the entropy of its texts. Branches of low
importance (the same links, the same notice on every page) are removed from
each page that has the repeated text there; what is left in blocks is the
page's main text.

Entropy says little about a host with few pages: an importance is in doubt by
``DOUBT`` divided by the number of pages. Element semantics
are the prior importance of a branch: ``nav``, ``footer``, ``aside``, forms
and scripts have none, and a page's ``article`` or ``main`` stands for the
page, unless its articles are mere teasers. Inside and outside of them the
tree decides alike. Class names of menus, adverts, notices or comments remove
a branch unless the tree is sure that its texts differ from page to page; they
never count on what stands around an article. An article copied to many pages
would look like a notice, so pages of one main text count once.

Defined results: null or empty html gives an empty text; broken markup is read
as far as it goes; a null url is a host of its own; repeated rows give repeated
rows; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, pieces, text_or_empty, written

#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is raw text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
#: Elements that never belong to the main text.
NOISE = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "script", "style", "textarea", "title", "noscript", "iframe", "template", "button", "select", "svg", "canvas", "object", "embed", "noembed", "noframes", "audio", "video", "map", "datalist", "option"}
#: Words of class, id or role that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
NOISE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "search", "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "discussion", "replies", "pagination", "pager", "widget", "toolbar", "legal", "copyright", "complementary", "contentinfo"}
#: Elements that stand inside a line of text.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: The elements of main text, those that words never remove, and those whose id is a name of theirs.
REGION, WHOLE, TITLED = {"article", "main"}, {"html", "body"}, {"h1", "h2", "h3", "h4", "h5", "h6", "section"}
#: An open element that the start of the key ends by itself.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose start ends an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>"']|(?<==)\s*(?:"[^"]*"|'[^']*')|["'])*?(?:>|\Z)|[^<]+|<""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}

#: How much more or less important than measured a branch may be, divided by the number of pages that tell.
DOUBT = 1.5
LOW = 0.2
HIGH = 0.5
SHARED = 0.05
#: Bytes of decisions (as JSON) that may be broadcast, and parts of a host beyond that.
BROADCAST_BYTES, SALTS = 32 << 20, 64
#: Characters of a path above which what is above it becomes a digest.
LONG_PATH = 2000


class Node:
    """An element of a page: its style (tag and classes), path, children and texts.

    ``noise`` elements never count; ``soft`` ones have a word of noise, which
    the tree may contradict.
    """

    __slots__ = ("tag", "style", "path", "parent", "parts", "noise", "soft", "region")

    def __init__(self, tag: str, style: str, parent: Node | None, noise: bool, soft: bool = False):
        self.tag, self.style, self.parent, self.noise, self.soft = tag, style, parent, noise, soft
        self.path = style if parent is None else _below(parent.path, style)
        self.region = tag in REGION or (parent is not None and parent.region)
        self.parts: list[Node | str] = []


def _below(path: str, style: str) -> str:
    """The path of an element below another; long ones begin with a digest of what is above."""
    if len(path) > LONG_PATH:
        path = "/".join(("#" + _digest(path), "", ""))
    return f"{path}/{style}"


def _start(source: str, tag: str, inside: bool) -> tuple[str, bool, bool]:
    """Style, noise and soft of a start tag; ``inside`` says if it stands in an article or main."""
    marks = _MARK.findall(source) if "=" in source else []
    values = {k.lower(): (a or b or c).lower() for k, a, b, c in marks}
    classes = sorted(set(values.get("class", "").split()))
    words = lambda *keys: bool({w for k in keys for w in _WORDS.findall(values.get(k, ""))} & NOISE_WORDS)
    soft = tag not in WHOLE and words("class", "id", "role")
    if soft and tag in TITLED and not words("class", "role"):
        soft = not inside  # there an id is the name of a heading
    return ".".join([tag, *classes]), tag in NOISE or values.get("aria-hidden") == "true", soft


def parse(source: str) -> Node:
    """The element tree of a page; open elements end where their parents do."""
    root = at = Node("", "", None, False)
    place, size = 0, len(source)
    while place < size:
        m = _TOKEN.match(source, place)
        s, place = m.group(), m.end()
        if s[0] != "<" or s == "<":
            at.parts.append(s)
            continue
        n = _NAME.match(s)
        if not n:
            continue
        tag = n.group(1).lower()
        if s[1] == "/":
            up = at
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                at = up.parent
            continue
        if tag in ENDS_P or tag in CLOSES:
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            up = at
            while up.parent is not None and (up.tag in INLINE or up.tag in ends):
                if up.tag in ends:
                    at = up.parent
                    if tag != "tr":
                        break
                up = up.parent
        style, noise, soft = _start(s, tag, at.region)
        if tag == "header" and not at.region:
            noise = True
        node = Node(tag, style, at, noise, soft)
        at.parts.append(node)
        if tag not in VOID and not s.endswith("/>"):
            at = node
            if tag in RAW:  # raw text runs to its own end tag, whatever stands in it
                end = _END[tag].search(source, place)
                stop = end.start() if end else size
                node.parts.append(source[place:stop])
                place = stop
    _unwrap(root)
    return root


def _unwrap(root: Node) -> None:
    """No word counts on a main or an outermost article, nor on what stands around them.

    If the text outside of soft elements is more than that of the articles in
    soft elements, these are cards of a menu, and the words count.
    """

    def clear(up: Node | None) -> None:
        while up is not None:
            up.soft = False
            up = up.parent

    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "main":
            clear(node)
        if not node.noise and node.tag != "article":
            todo += [p for p in node.parts if not isinstance(p, str)]
    clean, cards = 0, []
    todo = [(root, False, False)]
    while todo:
        node, below, held = todo.pop()
        if node.noise:
            continue
        below = below or node.soft
        if node.tag in REGION and not below and not held:
            clean, held = clean + _size(node), True
        if node.tag == "article":
            if below:
                cards.append(node)
        else:
            todo += [(p, below, held) for p in node.parts if not isinstance(p, str)]
    if cards and sum(map(_size, cards)) >= clean:
        for node in cards:
            clear(node)


def _own_text(node: Node) -> str:
    out, todo = [], list(reversed(node.parts))
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            out.append(p)
        elif p.tag in INLINE and not p.noise and not p.soft:
            todo += reversed(p.parts)
    return _SPACE.sub(" ", "".join(out)).strip()


def _digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _texts(root: Node, paths: frozenset[str] | set[str] | dict | None = None) -> dict[str, str]:
    """For each path of a page (or each of ``paths``) its nodes' texts; noise is left out."""
    texts: dict[str, list[str]] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.noise:
            continue
        if (node.tag not in INLINE or node.soft) and (paths is None or node.path in paths):
            texts.setdefault(node.path, []).append(_own_text(node))
        todo += reversed([p for p in node.parts if not isinstance(p, str)])
    return {p: "\n".join(t) if any(t) else "" for p, t in texts.items()}


def styles(root: Node) -> tuple[str, dict[str, tuple[str, str, bool]]]:
    """A digest of the page's main text, and for each path digests of its nodes' children and texts, and whether it is soft or below a soft one."""
    shapes: dict[str, list[str]] = {}
    soft: set[str] = set()
    todo = [(root, False)]
    while todo:
        node, below = todo.pop()
        if node.noise:
            continue
        below = below or node.soft
        kids = [p for p in node.parts if not isinstance(p, str)]
        if node.tag not in INLINE or node.soft:
            shapes.setdefault(node.path, []).append(" ".join(dict.fromkeys(k.style for k in kids)))
            if below:
                soft.add(node.path)
        todo += [(k, below) for k in reversed(kids)]
    texts = _texts(root)
    return _digest(main_text(root)), {p: (_digest("\n".join(shapes[p])), _digest(texts[p]) if texts[p] else "", p in soft) for p in shapes}


def main_text(root: Node, low: dict[str, frozenset[str]] | None = None, high: frozenset[str] = frozenset()) -> str:
    """The blocks of a page in order, without noise and without repeated texts of low branches.

    ``low`` has the digests of the repeated texts of each low path: a page
    whose text there is another one keeps it. ``high`` are the paths whose
    words the tree contradicts; other soft elements go.
    """
    gone = {p for p, t in _texts(root, low).items() if _digest(t) in low[p]} if low else set()
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(line))).strip()
        if text:
            blocks.append(text)
        line.clear()

    for top in _regions(root, high):
        # with each part, whether the text around it goes
        stack: list[tuple[Node | str | None, bool]] = [(top, False)]
        while stack:
            p, out = stack.pop()
            if p is None:
                close()
            elif isinstance(p, str):
                if not out:
                    line.append(p)
            elif p.noise or (p.soft and p.path not in high):
                if p.tag not in INLINE:
                    close()
            elif p.tag == "br":
                line.append(" ")
            elif p.tag in INLINE:
                inner = p.path in gone if p.soft else out
                stack += [(x, inner) for x in reversed(p.parts)]
            else:
                close()
                own = p.path in gone
                stack += [(None, False), *((x, own) for x in reversed(p.parts))]
        close()
    return " ".join(blocks)


def _size(node: Node, high: frozenset[str] = frozenset()) -> int:
    """Characters below a node, noise and soft elements left out."""
    n, todo = 0, [node]
    while todo:
        node = todo.pop()
        for p in node.parts:
            if isinstance(p, str):
                n += len(p.strip())
            elif not p.noise and (not p.soft or p.path in high):
                todo.append(p)
    return n


def _regions(root: Node, high: frozenset[str] = frozenset()) -> list[Node]:
    """A page's ``article`` and ``main`` elements, or the whole page.

    Articles that hold less than half of the text are teasers: the page is
    taken whole then. A ``main`` is taken at any size.
    """
    found: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.noise or (node.soft and node.path not in high):
            continue
        if node.tag in REGION:
            found.append(node)
        else:
            todo += reversed([p for p in node.parts if not isinstance(p, str)])
    if not found or all(n.tag == "article" for n in found) and 2 * sum(_size(n, high) for n in found) < _size(root, high):
        return [root]
    return found


def host_of(url: str):
    """The host of a url column; null urls share the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """How often each variant occurs: ``host, path, kind, v, n, soft``; kind ``p`` are child sequences, ``c`` texts.

    A variant whose pages all have the same main text counts once: copies of
    one page say nothing about what pages repeat. Workers emit one row a page
    and path; Spark counts the variants, first within each task, so a host
    with a third of all pages is no single task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 4 << 20):
            out: list[list] = [[], [], [], [], [], []]
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page, found = styles(parse(source))
                for path, (shape, text, soft) in found.items():
                    for column, x in zip(out, (host, page, path, shape, text, soft), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in out[:5]), pa.array(out[5], pa.bool_())], names=["host", "page", "path", "shape", "text", "soft"])

    seen = map_arrow(pages.select(host_of(url_col).alias("host"), text_or_empty(html_col).alias("html")), run, "host string, page string, path string, shape string, text string, soft boolean")
    both = seen.select("host", "page", "path", "soft", F.explode(F.array(F.struct(F.lit("p").alias("kind"), F.col("shape").alias("v")), F.struct(F.lit("c").alias("kind"), F.col("text").alias("v")))).alias("x"))
    one = F.min("page") == F.max("page")
    return both.groupBy("host", "path", "x.kind", "x.v").agg(F.when(one, F.lit(1)).otherwise(F.count(F.lit(1))).cast("long").alias("n"), F.max("soft").alias("soft"))


def style_tree(counts: DataFrame) -> DataFrame:
    """The merged tree of ``style_counts``: ``host, path, pages, presentation, content, soft`` (importances 0 to 1)."""
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.max("v").alias("any"), F.max("soft").alias("soft"))
    # entropy of the variants, divided by that of as many different ones
    importance = F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log2("pages"))).otherwise(1.0)
    return (
        sums.withColumn("importance", F.when((F.col("kind") == "c") & (F.col("any") == ""), F.lit(0.0)).otherwise(importance))
        .groupBy("host", "path")
        .agg(F.max("pages").alias("pages"), F.max(F.when(F.col("kind") == "p", F.col("importance"))).alias("presentation"), F.max(F.when(F.col("kind") == "c", F.col("importance"))).alias("content"), F.max("soft").alias("soft"))
    )


def _above() -> Column:
    """A path and the paths above it."""
    steps = F.split("path", "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))


def low_branches(tree: DataFrame, counts: DataFrame, doubt: float = DOUBT, low: float = LOW) -> DataFrame:
    """``host, low``: the paths below which everything is of low importance, each with its repeated texts.

    A branch is as important as its most important node, so a path is kept if
    any path below it is. A text is a repeated one if at least ``SHARED`` of
    the path's pages have it. ``html`` and ``body`` are no branches.
    """
    worth = F.greatest("presentation", "content") + F.lit(doubt) / F.col("pages")
    poor = tree.filter((worth < low) & F.col("path").rlike("/.*/.*/"))
    rich = tree.filter(worth >= low).select("host", F.explode(_above()).alias("path")).distinct()
    poor = poor.join(rich, ["host", "path"], "left_anti").select("host", "path", "pages")
    often = counts.filter("kind = 'c' AND v <> '' AND n > 1").join(poor, ["host", "path"]).filter(F.col("n") >= F.lit(SHARED) * F.col("pages"))
    texts = often.groupBy("host", "path").agg(F.collect_list("v").alias("texts"))
    return texts.groupBy("host").agg(F.collect_list(F.struct("path", "texts")).alias("low"))


def high_branches(tree: DataFrame, doubt: float = DOUBT, high: float = HIGH) -> DataFrame:
    """``host, high``: the paths with texts of high importance in or below soft elements.

    Texts alone say so: adverts may vary in shape without being text.
    """
    rich = tree.filter(F.col("soft") & (F.col("content") - F.lit(doubt) / F.col("pages") >= high))
    return rich.select("host", F.explode(_above()).alias("path")).groupBy("host").agg(F.collect_set("path").alias("high"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", doubt: float = DOUBT, low: float = LOW) -> DataFrame:
    """``id_col, url, text, n_chars``: the main text of every page.

    The tree's decisions reach the pages by broadcast up to ``BROADCAST_BYTES``,
    which are measured first; beyond it pages and decisions are dealt by host
    and ``SALTS`` parts of it, so a host's pages are no single task's work.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    counts = written(style_counts(pages, url_col, html_col), "styles")
    tree = style_tree(counts)
    branches = written(low_branches(tree, counts, doubt, low).join(high_branches(tree, doubt), "host", "full"), "branches")
    held = branches.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"), host_of(url_col).alias("host"))
    if held <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(branches), "host", "left")
    else:
        salted = branches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select(id_col, "url", "html", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 4 << 20):
            texts = []
            for source, poor, rich in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                texts.append(main_text(parse(source), {x["path"]: frozenset(x["texts"]) for x in poor or ()}, frozenset(rich or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    return map_arrow(joined, run, f"`{id_col}` {kind}, url string, text string, n_chars long")
