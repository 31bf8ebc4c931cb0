"""HTML pages as rows of blocks.

Python only reads tags, since Spark has no reader for them: a task turns each page into the flat list of its visible
pieces (headings, paragraphs, items of lists, cells of tables, terms), with links as Markdown and without hidden parts.
Blocks, their texts, heading paths and hashes are made of these pieces by DataFrame expressions.

Pages of any depth are walked without recursion. A page that can't be read gives no block and one row of issues. Null
pages are empty; ids may be of any type; a page stays in one row, as one page does, before its blocks are rows.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser
from itertools import groupby
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tags whose contents are no text of a page.
DROPPED = frozenset((
    "aside", "button", "canvas", "footer", "iframe", "input", "menu", "nav", "noscript", "option", "script",
    "select", "style", "svg", "textarea",
))
#: Words in ids and classes, between blanks, `-` and `_`, of parts that are no content.
BOILERPLATE = (
    "banner", "breadcrumb", "cookie", "feedback", "footer", "header", "leftnav", "leftpanel", "logo", "menu",
    "modal", "nav", "navigation", "quicklaunch", "ribbon", "search", "share", "sidebar", "social",
    "suitebar", "topnavigation", "updated",
)
#: The same of classes of hidden parts, and a part of a class that hides.
HIDDEN_CLASSES, HIDDEN_PART = ("d-none", "hidden", "visually-hidden"), "ms-hide"
#: What may hold the content where there is no main element, in order: (attribute, value); class: one of several.
MAIN_PLACES = (("data-name", "ContentPlaceHolderMain"), ("id", "DeltaPlaceHolderMain"), ("class", "ms-rtestate-field"), ("class", "content_common"),
    ("class", "container-body"))
#: Parts of ids and classes of tables that lay out a page, and of tables of content.
LAYOUT_MARKS, CONTENT_MARKS = ("webpart", "ms-core", "ms-table", "layout"), ("in-table", "e-table", "d-table")

_VOID = frozenset((
    "br", "img", "input", "hr", "meta", "link", "source", "area", "base", "col", "embed", "param", "track",
    "wbr",
))
_LEVEL = {f"h{k}": k for k in range(1, 7)}
_PLAIN = frozenset(("p", "pre", "blockquote", "figure"))
_SEMANTIC = _PLAIN | {"ul", "ol", "dl", "table"}
_ENDS_P = _SEMANTIC | set(_LEVEL) | {"div", "section", "article", "main", "form", "li"}
_INLINE = frozenset((
    "a", "b", "i", "u", "em", "strong", "span", "small", "code", "sub", "sup", "font", "mark", "abbr",
    "cite", "q",
))
_CELL_BLOCKS = frozenset(("div", "section", "ul", "ol", "p"))
#: An open tag of one of these ends at the next of its kind, unless the second tag was opened in between.
_ENDS_SAME = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_EDGE = r"(?:^|[-_\s])(?:{})(?:$|[-_\s])"
_BOILER = re.compile(_EDGE.format("|".join(BOILERPLATE)), re.I)
_HIDE = re.compile(_EDGE.format("|".join(HIDDEN_CLASSES)), re.I)
_HIDE_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    __slots__ = ("tag", "attrs", "items", "up", "has")

    def __init__(self, tag: str, attrs: dict, up):
        self.tag, self.attrs, self.items, self.up = tag, attrs, [], up
        self.has: set[str] = set()  # tags below


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("root", {}, None)

    def _close(self, node) -> None:
        """Ends all open elements down to `node`, which passes on what they hold."""
        while self.at is not node.up:
            self.at.up.has |= self.at.has | {self.at.tag}
            self.at = self.at.up

    def _open(self, tags, stop=()):
        n = self.at
        while n.up is not None and n.tag not in tags:
            if n.tag in stop:
                return None
            n = n.up
        return n if n.up is not None else None

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:  # an open paragraph ends here, with inline tags that were left open in it
            n = self.at
            while n.up is not None and n.tag in _INLINE:
                n = n.up
            if n.tag == "p":
                self._close(n)
        same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
        if tag in _ENDS_SAME and (n := self._open(same, _ENDS_SAME[tag])) is not None:
            self._close(n)
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag in _VOID:
            self.at.has.add(tag)
        else:
            self.at = node

    def handle_endtag(self, tag):
        if (n := self._open((tag,))) is not None:
            self._close(n)

    def handle_data(self, data):
        self.at.items.append(data)

    def done(self) -> _Node:
        self.close()
        if self.at.up is not None:
            n = self.at
            while n.up.up is not None:
                n = n.up
            self._close(n)
        return self.root


def clean(text: str) -> str:
    """NFKC, without format characters, runs of blanks collapsed, line ends kept."""
    text = unicodedata.normalize("NFKC", text)
    if not text.isascii():
        text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return re.sub(r"[^\S\n]+", " ", re.sub(r"[^\S\n]*\n[^\S\n]*", "\n", re.sub(r"\r\n?", "\n", text))).strip()


def hidden(n: _Node) -> bool:
    if n.tag in DROPPED:
        return True
    if not n.attrs or n.tag == "form":
        return False
    of = n.attrs.get
    return (
        of("aria-hidden", "").lower() == "true" or "hidden" in n.attrs or bool(_HIDE_STYLE.search(of("style", ""))) or HIDDEN_PART in of("class",
            "").lower()
        or bool(_HIDE.search(of("class", ""))) or bool(_BOILER.search(f"{of('id', '')} {of('class', '')}"))
    )


def _all(n: _Node, tag: str | None = None):
    """Elements below n in the order of the page, those of hidden parts left out."""
    todo = [x for x in reversed(n.items) if isinstance(x, _Node)]
    while todo:
        x = todo.pop()
        if hidden(x):
            continue
        if tag is None or x.tag == tag:
            yield x
        if tag is None or tag in x.has:
            todo += [y for y in reversed(x.items) if isinstance(y, _Node)]


def main_part(root: _Node) -> tuple[_Node, bool]:
    """(the element that holds the content, whether it is only the body)."""
    tests = [lambda x: x.tag == "main", lambda x: x.attrs.get("role", "").lower() == "main"]
    for name, value in MAIN_PLACES:
        tests.append(lambda x, name=name, value=value: value in x.attrs.get("class", "").split() if name == "class" else x.attrs.get(name) == value)
    found: dict[int, _Node] = {}
    todo = [root]
    while todo:  # hidden or not
        x = todo.pop()
        for k, test in enumerate(tests):
            if k not in found and x is not root and test(x):
                found[k] = x
        todo += [y for y in reversed(x.items) if isinstance(y, _Node)]
    if found:
        return found[min(found)], False
    return next((x for x in root.items if isinstance(x, _Node) and x.tag == "body"), None) or next(_all(root, "body"), root), True


def _link(href: str, base: str) -> str | None:
    href = href.strip()
    if not href or href.startswith("#") or re.match(r"(?i)(?:javascript|data|mailto|tel):", href):
        return None
    try:
        full = urljoin(base, href)
    except ValueError:
        return None
    return full if re.match(r"(?i)https://[^/?#]", full) else None


def inline(items: list, base: str, skip=frozenset()) -> str:
    """The text of nodes with links as Markdown; `skip`: tags left out. One pass with a stack of open links."""
    out: list[str] = []
    todo = list(reversed(items))
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):  # the end of a link
            at, to = x
            text = "".join(out[at:])
            out[at:] = [f"[{clean(text)}]({to})" if text.strip() else text]
        elif isinstance(x, str):
            out.append(re.sub(r"\s+", " ", x))
        elif x.tag == "br":
            out.append("\n")
        elif x.tag == "img":
            out.append(x.attrs.get("alt", ""))
        elif x.tag not in skip and not hidden(x):
            if x.tag == "a" and (to := _link(x.attrs.get("href", ""), base)):
                todo.append((len(out), to))
            todo += reversed(x.items)
    return clean("".join(out))


def is_layout(n: _Node) -> bool:
    """Whether a table only lays out the page."""
    mark = f"{n.attrs.get('id', '')} {n.attrs.get('class', '')}".lower()
    if any(m in mark for m in LAYOUT_MARKS):
        return True
    if "th" in n.has or any(m in mark for m in CONTENT_MARKS) and "table" not in n.has:
        return False
    return "table" in n.has or any(cell.has & _CELL_BLOCKS for cell in _all(n, "td"))


def pieces(root: _Node, base: str):
    """Rows (block, kind, depth, number, text, cells) of the visible pieces below an element, in order.

    kinds: heading (depth: its level), paragraph, item (depth, number in an ordered list or 0), caption, header and row
    (cells), term (text, cells: its definition). Pieces of one block share its number. An element without blocks below it is a paragraph; text
    that stands free in a container comes after its blocks, as a paragraph.
    """
    block = 0
    todo: list = [("open", root)]
    while todo:
        what, x = todo.pop()
        if what == "free":
            if text := clean(" ".join(t for t in x if t)):
                block += 1
                yield block, "paragraph", 0, 0, text, []
            continue
        if what == "open":
            free: list[str] = []
            todo.append(("free", free))
            inside = []
            for y in x.items:
                if isinstance(y, str):
                    free.append(re.sub(r"\s+", " ", y))
                elif hidden(y):
                    continue
                elif y.tag in _LEVEL or (y.tag in _SEMANTIC and not (y.tag == "table" and is_layout(y))):
                    inside.append(("block", y))
                elif y.has & (_SEMANTIC | set(_LEVEL)) or y.tag == "table":
                    inside.append(("open", y))
                elif text := inline([y], base):
                    inside.append(("text", text))
            todo += reversed(inside)
            continue
        block += 1
        if what == "text":
            yield block, "paragraph", 0, 0, x, []
            continue
        if x.tag in _LEVEL:
            yield block, "heading", _LEVEL[x.tag], 0, inline(x.items, base), []
        elif x.tag in _PLAIN:
            yield block, "paragraph", 0, 0, inline(x.items, base), []
        elif x.tag in ("ul", "ol"):
            lists = [(x, 0, 0)]
            while lists:
                n, depth, at = lists.pop()
                items = [y for y in n.items if isinstance(y, _Node) and y.tag == "li"]
                if at >= len(items):
                    continue
                lists.append((n, depth, at + 1))
                if not hidden(items[at]):
                    yield block, "item", depth, at + 1 if n.tag == "ol" else 0, inline(items[at].items, base, frozenset(("ul", "ol"))), []
                    lists += [(y, depth + 1, 0) for y in reversed(items[at].items) if isinstance(y, _Node) and y.tag in ("ul", "ol")]
        elif x.tag == "dl":
            term = ""
            for y in _all(x):
                if y.tag == "dt":
                    term = inline(y.items, base)
                elif y.tag == "dd":
                    yield block, "term", 0, 0, term, [inline(y.items, base)]
        else:
            for caption in list(_all(x, "caption"))[:1]:
                yield block, "caption", 0, 0, inline(caption.items, base), []
            for k, tr in enumerate(_all(x, "tr")):
                cells = [y for y in tr.items if isinstance(y, _Node) and y.tag in ("td", "th")]
                head = k == 0 and any(c.tag == "th" for c in cells)
                yield block, "header" if head else "row", 0, 0, "", [inline(c.items, base) for c in cells]


def read_page(html: str, url: str) -> tuple[str, bool, list[tuple]]:
    """(title, whether the body is all there is, pieces) of a page."""
    tree = _Tree()
    tree.feed(html or "")
    root = tree.done()
    title = next(_all(root, "title"), None)
    main, fallback = main_part(root)
    return inline(title.items, url) if title else "", fallback, list(pieces(main, url))


def links_of(html: str) -> list[tuple[str, str]]:
    """(label, href) of the links of a page, hidden ones too, as they stand."""
    tree = _Tree()
    tree.feed(html or "")
    out, todo = [], [tree.done()]
    while todo:
        x = todo.pop()
        if x.tag == "a" and "href" in x.attrs:
            words, inner = [], list(reversed(x.items))
            while inner:
                y = inner.pop()
                words.append(y) if isinstance(y, str) else inner.extend(reversed(y.items))
            out.append((re.sub(r"\s+", " ", " ".join(words)).strip(), x.attrs["href"].strip()))
        todo += [y for y in reversed(x.items) if isinstance(y, _Node)]
    return out


_PIECE = "struct<kind:string,depth:int,number:int,text:string,cells:array<string>>"


def page_pieces(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(`id_col`, url, title, fallback, blocks, error): the pieces of each block of each page, or why it can't be read (the
    kind of error)."""
    packed = pages.select(F.struct(F.col(f"`{id_col}`")).alias("row"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"),
        F.col(f"`{html_col}`").alias("html"))
    piece = pa.list_(pa.struct([("kind", pa.string()), ("depth", pa.int32()), ("number", pa.int32()), ("text", pa.string()),
        ("cells", pa.list_(pa.string()))]))
    names = ("kind", "depth", "number", "text", "cells")
    grouped = lambda found: [[dict(zip(names, p[1:])) for p in ps] for _, ps in groupby(found, key=lambda p: p[0])]

    def run(batches):
        for batch in batches:
            out = []
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    title, fallback, found = read_page(html, url)
                    out.append((title, fallback, grouped(found), None))
                except (ValueError, AssertionError) as e:  # what the tag reader raises
                    out.append(("", False, [], type(e).__name__))
            title, fallback, found, error = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(title, pa.string()), pa.array(fallback, pa.bool_()), pa.array(found, pa.list_(piece)),
                    pa.array(error, pa.string())],
                ["row", "url", "title", "fallback", "blocks", "error"])

    schema = StructType([packed.schema["row"],
        *StructType.fromDDL(f"url string, title string, fallback boolean, blocks array<array<{_PIECE}>>, error string")])
    out = packed.mapInArrow(run, schema)
    return out.select(F.col(f"row.`{id_col}`"), "url", "title", "fallback", "blocks", "error")


def block_text(ps: Column) -> Column:
    """The text of a block's pieces."""
    cells = lambda p: F.array_join(p["cells"], " | ")
    full = lambda p: F.exists(p["cells"], lambda c: c != "")
    mark = lambda p: F.when(p["number"] > 0, F.concat(p["number"].cast("string"), F.lit(". "))).otherwise("- ")
    line = lambda p: (
        F.when(p["kind"] == "item", F.when(p["text"] != "", F.concat(F.repeat(F.lit("  "), p["depth"]), mark(p), p["text"])))
        .when(p["kind"] == "caption", F.concat(F.lit("Table: "), p["text"])).when(p["kind"] == "header", F.concat(F.lit("Headers: "), cells(p)))
        .when(p["kind"] == "row", F.when(full(p), F.concat(F.lit("Row: "), cells(p)))).when(p["kind"] == "term",
            F.concat(p["text"], F.lit(": "), F.get(p["cells"], F.lit(0))))
        .otherwise(p["text"]))
    return F.array_join(F.array_compact(F.transform(ps, line)), "\n")


def html_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(`id_col`, ordinal, kind, title_path, content, headers, warnings): a row for each block with text of each page.

    title_path: the open headings, else the page's title, else its url. A heading closes those of its level and below.
    """
    read = page_pieces(pages, id_col, url_col, html_col)
    kind = lambda ps: F.when(ps[0]["kind"] == "item", "list").when(ps[0]["kind"] == "term",
        "definition_list").when(ps[0]["kind"].isin("caption", "header", "row"), "table").otherwise(ps[0]["kind"])
    head = lambda ps: F.coalesce(F.get(F.filter(ps, lambda p: p["kind"] == "header"), F.lit(0))["cells"],
        F.expr("cast(array() as array<string>)"))
    one = lambda ps: F.struct(kind(ps).alias("kind"), block_text(ps).alias("content"), head(ps).alias("headers"),
        ps[0]["depth"].alias("depth"))
    rows = read.withColumn("bs", F.filter(F.transform("blocks", one), lambda b: b["content"] != ""))

    def follow(s: Column, b: Column) -> Column:
        path = F.when(b["kind"] == "heading", F.concat(F.slice(s["path"], F.lit(1), b["depth"] - 1), F.array(b["content"]))).otherwise(s["path"])
        return F.struct(path.alias("path"), F.concat(s["out"], F.array(path)).alias("out"))

    none = F.expr("cast(array() as array<string>)")
    start = F.struct(none.alias("path"), F.expr("cast(array() as array<array<string>>)").alias("out"))
    paths = rows.withColumn("paths", F.aggregate("bs", start, follow, lambda s: s["out"]))
    flat = paths.select(id_col, "url", "title", "fallback", F.posexplode(F.arrays_zip("bs", "paths")).alias("at", "x"))
    named = F.when(F.size("x.paths") > 0, F.col("x.paths")).otherwise(F.array(F.coalesce(F.nullif("title", F.lit("")), "url")))
    warned = F.when(F.col("fallback"), F.array(F.lit("HTML_MAIN_FALLBACK"))).otherwise(none)
    return flat.select(id_col, (F.col("at") + 1).alias("ordinal"), F.col("x.bs.kind").alias("kind"), named.alias("title_path"),
        F.col("x.bs.content").alias("content"),
                       F.col("x.bs.headers").alias("headers"), warned.alias("warnings"))


def html_issues(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(`id_col`, code, severity, message) of pages that can't be read; messages don't tell contents."""
    bad = page_pieces(pages, id_col, url_col, html_col).where("error is not null")
    return bad.select(id_col, F.lit("EXTRACTION_FAILED").alias("code"), F.lit("error").alias("severity"),
        F.concat(F.lit("page can't be read: "), "error").alias("message"))


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(`id_col`, source, label, url): http(s) links of pages to their own host, each (label, url) once in all, that of the
    page with the smallest url. Links without a text are `Unlabelled link`; null urls have no host and give no row."""
    from corpusloom.functions.urls import absolute

    @F.pandas_udf("array<struct<label:string,href:string>>")
    def found(htmls):
        return htmls.map(lambda h: [{"label": a, "href": b} for a, b in links_of(h)])

    flat = pages.select(F.col(id_col), F.col(url_col).alias("source"), F.posexplode(found(F.col(html_col))).alias("at", "l"))
    host = lambda c: F.lower(F.regexp_extract(c, "(?i)^https?://([^/?#]*)", 1))
    rows = flat.select(id_col, "source", "at", F.col("l.label").alias("label"), absolute(F.col("l.href"), F.col("source")).alias("url"))
    own = rows.where((host(F.col("url")) != "") & (host(F.col("url")) == host(F.col("source"))))
    first = own.groupBy("label", "url").agg(F.min(F.struct("source", "at", F.col(id_col).alias("id"))).alias("f"))
    return first.select(F.col("f.id").alias(id_col), "f.source", F.when(F.col("label") == "",
        "Unlabelled link").otherwise(F.col("label")).alias("label"), "url")
