"""HTML extraction by layout-aware rendering.

A tokenizer and tree builder with implied tags make a tree of any input; rules
decide which elements are visible; a renderer emits all visible text with block
spacing, list markers and table cells aligned in columns. Nothing is guessed to be
boilerplate.

Tree. ``html``, ``head`` and ``body`` are implied; a block start closes an open
paragraph; list items, definition terms, options, rows, cells and row groups close
their like; ``tr`` and ``td`` imply the groups and rows around them. End tags close
up to their element if it is open in the same cell or list, or are ignored; ``</p>``
without a paragraph makes an empty one. Script, style and similar hold raw text.

Visibility. Not shown: head, script, style, template and other elements that hold
no text for readers; the ``hidden`` attribute; ``display:none``; inputs of type
hidden; closed details but for their summary; closed dialogs; options that a closed
select doesn't show. ``visibility:hidden`` hides text until a descendant sets it
back. Declarations count from style attributes and from rules of style elements
whose selectors are a tag, class, id or such a tag with one class.

Layout. Paragraph-like blocks stand apart by a blank line, other blocks by a line
break. White space collapses outside ``pre`` and text areas. Items of lists carry
``*`` or their number and are indented. Cells of a table are padded to the widest
cell of their column up to MAX_COLUMN characters; longer cells overflow.

Defined results: null and empty html give empty text and a null title. Broken or
cut-off markup gives the text up to its end; elements nested deeper than MAX_DEPTH
go to the element at that depth, with all their text. Repeated pages are kept; an empty table gives an empty result; columns
other than ``page_id`` and ``html`` are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm.common import table

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW = frozenset(("title", "textarea"))
UNSEEN = frozenset(
    "head title meta link base script style template noembed noframes iframe object embed applet audio video canvas svg "
    "math datalist param source track area map rp".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure fieldset listing xmp".split())
BLOCK = APART | frozenset(
    "html body div section article aside header footer nav main address center form details summary dialog hgroup "
    "search figcaption li dt dd tr caption legend thead tbody tfoot td th hr optgroup option noscript frameset".split()
)
CLOSES_P = (APART | frozenset(
    "div section article aside header footer nav main address center form details summary dialog hgroup search "
    "figcaption hr li dt dd".split()
)) - {"table"}
IN_HEAD = frozenset("title meta link base script style template noscript".split())
#: A start tag closes the nearest of these elements unless one of the barriers stands between.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)),
}
GROUPS = ("thead", "tbody", "tfoot")
CELLS = ("td", "th")
#: End tags and closing by like don't reach past these.
SCOPE = frozenset(("table", "td", "th", "caption", "html", "template"))
MAX_COLUMN = 60
#: What is nested deeper becomes a child of the element at this depth, as in browsers.
MAX_DEPTH = 512

# A quote opens a value only behind an equals sign, and an unclosed one runs to the end of the file.
_NAME, _VALUE = r"[^\s/>][^\s/>=]*+", r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|(?:[^\s>\"'][^\s>]*+)?+"
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE}))?+", re.S)
_TAG_END = rf"((?:[\s/]++|{_NAME}(?:\s*+=\s*+(?:{_VALUE}))?+)*+)(?:>|\Z)"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*+){_TAG_END}|</[^>]*+(?:>|\Z)|[^<]++|<",
    re.S,
)
_SPACES = re.compile(r"[ \t\n\f\r]+")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SELECTOR = re.compile(r"([a-z][a-z0-9-]*)?(?:\.([\w-]+)|#([\w-]+))?\Z", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag = tag
        self.attrs = attrs or {}
        self.children: list[Node | str] = []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        value = m[2] or ""
        if value[:1] in ("'", '"'):
            value = value[1:].removesuffix(value[0])
        found.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return found


class Builder:
    """Builds the tree of one document."""

    def __init__(self, source: str):
        self.root = Node("html")
        self.head = Node("head")
        self.body = Node("body")
        self.root.children = [self.head, self.body]
        self.open: list[Node] = [self.root, self.body]
        self.in_head = True  # until something that isn't for the head comes
        self.styles: list[str] = []
        self.title: str | None = None
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        match = _TOKEN.match
        while at < end:
            m = match(source, at)
            at = m.end()
            if m[2]:
                name = m[2].lower()
                if m[1]:
                    self._end(name)
                    continue
                self._start(name, _attributes(m[3]) if m[3] else {})
                if name in RAW or name in ESCAPABLE_RAW:
                    close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
                    stop = close.start() if close else end
                    self._raw(name, source[at:stop])
                    at = stop
            elif not m[0].startswith("<") or m[0] == "<":
                self._text(html.unescape(m[0]) if "&" in m[0] else m[0])
            elif m[0].startswith("<![CDATA["):
                self._text(m[0][9:].removesuffix("]]>"))

    def _raw(self, name: str, content: str) -> None:
        if name == "style":
            self.styles.append(content)
        elif name in ESCAPABLE_RAW:
            content = html.unescape(content)
            if name == "title" and self.title is None:
                self.title = " ".join(content.split())
            self.open[-1].children.append(content)

    def _text(self, text: str) -> None:
        if self.in_head and not text.strip(" \t\n\f\r"):
            return
        self.in_head = False
        self.open[-1].children.append(text)

    def _close_to(self, names: tuple[str, ...], barriers) -> bool:
        for i in range(len(self.open) - 1, 1, -1):
            tag = self.open[i].tag
            if tag in names:
                del self.open[i:]
                return True
            if tag in barriers:
                return False
        return False

    def _start(self, name: str, attrs: dict[str, str]) -> None:
        if name in ("html", "body", "head"):
            node = {"html": self.root, "body": self.body, "head": self.head}[name]
            node.attrs = attrs | node.attrs
            self.in_head = self.in_head and name != "body"
            return
        if self.in_head and name in IN_HEAD:
            parent = self.head
        else:
            self.in_head = False
            parent = None
        if name in CLOSES_P:
            self._close_to(("p",), SCOPE | {"button"})
        if name in CLOSED_BY:
            closed, barriers = CLOSED_BY[name]
            self._close_to(closed, barriers)
        if name == "tr" or name in GROUPS:
            self._close_to(CELLS, ("table",))
            self._close_to(("tr",), ("table",))
        elif name == "option" or name == "optgroup":
            pass
        elif name in CELLS and self.open[-1].tag in (*GROUPS, "table"):
            self._start("tr", {})
        if name == "tr" and self.open[-1].tag == "table":
            self._push("tbody", {}, None)
        if name[0] == "h" and len(name) == 2 and name[1] in "123456" and re.fullmatch("h[1-6]", self.open[-1].tag):
            self.open.pop()
        self._push(name, attrs, parent)

    def _push(self, name: str, attrs: dict[str, str], parent: Node | None) -> None:
        node = Node(name, attrs)
        (parent or self.open[-1]).children.append(node)
        if name not in VOID and len(self.open) < MAX_DEPTH:
            self.open.append(node)

    def _end(self, name: str) -> None:
        if name in ("html", "body", "head") or name in VOID - {"br"}:
            self.in_head = self.in_head and name == "head"
            return
        if name == "br":
            self._start("br", {})
            return
        barriers = SCOPE - {name}
        if name in ("table", *GROUPS, "tr"):
            barriers = frozenset(("html", "template")) if name == "table" else frozenset(("table",))
        elif name == "li":
            barriers = SCOPE | {"ul", "ol"}
        if not self._close_to((name,), barriers) and name == "p":
            self._start("p", {})
            self._end("p")


class Rules:
    """Which selectors of the style elements hide their elements."""

    def __init__(self, styles: list[str]):
        self.display: dict[tuple, bool] = {}
        self.visibility: dict[tuple, bool] = {}
        for source in styles:
            for selectors, body in _RULE.findall(_COMMENT.sub("", source)):
                shown, visible = declared(body)
                if shown is None and visible is None:
                    continue
                for selector in selectors.split(","):
                    m = _SELECTOR.match(selector.strip())
                    if m and m[0]:
                        key = ((m[1] or "").lower(), m[2] or "", m[3] or "")
                        if shown is not None:
                            self.display[key] = shown
                        if visible is not None:
                            self.visibility[key] = visible

    def of(self, node: Node, rules: dict[tuple, bool]) -> bool | None:
        """The most specific rule's word on an element: id, then class, then tag."""
        if not rules:
            return None
        name = node.attrs.get("id", "")
        classes = node.attrs.get("class", "").split()
        keys = [(node.tag, "", name), ("", "", name)] if name else []
        keys += [(t, c, "") for t in (node.tag, "") for c in classes] + [(node.tag, "", "")]
        return next((rules[k] for k in keys if k in rules), None)


def declared(body: str) -> tuple[bool | None, bool | None]:
    """Whether declarations show (display) and make visible (visibility) an element; None: they don't say."""
    shown = visible = None
    for one in body.lower().split(";"):
        name, _, value = one.partition(":")
        name, value = name.strip(), value.replace("!important", "").strip()
        if name == "display":
            shown = value != "none"
        elif name == "visibility":
            visible = value not in ("hidden", "collapse")
    return shown, visible


class Page:
    """Lines of text as they grow: the whole page or one table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a space is due before the next word
        self.blank = False  # a blank line is due before the next line
        self.indent: list[str] = []
        self.marker = ""  # of the item that begins on the next line

    def words(self, text: str) -> None:
        parts = _SPACES.split(text)
        for i, part in enumerate(parts):
            if i and self.line:
                self.space = True
            if part:
                if self.space:
                    self.line.append(" ")
                    self.space = False
                self.line.append(part)

    def verbatim(self, text: str) -> None:
        for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.end_line(True)
            if part:
                self.line.append(part)

    def end_line(self, even_empty: bool = False) -> None:
        text = "".join(self.line).replace("\xa0", " ").rstrip()
        self.line, self.space = [], False
        if text:
            self._emit(text)
        elif even_empty and self.lines:
            self.lines.append("")

    def _emit(self, text: str) -> None:
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        margin = "".join(self.indent)
        if self.marker:
            margin = margin[: -len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append(margin + text)

    def block(self, apart: bool) -> None:
        self.end_line()
        self.blank = self.blank or apart

    def raw_line(self, text: str) -> None:
        self._emit(text) if text else self.lines.append("")

    def finish(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(value: int, kind: str) -> str:
    if kind in ("a", "A") and value > 0:
        out = ""
        while value:
            value, rest = divmod(value - 1, 26)
            out = chr(97 + rest) + out
        return out if kind == "a" else out.upper()
    if kind in ("i", "I") and 0 < value < 4000:
        out = ""
        for size, name in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"),
                           (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += name * (value // size)
            value %= size
        return out if kind == "i" else out.upper()
    return str(value)


def _integer(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", text) else default


def _laid_out(rows: list[list[tuple[list[str], int]]]) -> Iterator[str]:
    """The lines of a table from rows of ``(lines, columns spanned)``."""
    widths: list[int] = []
    for row in rows:
        column = 0
        for lines, span in row:
            widths.extend([0] * (column + span - len(widths)))
            widest = max(map(len, lines), default=0)
            if span == 1 and widest <= MAX_COLUMN:
                widths[column] = max(widths[column], widest)
            column += span
    for row in rows:
        for i in range(max((len(lines) for lines, _ in row), default=0)):
            out, column = "", 0
            for lines, span in row:
                text = lines[i] if i < len(lines) else ""
                if text:
                    at = sum(w + 2 for w in widths[:column])
                    out = out.ljust(at) if len(out) <= at - 2 or not out else out + "  "
                    out += text
                column += span
            yield out.rstrip()


class Renderer:
    def __init__(self, tree: Builder):
        self.rules = Rules(tree.styles)
        self.pages = [Page()]
        self.tables: list[list[list[tuple[list[str], int]]]] = []
        self.lists: list[list] = []
        self.text = "\n".join(self._run(tree.root))

    def _shown(self, node: Node, parent: Node | None) -> bool:
        tag, attrs = node.tag, node.attrs
        if tag in UNSEEN or "hidden" in attrs:
            return False
        if tag == "input" and attrs.get("type", "").lower() == "hidden" or tag == "dialog" and "open" not in attrs:
            return False
        if parent is not None and parent.tag == "details" and tag != "summary" and "open" not in parent.attrs:
            return False
        shown = declared(attrs["style"])[0] if "style" in attrs else None
        shown = self.rules.of(node, self.rules.display) if shown is None else shown
        return shown is not False

    def _visible(self, node: Node, now: bool) -> bool:
        said = declared(node.attrs["style"])[1] if "style" in node.attrs else None
        said = self.rules.of(node, self.rules.visibility) if said is None else said
        return now if said is None else said

    def _run(self, root: Node) -> list[str]:
        # (node or text, parent, visible, preformatted) to enter; a function to call when leaving.
        stack: list = [(root, None, True, False)]
        while stack:
            top = stack.pop()
            if callable(top):
                top()
                continue
            node, parent, visible, pre = top
            page = self.pages[-1]
            if isinstance(node, str):
                if visible and not (parent.tag == "details" and "open" not in parent.attrs):
                    page.verbatim(node) if pre else page.words(node)
                continue
            if not self._shown(node, parent):
                continue
            visible = self._visible(node, visible)
            pre = pre or node.tag in ("pre", "listing", "textarea", "xmp")
            children = node.children
            leave = self._enter(node, visible)
            if leave:
                stack.append(leave)
            if node.tag == "select" and "multiple" not in node.attrs and _integer(node.attrs.get("size"), 1) <= 1:
                children = self._selected(node)
            elif node.tag in ("pre", "listing", "textarea") and children and isinstance(children[0], str):
                children = [children[0].removeprefix("\n"), *children[1:]]
            stack.extend((c, node, visible, pre) for c in reversed(children))
        return self.pages[0].finish()

    def _selected(self, node: Node) -> list:
        options, stack = [], [node]
        while stack:
            at = stack.pop()
            if at.tag == "option":
                options.append(at)
            stack.extend(c for c in reversed(at.children) if isinstance(c, Node))
        chosen = [o for o in options if "selected" in o.attrs][-1:] or options[:1]
        return chosen

    def _enter(self, node: Node, visible: bool):
        """Opens an element; what to call when it ends, if anything."""
        tag, page = node.tag, self.pages[-1]
        if tag == "br":
            page.end_line(True)
        elif tag == "hr":
            page.block(True)
        elif tag == "input":
            if visible and node.attrs.get("type", "text").lower() not in ("checkbox", "radio", "password", "image", "file"):
                page.words(" " + node.attrs.get("value", "") + " ")
        elif tag in ("ul", "ol", "menu", "dir"):
            return self._enter_list(node)
        elif tag == "li":
            return self._enter_item(node)
        elif tag in ("blockquote", "dd"):
            page.block(tag in APART)
            page.indent.append("  ")
            return lambda: (page.block(tag in APART), page.indent.pop())
        elif tag == "table":
            return self._enter_table()
        elif tag == "tr":
            if self.tables:
                self.tables[-1].append([])
            return None
        elif tag in CELLS and self.tables:
            return self._enter_cell(node)
        elif tag in GROUPS or tag in ("colgroup", "col"):
            return None
        elif tag in BLOCK:
            apart = tag in APART
            page.block(apart)
            return lambda: page.block(apart)
        return None

    def _enter_list(self, node: Node):
        page = self.pages[-1]
        # A list within an item follows its text without a blank line.
        apart = not self.lists
        page.block(apart)
        step = -1 if "reversed" in node.attrs else 1
        first = _integer(node.attrs.get("start"), 1)
        if step < 0 and "start" not in node.attrs:
            first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
        self.lists.append([node.tag == "ol", first, step, node.attrs.get("type", "1")])

        def leave() -> None:
            page.block(apart)
            self.lists.pop()

        return leave

    def _enter_item(self, node: Node):
        page = self.pages[-1]
        page.block(False)
        marker = "* "
        if self.lists and self.lists[-1][0]:
            own = self.lists[-1]
            own[1] = _integer(node.attrs.get("value"), own[1])
            marker = _number(own[1], own[3]) + ". "
            own[1] += own[2]
        page.indent.append(" " * len(marker))
        page.marker = marker

        def leave() -> None:
            page.block(False)
            page.indent.pop()
            page.marker = ""

        return leave

    def _enter_table(self):
        outer = self.pages[-1]
        outer.block(True)
        lists, self.lists = self.lists, []
        self.tables.append([])

        def leave() -> None:
            outer.end_line()
            for line in _laid_out([row for row in self.tables.pop() if row]):
                outer.raw_line(line)
            outer.block(True)
            self.lists = lists

        return leave

    def _enter_cell(self, node: Node):
        self.pages.append(Page())
        lists, self.lists = self.lists, []
        span = min(max(_integer(node.attrs.get("colspan"), 1), 1), 1000)
        rows = self.tables[-1]

        def leave() -> None:
            self.lists = lists
            if not rows:
                rows.append([])
            rows[-1].append((self.pages.pop().finish(), span))

        return leave


def render(source: str | None) -> tuple[str | None, str]:
    """Title (None without one) and visible text of a page."""
    if not source:
        return None, ""
    tree = Builder(source)
    return tree.title, Renderer(tree).text


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, title, text`` of each row of ``pages``."""
    rows = pages.select(F.col("page_id"), F.col("html").alias("_source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [render(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())],
                ["page_id", "title", "text"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, title string, text string")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "title", "text", F.length("text").cast("long").alias("n_chars"))
