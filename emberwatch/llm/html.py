"""HTML extraction: a tree builder with implied tags, visibility rules, and a renderer that keeps the layout of text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp".split())
ESCAPABLE = frozenset("title textarea".split())
NEVER_SHOWN = frozenset("head title script style template iframe noembed noframes datalist audio video canvas".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre xmp table figure fieldset hr menu".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer nav main address center form li dt dd details summary dialog "
    "figcaption caption legend option optgroup search hgroup".split())
TABLE_PARTS = frozenset("thead tbody tfoot tr td th caption colgroup col".split())
CELLS = frozenset("td th caption".split())
CLOSES_P = BLOCK - frozenset("html body option optgroup caption table".split())
IN_HEAD = frozenset("base link meta title style script template noscript".split())
#: What a start tag ends if it is open, and the elements behind which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "a": ({"a"}, set()), "button": ({"button"}, set()),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "caption": ({"caption"}, {"table"}), "colgroup": ({"colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"  # a quote that never ends
    r"|<[!?][^>]*+>?|</>|</[^a-zA-Z>][^>]*+>?|</?[a-zA-Z][^>]*+\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLANKS = re.compile(r"[ \t\n\r\f]+")
HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def add(self, child: Node | str, at: int | None = None) -> None:
        self.children.insert(len(self.children) if at is None else at, child)
        if isinstance(child, Node):
            child.parent = self


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class Builder:
    """Tokens to a tree. `path` are the open elements from the body (or head) down."""

    def __init__(self):
        self.head, self.body = Node("head"), Node("body")
        self.path: list[Node] = [self.head]
        self.open: dict[str, int] = {}  # how many elements of a tag are in the path

    def place(self) -> Node:
        return self.path[-1]

    def leave_head(self) -> None:
        if self.path[0] is self.head:
            self.path, self.open = [self.body], {}

    def push(self, node: Node) -> None:
        self.path.append(node)
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def close_to(self, at: int) -> None:
        for node in self.path[at:]:
            self.open[node.tag] -= 1
        del self.path[at:]

    def find(self, tags: set[str], barrier: set[str]) -> int:
        """Place in the path of the innermost open element of `tags`, 0 if there is none before a barrier."""
        if not any(self.open.get(t) for t in tags):
            return 0
        in_cell = not tags & TABLE_PARTS and "table" not in tags
        for i in range(len(self.path) - 1, 0, -1):
            tag = self.path[i].tag
            if tag in tags:
                return i
            if tag in barrier or tag in CELLS and in_cell:
                break
        return 0

    def text(self, data: str) -> None:
        if self.path[0] is self.head and len(self.path) == 1:
            if not data.strip():
                return
            self.leave_head()
        at = self.place()
        if at.tag in ("table", "thead", "tbody", "tfoot", "tr", "colgroup"):
            if not data.strip():
                return
            self.foster(data)
            return
        at.children.append(data)

    def foster(self, child: Node | str) -> None:
        """Content that can't be in a table goes before it."""
        table = self.path[self.find({"table"}, set())]
        siblings = table.parent.children
        table.parent.add(child, len(siblings) - 1 - siblings[::-1].index(table))

    def start(self, tag: str, source: str) -> None:
        if tag in ("html", "head", "body"):
            if tag == "body":
                self.leave_head()
                for k, v in attributes(source).items():
                    self.body.attrs.setdefault(k, v)
            return
        if self.path[0] is self.head and len(self.path) == 1 and tag not in IN_HEAD:
            self.leave_head()
        if tag in CLOSES_P and (i := self.find({"p"}, {"button", "table"})):
            self.close_to(i)
        if tag in ENDS and (i := self.find(*ENDS[tag])):
            self.close_to(i)
        if tag[0] == "h" and tag in SPACED and tag != "hr" and self.place().tag[0] == "h" and self.place().tag in SPACED:
            self.close_to(len(self.path) - 1)
        if tag in TABLE_PARTS:
            if not self.open.get("table"):
                return
            self.open_table_parts(tag)
        node = Node(tag, attributes(source) if source and source != "/" else None)
        at = self.place()
        if at.tag in ("table", "thead", "tbody", "tfoot", "tr") and tag not in TABLE_PARTS and tag not in RAW | {"template"}:
            self.foster(node)
        else:
            at.add(node)
        if tag not in VOID:
            self.push(node)

    def open_table_parts(self, tag: str) -> None:
        """Implied tbody and tr; the caller ignores parts outside a table."""
        table = self.find({"table"}, set())
        wants = {"td": ("tr", "section"), "th": ("tr", "section"), "tr": ("section",)}.get(tag, ())
        sections = ("thead", "tbody", "tfoot")
        keep = table + 1
        for i in range(table + 1, len(self.path)):
            name = self.path[i].tag
            if name in sections and wants or name == "tr" and "tr" in wants or tag == "col" and name == "colgroup":
                keep = i + 1
        self.close_to(keep)
        if wants and self.place().tag == "table":
            self.imply("tbody")
        if "tr" in wants and self.place().tag in sections:
            self.imply("tr")

    def imply(self, tag: str) -> None:
        node = Node(tag)
        self.place().add(node)
        self.push(node)

    def end(self, tag: str) -> None:
        if tag == "head":
            self.leave_head()
        elif tag == "br":
            self.start("br", "")
        elif tag in ("html", "body"):
            return
        elif tag == "p" and not self.find({"p"}, {"button", "table"}):
            self.start("p", "")
            self.close_to(len(self.path) - 1)
        else:
            names = {"h1", "h2", "h3", "h4", "h5", "h6"} if re.fullmatch("h[1-6]", tag) else {tag}
            barrier = set() if tag in TABLE_PARTS | {"table"} else {"table"}
            if i := self.find(names, barrier):
                self.close_to(i)


def parse(source: str) -> Node:
    """The body of a page. Broken markup never fails: unknown ends are ignored, open elements end with the page."""
    builder, at = Builder(), 0
    while True:
        hit = MARKUP.search(source, at)
        data = source[at:hit.start()] if hit else source[at:]
        if data:
            builder.text(unescape(data) if "&" in data else data)
        if not hit:
            return builder.body
        at = hit.end()
        if name := hit[2] or hit[5]:
            tag = name.lower()
            if hit[1] or hit[4]:
                builder.end(tag)
                continue
            builder.start(tag, hit[3] or hit[6] or "")
            if tag in RAW or tag in ESCAPABLE:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                inside = source[at:close.start()] if close else source[at:]
                if tag == "textarea" or tag == "xmp":
                    builder.place().children.append(unescape(inside) if tag == "textarea" else inside)
                if builder.place().tag == tag and len(builder.path) > 1:
                    builder.close_to(len(builder.path) - 1)
                at = close.end() if close else len(source)


class Page:
    """Lines under construction: pending gaps between blocks, one open line, indents by list depth."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # line breaks owed before the next text
        self.blank = False  # a collapsed blank is owed
        self.indent: list[str] = []
        self.marker = ""

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap = max(self.gap, 2 if spaced else 1)

    def flush(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.blank = False

    def write(self, text: str) -> None:
        if not self.line:
            if self.lines and self.gap > 1 and self.lines[-1]:
                self.lines.append("")
            prefix = "".join(self.indent)
            if self.marker:
                prefix = prefix[:-len(self.marker)] + self.marker
                self.marker = ""
            self.line.append(prefix)
        elif self.blank:
            self.line.append(" ")
        self.gap, self.blank = 0, False
        self.line.append(text)

    def flow(self, data: str) -> None:
        words = BLANKS.sub(" ", data)
        if words[0] == " ":
            self.blank = self.blank or len(self.line) > 0
            words = words[1:]
        if words:
            trailing = words[-1] == " "
            self.write(words[:-1] if trailing else words)
            self.blank = trailing

    def kept(self, data: str) -> None:
        for i, line in enumerate(data.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline()
            if line:
                self.blank = False
                self.write(line)

    def newline(self) -> None:
        if self.line:
            self.flush()
        elif self.lines and not self.gap:
            self.lines.append("")
        self.gap = max(self.gap, 0)

    def finish(self) -> str:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines).replace("\u00a0", " ")


def shown(node: Node) -> bool:
    attrs = node.attrs
    if node.tag in NEVER_SHOWN or "hidden" in attrs or node.tag == "dialog" and "open" not in attrs:
        return False
    return not ("style" in attrs and HIDING.search(attrs["style"]))


def number(text: str | None, default: int, most: int = 1 << 31) -> int:
    hit = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return min(int(hit[1]), most) if hit else default


class Renderer:
    """Walks a tree with a stack of its own, so depth is bounded by memory alone."""

    def render(self, body: Node) -> str:
        self.pages, self.lists, self.tables = [Page()], [], []
        todo: list = [(body, False, False, False)]
        while todo:
            node, leaving, kept, unseen = todo.pop()
            if isinstance(node, str):
                if not unseen:
                    self.pages[-1].kept(node) if kept else self.pages[-1].flow(node)
                continue
            if leaving:
                self.leave(node)
                continue
            if not shown(node):
                continue
            attrs, tag = node.attrs, node.tag
            if "style" in attrs and (hit := VISIBILITY.search(attrs["style"])):
                unseen = hit[1].lower() in ("hidden", "collapse")
            kept = kept or tag in ("pre", "xmp", "textarea")
            if not unseen or tag in BLOCK or tag in TABLE_PARTS:
                self.enter(node)
            todo.append((node, True, kept, unseen))
            children = node.children
            if tag == "details" and "open" not in attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo.extend((c, False, kept, unseen) for c in reversed(children))
        return self.pages[0].finish()

    def enter(self, node: Node) -> None:
        page, tag, attrs = self.pages[-1], node.tag, node.attrs
        if tag in CELLS and (tag == "caption" or self.tables):
            self.pages.append(Page())
            return
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu") and self.lists
            page.block(tag in SPACED and not nested)
        if tag in ("ul", "ol", "menu"):
            count = sum(1 for c in node.children if isinstance(c, Node) and c.tag == "li")
            step = -1 if "reversed" in attrs else 1
            first = number(attrs.get("start"), count if step < 0 else 1)
            self.lists.append([tag == "ol", first, step])
        elif tag == "li":
            ordered, at, step = self.lists[-1] if self.lists else (False, 0, 1)
            if ordered:
                at = number(attrs.get("value"), at)
                self.lists[-1][1] = at + step
            page.marker = f"{at}. " if ordered else "- "
            page.indent.append(" " * len(page.marker))
        elif tag in ("dd", "blockquote"):
            page.indent.append("    ")
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag == "br":
            page.newline()
        elif tag == "hr":
            page.write("---")
            page.block(True)
        elif tag == "q":
            page.write('"')
        elif tag == "input" and attrs.get("type", "").lower() in ("submit", "button", "reset") and attrs.get("value"):
            page.flow(attrs["value"])

    def leave(self, node: Node) -> None:
        tag = node.tag
        if tag in CELLS and (tag == "caption" or self.tables):
            text = self.pages.pop().finish()
            if tag == "caption":
                self.pages[-1].kept(text)
                self.pages[-1].block(False)
            else:
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.tables[-1][-1].append((text.split("\n"), node))
            return
        page = self.pages[-1]
        if tag == "table":
            for line in table_lines(self.tables.pop()):
                page.kept(line) if line else None
                page.block(False)
        elif tag == "q":
            page.write('"')
        elif tag in ("ul", "ol", "menu"):
            self.lists.pop()
        if tag in ("li", "dd", "blockquote"):
            page.flush()
            page.indent.pop()
            page.marker = ""
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu") and self.lists
            page.block(tag in SPACED and not nested)


def table_lines(rows: list[list[tuple[list[str], Node]]]) -> list[str]:
    """Rows with cells at their columns' places; spans cover columns and rows, `align` is kept, cells may have lines."""
    placed, taken, width = [], {}, {}
    for r, row in enumerate(rows):
        c = 0
        for lines, node in row:
            while taken.get((r, c)):
                c += 1
            across = max(1, number(node.attrs.get("colspan"), 1, 1000))
            down = max(1, number(node.attrs.get("rowspan"), 1, max(1, len(rows) - r)))
            for i in range(down):
                for j in range(across):
                    taken[r + i, c + j] = True
            placed.append((r, c, across, lines, node.attrs.get("align", "").lower() or ("center" if node.tag == "th" else "")))
            if across == 1:
                width[c] = max(width.get(c, 0), *map(len, lines))
            c += across
    columns = max((c + across for _, c, across, _, _ in placed), default=0)
    for _, c, across, lines, _ in placed:
        short = max(map(len, lines)) - sum(width.get(c + j, 0) for j in range(across)) - 2 * (across - 1)
        if across > 1 and short > 0:
            width[c + across - 1] = width.get(c + across - 1, 0) + short
    starts = [0]
    for c in range(columns):
        starts.append(starts[-1] + width.get(c, 0) + 2)
    by_row: dict[int, list] = {}
    for cell in placed:
        by_row.setdefault(cell[0], []).append(cell)
    out = []
    for r in range(len(rows)):
        cells = by_row.get(r, [])
        for i in range(max((len(c[3]) for c in cells), default=0)):
            line = ""
            for _, c, across, lines, align in cells:
                room = starts[c + across] - starts[c] - 2
                text = lines[i] if i < len(lines) else ""
                text = text.rjust(room) if align == "right" else text.center(room) if align == "center" else text
                line = line.ljust(starts[c]) + text
            out.append(line.rstrip())
    return out


def visible_text(source: str | None) -> str | None:
    return None if source is None else Renderer().render(parse(source))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines: the visible text of each page, one row per row of `pages`.

    A null page has null text and no lines; an empty one, or one that shows nothing, has an empty text and no lines.
    Broken and cut-off markup is read as far as it goes. Null ids and repeated rows keep a row each; other columns are
    ignored.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(visible_text, na_action="ignore")

    rows = pages.select("page_id", text("html").alias("text"))
    lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n")))
    return rows.select("page_id", "text", lines.alias("n_lines"))
