"""Layout-aware HTML rendering: a tree builder with implied tags, visibility rules, and a text layout.

The builder closes and opens what HTML implies (paragraphs before blocks, list items, table sections, rows and
cells), drops stray end tags and keeps at most DEEP levels open, as browsers do. Elements that are not shown
(scripts, hidden, display:none and the like, closed details, options not chosen) are left out; all other text is
emitted, with blank lines around paragraphs and headings, line breaks around blocks, list markers with indents, and
tables as columns, cells that span rows or columns included. Tags and style rules are read by scanners that pass over
a page once, whatever it holds.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm import batches as batch_rows

DEEP = 256

# fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noframes xmp iframe noembed".split())
UNSEEN = frozenset("head script style title template noscript noframes iframe noembed datalist object audio video canvas annotation annotation-xml".split())
#: Parts of drawings that are not drawn where they stand.
UNDRAWN = frozenset("defs title desc metadata symbol clippath mask pattern marker script style".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCKS = PARAGRAPHS | frozenset("html body div section article aside header footer nav main address fieldset form figcaption details summary dialog dd dt li center legend search hgroup menu tr td th caption thead tbody tfoot".split())
ENDS_P = BLOCKS - frozenset("html body td th tr caption thead tbody tfoot".split())
SECTIONS = frozenset("thead tbody tfoot".split())
#: Open elements that a start tag closes, and those that it does not look beyond.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"[\s/]*+(=?[^\s/>=]*+)(\s*+=\s*+)?")
BARE = re.compile(r"[^\s>]*+")
COMMENT = re.compile(r"--!?>")
BRACE, SELECTOR = re.compile(r"[{}]"), re.compile(r"[.#]?[\w-]+")
NONE, GONE, SHOWN = (re.compile(x) for x in (r"(?:^|;)\s*display\s*:\s*none", r"(?:^|;)\s*visibility\s*:\s*(?:hidden|collapse)", r"(?:^|;)\s*visibility\s*:\s*visible"))


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


class Scanner:
    """Tags and comments of a page, in order, in one pass."""

    def __init__(self, source: str):
        self.source = source
        # beyond these places no search can succeed
        self.last = {c: source.rfind(c) for c in "\"'>"}

    def find(self, c: str, at: int) -> int:
        """The next place of a quote or bracket, or the end of the page."""
        return self.source.find(c, at) if at <= self.last[c] else len(self.source)

    def attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """Attributes from ``at`` on (the first of a name counts), where the tag ends, and whether it closes itself."""
        source, out = self.source, {}
        while True:
            m = ATTRIBUTE.match(source, at)
            at = m.end()
            value = ""
            if m[2]:
                quote = source[at : at + 1]
                if quote in ("'", '"') and at < self.last[quote]:
                    end = source.find(quote, at + 1)
                    value, at = source[at + 1 : end], end + 1
                else:  # a quote that never closes is a character like any other
                    m2 = BARE.match(source, at)
                    value, at = m2[0], m2.end()
            if m[1]:
                out.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
            if at >= len(source):
                return out, at, False
            if source[at] == ">":
                return out, at + 1, source[at - 1] == "/"

    def tag(self, at: int) -> tuple[int, str, bool, dict[str, str], bool] | None:
        """(end, name, whether it is an end tag, attributes, whether it closes itself) at a "<"; None for mere text.

        Comments and declarations have no name. A tag that the page ends in is dropped, with all that follows.
        """
        source = self.source
        c = source[at + 1 : at + 2]
        if source.startswith("<!--", at):
            m = COMMENT.search(source, at + 2)
            return (m.end() if m else len(source)), "", False, {}, False
        if c in ("!", "?") or (c == "/" and not source[at + 2 : at + 3].isalpha()):
            return (self.find(">", at) + 1 if c else at + 1), "", False, {}, False
        m = NAME.match(source, at + 1 + (c == "/"))
        if not m:
            return None
        if source[m.end() : m.end() + 1] == ">":
            return m.end() + 1, m[0].lower(), c == "/", {}, False
        attrs, end, own = self.attributes(m.end())
        return end, m[0].lower() if source[end - 1] == ">" else "", c == "/", attrs, own


def parse(source: str) -> tuple[Node, str]:
    """The tree of a page, and the text of its style elements."""
    root = Node("html")
    open_, styles, at = [root], [], 0

    def close(tags: set[str], until: set[str]) -> None:
        for depth in range(len(open_) - 1, 0, -1):
            if open_[depth].tag in until:
                return
            if open_[depth].tag in tags:
                del open_[depth:]
                if len(tags) < 3:
                    return

    def text(run: str) -> None:
        if run:
            if open_[-1].tag == "head" and run.strip():
                close({"head"}, set())
            open_[-1].kids.append(html.unescape(run))

    def start(tag: str, attrs: dict[str, str] | None = None, stays: bool = True) -> None:
        node = Node(tag, attrs)
        open_[-1].kids.append(node)
        if stays and len(open_) < DEEP:
            open_.append(node)

    scanner, seek = Scanner(source), 0
    while (here := source.find("<", seek)) >= 0:
        found = scanner.tag(here)
        if found is None:
            seek = here + 1
            continue
        text(source[at:here])
        at = seek = found[0]
        _, tag, ends, attrs, own = found
        if not tag:
            continue
        if ends:
            if tag == "br":
                start("br", stays=False)
            elif tag == "p" and not any(n.tag == "p" for n in open_):
                start("p", stays=False)
            elif tag not in ("html", "body"):
                scope = {"table"} if tag not in ("table", "tr", "td", "th", "caption", *SECTIONS) else set()
                for depth in range(len(open_) - 1, 0, -1):
                    if open_[depth].tag == tag:
                        del open_[depth:]
                        break
                    if open_[depth].tag in scope or (tag not in BLOCKS and open_[depth].tag in ("td", "th", "li")):
                        break
            continue
        if tag in ("html", "body") and (tag == "html" or any(n.tag == "body" for n in open_)):
            continue
        if tag in ENDS_P:
            close({"p"}, {"table", "button", "td", "th"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag == "tr" and open_[-1].tag == "table":
            start("tbody")
        if tag in ("td", "th") and open_[-1].tag in ("table", *SECTIONS):
            if open_[-1].tag == "table":
                start("tbody")
            start("tr")
        if open_[-1].tag == "head" and tag not in ("meta", "link", "base", "script", "style", "title", "template", "noscript"):
            close({"head"}, set())
        foreign = own and any(n.tag in ("svg", "math") for n in open_)
        start(tag, attrs, stays=tag not in VOID and tag not in RAW and not foreign)
        if tag in RAW and not foreign:
            end = _ending(tag).search(source, at)
            body = source[at : end.start() if end else len(source)]
            at = seek = scanner.find(">", end.end()) + 1 if end else len(source)
            if tag == "style":
                styles.append(body)
            elif tag == "textarea":
                open_[-1].kids[-1].kids.append(html.unescape(body))
    text(source[at:])
    return root, "\n".join(styles)


@cache
def _ending(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def _uncommented(styles: str) -> str:
    parts, at = [], 0
    while (start := styles.find("/*", at)) >= 0:
        parts.append(styles[at:start])
        end = styles.find("*/", start + 2)
        at = end + 2 if end >= 0 else len(styles)
    return "".join([*parts, styles[at:]])


def _closing(styles: str, at: int) -> int:
    """The place after the brace that closes the one before ``at``."""
    depth = 1
    for m in BRACE.finditer(styles, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(styles)


def rules(styles: str) -> dict[str, str]:
    """Selectors of one element name, class or id, with their declarations; rules for print alone do not count."""
    out: dict[str, str] = {}
    styles, at = _uncommented(styles), 0
    while (brace := styles.find("{", at)) >= 0:
        names = styles[at:brace].rpartition("}")[2].rpartition(";")[2].strip()
        at = brace + 1
        if names.startswith("@"):
            if not names.startswith(("@media", "@supports", "@layer", "@container")) or ("print" in names and "screen" not in names and "all" not in names):
                at = _closing(styles, at)
            continue
        end = styles.find("}", at)
        body, at = (styles[at:end], end + 1) if end >= 0 else (styles[at:], len(styles))
        for s in names.split(","):
            if SELECTOR.fullmatch(s.strip()):
                out[s.strip()] = out.get(s.strip(), "") + ";" + body.lower()
    return out


class Layout:
    """Lines of visible text of a tree."""

    def __init__(self, sheet: dict[str, str] | None = None):
        self.sheet = {k: v for k, v in (sheet or {}).items() if "display" in v or "visibility" in v}

    def style(self, node: Node) -> str:
        own = node.attrs.get("style", "").lower()
        if not self.sheet:
            return own
        keys = [node.tag, *(f".{c}" for c in node.attrs.get("class", "").split()), f"#{node.attrs.get('id', '')}"]
        return ";".join([*(self.sheet[k] for k in keys if k in self.sheet), own])

    def shown(self, node: Node) -> bool:
        if node.tag in UNSEEN or "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs):
            return False
        return not NONE.search(self.style(node))

    def render(self, node: Node) -> str:
        lines = self.block(node, False, True)
        return "\n".join(line.rstrip() for line in _trim(lines))

    def block(self, node: Node, pre: bool, visible: bool) -> list[str]:
        """Lines of a block's content; an empty line separates paragraphs."""
        lines: list[str] = []
        inline: list[str] = []

        def flush() -> None:
            if inline:
                run = "".join(inline)
                inline.clear()
                if pre:
                    lines.extend(run.strip("\n").split("\n"))
                else:
                    found = [re.sub(r"[ \t\n\r\f]+", " ", part).strip(" ") for part in run.split("\v")]
                    while found and not found[-1]:
                        found.pop()
                    lines.extend(found)

        def gap() -> None:
            if lines and lines[-1] != "":
                lines.append("")

        def walk(kids: list, visible: bool) -> None:
            for kid in kids:
                if isinstance(kid, str):
                    if visible:
                        inline.append(kid if pre else kid.replace("\v", " "))
                    continue
                if not self.shown(kid):
                    continue
                style = self.style(kid) if kid.attrs or self.sheet else ""
                sees = bool(SHOWN.search(style)) or (visible and not GONE.search(style))
                if kid.tag == "br":
                    inline.append("\n" if pre else "\v")
                elif kid.tag == "select":
                    inline.extend(f" {x} " for x in self.chosen(kid) if sees)
                elif kid.tag == "svg":
                    inline.extend(f" {x} " for x in self.drawn(kid, sees))
                elif kid.tag not in BLOCKS:
                    walk(kid.kids, sees)
                else:
                    flush()
                    if kid.tag in PARAGRAPHS and not (kid.tag in ("ul", "ol") and node.tag == "li"):
                        gap()
                    lines.extend(self.element(kid, pre, sees))
                    if kid.tag in PARAGRAPHS and not (kid.tag in ("ul", "ol") and node.tag == "li"):
                        gap()

        kids = node.kids
        if node.tag == "details" and "open" not in node.attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        walk(kids, visible)
        flush()
        return lines

    def element(self, node: Node, pre: bool, visible: bool) -> list[str]:
        if node.tag == "table":
            return self.table(node, visible)
        if node.tag in ("ul", "ol", "menu"):
            return self.items(node, pre, visible)
        if node.tag == "li":
            return _marked(_trim(self.block(node, pre, visible)), "- ")
        lines = self.block(node, pre or node.tag == "pre", visible)
        if node.tag in ("blockquote", "dd"):
            lines = [f"  {line}" if line else line for line in _trim(lines)]
        return lines

    def items(self, node: Node, pre: bool, visible: bool) -> list[str]:
        lines: list[str] = []
        try:
            number = int(node.attrs.get("start", "1"))
        except ValueError:
            number = 1
        for kid in node.kids:
            if isinstance(kid, Node) and kid.tag == "li" and self.shown(kid):
                style = self.style(kid)
                sees = bool(SHOWN.search(style)) or (visible and not GONE.search(style))
                found = _trim(self.block(kid, pre, sees))
                if found:
                    lines += _marked(found, f"{number}. " if node.tag == "ol" else "- ")
                number += 1
            elif isinstance(kid, Node) or kid.strip():
                shell = Node("div")
                shell.kids = [kid]
                lines += [f"  {line}" for line in _trim(self.block(shell, pre, visible))]
        return lines

    def chosen(self, node: Node) -> list[str]:
        """The options that a closed list shows, or all of an open one."""
        options, todo = [], [k for k in reversed(node.kids) if isinstance(k, Node)]
        while todo:
            kid = todo.pop()
            if self.shown(kid):
                options += [kid] if kid.tag == "option" else []
                todo += [k for k in reversed(kid.kids) if isinstance(k, Node)]
        if not ("multiple" in node.attrs or node.attrs.get("size", "1") not in ("", "0", "1")):
            marked = [o for o in options if "selected" in o.attrs]
            options = marked[-1:] or [o for o in options if "disabled" not in o.attrs][:1] or options[:1]
        return [o.attrs.get("label") or " ".join(_strings(o).split()) for o in options]

    def drawn(self, node: Node, visible: bool) -> list[str]:
        """The texts of a drawing."""
        out: list[str] = []
        for kid in node.kids:
            if isinstance(kid, str) or kid.tag in UNDRAWN or not self.shown(kid):
                continue
            style = self.style(kid)
            sees = bool(SHOWN.search(style)) or (visible and not GONE.search(style))
            if kid.tag == "text":
                out += [" ".join(_strings(kid).split())] * sees
            elif kid.tag == "foreignobject":
                out += self.block(kid, False, sees)
            else:
                out += self.drawn(kid, sees)
        return out

    def table(self, node: Node, visible: bool) -> list[str]:
        """Caption, then rows with the lines of their cells in aligned columns."""
        before: list[str] = []
        rows: list[list[tuple[list[str], int, int]]] = []

        def gather(parent: Node, visible: bool) -> None:
            for kid in parent.kids:
                if isinstance(kid, str):
                    if visible and kid.strip():
                        before.append(" ".join(kid.split()))
                    continue
                if not self.shown(kid):
                    continue
                style = self.style(kid)
                sees = bool(SHOWN.search(style)) or (visible and not GONE.search(style))
                if kid.tag in SECTIONS:
                    gather(kid, sees)
                elif kid.tag == "tr":
                    cells = []
                    for cell in kid.kids:
                        if isinstance(cell, Node) and cell.tag in ("td", "th"):
                            if self.shown(cell):
                                own = self.style(cell)
                                seen = bool(SHOWN.search(own)) or (sees and not GONE.search(own))
                                cells.append((_trim(self.block(cell, False, seen)), _span(cell, "colspan", 1000), _span(cell, "rowspan", 65_534)))
                        elif isinstance(cell, Node) or cell.strip():
                            shell = Node("div")
                            shell.kids = [cell]
                            before.extend(_trim(self.block(shell, False, sees)))
                    rows.append(cells)
                else:
                    shell = Node("div")
                    shell.kids = [kid]
                    before.extend(_trim(self.block(shell, False, sees)))

        gather(node, visible)
        # cells at their columns; those that reach down keep their columns in the rows below
        placed: list[list[tuple[int, list[str], int]]] = []
        taken: dict[int, int] = {}
        for cells in rows:
            column, row, below = 0, [], {c: n - 1 for c, n in taken.items() if n > 1}
            for lines, span, down in cells:
                while column in taken:
                    column += 1
                row.append((column, lines, span))
                if down > 1:
                    below |= {c: down - 1 for c in range(column, column + span)}
                column += span
            placed.append(row)
            taken = below
        widths: dict[int, int] = {}
        for row in placed:
            for column, lines, span in row:
                if span == 1:
                    widths[column] = max(widths.get(column, 0), *(len(x) for x in lines), 0)
        starts, at = [0], 0
        for c in range(max((column for row in placed for column, _, _ in row), default=0)):
            at += widths.get(c, 0) + 2
            starts.append(at)
        out = list(before)
        for row in placed:
            for k in range(max((len(lines) for _, lines, _ in row), default=0)):
                line = ""
                for column, lines, _ in row:
                    if k < len(lines):
                        line = line.ljust(starts[column]) if len(line) <= starts[column] else line + "  "
                        line += lines[k]
                out.append(line.rstrip())
        return out


def _span(cell: Node, name: str, most: int) -> int:
    text = cell.attrs.get(name, "1").strip()
    if not (text.isascii() and text.isdigit()):
        return 1
    number = int(text[:6])
    # a row span of 0 reaches to the end
    return most if name == "rowspan" and not number else max(1, min(most, number))


def _strings(node: Node) -> str:
    """All text below a node."""
    out, todo = [], list(reversed(node.kids))
    while todo:
        kid = todo.pop()
        if isinstance(kid, str):
            out.append(kid)
        elif kid.tag not in UNSEEN and kid.tag not in UNDRAWN:
            todo += reversed(kid.kids)
    return "".join(out)


def _trim(lines: list[str]) -> list[str]:
    """Without empty lines at the ends and doubled ones within."""
    out: list[str] = []
    for line in lines:
        if line.strip() or (out and out[-1].strip()):
            out.append(line)
    while out and not out[-1].strip():
        out.pop()
    return out


def _marked(lines: list[str], mark: str) -> list[str]:
    return [(mark if i == 0 else " " * len(mark)) + line if line else line for i, line in enumerate(lines)]


def render(source: str | None) -> str:
    """The visible text of one page; null gives the empty text."""
    if not source:
        return ""
    root, styles = parse(source)
    return Layout(rules(styles)).render(root)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.num_columns - 1
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array([render(x) for x in batch.column(at).to_pylist()], pa.string())], [*batch.schema.names[:at], "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) of each row of ``pages`` (page_id, html).

    Null and empty pages give empty texts, malformed ones what a browser would show of them, in time that grows with
    their length alone; a quote that never closes is a plain character; repeated rows give equal texts; no rows give none. Other columns are not read. One pass, no shuffle; a page at a time in memory.
    """
    batch_rows.bound(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(_rendered, f"page_id {kind}, text string")
