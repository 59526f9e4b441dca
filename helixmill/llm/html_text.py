"""Visible text of HTML pages by layout-aware rendering.

A tokenizer splits a page into tags and text. A tree builder adds what the markup
implies (paragraphs, list items, cells and rows end where the next one starts, stray
end tags are dropped, elements left open end with their parent). Visibility rules
drop what a reader never sees. A renderer walks the tree: blocks are set apart by
line breaks, paragraphs and headings by a blank line, list items carry bullets or
numbers and are indented by depth, preformatted text keeps its spacing, and table
cells are padded to their column's width.

Unseen is what the standard hides, the attribute ``hidden``, and what style sets to
``display: none`` or an invisible ``visibility``, from which a descendant may step out
again. Style is the attribute, then the page's own ``<style>`` rules whose selectors are
made of a name, ids and classes; other selectors and rules under ``@`` are not applied.

The tree is walked with a stack of its own, so depth is bounded by memory, not by
the interpreter. Columns are aligned by code points, up to ``MAX_CELL`` of them;
longer cells stay whole and push what follows. Colspan counts as columns of the
cell, up to ``MAX_SPAN``; rowspan keeps its columns free in the rows below. Items of a
list are numbered by ``start``, ``reversed`` and ``value``.

Cases: null html gives null text; empty html or none visible gives an empty text;
broken markup never raises; rows that repeat count each time; null ids are handed
on; extra columns are not read; a very long page is one row of the slices; an empty
table gives an empty result. Texts under ``aria-hidden`` are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from helixmill.llm.common import bounded_batches, slices

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe canvas audio video datalist area annotation annotation-xml".split())
SVG_HIDDEN = frozenset("desc metadata defs symbol clippath mask pattern marker".split())
APART = frozenset("option optgroup text".split())  # labels set apart by a space
UNREAD = frozenset("hidden checkbox radio range color file image password".split())  # inputs whose value is not text on the page
PUSHED = frozenset("submit button reset".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody thead tfoot tr ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
ENDS_P = BLOCK - frozenset("html body caption tbody thead tfoot tr".split()) | {"xmp"}
#: Start tag: open elements that it ends, and the elements beyond which it does not look.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "body": (("head",), ("html",)),
}
SCOPE = frozenset("table td th caption html button object template".split())
MAX_CELL, MAX_SPAN = 60, 64

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW}
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_AT_RULE = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*(?:\}|\Z))")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)(?:\}|\Z)")
_SELECTOR = re.compile(r"(\*|[a-zA-Z][a-zA-Z0-9]*)?((?:[.#][a-zA-Z0-9_-]+)*)")
_SEEN = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(s: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(s):
        out.setdefault(m[1].lower(), entities.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root", {})
    stack, at, raw = [root], 0, None

    def text(s: str):
        if s:
            stack[-1].children.append(entities.unescape(s))

    def close(index: int):
        del stack[index:]

    def find(names, stop) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                return i
            if stack[i].tag in stop:
                return 0
        return 0

    while True:
        if raw:
            m = _END[raw].search(page, at)
            end = m.start() if m else len(page)
            if raw == "textarea":
                text(page[at:end])
            elif raw == "style":
                root.attrs["style"] = root.attrs.get("style", "") + page[at:end] + "\n"
            elif raw == "xmp" and end > at:
                stack[-1].children.append(page[at:end])
            at = end
            raw = None
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            return root
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not find(("p",), SCOPE):
                stack[-1].children.append(Node("p", {}))
            elif i := find((tag,), () if tag in ("table", "html", "body") else SCOPE - {tag}):
                close(i)
            continue
        if tag in IMPLIED and (i := find(*IMPLIED[tag])):
            close(i)
        if tag in ENDS_P and (i := find(("p",), SCOPE)):
            close(i)
        if tag[0] == "h" and tag[1:].isdigit() and re.fullmatch("h[1-6]", stack[-1].tag):
            close(len(stack) - 1)
        if tag in ("html", "body") and find((tag,), ()):
            continue
        node = Node(tag, _attributes(m[3]) if m[3].strip(" /") else {})
        if tag in SVG_HIDDEN and find(("svg",), ()):
            node.attrs["hidden"] = ""
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        stack.append(node)
        if tag in RAW:
            raw = tag


class Style:
    """What a page's own rules and an element's attributes say of being seen."""

    def __init__(self, css: str):
        self.rules: list[tuple] = []
        if "display" not in css.lower() and "visibility" not in css.lower():
            return
        for i, m in enumerate(_RULE.finditer(_AT_RULE.sub(" ", _COMMENT.sub(" ", css)))):
            said = self._said(m[2])
            for one in m[1].split(",") if said else ():
                if (x := _SELECTOR.fullmatch(one.strip())) and one.strip():
                    names = re.findall(r"[.#][^.#]+", x[2])
                    ids = sum(n[0] == "#" for n in names)
                    tag = x[1].lower() if x[1] and x[1] != "*" else ""
                    self.rules.append(((ids, len(names) - ids, bool(tag), i), tag, frozenset(names), said))
        self.rules.sort(key=lambda r: r[0])

    @staticmethod
    def _said(style: str) -> dict[str, tuple[bool, str]]:
        out: dict[str, tuple[bool, str]] = {}
        for m in _SEEN.finditer(style):
            k, new = m[1].lower(), (bool(m[3]), m[2].lower())
            if new[0] or not out.get(k, (False, ""))[0]:
                out[k] = new
        return out

    def of(self, n: Node) -> dict[str, str]:
        """display and visibility, as far as they are given."""
        found: dict[str, tuple[bool, str]] = {}
        sources = []
        if self.rules:
            names = {f".{c}" for c in n.attrs.get("class", "").split()} | ({f"#{n.attrs['id']}"} if n.attrs.get("id") else set())
            sources = [said for _, tag, wanted, said in self.rules if (not tag or tag == n.tag) and wanted <= names]
        if "style" in n.attrs:
            sources.append(self._said(n.attrs["style"]))
        for said in sources:
            for k, v in said.items():
                if v[0] or not found.get(k, (False, ""))[0]:
                    found[k] = v
        return {k: v for k, (_, v) in found.items()}

    def gone(self, n: Node) -> bool:
        """Not shown, and nothing inside it."""
        a = n.attrs
        if n.tag in HIDDEN or n.tag == "dialog" and "open" not in a:
            return True
        if not a and not self.rules:
            return False
        if a.get("aria-hidden", "").lower() == "true" or n.tag == "input" and a.get("type", "").lower() == "hidden":
            return True
        display = self.of(n).get("display") if self.rules or "style" in a else None
        return display == "none" if display else "hidden" in a

    def shown(self, n: Node, before: bool) -> bool:
        """Visibility, ``before`` being that of what holds the element."""
        v = self.of(n).get("visibility") if self.rules or "style" in n.attrs else None
        return v == "visible" if v in ("visible", "hidden", "collapse") else before


class Page:
    """Lines of rendered text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.space = "", 0, False
        self.prefix: list[str] = []
        self.bullet = ""

    def words(self, s: str):
        parts = _SPACE.split(s)
        if parts[0] == "" and len(parts) > 1:
            self.space = True
        body = " ".join(p for p in parts if p)
        if not body:
            return
        self._open()
        if self.space and self.line and not self.line.endswith("\n"):
            self.line += " "
        self.line += body
        self.space = parts[-1] == ""

    def _open(self):
        if not self.line:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            self.space = False

    def end(self):
        if self.line:
            indent = "".join(self.prefix)
            if self.bullet:
                indent = indent[: len(indent) - len(self.bullet)] + self.bullet
                self.bullet = ""
            self.lines.append((indent + self.line).rstrip(" "))
            self.line, self.gap = "", max(self.gap, 1)
        self.space = False

    def blank(self, n: int = 2):
        self.end()
        self.gap = max(self.gap, n)

    def verbatim(self, lines: list[str]):
        for s in lines:
            self._open()
            self.lines.append(("".join(self.prefix) + s).rstrip(" "))
            self.gap = 1


def _rows(table: Node, style: Style, shown: bool) -> tuple[list[list[tuple[Node, int, int, bool]]], list[tuple[Node, bool]]]:
    """Rows of (cell, columns, rows, shown) and captions of a table, nested tables left to their cells."""
    rows, captions, stack = [], [], [(n, shown) for n in reversed(table.children)]
    loose: list | None = None

    def cell(n: Node, shown: bool) -> tuple[Node, int, int, bool]:
        return n, _span(n, "colspan"), _span(n, "rowspan"), style.shown(n, shown)

    while stack:
        n, shown = stack.pop()
        if isinstance(n, str):
            if n.strip():
                captions.append((n, shown))
        elif style.gone(n):
            continue
        elif n.tag in ("td", "th"):
            if loose is None:
                rows.append(loose := [])
            loose.append(cell(n, shown))
        elif n.tag == "tr":
            loose, cells, shown = None, [], style.shown(n, shown)
            for c in n.children:
                if isinstance(c, str):
                    if c.strip():
                        captions.append((c, shown))
                elif c.tag in ("td", "th"):
                    if not style.gone(c):
                        cells.append(cell(c, shown))
                elif not style.gone(c):
                    captions.append((c, shown))
            rows.append(cells)
        elif n.tag in ("tbody", "thead", "tfoot"):
            stack += [(c, style.shown(n, shown)) for c in reversed(n.children)]
        else:
            captions.append((n, shown))
    return rows, captions


def _span(n: Node, name: str) -> int:
    s = n.attrs.get(name, "1")
    return min(max(int(s), 1), MAX_SPAN) if s.isdecimal() and len(s) < 6 else 1


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Aligned lines of a table whose cells are lines of text, with columns and rows of each."""
    width: dict[int, int] = {}
    taken: dict[int, int] = {}  # column: rows that a cell above still takes there
    placed: list[list[tuple[list[str], int]]] = []
    for cells in rows:
        at, held, row = 0, {c: n - 1 for c, n in taken.items() if n > 1}, []
        for lines, span, high in cells:
            while taken.get(at, 0) > 0:
                at += 1
            row.append((lines, at))
            if span == 1:
                width[at] = max(width.get(at, 0), min(max(map(len, lines), default=0), MAX_CELL))
            if high > 1:
                held |= dict.fromkeys(range(at, at + span), high - 1)
            at += span
        placed.append(row)
        taken = held
    columns = 1 + max((at for row in placed for _, at in row), default=0)
    first = [0]
    for c in range(columns):
        first.append(first[-1] + width.get(c, 0) + 2)
    out = []
    for row in placed:
        for i in range(max((len(lines) for lines, _ in row), default=0)):
            line = ""
            for lines, at in row:
                to = max(first[at], len(line) + 2) if line else first[at]
                if i < len(lines) and lines[i]:
                    line = line.ljust(to) + lines[i]
            out.append(line.rstrip(" "))
    return out


def _render_into(root: Node, page: Page) -> None:
    """Write the visible text of a tree; tables render their cells to pages of their own."""
    style = Style(root.attrs.pop("style", ""))
    stack: list[tuple] = [("node", root, page, [], True)]
    while stack:
        what, n, page, lists, shown = stack.pop()
        if what == "call":
            n()
            continue
        if isinstance(n, str):
            if shown:
                page.words(n)
            continue
        if style.gone(n):
            continue
        shown = style.shown(n, shown)
        tag = n.tag
        if tag == "br":
            if page.line:
                page.end()
            else:
                page.gap = min(page.gap + 1, 2)
            continue
        if tag == "hr":
            page.blank(1)
            continue
        if tag == "img":
            continue
        if tag == "input":
            kind = n.attrs.get("type", "").lower() or "text"
            if shown and kind not in UNREAD and n.attrs.get("value"):
                page.space |= kind not in PUSHED
                page.words(n.attrs["value"])
                page.space |= kind not in PUSHED
            continue
        if tag in ("pre", "textarea", "xmp"):
            page.blank()
            page.verbatim(_verbatim(n, style, shown))
            page.blank()
            continue
        if tag == "table":
            page.blank()
            rows, captions = _rows(n, style, shown)
            cells = [[Page() for _ in r] for r in rows]

            def finish(cells=cells, page=page, rows=rows):
                for r in cells:
                    for p in r:
                        p.end()
                page.verbatim(_table([[(p.lines, wide, high) for p, (_, wide, high, _) in zip(ps, r)] for ps, r in zip(cells, rows)]))
                page.blank()

            stack.append(("call", finish, None, None, True))
            for r, ps in zip(reversed(rows), reversed(cells)):
                for (c, _, _, seen), p in zip(reversed(r), reversed(ps)):
                    stack += [("node", x, p, [], seen) for x in reversed(c.children)]
            stack.append(("call", page.end, None, None, True))
            stack += [("node", x, page, lists, seen) for x, seen in reversed(captions)]
            continue
        if tag in APART:
            page.space = True
            if shown and tag == "optgroup" and n.attrs.get("label"):
                page.words(n.attrs["label"] + " ")
        gap = 0
        inner = lists
        if tag in BLOCK:
            gap = 2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1
            page.blank(gap)
        done = []
        if tag in ("ul", "ol", "menu", "dir"):
            step = -1 if tag == "ol" and "reversed" in n.attrs else 1
            first = sum(not isinstance(c, str) and c.tag == "li" and not style.gone(c) for c in n.children) if step < 0 else 1
            inner = [*lists, [tag == "ol", _whole_number(n.attrs.get("start"), first), step]]
        elif tag == "li":
            kind = lists[-1] if lists else [False, 1, 1]
            kind[1] = _whole_number(n.attrs.get("value"), kind[1])
            bullet = f"{kind[1]}. " if kind[0] else "- "
            kind[1] += kind[2]
            page.bullet = bullet
            page.prefix.append(" " * len(bullet))
            done.append(page.prefix.pop)
        elif tag == "dd":
            page.prefix.append("  ")
            done.append(page.prefix.pop)
        elif tag == "blockquote":
            page.prefix.append("> ")
            done.append(page.prefix.pop)

        def leave(page=page, gap=gap, done=done, li=tag == "li", apart=tag in APART):
            page.space |= apart
            if gap:
                page.blank(gap)
            if li:
                page.bullet = ""
            for f in done:
                f()

        stack.append(("call", leave, None, None, True))
        stack += [("node", x, page, inner, shown) for x in reversed(n.children)]


def _whole_number(s: str | None, otherwise: int) -> int:
    return int(s) if s and re.fullmatch(r"-?\d{1,9}", s, re.A) else otherwise


def _verbatim(n: Node, style: Style, shown: bool) -> list[str]:
    out, stack = [], [(x, shown) for x in reversed(n.children)]
    while stack:
        x, shown = stack.pop()
        if isinstance(x, str):
            out += [x] if shown else []
        elif x.tag == "br":
            out.append("\n")
        elif not style.gone(x):
            stack += [(c, style.shown(x, shown)) for c in reversed(x.children)]
    return "".join(out).replace("\r\n", "\n").strip("\n").split("\n") if any(out) else []


def extract(page: str) -> str:
    """Visible text of a page."""
    root, out = parse(page), Page()
    _render_into(root, out)
    out.end()
    return "\n".join(out.lines).strip("\n")


def extract_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, text, n_chars, n_lines."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [None if x is None else extract(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int64()), pa.array([None if t is None else t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, text string, n_chars long, n_lines long")
