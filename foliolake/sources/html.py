"""HTML: headings with what follows them among their siblings, and tables with their spans laid out."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .common import Parsed, decoded, stem_of, table

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template", "noscript"))
_LEVEL = dict(zip(("h1", "h2", "h3", "h4", "h5", "h6"), range(1, 7)))
_CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Elements that an open element of the same kind must not be closed through.
_WALLS = frozenset(("table", "ul", "ol", "dl", "select", "div", "article", "section", "body"))
#: A sign that begins no reference, if references must end with a semicolon.
_OPEN = re.compile("&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)")


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs=(), parent: Node | None = None):
        self.name, self.attrs, self.children, self.parent = name, dict(attrs), [], parent

    def walk(self):
        """All elements below, in reading order; without recursion, as pages may nest deeply."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self):
        stack = self.children[::-1]
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                if c.strip():
                    yield c.strip()
            elif c.name not in _HIDDEN:
                stack += c.children[::-1]


class _Tree(HTMLParser):
    """Builds a tree; comments, scripts and styles have no text in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root")

    def handle_starttag(self, tag, attrs):
        shut = _CLOSES.get(tag, set()) | ({"p"} if tag in _LEVEL or tag in ("table", "ul", "ol", "div", "article", "section") else set())
        node = self.at
        while node.parent is not None and node.name not in _WALLS:
            if node.name in shut:
                self.at = node.parent
                break
            node = node.parent
        child = Node(tag, attrs, self.at)
        self.at.children.append(child)
        if tag not in _VOID:
            self.at = child

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(text: str) -> Node:
    t = _Tree()
    t.feed(text)
    t.close()
    return t.root


def grid_of(rows: list[Node]) -> list[list[str]]:
    """Cells by row and column; a spanning cell's text is in every place that it covers."""
    taken: dict[tuple[int, int], str] = {}
    for r, row in enumerate(rows):
        column = 0
        for cell in (c for c in row.children if isinstance(c, Node) and c.name in ("td", "th")):
            while (r, column) in taken:
                column += 1
            down, across = (_span(cell.attrs.get(k)) for k in ("rowspan", "colspan"))
            text = " ".join(cell.strings())
            for i in range(r, min(r + down, len(rows))):
                for j in range(column, column + across):
                    taken.setdefault((i, j), text)
            column += across
    width = max((c for _, c in taken), default=-1) + 1
    return [[taken.get((r, column), "") for column in range(width)] for r in range(len(rows))]


def _span(value: str | None) -> int:
    try:
        return min(max(int(value or 1), 1), 1000)
    except ValueError:
        return 1


def table_of(node: Node, index: int) -> dict | None:
    grid = grid_of([n for n in node.walk() if n.name == "tr"])
    if not (grid and any(grid[0])):
        return None
    caption = next((" ".join(n.strings()) for n in node.walk() if n.name == "caption"), None)
    return table(f"tbl_{index + 1:03d}", grid[0], [row for row in grid[1:] if "".join(row).strip()], caption)


def parse(data: bytes, path: str, *, closed: bool = False) -> Parsed:
    """Sections of a page. A reference without its semicolon ("&amp" at the end of a cut title) is decoded as browsers do; with ``closed`` it is text, as in XML."""
    text = decoded(data)
    root = tree(_OPEN.sub("&amp;", text) if closed else text)
    nodes = list(root.walk())
    first = lambda name: next(("".join(n.strings()) if name == "title" else " ".join(n.strings()) for n in nodes if n.name == name), "")
    out = Parsed(first("title") or first("h1") or stem_of(path))
    heads = [n for n in nodes if n.name in _LEVEL]
    if not heads:
        body = "\n".join(s for n in root.children for s in ([n.strip()] if isinstance(n, str) else n.strings()) if s)
        if body:
            out.add("Document", 1, body)
        return out
    for head in heads:
        row = out.add(" ".join(head.strings()), _LEVEL[head.name], "")
        parts, siblings = [], head.parent.children
        for node in siblings[siblings.index(head) + 1 :]:
            if isinstance(node, str):
                parts.append(node.strip())
            elif node.name in _LEVEL:
                break
            elif node.name == "table":
                found = table_of(node, len(row["tables"]))
                if found:
                    row["tables"].append(found)
            elif node.name not in _HIDDEN:
                parts.append(" ".join(node.strings()))
        row["text"] = " ".join(p for p in parts if p)
    return out
