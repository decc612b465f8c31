"""Layout-aware HTML rendering: a tree with implied tags, visibility rules, and text laid out by blocks.

All visible text is emitted, navigation and footers too; only what a browser without scripts would not show
is left out: head, scripts, styles, templates, comments, what a closed ``details`` holds beside its summary, and elements
hidden by ``hidden``, by their style or by the page's style sheets. Selectors of tags, classes and ids, alone or joined by
blanks (within) and ``>`` (child), are obeyed; others, and rules inside @media and the like, are not. What
``visibility`` hides is shown again within an element that it makes visible.

White space collapses but in ``pre``; blocks start new lines, paragraphs and headings are set off by a blank line;
list items get bullets or numbers and their lists' indent; table cells, of any width, are padded to their columns. Columns
without text of their own take no room. The output grows with the input: indents stop growing at INDENTS levels,
a table whose padding would be over PADDING times its text has its cells set apart by two blanks only, and tables
nested more than TABLES deep are laid out as blocks.

Null and empty html render as the empty text. Tags left open at the end are closed, a tag cut off by the
end is dropped, stray end tags are ignored. Pages are rendered row by row: repeats give equal rows. Only page_id and html are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import slices

#: Levels of indents that are told apart, how many blanks a character of a table may cost, and levels of tables.
INDENTS, PADDING, TABLES = 20, 8, 50

# Element classes of the HTML standard.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_HIDDEN = {"head", "script", "style", "template", "title", "iframe", "noembed", "noframes", "object", "audio", "video", "canvas", "datalist", "meta", "link", "base"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section",
    "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "xmp",
}
_SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "article", "section", "xmp"}
_CLOSES_P = _BLOCK - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "option", "optgroup", "legend"}
_HEAD_ONLY = {"base", "link", "meta", "script", "style", "title", "template", "noscript"}
#: tag: (open tags that it ends, tags at which the search for them stops)
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
_GROUPS = {"tbody", "thead", "tfoot"}
_IN_ROWS = {"table", "tr", *_GROUPS}
#: tag: where in a table it belongs
_BELONGS = {"td": _IN_ROWS, "th": _IN_ROWS, "tr": _IN_ROWS - {"tr"}, **dict.fromkeys(("caption", "colgroup", "col", *_GROUPS), {"table"})}
_STAYS = {*_BELONGS, "script", "style", "template", "form"}

_MARKUP = re.compile(
    r"""<!--(?P<comment>.*?(?:--!?>|\Z))|<(?P<bogus>[!?][^>]*(?:>|\Z))|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*+"[^"]*"|=\s*+'[^']*'|[^>])*+)>|<(?P<cut>[a-zA-Z][^>]*\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def parse(text: str) -> Node:
    """The tree of a page. Tags that html lets out are implied: head, body, tbody and tr, and ends of elements.

    What stands between the cells or rows of a table goes before the table, as browsers put it."""
    root = Node("html")
    stack = [root]
    open_: dict[str, int] = {"html": 1}  # how many of each tag are open

    loose = None  # the table that loose content was put before last

    def table_at() -> int:
        """The place of the table if its next content would stand outside its cells, or else 0."""
        i = len(stack) - 1
        while stack[i].tag in _IN_ROWS and stack[i].tag != "table":
            i -= 1
        return i if stack[i].tag == "table" else 0

    def before_table(at: int, node: Node | str) -> None:
        nonlocal loose
        children = stack[at - 1].children  # an open table is the last of its parent's children
        children.insert(len(children) - 1, node)
        loose = stack[at]

    def keep_apart() -> None:
        """Loose content before and after a cell or row does not run together."""
        if (at := table_at()) and loose is stack[at]:
            before_table(at, " ")

    def push(tag: str, attrs: dict[str, str] | None = None) -> None:
        node = Node(tag, attrs)
        hidden = tag == "input" and node.attrs.get("type", "").lower() == "hidden"
        if stack[-1].tag in _IN_ROWS and tag not in _STAYS and not hidden and (at := table_at()):
            before_table(at, node)
        else:
            stack[-1].children.append(node)
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1

    def pop_to(size: int) -> None:
        while len(stack) > size:
            open_[stack.pop().tag] -= 1

    def end(tags: set[str], stops: set[str]) -> None:
        if not any(open_.get(t) for t in tags):
            return
        size = len(stack)
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stops:
                break
            if stack[i].tag in tags:
                size = i
        pop_to(size)

    def into_body() -> None:
        if open_.get("head"):
            end({"head"}, set())
        if not open_.get("body"):
            push("body")

    def add_text(part: str) -> None:
        if not part:
            return
        if not open_.get("body") and not part.isspace() and not open_.get("noscript"):
            into_body()
        part = html.unescape(part) if "&" in part else part
        blank = part.isspace()
        if stack[-1].tag == "colgroup" and not blank:
            pop_to(len(stack) - 1)
        if stack[-1].tag in _IN_ROWS and (at := table_at()) and (not blank or loose is stack[at]):
            before_table(at, " " if blank else part)
        else:
            stack[-1].children.append(part)

    def start(tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            root.attrs = attrs | root.attrs
            return
        if tag == "head":
            if not open_.get("head") and not open_.get("body"):
                push("head", attrs)
            return
        if tag == "body":
            if not open_.get("body"):
                end({"head"}, set())
                push("body", attrs)
            return
        if not open_.get("body"):
            if tag in _HEAD_ONLY:
                if not open_.get("head"):
                    push("head")
            else:
                into_body()
        if tag in _CLOSES_P and open_.get("p"):
            end({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if tag in _ENDS:
            end(*_ENDS[tag])
        if stack[-1].tag == "colgroup" and tag not in ("col", "template"):
            pop_to(len(stack) - 1)
        if tag in _BELONGS and open_.get("table") and not (tag == "col" and stack[-1].tag == "colgroup"):
            size = len(stack)
            while stack[size - 1].tag not in _BELONGS[tag]:
                size -= 1
            pop_to(size)
            keep_apart()
        if tag == "table" and stack[-1].tag in _IN_ROWS and (at := table_at()):
            pop_to(at)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            start("tr", {})
        if tag == "tr" and stack[-1].tag == "table":
            push("tbody")
        in_rows = tag == "form" and stack[-1].tag in _IN_ROWS and table_at()  # such a form holds nothing
        push(tag, attrs)
        if tag in _VOID or in_rows:
            pop_to(len(stack) - 1)

    at, styles = 0, []
    while at < len(text):
        found = _MARKUP.search(text, at)
        if not found:
            add_text(text[at:])
            break
        add_text(text[at : found.start()])
        at = found.end()
        if tag := found["tag"]:
            tag = tag.lower()
            attrs = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(found["attrs"])} if found["attrs"].strip(" /\t\n\r") else {}
            start(tag, attrs)
            if tag in _RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(text, at)
                raw = text[at : close.start() if close else len(text)]
                stack[-1].children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
                if tag == "style" and (_NONE.search(raw) or _VISIBILITY.search(raw)):
                    styles.append(raw)
                at = close.end() if close else len(text)
                pop_to(len(stack) - 1)
        elif tag := found["end"]:
            tag = tag.lower()
            if tag == "br":
                start("br", {})
            elif tag == "p" and not open_.get("p"):
                start("p", {})
                pop_to(len(stack) - 1)
            elif tag not in ("body", "html") and open_.get(tag):
                stops = set() if tag in ("table", "head") else {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") else {"td", "th", "table"}
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop_to(i)
                        if tag in _BELONGS:
                            keep_apart()
                        break
                    if stack[i].tag in stops:
                        break
    if styles:
        _apply_styles(root, "\n".join(styles))
    return root


_AT_RULE = re.compile(r"/\*.*?\*/|@[^{};]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}|@[^{};]*;", re.S)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")


def _selector(text: str) -> list[tuple[str, frozenset[str]]] | None:
    """The parts of a selector from the last to the first: how each stands to the part after it, and its names."""
    found, how = [], " "
    for word in text.replace(">", " > ").split():
        if word == ">":
            how = ">"
            continue
        m = _COMPOUND.fullmatch(word)
        if not m:
            return None
        tag = {m[1].lower()} if m[1] and m[1] != "*" else set()
        found.append((how, frozenset(tag | set(re.findall(r"[.#][\w-]+", m[2])))))
        how = " "
    return [(found[i + 1][0] if i + 1 < len(found) else "", names) for i, (_, names) in reversed(list(enumerate(found)))]


def _apply_styles(root: Node, css: str) -> None:
    """Marks elements that the page's own style sheets hide or make visible."""
    rules: dict[str, list] = defaultdict(list)  # by a name of their last part
    for selectors, body in _RULE.findall(_AT_RULE.sub(" ", css)):
        shown = _VISIBILITY.findall(body)
        effect = "none" if _NONE.search(body) else shown[-1].lower() if shown else ""
        for text in selectors.split(",") if effect else ():
            if parts := _selector(text):
                rules[min(parts[0][1], default="*")].append((parts, effect))
    if not rules:
        return
    path: list[set[str]] = []  # names of the elements above
    above: Counter = Counter()
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        if leaving:
            above.subtract(path.pop())
            continue
        id_ = node.attrs.get("id", "").strip()
        own = {node.tag, *("." + c for c in node.attrs.get("class", "").split()), *({"#" + id_} if id_ else ())}
        for name in (*own, "*"):
            for parts, effect in rules.get(name, ()):
                if parts[0][1] <= own and all(above[n] > 0 for _, names in parts[1:] for n in names) and _stands(parts[1:], path):
                    node.attrs["hidden" if effect == "none" else "_visibility"] = effect
        path.append(own)
        above.update(own)
        todo.append((node, True))
        todo += [(c, False) for c in node.children if not isinstance(c, str)]


def _stands(parts: list[tuple[str, frozenset[str]]], path: list[set[str]]) -> bool:
    """Do the elements above match the parts before the last, from the innermost on?"""
    ends = {len(path)}  # where the element stands that the part before has matched
    for how, names in parts:
        places = (e - 1 for e in ends if e) if how == ">" else range(max(ends))
        ends = {i for i in places if names <= path[i]}
        if not ends:
            return False
    return True


def _shown(node: Node) -> bool:
    if node.tag in _HIDDEN or "hidden" in node.attrs:
        return False
    if node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
        return False
    return not ("style" in node.attrs and _NONE.search(node.attrs["style"]))


def _visibility(node: Node) -> str:
    """What an element's own style, or else the style sheets, say of visibility."""
    found = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else ()
    return found[-1].lower() if found else node.attrs.get("_visibility", "")


class _Page:
    """Lines so far, the open line, and the gap that is due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0  # 0: go on, 1: new line, 2: blank line
        self.indent, self.indents = "", [""]  # now, and of each open level
        self.mark = ""

    def block(self, gap: int) -> None:
        self.gap = max(self.gap, gap)
        self.space = False

    def _begin(self) -> None:
        if self.gap:
            self._end_line()
            if self.gap == 2 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
        if not self.line:
            self.line.append(self.indents[-2] + self.mark if self.mark else self.indent)
            self.mark, self.space = "", False

    def deeper(self, width: int) -> None:
        self.indent = self.indent + " " * width if len(self.indents) <= INDENTS else self.indent
        self.indents.append(self.indent)

    def back(self) -> None:
        self.indents.pop()
        self.indent = self.indents[-1]

    def _end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []

    def text(self, part: str) -> None:
        words = _SPACES.sub(" ", part)
        if words == " ":
            self.space = self.space or bool(self.line and not self.gap)
            return
        inner = words.strip(" ")
        fresh = not self.line or self.gap
        self._begin()
        if not fresh and (self.space or words[0] == " "):
            self.line.append(" ")
        self.line.append(inner)
        self.space = words[-1] == " "

    def literal(self, part: str) -> None:
        for i, line in enumerate(part.split("\n")):
            if i:
                self.newline()
            if line:
                self._begin()
                self.line.append(line)
        self.space = False

    def newline(self) -> None:
        if self.gap or not self.line:
            self._begin()
        self._end_line()
        self.space = False

    def cell(self) -> None:
        self.space = True

    def done(self) -> str:
        self._end_line()
        return "\n".join(self.lines).strip("\n")


def _cells(table: Node) -> tuple[list[Node], list[list[tuple[Node, int]]]]:
    """Captions, and each row's cells with the columns that they span; spanned rows get empty cells."""
    captions, rows, down = [], [], {}
    todo = list(reversed(table.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str) or not _shown(node):
            continue
        if node.tag == "tr":
            row, at = [], 0
            for c in node.children:
                if isinstance(c, str) or c.tag not in ("td", "th") or not _shown(c):
                    continue
                while down.get(at, 0) > 0:
                    down[at] -= 1
                    row.append((Node("td"), 1))
                    at += 1
                wide, tall = (min(1000, int(v)) if (v := c.attrs.get(k, "1").strip()).isascii() and v.isdigit() and int(v) else 1 for k in ("colspan", "rowspan"))
                row.append((c, wide))
                for i in range(at, at + wide if tall > 1 else at):
                    down[i] = tall - 1
                at += wide
            rows.append(row)
        elif node.tag in ("tbody", "thead", "tfoot"):
            todo += reversed(node.children)
        else:
            captions.append(node)
    return captions, rows


def _table(page: _Page, table: Node, depth: int, visible: bool) -> None:
    captions, rows = _cells(table)
    for node in captions:
        page.block(1)
        _lay_out(page, [node], depth, visible)
        page.block(1)
    # Cells keep their lines side by side; the parser has put loose content before the table.
    laid = []
    for row in rows:
        own = []
        for c, wide in row:
            said = _visibility(c)
            own.append((render(c.children, depth + 1, said == "visible" if said else visible).split("\n"), wide))
        laid.append(own)
    widths: list[int] = []
    for row in laid:
        at = 0
        for lines, wide in row:
            widths += [0] * (at + wide - len(widths))
            if wide == 1:
                widths[at] = max(widths[at], max(map(len, lines)))
            at += wide
    before, columns = [0], [0]  # of the columns before: their width, and how many have text of their own
    for w in widths:
        before.append(before[-1] + w)
        columns.append(columns[-1] + (w > 0))
    room = lambda at, end: before[end] - before[at] + 2 * max(0, columns[end] - columns[at] - 1)
    text = sum(len(x) for row in laid for lines, _ in row for x in lines)
    aligned = sum(room(0, sum(wide for _, wide in row)) * max((len(lines) for lines, _ in row), default=0) for row in laid) <= PADDING * text + 4096
    for row in laid:
        if not any(line for lines, _ in row for line in lines):
            continue
        for k in range(max(len(lines) for lines, _ in row)):
            parts, at = [], 0
            for lines, wide in row:
                line = lines[k] if k < len(lines) else ""
                if line or columns[at + wide] > columns[at]:
                    parts.append(line.ljust(room(at, at + wide)) if aligned else line)
                at += wide
            page.block(1)
            page.literal("  ".join(parts if aligned else filter(None, parts)).rstrip(" "))
    page.block(1)


def _number(attrs: dict[str, str]) -> int:
    value = attrs.get("start", "1").strip()
    return int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else 1


def _lay_out(page: _Page, nodes: list, depth: int = 0, visible: bool = True) -> None:
    todo: list = [(x, False) for x in reversed(nodes)]
    seen = [visible]
    counters: list[list] = []  # of open lists: [ordered, next number]
    pre = 0
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            if seen[-1]:
                page.literal(node) if pre else page.text(node)
            continue
        tag = node.tag
        if leaving:
            seen.pop()
            if tag in ("pre", "xmp", "textarea"):
                pre -= 1
            elif tag in ("ul", "ol", "menu", "dir"):
                counters.pop()
            if tag in ("li", "dd", "blockquote"):
                page.back()
                if tag == "li":
                    page.mark = ""
            if tag in _BLOCK:
                page.block(2 if tag in _SPACED and not (tag in ("ul", "ol") and counters) else 1)
            continue
        if not _shown(node):
            continue
        if tag == "br":
            page.newline()
            continue
        if said := _visibility(node):
            visible = said == "visible"
        else:
            visible = seen[-1]
        if tag == "table" and depth < TABLES:
            page.block(2)
            _table(page, node, depth, visible)
            page.block(2)
            continue
        if tag in ("td", "th"):
            page.cell()
        if tag in _BLOCK:
            page.block(2 if tag in _SPACED and not (tag in ("ul", "ol") and counters) else 1)
        if tag in ("ul", "ol", "menu", "dir"):
            counters.append([tag == "ol", _number(node.attrs)])
        elif tag == "li":
            mark = "- "
            if counters and counters[-1][0]:
                mark = f"{counters[-1][1]}. "
                counters[-1][1] += 1
            page.deeper(len(mark))
            page.mark = mark
        elif tag in ("dd", "blockquote"):
            page.deeper(2)
        elif tag in ("pre", "xmp", "textarea"):
            pre += 1
        todo.append((node, True))
        seen.append(visible)
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [x for x in children if not isinstance(x, str) and x.tag == "summary"][:1]
        if tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        todo += [(x, False) for x in reversed(children)]


def render(nodes: list, depth: int = 0, visible: bool = True) -> str:
    page = _Page()
    _lay_out(page, nodes, depth, visible)
    return page.done()


def render_page(text: str | None) -> str:
    return render([parse(text)]) if text else ""


def render_pages(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars and n_lines of every page. Map only."""
    kind = pages.schema["page_id"].dataType

    def run(batches):
        for batch in slices(batches):
            texts = [render_page(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for x in texts], pa.int64())], schema=out)

    out = pa.schema([("page_id", to_arrow_type(kind)), ("text", pa.string()), ("n_chars", pa.int64()), ("n_lines", pa.int64())])
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind.simpleString()}, text string, n_chars long, n_lines long")
