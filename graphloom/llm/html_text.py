"""HTML to text by layout-aware rendering.

A tree builder closes what HTML implies to be closed (paragraphs, list items, table parts),
visibility rules drop what a browser doesn't show, and a renderer lays out the rest: one line a
block, a blank line around paragraphs and the like, list markers with indentation, cells of a
table padded to the widths of their columns, over spanned columns and rows too; a cell of several
lines, such as a list or a table inside, takes several lines of its row.

Rules of the layout that keep any page's text in proportion to the page: a table whose padding
would pass SPARSE times its letters has its cells one below the other; tables inside more than
DEPTH tables are plain blocks; indentation grows up to INDENT columns; row spans are followed in the
first SPANNED columns. No text is dropped by them.

Scale: a map over the scan; a page is held as one flat list of nodes and rendered without
recursion, in time and memory in proportion to its length, whatever its markup: the tokenizer
remembers what it has found not to close, and the tree builder keeps stacks of the open elements
that each rule asks for.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table


def words(s: str) -> frozenset[str]:
    return frozenset(s.split())


#: Fixed values of HTML.
VOID = words("area base br col embed hr img input link meta param source track wbr")
RAW = words("script style textarea title xmp iframe noembed noframes plaintext")
HIDDEN = words("head script style template noscript title iframe object canvas audio video datalist param noembed noframes link meta base col colgroup defs desc metadata symbol annotation annotation-xml")
ESCAPABLE = words("textarea title")
TYPED = words("text search submit button reset email url tel number")
BLOCK = words(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table ul tr td th thead tbody tfoot caption option optgroup"
)
SPACED = words("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote hr figure")
ENDS_P = words("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul")
#: Opening the key closes open elements of the first set, up to the nearest of the second.
IMPLIED = {
    "li": (words("li"), words("ul ol menu dir table td th")),
    "dt": (words("dt dd"), words("dl table td th")),
    "dd": (words("dt dd"), words("dl table td th")),
    "option": (words("option"), words("select datalist optgroup")),
    "select": (words("select option optgroup"), words("table td th")),
    "tr": (words("tr td th caption colgroup"), words("table thead tbody tfoot")),
    "td": (words("td th caption"), words("tr table")),
    "th": (words("td th caption"), words("tr table")),
    "thead": (words("thead tbody tfoot tr td th caption colgroup"), words("table")),
    "tbody": (words("thead tbody tfoot tr td th caption colgroup"), words("table")),
    "tfoot": (words("thead tbody tfoot tr td th caption colgroup"), words("table")),
    "body": (words("head"), words("html")),
}
#: The p key is for all elements of ENDS_P.
RULES = IMPLIED | {"p": (words("p"), words("table td th caption button object"))}
#: tag -> the keys of RULES that ask for it.
ASKED = {t: tuple(k for k, (names, limit) in RULES.items() if t in names | limit) for t in frozenset().union(*(n | limit for n, limit in RULES.values()))}
CELLS = words("td th table")
THROUGH_CELLS = words("table tr thead tbody tfoot td th body html")
HEADINGS = words("h1 h2 h3 h4 h5 h6")
SPARSE, DEPTH, INDENT, SPANNED = 8, 16, 64, 256

NAME = re.compile(r"""[a-zA-Z][^\s/<>"']*""")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")
NO_BOX = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
REFERENCE = re.compile(r"&#0*([0-9]+);?")


def unescape(s: str) -> str:
    """Character references as characters; numbers beyond all characters as the replacement character."""
    if "&" not in s:
        return s
    if "&#" in s:
        s = REFERENCE.sub(lambda m: f"&#{m[1]};" if len(m[1]) < 8 else "\ufffd", s)
    return html.unescape(s)


def tokens(source: str) -> Iterator[tuple[str, str, str, int]]:
    """("text", text, "", end), ("open", name, attributes, end) or ("close", name, "", end) of a page.

    What looks like a tag but never ends is text. The receiver may send the place to go on from.
    """
    at, size, last, stop = 0, len(source), source.rfind(">"), -1
    failed: set[int] = set()  # quotes that open outside of others and after which no tag ends

    def next_stop(pos: int) -> int:
        m = STOP.search(source, pos)
        return m.start() if m else size

    while at < size:
        lead = source.find("<", at)
        if lead != at:
            end = size if lead < 0 else lead
            yield "text", source[at:end], "", end
            at = end
            continue
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if at > last:  # no tag any more
            end = source.find("<!--", at)
            yield "text", source[at : size if end < 0 else end], "", at
            at = size if end < 0 else end
            continue
        if at < last:
            after = source[at + 1]
            if after in "!?":
                at = source.index(">", at) + 1
                continue
            if after == "/" and (m := NAME.match(source, at + 2)):
                at = source.index(">", m.end()) + 1
                yield "close", m[0].lower(), "", at
                continue
            if m := NAME.match(source, at + 1):
                if stop < m.end():  # else it is the first one from here on, too
                    stop = next_stop(m.end())
                end, walked = stop, []
                while end < size and source[end] != ">" and end not in failed:
                    walked.append(end)
                    shut = source.find(source[end], end + 1)
                    end = next_stop(shut + 1) if shut >= 0 else size
                if end < size and source[end] == ">":
                    went = yield "open", m[0].lower(), source[m.end() : end], end + 1
                    at = went or end + 1
                    continue
                failed.update(walked)
        end = source.find("<", at + 1)
        end = size if end < 0 else end
        yield "text", source[at:end], "", end
        at = end


class Tree:
    """A flat tree: kind[i] is a tag or "" for text, text[i] its text, attrs[i], and children[i]."""

    def __init__(self, source: str):
        self.tag, self.text, self.attrs, self.children = ["#root"], [""], [{}], [[]]
        tag, open_ = self.tag, [0]
        #: Places in open_ of the open elements by name, by rule that asks for them, and of cells and tables.
        by_name: dict[str, list[int]] = {}
        by_rule: dict[str, list[int]] = {k: [] for k in RULES}
        cells: list[int] = [0]

        def add(name: str, text: str, attrs: dict) -> int:
            tag.append(name), self.text.append(text), self.attrs.append(attrs), self.children.append([])
            self.children[open_[-1]].append(len(tag) - 1)
            return len(tag) - 1

        def push(node: int) -> None:
            name, k = tag[node], len(open_)
            open_.append(node)
            by_name.setdefault(name, []).append(k)
            for rule in ASKED.get(name, ()):
                by_rule[rule].append(k)
            if name in CELLS:
                cells.append(k)

        def pop_to(k: int) -> None:
            while len(open_) > k:
                name = tag[open_.pop()]
                by_name[name].pop()
                for rule in ASKED.get(name, ()):
                    by_rule[rule].pop()
                if name in CELLS:
                    cells.pop()

        def close(rule: str) -> None:
            """Close the outermost open element that the rule closes above the nearest of its limit."""
            names, asked, k = RULES[rule][0], by_rule[rule], 0
            for i in range(len(asked) - 1, -1, -1):
                if tag[open_[asked[i]]] not in names:
                    break
                k = asked[i]
            if k:
                pop_to(k)

        stream = tokens(source)
        token = next(stream, None)
        while token:
            kind, name, inside, at = token
            went = None
            if kind == "text":
                add("", unescape(name), {})
            elif kind == "open":
                if tag[open_[-1]] == "head" and name not in HIDDEN and name not in ("head", "html"):
                    pop_to(len(open_) - 1)  # the body is implied
                if name in IMPLIED:
                    close(name)
                if name in ENDS_P:
                    close("p")
                if name in HEADINGS and tag[open_[-1]] in HEADINGS:
                    pop_to(len(open_) - 1)
                attrs = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(inside)} if inside.strip(" /\n\t") else {}
                node = add(name, "", attrs)
                if name in RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                    stop = source.find(">", end.end()) if end else -1
                    inner, went = (source[at : end.start()], stop + 1) if stop >= 0 else (source[at:], len(source))
                    push(node), add("", unescape(inner) if name in ESCAPABLE else inner, {}), pop_to(len(open_) - 1)
                elif name not in VOID and not (inside.endswith("/") and by_name.get("svg")):
                    push(node)
            elif name == "br":
                add("br", "", {})
            elif name == "p" and not by_name.get("p"):
                add("p", "", {})
            elif by_name.get(name) and (name in THROUGH_CELLS or by_name[name][-1] >= cells[-1]):
                pop_to(by_name[name][-1])
            try:
                token = stream.send(went) if went else next(stream)
            except StopIteration:
                break

    def hidden_options(self) -> set[int]:
        """The options a browser doesn't show: of each select element's own options (those inside no select nearer to them), it
        shows all of a list, else the selected one or the first."""
        own: dict[int, list[int]] = {}
        stack: list[tuple[int, int]] = [(0, -1)]
        while stack:
            x, select = stack.pop()
            if self.tag[x] == "option" and select >= 0:
                own.setdefault(select, []).append(x)
            elif self.tag[x] == "select":
                select = x
            stack.extend((y, select) for y in reversed(self.children[x]))
        hidden: set[int] = set()
        for select, found in own.items():
            size = self.attrs[select].get("size", "")
            if not ("multiple" in self.attrs[select] or re.fullmatch(r"\d{1,9}", size) and int(size) > 1):
                hidden.update(found)
                hidden.difference_update([x for x in found if "selected" in self.attrs[x]][-1:] or found[:1])
        return hidden


def width(s: str) -> int:
    """Columns of a fixed-width font: wide letters take two, combining marks none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines under construction: words are joined by single blanks, blocks end the line."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # a blank is due before the next word
        self.gap = False  # an empty line is due before the next line
        self.prefix, self.marker = "", ""

    def inline(self, text: str) -> None:
        flat = SPACE.sub(" ", text)
        core = flat.strip(" ")
        if not core:
            self.blank = self.blank or bool(flat and self.line)
            return
        if self.line and (self.blank or flat[0] == " "):
            self.line.append(" ")
        self.line.append(core)
        self.blank = flat[-1] == " "

    def end(self) -> None:
        """End the line, if anything is on it."""
        if self.line:
            self.put("".join(self.line))
        self.line, self.blank = [], False

    def put(self, text: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.marker or self.prefix) + text)
        if self.marker:
            self.marker = ""


class Table:
    """The cells of a table: (row, column, lines)."""

    def __init__(self):
        self.cells: list[tuple[int, int, list[str]]] = []
        self.row, self.column = -1, 0
        self.until: dict[int, int] = {}  # column -> last row that a cell above reaches into

    def next_row(self) -> None:
        self.row, self.column = self.row + 1, 0

    def add(self, lines: list[str], columns: int, rows: int) -> None:
        if self.row < 0:
            self.next_row()
        while self.column < SPANNED and self.until.get(self.column, -1) >= self.row:
            self.column += 1
        if lines:
            self.cells.append((self.row, self.column, lines))
        if rows > 1:
            self.until.update(dict.fromkeys(range(self.column, min(self.column + columns, SPANNED)), self.row + rows - 1))
        self.column += columns

    def lines(self) -> list[str]:
        """One line a row, or as many as its longest cell has; cells are padded to the width of their column, columns are two blanks apart."""
        wide: dict[int, int] = {}
        for _, c, lines in self.cells:
            wide[c] = max(wide.get(c, 0), max(map(width, lines)))
        place, at = {}, 0
        for c in sorted(wide):
            place[c], at = at, at + wide[c] + 2
        letters = sum(len(x) - x.count(" ") for _, _, lines in self.cells for x in lines)
        out: list[list] = []
        room, row, k = SPARSE * letters + 256, -1, 0
        for r, c, lines in self.cells:
            if r != row:
                row, k = r, len(out)
            for i, x in enumerate(lines):
                if k + i == len(out):
                    out.append([0])
                line = out[k + i]
                if x:
                    line.append(" " * (place[c] - line[0]) + x)
                    room -= place[c] - line[0] + len(x)
                    line[0] = place[c] + width(x)
                if room < 0:
                    return [x for _, _, lines in self.cells for x in lines]
        return ["".join(line[1:]) for line in out]


def number(text: str, most: int) -> int:
    return min(max(1, int(text)), most) if re.fullmatch(r"\d{1,9}", text) else 1


def render(source: str) -> str:
    """The visible text of a page, laid out."""
    tree = Tree(source)
    pages: list[Page] = [Page()]
    stack: list[tuple] = [("open", 0, True)]  # (step, node, whether visibility is on, or what the step restores)
    lists: list[list] = []  # of open lists: [ordered, number]
    tables: list[Table | None] = []
    hidden_options = tree.hidden_options() if "select" in tree.tag else set()
    pre = 0
    while stack:
        step, x, how = stack.pop()
        page, tag = pages[-1], tree.tag[x]
        if step == "open":
            if not tag:
                if not how:
                    continue
                if pre:
                    for k, part in enumerate(tree.text[x].split("\n")):
                        if k:
                            page.put("".join(page.line).rstrip()) if page.line or page.lines else None
                            page.line = []
                        if part:
                            page.line.append(part.rstrip("\r"))
                else:
                    page.inline(tree.text[x])
                continue
            attrs = tree.attrs[x]
            if tag in HIDDEN or x in hidden_options:
                continue
            if attrs:
                style = attrs.get("style", "")
                if "hidden" in attrs or NO_BOX.search(style):
                    continue
                if own := VISIBILITY.findall(style):
                    how = own[-1].lower() == "visible"
            if tag == "br":
                if page.line:
                    page.end()
                continue
            if tag in ("img", "input"):
                said = attrs.get("alt", "") if tag == "img" else attrs.get("value", "") if attrs.get("type", "text").lower() in TYPED else ""
                if how and said.strip():
                    page.inline(f" {said} ")
                continue
            if tag in BLOCK:
                page.end()
                page.gap = page.gap or tag in SPACED and not (tag in ("ul", "ol") and lists)
            if tag == "hr":
                if how:
                    page.put("---")
                page.gap = True
                continue
            if tag in ("ul", "ol", "menu", "dir"):
                start = attrs.get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                own = lists[-1] if lists else [False, 1]
                mark = f"{own[1]}. " if own[0] else "- "
                own[1] += 1
                stack.append(("prefix", x, page.prefix))
                if len(page.marker) < INDENT:
                    page.marker = (page.marker or page.prefix) + mark
                if len(page.prefix) < INDENT:
                    page.prefix += " " * len(mark)
            elif tag == "dd" or tag == "blockquote":
                stack.append(("prefix", x, page.prefix))
                if len(page.prefix) < INDENT:
                    page.prefix += "  " if tag == "dd" else "> "
            elif tag == "table":
                tables.append(Table() if len(tables) < DEPTH else None)
            elif tag == "tr" and tables and tables[-1]:
                tables[-1].next_row()
            elif tag in ("td", "th") and tables and tables[-1]:
                pages.append(Page())
                stack.append(("cell", x, (lists, tables[-1])))
                lists = []
            elif tag == "pre":
                pre += 1
            stack.append(("close", x, None))
            stack.extend(("open", c, how) for c in reversed(tree.children[x]))
            continue
        if step == "prefix":
            page.end()
            page.prefix, page.marker = how, ""
            continue
        if step == "cell":
            page.end()
            pages.pop()
            lists, mine = how
            attrs = tree.attrs[x]
            mine.add(page.lines, number(attrs.get("colspan", "1"), 1000), number(attrs.get("rowspan", "1"), 65534))
            continue
        if tag == "table" and tables:
            page.end()
            done = tables.pop()
            for line in done.lines() if done else ():
                page.put(line)
        elif tag in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
        elif tag == "pre":
            pre -= 1
        if tag in BLOCK:
            page.end()
            page.gap = page.gap or tag in SPACED and not (tag in ("ul", "ol") and lists)
    pages[0].end()
    return "\n".join(line.rstrip() for line in pages[0].lines)


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars of each page.

    Null and empty pages have the empty text, broken markup never fails, rows without id keep a null
    page_id, repeated rows give equal rows, an empty table none, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [render(x) if x else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))
