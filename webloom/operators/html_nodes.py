"""HTML as nested rows, stage 1: the node array.

One ``mapInPandas`` pass tokenizes each body with the standard-library
``html.parser`` and adds one column ``nodes`` to its row: an array with a struct
per element (and per text node when a path needs ``text()``),

    (pre, parent, kind, name, sib_pos, attrs, at, last, value)

``pre`` numbers nodes in document order (the document itself is 0); what lies below a
node stands behind it in the array, from ``at`` + 1 to ``last``.  Stage 2
(``webloom.operators.xpath``) filters that array with Column expressions, so no
step of a path shuffles.  Only elements whose names occur in some compiled path
are emitted (``keep_names``; ``None`` = all), and the string-value (concatenated
descendant text) is filled only for names a path returns as elements
(``value_names``).

Tree building follows the HTML rules that matter for extraction: ``html``,
``head`` and ``body`` exist even where the source omits them, rows get an implied
``tbody`` (and cells an implied row), void elements close themselves and ``/>``
closes nothing else, a new ``p`` or block element closes an open ``p``,
``li``/``dt``/``dd``/``option`` close their open sibling, an end tag closes up to
its open element (stray ones are ignored, a stray ``</p>`` is an empty paragraph),
``script``/``style`` content is raw text, everything open at EOF closes there.
Formatting elements (``b``, ``i``, ``a``, ...) that something else closes are opened again
for the content that follows, and an end tag that lies across blocks moves them as the
adoption steps of HTML say.
A body that the tokenizer cannot read fails the job; nothing is dropped.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from webloom import schemas
from webloom.session import ship_package

SLICE_CHARS, SLICE_ROWS = 1 << 20, 512  # of bodies that are held as nodes at once

# ---- fixed values: HTML element categories (WHATWG HTML) -------------------
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul "
    "li dd dt".split())
SIBLING_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
                 "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
SCOPE_STOP = {"li": frozenset("ul ol".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
              "option": frozenset(["select"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]),
              "th": frozenset(["tr", "table"])}
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
SECTIONS = frozenset("tbody thead tfoot".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
MARKED = frozenset("applet caption marquee object td template th".split())
SCOPE = frozenset("applet caption html marquee object table td template th".split())
PHRASING = frozenset("abbr acronym bdi bdo cite data del dfn ins kbd label map mark meter output progress q rp rt ruby samp span sub "
                     "sup time var".split())
NO_TEXT = frozenset("html head table tbody thead tfoot tr colgroup script style title".split())
NO_REOPEN = frozenset("html head body table caption colgroup col tbody thead tfoot tr td th base link meta script style template "
                      "title param source track".split())
# ---------------------------------------------------------------------------


class _Node:
    __slots__ = ("name", "attrs", "parent", "children")

    def __init__(self, name, attrs):
        self.name, self.attrs, self.parent, self.children = name, attrs, None, []

    def add(self, child):
        """Append a node (taken from where it was) or a text."""
        if isinstance(child, _Node):
            if child.parent is not None:
                child.parent.children.remove(child)
            child.parent = self
        self.children.append(child)


MARK = _Node("", [])  # in the list of active formatting elements: a cell or an object begins


class _Open(list):
    """The open elements, with how many of each name there are."""

    def __init__(self):
        super().__init__()
        self.count = Counter()

    def append(self, node):
        self.insert(len(self), node)

    def insert(self, i, node):
        self.count[node.name] += 1
        super().insert(i, node)

    def pop(self):
        self.count[self[-1].name] -= 1
        return super().pop()

    def remove(self, node):
        super().remove(node)
        self.count[node.name] -= 1

    def __delitem__(self, at):
        self.count.subtract(e.name for e in (self[at] if isinstance(at, slice) else [self[at]]))
        super().__delitem__(at)


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", [])
        self.stack = _Open()
        self.active = []     # formatting elements that later content still stands in, and marks
        self.head_done = False

    # -- helpers --------------------------------------------------------------
    def _top(self):
        return self.stack[-1] if self.stack else self.root

    def _close_through(self, name):
        while self.stack:
            if self.stack.pop().name == name:
                break
        if name in MARKED:
            while self.active and self.active.pop() is not MARK:
                pass

    def _open_in(self, name, stops=frozenset()):
        if not self._has(name):
            return False
        for e in reversed(self.stack):
            if e.name == name:
                return True
            if e.name in stops:
                return False
        return False

    # -- formatting elements ---------------------------------------------------
    def _reopen(self):
        """Open again the active formatting elements that were closed by something else."""
        at = len(self.active)
        while at and self.active[at - 1] is not MARK and self.active[at - 1] not in self.stack:
            at -= 1
        for i in range(at, len(self.active)):
            self.active[i] = self._open(self.active[i].name, self.active[i].attrs)

    def _remember(self, node):
        alike = []
        for e in reversed(self.active):
            if e is MARK:
                break
            if e.name == node.name and e.attrs == node.attrs:
                alike.append(e)
        if len(alike) >= 3:  # of equal ones the last three count
            self.active.remove(alike[-1])
        self.active.append(node)

    def _close_formatting(self, name):
        """An end tag of a formatting element that may lie across others (the adoption steps)."""
        if self.stack and self.stack[-1].name == name and self.stack[-1] not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            own = None
            for e in reversed(self.active):
                if e is MARK:
                    break
                if e.name == name:
                    own = e
                    break
            if own is None:
                for e in reversed(self.stack):
                    if e.name == name:
                        self._close_through(name)
                        return
                    if e.name not in FORMATTING and e.name not in PHRASING:
                        return
                return
            if own not in self.stack:
                self.active.remove(own)
                return
            at = self.stack.index(own)
            if any(e.name in SCOPE for e in self.stack[at + 1:]):
                return
            block = next((e for e in self.stack[at + 1:] if e.name not in FORMATTING and e.name not in PHRASING), None)
            if block is None:
                del self.stack[at:]
                self.active.remove(own)
                return
            above, mark = self.stack[at - 1] if at else self.root, self.active.index(own)
            last, i, steps = block, self.stack.index(block), 0
            while True:  # from the block up to the formatting element
                i, steps = i - 1, steps + 1
                node = self.stack[i]
                if node is own:
                    break
                if node in self.active and steps > 3:
                    self.active.remove(node)
                    mark = min(mark, len(self.active))
                if node not in self.active:
                    del self.stack[i]
                    continue
                copy = _Node(node.name, node.attrs)
                self.active[self.active.index(node)] = copy
                self.stack[i] = copy
                if last is block:
                    mark = self.active.index(copy) + 1
                copy.add(last)
                last = copy
            above.add(last)
            copy = _Node(own.name, own.attrs)
            inside, block.children = block.children, []
            for child in inside:
                if isinstance(child, _Node):
                    child.parent = copy
                copy.children.append(child)
            block.add(copy)
            self.active.insert(mark, copy)
            self.active.remove(own)
            self.stack.remove(own)
            self.stack.insert(self.stack.index(block) + 1, copy)

    # -- implied elements ------------------------------------------------------
    def _has(self, name):
        return self.stack.count[name] > 0

    def _imply(self, name):
        """Open what HTML supplies before a start tag ``name``."""
        if name != "html" and not self._has("html"):
            self._open("html", [])
        if name in ("html", "head") or self._has("body"):
            return
        if name in HEAD_ONLY and not self.head_done:
            if not self._has("head"):
                self._open("head", [])
            return
        self._leave_head()
        if name != "body":
            self._open("body", [])

    def _leave_head(self):
        if self._has("head"):
            self._close_through("head")
        elif not self.head_done:
            self._open("head", [])
            self._close_through("head")
        self.head_done = True

    def _imply_table(self, name):
        if name in SECTIONS:
            while self.stack[-1].name in SECTIONS | {"tr", "td", "th"} and self._open_in("table"):
                self._close_through(self.stack[-1].name)
        elif name == "tr" and self.stack[-1].name == "table":
            self._open("tbody", [])
        elif name in ("td", "th"):
            if self.stack[-1].name == "table":
                self._open("tbody", [])
            if self.stack[-1].name in SECTIONS:
                self._open("tr", [])

    # -- parser callbacks ------------------------------------------------------
    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # HTML has no marked sections

    def handle_starttag(self, tag, attrs):
        name = tag.lower()
        if name in ("html", "head", "body") and (self._has(name) or name == "head" and self.head_done):
            return
        self._imply(name)
        if name in CLOSES_P and self._open_in("p", frozenset(["button"])):
            self._close_through("p")
        if name in SIBLING_CLOSE:
            for sib in SIBLING_CLOSE[name]:
                if self._open_in(sib, SCOPE_STOP[name]):
                    self._close_through(sib)
                    break
        if name in SECTIONS or name in ("tr", "td", "th"):
            self._imply_table(name)
        if name in ("a", "nobr"):
            for e in reversed(self.active):
                if e is MARK:
                    break
                if e.name == name:
                    self._close_formatting(name)
                    if e in self.active:
                        self.active.remove(e)
                    if e in self.stack:
                        self.stack.remove(e)
                    break
        if self._has("body") and name not in CLOSES_P and name not in NO_REOPEN:
            self._reopen()
        node = self._open(name, attrs)
        if name in FORMATTING:
            self._remember(node)
        elif name in MARKED:
            self.active.append(MARK)

    def _open(self, name, attrs):
        node = _Node(name, attrs)
        self._top().add(node)
        if name not in VOID:
            self.stack.append(node)
        return node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        name = tag.lower()
        if name in ("html", "body"):
            return  # what follows still belongs to the body
        if name == "head":
            self._imply("head")
            self._leave_head()
        elif name in FORMATTING:
            self._close_formatting(name)
        elif self._has(name):
            self._close_through(name)
        elif name == "p":
            self.handle_starttag("p", [])
            self._close_through("p")

    def handle_data(self, data):
        if not data:
            return
        if not self._has("body") and (not self.stack or self.stack[-1].name in ("html", "head")):
            if not data.strip():
                return
            self._imply("#text")
        if self._has("body") and self._top().name not in NO_TEXT:
            self._reopen()
        self._top().add(data)


def _rows(root, keep, values, want_text):
    """The tree in document order, numbered from 1."""
    rows, chunks, pre = [], [], 0
    # (node, its number, its row, first chunk, children left, names counted)
    path = [(root, 0, None, 0, iter(root.children), {})]
    while path:
        node, number, row, start, left, counts = path[-1]
        child = next(left, None)
        if child is None:
            path.pop()
            if row is not None:
                row[8] = len(rows) - 1
                if values is None or node.name in values:
                    row[10] = "".join(chunks[start:])
            continue
        pre += 1
        if not isinstance(child, _Node):
            chunks.append(child)
            if want_text:
                rows.append([pre, number, len(path) - 1, "text", None, None, None, len(rows), len(rows), None, child])
            continue
        counts[child.name] = counts.get(child.name, 0) + 1
        own = None
        if keep is None or child.name in keep:
            amap = {}
            for k, v in child.attrs:
                if k not in amap:  # first of duplicate attributes wins
                    amap[k] = "" if v is None else v
            own = [pre, number, len(path) - 1, "elem", child.name, counts[child.name], amap, len(rows), None, None, None]
            rows.append(own)
        path.append((child, pre, own, len(chunks), iter(child.children), {}))
    return rows


def parse_nodes(html: str, keep_names=None, value_names=None, want_text=False) -> list:
    """Rows ``[pre, parent, depth, kind, name, sib_pos, attrs, at, last, -, value]``
    of one document (plain Python, used by the Spark stage and by tests)."""
    b = _TreeBuilder()
    b.feed(html or "")
    b.close()
    return _rows(b.root, keep_names, value_names, want_text)


def slices(bodies) -> list[tuple[int, int]]:
    """Runs (from, to) of bodies of about ``SLICE_CHARS`` in all, one at least.  The nodes of a body
    take many times its size, so a batch of thousands of pages is not held as nodes at once."""
    out, lo, size = [], 0, 0
    for i, body in enumerate(bodies):
        size += len(body) if isinstance(body, str) else 0
        if size >= SLICE_CHARS or i - lo + 1 >= SLICE_ROWS:
            out.append((lo, i + 1))
            lo, size = i + 1, 0
    return out + [(lo, len(bodies))] if lo < len(bodies) else out


def with_nodes(docs: DataFrame, keep_names=None, value_names=None, want_text=False, html_col: str = "html",
               wanted_col: str | None = None, drop_html: bool = False) -> DataFrame:
    """Stage 1 as a Spark job: ``docs`` with a column ``nodes``.

    Rows where ``wanted_col`` is false are not tokenized (their array is
    empty); ``drop_html`` leaves the body behind in the Python worker.
    """
    ship_package(docs.sparkSession)
    keep = None if keep_names is None else frozenset(keep_names)
    vals = None if value_names is None else frozenset(value_names)
    out = [f for f in docs.schema.fields if not (drop_html and f.name == html_col)]

    def rows(html, wanted):
        return [{"pre": r[0], "parent": r[1], "kind": r[3], "name": r[4], "sib_pos": r[5], "attrs": r[6],
                 "at": r[7], "last": r[8], "value": r[10]} for r in parse_nodes(html, keep, vals, want_text)] if wanted else []

    def run(batches):
        for pdf in batches:
            for lo, hi in slices(pdf[html_col]):
                part = pdf.iloc[lo:hi]
                wanted = part[wanted_col] if wanted_col else [True] * len(part)
                nodes = [rows(h, w) for h, w in zip(part[html_col], wanted, strict=True)]
                yield part[[f.name for f in out]].assign(nodes=pd.Series(nodes, index=part.index, dtype=object))

    return docs.mapInPandas(run, T.StructType([*out, T.StructField("nodes", T.ArrayType(schemas.HTML_NODE))]))
