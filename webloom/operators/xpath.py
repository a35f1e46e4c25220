"""XPath location paths compiled to Column expressions.

Supported subset (what the rule sets use, plus the usual small extras):

    expr      := path ('|' path)*
    path      := ('/' | '//') step (('/' | '//') step)*
    step      := ('*' | NAME) pred* | '@' NAME | 'text()'
    pred      := '[' or ']' | '[' INTEGER ']'
    or        := and ('or' and)*
    and       := unary ('and' unary)*
    unary     := 'not(' or ')' | '(' or ')' | '@' NAME ('=' | '!=') LITERAL | '@' NAME
               | 'contains(@' NAME ',' LITERAL ')' | 'starts-with(@' NAME ',' LITERAL ')'

Anything else is refused when the rule is loaded (``XPathError``), where the
reference would fail at run time.  A relative path in a union (``a|@b``) is
evaluated from the document node, as the reference does.

Evaluation is Column-only, over the ``nodes`` array of a row
(``html_nodes.with_nodes``): a step keeps nodes by name, predicates and axis.  The
nodes below a context are runs of the array: the outermost context nodes (those that no
earlier one reaches, by a running maximum of ``last``) give runs that do not overlap, so
each step reads a node at most once, however deep the page.  No join, no shuffle; each
step's context is computed once per row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


class XPathError(ValueError):
    pass


@dataclass
class Step:
    axis: str            # child | descendant
    kind: str            # elem | attr | text
    name: str            # element name, '*', or attribute name
    preds: list = field(default_factory=list)   # Column-builder trees
    position: int | None = None


@dataclass
class Path:
    absolute: bool
    steps: list


_TOKEN = re.compile(r"""\s*(?:
    (?P<dslash>//)|(?P<slash>/)|(?P<pipe>\|)|(?P<lb>\[)|(?P<rb>\])|(?P<lp>\()|(?P<rp>\))|
    (?P<neq>!=)|(?P<eq>=)|(?P<comma>,)|(?P<at>@)|(?P<star>\*)|
    (?P<num>[0-9]+)|(?P<str>"[^"]*"|'[^']*')|(?P<name>[A-Za-z_][\w.\-]*(?:\(\))?)
    )""", re.X)


def _tokens(s: str):
    out, i = [], 0
    while i < len(s):
        m = _TOKEN.match(s, i)
        if not m or m.end() == i:
            if s[i:].strip() == "":
                break
            raise XPathError(f"unsupported XPath near {s[i:]!r}")
        kind = m.lastgroup
        out.append((kind, m.group(kind)))
        i = m.end()
    return out


class _P:
    def __init__(self, text):
        self.t = _tokens(text)
        self.i = 0
        self.text = text

    def peek(self, k=0):
        return self.t[self.i + k] if self.i + k < len(self.t) else (None, None)

    def take(self, kind=None, value=None):
        tk = self.peek()
        if kind and tk[0] != kind or value is not None and tk[1] != value:
            raise XPathError(f"unsupported XPath {self.text!r}: expected {value or kind}, got {tk[1]!r}")
        self.i += 1
        return tk

    def expr(self):
        paths = [self.path()]
        while self.peek()[0] == "pipe":
            self.take()
            paths.append(self.path())
        if self.peek()[0] is not None:
            raise XPathError(f"unsupported XPath {self.text!r}: trailing {self.peek()[1]!r}")
        return paths

    def path(self):
        steps = []
        absolute = self.peek()[0] in ("slash", "dslash")
        axis = "child"
        if absolute:
            axis = "descendant" if self.take()[0] == "dslash" else "child"
        steps.append(self.step(axis))
        while self.peek()[0] in ("slash", "dslash"):
            axis = "descendant" if self.take()[0] == "dslash" else "child"
            steps.append(self.step(axis))
        for s in steps[:-1]:
            if s.kind != "elem":
                raise XPathError(f"unsupported XPath {self.text!r}: {s.kind} step must be last")
        return Path(absolute, steps)

    def step(self, axis):
        k, v = self.peek()
        if k == "at":
            self.take()
            return Step(axis, "attr", self.take("name")[1])
        if k == "name" and v == "text()":
            self.take()
            return Step(axis, "text", "")
        if k == "star":
            self.take()
            s = Step(axis, "elem", "*")
        elif k == "name" and not v.endswith("()"):
            self.take()
            s = Step(axis, "elem", v.lower())
        else:
            raise XPathError(f"unsupported XPath {self.text!r}: step {v!r}")
        while self.peek()[0] == "lb":
            self.take()
            if self.peek()[0] == "num" and self.peek(1)[0] == "rb":
                if s.preds or s.position is not None:
                    raise XPathError(f"unsupported XPath {self.text!r}: position after a predicate")
                s.position = int(self.take()[1])
            else:
                s.preds.append(self.or_())
            self.take("rb")
        return s

    def or_(self):
        parts = [self.and_()]
        while self.peek() == ("name", "or"):
            self.take()
            parts.append(self.and_())
        return ("or", parts) if len(parts) > 1 else parts[0]

    def and_(self):
        parts = [self.unary()]
        while self.peek() == ("name", "and"):
            self.take()
            parts.append(self.unary())
        return ("and", parts) if len(parts) > 1 else parts[0]

    def unary(self):
        k, v = self.peek()
        if k == "lp":
            self.take()
            e = self.or_()
            self.take("rp")
            return e
        if k == "at":
            self.take()
            a = self.take("name")[1]
            if self.peek()[0] in ("eq", "neq"):
                op = self.take()[0]
                lit = self.take("str")[1][1:-1]
                return (op, a, lit)
            return ("has", a)
        if k == "name" and v in ("not", "contains", "starts-with") and self.peek(1)[0] == "lp":
            self.take()
            self.take("lp")
            if v == "not":
                e = self.or_()
                self.take("rp")
                return ("not", e)
            self.take("at")
            a = self.take("name")[1]
            self.take("comma")
            lit = self.take("str")[1][1:-1]
            self.take("rp")
            return (v, a, lit)
        raise XPathError(f"unsupported XPath {self.text!r}: predicate near {v!r}")


def compile_xpath(text: str) -> list[Path]:
    return _P(text).expr()


def validate(text: str) -> None:
    """Raise XPathError for a path that is outside the subset."""
    for path in compile_xpath(text):
        for s in path.steps:
            if s.position is not None and s.name == "*":
                raise XPathError(f"unsupported XPath {text!r}: position on '*'")


def _pred_column(p, attrs: Column) -> Column:
    op = p[0]
    if op == "or":
        c = _pred_column(p[1][0], attrs)
        for q in p[1][1:]:
            c = c | _pred_column(q, attrs)
        return c
    if op == "and":
        c = _pred_column(p[1][0], attrs)
        for q in p[1][1:]:
            c = c & _pred_column(q, attrs)
        return c
    if op == "not":
        return ~_pred_column(p[1], attrs)
    v = attrs[p[1]]
    if op == "has":
        return v.isNotNull()
    if op == "eq":
        return F.coalesce(v == F.lit(p[2]), F.lit(False))
    if op == "neq":
        return F.coalesce(v != F.lit(p[2]), F.lit(False))
    if op == "contains":
        return F.coalesce(v.contains(p[2]), F.lit(False))
    if op == "starts-with":
        return F.coalesce(v.startswith(p[2]), F.lit(False))
    raise XPathError(f"predicate {op}")


def names_used(paths: list[Path]) -> tuple[set | None, set | None, bool]:
    """(element names the node table must keep, names whose string-value is
    needed, whether text nodes are needed).  ``None`` = all elements."""
    keep, values, text = set(), set(), False
    for p in paths:
        for i, s in enumerate(p.steps):
            if s.kind == "elem":
                if s.name == "*":
                    keep = None
                elif keep is not None:
                    keep.add(s.name)
                if i == len(p.steps) - 1:
                    if s.name == "*":
                        values = None
                    elif values is not None:
                        values.add(s.name)
            elif s.kind == "text":
                text = True
            elif s.axis == "descendant":
                keep = None  # any element may hold the attribute
    return keep, values, text


def merge_names(parts):
    keep, values, text = set(), set(), False
    for k, v, t in parts:
        keep = None if keep is None or k is None else keep | k
        values = None if values is None or v is None else values | v
        text = text or t
    return keep, values, text


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (a lambda variable)."""
    return F.get(F.transform(F.array(value), body), 0)


def _is_step(n: Column, s: Step) -> Column:
    c = n["kind"] == "elem"
    if s.name != "*":
        c = c & (n["name"] == s.name)
    for p in s.preds:
        c = c & _pred_column(p, n["attrs"])
    if s.position is not None:
        c = c & (n["sib_pos"] == s.position)
    return c


def _outermost(ctx: Column) -> Column:
    """The nodes of ``ctx`` (in document order) that lie below none of the others.  The
    running maximum doubles its reach in each round."""
    def running(c):
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(c))).cast("int") - 1)
        return F.reduce(F.transform(rounds, lambda k: F.pow(F.lit(2), k).cast("int")), F.transform(c, lambda n: n["last"]),
                        lambda m, step: F.transform(m, lambda x, i: F.greatest(x, F.get(m, i - step))))

    def pick(c):
        return _bind(running(c), lambda top: F.filter(c, lambda n, i: (i == 0) | (F.get(top, i - 1) < n["at"])))

    return F.when(F.size(ctx) < 2, ctx).otherwise(pick(ctx))


def _below(nodes: Column, ctx: Column, own: bool = False) -> Column:
    """The nodes below those of ``ctx`` (with them, if ``own``) in document order, each once."""
    more = int(own)
    return F.flatten(F.transform(_outermost(ctx), lambda c: F.slice(
        nodes, c["at"] + (2 - more), c["last"] - c["at"] + more)))


def _children(nodes: Column, ctx: Column) -> Column:
    """The nodes whose parent is in ``ctx``: by a row of flags over the numbers up to the last of ``ctx``."""
    def before(c, i):
        return F.coalesce(F.get(c, i - 1)["pre"], F.lit(0))

    flags = _bind(ctx, lambda c: F.flatten(F.transform(c, lambda n, i: F.concat(
        F.array_repeat(F.lit(False), n["pre"] - before(c, i) - 1), F.array(F.lit(True))))))
    return _bind(flags, lambda f: F.filter(_below(nodes, ctx), lambda n: F.coalesce(F.get(f, n["parent"] - 1), F.lit(False))))


def _on_axis(nodes: Column, ctx: Column | None, axis: str) -> Column:
    """The nodes on the axis of some context node (None: the document)."""
    if ctx is None:
        return nodes if axis == "descendant" else F.filter(nodes, lambda n: n["parent"] == 0)
    return _below(nodes, ctx) if axis == "descendant" else _children(nodes, ctx)


def _found(nodes: Column, sub: int, value) -> Column:
    return F.transform(nodes, lambda n: F.struct(n["pre"].alias("pre"), F.lit(sub).alias("sub"), value(n).alias("value")))


def _walk(nodes: Column, steps: list[Step], ctx: Column | None) -> Column | None:
    """array<struct<pre, sub, value>> of the last step's nodes."""
    s, rest = steps[0], steps[1:]
    if s.kind == "attr":
        if ctx is None and s.axis == "child":
            return None  # the document node has no attributes
        if ctx is None:
            own = nodes
        else:
            own = _below(nodes, ctx, own=True) if s.axis == "descendant" else ctx
        return _found(F.filter(own, lambda n: (n["kind"] == "elem") & n["attrs"][s.name].isNotNull()), 1,
                      lambda n: n["attrs"][s.name])
    if s.kind == "text":
        return _found(F.filter(_on_axis(nodes, ctx, s.axis), lambda n: n["kind"] == "text"), 0, lambda n: n["value"])
    if s.position is not None and s.name == "*":
        raise XPathError("position on '*' is not supported")
    hits = F.filter(_on_axis(nodes, ctx, s.axis), lambda n: _is_step(n, s))
    if not rest:
        return _found(hits, 0, lambda n: n["value"])
    return _bind(hits, lambda c: _walk(nodes, rest, c))


def values(nodes: Column, paths: list[Path]) -> Column:
    """array<string>: the non-empty values of the union of ``paths`` over a
    ``nodes`` column, in document order."""
    outs = []
    for p in paths:
        if not p.absolute and p.steps[0].kind != "elem":
            continue  # attributes or text of the document itself: none
        v = _walk(nodes, p.steps, None)
        if v is not None:
            outs.append(v)
    if not outs:
        return F.array().cast("array<string>")
    found = outs[0] if len(outs) == 1 else F.array_sort(F.array_distinct(F.concat(*outs)))
    return F.filter(F.transform(found, lambda x: x["value"]), lambda x: x.isNotNull() & (F.length(x) > 0))
