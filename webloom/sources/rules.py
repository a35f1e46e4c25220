"""URL-class and parser rule sets.

Rule sets are tiny (tens of rows) while pages are huge, so rules are read once
on the driver, validated, and compiled into Column expressions by
``webloom.operators.classify`` / ``webloom.operators.extract``.  They can be
given as Python dicts, a JSON file (``spark.read.json(multiLine)`` with a fixed
schema) or a DataFrame of that schema; a missing or empty store falls back to the
built-in defaults, an unreadable one or an unsupported rule raises.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from webloom import schemas
from webloom.operators import xpath

# ---- fixed values (must equal the reference for the same results) ----------
# Named REGEX matchers of StringMatcher: name -> pattern.
NAMED_PATTERNS = {
    "any": "[^/]+",
    "alpha": "[A-Za-z]",
    "alphas": "[A-Za-z]+",
    "digit": "[0-9]",
    "digits": "[0-9]+",
    "alnum": "[A-Za-z0-9]",
    "alnums": "[A-Za-z0-9]+",
}
# Result types a URL class accepts from its parsers (IGNORE accepts none).
CLASS_PARSER_TYPES = {
    "FILE": ("CONTENT",),
    "POST": ("CONTENT", "TAG", "FOLLOW"),
    "LIST": ("FOLLOW", "NEXT"),
}
# ---------------------------------------------------------------------------


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Matcher:
    value: str = ""
    type: str = "EXACT"
    default: str = ""


@dataclass(frozen=True)
class URLClass:
    name: str
    cls: str
    priority: int
    domain: str
    path: tuple = ()
    query: tuple = ()  # ((key, Matcher), ...) sorted by key
    allow_http: bool = False
    match_subdomain: bool = False
    allow_subdomain: bool = False
    ordinal: int = 0


@dataclass(frozen=True)
class Operation:
    type: str
    value: str


@dataclass(frozen=True)
class Parser:
    name: str
    type: str
    operations: tuple
    urls: tuple = ()
    ordinal: int = 0


@dataclass
class RuleSet:
    classes: list = field(default_factory=list)
    parsers: list = field(default_factory=list)


# ---------------------------------------------------------------------------
# Regex dialect: the rules are RE2; Spark runs Java patterns.

# ---- fixed values: POSIX class names of RE2 and the Java classes ------------
POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}",
         "cntrl": r"\p{Cntrl}", "digit": r"0-9", "graph": r"\p{Graph}", "lower": r"a-z", "print": r"\p{Print}",
         "punct": r"\p{Punct}", "space": r"\t\n\x0B\f\r ", "upper": r"A-Z", "word": r"0-9A-Za-z_",
         "xdigit": r"0-9A-Fa-f"}
# ---------------------------------------------------------------------------
_SPACE = r"\t\n\f\r "
_GROUP = re.compile(r"\(\?(?:P?<([A-Za-z_]\w*)>|([imsU]*(?:-[imsU]+)?)([:)]))")


def _class(p: str, i: int) -> tuple[str, int]:
    """The bracket class that begins at p[i] in Java syntax, and its end."""
    j, out = i + 1, "["
    if p[j:j + 1] == "^":
        out, j = "[^", j + 1
    first = True
    while j < len(p):
        c = p[j]
        if c == "]" and not first:
            return out + "]", j + 1
        first = False
        if c == "[":
            m = re.match(r"\[:(\^?)([a-z]+):\]", p[j:])
            if m and m[2] in POSIX:
                out += f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]]
                j += m.end()
                continue
            if m:
                raise ValueError("unknown POSIX class")
            out, j = out + r"\[", j + 1
        elif c == "\\":
            e, j = _escape(p, j, True)
            out += e
        else:
            out, j = out + ("\\&" if c == "&" else c), j + 1
    raise ValueError("missing ]")


def _escape(p: str, i: int, inside: bool) -> tuple[str, int]:
    c = p[i + 1:i + 2]
    if c == "s":
        return (_SPACE if inside else f"[{_SPACE}]"), i + 2
    if c == "S":
        return f"[^{_SPACE}]", i + 2
    if c == "C":
        raise RuleError(f"regex {p!r}: single bytes cannot be matched")
    if c and c in "pP":
        m = re.match(r"\\[pP](?:\{\^?\w+\}|[A-Z])", p[i:])
        if not m:
            raise ValueError("bad property")
        name = m[0]
        if "{^" in name:
            name = ("\\P" if name[1] == "p" else "\\p") + name[2:].replace("^", "")
        if re.fullmatch(r"\\[pP]\{[A-Z][a-z]{2,}\w*\}", name):
            name = name.replace("{", "{Is")
        return name, i + m.end()
    if c == "x":
        m = re.match(r"\\x(?:\{[0-9A-Fa-f]{1,6}\}|[0-9A-Fa-f]{2})", p[i:])
        if not m:
            raise ValueError("bad \\x")
        return m[0], i + m.end()
    if c and (c in "dDwWtnrfv" or c in "AbBz" and not inside):
        return ("\\x0B" if c == "v" else f"\\{c}"), i + 2
    if c == "a":
        return "\\x07", i + 2
    if c and not c.isalnum():
        return f"\\{c}", i + 2
    raise ValueError("escape that RE2 does not know")


def to_java_regex(pattern: str) -> str | None:
    """RE2 pattern -> Java pattern, or None where RE2 itself refuses it.

    Raises RuleError for the few valid patterns Java has no form for.
    """
    p, out, i = pattern, "(?d)", 0
    many = False  # whether the multi-line flag may be on
    quant = False  # whether the last thing was a quantifier
    try:
        re.compile(re.sub(r"\(\?U", "(?", re.sub(r"\\[pP](\{\^?\w+\}|[A-Z])|\\z|\\x\{[0-9A-Fa-f]+\}", "x", re.sub(
            r"\[\[:\^?\w+:\]", "[x", re.sub(r"\[:\^?\w+:\]", "x", p.replace("(?<", "(?P<").replace("\\Q", "").replace("\\E", ""))))))
        while i < len(p):
            c, was, quant = p[i], quant, False
            if p.startswith("\\Q", i):
                end = p.find("\\E", i)
                text = p[i + 2:] if end < 0 else p[i + 2:end]
                out += "".join(c if c.isalnum() or ord(c) > 127 else f"\\{c}" for c in text)
                i = len(p) if end < 0 else end + 2
            elif c == "\\":
                e, i = _escape(p, i, False)
                out += e
            elif c == "[":
                e, i = _class(p, i)
                out += e
            elif c == "(" and p[i + 1:i + 2] == "?":
                m = _GROUP.match(p, i)
                if not m:
                    return None  # look-around, atomic groups, conditions
                if m[1]:
                    out += f"(?<{m[1].replace('_', 'U')}>"
                else:
                    if "U" in m[2]:
                        raise RuleError(f"regex {pattern!r}: the ungreedy flag has no Java form")
                    many = many or "m" in m[2].partition("-")[0]
                    out += m[0]
                i = m.end()
            elif c in "*+?" or c == "{" and re.match(r"\{[0-9]+(,[0-9]*)?\}", p[i:]):
                m = re.match(r"[*+?]|\{[0-9]+(,[0-9]*)?\}", p[i:])
                if was:
                    return None  # RE2 refuses repeated quantifiers
                out, i, quant = out + m[0], i + m.end(), True
                if p[i:i + 1] == "?":
                    out, i = out + "?", i + 1
            elif c == "$":
                if many:
                    raise RuleError(f"regex {pattern!r}: $ under a multi-line flag is not supported")
                out, i = out + "\\z", i + 1
            elif c in "{}":
                out, i = out + f"\\{c}", i + 1
            else:
                out, i = out + c, i + 1
    except (ValueError, re.error) as e:
        if isinstance(e, RuleError):
            raise
        return None
    return out


def regex_for_op(pattern: str) -> str:
    """REGEX operation in Java syntax.  Raises RuleError for a pattern RE2
    refuses, and for one that can match the empty string (which Java and RE2 count
    differently)."""
    p = to_java_regex(pattern)
    if p is None:
        raise RuleError(f"regex {pattern!r} is not valid RE2")
    if _may_be_empty(pattern):
        raise RuleError(f"regex {pattern!r} can match the empty string")
    return p


def _may_be_empty(pattern: str) -> bool:
    import regex
    plain = regex.sub(r"\(\?P?<", "(?P<", pattern).replace("\\z", "\\Z")
    return any(m.end() == m.start() for t in ("", "a", " a-1 ", "0_") for m in regex.finditer(plain, t))


def matcher_pattern(m: Matcher) -> str | None:
    p = NAMED_PATTERNS.get(m.value, m.value)
    return to_java_regex(p)


def _matcher(d) -> Matcher:
    if d is None:
        return Matcher()
    if isinstance(d, Matcher):
        return d
    d = dict(d)
    t = d.get("type") or "EXACT"
    if isinstance(t, int):
        t = {0: "EXACT", 1: "REGEX"}.get(t, str(t))
    return Matcher(value=d.get("value") or "", type=str(t).upper(), default=d.get("default") or "")


def url_class(d: dict, ordinal: int) -> URLClass:
    d = dict(d)
    cls = str(d.get("class") or "FILE").upper()
    if cls not in schemas.CLASS_TYPES:
        raise RuleError(f"class {d.get('name')!r}: unknown class type {cls!r}")
    prio = int(d.get("priority") or 0)
    if prio < 0:
        raise RuleError(f"class {d.get('name')!r}: priority is unsigned")
    q = d.get("query") or {}
    if isinstance(q, list):
        q = {k: v for k, v in q}
    return URLClass(
        name=d["name"], cls=cls, priority=prio, domain=d.get("domain") or "",
        path=tuple(_matcher(m) for m in (d.get("path") or [])),
        query=tuple(sorted((k, _matcher(v)) for k, v in q.items())),
        allow_http=bool(d.get("allow_http")), match_subdomain=bool(d.get("match_subdomain")),
        allow_subdomain=bool(d.get("allow_subdomain")), ordinal=ordinal)


def parser(d: dict, ordinal: int) -> Parser:
    d = dict(d)
    ptype = str(d.get("type") or "TAG").upper()
    if ptype not in schemas.RESULT_TYPES:
        raise RuleError(f"parser {d.get('name')!r}: unknown result type {ptype!r}")
    ops = []
    for o in d.get("operations") or []:
        o = dict(o)
        t = str(o.get("type") or "VALUE").upper()
        if t not in schemas.OP_TYPES:
            raise RuleError(f"parser {d.get('name')!r}: unknown operation {t!r}")
        ops.append(Operation(type=t, value=o.get("value") or ""))
    if not ops:
        # The reference would return the whole body typed TAG; refused at load.
        raise RuleError(f"parser {d.get('name')!r}: no operations")
    for o in ops:
        if o.type == "XPATH":
            try:
                xpath.validate(o.value)
            except xpath.XPathError as e:
                raise RuleError(f"parser {d.get('name')!r}: {e}") from e
        if o.type == "REGEX":
            regex_for_op(o.value)
    return Parser(name=d["name"], type=ptype, operations=tuple(ops),
                  urls=tuple(d.get("urls") or ()), ordinal=ordinal)


def load_classes(source=None, spark: SparkSession | None = None) -> list[URLClass]:
    """A1: all URL classes; a missing or empty store gives the defaults."""
    rows = _rows(source, spark, schemas.URL_CLASS) or default_classes_dicts()
    return [url_class(r, i) for i, r in enumerate(rows)]


def load_parsers(source=None, spark: SparkSession | None = None) -> list[Parser]:
    """A2: all parsers; a missing or empty store gives the defaults."""
    rows = _rows(source, spark, schemas.PARSER) or default_parsers_dicts()
    return [parser(r, i) for i, r in enumerate(rows)]


def _rows(source, spark, schema) -> list[dict]:
    if source is None:
        return []
    if isinstance(source, DataFrame):
        rows = source.orderBy("ordinal") if "ordinal" in source.columns else source
        return [r.asDict(recursive=True) for r in rows.collect()]
    if isinstance(source, str):
        if spark is None:
            try:
                with open(source) as fh:
                    return json.load(fh)
            except FileNotFoundError:
                return []
        try:
            return [r.asDict(recursive=True) for r in
                    spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(source).collect()]
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []  # no store yet: the defaults hold
            raise
    return list(source)


def classes_dataframe(spark: SparkSession, classes: list[URLClass]) -> DataFrame:
    rows = [(c.name, c.cls, c.priority, c.domain,
             [(m.value, m.type, m.default) for m in c.path],
             {k: (m.value, m.type, m.default) for k, m in c.query},
             c.allow_http, c.match_subdomain, c.allow_subdomain, c.ordinal) for c in classes]
    return spark.createDataFrame(rows, schemas.URL_CLASS)


def parsers_dataframe(spark: SparkSession, parsers: list[Parser]) -> DataFrame:
    rows = [(p.name, p.type, [(o.value, o.type) for o in p.operations], list(p.urls), p.ordinal)
            for p in parsers]
    return spark.createDataFrame(rows, schemas.PARSER)


# ---------------------------------------------------------------------------
# Built-in defaults: neutral example.* rules with the shape of the reference's
# defaults (FIXTURES 2.2 and 2.3).

_LANG = {"value": "^(en|fr|de|es)$", "type": "REGEX"}


def default_classes_dicts() -> list[dict]:
    return [
        {"name": "article", "class": "POST", "priority": 0, "domain": "example.com",
         "match_subdomain": True, "allow_subdomain": True,
         "path": [_LANG, {"value": "^[0-9]+$", "type": "REGEX"}]},
        {"name": "article_file", "class": "FILE", "priority": 0, "domain": "example.com",
         "match_subdomain": True, "allow_subdomain": True,
         "path": [_LANG, {"value": "^[0-9]+[.]html$", "type": "REGEX"}]},
        {"name": "listing", "class": "LIST", "priority": 5, "domain": "example.org",
         "match_subdomain": True, "allow_subdomain": False,
         "path": [_LANG, {"value": "digits", "type": "REGEX"}],
         "query": {"page": {"value": "^[0-9]+$", "type": "REGEX", "default": "1"}}},
        {"name": "spam_farm", "class": "IGNORE", "priority": 10, "domain": "spam-farm.example.org",
         "match_subdomain": True, "allow_subdomain": True},
        {"name": "cheap_pills", "class": "IGNORE", "priority": 10, "domain": "cheap-pills.example.com",
         "match_subdomain": True, "allow_subdomain": True},
    ]


def default_parsers_dicts() -> list[dict]:
    return [
        {"name": "title", "type": "TAG",
         "operations": [{"type": "XPATH", "value": "//article/h1"}, {"type": "PREFIX", "value": "title:"}],
         "urls": ["https://a.example.com/en/1"]},
        {"name": "nav links", "type": "FOLLOW",
         "operations": [{"type": "XPATH", "value": "//nav//a/@href"}],
         "urls": ["https://a.example.com/en/1", "https://b.example.org/en/2"]},
        {"name": "ad text", "type": "CONTENT",
         "operations": [{"type": "XPATH", "value": "//div[contains(@class,'ad')]"}],
         "urls": ["https://a.example.com/en/1"]},
        {"name": "tracker", "type": "TAG",
         "operations": [{"type": "REGEX", "value": r"track\([0-9]+\)"}],
         "urls": ["https://a.example.com/en/1"]},
        {"name": "constant", "type": "NEXT",
         "operations": [{"type": "VALUE", "value": "/next"}, {"type": "SUFFIX", "value": "?page=2"}],
         "urls": ["https://b.example.org/en/2"]},
    ]


def default_rules() -> RuleSet:
    return RuleSet(load_classes(None), load_parsers(None))
