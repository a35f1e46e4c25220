"""URL classification, normalisation and reference resolution (hand-written
vectors from the semantics in SURVEY 2.2; the reference has no tests here)."""

import pytest
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import classify as C
from webloom.sources import rules as R


def _classes(*dicts):
    return [R.url_class(d, i) for i, d in enumerate(dicts)]


def _norm(spark, classes, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return {r.url: (r.uclass, r.normalized_url) for r in C.classify(df, classes).collect()}


def test_priority_and_ties(spark):
    cls = _classes({"name": "a", "class": "POST", "priority": 1, "domain": "x.com"},
                   {"name": "b", "class": "LIST", "priority": 1, "domain": "x.com"},
                   {"name": "c", "class": "FILE", "priority": 0, "domain": "x.com"})
    got = _norm(spark, cls, ["https://x.com/p"])
    assert got["https://x.com/p"] == ("a", "https://x.com/")


def test_domain_port_and_subdomain(spark):
    cls = _classes({"name": "keep", "class": "POST", "domain": "x.com", "match_subdomain": True,
                    "allow_subdomain": True, "allow_http": True},)
    got = _norm(spark, cls, ["http://x.com:8080/a", "http://w.x.com:81/a", "http://wx.com/a"])
    assert got["http://x.com:8080/a"] == ("keep", "http://x.com:8080/")
    assert got["http://w.x.com:81/a"] == ("keep", "http://w.x.com:81/")
    assert got["http://wx.com/a"] == (None, None)
    cls = _classes({"name": "drop", "class": "POST", "domain": "x.com", "match_subdomain": True},)
    got = _norm(spark, cls, ["http://w.x.com:81/a?q=1#f", "ftp://u@x.com:9/"])
    assert got["http://w.x.com:81/a?q=1#f"] == ("drop", "https://x.com/#f")
    assert got["ftp://u@x.com:9/"] == ("drop", "https://u@x.com:9/")


def test_path_segments_defaults_and_extra(spark):
    cls = _classes({"name": "p", "class": "POST", "domain": "x.com",
                    "path": [{"value": "^a$", "type": "REGEX"}, {"value": "digits", "type": "REGEX", "default": "7"}]})
    got = _norm(spark, cls, ["https://x.com/a", "https://x.com/a/12/extra", "https://x.com/a/",
                             "https://x.com/b/1", "https://x.com/a/x9y"])
    assert got["https://x.com/a"] == ("p", "https://x.com/a/7")
    assert got["https://x.com/a/12/extra"] == ("p", "https://x.com/a/12")
    assert got["https://x.com/a/"] == (None, None)          # empty segment never takes the default
    assert got["https://x.com/b/1"] == (None, None)
    assert got["https://x.com/a/x9y"] == ("p", "https://x.com/a/x9y")   # unanchored named pattern


def test_query_rules(spark):
    cls = _classes({"name": "q", "class": "LIST", "domain": "x.com",
                    "query": {"page": {"value": "digits", "type": "REGEX", "default": "1"},
                              "a b": {"value": "", "type": "EXACT", "default": "v~*"}}})
    got = _norm(spark, cls, ["https://x.com/?page=2&page=3&z=1", "https://x.com/?page=x", "https://x.com/?page="])
    assert got["https://x.com/?page=2&page=3&z=1"] == ("q", "https://x.com/?a+b=v~%2A&page=2&page=3")
    assert got["https://x.com/?page=x"] == (None, None)
    assert got["https://x.com/?page="] == (None, None)


def test_exact_matcher_and_bad_regex(spark):
    cls = _classes({"name": "e", "class": "POST", "domain": "x.com", "path": [{"value": "Abc", "type": "EXACT"}]},
                   {"name": "bad", "class": "POST", "priority": 9, "domain": "x.com",
                    "path": [{"value": "(?=a)", "type": "REGEX"}]})
    got = _norm(spark, cls, ["https://x.com/Abc", "https://x.com/abc"])
    assert got["https://x.com/Abc"] == ("e", "https://x.com/Abc")
    assert got["https://x.com/abc"] == (None, None)


def test_class_matches_reason(spark):
    uc = _classes({"name": "p", "class": "POST", "domain": "x.com", "path": [{"value": "a", "type": "EXACT"}]})[0]
    df = spark.createDataFrame([("https://y.com/a",), ("https://x.com/b",), ("https://x.com",)], "url string")
    got = {r.url: r.reason for r in C.class_matches(df, uc).collect()}
    assert got == {"https://y.com/a": "domain mismatch", "https://x.com/b": "path segment mismatch",
                   "https://x.com": "path segment mismatch"}


RESOLVE = [
    ("http://a/b/c/d;p?q", "g", "http://a/b/c/g"),
    ("http://a/b/c/d;p?q", "./g", "http://a/b/c/g"),
    ("http://a/b/c/d;p?q", "g/", "http://a/b/c/g/"),
    ("http://a/b/c/d;p?q", "/g", "http://a/g"),
    ("http://a/b/c/d;p?q", "//g", "http://g"),
    ("http://a/b/c/d;p?q", "?y", "http://a/b/c/d;p?y"),
    ("http://a/b/c/d;p?q", "g?y", "http://a/b/c/g?y"),
    ("http://a/b/c/d;p?q", "#s", "http://a/b/c/d;p?q#s"),
    ("http://a/b/c/d;p?q", "", "http://a/b/c/d;p?q"),
    ("http://a/b/c/d;p?q", "..", "http://a/b/"),
    ("http://a/b/c/d;p?q", "../..", "http://a/"),
    ("http://a/b/c/d;p?q", "../../../g", "http://a/g"),
    ("http://a/b/c/d;p?q", "g;x=1/../y", "http://a/b/c/y"),
    ("https://h.example.com/en/1", "/für", "https://h.example.com/f%C3%BCr"),
    ("https://h.example.com/en/1", "a b", "https://h.example.com/en/a%20b"),
    ("https://h.example.com/en/1", "x:y z", "x:y z"),
    ("https://h.example.com/en/1", "a b:c", "a b:c"),
    ("https://h.example.com/en/1", "bad%zz", "bad%zz"),
    ("https://h.example.com/en/1", "a\nb", "a\nb"),
    ("https://h.example.com/en/1", "HTTPS://Other.org/./p", "https://Other.org/p"),
]


@pytest.mark.parametrize("base,ref,want", RESOLVE)
def test_resolve_reference(spark, base, ref, want):
    df = spark.createDataFrame([(base, ref)], "b string, r string")
    got = U.with_resolved(df, "b", "r", "out").collect()[0].out
    assert got == want


def test_path_escape(spark):
    df = spark.createDataFrame([("/a,b.c",), ("/ü x",), ("/a!(b)",)], "p string")
    got = [r.e for r in df.select(U.path_escape(F.col("p")).alias("e")).collect()]
    assert got == ["/a,b.c", "/%C3%BC%20x", "/a!(b)"]
