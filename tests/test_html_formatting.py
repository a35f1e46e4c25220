"""Misnested formatting elements, and hosts with other than ASCII characters."""

import random

import pytest
from pyspark.sql import functions as F

from webloom.functions import hosts
from webloom.operators import html_nodes


def tree(html):
    """The body as nested text, from the node rows."""
    rows = html_nodes.parse_nodes(html, want_text=True)
    kids = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)

    def show(r):
        if r[3] == "text":
            return r[10]
        return f"<{r[4]}>{''.join(map(show, kids.get(r[0], [])))}</{r[4]}>"

    body = next(r for r in rows if r[4] == "body")
    return "".join(map(show, kids.get(body[0], [])))


@pytest.mark.parametrize("html, want", [
    ("<p><b>x<p>y", "<p><b>x</b></p><p><b>y</b></p>"),
    ("<b><i>x</b>y</i>z", "<b><i>x</i></b><i>y</i>z"),
    ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
    ("<b><i></b></i>x", "<b><i></i></b>x"),
    ("<a>1<div>2</a>3</div>", "<a>1</a><div><a>2</a>3</div>"),
    ("<a>1<a>2", "<a>1</a><a>2</a>"),
    ("<div><b>x</div>y", "<div><b>x</b></div><b>y</b>"),
    ("<b><p>x</b><i>y</i></p>z", "<b></b><p><b>x</b><i>y</i></p>z"),
    ("<i><table><tr><td>x</i>y</td></tr></table>z", "<i><table><tbody><tr><td>xy</td></tr></tbody></table>z</i>"),
    ("<b>x<span>y</b>z</span>w", "<b>x<span>y</span></b>zw"),
    ("<em>a<strong>b<div>c</em>d</strong>e</div>f",
     "<em>a<strong>b</strong></em><strong></strong><div><strong><em>c</em>d</strong>e</div>f"),
    ("x</b>y", "xy"),
    ("<p>a<b>b</p>c</b>d", "<p>a<b>b</b></p><b>c</b>d"),
])
def test_misnested_formatting(html, want):
    assert tree(html) == want


def test_formatting_never_loses_text():
    rng = random.Random(1)
    tags = ["b", "i", "a", "p", "div", "span", "li", "ul", "table", "td", "tr", "em", "h1"]
    for _ in range(400):
        parts = [rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", f"t{i}"]) for i in range(rng.randint(1, 30))]
        rows = html_nodes.parse_nodes("".join(parts), want_text=True)
        assert "".join(r[10] for r in rows if r[3] == "text") == "".join(x for x in parts if x[0] == "t")
        whole = next((r[10] for r in rows if r[4] == "html"), "")
        assert whole == "".join(x for x in parts if x[0] == "t")


def test_ascii_form_of_hosts(spark):
    rng = random.Random(2)
    labels = ["bücher", "münchen", "日本語", "пример", "ñandú", "a", "xn--x", "straße", "😀", "é", "ab日cd語é", "αβγαβγ"]
    labels += ["".join(rng.choice("abcäöü日本語я") for _ in range(rng.randint(1, 25))) for _ in range(60)]
    hosts_in = [f"www.{x}.de" for x in labels] + ["WWW.BÜCHER.DE:80", "bücher.example.", "plain.example.com", "日本.日本"]
    got = spark.createDataFrame([(h,) for h in hosts_in], "h string").select("h", hosts.canonical_host(F.col("h")).alias("c")).collect()

    def plain(h):
        h = h.lower().removesuffix(":80").removesuffix(".")
        return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in h.split("."))

    assert {r["h"]: r["c"] for r in got} == {h: plain(h) for h in hosts_in}
    assert {r["h"]: r["c"] for r in got}["www.bücher.de"] == "www.xn--bcher-kva.de"
