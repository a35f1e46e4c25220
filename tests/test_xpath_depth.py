"""Descendant and child steps on nested pages, against a plain walk of the tree, and on very deep pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from webloom.operators import html_nodes, xpath

PATHS = ["//div//p", "//div/p", "//div//div//b", "//div[@k='1']//p", "//div//@k", "//div/@k", "//p//text()", "//div/text()",
         "//div//*", "//div[2]//b", "//b|//div//p", "/html/body/div/div", "//div/*/b"]


def walked(html, path):
    """(pre, sub, value) of a union of paths by following every context node by itself."""
    rows = html_nodes.parse_nodes(html, want_text=True)
    up = {r[0]: r[1] for r in rows}

    def above(n):
        out = []
        while up.get(n):
            n = up[n]
            out.append(n)
        return out

    found = set()
    for p in xpath.compile_xpath(path):
        ctx = {0}
        for s in p.steps:
            if s.kind == "attr":
                own = {r[0] for r in rows if r[0] in ctx or s.axis == "descendant" and (ctx == {0} or ctx & set(above(r[0])))}
                found |= {(r[0], 1, r[6][s.name]) for r in rows if r[0] in own and r[3] == "elem" and s.name in r[6]}
                break
            on = [r for r in rows if (r[1] in ctx if s.axis == "child" else ctx == {0} or ctx & set(above(r[0])))]
            if s.kind == "text":
                found |= {(r[0], 0, r[10]) for r in on if r[3] == "text"}
                break
            on = [r for r in on if r[3] == "elem" and s.name in ("*", r[4]) and s.position in (None, r[5])
                  and all(r[6].get(q[1]) == q[2] for q in s.preds)]
            ctx = {r[0] for r in on}
            if s is p.steps[-1]:
                found |= {(r[0], 0, r[10]) for r in on}
    return [v for _, _, v in sorted(found, key=lambda x: x[:2]) if v]


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(5)
    out = ["", "<div>", "x", "<div k=1><div k=2><p>a<b>c</b></div><p>b</div><p>z"]
    for _ in range(60):
        parts = []
        for i in range(rng.randint(5, 60)):
            tag = rng.choice(["div", "p", "b", "ul", "li", "span"])
            parts.append(rng.choice([f"<{tag} k={i % 3}>", f"<{tag}>", f"</{tag}>", f"t{i}"]))
        out.append("".join(parts))
    return out


def test_steps_equal_a_plain_walk(spark, pages):
    df = html_nodes.with_nodes(spark.createDataFrame(list(enumerate(pages)), "id int, html string"), want_text=True)
    got = df.select("id", *[xpath.values(F.col("nodes"), xpath.compile_xpath(p)).alias(f"c{i}") for i, p in enumerate(PATHS)])
    for r in got.collect():
        for i, p in enumerate(PATHS):
            assert r[f"c{i}"] == walked(pages[r["id"]], p), (p, pages[r["id"]])


def test_deep_page_takes_time_linear_in_its_nodes(spark):
    def run(depth):
        page = "<div>" * depth + "<p><b>x</b>" + "</div>" * depth
        df = html_nodes.with_nodes(spark.createDataFrame([(page,)], "html string"), {"div", "p", "b"}, {"b"}, drop_html=True)
        at = time.time()
        got = df.select(xpath.values(F.col("nodes"), xpath.compile_xpath("//div//div//p/b")).alias("v")).collect()
        assert [r["v"] for r in got] == [["x"]]
        return time.time() - at

    run(10)
    few, many = run(4_000), run(20_000)
    assert many < 7 * max(few, 1.0)


def test_wide_page(spark):
    page = "".join(f"<div><p>{i}</div>" for i in range(20_000))
    df = html_nodes.with_nodes(spark.createDataFrame([(page,)], "html string"))
    got = df.select(xpath.values(F.col("nodes"), xpath.compile_xpath("//div/p")).alias("v"),
                    xpath.values(F.col("nodes"), xpath.compile_xpath("//div//p")).alias("w")).first()
    assert got["v"] == got["w"] == [str(i) for i in range(20_000)]


def test_nodes_are_made_in_slices(spark):
    """A batch of thousands of pages is not held as nodes at once; the rows stay those of the pages."""
    bodies = ["<p>x</p>"] * 2000 + [None, "y" * (html_nodes.SLICE_CHARS + 5), "z"]
    cuts = html_nodes.slices(bodies)
    assert [a for a, _ in cuts] == [0] + [b for _, b in cuts[:-1]] and cuts[-1][1] == len(bodies)
    assert all(b - a <= html_nodes.SLICE_ROWS for a, b in cuts) and len(cuts) >= 5
    assert html_nodes.slices([]) == []
    docs = spark.createDataFrame([(i, f"<p>{i}</p><b>{i % 3}</b>", i % 5 != 0) for i in range(1500)], "id long, html string, w boolean").coalesce(1)
    got = html_nodes.with_nodes(docs, wanted_col="w", drop_html=True).collect()
    assert [r["id"] for r in got] == list(range(1500))
    for r in got:
        want = html_nodes.parse_nodes(f"<p>{r['id']}</p><b>{r['id'] % 3}</b>") if r["w"] else []
        assert [(n["pre"], n["name"], n["value"]) for n in r["nodes"]] == [(n[0], n[4], n[10]) for n in want]
