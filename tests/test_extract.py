"""Node arrays, the XPath subset, operation chains, rule validation."""

import json

import pytest
from pyspark.sql import functions as F

from webloom.operators import extract as X
from webloom.operators import html_nodes as H
from webloom.operators import xpath as XP
from webloom.sources import rules as R

SHOP = """<section data-k="list"><dl><dt>Pear<dd lang=en>green <i>fruit</i><dt>Oak<dd lang=de>Baum</dl>
<table><tr><td>1<td>2<tr><td>3</table></section><aside title="Note &lt;1&gt;">see <em>there</em>
<img alt="x" data-go="load('//cdn.test/a.png')"></aside><script>"<td>no</td>"</script>"""


def run(spark, ops, ptype="FOLLOW", html=SHOP):
    p = R.parser({"name": "t", "type": ptype, "operations": ops}, 0)
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return [r.value for r in X.apply_parser(df, p).orderBy("seq").collect()]


def names(html):
    rows = H.parse_nodes(html)
    by = {r[0]: r[4] for r in rows}
    return [(by.get(r[1], "#"), r[4], r[5]) for r in rows]


def test_implied_elements():
    assert names("<p>a<p>b<ul><li>x<li>y</ul>") == [
        ("#", "html", 1), ("html", "head", 1), ("html", "body", 1), ("body", "p", 1), ("body", "p", 2), ("body", "ul", 1),
        ("ul", "li", 1), ("ul", "li", 2)]
    assert names("<title>t</title>text") == [("#", "html", 1), ("html", "head", 1), ("head", "title", 1), ("html", "body", 1)]
    assert names("<table><tr><td>1<tr><td>2</table>")[3:] == [
        ("body", "table", 1), ("table", "tbody", 1), ("tbody", "tr", 1), ("tr", "td", 1), ("tbody", "tr", 2), ("tr", "td", 1)]
    assert names("<html><head></head><body><div/><b>in</b></div></body></html>")[3:] == [("body", "div", 1), ("div", "b", 1)]
    assert names("</p>")[3:] == [("body", "p", 1)]
    assert names("") == [] and names("  \n") == []
    assert [n for _, n, _ in names("<![x[ y ]]><u>z</u>")][3:] == ["u"]


@pytest.mark.parametrize("path,want", [
    ("//dl/dt", ["Pear", "Oak"]),
    ("//dl/dd[@lang='de']", ["Baum"]),
    ("//section[@data-k='list']//i", ["fruit"]),
    ("//dd[not(@lang='de') and starts-with(@lang, 'e')]", ["green fruit"]),
    ("//table/tbody/tr/td", ["1", "2", "3"]),
    ("//tr[2]/td[1]", ["3"]),
    ("/html/body/aside/@title", ["Note <1>"]),
    ("//img/@alt|@title", ["x"]),
    ("//aside//@alt", ["x"]),
    ("//@lang", ["en", "de"]),
    ("//dd/i | //em", ["fruit", "there"]),
    ("//aside/em/text()", ["there"]),
    ("//dd[contains(@lang, 'z') or @lang!='de']/*", ["fruit"]),
    ("//nothing//b", []),
])
def test_xpath(spark, path, want):
    assert run(spark, [{"type": "XPATH", "value": path}]) == want


def test_chains(spark):
    ops = [{"type": "XPATH", "value": "//img/@data-go"}, {"type": "REGEX", "value": "//[a-z.]+/[a-z.]+"},
           {"type": "PREFIX", "value": "https:"}, {"type": "SUFFIX", "value": "?s=1"}]
    assert run(spark, ops, "CONTENT") == ["https://cdn.test/a.png?s=1"]
    assert run(spark, [{"type": "XPATH", "value": "//dt"}], "TAG") == ["pear", "oak"]
    assert run(spark, [{"type": "XPATH", "value": "//dt"}, {"type": "VALUE", "value": "Any"}]) == ["Any"]
    assert run(spark, [{"type": "XPATH", "value": "//video"}, {"type": "VALUE", "value": "Any"}]) == []
    assert run(spark, [{"type": "REGEX", "value": "l[a-z]ng="}]) == ["lang=", "lang="]


def test_later_xpath_parses_values_as_documents(spark):
    page = "<ul><li title='<b>one</b><b>two</b>'><li title='<b>three</b>'></ul>"
    ops = [{"type": "XPATH", "value": "//li/@title"}, {"type": "XPATH", "value": "//b"}, {"type": "SUFFIX", "value": "!"}]
    assert run(spark, ops, html=page) == ["one!", "two!", "three!"]
    assert run(spark, [*ops, {"type": "VALUE", "value": "v"}], html=page) == ["v"]


def test_one_pass_without_shuffle(spark):
    pages = spark.createDataFrame([(1, "c", "https://a.test/x", SHOP)], "page_id long, uclass string, url string, html string")
    bind = {"c": [R.parser({"name": n, "type": "TAG", "operations": [{"type": "XPATH", "value": v}]}, i)
                  for i, (n, v) in enumerate([("a", "//dl//i"), ("b", "//td"), ("d", "//aside//em")])]}
    df = X.page_results(pages, bind)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Exchange" not in plan and "Join" not in plan
    got = {(r.parser, r.seq): r.value for r in df.collect()}
    assert got == {(None, 0): "https://a.test/x", ("a", 0): "fruit", ("b", 0): "1", ("b", 1): "2", ("b", 2): "3", ("d", 0): "there"}


def rule(op, value):
    return R.parser({"name": "n", "type": "TAG", "operations": [{"type": op, "value": value}]}, 0)


@pytest.mark.parametrize("op,value", [("XPATH", "//a[position() > 2]"), ("XPATH", "//*[2]"), ("XPATH", "//a["), ("REGEX", "a*"),
                                      ("REGEX", r"\b"), ("REGEX", "(?=x)y"), ("REGEX", "("), ("REGEX", "(?U)a+")])
def test_bad_rules_raise_at_load(op, value):
    with pytest.raises(R.RuleError):
        rule(op, value)
    with pytest.raises(R.RuleError):
        R.parser({"name": "n", "type": "TAG", "operations": []}, 0)


def test_rules_load_alike_from_every_source(spark, tmp_path):
    dicts = [{"name": "a", "class": "POST", "priority": 1, "domain": "a.test", "query": {"p": {"value": "1"}}, "ordinal": 0},
             {"name": "b", "class": "LIST", "priority": 0, "domain": "b.test", "query": {"q": {"value": "digits", "type": "REGEX"}},
              "ordinal": 1}]
    file = tmp_path / "rules.json"
    file.write_text(json.dumps(dicts))
    want = R.load_classes(dicts)
    assert R.load_classes(str(file), spark) == want == R.load_classes(str(file))
    assert R.load_classes(R.classes_dataframe(spark, want), spark) == want
    assert R.load_classes(str(tmp_path / "none.json"), spark) == R.load_classes()
    many = R.load_classes([{"name": f"c{i}", "domain": f"d{i}.test"} for i in range(10_500)])
    assert len(many) == 10_500


@pytest.mark.parametrize("pattern,text,want", [("x.+y", "x\ry", True), ("[[:digit:]]z", "7z", True), (r"\pLz", "éz", True), (r"q\z", "pq", True),
                                               ("[+?]k", "+k", True), ("q$", "q\n", False), (r"\s", "\x0b", False), ("[[q]", "[", True)])
def test_re2_dialect(spark, pattern, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.col("t").rlike(R.to_java_regex(pattern))).first()[0] is want


def test_unsupported_paths():
    for bad in ("//a[last()]", "a b", "//a/..", "//@x/y"):
        with pytest.raises(XP.XPathError):
            XP.compile_xpath(bad)
