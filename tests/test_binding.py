"""Class-parser binding over sample URLs."""

import pytest

from webloom.operators import binding as B
from webloom.sources import rules as R

CLASSES = R.load_classes([{"name": "post", "class": "POST", "domain": "p.test"}, {"name": "list", "class": "LIST", "domain": "l.test"}])


def parser(name, kind, urls):
    return R.parser({"name": name, "type": kind, "operations": [{"type": "VALUE", "value": "v"}], "urls": urls}, 0)


def bound(spark, parsers, **kw):
    return sorted((r.uclass, r.parser) for r in B.binding(spark, CLASSES, parsers, **kw).collect())


def test_typed_and_untyped(spark):
    ps = [parser("tag", "TAG", ["https://p.test/", "https://l.test/"]), parser("next", "NEXT", ["https://l.test/x"]),
          parser("src", "SOURCE", ["https://p.test/"])]
    assert bound(spark, ps) == [("list", "next"), ("post", "tag")]
    assert bound(spark, ps, typed=False) == [("list", "next"), ("list", "tag"), ("post", "src"), ("post", "tag")]


@pytest.mark.parametrize("url", ["https://p.test:port/", "https://p.test/%zz", "https://p.test/\x01"])
def test_bad_sample_url(spark, url):
    ps = [parser("tag", "TAG", [url])]
    assert bound(spark, ps) == []
    with pytest.raises(R.RuleError):
        bound(spark, ps, strict=True)
