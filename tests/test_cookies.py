"""Hosts and cookie state through DataFrames; cases follow RFC 6265."""

import datetime as dt
import ipaddress

import pytest
from pyspark.sql import functions as F

from webloom.functions import hosts as HS
from webloom.operators import cookies as CK

T0 = dt.datetime(2024, 3, 1, 8)
SETS = ("jar_id long, event_id long, ordinal int, ts timestamp, url string, name string, value string, domain_attr string, "
        "path_attr string, max_age int, expires timestamp, secure boolean, httponly boolean, same_site string")


def at(sec):
    return T0 + dt.timedelta(seconds=sec)


def put(sec, url, name, value="v", domain=None, path=None, age=None, expires=None, secure=False, same=None, jar=1):
    return (jar, sec * 10, 0, at(sec), url, name, value, domain, path, age, expires, secure, False, same)


def play(spark, sets, reqs, suffixes=None):
    s = spark.createDataFrame(sets, SETS)
    r = spark.createDataFrame([(1, sec * 10 + 5, at(sec), u) for sec, u in reqs], "jar_id long, event_id long, ts timestamp, url string")
    table = None if suffixes is None else spark.createDataFrame([(x,) for x in suffixes], "suffix string")
    r = CK.requests_prepared(r, suffixes=table)
    v = CK.versions(CK.entries(s, suffixes=table), r)
    return [x.cookies for x in CK.cookies_for_requests(v, r).orderBy("req_id").collect()], v, r


def test_ip_literals(spark):
    texts = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "::", "::1", "1::", "1:2:3", "12345::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9",
             "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7::8", "::ffff:10.0.0.1", "1::2::3", "fe80::a:b", "g::1", "1:2:3:4:5:6:1.2.3.4", "a.b", ""]

    def is_ip(t):
        try:
            ipaddress.ip_address(t)
            return True
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.ip for r in df.select("t", HS.is_ip(F.col("t")).alias("ip")).collect()} == {t: is_ip(t) for t in texts}


def test_suffix_table(spark):
    hosts = {"www.shop.co.test": "shop.co.test", "shop.co.test": "shop.co.test", "co.test": "co.test", "a.b.site": "b.site", "10.0.0.7": "10.0.0.7"}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    rules = spark.createDataFrame([("test",), ("co.test",)], "suffix string")
    got = CK._with_suffix(df, "h", "s", rules).select("h", HS.jar_key_with_suffix(F.col("h"), F.col("s")).alias("k")).collect()
    assert {r.h: r.k for r in got} == hosts


def test_domain_and_path_rules(spark):
    u = "https://www.shop.test/a/b/c"
    got, *_ = play(spark, [put(1, u, "host"), put(2, u, "dom", domain="shop.test", path="/"), put(3, u, "foreign", domain="else.test"),
                           put(4, u, "deep", path="/a/b/c/d"), put(5, u, "sec", path="/", secure=True), put(6, u, "rel", path="a")],
                   [(10, u), (11, "https://www.shop.test/a/bc"), (12, "https://img.shop.test/a/b"), (13, "http://www.shop.test/"),
                    (14, "https://www.shop.test/a/b/c/d/e")])
    assert got == ["host=v rel=v dom=v sec=v", "dom=v sec=v", "dom=v", "dom=v", "deep=v host=v rel=v dom=v sec=v"]


def test_public_suffix_is_refused(spark):
    sets = [put(1, "https://a.co.test/", "wide", domain="co.test"), put(2, "https://a.co.test/", "own", domain="a.co.test"),
            put(3, "https://co.test/", "self", domain="co.test")]
    reqs = [(10, "https://b.co.test/"), (11, "https://x.a.co.test/"), (12, "https://co.test/")]
    assert play(spark, sets, reqs, ["test", "co.test"])[0] == ["", "own=v", "self=v"]


@pytest.mark.parametrize("host", ["", ".", "h"])
def test_short_hosts(spark, host):
    assert play(spark, [put(1, f"http://{host}/", "k")], [(2, f"http://{host}/")])[0] == ["k=v"]


def test_escaped_paths(spark):
    got, *_ = play(spark, [put(1, "https://s.test/", "k", path="/x y"), put(2, "https://s.test/p%20q/z", "d")],
                   [(5, "https://s.test/x%20y/1"), (6, "https://s.test/x+y"), (7, "https://s.test/p%20q")])
    assert got == ["k=v", "", "d=v"]


def test_update_keeps_creation_and_delete_does_not(spark):
    u = "https://s.test/"
    sets = [put(1, u, "a", "1"), put(2, u, "b", "1"), put(3, u, "a", "2"), put(5, u, "a", age=-1), put(6, u, "a", "3"),
            put(7, u, "b", "x", expires=at(7))]
    got, *_ = play(spark, sets, [(4, u), (6, u), (8, u)])
    assert got == ["a=2 b=1", "b=1 a=3", "a=3"]


def test_expiry_and_last_access(spark):
    u = "https://s.test/"
    got, v, r = play(spark, [put(1, u, "short", age=4), put(2, u, "long", age=100), put(3, u, "gone"), put(4, u, "gone", age=-1), put(5, u, "s")],
                     [(4, u), (5, u), (9, u)])
    assert got == ["short=v long=v", "long=v s=v", "long=v s=v"]
    last = {x.cookie_id.split(";")[-1]: x.last_access for x in CK.last_access(v, r).collect()}
    assert last == {"long": at(9), "s": at(9)}


def test_same_site(spark):
    u = "https://s.test/"
    s = spark.createDataFrame([put(i, u, f"k{i}", same=m) for i, m in enumerate(["Default", "strict", "Lax", "none", None])], SETS)
    got = [x.same_site for x in CK.entries(s).orderBy("event_id").collect()]
    assert got == ["SameSite", "SameSite=Strict", "SameSite=Lax", "", ""]
