"""Registered cookie queries (FIXTURES 2.7): ``events`` replayed as
Set-Cookie events and requests; ``jar_id = user_id % 10`` is an extra jar
partition, host ``u{event_id % 5}.example.com``, events ordered by
(ts, event_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import hosts as HS
from webloom.functions import urls as U
from webloom.operators import cookies as CK
from webloom.session import cut_lineage
from webloom.sources import tables
from webloom.streaming import jobs as S


def _events(spark, sf_dir):
    return _shaped(tables.events(spark, sf_dir, "event_id", "ts", "user_id", "event_type"))


def _shaped(e):
    host = F.concat(F.lit("u"), (F.col("event_id") % 5).cast("string"), F.lit(".example.com"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("jar_id"),
                    "event_type", host.alias("host"))


def set_events(spark, sf_dir):
    return sets_of(_events(spark, sf_dir))


def sets_of(e):
    e = e.where(F.col("event_type").isin("click", "signup", "purchase", "error"))
    t = F.col("event_type")
    eid = F.col("event_id").cast("string")
    return e.select(
        "jar_id", "event_id", F.lit(0).alias("ordinal"), "ts",
        F.concat(F.lit("https://"), "host", F.lit("/login")).alias("url"),
        F.when(t == "click", "c").when(t == "signup", "s").when(t == "purchase", "p").otherwise("c").alias("name"),
        F.when(t == "error", F.lit("")).otherwise(eid).alias("value"),
        F.when(t == "signup", F.lit(".example.com")).alias("domain_attr"),
        F.when(t == "signup", F.lit("/")).when(t == "purchase", F.lit("/shop")).alias("path_attr"),
        F.when(t == "signup", F.lit(86400)).when(t == "purchase", (F.col("event_id") % 48 + 1) * 3600)
        .when(t == "error", F.lit(-1)).cast("int").alias("max_age"),
        F.lit(None).cast("timestamp").alias("expires"),
        (t == "purchase").alias("secure"), F.lit(False).alias("httponly"))


def request_events(spark, sf_dir):
    return requests_of(_events(spark, sf_dir))


def requests_of(e):
    e = e.where(F.col("event_type") == "view")
    scheme = F.when(F.col("event_id") % 2 == 1, F.lit("http")).otherwise(F.lit("https"))
    return e.select("jar_id", "event_id", "ts", F.concat(scheme, F.lit("://"), "host", F.lit("/shop/"),
                                                           F.col("event_id").cast("string")).alias("url"))


def _state(spark, sf_dir):
    reqs = cut_lineage(CK.requests_prepared(request_events(spark, sf_dir)))
    vers = CK.versions(CK.entries(set_events(spark, sf_dir)), reqs)
    return vers, reqs


def _page_hosts(spark, sf_dir):
    p = U.with_url_parts(tables.pages(spark, sf_dir, "page_id", "url"), "url", "_u")
    return p.select("page_id", F.col("_u")["host"].alias("host"), F.col("_u")["path"].alias("path"))


def canonical_hosts(spark, sf_dir):
    h = _page_hosts(spark, sf_dir)
    c = HS.canonical_host(F.col("host"))
    return h.select("page_id", "host", c.alias("canonical_host"), HS.is_ip(c).alias("is_ip"))


def registrable_domain(spark, sf_dir):
    h = _page_hosts(spark, sf_dir).withColumn("c", HS.canonical_host(F.col("host")))
    # One rule of the suffix table has two labels, as registries with subdomains have.
    rules = F.explode(F.array(*map(F.lit, ("com", "net", "org", "example.net"))))
    h = CK._with_suffix(h, "c", "suffix", spark.range(1).select(rules.alias("suffix")))
    return h.select("page_id", HS.jar_key(F.col("c")).alias("jar_key"),
                    HS.jar_key_with_suffix(F.col("c"), F.col("suffix")).alias("site"))


def default_path(spark, sf_dir):
    return _page_hosts(spark, sf_dir).select("page_id", HS.default_path(F.col("path")).alias("default_path"))


def cookie_versions(spark, sf_dir):
    vers, _ = _state(spark, sf_dir)
    return vers.select("jar_id", "cookie_id", "valid_from", "valid_to", "value", "creation", "expires", "persistent")


VERSION_COLUMNS = ["jar_id", "cookie_id", "valid_from", "valid_to", "value", "creation", "expires", "persistent"]


def prepared(raw):
    """Raw events -> (entries, requests)."""
    e = _shaped(raw)
    return CK.entries(sets_of(e)), CK.requests_prepared(requests_of(e))


def cookie_resume(spark, sf_dir):
    """Replay half of the events, save the state, restore it, go on."""
    raw = tables.events(spark, sf_dir, "event_id", "ts", "user_id", "event_type")
    middle = raw.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    late = F.unix_micros(F.col("ts").cast("timestamp")) >= F.lit(middle)
    base = S.work_dir(spark, "resume")
    ended, state = CK.advance(*prepared(raw.where(~late)))
    ended.write.parquet(f"{base}/ended")
    CK.save_state(state, f"{base}/state")
    more, state = CK.advance(*prepared(raw.where(late)), CK.load_state(spark, f"{base}/state"))
    more.write.parquet(f"{base}/more")
    CK.save_state(state, f"{base}/last")
    every = (spark.read.parquet(f"{base}/ended", f"{base}/more")
             .unionByName(CK.open_versions(CK.load_state(spark, f"{base}/last"))))
    return every.select(*VERSION_COLUMNS)


def cookies_for_requests(spark, sf_dir):
    vers, reqs = _state(spark, sf_dir)
    return CK.cookies_for_requests(vers, reqs).select("jar_id", "req_id", "cookies")


def cookie_last_access(spark, sf_dir):
    vers, reqs = _state(spark, sf_dir)
    return CK.last_access(vers, reqs).select("jar_id", "cookie_id", "last_access")


def cookie_table(spark, sf_dir):
    """The events as an exported browser cookie table (A7 input)."""
    s = set_events(spark, sf_dir).where(F.col("max_age").isNull() | (F.col("max_age") >= 0))
    us = F.unix_micros("ts") + F.lit(CK.WINDOWS_EPOCH_OFFSET_US)
    host = F.regexp_extract("url", "^https://([^/]*)", 1)
    return s.select("name", "value", F.coalesce("path_attr", F.lit("/")).alias("path"),
                    F.coalesce("domain_attr", host).alias("host_key"), us.alias("creation_utc"),
                    F.when(F.col("max_age").isNull(), F.lit(0).cast("bigint"))
                    .otherwise(us + F.col("max_age").cast("bigint") * 1000000).alias("expires_utc"),
                    F.col("secure").alias("is_secure"))


def cookie_table_scan(spark, sf_dir):
    t = CK.cookie_table_scan(cookie_table(spark, sf_dir), "U1.example.com")
    return t.select("name", "value", "path", "host_key", "creation_utc",
                    CK.browser_epoch_to_unix(F.col("expires_utc")).alias("expires"), "is_secure")


QUERIES = {
    "canonical_hosts": canonical_hosts,
    "registrable_domain": registrable_domain,
    "default_path": default_path,
    "cookie_versions": cookie_versions,
    "cookie_resume": cookie_resume,
    "cookies_for_requests": cookies_for_requests,
    "cookie_last_access": cookie_last_access,
    "cookie_table_scan": cookie_table_scan,
}
