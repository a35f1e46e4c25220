"""Cookie state as a versioned table.

The reference keeps an in-memory jar and mutates it per Set-Cookie and per
request.  Here Set-Cookie events become a version table (SCD2) with window
functions, and the cookies sent with a request are an equi-join on the jar
key plus an interval predicate:

* ``entries``   - H5-H7 per Set-Cookie row (Column expressions).
* ``versions``  - H8 + H15: per (jar, cookie id), ordered by
  (ts, event_id, ordinal): a delete or a purge starts a new segment; the
  creation time and sequence are those of the segment's first set; a version
  is valid until the next event of the same cookie.
* ``cookies_for_requests`` - H13/H14: versions valid at the request time,
  not expired, passing the send predicate, ordered by path length desc,
  creation asc, sequence asc, by an as-of join.

No window holds a whole jar or cookie: they run inside time buckets
(``operators.timeline``), so a jar with a third of all events is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import hosts as HS
from webloom.functions import urls as U
from webloom.operators import store
from webloom.operators import timeline as TL
from webloom.session import cut_lineage, stored

JAR = ["jar_id", "jar_key"]


SMALL_SUFFIXES = 100_000


def public_suffix(names: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(name, suffix) for distinct host names: the longest listed suffix at a
    label boundary, by default the last label.  suffixes: column ``suffix``."""
    labels = F.split("name", "[.]")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = names.where("name is not null and name != ''").select("name").distinct()
    listed = suffixes.select(F.col("suffix").alias("tail")).distinct()
    listed = F.broadcast(listed) if listed.count() <= SMALL_SUFFIXES else listed
    best = (named.select("name", F.explode(tails).alias("tail")).join(listed, "tail").groupBy("name")
            .agg(F.max_by("tail", F.length("tail")).alias("found")))
    return named.join(best, "name", "left").select("name", F.coalesce("found", F.element_at(labels, -1)).alias("suffix"))


def _with_suffix(df: DataFrame, col: str, out: str, suffixes: DataFrame) -> DataFrame:
    found = public_suffix(df.select(F.col(col).alias("name")), suffixes)
    return df.join(found.select(F.col("name").alias(col), F.col("suffix").alias(out)), col, "left")


def _url_fields(df: DataFrame, url_col: str, suffixes: DataFrame | None = None) -> DataFrame:
    d = U.with_url_parts(df, url_col, "_u")
    u = F.col("_u")
    # Paths are compared decoded; '+' is an ordinary character of a path.
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(u["path"], "[+]", "%2B")), u["path"])
    d = U.materialize(d, scheme=u["scheme"], _raw_host=F.lower(u["host"]), req_path=plain).drop("_u")
    d = U.materialize(d, host=HS.canonical_host(F.col("_raw_host"))).drop("_raw_host")
    d = d.where(F.col("scheme").isin("http", "https") & F.col("host").isNotNull())
    if suffixes is None:
        return U.materialize(d, jar_key=HS.jar_key(F.col("host")))
    d = _with_suffix(d, "host", "_suffix", suffixes)
    return U.materialize(d, jar_key=HS.jar_key_with_suffix(F.col("host"), F.coalesce("_suffix", "host"))).drop("_suffix")


def entries(sets: DataFrame, url_col: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """H5-H7 for rows (jar_id, event_id, ordinal, ts, url, name, value,
    domain_attr, path_attr, max_age, expires, secure, httponly[, same_site]).
    Rejected cookies and non-http(s) URLs are dropped; ``remove`` marks
    deletions.  With a suffix table, cookies for a whole public suffix are refused."""
    d = _url_fields(sets, url_col, suffixes)
    if suffixes is None:
        kind = HS.domain_and_type(F.col("host"), F.col("domain_attr"))
    else:
        d = _with_suffix(d.withColumn("_attr", F.lower(F.regexp_replace("domain_attr", "^[.]", ""))), "_attr", "_ps", suffixes)
        kind = HS.domain_and_type(F.col("host"), F.col("domain_attr"), F.col("_ps"))
    d = U.materialize(d, _dt=kind)
    d = d.where(F.col("_dt")["error"].isNull())
    mode = F.lower("same_site") if "same_site" in sets.columns else F.lit(None).cast("string")
    same_site = (F.when(mode == "default", "SameSite").when(mode == "strict", "SameSite=Strict")
                 .when(mode == "lax", "SameSite=Lax").otherwise(""))
    path = F.when(F.col("path_attr").startswith("/"), F.col("path_attr")).otherwise(HS.default_path(F.col("req_path")))
    ma = F.coalesce(F.col("max_age"), F.lit(0))
    remove = (ma < 0) | ((ma == 0) & F.col("expires").isNotNull() & (F.col("expires") <= F.col("ts")))
    expires = (F.when(ma > 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ma.cast("decimal(18,6)")))
               .when(F.col("expires").isNull(), F.lit(HS.END_OF_TIME).cast("timestamp"))
               .otherwise(F.col("expires")))
    persistent = (ma > 0) | F.col("expires").isNotNull()
    return d.select(
        "jar_id", "jar_key", "event_id", "ordinal", "ts",
        HS.cookie_id(F.col("_dt")["domain"], path, F.col("name")).alias("cookie_id"),
        "name", "value", F.col("_dt")["domain"].alias("domain"), path.alias("path"),
        F.col("_dt")["host_only"].alias("host_only"), F.coalesce("secure", F.lit(False)).alias("secure"),
        F.coalesce("httponly", F.lit(False)).alias("httponly"), persistent.alias("persistent"),
        expires.alias("expires"), same_site.alias("same_site"), remove.alias("remove"))


def requests_prepared(requests: DataFrame, url_col: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """Request rows (jar_id, event_id, ts, url) with host, jar key, https flag
    and request path ('' -> '/')."""
    d = _url_fields(requests, url_col, suffixes)
    return (d.withColumn("https", F.col("scheme") == "https")
            .withColumn("req_path", F.when(F.col("req_path") == "", F.lit("/")).otherwise(F.col("req_path"))))


_KEPT = ["cookie_id", "name", "value", "domain", "path", "host_only", "secure", "httponly", "same_site", "persistent",
         "expires"]
_ORDER = ["ts", "event_id", "ordinal"]


def _replay(ents: DataFrame, reqs: DataFrame | None, cookies: DataFrame | None, reads: DataFrame | None,
            rows: int = TL.ROWS) -> DataFrame:
    """Set and delete events in order, with the bounds of their versions.

    cookies, reads: a state (see :func:`advance`) whose events all lie before
    those of ``ents`` and ``reqs``; its rows go first in their cookie's order.
    Windows run inside time buckets of about ``rows`` events (``timeline``).
    """
    e = ents.withColumn("_kind", F.when(F.col("remove"), F.lit("del")).otherwise(F.lit("set"))).select(
        *JAR, *_ORDER, *_KEPT, "_kind", F.col("ts").alias("c_ts"), F.col("event_id").alias("c_eid"), F.col("ordinal").alias("c_ord"))
    none = F.lit(None).cast("struct<ts:timestamp,event_id:bigint>")
    # The last read on the jar before each event (reads purge
    # expired entries, so a later set gets a new creation time)
    rd = None if reqs is None else reqs.select(*JAR, "ts", "event_id")
    if reads is not None:
        old = reads.select(*JAR, F.col("read_ts").alias("ts"), F.col("read_eid").alias("event_id"))
        rd = old if rd is None else rd.unionByName(old)
    every = e.withColumn("_read", none)
    if rd is not None:
        rd = rd.withColumn("ordinal", F.lit(-1)).withColumn("_read", F.struct("ts", "event_id"))
        every = every.unionByName(rd, allowMissingColumns=True)
    # What is read more than once is stored: without that each step would run all before it two or three times.
    every = stored(every, "events")
    bounds = TL.bucket_bounds(every.select("ts"), rows)
    bucket = TL.bucket_of(F.col("ts"), bounds).alias(TL.BUCKET)
    every = every.select("*", bucket)
    if rd is None:
        e = every.withColumnRenamed("_read", "_last_read")
    else:
        e = (TL.carry(every, JAR, _ORDER, F.col("_read"), "_last_read", bounds)
             .where(F.col("_kind").isNotNull()).drop("_read"))
    if cookies is not None:
        e = e.unionByName(cookies.select("*", bucket, none.alias("_last_read")))
    own = [*JAR, "cookie_id"]
    e = stored(e, "read") if bounds else e
    w = Window.partitionBy(*own, TL.BUCKET).orderBy(TL.EDGE, *_ORDER)
    e = TL.with_neighbours(e, own, _ORDER, bounds)
    e = (e.withColumn("_pk", F.lag("_kind").over(w)).withColumn("_pts", F.lag("ts").over(w))
         .withColumn("_peid", F.lag("event_id").over(w)).withColumn("_pexp", F.lag("expires").over(w))
         .withColumn("_ppers", F.lag("persistent").over(w))
         .withColumn("valid_to", F.lead("ts").over(w)).withColumn("to_eid", F.lead("event_id").over(w))
         .where(F.col(TL.EDGE) == 1).drop(TL.EDGE))
    purged = ((F.col("_pk") == "set") & F.col("_ppers") & F.col("_last_read").isNotNull()
              & (F.col("_last_read") > F.struct(F.col("_pts").alias("ts"), F.col("_peid").alias("event_id")))
              & (F.col("_last_read")["ts"] >= F.col("_pexp")))
    # A segment begins at a first set, after a delete and after a purge; its events share its creation.
    begins = F.col("_pk").isNull() | (F.col("_pk") == "del") | F.coalesce(purged, F.lit(False))
    e = e.withColumn("_begin", F.when(begins, F.struct("c_ts", "c_eid", "c_ord"))).drop(
        "_pk", "_pts", "_peid", "_pexp", "_ppers", "_last_read")
    e = TL.carry(stored(e, "begins") if bounds else e, own, _ORDER, F.col("_begin"), "_first", bounds).drop("_begin")
    return (e.drop("c_ts", "c_eid", "c_ord", TL.BUCKET)
            .select("*", F.col("_first")["c_ts"].alias("c_ts"), F.col("_first")["c_eid"].alias("c_eid"),
                    F.col("_first")["c_ord"].alias("c_ord")))


def _as_versions(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_kind") == "set").select(
        *JAR, *_KEPT, F.col("c_ts").alias("creation"), F.col("c_eid").alias("seq_eid"), F.col("c_ord").alias("seq_ord"),
        F.col("ts").alias("valid_from"), F.col("event_id").alias("from_eid"), "valid_to", "to_eid")


def versions(ents: DataFrame, reqs: DataFrame | None = None, rows: int = TL.ROWS) -> DataFrame:
    """H8 + H15: SCD2 versions (jar_id, jar_key, cookie_id, name, value,
    domain, path, host_only, secure, httponly, same_site, persistent, expires,
    creation, seq_eid, seq_ord, valid_from, from_eid, valid_to, to_eid)."""
    return _as_versions(_replay(ents, reqs, None, None, rows))


# ---- H9, H17: the state between batches ------------------------------------

def advance(ents: DataFrame, reqs: DataFrame, state: dict[str, DataFrame] | None = None):
    """One step of the cookie state: events later than all before them ->
    (versions that ended, new state).

    The state is two tables: ``cookies``, the last event of each cookie with the
    creation time and sequence of its segment, and ``reads``, the last read of
    each jar.  It grows with the cookies, not with the events.  The ended versions of all
    steps and :func:`open_versions` of the last state are the table that
    :func:`versions` makes of all events at once.
    """
    state = state or {}
    rows = stored(_replay(ents, reqs, state.get("cookies"), state.get("reads")), "replayed")
    last = rows.where("valid_to is null").select(*JAR, *_ORDER, *_KEPT, "_kind", "c_ts", "c_eid", "c_ord")
    read = reqs.select(*JAR, F.col("ts").alias("read_ts"), F.col("event_id").alias("read_eid"))
    read = read.unionByName(state["reads"]) if state else read
    read = (read.groupBy(*JAR).agg(F.max(F.struct("read_ts", "read_eid")).alias("r"))
            .select(*JAR, "r.read_ts", "r.read_eid"))
    return _as_versions(rows.where("valid_to is not null")), {"cookies": last, "reads": read}


def open_versions(state: dict[str, DataFrame]) -> DataFrame:
    ends = {"valid_to": F.lit(None).cast("timestamp"), "to_eid": F.lit(None).cast("bigint")}
    return _as_versions(state["cookies"].withColumns(ends))


def _jar_bucket(buckets: int = store.BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*JAR), F.lit(buckets)).cast("int").alias(store.BUCKET)


def touched_buckets(ents: DataFrame, reqs: DataFrame) -> list[int]:
    """The buckets of the jars that a batch writes or reads."""
    both = ents.select(_jar_bucket()).unionByName(reqs.select(_jar_bucket())).distinct()
    return [r[0] for r in both.collect()]  # at most store.BUCKETS numbers


def save_state(state: dict[str, DataFrame], path: str, batch: int = 0) -> None:
    """Write the state, or the buckets of it that a batch touched, as number ``batch``.
    Older numbers stay, so a batch that is run again starts from the same state."""
    for name, df in state.items():
        df.limit(0).write.mode("overwrite").parquet(f"{path}/columns/{name}")
        (df.select("*", _jar_bucket()).repartition(store.BUCKET).write.mode("overwrite").partitionBy(store.BUCKET)
         .parquet(f"{path}/{name}/batch={batch}"))


def load_state(spark: SparkSession, path: str, before: int | None = None,
               buckets: list[int] | None = None) -> dict[str, DataFrame]:
    """The newest rows of each bucket (of ``buckets`` only) among the batches before ``before``.
    No row of a state ever leaves it, so a bucket's newest folder holds all of it."""
    state = {}
    for name in ("cookies", "reads"):
        schema = spark.read.parquet(f"{path}/columns/{name}").schema
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType()),
                                               T.StructField(store.BUCKET, T.IntegerType())])).parquet(f"{path}/{name}")
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        if buckets is not None:
            rows = rows.where(F.col(store.BUCKET).isin(buckets))
        newest: dict[int, list[int]] = {}
        for r in rows.groupBy(store.BUCKET).agg(F.max("batch").alias("batch")).collect():
            newest.setdefault(r["batch"], []).append(r[store.BUCKET])
        own = F.lit(False)
        for batch, inside in newest.items():
            own = own | ((F.col("batch") == batch) & F.col(store.BUCKET).isin(inside))
        state[name] = rows.where(own).drop("batch", store.BUCKET)
    return state


def sent_cookies(vers: DataFrame, reqs: DataFrame, rows: int = TL.ROWS) -> DataFrame:
    """(request, version) pairs of cookies sent with each request.

    An as-of join: each request is paired with the cookies of its jar whose domain and path fit, not
    with their versions; in the order of (jar, cookie) the last version before the request is carried to it,
    inside time buckets of about ``rows`` rows.  Candidates grow with requests times cookies.
    """
    scope = vers.select(*JAR, "cookie_id", F.col("domain").alias("_domain"), F.col("path").alias("_path")).distinct()
    r = reqs.select(*JAR, F.col("event_id").alias("req_id"), F.col("ts").alias("req_ts"), "host", "https", "req_path")
    fits = HS.domain_match(F.col("_domain"), F.lit(False), F.col("host")) & HS.path_match(F.col("_path"), F.col("req_path"))
    asks = (r.join(scope, JAR).where(fits).drop("_domain", "_path")
            .withColumns({"_ts": F.col("req_ts"), "_eid": F.col("req_id"), "_set": F.lit(False)}))
    kept = [c for c in vers.columns if c not in (*JAR, "cookie_id")]
    late = F.coalesce("valid_to", F.lit(HS.END_OF_TIME).cast("timestamp"))
    sets = vers.select(*JAR, "cookie_id", F.col("valid_from").alias("_ts"), F.col("from_eid").alias("_eid"), F.lit(True).alias("_set"),
                       late.alias("_to"), F.coalesce("to_eid", F.lit((1 << 63) - 1)).alias("_to_eid"),
                       F.struct(*kept).alias("_version"))
    bounds = TL.bucket_bounds(vers.select("valid_from").union(reqs.select("ts")), rows)
    every = asks.unionByName(sets, allowMissingColumns=True).withColumn(TL.BUCKET, TL.bucket_of(F.col("_ts"), bounds))
    every = stored(every, "asked") if bounds else every
    # A request goes before a set of the same time and event; of several sets there the last one counts.
    found = TL.carry(every, [*JAR, "cookie_id"], ["_ts", "_eid", "_set", "_to", "_to_eid"], F.col("_version"), "_v", bounds)
    s = found.where(~F.col("_set") & F.col("_v").isNotNull()).select(
        *JAR, "cookie_id", "req_id", "req_ts", "host", "https", "req_path", "_v.*")
    before_to = F.col("valid_to").isNull() | (F.col("req_ts") < F.col("valid_to")) | (
        (F.col("req_ts") == F.col("valid_to")) & (F.col("req_id") < F.col("to_eid")))
    live = ~F.col("persistent") | (F.col("expires") > F.col("req_ts"))
    send = HS.should_send(F.col("domain"), F.col("host_only"), F.col("path"), F.col("secure"),
                          F.col("https"), F.col("host"), F.col("req_path"))
    return s.where(before_to & live & send)


def cookies_for_requests(vers: DataFrame, reqs: DataFrame) -> DataFrame:
    """H13 + H14: per request the ``name=value`` list in send order (path
    length desc, creation asc, sequence asc), space separated."""
    s = sent_cookies(cut_lineage(vers), reqs)
    base = reqs.select(*JAR, F.col("event_id").alias("req_id"))
    ordered = (s.groupBy(*JAR, "req_id")
               .agg(F.array_sort(F.collect_list(F.struct(
                   (-F.length("path")).alias("k1"), F.col("creation").alias("k2"), F.col("seq_eid").alias("k3"),
                   F.col("seq_ord").alias("k4"), F.concat("name", F.lit("="), "value").alias("nv")))).alias("_c")))
    return (base.join(ordered, JAR + ["req_id"], "left")
            .select(*JAR, "req_id", F.coalesce(F.array_join(F.transform("_c", lambda x: x["nv"]), " "),
                                                F.lit("")).alias("cookies")))


def last_access(vers: DataFrame, reqs: DataFrame) -> DataFrame:
    """Per cookie that is still in the jar, the later of its last set and
    the last request it was sent with.  A cookie is gone if its last event
    deleted it or a later read of the jar found it expired."""
    vers = cut_lineage(vers)
    reads = reqs.groupBy(*JAR).agg(F.max("ts").alias("_read"))
    purged = F.col("persistent") & (F.col("_read") > F.col("valid_from")) & (F.col("_read") >= F.col("expires"))
    here = (vers.where("valid_to is null").join(reads, JAR, "left").where(~F.coalesce(purged, F.lit(False)))
            .select(*JAR, "cookie_id", F.col("valid_from").alias("last_set")))
    s = sent_cookies(vers, reqs)
    sent = s.groupBy(*JAR, "cookie_id").agg(F.max("req_ts").alias("last_sent"))
    return (here.join(sent, JAR + ["cookie_id"], "left")
            .select(*JAR, "cookie_id", F.greatest("last_set", F.coalesce("last_sent", "last_set")).alias("last_access")))


# ---- A7 / A8: exported browser cookie table --------------------------------
# fixed value: microseconds between 1601-01-01 and 1970-01-01
WINDOWS_EPOCH_OFFSET_US = 11644473600000000


def browser_epoch_to_unix(col) -> F.Column:
    """0 -> Unix 0; else (r - offset) / 1e6 truncating; NULL stays unset."""
    # decimal division then cast: truncation toward zero, exact for 64-bit values
    secs = F.when(col == 0, F.lit(0).cast("bigint")).otherwise(
        ((col.cast("decimal(20,0)") - F.lit(WINDOWS_EPOCH_OFFSET_US)) / F.lit(1000000)).cast("bigint"))
    return F.timestamp_seconds(secs)


def cookie_table_scan(table: DataFrame, hostname: str | None = None) -> DataFrame:
    """The nine columns, optionally ``host_key LIKE '%' || hostname``
    (case-insensitive, bare suffix, wildcards not escaped), ordered by
    LENGTH(path) DESC, creation_utc ASC."""
    t = table
    if hostname is not None:
        t = t.where(F.col("host_key").ilike("%" + hostname))
    return t.orderBy(F.length("path").desc(), F.col("creation_utc").asc())
