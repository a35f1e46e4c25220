"""URL classification and normalisation.

Each URL class compiles to one ``struct(matched, normalized_url, reason)``
Column; ``classify`` orders the classes by (priority desc, ordinal asc) on the
driver and picks the first match with ``coalesce`` - the same answer as the
reference's "highest priority, first in list order on ties" scan, evaluated in
one projection over the URL column (no join, no shuffle).  The URL is split
once into a struct column so the regex work is shared by all classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.sources.rules import Matcher, URLClass, matcher_pattern


def _null_str() -> Column:
    return F.lit(None).cast("string")


def match_string(m: Matcher, value: Column) -> Column:
    """B2 ``MatchStringMatcher``: empty input -> false first; empty pattern
    -> true; EXACT equality; REGEX unanchored search; bad regex -> false."""
    nonempty = value.isNotNull() & (value != F.lit(""))
    if m.value == "":
        return nonempty
    if m.type == "EXACT":
        return nonempty & (value == F.lit(m.value))
    if m.type == "REGEX":
        pat = matcher_pattern(m)
        if pat is None:
            return F.lit(False)
        return nonempty & value.rlike(pat)
    return F.lit(False)


def _key_is(key):
    return lambda p: p["k"] == F.lit(key)


def _matches(m):
    return lambda v: match_string(m, v)


def _pair_text(kq):
    return lambda v: F.concat(kq, F.lit("="), U.query_escape(v))


def apply_class(uc: URLClass, u: Column, segs: Column | None = None, pairs: Column | None = None,
                only_match: bool = False) -> dict:
    """B3-B7 ``ApplyClassifier`` on a split URL struct ``u`` (see
    ``urls.url_parts``); ``segs``/``pairs`` are the escaped path segments and
    parsed query (pass materialised columns, see ``with_url_fields``).
    Returns Columns {matched, normalized_url, reason}, with ``only_match`` the first alone."""
    if segs is None:
        segs = _segments(u)
    if pairs is None:
        pairs = U.query_pairs(u["query"])
    # B3 scheme upgrade
    scheme = u["scheme"] if uc.allow_http else F.lit("https")
    # B4 domain predicate + host rewrite
    same = u["hostname"] == F.lit(uc.domain)
    sub = u["hostname"].endswith("." + uc.domain) if uc.match_subdomain else F.lit(False)
    if uc.allow_subdomain:
        host = u["host"]
    else:
        host = F.when(same, u["host"]).otherwise(F.lit(uc.domain))
    domain_reason = (F.when(same, _null_str())
                     .when(F.lit(not uc.match_subdomain), F.lit("domain mismatch"))
                     .when(~sub, F.lit("subdomain mismatch")).otherwise(_null_str()))
    # B5 path predicate + rewrite
    path_ok = F.lit(True)
    path_reason = _null_str()
    out_segs = []
    checks = []
    for i, m in enumerate(uc.path):
        seg = F.get(segs, i)  # NULL past the end
        if m.default:
            ok = F.when(seg.isNull(), F.lit(True)).otherwise(match_string(m, seg))
            why = F.when(seg.isNull(), _null_str()).otherwise(F.lit("path segment mismatch"))
        else:
            ok = F.when(seg.isNull(), F.lit(False)).otherwise(match_string(m, seg))
            why = F.when(seg.isNull(), F.lit("path length mismatch")).otherwise(F.lit("path segment mismatch"))
        checks.append((ok, why))
        out_segs.append(F.coalesce(seg, F.lit(m.default)))
    for ok, why in reversed(checks):
        path_reason = F.when(~ok, why).otherwise(path_reason)
        path_ok = path_ok & ok
    new_path = F.concat(F.lit("/"), F.concat_ws("/", *out_segs)) if out_segs else F.lit("/")
    # B6 query predicate + rewrite (keys in sorted order, as Values.Encode)
    q_ok = F.lit(True)
    q_reason = _null_str()
    encoded_parts = []
    q_checks = []
    for key, m in uc.query:
        vals = F.transform(F.filter(pairs, _key_is(key)), lambda p: p["v"])
        present = F.size(vals) > 0
        all_match = F.forall(vals, _matches(m))
        if m.default:
            ok = F.when(present, all_match).otherwise(F.lit(True))
            vals = F.when(present, vals).otherwise(F.array(F.lit(m.default)))
            why = F.lit("query param mismatch")
        else:
            ok = present & all_match
            why = F.when(present, F.lit("query param mismatch")).otherwise(F.lit("no default for param"))
        q_checks.append((ok, why))
        if only_match:
            continue
        kq = U.query_escape(F.lit(key))
        encoded_parts.append(F.array_join(F.transform(vals, _pair_text(kq)), "&"))
    for ok, why in reversed(q_checks):
        q_reason = F.when(~ok, why).otherwise(q_reason)
        q_ok = q_ok & ok
    matched = u["valid"] & (same | sub) & path_ok & q_ok
    if only_match:
        return {"matched": matched}
    encoded = F.concat_ws("&", *encoded_parts) if encoded_parts else F.lit("")
    force = u["has_query"] & (u["query"] == "")
    normalized = U.url_string(scheme, u["has_authority"], u["userinfo"], host, new_path, encoded, force, u["fragment"])
    reason = F.coalesce(domain_reason, path_reason, q_reason)
    reason = F.when(~u["valid"], F.lit("unparsable url")).otherwise(reason)
    return {"matched": matched, "normalized_url": normalized, "reason": reason}


def _segments(u: Column) -> Column:
    esc = U.path_escape(u["path"])
    return F.split(F.when(esc.startswith("/"), esc.substr(F.lit(2), F.lit(1 << 30))).otherwise(esc), "/")


def with_url_fields(df: DataFrame, url_col: str, prefix: str = "__") -> DataFrame:
    """Materialise the split URL, escaped path segments and query pairs once
    (columns ``{prefix}u``, ``{prefix}segs``, ``{prefix}pairs``)."""
    d = U.with_url_parts(df, url_col, prefix + "u")
    u = F.col(prefix + "u")
    return U.materialize(d, **{prefix + "segs": _segments(u), prefix + "pairs": U.query_pairs(u["query"])})


def priority_order(classes: list[URLClass]) -> list[URLClass]:
    return sorted(classes, key=lambda c: (-c.priority, c.ordinal))


LITERAL_CLASSES = 48


def classify(df: DataFrame, classes: list[URLClass], url_col: str = "url") -> DataFrame:
    """Add ``uclass``, ``class_type``, ``priority``, ``normalized_url``
    (all NULL when no class matches - B9).  A few classes are compiled into the
    projection; more of them are looked up by host (:func:`classify_by_host`)."""
    if not classes:
        return (df.withColumn("uclass", _null_str()).withColumn("class_type", _null_str())
                .withColumn("priority", F.lit(None).cast("bigint")).withColumn("normalized_url", _null_str()))
    if len(classes) > LITERAL_CLASSES:
        return classify_by_host(df, classes, url_col)
    d = with_url_fields(df, url_col, "__")
    u, segs, pairs = F.col("__u"), F.col("__segs"), F.col("__pairs")
    picks = []
    for c in priority_order(classes):
        r = apply_class(c, u, segs, pairs)
        picks.append(F.when(r["matched"], F.struct(
            F.lit(c.name).alias("uclass"), F.lit(c.cls).alias("class_type"),
            F.lit(c.priority).cast("bigint").alias("priority"), r["normalized_url"].alias("normalized_url"))))
    # The generator keeps filters on the class columns from copying the classifier into them.
    return d.select(*[F.col(c) for c in df.columns], F.inline(F.array(F.coalesce(*picks, _no_class()))))


def _no_class() -> Column:
    return F.struct(_null_str().alias("uclass"), _null_str().alias("class_type"),
                    F.lit(None).cast("bigint").alias("priority"), _null_str().alias("normalized_url"))


_RULE = ("domain string, priority bigint, ordinal int, uclass string, class_type string, allow_http boolean, "
         "match_subdomain boolean, allow_subdomain boolean, "
         "path array<struct<value: string, type: string, default: string, pattern: string>>, "
         "query array<struct<key: string, value: string, type: string, default: string, pattern: string>>")


def _rule_rows(classes: list[URLClass]) -> list[tuple]:
    def parts(m: Matcher) -> tuple:
        return m.value, m.type, m.default or "", matcher_pattern(m) if m.type == "REGEX" and m.value else None

    return [(c.domain, c.priority, c.ordinal, c.name, c.cls, c.allow_http, c.match_subdomain, c.allow_subdomain,
             [parts(m) for m in c.path], [(k, *parts(m)) for k, m in c.query]) for c in classes]


def _match_row(m: Column, value: Column) -> Column:
    """B2 with the matcher as data; see :func:`match_string`."""
    hit = (F.when(m["value"] == "", F.lit(True)).when(m["type"] == "EXACT", value == m["value"])
           .when(m["pattern"].isNotNull(), F.rlike(value, m["pattern"])).otherwise(F.lit(False)))
    return F.coalesce(value != "", F.lit(False)) & hit


def _accepts(c: Column, u: Column, segs: Column, pairs: Column) -> Column:
    """B5, B6 with the class as data."""
    def path_ok(m, i):
        seg = F.get(segs, i)
        return F.when(seg.isNull(), m["default"] != "").otherwise(_match_row(m, seg))

    def query_ok(m):
        own = F.filter(pairs, lambda p: p["k"] == m["key"])
        return F.when(F.size(own) == 0, m["default"] != "").otherwise(F.forall(own, lambda p: _match_row(m, p["v"])))

    return (F.forall(F.transform(c["path"], path_ok), lambda ok: ok) & F.forall(c["query"], query_ok))


def _rewritten(c: Column, u: Column, segs: Column, pairs: Column) -> Column:
    """The normalised URL with the class as data."""
    scheme = F.when(c["allow_http"], u["scheme"]).otherwise("https")
    host = F.when(c["allow_subdomain"] | (u["hostname"] == c["domain"]), u["host"]).otherwise(c["domain"])
    path = F.concat(F.lit("/"), F.array_join(F.transform(c["path"], lambda m, i: F.coalesce(F.get(segs, i), m["default"])), "/"))

    def encoded(m):
        own = F.transform(F.filter(pairs, lambda p: p["k"] == m["key"]), lambda p: p["v"])
        vals = F.when(F.size(own) == 0, F.array(m["default"])).otherwise(own)
        return F.array_join(F.transform(vals, lambda v: F.concat(U.query_escape(m["key"]), F.lit("="), U.query_escape(v))), "&")

    query = F.array_join(F.transform(c["query"], encoded), "&")
    return U.url_string(scheme, u["has_authority"], u["userinfo"], host, path, query,
                        u["has_query"] & (u["query"] == ""), u["fragment"])


def classify_by_host(df: DataFrame, classes: list[URLClass], url_col: str = "url") -> DataFrame:
    """B8 for large rule sets: the rules are a table keyed by domain.  Each distinct host is joined with
    the rules on its label suffixes (an equi-join), which gives it its candidates in order of
    precedence; a URL takes the first of its host's candidates whose path and query rules hold."""
    spark = df.sparkSession
    rules = spark.createDataFrame(_rule_rows(classes), _RULE)
    d = with_url_fields(df, url_col, "__")
    d = U.materialize(d, __host=F.when(F.col("__u")["valid"], F.col("__u")["hostname"]))
    labels = F.split("host", "[.]")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = d.select(F.col("__host").alias("host")).where("host is not null").distinct()
    found = (hosts.select("host", F.explode(F.array_distinct(tails)).alias("domain")).join(rules, "domain")
             .where("host = domain or match_subdomain"))
    ranked = F.struct((-F.col("priority")).alias("rank"), "ordinal", F.struct(*rules.columns).alias("rule"))
    cands = found.groupBy("host").agg(F.array_sort(F.collect_list(ranked)).alias("__cands"))
    d = d.join(cands.withColumnRenamed("host", "__host"), "__host", "left")
    u, segs, pairs = F.col("__u"), F.col("__segs"), F.col("__pairs")
    d = U.materialize(d, __rule=F.get(F.filter("__cands", lambda x: _accepts(x["rule"], u, segs, pairs)), 0)["rule"])
    rule = F.col("__rule")
    picked = F.struct(rule["uclass"].alias("uclass"), rule["class_type"].alias("class_type"), rule["priority"].alias("priority"),
                      F.when(rule.isNotNull(), _rewritten(rule, u, segs, pairs)).alias("normalized_url"))
    return d.select(*[F.col(c) for c in df.columns], F.inline(F.array(picked)))


def class_matches(df: DataFrame, uc: URLClass, url_col: str = "url") -> DataFrame:
    """B7 for one class: add ``matched``, ``normalized_url``, ``reason``."""
    d = with_url_fields(df, url_col, "__")
    r = apply_class(uc, F.col("__u"), F.col("__segs"), F.col("__pairs"))
    d = d.withColumn("matched", r["matched"])
    return (d.withColumn("normalized_url", F.when(F.col("matched"), r["normalized_url"]))
            .withColumn("reason", F.when(~F.col("matched"), r["reason"]))
            .drop("__u", "__segs", "__pairs"))


def unclassified(classified: DataFrame) -> DataFrame:
    """Rows no class accepts."""
    return classified.where(F.col("uclass").isNull())


def ignored(classified: DataFrame) -> DataFrame:
    """B10 (the rows the IGNORE class stops)."""
    return classified.where(F.col("class_type") == "IGNORE")


def processable(classified: DataFrame) -> DataFrame:
    """Rows that go on to extraction: classified and not IGNORE."""
    return classified.where(F.col("uclass").isNotNull() & (F.col("class_type") != "IGNORE"))
