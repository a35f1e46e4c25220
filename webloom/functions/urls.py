"""URL Column builders.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions only, so the work stays inside whole-stage codegen.  The parsing
rules follow Go's ``net/url`` (the behaviour the rules were written against):
the scheme is lower-cased, the host is not; ``Hostname`` strips a numeric port
and IPv6 brackets; paths are compared in their escaped form.

``parse_url`` is deliberately not used: it throws on a space and
``try_parse_url`` returns NULL where Go keeps going.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# RFC 3986 appendix B, with the scheme restricted to Go's grammar.  The
# authority, query and fragment groups keep their delimiter so that "present
# but empty" differs from "absent".
URL_PATTERN = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"

# Characters Go accepts unescaped in an escaped path (validEncoded, encodePath).
_PATH_VALID = r"^[A-Za-z0-9\-._~$&+,/:;=@!'()*\[\]%]*$"


GROUPS = ("g_scheme", "g_auth", "g_path", "g_query", "g_frag", "g_ctl")
PARTS = ("scheme", "has_authority", "userinfo", "host", "path", "has_query", "query", "fragment", "valid")


def _g(col: Column, i: int) -> Column:
    return F.regexp_extract(col, URL_PATTERN, i)


def url_groups(url: Column) -> Column:
    """Stage 1 of B1: the raw regex groups (materialise this column once)."""
    return F.struct(
        _g(url, 1).alias("g_scheme"), _g(url, 2).alias("g_auth"), _g(url, 3).alias("g_path"),
        _g(url, 4).alias("g_query"), _g(url, 5).alias("g_frag"),
        url.rlike(r"[\x00-\x1f\x7f]").alias("g_ctl"))


def url_parts(g: Column) -> Column:
    """Stage 2 of B1 over a materialised ``url_groups`` column: struct(scheme,
    has_authority, userinfo, host, hostname, port, path, has_query, query,
    fragment, valid)."""
    auth_raw = g["g_auth"]
    has_auth = auth_raw != F.lit("")
    authority = F.substring(auth_raw, 3, 1 << 30)
    at = F.locate("@", F.reverse(authority))  # 1-based from the right, 0 = none
    userinfo = F.when(at > 0, authority.substr(F.lit(1), F.length(authority) - at)).otherwise(F.lit(None).cast("string"))
    host = F.when(at > 0, F.substring_index(authority, "@", -1)).otherwise(authority)
    host_noport = F.regexp_extract(host, r"^(.*?)(:[0-9]*)?$", 1)
    port = F.regexp_extract(host, r"^.*?:([0-9]*)$", 1)
    hostname = F.when(host_noport.startswith("[") & host_noport.endswith("]"),
                      host_noport.substr(F.lit(2), F.length(host_noport) - 2)).otherwise(host_noport)
    q_raw = g["g_query"]
    f_raw = g["g_frag"]
    # Go rejects control bytes anywhere, a bad port and bad escapes.
    bad_port = host.rlike(r"^[^\[\]]*:.*[^0-9].*$|^\[.*\]:.*[^0-9]")
    valid = ~g["g_ctl"] & ~bad_port & ~_bad_escape(g["g_path"]) & ~_bad_escape(F.substring(q_raw, 2, 1 << 30))
    return F.struct(
        F.lower(g["g_scheme"]).alias("scheme"),
        has_auth.alias("has_authority"),
        userinfo.alias("userinfo"),
        host.alias("host"),
        hostname.alias("hostname"),
        port.alias("port"),
        g["g_path"].alias("path"),
        (q_raw != F.lit("")).alias("has_query"),
        F.substring(q_raw, 2, 1 << 30).alias("query"),
        F.substring(f_raw, 2, 1 << 30).alias("fragment"),
        valid.alias("valid"),
    )


def with_url_parts(df: DataFrame, url_col: str, out: str) -> DataFrame:
    """B1 as a stage: adds struct column ``out`` (see ``url_parts``).  The
    two materialised steps keep the expression tree linear in size."""
    tmp = out + "__g"
    d = materialize(df, **{tmp: url_groups(F.col(url_col))})
    return materialize(d, **{out: url_parts(F.col(tmp))}).drop(tmp)


def split_url(url: Column) -> Column:
    """B1 as a single Column (for small inputs such as rule sample URLs)."""
    return url_parts(url_groups(url))


def _bad_escape(s: Column) -> Column:
    return s.rlike(r"%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)")


def path_escape(raw_path: Column) -> Column:
    """Go ``EscapedPath``: keep the raw form when it is a valid escaping,
    otherwise percent-encode (UTF-8, upper-case hex) what encodePath escapes.
    Existing ``%XX`` sequences are kept."""
    enc = F.url_encode(raw_path)
    for a, b in (("%2F", "/"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","),
                 ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"), ("%7E", "~"),
                 ("%25", "%"), ("+", "%20"), ("*", "%2A")):
        enc = F.replace(enc, F.lit(a), F.lit(b))
    return F.when(raw_path.rlike(_PATH_VALID), raw_path).otherwise(enc)


def query_escape(s: Column) -> Column:
    """Go ``url.QueryEscape``: space -> '+', keep ``-_.~``, escape ``*``.
    Java's URLEncoder differs only on ``*`` and ``~``."""
    return F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(raw_query: Column) -> Column:
    """Go ``ParseQuery``: split on '&'; skip empty parts, parts holding ';' and
    parts whose key or value has a bad escape.  ARRAY<STRUCT<k,v>> in order."""
    parts = F.filter(F.split(raw_query, "&"), lambda p: (p != F.lit("")) & ~p.contains(";"))
    pairs = F.transform(parts, lambda p: F.struct(
        F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
        F.try_url_decode(F.when(p.contains("="), p.substr(F.locate("=", p) + 1, F.lit(1 << 30)))
                         .otherwise(F.lit(""))).alias("v")))
    return F.filter(pairs, lambda s: s["k"].isNotNull() & s["v"].isNotNull())


# --------------------------------------------------------------------------
# Reference resolution (RFC 3986 section 5.2, Go ``URL.Parse``)
# --------------------------------------------------------------------------

def with_dots_removed(df: DataFrame, full_col: str, out: str) -> DataFrame:
    """Go ``resolvePath`` dot-segment removal over an escaped path, as an
    ``aggregate`` fold over the '/'-separated elements (staged so the fold
    is evaluated once per row)."""
    f = out + "__f"
    full = F.col(full_col)
    elems = F.split(full, "/")
    init = F.struct(F.lit("/").alias("acc"), F.lit(True).alias("first"))

    def step(s, e):
        tail = s["acc"].substr(F.lit(2), F.lit(1 << 30))
        rpos = F.locate("/", F.reverse(tail))
        idx = F.when(rpos == 0, F.lit(-1)).otherwise(F.length(tail) - rpos)
        dd = F.struct(F.concat(F.lit("/"), F.when(idx == -1, F.lit("")).otherwise(tail.substr(F.lit(1), idx))).alias("acc"),
                      (idx == -1).alias("first"))
        keep = F.struct(F.concat(s["acc"], F.when(s["first"], F.lit("")).otherwise(F.lit("/")), e).alias("acc"),
                        F.lit(False).alias("first"))
        drop = F.struct(s["acc"].alias("acc"), F.lit(False).alias("first"))
        return F.when(e == ".", drop).when(e == "..", dd).otherwise(keep)

    d = materialize(df, **{f: F.concat(F.aggregate(elems, init, step)["acc"],
                                       F.when(F.element_at(elems, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")))})
    r = F.col(f)
    r = F.when((F.length(r) > 1) & (r.substr(2, 1) == "/"), r.substr(F.lit(2), F.lit(1 << 30))).otherwise(r)
    return d.withColumn(out, F.when(full == "", F.lit("")).otherwise(r)).drop(f)


def url_string(scheme: Column, has_auth: Column, userinfo: Column, host: Column, path: Column,
               query: Column, force_query: Column, fragment: Column) -> Column:
    """Go ``URL.String`` for the non-opaque case."""
    auth = F.when(has_auth | (host != "") | userinfo.isNotNull(),
                  F.concat(F.lit("//"), F.when(userinfo.isNotNull(), F.concat(userinfo, F.lit("@"))).otherwise(F.lit("")), host)
                  ).otherwise(F.lit(""))
    p = F.when((path != "") & ~path.startswith("/") & (host != ""), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        auth, p,
        F.when(force_query | (query != ""), F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def with_resolved(df: DataFrame, base_col: str, ref_col: str, out: str) -> DataFrame:
    """B11 as a stage: ``out`` = ``base.Parse(ref).String()``; an unparsable
    ``ref`` is kept unchanged (the reference keeps the raw value when
    parsing fails).  Every stage ends in a generator (:func:`materialize`), so that
    later uses of ``out``, as a join key say, see a column and not the whole tree."""
    b, r, x = out + "__b", out + "__r", out + "__x"
    d = df
    groups, parts = {}, {}
    for p, col in ((b, base_col), (r, ref_col)):
        g = url_groups(F.col(col))
        groups |= {p + f: g[f] for f in GROUPS}
        own = url_parts({f: F.col(p + f) for f in GROUPS})
        parts |= {p + f: own[f] for f in PARTS}
    # Plain columns, no structs: each stage reads only what it needs of the one before.
    d = materialize(d, **groups)
    d = materialize(d, **parts).drop(*groups)
    B, R = {f: F.col(b + f) for f in PARTS}, {f: F.col(r + f) for f in PARTS}
    d = materialize(d, **{x + "rp": path_escape(R["path"]), x + "bp": path_escape(B["path"])})
    r_path, b_path = F.col(x + "rp"), F.col(x + "bp")
    ref = F.col(ref_col)
    # Go: without a scheme, a colon in the first path segment is an error.
    colon_err = (R["scheme"] == "") & ~R["has_authority"] & F.substring_index(R["path"], "/", 1).contains(":")
    ok = R["valid"] & B["valid"] & ~colon_err & ref.isNotNull()
    r_force = R["has_query"] & (R["query"] == "")
    absolute = R["scheme"] != ""
    net = R["has_authority"] | R["userinfo"].isNotNull()
    inherit_q = (R["path"] == "") & ~R["has_query"]
    rel_query = F.when(inherit_q, B["query"]).otherwise(R["query"])
    rel_force = F.when(inherit_q, B["has_query"] & (B["query"] == "")).otherwise(r_force)
    rel_frag = F.when(inherit_q & (R["fragment"] == ""), B["fragment"]).otherwise(R["fragment"])
    slash = F.locate("/", F.reverse(b_path))
    b_dir = F.when(slash > 0, b_path.substr(F.lit(1), F.length(b_path) - slash + 1)).otherwise(F.lit(""))
    full = F.when(absolute | net, r_path).when(r_path == "", b_path).when(
        ~r_path.startswith("/"), F.concat(b_dir, r_path)).otherwise(r_path)
    d = materialize(d, **{x + "full": full}).drop(x + "rp", x + "bp")
    d = with_dots_removed(d, x + "full", x + "path").drop(x + "full")
    away = absolute | net

    def side(own: Column, other: Column) -> Column:
        return F.when(away, own).otherwise(other)

    resolved = url_string(F.when(absolute, R["scheme"]).otherwise(B["scheme"]), side(R["has_authority"], B["has_authority"]),
                          side(R["userinfo"], B["userinfo"]), side(R["host"], B["host"]), F.col(x + "path"),
                          side(R["query"], rel_query), side(r_force, rel_force), side(R["fragment"], rel_frag))
    # "scheme:opaque" (no '//' and no leading '/') is kept opaque by Go
    opaque = (R["scheme"] != "") & ~R["has_authority"] & (R["path"] != "") & ~R["path"].startswith("/")
    resolved_opaque = F.concat(R["scheme"], F.lit(":"), R["path"],
                               F.when(R["has_query"], F.concat(F.lit("?"), R["query"])).otherwise(F.lit("")),
                               F.when(R["fragment"] != "", F.concat(F.lit("#"), R["fragment"])).otherwise(F.lit("")))
    res = F.when(~ok, ref).when(opaque, resolved_opaque).otherwise(resolved)
    return materialize(d, **{out: res}).drop(*parts, x + "path")


def with_url_string(df: DataFrame, url_col: str, out: str) -> DataFrame:
    """Round trip ``url.Parse(u).String()`` (path re-escaped); invalid -> as is."""
    p = out + "__p"
    d = with_url_parts(df, url_col, p)
    u = F.col(p)
    return materialize(d, **{out: F.when(u["valid"], url_string(
        u["scheme"], u["has_authority"], u["userinfo"], u["host"], path_escape(u["path"]), u["query"],
        u["has_query"] & (u["query"] == ""), u["fragment"])).otherwise(F.col(url_col))}).drop(p)


def materialize(df: DataFrame, **cols: Column) -> DataFrame:
    """Add ``cols`` through a one-row ``inline`` generator: filters on them
    are not pushed below (which would copy the expressions into the filter
    and evaluate them twice per row)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
