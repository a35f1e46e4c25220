"""Cookie host/domain/path Column builders, after
RFC 6265 as the reference's jar implements it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----------------------------------------------------------
NON_ASCII = r"[^\x00-\x7F]"
PUNYCODE_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
END_OF_TIME = "9999-12-31 23:59:59"  # expiry of session cookies (UTC)
_V4 = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_V4}\.{_V4}\.{_V4}\.{_V4}$"
# ---------------------------------------------------------------------------


def _ipv6() -> str:
    """Eight groups of 1-4 hex digits, the last two maybe dotted IPv4; one
    ``::`` stands for at least one group."""
    g = "[0-9A-Fa-f]{1,4}"
    v4 = IPV4[1:-1]
    forms = [f"(?:{g}:){{7}}{g}", f"(?:{g}:){{6}}{v4}"]
    for k in range(8):
        head = f"{g}(?::{g}){{{k - 1}}}" if k else ""
        forms.append(f"{head}::" + (f"(?:{g}(?::{g}){{0,{6 - k}}})?" if k < 7 else ""))
        if k < 6:
            forms.append(f"{head}::(?:{g}:){{0,{5 - k}}}{v4}")
    return "^(?:" + "|".join(forms) + ")$"


IPV6 = _ipv6()


def _last_index(s: Column, ch: str) -> Column:
    """0-based index of the last ``ch`` in ``s``; -1 when absent."""
    r = F.locate(ch, F.reverse(s))
    return F.when(r == 0, F.lit(-1)).otherwise(F.length(s) - r)


def has_port(host: Column) -> Column:
    """H1 helper: one colon, or ``[...]:`` for IPv6."""
    colons = F.length(host) - F.length(F.regexp_replace(host, ":", ""))
    return F.when(colons == 0, F.lit(False)).when(colons == 1, F.lit(True)).otherwise(
        host.startswith("[") & host.contains("]:"))


def is_ip(host: Column) -> Column:
    """H2: IPv4 (no leading zeros) or IPv6 literal."""
    return host.rlike(IPV4) | host.rlike(IPV6)


def canonical_host(host: Column) -> Column:
    """H1: lower-case, strip the port, strip one trailing dot, labels with other than ASCII
    characters in their ASCII form.  NULL when the host:port form is malformed."""
    h = F.lower(host)
    bracket = h.startswith("[")
    hp = F.when(bracket, F.regexp_extract(h, r"^\[([^\]]*)\]:[^:\]\[]*$", 1)).otherwise(
        F.regexp_extract(h, r"^([^:]*):[^:]*$", 1))
    bad = has_port(h) & (hp == "") & ~h.rlike(r"^:[^:]*$")
    stripped = F.when(has_port(h), hp).otherwise(h)
    out = F.when(stripped.endswith("."), stripped.substr(F.lit(1), F.length(stripped) - 1)).otherwise(stripped)
    return F.when(bad, F.lit(None).cast("string")).when(out.rlike(NON_ASCII), ascii_host(out)).otherwise(out)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once (a lambda variable)."""
    return F.get(F.transform(F.array(value), body), 0)


def ascii_host(host: Column) -> Column:
    """Each label with other than ASCII characters as ``xn--`` and its Punycode (RFC 3492)."""
    return F.array_join(F.transform(F.split(host, "[.]"), lambda label: F.when(
        label.rlike(NON_ASCII), F.concat(F.lit("xn--"), punycode(label))).otherwise(label)), ".")


def punycode(label: Column) -> Column:
    """RFC 3492: the ASCII characters, then for each other character, by code point and place, how many
    states the decoder skips to it, as a number of variable length."""
    points = F.transform(F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c))
    return _bound(points, _encode)


def _encode(points: Column) -> Column:
    plain = F.filter(points, lambda c: c < 128)
    other = F.array_sort(F.filter(F.transform(points, lambda c, i: F.struct(c.alias("point"), i.alias("at"))),
                                  lambda e: e["point"] >= 128))
    start = F.struct(F.concat(F.array_join(F.transform(plain, lambda c: F.char(c)), ""),
                              F.when(F.size(plain) > 0, "-").otherwise("")).alias("out"),
                     F.size(plain).alias("done"), F.lit(127).alias("point"), F.size(points).alias("at"),
                     F.lit(72).cast("long").alias("bias"))

    def before(e):  # smaller characters ahead of this one
        return F.size(F.filter(points, lambda c, j: (j < e["at"]) & (c < e["point"])))

    def step(s, e):
        first = s["point"] == 127
        same = F.size(F.filter(points, lambda c, j: (j > s["at"]) & (j < e["at"]) & (c < e["point"])))
        rest = F.size(F.filter(points, lambda c, j: (j > s["at"]) & (c < s["point"])))
        skipped = (e["point"] - s["point"] - 1) * (s["done"] + 1) + before(e)
        delta = F.when(e["point"] == s["point"], same).when(first, skipped).otherwise(rest + 1 + skipped).cast("long")
        return _bound(delta, lambda d: F.struct(
            F.concat(s["out"], _digits(d, s["bias"])).alias("out"), (s["done"] + 1).alias("done"),
            e["point"].alias("point"), e["at"].alias("at"), _adapted(d, s["done"] + 1, first).alias("bias")))

    return F.aggregate(other, start, step, lambda s: s["out"])


def _div(a: Column, b) -> Column:
    return F.floor(a / b).cast("long")


def _digits(number: Column, bias: Column) -> Column:
    def digit(d):
        return F.substring(F.lit(PUNYCODE_DIGITS), (d + 1).cast("int"), F.lit(1))

    def step(v, k):
        t = F.least(F.lit(26).cast("long"), F.greatest(F.lit(1).cast("long"), k - bias))
        last = F.struct(v["left"].alias("left"), F.concat(v["out"], digit(v["left"])).alias("out"), F.lit(False).alias("more"))
        next_ = F.struct(_div(v["left"] - t, 36 - t).alias("left"),
                         F.concat(v["out"], digit(t + (v["left"] - t) % (36 - t))).alias("out"), F.lit(True).alias("more"))
        return F.when(~v["more"], v).when(v["left"] < t, last).otherwise(next_)

    start = F.struct(number.alias("left"), F.lit("").alias("out"), F.lit(True).alias("more"))
    return F.aggregate(F.sequence(F.lit(36), F.lit(36 * 14), F.lit(36)), start, step, lambda v: v["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    d = F.when(first, _div(delta, 700)).otherwise(_div(delta, 2))
    start = F.struct((d + _div(d, points)).alias("d"), F.lit(0).cast("long").alias("k"))
    step = F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, lambda a, _: F.when(
        a["d"] > 455, F.struct(_div(a["d"], 35).alias("d"), (a["k"] + 36).alias("k"))).otherwise(a),
        lambda a: a["k"] + _div(36 * a["d"], a["d"] + 38))
    return step


def jar_key(host: Column) -> Column:
    """H3 without a public-suffix list: IP -> itself; else the last two labels
    (the host when it has no inner dot)."""
    i = _last_index(host, ".")
    head = host.substr(F.lit(1), i - 1)  # host[:i-1]
    prev = _last_index(head, ".")
    key = host.substr(prev + 2, F.lit(1 << 30))
    return F.when(is_ip(host) | (i <= 0), host).otherwise(key)


def jar_key_with_suffix(host: Column, suffix: Column) -> Column:
    """H3 with a public suffix (already looked up for ``host``): suffix equal
    to host or not at a label boundary -> host; else one label + suffix."""
    i = F.length(host) - F.length(suffix)
    boundary = host.substr(i, F.lit(1)) == "."
    head = host.substr(F.lit(1), i - 1)
    prev = _last_index(head, ".")
    key = host.substr(prev + 2, F.lit(1 << 30))
    return F.when(is_ip(host) | (suffix == host) | (i <= 0) | ~boundary, host).otherwise(key)


def default_path(path: Column) -> Column:
    """H4: the directory of the URL path; '/' when empty, relative or top level."""
    i = _last_index(path, "/")
    return F.when((path == "") | ~path.startswith("/") | (i == 0), F.lit("/")).otherwise(path.substr(F.lit(1), i))


def has_dot_suffix(s: Column, suffix: Column) -> Column:
    """``s`` ends in '.' + suffix (and is longer)."""
    return (F.length(s) > F.length(suffix)) & s.endswith(F.concat(F.lit("."), suffix))


def domain_and_type(host: Column, domain: Column, public_suffix: Column | None = None) -> Column:
    """H5: struct(domain, host_only, error) for a Domain attribute."""
    d1 = F.when(domain.startswith("."), domain.substr(F.lit(2), F.lit(1 << 30))).otherwise(domain)
    d = F.lower(d1)
    ok = F.struct(d.alias("domain"), F.lit(False).alias("host_only"), F.lit(None).cast("string").alias("error"))

    def err(msg):
        return F.struct(F.lit(None).cast("string").alias("domain"), F.lit(False).alias("host_only"),
                        F.lit(msg).alias("error"))

    host_only = F.struct(host.alias("domain"), F.lit(True).alias("host_only"),
                         F.lit(None).cast("string").alias("error"))
    r = (F.when(domain.isNull() | (domain == ""), host_only)
         .when(is_ip(host), err("no host name"))
         .when((d1 == "") | d1.startswith("."), err("malformed domain"))
         .when(d.endswith("."), err("malformed domain")))
    if public_suffix is not None:
        ps = public_suffix
        r = r.when((ps.isNotNull() & (ps != "") & ~has_dot_suffix(d, ps)) & (host == d), host_only).when(
            ps.isNotNull() & (ps != "") & ~has_dot_suffix(d, ps), err("illegal domain"))
    return r.when((host != d) & ~has_dot_suffix(host, d), err("illegal domain")).otherwise(ok)


def cookie_id(domain: Column, path: Column, name: Column) -> Column:
    """H7: ``domain;path;name``."""
    return F.concat_ws(";", domain, path, name)


def domain_match(c_domain: Column, host_only: Column, host: Column) -> Column:
    """H10."""
    return (c_domain == host) | (~host_only & has_dot_suffix(host, c_domain))


def path_match(c_path: Column, req_path: Column) -> Column:
    """H11."""
    nxt = req_path.substr(F.length(c_path) + 1, F.lit(1))
    return (req_path == c_path) | (req_path.startswith(c_path) & (c_path.endswith("/") | (nxt == "/")))


def should_send(c_domain, host_only, c_path, secure, https: Column, host: Column, path: Column) -> Column:
    """H12."""
    return domain_match(c_domain, host_only, host) & path_match(c_path, path) & (https | ~secure)
