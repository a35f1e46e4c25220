"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

from webloom.llm.urlglob import FILTER, RULES

# A one-row table ``crc`` with the 256 values of the checksum's table, and crc32 of a text with it.
CRC_TABLE = """crc_steps as (
  select i, 0 as k, i as c from range(256) r(i)
  union all select i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) from crc_steps where k < 8),
crc as (select list(c order by i) as tab from crc_steps where k = 8)"""


def crc32(text: str) -> str:
    code = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(1, length({code}) + 1, 2), lambda j: ('0x' || substr({code}, j, 2))::bigint)"
    return (f"xor(list_reduce(list_prepend(4294967295, {bytes_}), "
            "lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295)")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
_PAIRS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

RESAMPLING = f"""
with recursive {CRC_TABLE},
d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
b as (select {_WORDS} as w from benchmark),
df as (select rid, unnest({_PAIRS}) as f from d),
bf as (select unnest({_PAIRS}) as f from b),
code as (select f, {crc32("f")} % 10000 as bucket from (select f from df union select f from bf), crc),
s as (select bucket, count(*) as n from df join code using (f) group by 1),
t as (select bucket, count(*) as n from bf join code using (f) group by 1),
big as (select (select count(*) from df) as s, (select count(*) from bf) as t),
gain as (select x.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (big.s + 10000)
                / ((coalesce(s.n, 0) + 1) * (big.t + 10000))::double))::bigint as g
         from (select distinct bucket from code) x left join s using (bucket) left join t using (bucket), big),
total as (select rid, count(*) as n, sum(g) as g from df join code using (f) join gain using (bucket) group by 1),
scored as (
  select d.rid, d.doc_id, len(w) as words, coalesce(n, 0)::bigint as n_features,
         coalesce(floor(g / n::double), 0)::bigint as weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296.0::double)))::bigint as noise
  from d left join total using (rid)),
placed as (
  select *, row_number() over (partition by words >= 20 and doc_id is not null
                               order by weight + noise desc, doc_id, n_features, weight) as place,
         (select count(*) from scored where words >= 20 and doc_id is not null) as n_fit
  from scored)
select doc_id, n_features, weight, weight + noise as score,
       case when words >= 20 and doc_id is not null and place <= 25 * n_fit // 100 then place end as rank
from placed"""


def _regex(glob: str) -> str:
    out, j = "", 0
    while j < len(glob):
        if glob[j: j + 2] == "**":
            out, j = out + ".*", j + 2
            continue
        out += {"*": "[^/]*", "?": "."}.get(glob[j], "\\" + glob[j] if not glob[j].isalnum() else glob[j])
        j += 1
    return f"(?s){out}"


def _rule_case() -> str:
    arms = []
    for rule, verdict in sorted(RULES, key=lambda r: -len(r[0])):
        host, _, path = rule.partition("/")
        arms.append(f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}') "
                    f"then {{'rule': '{rule}', 'verdict': '{verdict}', 'glob': case when host = '{host}' "
                    f"then '{rule}**' else '*.{rule}**' end}}")
    arms += [f"when regexp_full_match(host || path, '{_regex(g)}') "
             f"then {{'rule': null, 'verdict': 'block', 'glob': '{g}'}}" for g in FILTER]
    return "case " + "\n".join(arms) + " else {'rule': null, 'verdict': 'allow', 'glob': null} end"


URLS = f"""
with a as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as after from pages),
p as (
  select page_id, translate(regexp_extract(after, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
         regexp_extract(after, '^[^/?#]*([^?#]*)', 1) as path from a),
j as (select *, {_rule_case()} as j from p)
select page_id, host, path, j.rule as rule, j.verdict as verdict, j.glob as glob from j"""

TRIE = f"""
with recursive {CRC_TABLE},
own as (
  select conv_id, list({{'d': md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')),
                        'n': length(coalesce(text, ''))}}
                       order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as t
  from conversations where conv_id is not null group by conv_id),
rebuilt as (
  select o.conv_id, list_concat(coalesce(h.t, [])[1:share], o.t[share + 1:]) as t
  from (select *, {crc32("conv_id::varchar")} % 6 as share from own, crc) o
  left join own h on h.conv_id = o.conv_id - o.conv_id % 100),
prefix as (
  select conv_id, d, len(t) as size, array_to_string(list_transform(t[1:d], lambda x: x.d), '') as p,
         case when d > 0 then t[d].n else 0 end as n
  from (select conv_id, t, unnest(range(len(t) + 1)) as d from rebuilt)),
node as (
  select p, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(n) as n,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = d), '')) as ends_sha256
  from prefix group by p),
kids as (select substr(p, 1, length(p) - 32) as p, count(*) as k from node where depth > 0 group by 1),
own_part as (
  select node.*, coalesce(k, 0) as k, (coalesce(k, 0) = 0)::bigint as leaf, (n_convs - 1) * n as saved
  from node left join kids using (p)),
above as (select substr(p, 1, 32 * a) as p, leaf, saved from (select *, unnest(range(depth + 1)) as a from own_part)),
sums as (select p, sum(leaf) as n_leaves, sum(saved) as saved_tokens from above group by p)
select o.conv_id, o.depth::bigint as depth, u.conv_id as parent_conv_id, o.n_convs, o.k::bigint as n_children,
       n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, o.ends_sha256
from own_part o join sums using (p)
left join node u on o.depth > 0 and u.p = substr(o.p, 1, length(o.p) - 32)"""
