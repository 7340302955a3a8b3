"""SQL for DuckDB of the operators whose rows it can express."""

from __future__ import annotations

from .secret_scan import ALLOWED, CANDIDATE, CLASSES, KINDS, MIXED, WINDOW


def _classes(count: str) -> str:
    """Near-duplicate classes by brute force: all pairs that share a shingle, Jaccard by the counts, reachability."""
    return rf"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t\n\x0b\x0c\r\x1c-\x20]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, array_to_string(w[i:i + 4], ' ') as g, {count} as c from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from w where len(w) > 0) group by all),
t as (select doc_id, sum(c) as n from s group by doc_id),
m as (select a.doc_id as lo, b.doc_id as hi, sum(least(a.c, b.c)) as m from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select lo, hi from m join t x on x.doc_id = lo join t y on y.doc_id = hi where m >= 0.8 * (x.n + y.n - m)),
u as (select lo as a, hi as b from e union all select hi, lo from e),
r(a, b) as (select doc_id, doc_id from documents union select r.a, u.b from r join u on u.a = r.b)
select a as doc_id, min(b) as class_id from r group by a
"""


OP2_SQL, MINHASH_SQL = _classes("count(*)"), _classes("1")


#: Every window of 50 bytes (100 hex digits), its first document, and what lies outside the runs of covered bytes.
OP6_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select doc_id, cast(500 * j as bigint) as base, substr(h, cast(1000 * j + 1 as bigint), 1098) as part from (select doc_id, h, unnest(range(0, cast(ceil(length(h) / 1000) as bigint))) as j from d where length(h) >= 100)),
w as (select doc_id, base + j as i, substr(part, cast(2 * j + 1 as bigint), 100) as s from (select doc_id, base, part, unnest(range(0, cast(length(part) / 2 as bigint) - 49)) as j from b where length(part) >= 100)),
q as (select hash(s) as q from w group by 1 having min(doc_id) < max(doc_id)),
z as (select doc_id, i, s from w where hash(s) in (select q from q)),
f as (select s, min(doc_id) as first from z group by s),
c as (select doc_id, i from z join f using (s) where doc_id > first),
o as (select *, coalesce(i > lag(i) over (partition by doc_id order by i) + 50, true) as opens from c),
n as (select *, sum(opens::int) over (partition by doc_id order by i) as run from o),
r as (select doc_id, run, min(i) as lo, max(i) + 50 as hi from n group by all),
g as (select doc_id, list({'lo': lo, 'hi': hi} order by lo) as spans, cast(sum(hi - lo) as bigint) as n_removed, count(*) as n_spans from r group by doc_id),
k as (select d.doc_id, h, n_removed, n_spans, array_to_string(list_transform(range(1, len(spans) + 2), lambda j:
  substr(h, cast(case when j = 1 then 1 else 2 * spans[j - 1].hi + 1 end as bigint), cast(case when j > len(spans) then length(h) else 2 * spans[j].lo end - case when j = 1 then 0 else 2 * spans[j - 1].hi end as bigint))), '') as kept
  from d left join g using (doc_id))
select doc_id, cast(length(h) / 2 as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(case when n_spans is null then h else kept end)) as kept_sha256 from k
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(pattern: str, kind: int, group: int = 0) -> str:
    """A list of spans (start, kind, end, text of the group) of the matches of a pattern in t."""
    p = _quoted(pattern)
    return f"""list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda k: {{'s':
      coalesce(list_sum(list_transform(string_split_regex(t, {p})[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:k - 1], lambda x: length(x))), 0),
      'k': {kind}, 'e': coalesce(list_sum(list_transform(string_split_regex(t, {p})[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:k], lambda x: length(x))), 0),
      'v': regexp_extract_all(t, {p}, {group})[k]}})"""


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_LIMIT = "case " + " ".join(f"when regexp_matches(x.v, {_quoted(p)}) then {bits}" for p, bits in CLASSES) + " else 9.0 end"
_BITS = f"""list_max(list_transform(range(1, length(x.v) - {WINDOW} + 2), lambda i: - list_sum(list_transform(list_distinct(string_split(x.v[i:i + {WINDOW - 1}], '')),
  lambda c: len(list_filter(string_split(x.v[i:i + {WINDOW - 1}], ''), lambda y: y = c)) / {WINDOW}.0 * log2(len(list_filter(string_split(x.v[i:i + {WINDOW - 1}], ''), lambda y: y = c)) / {WINDOW}.0)))))"""
_HAS = lambda p: f"regexp_matches(x.v, {_quoted(p)})"
_TOLD = " or ".join(["(" + " and ".join(map(_HAS, MIXED[0])) + ")", _HAS(CLASSES[0][0]), "(" + " and ".join(map(_HAS, (CLASSES[1][0], *MIXED[1]))) + ")"])
_KIND = "[" + ", ".join(_quoted(k) for k in KINDS) + "]"
_JOIN = f"array_to_string(list_transform(%s, lambda x: {_KIND}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"

OP9_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
b as (select doc_id, t, list_sort(list_concat(list_concat(list_filter({_found(_ASSIGN, 0, 2)}, lambda x: length(x.v) >= 6), list_filter({_found('AKIA[A-Z0-9]+', 1)}, lambda x: x.e - x.s >= 20)),
  list_filter({_found('[0-9a-f]{24,}', 2)}, lambda x: x.e - x.s >= 24))) as base from d),
c as (select *, {_found(CANDIDATE, 3)} as runs from b),
f as (select *, list_filter(runs, lambda x: ({_TOLD}) and not regexp_matches(x.v, {_quoted(ALLOWED)})
  and len(list_filter(base, lambda y: y.s < x.e and x.s < y.e)) = 0 and {_BITS} >= {_LIMIT}) as added from c)
select doc_id, cast(len(list_filter(base, lambda x: x.k = 0)) as bigint) as n_assign, cast(len(list_filter(base, lambda x: x.k = 1)) as bigint) as n_access, cast(len(list_filter(base, lambda x: x.k = 2)) as bigint) as n_hex,
 sha256({_JOIN % 'base'}) as base_sha256, {_JOIN % 'list_sort(list_concat(base, added))'} as spans from f
"""
