"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .urlalias import HIDDEN, REFERENCES

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _cases(rules: list[tuple[str, str]], value: int) -> str:
    """The first of the rules, longest first, that fits columns host and path."""
    whens = []
    for r in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = r[0].partition("/")
        whens.append(f"when (host = '{name}' or suffix(host, '.{name}')) and prefix(path, '/{rest}') then '{r[value]}'")
    return f"case {' '.join(whens)} end"


def _parts(url: str) -> str:
    return (
        f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOW}') as host, "
        f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path"
    )


def _plain(p: str) -> str:
    """A path without . and .. segments, / for an empty one."""
    walked = f"list_reduce(list_prepend('', string_split(substr({p}, 2), '/')), lambda a, x: case when x = '.' then a when x = '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || x end)"
    return rf"case when {p} = '' then '/' when regexp_matches({p}, '/\.\.?$') then {walked} || '/' when regexp_matches({p}, '/\.\.?/') then {walked} else {p} end"


def _node(url: str) -> str:
    query = r"regexp_extract(u, '(?s)^[^?#]*(\?[^#]*)', 1)"
    scheme = "lower(regexp_extract(u, '(?s)^(.*?)://', 1))"
    return f"(select case when host <> '' then {scheme} || '://' || host || {_plain('path')} || {query} end from (select u, {_parts('u')} from (select {url} as u)))"


def _decoded(x: str) -> str:
    out = rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    for name, char in REFERENCES:
        out = "replace({}, '{}', '{}')".format(out, name, char.replace("'", "''"))
    return out


def _resolved(x: str, base: str) -> str:
    folder = f"regexp_extract({base}, '^(.*?://[^/?#]*(?:[^?#]*/)?)', 1)"
    return (
        f"case when regexp_matches({x}, '(?i)^[a-z][a-z0-9+.-]*://') then {x} when prefix({x}, '//') then regexp_extract({base}, '^(.*?:)//', 1) || {x} "
        f"when prefix({x}, '/') then regexp_extract({base}, '^(.*?://[^/?#]*)', 1) || {x} when suffix({folder}, '/') then {folder} || {x} else {folder} || '/' || {x} end"
    )


_HREF = r"""coalesce(nullif(regexp_extract(t, '(?i)\bhref\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(t, '(?i)\bhref\s*=\s*''([^'']*)''', 1), ''),
  regexp_extract(t, '(?i)\bhref\s*=\s*([^\s>"'']+)', 1))"""
_MOVE = r"""regexp_extract(t, '(?i)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*[''"]?([^"''>\s]+)', 1)"""
_IS_LINK = r"""regexp_matches(t, '(?i)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')"""
_IS_MOVE = r"""regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')"""
_LINKS = (
    rf"list_filter(list_transform(list_concat(list_transform(list_filter(regexp_extract_all(h, '(?is)<link\b[^>]*>'), lambda t: {_IS_LINK}), lambda t: {_HREF}),"
    rf" list_transform(list_filter(regexp_extract_all(h, '(?is)<meta\b[^>]*>'), lambda t: {_IS_MOVE}), lambda t: {_MOVE})), lambda x: {_decoded('x')}), lambda x: x <> '')"
)
_BASE = rf"(select case when named <> '' then {_resolved('named', 'url')} else url end from (select {_decoded(_HREF)} as named from (select regexp_extract(h, '(?is)<base\b[^>]*>') as t)))"


def url_alias(rules: list[tuple[str, str]]) -> str:
    rule, said = _cases(rules, 0), _cases(rules, 1)
    return f"""with recursive read as (select page_id, url, {_parts('url')}, regexp_replace(coalesce(html, ''), '{HIDDEN}', '', 'g') as h from pages),
 rows_ as (select page_id, url, coalesce(host, '') as host, coalesce(path, '') as path, {_node('url')} as node, {_BASE} as base, {_LINKS} as links from read),
 named as (select node, {_resolved('x', 'base')} as t from (select node, base, unnest(links) as x from rows_ where node is not null)),
 raw as (select node as a, {_node('t')} as b from named),
 edges as (select a, b from raw where a <> b union select b, a from raw where a <> b),
 reach(node, root) as (select a, a from edges union select e.b, r.root from reach r join edges e on e.a = r.node),
 comp as (select node, min(root) as alias_of from reach group by node),
 places as (select alias_of, {said} as said from (select alias_of, {_parts('node')} from comp)),
 decided as (select alias_of, case when bool_or(said = 'allow') then 'allow' when bool_or(said = 'block') then 'block' else 'allow' end as carried from places group by alias_of)
 select page_id, host, path, {rule} as rule, coalesce({said}, carried, 'allow') as verdict, alias_of from rows_ left join comp using (node) left join decided using (alias_of)"""


def shingle_components(width: int, hundredths: int) -> str:
    joined = " || ' ' || ".join(f"ws[i + {k}]" for k in range(width))
    return rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[^\x20\x09-\x0D]+') as ws from documents),
 sets as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < {width} then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - {width - 2}), lambda i: {joined}) end) as s from w),
 x as (select doc_id, len(s) as n, unnest(s) as s from sets),
 links as (select a, b from (select p.doc_id as a, q.doc_id as b, any_value(p.n) as n, any_value(q.n) as m, count(*) as i from x p join x q on p.s = q.s and p.doc_id < q.doc_id group by all) where 100 * i >= {hundredths} * (n + m - i)),
 edges as (select a, b from links union all select b, a from links),
 reach(node, root) as (select doc_id, doc_id from sets union select e.b, r.root from reach r join edges e on e.a = r.node where r.root < e.b),
 comp as (select node, min(root) as c from reach group by node)
 select doc_id, cast(len(s) as bigint) as n_shingles, c as component_id, doc_id = c as kept from sets join comp on node = doc_id"""


def cosine_components(cosine: float) -> str:
    return f"""with recursive v as (select vec_id, cast(embedding as double[]) as e, row_number() over () as r from embeddings),
 good as (select vec_id, e, r, len(e) as n from v where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
 links as (select p.r as a, q.r as b from good p join good q on p.n = q.n and p.r <> q.r where list_cosine_similarity(p.e, q.e) >= {cosine}),
 reach(node, root) as (select r, r from v union select l.b, h.root from reach h join links l on l.a = h.node),
 comp as (select node, min(vec_id) as c from reach join v on v.r = root group by node),
 n as (select a, count(*) as n from links group by a)
 select vec_id, coalesce(n, 0) as n_links, coalesce(c, vec_id) as component_id, vec_id is not distinct from coalesce(c, vec_id) as kept from v join comp on node = r left join n on a = r"""


_CRC = """tab as (select list(c order by i) as t from (with recursive s(i, k, c) as (select i, 0, cast(i as ubigint) from range(256) x(i)
   union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from s where k < 8) select i, c from s where k = 8))"""


def _crc(x: str) -> str:
    """The CRC-32 of a string's bytes, by the table t."""
    code = f"list_transform(range(octet_length(encode({x}))), lambda k: cast('0x' || substr(hex(encode({x})), 2 * k + 1, 2) as ubigint))"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {code}), lambda a, b: xor(a >> 8, t[cast(xor(a, b) & 255 as bigint) + 1])), 4294967295::ubigint)"


def resampling(percent: int, least_words: int, seed: int, buckets: int) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""with {_CRC},
 w as (select doc_id, row_number() over () as r, {words} as ws from documents), bw as (select {words} as ws from benchmark),
 feats as (select *, list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as f from w),
 x as (select r, unnest(f) as f from feats), y as (select unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from bw),
 names as (select f, cast({_crc('f')} % {buckets} as bigint) as b from (select f from x union select f from y), tab),
 s as (select b, count(*) as n from x join names using (f) group by b), t as (select b, count(*) as n from y join names using (f) group by b),
 total as (select (select coalesce(sum(n), 0) from s) as s, (select coalesce(sum(n), 0) from t) as t),
 gains as (select s.b, cast(floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * (total.s + {buckets})::double / ((s.n + 1.0::double) * (total.t + {buckets})::double))) as bigint) as g from s left join t using (b), total),
 weights as (select r, sum(g)::bigint as g from x join names using (f) join gains using (b) group by r),
 scored as (select doc_id, len(ws) as n, len(f) as n_features, case when len(f) = 0 then 0 else cast((g - ((g % len(f)) + len(f)) % len(f)) // len(f) as bigint) end as weight,
   cast('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8) as bigint) as h from feats left join weights using (r)),
 final as (select doc_id, n, n_features, weight, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from scored),
 place as (select *, case when n >= {least_words} then row_number() over (partition by n >= {least_words} order by score desc, doc_id nulls last, n_features) end as p, count(*) filter (n >= {least_words}) over () as m from final)
 select doc_id, n_features, weight, score, case when p <= {percent} * m // 100 then p end as rank from place"""


def prefix_trie(family: int, heads: int) -> str:
    return rf"""with {_CRC},
 turns as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as p from conversations where conv_id is not null),
 sizes as (select c, c - c % {family} as base, max(p) as n, cast({_crc('c::varchar')} % {heads} as bigint) as h from turns, tab group by c, t),
 convs as (select s.*, least(s.h, coalesce(b.n, 0)) as head from sizes s left join (select c, n from sizes) b on b.c = s.base),
 built as (select c, p - h + head as depth, role, text from turns join convs using (c) where p > h
   union all select convs.c, p, role, text from convs join turns on turns.c = base and p <= head),
 deep as (select c, depth, list((role, text)) over (partition by c order by depth) as key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from built),
 paths as (select c, depth, sha256(to_json(key)) as key, words from deep union all select c, 0, '', 0 from convs),
 ends as (select c, max(depth) as last from paths group by c),
 nodes as (select key, depth, min(c) as low, count(*) as n, any_value(words) as words, sha256(coalesce(string_agg(case when depth = last then c::varchar end, ',' order by c), '')) as sha from paths join ends using (c) group by key, depth),
 up as (select n.key, n.depth, p.key as above from nodes n join paths p on p.c = n.low and p.depth = n.depth - 1),
 kids as (select above as key, depth - 1 as depth, count(*) as k from up group by all),
 under as (select p.key, p.depth, sum((n.n - 1) * n.words) as saved, count(*) filter (not exists (select 1 from kids where kids.key = n.key and kids.depth = n.depth)) as leaves
   from nodes n join paths p on p.c = n.low and p.depth <= n.depth group by p.key, p.depth)
 select n.low as conv_id, n.depth as depth, a.low as parent_conv_id, n.n as n_convs, coalesce(k, 0) as n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens, n.sha as ends_sha256
 from nodes n join under using (key, depth) left join kids using (key, depth) left join up using (key, depth) left join nodes a on a.key = above and a.depth = n.depth - 1"""
