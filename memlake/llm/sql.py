"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

#: Words of the decontamination contract, windows of 10, and the documents' windows equal to an item's.
ORACLES["op7_decontaminate"] = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), wins as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, k, k + 9), ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) as k from bw where len(w) > 0)
), sizes as (select distinct n from wins
), dwins as (
  select doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from dw, sizes where len(w) >= n)
), hits as (select d.doc_id, d.k, d.n, b.item_id from dwins d join wins b on d.win = b.win and d.n = b.n
), hw as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hits) group by doc_id
), hi as (select doc_id, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) as items_sha256 from hits group by doc_id)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hw using (doc_id) left join hi using (doc_id)
"""


#: kind, regex, group, least characters of the group: the base kinds, then those that the method adds.
SECRETS = [
    ("assign", """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("forge", "gh[opsu]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat", "xox[abp]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 20),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]


def _secrets_sql() -> str:
    """Each rule's spans from the matches and the gaps between them."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found, spans = [], []
    for k, (kind, regex, group, least) in enumerate(SECRETS):
        found.append(f"regexp_extract_all(t, {quoted(regex)}, 0) as m{k}, string_split_regex(t, {quoted(regex)}) as g{k}, regexp_extract_all(t, {quoted(regex)}, {group}) as p{k}")
        upto = f"list_sum(list_transform(g{k}[1:i], lambda x: length(x))) + list_sum(list_transform(m{k}[1:i], lambda x: length(x)))"
        kept = f"list_filter(range(1, len(m{k}) + 1), lambda i: length(p{k}[i]) >= {least})"
        spans.append(f"list_transform({kept}, lambda i: {{'s': ({upto} - length(m{k}[i]))::bigint, 'k': {k}, 'e': ({upto})::bigint, 'n': '{kind}'}})")
    base = "'assign', 'access', 'hex'"
    text = "array_to_string(list_transform({}, lambda x: x.n || ':' || x.s || ':' || x.e), ',')"
    count = "len(list_filter(a, lambda x: x.n = '{0}'))::bigint as n_{0}"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
f as (select doc_id, {", ".join(found)} from d),
s as (select doc_id, list_sort({" || ".join(spans)}) as a from f)
select doc_id, {count.format("assign")}, {count.format("access")}, {count.format("hex")},
  sha256({text.format(f"list_filter(a, lambda x: x.n in ({base}))")}) as base_sha256, {text.format("a")} as spans
from s
"""


ORACLES["op2_secret_scan"] = _secrets_sql()


ORACLES["op5_chat_format"] = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r as (
  select *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') as t,
    replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:'), chr(10), '\' || chr(10)) as h from c
)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length('### ' || h || ': ' || t || '</turn>' || chr(10)))::bigint as formatted_chars
from r group by conv_id
"""

ORACLES["op6_warc"] = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join f using (payload_digest)
"""

ORACLES["op11_conversation_trie"] = """
with r as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as place
  from conversations where conv_id is not null
), digits as (select conv_id, place, sha256(length(role) || ':' || role || text) as t, strlen(text) as b from r
), bytes as (
  select conv_id, list_transform(range(1, length(conv_id::varchar) + 1), lambda k: ascii((conv_id::varchar)[k])) as cs from (select distinct conv_id from r)
), crcs as (
  -- CRC-32 of the decimal digits, bit by bit
  select conv_id, xor(list_reduce(cs, lambda crc, c: list_reduce(range(8), lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(crc, c)), 4294967295::bigint), 4294967295) % 9 as h from bytes
), named as (select conv_id, conv_id - conv_id % 5 as base, h from crcs
), taken as (select n.conv_id, n.h, least(n.h, coalesce(max(d.place), 0)) as m from named n left join digits d on d.conv_id = n.base group by n.conv_id, n.h
), turns as (
  select n.conv_id, d.place as depth, d.t, d.b from named n join digits d on d.conv_id = n.base and d.place <= n.h
  union all select n.conv_id, d.place - n.h + n.m, d.t, d.b from taken n join digits d on d.conv_id = n.conv_id and d.place > n.h
), paths as (
  select conv_id, depth, b, string_agg(t, '') over (partition by conv_id order by depth) as prefix, count(*) over (partition by conv_id) as n from turns
  union all select conv_id, 0, 0, '', coalesce(n, 0) from named left join (select conv_id, count(*) as n from turns group by 1) using (conv_id)
), nodes as (
  select depth, prefix, min(conv_id) as conv_id, count(*) as n_convs, any_value(b) as b, substr(prefix, 1, length(prefix) - 64) as parent,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '')) as ends_sha256
  from paths group by depth, prefix
), kids as (select depth - 1 as depth, parent as prefix, count(*) as n_children from nodes where depth > 0 group by all
), known as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids using (depth, prefix)
), above as (
  select p.depth, p.prefix, sum((k.n_children = 0)::int) as n_leaves, sum((k.n_convs - 1) * k.b) as saved_tokens
  from known k join paths p on p.conv_id = k.conv_id and p.depth <= k.depth group by all
)
select k.conv_id::bigint as conv_id, k.depth::bigint as depth, p.conv_id::bigint as parent_conv_id, k.n_convs::bigint as n_convs, k.n_children::bigint as n_children,
  a.n_leaves::bigint as n_leaves, a.saved_tokens::bigint as saved_tokens, k.ends_sha256
from known k join above a using (depth, prefix) left join nodes p on k.depth > 0 and p.depth = k.depth - 1 and p.prefix = k.parent
"""

ORACLES["op12_frequent_baskets"] = """
with recursive b as (select distinct sale_id, item_id from sale_lines where sale_id is not null and item_id is not null),
n as (select count(distinct sale_id)::bigint as baskets from b),
f as (select item_id, count(*)::bigint as s, list(sale_id) as tids from b group by 1 having count(*) >= 8 and count(*) * 5000 >= (select baskets from n)),
fb as (select sale_id, item_id from b semi join f using (item_id)),
pr as (
  select x.item_id as lo, y.item_id as hi from fb x join fb y on x.sale_id = y.sale_id and x.item_id < y.item_id
  group by all having count(*) >= 8 and count(*) * 5000 >= (select baskets from n)
), sets as (
  select [item_id] as items, item_id as last, s, tids from f
  union all
  select items, last, len(tids)::bigint as s, tids
  from (select list_append(sets.items, f.item_id) as items, f.item_id as last, list_intersect(sets.tids, f.tids) as tids from sets join pr on pr.lo = sets.last join f on f.item_id = pr.hi)
  where len(tids) >= 8 and len(tids) * 5000 >= (select baskets from n)
), named as (select array_to_string(items, ',') as name, items, s from sets
), less as (
  select name, s, items[k] as c, array_to_string(list_concat(items[1:k - 1], items[k + 1:]), ',') as rest from (select *, unnest(range(1, len(items) + 1)) as k from named where len(items) > 1)
), open as (select distinct l.rest as name from less l join named p on p.name = l.rest and p.s = l.s
), held as (
  select l.name, l.c, p.s as a, f.s as own from less l join named p on p.name = l.rest join f on f.item_id = l.c, n
  where 100 * l.s >= 10 * p.s and l.s * baskets > p.s * f.s
), r as (
  select name, count(*)::bigint as n_rules, (arg_min(c, {'a': a, 'c': c}))::bigint as best_item, sha256(string_agg(c || ':' || a || ':' || own, ';' order by c)) as rules_sha256 from held group by 1
)
select named.name as items, len(items)::bigint as n_items, s::bigint as support, coalesce(n_rules, 0) as n_rules, best_item, coalesce(rules_sha256, sha256('')) as rules_sha256
from named anti join open using (name) left join r using (name)
"""
