"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_line_dedup"] = r"""
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null
), pages as (select source, count(*) as pages from documents where source is not null group by 1),
bad as (
  select source, line from (select distinct doc_id, source, line from lines where regexp_matches(line, '[^\x09-\x0D\x20]'))
  join pages using (source) group by source, line, pages having count(*) >= 2 and count(*) > pages * 0.1
), kept as (
  select doc_id, count(*) as n_kept, string_agg(line, chr(10) order by pos) as text
  from lines l where not exists (select 1 from bad b where b.source = l.source and b.line = l.line) group by doc_id
)
select d.doc_id, d.source, case when d.text is null then null else coalesce(k.text, '') end as text,
  case when coalesce(d.text, '') = '' then 0 else len(string_split(d.text, chr(10))) end as n_lines,
  case when coalesce(d.text, '') = '' then 0 else len(string_split(d.text, chr(10))) - coalesce(n_kept, 0) end as n_removed
from documents d left join kept k using (doc_id)
"""

_HOST = r"case when instr({u}, '://') > 0 then translate(regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end"
_PATH = r"case when instr({u}, '://') > 0 then regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) else '' end"
_RULES = "(values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) r(v, h, p)"

#: Here no page has a canonical or refresh tag, so a url's aliases are those with its canonical form.
ORACLES["op2_url_filters"] = rf"""
with urls as (
  select page_id, url, {_HOST.format(u="url")} as host, {_PATH.format(u="url")} as path,
    case when instr(url, '://') > 0 then 'https://' || {_HOST.format(u="url")} || regexp_replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^(?s:.*?)://[^/?#]*((?s:.*))$', 1), '(?s:#.*)$', ''),
        '([?&])(?:(?:utm_[a-z]+|ref|gclid|fbclid)=[^&]*(?:&|$))+', '\1', 'g'),
        '([?&])(?:(?:utm_[a-z]+|ref|gclid|fbclid)=[^&]*(?:&|$))+', '\1', 'g'), '[?&]+$', ''), '^/$', '') else url end as canon
  from pages
), judged as (
  select u.*, (select h || p from {_RULES} where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1) as rule,
    (select v from {_RULES} where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1) as own
  from urls u
), forms as (select canon, bool_or(own = 'block') as b, bool_or(own = 'allow') as a from judged group by canon)
select page_id, host, path, rule, coalesce(own, case when b and not coalesce(a, false) then 'block' else 'allow' end) as verdict
from judged left join forms using (canon)
"""

ORACLES["op10_embedding_near_dedup"] = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
    and list_contains(list_transform(embedding, lambda x: x <> 0), true)
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9
), reach(n, r) as (
  select vec_id, vec_id from embeddings union select l.b, r from reach join links l on l.a = n
)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept from embeddings
join (select n as vec_id, min(r) as component_id from reach group by 1) using (vec_id)
left join (select a as vec_id, count(*) as n_links from links group by 1) using (vec_id)
"""

#: crc32 of a number's decimal digits, bit by bit.
_CRC32 = """xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({c}::varchar, ''), lambda ch: ascii(ch)::ubigint)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda p, q: xor(p >> 1, 3988292384::ubigint * (p & 1::ubigint)))))"""

_LOWERED = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _merkle(levels: int) -> str:
    """Trees of up to 16 ** levels leaves, a step of the WITH clause per level."""
    fields = [f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end" for c in ("doc_id", "source", "lang", "n_chars")]
    said = lambda text: f"sha256({' || '.join(fields)} || case when {text} is null then '-' else strlen({text}) || ':' || {text} end)"
    steps = [f"""leaves as (select doc_id, source, {said("text")} as leaf, case when doc_id is not null and {_CRC32.format(c="coalesce(doc_id, 0)")} % 5 = 0 then {said(_LOWERED.format(t="text"))} end as other from documents),
s0 as (select source as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, leaf as digest, count(*) over (partition by source) as width, doc_id, other from leaves)"""]
    for name, by in (("s", "tree"), ("t", "tree")):
        if name == "t":
            steps.append(f"t0 as (select 0 as tree, row_number() over (order by tree nulls first) - 1 as idx, digest, count(*) over () as width, tree as source from s{levels})")
        for k in range(levels):
            steps.append(f"{name}r{k} as (select {by}, idx // 16 as run, max(width) as width, string_agg(digest, '' order by idx) as told from {name}{k} group by 1, 2)")
            steps.append(f"{name}{k + 1} as (select {by}, run as idx, case when width = 1 then told else sha256(told) end as digest, (width + 15) // 16 as width from {name}r{k})")
    now = "d0"
    steps.append("d0 as (select doc_id, digest as leaf, s0.tree, s0.idx, t0.idx as spot, '' as proof, coalesce(other, digest) as back from s0 join (select source, idx from t0) t0 on s0.tree is not distinct from t0.source)")
    for n, (name, place) in enumerate([*[(f"sr{k}", f"idx // {16**k}") for k in range(levels)], *[(f"tr{k}", f"spot // {16**k}") for k in range(levels)]]):
        same = "d.tree is not distinct from r.tree and " if name.startswith("s") else ""
        before, after = f"substr(told, 1, 64 * ({place} % 16))", f"substr(told, 64 * ({place} % 16) + 65)"
        steps.append(f"d{n + 1} as (select doc_id, leaf, d.tree, idx, spot, proof || case when width = 1 then '' else {before} || {after} end as proof, case when width = 1 then back else sha256({before} || back || {after}) end as back from {now} d join {name} r on {same}{place} // 16 = r.run)")
        now = f"d{n + 1}"
    return f"""with {", ".join(steps)}
select doc_id, leaf, s.digest as subroot, t.digest as root, sha256(proof) as proof_sha256, back as folded_root, back = t.digest as verified
from {now} d join s{levels} s on d.tree is not distinct from s.tree cross join t{levels} t"""


ORACLES["op11_merkle_manifest"] = _merkle(4)

ORACLES["op12_conversation_trie"] = f"""
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as place from conversations where conv_id is not null
), convs as (
  select conv_id, conv_id - conv_id % 100 as base, ({_CRC32.format(c="conv_id")} % 6)::int as h from (select distinct conv_id from own)
), shared as (select c.conv_id, o.role, o.text, o.place from convs c join own o on o.conv_id = c.base and o.place <= c.h),
heads as (select conv_id, count(*) as n from shared group by 1),
built as (
  select * from shared union all
  select o.conv_id, role, text, o.place - h + coalesce(n, 0) as place from own o join convs using (conv_id) left join heads using (conv_id) where o.place > h
), named as (
  select conv_id, place as depth, length(text) as chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by place) as name from built
  union all select conv_id, 0, 0, '' from convs
), linked as (
  select *, lag(name) over w as up, row_number() over (partition by conv_id order by depth desc) = 1 as last from named window w as (partition by conv_id order by depth)
), nodes as (
  select name, depth, min(up) as up, min(chars) as chars, count(*) as n_convs, min(conv_id) as conv_id, string_agg(conv_id::varchar, ',' order by conv_id) filter (last) as ends from linked group by 1, 2
), counted as (
  select n.*, p.conv_id as parent_conv_id, coalesce(k, 0) as n_children, (n_convs - 1) * chars as saved from nodes n
  left join (select name, conv_id from nodes) p on n.up = p.name and n.depth > 0 left join (select up as name, count(*) as k from nodes where depth > 0 group by 1) c on c.name = n.name
), below as (
  select name, depth, sum(saved) as saved, sum(leaf) as leaves from (
    select l.name, l.depth, coalesce(sum(c.saved) over w, 0) as saved, coalesce(sum((c.n_children = 0)::int) over w, 0) as leaf
    from linked l left join counted c on c.name = l.name and c.conv_id = l.conv_id window w as (partition by l.conv_id order by l.depth desc)
  ) group by 1, 2
)
select conv_id::bigint as conv_id, depth::bigint as depth, parent_conv_id::bigint as parent_conv_id, n_convs::bigint as n_convs, n_children::bigint as n_children, leaves::bigint as n_leaves,
  b.saved::bigint as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from counted join below b using (name, depth)
"""

_WORDS = r"regexp_extract_all({t}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op13_decontamination"] = f"""
with docs as (select doc_id, {_WORDS.format(t=_LOWERED.format(t="coalesce(text, '')"))} as w from documents),
items as (select item_id, w, least(10, len(w)) as n from (select item_id, {_WORDS.format(t=_LOWERED.format(t="coalesce(text, '')"))} as w from benchmark) where len(w) > 0),
sought as (select item_id, n, j, array_to_string(w[j + 1 : j + n], ' ') as told from (select *, unnest(range(0, len(w) - n + 1)) as j from items)),
places as (select doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') as told from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as k from docs, (select distinct n from items))),
hits as (select doc_id, item_id, n, k, j from places join sought using (n, told)),
covered as (select doc_id, count(distinct k + o) as n_hit from (select doc_id, k, unnest(range(0, n)) as o from hits) group by 1),
named as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from hits) group by 1),
runs as (
  select doc_id, min(k) as spot, count(*) + min(n) - 1 as words from (
    select distinct doc_id, item_id, n, k, j, k - row_number() over (partition by doc_id, item_id, k - j order by k) as island from hits
  ) group by doc_id, item_id, k - j, island
), longest as (select doc_id, max(words) as longest, min_by(spot, (-words, spot)) as longest_at from runs group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated, coalesce(longest, 0)::bigint as longest, longest_at::bigint as longest_at
from docs d left join covered using (doc_id) left join named using (doc_id) left join longest using (doc_id)
"""
