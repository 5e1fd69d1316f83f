"""DuckDB SQL for the queries of the catalogue, assembled from shared stages."""

from __future__ import annotations

from .functions.entities import PROJECT_WORDS, STOP
from .operators.fusion import branch_weight
from .plans.tables import AS_OF_MS, DAY_MS

_UUID = """(lower(substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||
  case when instr('0123456789abcdef', substr(h,17,1)) - 1 in (0,4,8,12) then '8' when instr('0123456789abcdef', substr(h,17,1)) - 1 in (1,5,9,13) then '9'
  when instr('0123456789abcdef', substr(h,17,1)) - 1 in (2,6,10,14) then 'a' else 'b' end||substr(h,18,3)||'-'||substr(h,21,12)))"""

MEM = f"""
base as (
  select d.*, doc_id // 4 as family, 'doc/' || (doc_id // 4 * 4) as memory_root_path,
    case when doc_id % 4 = 0 then 'doc/' || (doc_id // 4 * 4) else 'doc/' || (doc_id // 4 * 4) || '::section:' || lpad((doc_id % 4)::varchar, 4, '0') end as file_path,
    coalesce(text, '') as text_body
  from documents d
), named as (
  select *, 'c' || (family % 5) as collection, 'u' || (family % 3) as user_id, case when family % 2 = 0 then 'p' || (family % 4) end as project_id,
    case doc_id % 10 when 7 then 'image' when 8 then 'video' else 'text' end as content_type,
    case when doc_id % 13 = 0 then 0 else 1 end as active,
    case doc_id % 11 when 0 then {AS_OF_MS - DAY_MS} when 1 then {AS_OF_MS + DAY_MS} end as expires_at,
    {AS_OF_MS} - (doc_id % 60) * {DAY_MS} as embedded_at, sha256(text_body) as content_hash,
    case when file_path = memory_root_path then 'root' else 'child' end as memory_role
  from base
), hashed as (
  select *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(collection || '::' || user_id || '::::' || coalesce(project_id, '') || '::::' || memory_root_path)) as h from named
), mem as (
  select hashed.*, {_UUID} as memory_id, content_hash || '_0' as hash_seq, l.importance, e.embedding as vector,
    1 + 0.15 * coalesce(least(greatest(l.importance, 0), 1), 0) + case when doc_id % 60 <= 7 then 0.05 when doc_id % 60 <= 30 then 0.025 else 0 end as boost,
    regexp_extract(text_body, '^##?[^\\S\\n]+([^\\n]+)', 1) as heading
  from hashed left join (select doc_id, max(quality)::double as importance from labels group by 1) l using (doc_id)
  left join embeddings e on e.vec_id = doc_id
)"""
LIVE = f"live as (select * from mem where active = 1 and (expires_at is null or expires_at > {AS_OF_MS}))"
QS = """qs as (
  select item_id as query_id, b.text as query, e.embedding as vector, 1.0 + (item_id % 3) * 0.5 as weight
  from benchmark b left join embeddings e on e.vec_id = item_id where item_id % 20 = 0
)"""


def _words(x: str, pattern: str = r"[\p{L}\p{N}_]+") -> str:
    return f"regexp_extract_all(lower({x}), '{pattern}')"


def bm25(rows: str = "live", limit: int = 20, out: str = "fts", queries: str = "qs") -> str:
    return f"""
{out}_words as (select query_id, unnest({_words("query")}) as term from {queries}), {out}_terms as (select query_id, term, count(*) as qn from {out}_words group by 1, 2),
{out}_tokens as (select hash_seq, file_path, length(text_body) as len, boost, unnest({_words("text_body")}) as term from {rows}),
{out}_tf as (select term, hash_seq, file_path, len, boost, count(*) as tf from {out}_tokens where term in (select term from {out}_terms) group by all),
{out}_df as (select term, count(*) as df from {out}_tf group by 1),
{out}_stats as (select count(*) as n, avg(length(text_body)) as avgdl from {rows}),
{out}_raw as (
  select query_id, hash_seq, file_path, boost, round(sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))), 9) as raw
  from {out}_tf join {out}_df using (term) join {out}_terms using (term), {out}_stats group by all
), {out}_score as (select query_id, hash_seq, file_path, round(raw * boost, 9) as score from {out}_raw where raw > 0),
{_top(out, limit)}"""


def _top(out: str, limit: int) -> str:
    return f"""{out}_best as (select * from {out}_score qualify row_number() over (partition by query_id, file_path order by score desc, hash_seq) = 1),
{out}_ranked as (select *, row_number() over (partition by query_id order by score desc, file_path) - 1 as rank0 from {out}_best),
{out} as (select query_id, file_path, hash_seq, rank0, score / max(score) over (partition by query_id) as score from {out}_ranked where rank0 < {limit})"""


def vec(rows: str = "live", limit: int = 20, out: str = "vec", queries: str = "qs") -> str:
    return f"""
{out}_score as (
  select query_id, file_path, hash_seq, round((1 + list_cosine_similarity(r.vector::double[], q.vector::double[])) / 2 * boost, 9) as score
  from {rows} r, {queries} q where r.vector is not null and q.vector is not null
), {_top(out, limit)}"""


def fused(order: list[str], *, intent=None, content_type=None, limit: int = 10) -> str:
    weights = {b: branch_weight(b, intent, content_type) for b in order}
    table = {"original_vec": "vec", "original_fts": "fts", "original_vec_exp1": "exp1"}
    union = " union all ".join(f"select query_id, file_path, rank0, '{b}' as branch, {i} as pos, {weights[b]}::double as w from {table[b]}" for i, b in enumerate(order))
    text = sum(w for b, w in weights.items() if "fts" in b)
    factor = sum(weights.values()) / (sum(weights.values()) - text)
    hit = f"content_type in ('image', 'video') and not lexical and {content_type in ('image', 'video')}"
    most = min(max(limit, 200), limit * 10)
    return f"""
branches as ({union}),
summed as (
  select query_id, file_path, sum(w / (61 + rank0)) as s, string_agg(distinct branch, '+' order by branch) as sources, min(rank0) as best_rank,
    min(pos * 1000000 + rank0) as seen, bool_or(branch like '%fts%') as lexical from branches group by 1, 2
), comp as (
  select s.*, m.content_type, {hit} as compensated, round(case when {hit} then s * {factor} else s end, 12) as rrf from summed s join (select file_path, content_type from mem) m using (file_path)
), fused as (
  select *, row_number() over (partition by query_id order by rrf desc, seen, file_path) as rrf_rank from comp qualify rrf_rank <= {most}
)"""


_PLAIN = "[a-z0-9]+"
_JACCARD = f"""case when len({_words("query", _PLAIN)}) = 0 or len({_words("text_body", _PLAIN)}) = 0 then 0.0 else
  len(list_intersect(list_distinct({_words("query", _PLAIN)}), list_distinct({_words("text_body", _PLAIN)})))::double /
  len(list_distinct(list_concat({_words("query", _PLAIN)}, {_words("text_body", _PLAIN)}))) end"""


def blended(media_enabled: bool = False, query_media: bool = False) -> str:
    """Ambiguity is not required here; text-only candidate sets take the text path."""
    return f"""
joined as (select f.query_id, f.file_path, f.rrf, f.sources, f.compensated, f.rrf_rank, f.content_type, m.text_body, m.memory_id, m.memory_role, m.memory_root_path, m.lang, m.source, q.query
  from fused f join mem m using (file_path) join qs q using (query_id)),
gates as (select *, {query_media} or bool_or(rrf_rank <= 20 and content_type in ('image', 'video')) over (partition by query_id) as media from joined),
caps as (select *, case when {query_media} then 5 when media then 10 else 20 end as cap from gates),
ins as (select *, rrf_rank <= cap and (length(trim(text_body)) > 0 or content_type in ('image', 'video')) as inside from caps),
paths as (
  select *, case when media and not {media_enabled} then 'media_disabled' when not bool_or(inside) over q then case when media then 'media_no_rerankable_candidates' else 'no_rerankable_candidates' end
    when media then case when bool_or(inside and content_type = 'image') over q then 'vl_image' when bool_or(inside and content_type = 'video') over q then 'vl_video' else 'text' end
    else 'text' end as rerank_path
  from ins window q as (partition by query_id)
), scored as (select *, case when inside and rerank_path in ('text', 'vl_image', 'vl_video') then {_JACCARD} else 0.5 end as rerank_score from paths),
normed as (
  select *, case when max(rrf) over q - min(rrf) over q < 1e-9 then 0 else (rrf - min(rrf) over q) / (max(rrf) over q - min(rrf) over q) end as rrf_norm,
    case when max(rerank_score) over k - min(rerank_score) over k < 1e-9 then 0.5 else (rerank_score - min(rerank_score) over k) / (max(rerank_score) over k - min(rerank_score) over k) end as rerank_norm,
    min(rerank_score) over q <> max(rerank_score) over q or min(rerank_score) over q <> 0.5 as meaningful,
    not bool_or(content_type in ('image', 'video')) over q and rerank_path = 'text' as all_text
  from scored window q as (partition by query_id), k as (partition by query_id, content_type in ('image', 'video'))
), weighed as (
  select *, case when not meaningful then 1.0 when all_text then case when rrf_rank <= 3 then 0.90 when rrf_rank <= 10 then 0.85 else 0.75 end
    else case when rrf_rank <= 3 then 0.75 when rrf_rank <= 10 then 0.60 else 0.40 end end::double as rrf_weight from normed
), blended as (select *, round(rrf_weight * rrf_norm + (1 - rrf_weight) * rerank_norm, 10) as score from weighed)"""


def rolled(limit: int = 10) -> str:
    return f"""
hits as (
  select *, row_number() over (partition by query_id, memory_id order by score desc, rrf_rank, file_path) as pos, count(*) over (partition by query_id, memory_id) as hit_count from blended
), tops as (
  select query_id, memory_id, hit_count, memory_root_path as path, file_path as evidence_path, rrf_rank, rrf, rerank_score, rrf_weight, sources, rerank_path,
    1 + case when hit_count > 1 then least(0.15, 0.03 * (hit_count - 1)) else 0 end as boost, score as top_score from hits where pos = 1
), rolled as (
  select *, round(top_score * boost, 9) as score, row_number() over (partition by query_id order by round(top_score * boost, 9) desc, rrf_rank, path) as rank from tops qualify rank <= {limit}
)"""


def _q(*stages: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(s.strip() for s in stages) + "\n" + select


def _hybrid(select: str, content_type: str | None = "text", limit: int = 10, media_enabled: bool = False, roll: bool = True, query_media: bool = False, asked: str = QS) -> str:
    rows = f"typed as (select * from live where content_type = '{content_type}')" if content_type else "typed as (select * from live)"
    parts = [MEM, LIVE, rows, asked, vec("typed"), bm25("typed"), fused(["original_vec", "original_fts"], content_type=content_type, limit=limit), blended(media_enabled, query_media)]
    return _q(*parts, *([rolled(limit)] if roll else []), select=select)


def _rrf(intent=None, content_type=None, expand=False) -> str:
    rows = f"typed as (select * from live where content_type = '{content_type}')" if content_type else "typed as (select * from live)"
    order = ["original_vec", *["original_vec_exp1"] * expand, "original_fts"]
    parts = [MEM, LIVE, rows, QS, vec("typed"), bm25("typed")]
    if expand:
        parts += ["eq as (select query_id, embedding as vector from qs join embeddings on vec_id = query_id + 1)", vec("typed", out="exp1", queries="eq")]
    return _q(*parts, fused(order, intent=intent, content_type=content_type), select="select query_id, file_path, sources, best_rank, compensated, rrf_rank, round(rrf, 9) as rrf from fused")


_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]+"


def _compact(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SPACE}', ' ', 'g'))"


def _shortened(x: str, most: int) -> str:
    head = f"substr({x}, 1, {most - 3})"
    cut = f"trim(regexp_extract({head}, '(?s)^(.*) [^ ]*$', 1))"
    return f"case when length({x}) <= {most} then {x} else rtrim(case when {cut} <> '' then {cut} else {head} end) || '...' end"


CONV = f"""
bodies as (select conv_id, turn, substr(lower({_compact("role")}), 1, 64) as r, {_compact("text")} as c from conversations),
turns as (select conv_id, turn, case when r <> '' then r else 'speaker' end as role, {_shortened("c", 6000)} as content from bodies where c <> ''),
kids as (select *, row_number() over (partition by conv_id order by turn, content) as seq, count(*) over (partition by conv_id) as total from turns)"""

_PHRASES = "'show me|image of|photo of|picture of|architecture diagram|flow chart|mind map|that photo|that image|the diagram|the chart|the picture|the screenshot|visual representation'"
_WORDS = "diagram|chart|screenshot|illustration|drawing|infographic|wireframe|mockup|sketch|whiteboard|portrait"
_OPENINGS = "['show me ', 'The mapreduce show ', 'a diagram of ', '', 'tableau ', 'photo of the ', 'show ', 'my wireframes ', 'how to ', ' What is ', 'the difference between ', 'how many of ']"
PHRASED = f"phrased as (select item_id as query_id, {_OPENINGS}[item_id % 12 + 1] || text as query from benchmark)"
VISUAL = f"""flagged as (select *, lower(trim(query)) as low, regexp_matches(low, {_PHRASES}) or low = 'show' or regexp_matches(low, '\\b({_WORDS})\\b')
  or (regexp_matches(low, '\\bshow\\b') and not list_contains(regexp_split_to_array(low, '\\s+'), 'show')) as visual from phrased)"""
_CORE = "low"
for _p in ["show me", "image of", "photo of", "picture of", "architecture diagram", "flow chart", "mind map", "that photo", "that image", "the diagram", "the chart", "the picture", "the screenshot", "visual representation"]:
    _CORE = f"replace({_CORE}, '{_p}', '')"
_CORE = f"trim(regexp_replace(trim(regexp_replace({_CORE}, '\\b(show|{_WORDS})\\b', '', 'g')), '^\\s*(of|a|an|the|with|for|in)\\b\\s*', ''))"

_REWRITES = [("how to", "guide for"), ("what is", "definition of"), ("best way to", "optimal method for"), ("difference between", "comparison of"), ("example of", "sample"), ("how do", "how does")]
_RULED = " ".join(f"when instr(low, '{o}') > 0 then [substr(low, 1, instr(low, '{o}') - 1) || '{n}' || substr(low, instr(low, '{o}') + {len(o)})]" for o, n in _REWRITES)
_BARE = f"trim(regexp_replace(regexp_replace({_compact("v")}, '^[\"''` ]+|[\"''` ]+$', '', 'g'), '^\\s*(?:[-*•]\\s*|\\d+[.)]\\s*)', ''))"
ASKED = f"""ruled as (select query_id, low, list_filter(regexp_split_to_array(low, '\\s+'), lambda w: w <> '')[3:] as rest from flagged where not visual),
turned as (select query_id, low, case {_RULED} when (starts_with(low, 'what ') or starts_with(low, 'how ')) and len(rest) > 0
  then [array_to_string(rest, ' '), 'information about ' || array_to_string(rest, ' ')] else [] end as vs from ruled),
items as (select query_id, low, unnest(vs) as v, generate_subscripts(vs, 1) as k from turned),
others as (select query_id, {_BARE} as query, row_number() over (partition by query_id order by k) as variant from items where {_BARE} <> '' and lower({_BARE}) <> low)"""

_JUDGED = """
rel as (select file_path as item, max(quality) + 1 - max(toxic) as relevance from labels join mem using (doc_id) group by 1),
judged as (select query_id, file_path, rank0 + 1 as rank, coalesce(relevance, 0) as rel from vec left join rel on item = file_path)"""
_CHANGES = """changes as (select event_id, 'u/' || user_id as path, case event_type when 'purchase' then 'deleted' when 'signup' then 'created' else 'modified' end as change, ts from events),
latest as (select * from changes qualify row_number() over (partition by path order by ts desc, event_id desc) = 1)"""



def _stored(upserted: bool) -> str:
    """Rows of the catalogue's store with copies of every tenth path in another collection; what tells files apart follows their path."""
    own = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    key = " || ".join(own(c) if c else "'-'" for c in ("collection", "user_id", "", "project_id", "", "file_path"))
    fresh = f"doc_id % 50 = 0 and collection <> 'k' and {upserted}"
    return f"""held as (select * from mem union all select * replace ('k' as collection) from mem where doc_id % 10 = 0),
state as (select * replace (case when {fresh} then 'Updated text ' || doc_id else text_body end as text_body, case when {fresh} then 1.05 else boost end as boost,
  case when {fresh} then 1 else active end as active, case when {fresh} then null else expires_at end as expires_at) from held),
live as (select * replace (file_path || chr(1) || md5({key}) || chr(1) || collection as file_path, md5({key}) as hash_seq) from state
  where active = 1 and (expires_at is null or expires_at > {AS_OF_MS}))"""


#: A marked path is the path, the hash of what tells equal paths apart, which ranks them, and the collection.
_STORED_HITS = "select query_id, string_split(file_path, chr(1))[1] as file_path, string_split(file_path, chr(1))[3] as collection, rank0, round(score, 6) as score from fts"

SQL: dict[str, str] = {
    "content_hash_dedup": "select sha256(coalesce(text, '')) as hash, min(doc_id) as first_doc_id, count(*) as n_refs, substr(sha256(coalesce(text, '')), 1, 6) as docid from documents group by 1, 4",
    "memory_identity": _q(MEM, select="select doc_id, file_path, memory_root_path, memory_role, memory_id, content_hash, hash_seq from mem"),
    "title_extract": r"""
with b as (select doc_id, coalesce(case doc_id % 4 when 0 then '# ' || text when 1 then '# Notes' || chr(10) || chr(10) || '## ' || text when 2 then 'intro' || chr(10) || '#+TITLE: ' || text else text end, '') as t from documents),
m as (select doc_id, trim(regexp_extract(t, '\A##?[^\S\n]+([^\n]+)', 1)) as a, trim(regexp_extract(t, '\n##\s+([^\n]+)', 1)) as b, trim(regexp_extract(t, '(?m)^#\+TITLE:\s*([^\n]+)$', 1)) as c from b)
select doc_id, case when a <> '' and a not in ('Notes', '📝 Notes') then a when a <> '' and b <> '' then b when c <> '' then c else doc_id::varchar end as title from m""",
    "visible_rows": _q(MEM, select="select doc_id, file_path, active from mem where active = 1"),
    "ttl_live_rows": _q(MEM, select=f"select doc_id, expires_at from mem where expires_at is null or expires_at > {AS_OF_MS}"),
    "namespace_filter": _q(MEM, select="select doc_id, collection, user_id, project_id from mem where collection = 'c1' and user_id = 'u1' and content_type = 'text'"),
    "path_family": _q(MEM, select="select doc_id, file_path, memory_role from mem where memory_root_path = 'doc/8'"),
    "root_rows": _q(MEM, select="select doc_id, file_path as root from mem where memory_role = 'root'"),
    "policy_multiplier": _q(MEM, select="select doc_id, round(boost, 6) as boost from mem"),
    "page_text": f"with t as (select page_id, {_compact("regexp_replace(html, '<[^>]+>', ' ', 'g')")} as t from pages) select page_id, length(t) as n_chars, sha256(t) as text_hash from t",
    "corpus_stats": _q(MEM, LIVE, select="select count(*) as n, round(avg(length(text_body)), 6) as avgdl from live"),
    "term_postings": _q(MEM, LIVE, QS, bm25(), select="select term, count(*) as df, sum(tf)::bigint as tf from fts_tf group by 1"),
    "bm25_topk_batch": _q(MEM, LIVE, QS, bm25(), select="select query_id, file_path, rank0, round(score, 6) as score from fts"),
    "bm25_topk_pruned": _q(MEM, LIVE, QS, bm25(), select="select query_id, file_path, rank0, round(score, 6) as score from fts"),
    "store_search": _q(MEM, QS, _stored(False), bm25(), select=_STORED_HITS),
    "store_search_after_upsert": _q(MEM, QS, _stored(True), bm25(), select=_STORED_HITS),
    "bm25_topk": _q(MEM, LIVE, QS, "mine as (select * from live where collection = 'c0')", "one as (select * from qs where query_id = 0)", bm25("mine", 10, queries="one"), select="select file_path, rank0, round(score, 6) as score from fts"),
    "vector_topk_batch": _q(MEM, LIVE, QS, vec(), select="select query_id, file_path, rank0, round(score, 6) as score from vec"),
    "vector_topk_cells": _q(MEM, LIVE, QS, vec(), select="select query_id, file_path, rank0, round(score, 6) as score from vec"),
    "vector_topk": _q(MEM, LIVE, QS, "mine as (select * from live where content_type = 'text')", "one as (select * from qs where query_id = 0)", vec("mine", 10, queries="one"), select="select file_path, rank0, round(score, 6) as score from vec"),
    "best_chunk_per_file": _q(MEM, LIVE, QS, "mine as (select * replace (source as file_path) from live)", vec("mine", 10), select="select query_id, file_path, hash_seq, rank0, round(score, 6) as score from vec"),
    "knn_label_recall": """
with r as (select q.vec_id as query_id, q.label = d.label as same, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 9) desc, d.vec_id) as rank
  from embeddings q join embeddings d on q.vec_id <> d.vec_id where q.vec_id % 20 = 0),
p as (select query_id, max((rank <= 1 and same)::int) as a, max((rank <= 5 and same)::int) as b, max((rank <= 10 and same)::int) as c from r where rank <= 10 group by 1)
select round(avg(a), 6) as recall_at_1, round(avg(b), 6) as recall_at_5, round(avg(c), 6) as recall_at_10, count(*) as queries from p""",
    "rrf_default": _rrf(),
    "rrf_text": _rrf(content_type="text"),
    "rrf_media_compensated": _rrf(content_type="image"),
    "rrf_exact_lookup": _rrf("exact_lookup"),
    "rrf_semantic": _rrf("semantic"),
    "rrf_broad": _rrf("broad"),
    "rrf_expanded": _rrf(expand=True),
    "rerank_jaccard": _hybrid("select query_id, file_path, rerank_path, round(rerank_score, 6) as rerank_score from blended", roll=False),
    "blend_text_tiers": _hybrid("select query_id, file_path, rrf_rank, rrf_weight, round(rrf_norm, 6) as rrf_norm, round(rerank_norm, 6) as rerank_norm, round(score, 6) as score from blended", roll=False),
    "blend_media_tiers": _hybrid(
        "select query_id, file_path, rrf_rank, rrf_weight, rerank_path, round(rerank_score, 6) as rerank_score, round(rrf_norm, 6) as rrf_norm, round(rerank_norm, 6) as rerank_norm, round(score, 6) as score from blended",
        content_type=None, media_enabled=True, roll=False),
    "rerank_media_disabled": _hybrid("select query_id, file_path, rerank_path, compensated, round(rerank_score, 6) as rerank_score, round(score, 6) as score from blended", content_type="video", roll=False),
    "explain_search": _hybrid(
        "select query_id, rank, path, sources, rrf_rank, rerank_path, round(score, 4) as score, round(rrf, 4) as rrf, round(rerank_score, 4) as rerank_score, round(rrf_weight, 4) as rrf_weight, round(boost, 4) as boost, path as payload_path, sources as payload_sources, rrf_rank::varchar as payload_rrf_rank, collection as payload_collection, user_id as payload_user_id, evidence_path as payload_evidence_path, "
        "original_vec_rank, original_fts_rank from rolled join (select file_path as evidence_path, collection, user_id from mem) using (evidence_path) "
        "left join (select query_id, file_path as evidence_path, rank0 + 1 as original_vec_rank from vec) using (query_id, evidence_path) left join (select query_id, file_path as evidence_path, rank0 + 1 as original_fts_rank from fts) using (query_id, evidence_path)"),
    "memory_rollup": _hybrid(
        """, sup as (select query_id, memory_id, list(file_path order by pos) as files, list([lower(lang), 'src ' || lower(source)] order by pos) as tg from hits group by 1, 2)
select r.query_id, path, hit_count, round(score, 6) as score, round(boost, 6) as boost,
  array_to_string(list_filter(files, lambda x: x <> path and x <> evidence_path)[1:5], ',') as supporting,
  array_to_string(list_transform(list_sort(list_transform(list_distinct(flatten(tg)), lambda t: {'p': list_position(flatten(tg), t), 't': t})), lambda x: x.t)[1:8], ',') as tags
from rolled r join sup using (query_id, memory_id)""", limit=30),
    "search_batch_merge": _hybrid(
        """select path, string_agg(query_id::varchar, ',' order by query_id) as source, round(sum(weight / (60 + rank)), 9) as score from rolled join qs using (query_id)
group by path order by round(sum(weight / (60 + rank)), 12) desc, min(query_id * 1000 + rank) limit 10""", limit=30),
    "conversation_turns": f"with {CONV.strip()} select conv_id, 'conv/' || conv_id || '::turn:' || lpad(seq::varchar, 4, '0') as file_path, role, seq, total, "
    "'# Conversation ' || conv_id || ' - turn ' || seq || ' of ' || total || chr(10) || 'Role: ' || role || chr(10) || 'Speaker: ' || role || chr(10) || chr(10) || content as text_body from kids",
    "conversation_roots": f"""with {CONV.strip()}, parts as (select conv_id, any_value(total) as total, list_sort(list(distinct role)) as people,
  string_agg('- Turn ' || seq || ' ' || role || ': ' || {_shortened("content", 360)}, chr(10) order by seq) filter (seq <= 8) as said from kids group by 1)
select conv_id, 'conv/' || conv_id as file_path, trim(substr('# Conversation ' || conv_id || chr(10) || chr(10) || 'Conversation with ' || total || ' turns.' || chr(10) ||
  'Participants: ' || array_to_string(people[1:12], ', ') || '.' || chr(10) || chr(10) || 'Turn excerpts:' || chr(10) || said, 1, 4000)) as text_body from parts""",
    "conversation_tags": f"""with {CONV.strip()}, firsts as (select conv_id, role, min(seq) as s, any_value(total) as total from kids group by 1, 2)
select conv_id, array_to_string(list_concat(['conversation', 'turns:' || any_value(total)], list('role:' || role order by s))[1:16], ',') as tags from firsts group by 1""",
    "list_collections": _q(MEM, select="select distinct collection from mem where active = 1"),
    "list_namespaces": _q(MEM, select="select distinct user_id, '' as session_id, coalesce(project_id, '') as project_id, '' as profile from mem where active = 1"),
    "list_memories": _q(MEM, select="select file_path, memory_id, embedded_at as updated_at from mem where active = 1 and memory_role = 'root' order by embedded_at desc, file_path limit 50"),
    "memory_summary": _q(MEM, f"""snips as (select memory_id, case memory_role when 'root' then 0 else 1 end as r, file_path, substr({_compact("text_body")}, 1, 640) as t from mem),
firsts as (select memory_id, lower(t) as k, arg_min(t, r || file_path) as t, min(r || file_path) as o from snips where t <> '' group by 1, 2),
nth as (select *, row_number() over (partition by memory_id order by o) as i, first_value(length(t)) over (partition by memory_id order by o) as l from firsts),
chosen as (select memory_id, string_agg(t, ' ' order by i) as s from nth where i = 1 or (i = 2 and l < 280) group by 1),
counts as (select memory_id, count(*) as snippets from mem group by 1)""", select=f"select memory_id, {_shortened("coalesce(s, '')", 320)} as summary, snippets from counts left join chosen using (memory_id)"),
    "memory_tags": _q(MEM, """each as (select memory_id, case memory_role when 'root' then '0' else '1' end || file_path as o, unnest([lower(lang), 'src ' || lower(source)]) as t, unnest([1, 2]) as k from mem),
firsts as (select memory_id, t, min(o || k) as o from each group by 1, 2), nth as (select *, row_number() over (partition by memory_id order by o) as i from firsts)""", select="select memory_id, string_agg(t, ',' order by i) as tags from nth where i <= 8 group by 1"),
    "count_rows": _q(MEM, select="select count(*) as chunks, count(distinct memory_id) as memories, count(distinct content_hash) as contents from mem where active = 1"),
    "orphan_content": _q(MEM, select="select content_hash as hash from mem group by 1 having bool_and(collection = 'c0')"),
    "rename_collection": _q(MEM, select="select file_path, case collection when 'c0' then 'renamed' else collection end as collection, memory_id, case collection when 'c0' then 'renamed' else collection end as document_collection from mem"),
    "delete_collection": _q(MEM, "rest as (select * from mem where collection <> 'c0')", select="""select 'embeddings' as table_name, collection, count(*) as n from rest group by 2 union all select 'documents', collection, count(*) from rest group by 2
union all select 'content', '', count(distinct content_hash) from rest"""),
    "delete_memory": _q(MEM, select="select file_path, case when memory_root_path = 'doc/8' then 0 else active end as active, memory_root_path <> 'doc/8' as has_chunk from mem"),
    "get_memory": _q(MEM, """own as (select * from mem where memory_root_path = 'doc/8' and active = 1),
told as (select string_agg(file_path, ',' order by memory_role <> 'root', file_path) as snippets, string_agg(substr(trim(text_body), 1, 500), '|' order by memory_role <> 'root', file_path) as told from own where trim(text_body) <> ''),
each as (select memory_role <> 'root' as c, file_path, unnest([lower(lang), 'src ' || lower(source)]) as t, unnest([1, 2]) as k from own),
firsts as (select t, min({'c': c, 'f': file_path, 'k': k}) as o from each group by 1)""", select="""select memory_id, memory_root_path as path, collection, (select string_agg(file_path, ',' order by file_path) from own where memory_role <> 'root') as children,
(select snippets from told) as snippets, (select sha256(told) from told) as told, (select string_agg(t, ',' order by o) from (select * from firsts order by o limit 8)) as tags from own where memory_role = 'root'"""),
    "upsert_memory": _q(MEM, """new as (select *, doc_id % 50 = 0 as fresh, case when doc_id % 50 = 0 then sha256('Updated text ' || doc_id) else content_hash end as now from mem)""", select=f"""
select file_path, collection, memory_id, now as content_hash, case when fresh then 1 else active end as active, embedded_at as created_at, case when fresh then {AS_OF_MS} else embedded_at end as updated_at, now as document_hash from new"""),
    "parent_summaries": _q(MEM, f"""snips as (select memory_id, case memory_role when 'root' then 0 else 1 end as r, file_path, heading, substr({_compact("text_body")}, 1, 4000) as t from mem),
firsts as (select memory_id, lower(t) as k, arg_min(t, r || file_path) as t, min(r || file_path) as o from snips where t <> '' group by 1, 2),
nth as (select *, row_number() over (partition by memory_id order by o) as i, first_value(length(t)) over (partition by memory_id order by o) as l from firsts),
chosen as (select memory_id, string_agg(t, chr(10) || chr(10) order by i) as s from nth where i = 1 or (i = 2 and l < 600) group by 1),
titles as (select memory_id, arg_min(case when trim(heading) <> '' and trim(heading) not in ('Notes', '📝 Notes') then trim(heading) else list_extract(string_split(file_path, '/'), -1) end, r || file_path) as title from snips group by 1)""",
        select=f"select memory_id, trim(substr(coalesce(s, {_compact("title")}), 1, 4000)) as summary from titles left join chosen using (memory_id)"),
    "result_bodies": _q(MEM, LIVE, QS, vec(), select="select query_id, file_path, sha256(text_body) as body_hash from vec join (select file_path, text_body from mem) using (file_path)"),
    "promote_batch": _q(MEM, select="select doc_id, case when doc_id % 4 = 2 then 1 when memory_root_path = 'doc/8' then 0 else active end as active from mem"),
    "watch_latest_per_path": f"with {_CHANGES} select path, change, event_id from latest",
    "watch_batches": f"with {_CHANGES}, b as (select *, (row_number() over (order by ts, path) - 1) // 32 as batch from latest) select path, batch, row_number() over (partition by batch order by case change when 'deleted' then 0 else 1 end, ts, path) as step from b",
    "watch_diff": """with x as (select 'd/' || doc_id as path, doc_id % 9 <> 0 as b, doc_id % 7 <> 0 as n, doc_id % 5 = 0 as m from documents)
select path, case when not b then 'created' when not n then 'deleted' else 'modified' end as change from x where (b or n) and not (b and n and not m)""",
    "hash_embedding": f"""with t as (select item_id, unnest({_words("text", _PLAIN)}) as w from benchmark), h as (select item_id, ('0x' || right(sha256(w), 3))::int as v from t),
b as (select item_id, v & 2047 as bucket, sum(case when (v >> 8) & 1 = 0 then 1.0 else -1.0 end)::double as s from h group by 1, 2)
select item_id, bucket, round(s / sqrt(sum(s * s) over (partition by item_id)), 6) as value from b""",
    "visual_query_flag": _q(PHRASED, VISUAL, select="select query_id, visual from flagged"),
    "expand_queries": _q(PHRASED, VISUAL, ASKED, select=f"""select query_id, 0 as variant, query from phrased union all
select query_id, 1, case when {_CORE} = '' then low else 'A photograph or image showing ' || {_CORE} end from flagged where visual union all select query_id, variant, query from others"""),
    "query_categories": _q(PHRASED, r"""asked as (select query_id, case when query_id % 3 = 0 then array_to_string(string_split(query, ' ')[1:2], ' ') else query end as q from phrased),
said as (select query_id, query_id % 4 = 0 as image, query_id % 4 = 1 as txt, regexp_matches(lower(q), 'diagram|visual|image|picture|photo') as says,
  len(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '')) as n from asked),
each as (select query_id, unnest([case when image and not txt then 'image_only' end, case when txt and not image then 'text_only' end, case when image <> says then 'cross_modal' end,
  case when n <= 2 then 'short_query' end, case when n >= 6 then 'long_query' end]) as category from said)""", select="select query_id, category from each where category is not null"),
    "benchmark_paths": r"""
with p as (select doc_id, case doc_id % 5 when 0 then 'doc/' || doc_id || '::section:0001' when 1 then 'a/' || doc_id || '.md' when 2 then 'x/' || doc_id || '.md' when 3 then 'v/' || doc_id || '.transcript.json'
  else 'doc ' || doc_id || '::a' end as path from documents)
select doc_id, path, case doc_id % 5 when 3 then 'v/' || doc_id || '.mp4' else string_split(path, '::')[1] end as memory_key from p""",
    "eval_hit_mrr": _q(MEM, LIVE, QS, vec(), _JUDGED, """per as (select query_id, max((rank <= 1 and rel > 0)::int) as h1, max((rank <= 5 and rel > 0)::int) as h5, max((rank <= 10 and rel > 0)::int) as h10,
coalesce(1.0 / min(rank) filter (rel > 0), 0) as rr from judged group by 1)""", select="select round(avg(h1), 6) as hit_at_1, round(avg(h5), 6) as hit_at_5, round(avg(h10), 6) as hit_at_10, round(avg(rr), 6) as rr, count(*) as queries from per"),
    "eval_ndcg": _q(MEM, LIVE, QS, vec(), _JUDGED, "sorted as (select *, row_number() over (partition by query_id order by rel desc) as best from judged where rank <= 10)", """per as (select query_id, coalesce(1.0 / min(rank) filter (rel > 0), 0) as rr_at_10,
case when sum(rel) = 0 then 0 else sum(rel / log2(rank + 1)) / sum(rel / log2(best + 1)) end as ndcg from sorted group by 1)""", "prec as (select query_id, sum(rel) filter (rank <= 5) / 2.0 / least(5, count(*)) as p5, sum(rel) filter (rank <= 10) / 2.0 / least(10, count(*)) as p10 from judged group by 1)",
        select="select query_id, round(rr_at_10, 6) as rr_at_10, round(ndcg, 6) as ndcg_retrieved, round(p5, 6) as precision_at_5, round(p10, 6) as precision_at_10 from per join prec using (query_id)"),
    "eval_percentiles": """with s as (select list_sort(list(value)) as v, count(value) as n from events)
select round(v[ceil(n * 0.5)::int], 6) as p50, round(v[ceil(n * 0.95)::int], 6) as p95, round(v[floor(n * 0.5)::int + 1], 6) as i50, round(v[floor(n * 0.95)::int + 1], 6) as i95 from s""",
    "stage_metrics": _q(MEM, LIVE, QS, vec(), bm25(), """b as (select 'original_vec' as stage, * from vec union all select 'original_fts', * from fts)""", select="""select stage, content_type, count(*) as n, round(min(score), 6) as min_score, round(max(score), 6) as max_score,
round(avg(score), 6) as mean_score from b join (select file_path, content_type from mem) using (file_path) group by 1, 2"""),
    "ingest_summary": _q(MEM, select="select content_type, case when length(text_body) > 5000 then 'too_large' when active = 0 then 'hidden' else 'ok' end as status, count(*) as files, sum(strlen(text_body))::bigint as bytes from mem group by 1, 2"),
}
SQL["vector_topk_blocks"] = SQL["vector_topk_batch"]
SQL["hybrid_search"] = _hybrid("select query_id, path, rank, case when root_hit then title else list_extract(string_split(path, '/'), -1) end as title, hit_count, evidence_path, round(score, 6) as score from rolled join (select query_id, memory_id, bool_or(memory_role = 'root') as root_hit from hits group by 1, 2) using (query_id, memory_id) join (select file_path as path, case when trim(heading) <> '' then trim(heading) else list_extract(string_split(file_path, '/'), -1) end as title from mem) using (path)")
SQL["search_image"] = _hybrid(
    "select query_id, path, rank, rerank_path, compensated, round(score, 6) as score from rolled join (select query_id, file_path as evidence_path, compensated from blended) using (query_id, evidence_path)",
    content_type="image", query_media=True, asked=QS.replace("b.text as query", "trim(substr(trim(b.text), 1, 2000)) as query"),
)

#: A cut depends on the one before, so chunks are a recursion; a chunk ends at the break of highest decayed weight in its last 200 characters.
_CUT = "coalesce(arg_max(r.p, r.w * (1 - ((c.at + 2048 - r.p) / 200.0) ** 2 * 0.7)), least(c.at + 2048, c.n))"
SQL["chunk_documents"] = rf"""
with recursive docs as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n from documents),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as k from docs where n > 2048),
spots as (select doc_id, k, line, sum(length(line) + 1) over (partition by doc_id order by k) - length(line) - 2 as p, lead(line) over (partition by doc_id order by k) as next,
  lag(line) over (partition by doc_id order by k) as prev, sum(starts_with(line, '```')::int) over (partition by doc_id order by k) as fences from lines),
breaks as (select doc_id, p::bigint as p, greatest(1, case when regexp_matches(line, '^#{{1,6}}([^#]|$)') then 110 - 10 * length(regexp_extract(line, '^#+')) when starts_with(line, '```') then 80
    when regexp_matches(line, '^(---|\*\*\*|___)\s*$') and next is not null then 60 else 0 end,
  case when line = '' and next is not null and (k = 2 or prev <> '') then 20 else 0 end, case when regexp_matches(line, '^([-*]|\d+\.)\s') then 5 else 0 end) as w
  from spots where k > 1 and (fences % 2 = 0 or starts_with(line, '```'))),
chunks as (
  select doc_id, n, -1 as seq, 0::bigint as a, 0::bigint as b, 0::bigint as at from docs
  union all
  (select c.doc_id, c.n, c.seq + 1, c.at, {_CUT}::bigint as b, case when {_CUT} - 256 > c.at then {_CUT} - 256 else {_CUT} end::bigint
  from chunks c left join breaks r on r.doc_id = c.doc_id and c.at + 2048 < c.n and r.p between c.at + 1848 and c.at + 2048
  where c.seq < 0 or c.b < c.n group by c.doc_id, c.n, c.seq, c.at)
)
select doc_id, seq, a as pos, b - a as n_chars, sha256(substr(t, a + 1, b - a)) as chunk_hash from chunks join docs using (doc_id) where seq >= 0
"""

# -- entities and their graph -------------------------------------------------
# RE2 has no look-around and its \b is ASCII: every end of a word run is marked by two characters, of which a pattern's
# closing boundary takes the first and its opening boundary the second; both are stripped from what is matched.

_M = r"\x01\x02"


def _run(chars: str, least: int = 1) -> str:
    """At least `least` of the characters, with marks between and behind them."""
    return "".join(f"[{_M}]*[{chars}]" for _ in range(least)) + f"[{chars}{_M}]*"


def _found(pattern: str, text: str = "t") -> str:
    """A file's matches with the stretch before each: (?s)(.*?)(pattern)."""
    whole = f"'(?s)(.*?)({pattern})'"
    return f"""select file_path, unnest(regexp_extract_all({text}, {whole}, 1)) as gap, unnest(regexp_extract_all({text}, {whole}, 2)) as said,
    generate_subscripts(regexp_extract_all({text}, {whole}, 2), 1) as k from marked"""


_BLANK = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]"
_NAMED = r"A-Za-z0-9&._\-"
_PROPER = rf"\x01[A-Z]{_run(_NAMED)}(?:[{_M}]*{_BLANK}(?:{_BLANK}|[{_M}])*[A-Z]{_run(_NAMED)}){{0,4}}\x02"
_ACRONYM = rf"\x01[A-Z]{_run('A-Z0-9')}(?:[{_M}]*-{_run('A-Z0-9')})*\x02"
_TICKET = rf"\x01[A-Z]{{2,10}}[{_M}]*-[{_M}]*\p{{Nd}}{{1,6}}\x02"
_URL = rf"\x01https?[{_M}]*:[{_M}]*/[{_M}]*/[{_M}]*[^\s\x0b\p{{Z}})>\]{_M}][^\s\x0b\p{{Z}})>\]]*"
_DOMAIN = rf"\x01(?:{_run(r'A-Za-z0-9\-')}\.)+[{_M}]*[A-Za-z]{{2,}}\x02"
_HANDLE = rf"@{_run(r'A-Za-z0-9_.\-', 2)}"
_PLAIN = "replace(replace({0}, chr(1), ''), chr(2), '')".format
_EDGE = r"[.,;:!?()\[\]{}\x22''\x60]+"
_STOP = ", ".join(f"'{w}'" for w in sorted(STOP))
MENTIONS = rf"""marked as (
  select file_path, memory_id, memory_root_path as path, hash_seq || '|' || file_path as unit,
    regexp_replace(text_body, '([\p{{L}}\p{{N}}_]+)', chr(2) || chr(1) || '\1' || chr(2) || chr(1), 'g') as t from mem where active = 1
), matches as (
  select 1 as kind, * from ({_found(_URL)}) union all select 2, * from ({_found(_TICKET)}) union all select 3, * from ({_found(_ACRONYM)})
  union all select 4, * from ({_found(_PROPER)}) union all select 5, * from ({_found(_DOMAIN)})
  union all select 6, * from ({_found(_HANDLE, "replace(t, chr(1) || '@', chr(1) || chr(5))")})
), placed as (
  select file_path, {_PLAIN("said")} as said, (sum(length({_PLAIN("gap || said")})) over (partition by file_path, kind order by k) - length({_PLAIN("said")}))::bigint as a from matches
), trimmed as (select *, a + length(said) as b, regexp_replace({_compact("said")}, '^{_EDGE}|{_EDGE}$', '', 'g') as name from placed
), keyed as (
  select file_path, a, b, name, regexp_replace(regexp_replace(lower(regexp_replace(name, '^@', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as entity_key,
    row_number() over (partition by file_path order by a, b desc, said) as i from trimmed
), usable as materialized (
  select * from keyed where length(name) between 1 and 80 and length(entity_key) > 1 and name not in ({_STOP}) and entity_key not in ({_STOP.lower()})
), taken as (
  select file_path, 0::bigint as free, []::varchar[] as keys, 0 as ord, ''::varchar as name, ''::varchar as entity_key from marked
  union all
  select file_path, x.b, list_append(keys, x.entity_key), ord + 1, x.name, x.entity_key from (
    select t.file_path, t.keys, t.ord, arg_min(struct_pack(b := u.b, name := u.name, entity_key := u.entity_key), u.i) as x
    from taken t join usable u on u.file_path = t.file_path and u.a >= t.free and not list_contains(t.keys, u.entity_key)
    where t.ord < 24 group by t.file_path, t.keys, t.ord)
), mentions as materialized (select taken.file_path, memory_id, path, unit, ord, name, taken.entity_key from taken join marked using (file_path) where ord > 0)"""
_PROJECT = " or ".join(f"list_contains(string_split(lower(name), ' '), '{w}')" for w in PROJECT_WORDS)
_TYPE = rf"""case when starts_with(name, '@') then 'person' when regexp_full_match(name, '[A-Z]{{2,10}}-\p{{Nd}}{{1,6}}') then 'ticket'
  when regexp_full_match(name, 'https?://[^\s)>\]]+|(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,}}') then 'url' when regexp_full_match(name, '[A-Z][A-Z0-9]+(?:-[A-Z0-9]+)*') then 'acronym'
  when {_PROJECT} then 'project' else 'proper_noun' end"""
_SHARED = "shared as (select * from mentions where entity_key in (select entity_key from mentions where path = 'doc/4') and memory_id not in (select memory_id from mentions where path = 'doc/4'))"


def _graph(*stages: str, select: str) -> str:
    return _q(MEM, MENTIONS, *stages, select=select, recursive=True)


SQL["extract_entities"] = _graph(select=f"select file_path, ord, name, entity_key, {_TYPE} as entity_type from mentions")
SQL["co_mentions"] = _graph(
    """pairs as (select l.unit as hash_seq, l.entity_key as subject_key, r.entity_key as object_key, row_number() over (partition by l.unit order by l.ord, r.ord) as pair
  from mentions l join mentions r on l.unit = r.unit and l.ord < r.ord where r.ord <= 12)""",
    select="select sha256(hash_seq || chr(31) || subject_key || chr(31) || object_key) as id, * from pairs where pair <= 48",
)
SQL["related_memories"] = _graph(_SHARED, select="select memory_id, path, count(distinct entity_key) * 10 + count(*) as score from shared group by 1, 2 order by score desc, path limit 20")
SQL["memory_entities"] = _graph(select="select name, path, ord, entity_key from mentions order by lower(name), path, ord, name, entity_key limit 100")

# -- a cache's rounds ---------------------------------------------------------


def _cache_round(turn: int, fifths: str) -> str:
    """The cache after a round: what was asked, then the last used of the rest as far as there is room."""
    return f"""asked{turn} as (select distinct key from texts join benchmark using (text) where item_id % 5 in ({fifths})),
rest{turn} as (select s.*, row_number() over (order by used_in desc, tie desc) as place from held{turn} s join texts using (key) where key not in (select key from asked{turn})),
held{turn + 1} as (select key, coalesce(made_in, {turn}) as made_in, {turn} as used_in from asked{turn} left join held{turn} using (key)
  union all select key, made_in, used_in from rest{turn} where place <= (select count(*) // 2 from texts) - (select count(*) from asked{turn}))"""


SQL["vector_cache_lru"] = _q(
    """texts as (select text, min(item_id) as first_item, sha256('{"data":' || to_json(text)::varchar || ',"index_version":"0","model":"size","namespace":"","type":"text"}') as key,
  substr(sha256(sha256('{"data":' || to_json(text)::varchar || ',"index_version":"0","model":"size","namespace":"","type":"text"}')), 1, 13) as tie from benchmark where text is not null group by text)""",
    "held0 as (select key, 0 as made_in, 0 as used_in from texts where false)",
    *[_cache_round(turn, fifths) for turn, fifths in enumerate(("0, 1", "1, 2", "3", "0, 1"))],
    select="select first_item, made_in, used_in from held4 join texts using (key)",
)

_SHARES = ", ".join(f"avg(coalesce({s} <= {k}, false)::int) as {s}_at_{k}" for s in ("vector", "bm25", "rrf") for k in (5, 10))
SQL["stage_diagnostics"] = _q(
    MEM, LIVE, QS, vec(), bm25(), fused(["original_vec", "original_fts"]),
    """hits as (select 'vector' as stage, query_id, file_path, rank0 + 1 as rank from vec union all select 'bm25', query_id, file_path, rank0 + 1 from fts union all select 'rrf', query_id, file_path, rrf_rank from fused),
own as (select doc_id as query_id, lang, source from documents where doc_id in (select query_id from qs)),
met as (select h.query_id, min(rank) filter (stage = 'vector') as vector, min(rank) filter (stage = 'bm25') as bm25, min(rank) filter (stage = 'rrf') as rrf
  from hits h join own using (query_id) join mem m on m.file_path = h.file_path and m.source = own.source group by 1),
grouped as (select query_id, unnest(list_distinct(['all', lang])) as category from own)""",
    f"shares as (select category, count(*) as queries, {_SHARES} from grouped left join met using (query_id) group by 1)",
    "judged as (select *, greatest(vector_at_5, bm25_at_5, rrf_at_5) as best, round(rrf_at_5 - vector_at_5, 9) >= 0.05 or round(rrf_at_10 - vector_at_10, 9) >= 0.05 as lift from shares)",
    select="""select category, queries, round(vector_at_5, 6) as vector_at_5, round(bm25_at_5, 6) as bm25_at_5, round(rrf_at_5, 6) as rrf_at_5, round(vector_at_10, 6) as vector_at_10, round(bm25_at_10, 6) as bm25_at_10,
  round(rrf_at_10, 6) as rrf_at_10, round(greatest(0, 0.6 - best) + case when queries < 5 then 0.15 else 0 end + case when category = 'all' then 0.05 else 0 end, 6) as priority,
  case best when vector_at_5 then 'vector' when bm25_at_5 then 'bm25' else 'rrf' end as best_stage,
  array_to_string(list_filter([case when queries < 5 then 'under_sampled' end, case when category = 'all' and vector_at_5 < 0.6 then 'embedding_gap' end, case when lift then 'fusion_lift' end,
    case when not lift and category = 'all' and best < 0.6 then 'fusion_no_lift' end], lambda x: x is not null), ',') as issues from judged""",
)
