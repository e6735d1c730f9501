"""SQL that gives the same rows as a query, where SQL can express it on whole tables.

There is none for language spans, the classifier, the language model, the rolling hash, the packing and token counts, nor for
shards (the checking engine has no checksum of texts); tests compare these with brute force or hold out rows.
"""

from veilspan.llm.chat_format import CLOSE, LEARNED, MIDDLE, OPEN

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEAR_DUPLICATES = rf"""with recursive d as (
  select doc_id, regexp_extract_all({_LOWER.format("text")}, '{_WHITE}') as w from documents),
 s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])
         when len(w) > 0 then [w] else [] end) as g from d),
 n as (select doc_id, count(g) as n from d left join s using (doc_id) group by doc_id),
 shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
   group by all),
 links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
 reach as (select doc_id as a, doc_id as b from d union select reach.a, links.b from reach join links on links.a = reach.b)
select doc_id, n as n_shingles, min(reach.b) as component_id, doc_id = min(reach.b) as kept
from n join reach on reach.a = doc_id group by doc_id, n"""

TOP_K = """with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
   from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 5"""

_SAFE = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
_FRAME = len(OPEN) + len(MIDDLE) + len(CLOSE)
CHATS = rf"""with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 t as (select *, regexp_matches(role || chr(0) || text, '[<\[]\\*(/?s>|/?INST\])') as conflict from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 sum(case when role = '{LEARNED}' then length(text) else 0 end)::bigint as loss_chars,
 sha256(string_agg(case when role = '{LEARNED}' then text else '' end, '' order by turn, role, text)) as loss_sha256,
 (case when bool_or(conflict) then sum(length({_SAFE.format("role")}) + length({_SAFE.format("text")}) + {_FRAME})
   else sum(length(role) + length(text) + {_FRAME}) end)::bigint as formatted_chars
from t group by conv_id"""

CONTAMINATION = rf"""with d as (select doc_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') as w from documents),
 i as (select item_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') as w from benchmark),
 runs as (select distinct item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: w[k:k + n - 1])) as g
   from (select *, least(10, len(w)) as n from i where len(w) > 0)),
 places as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as k, w from d, (select distinct n from runs)),
 hits as (select doc_id, k, n, item_id from (select doc_id, n, k, w[k:k + n - 1] as g from places) join runs using (n, g)),
 words as (select doc_id, count(distinct spot) as n_hit from (select distinct doc_id, unnest(range(k, k + n)) as spot from hits) group by doc_id),
 items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
   from (select distinct doc_id, item_id::varchar as item from hits where item_id is not null) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
 sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""

_ROUND = """
 a{k} as materialized (select rid, p, min(d * 256 + entry) as best from (
   select rid, x.p as p, entry, list_sum(list_transform(list_zip(x.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
   from x join b{k} b on x.p = b.p) group by rid, p),"""
_UPDATE = """
 m{k} as (select p, entry, i, sum(c) as s, count(*) as n from (
   select a.p, a.best % 256 as entry, unnest(x.e) as c, unnest(range(len(x.e))) as i from a{k} a join x on x.rid = a.rid and x.p = a.p) group by all),
 b{next} as materialized (select p, entry, coalesce(m.e, b.e) as e from b{k} b left join (
   select p, entry, list((s - ((s % n) + n) % n)::bigint // n::bigint order by i) as e from m{k} group by p, entry) m using (p, entry)),"""
VECTOR_CODES = (
    """with v as (select row_number() over (order by vec_id nulls last, e) - 1 as rid, * from (
   select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
   where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
 x as materialized (select rid, p, e[p * len(e) // 4 + 1:(p + 1) * len(e) // 4] as e from v, range(4) parts(p)),
 b0 as (select p, rid as entry, e from x where rid < 256),"""
    + "".join(_ROUND.format(k=k) + _UPDATE.format(k=k, next=k + 1) for k in range(4))
    + _ROUND.format(k=4)
    + """
 h as (select sha256(string_agg(list_aggregate(e, 'string_agg', ','), ',' order by p, entry)) as codebooks_sha256 from b4),
 c as (select vec_id, label, string_agg(format('{:02x}', (best % 256)::int), '' order by p) as code, sum(best // 256)::bigint as error
   from v join a4 using (rid) group by rid, vec_id, label)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from c, h"""
)

#: The check sum of a number's decimal digits.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({c}::varchar, ''), lambda x: ascii(x)::bigint)),
   lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
     lambda r, _: case when r % 2 = 1 then xor(r // 2, 3988292384) else r // 2 end)))"""
PREFIX_TRIE = rf"""with own as (
  select conv_id as c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first,
     md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as t
  from conversations where conv_id is not null group by conv_id),
 h as (select c, c - c % 20 as base, t, {_CRC.format(c="c")} % 4 as h from own),
 r as (select h.c, list_concat(coalesce(b.t, [])[1:h.h], h.t[h.h + 1:]) as t from h left join own b on b.c = h.base),
 n as materialized (select d, t[1:d] as p, min(c) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where len(t) = d), '')) as ends_sha256
  from (select c, t, unnest(range(len(t) + 1)) as d from r) group by all),
 w as materialized (select n.*, (n_convs - 1) * (case when d > 0 then len(regexp_extract_all(p[d].text, '{_WHITE}')) else 0 end) as gain,
    (select count(*) from n k where k.d = n.d + 1 and k.p[1:n.d] = n.p) as n_children from n)
select w.conv_id, w.d as depth, u.conv_id as parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
from w left join n u on u.d = w.d - 1 and u.p = w.p[1:w.d - 1]
 join (select a.d, a.p, sum((b.n_children = 0)::int)::bigint as n_leaves, sum(b.gain)::bigint as saved_tokens
   from w a join w b on b.d >= a.d and b.p[1:a.d] = a.p group by a.d, a.p) s on s.d = w.d and s.p = w.p"""

ORACLES: dict[str, str] = {
    "op1_minhash_forest": NEAR_DUPLICATES,
    "op4_maxscore": TOP_K,
    "op9_chat_format": CHATS,
    "op10_suffix_decontamination": CONTAMINATION,
    "op11_vector_codes": VECTOR_CODES,
    "op12_prefix_trie": PREFIX_TRIE,
}
