"""SQL of the training-data queries that SQL can express, for DuckDB."""

from __future__ import annotations

_MIXING = r"""
with r as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    concat('domain', cast(cast(coalesce(nullif(regexp_extract(coalesce(source, ''), '(\d{1,9})$', 1), ''), '0') as int) % 4 as varchar)) as domain,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]', '', 'g')) + 1 as n_tokens from documents),
l3 as (select domain, lang, source, sum(n_tokens) as tokens, 2 * sum(n_tokens) as cap, power(sum(n_tokens)::double, 0.7) as weight from r group by all),
l2 as (select domain, lang, sum(tokens) as tokens, sum(cap) as cap, power(sum(tokens)::double, 0.7) as weight from l3 group by all),
l1 as (select domain, sum(tokens) as tokens, sum(cap) as cap, power(sum(tokens)::double, 0.7) as weight, (select sum(tokens) from l3)::double as budget from l2 group by all),
@1,
@2,
@3,
plan as (select domain, lang, source, cast(floor(share / tokens) as int) as passes, share - cast(floor(share / tokens) as bigint) * tokens as rest from s3),
k as (select r.*, passes, rest, md5(concat_ws(':', '17', passes, doc_id, n_tokens)) as h from r join plan using (domain, lang, source)),
c as (select *, sum(n_tokens) over (partition by domain, lang, source order by h, doc_id, n_tokens rows unbounded preceding) as upto from k)
select doc_id, domain, lang, source, n_tokens, cast(passes + cast(2 * upto - n_tokens <= 2 * rest as int) as int) as epochs from c"""


def _fill(k: int, parent: str, keys: str) -> str:
    """Water filling of level k: the children in the order of cap / weight, the first that its level doesn't fill."""
    source = f"l{k}" if k == 1 else f"(select l{k}.*, s{k - 1}.share::double as budget from l{k} join s{k - 1} using ({parent}))"
    part = f"partition by {parent}" if parent else ""
    return f"""f{k} as (select *, (budget - coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (w rows between current row and unbounded following) as level
  from {source} window w as ({part} order by cap / weight, {keys})),
g{k} as (select *, first_value(case when level * weight < cap then level end ignore nulls) over ({part} order by cap / weight, {keys} rows between unbounded preceding and unbounded following) as final from f{k}),
s{k} as (select * exclude (level, final), cast(case when final is null then cap else least(cap, floor(final * weight)) end as bigint) as share from g{k})"""


# Kinds of the secret scan: pattern as given, the group that holds the value, and what a value must be.
_KINDS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)""", 2, "length(value) >= 6"),
    ("access", "AKIA[A-Z0-9]+", 0, "length(value) >= 20"),
    ("hex", "[0-9a-f]+", 0, "length(value) >= 24"),
    ("generic", "[A-Za-z0-9+/_-]{24,}", 0, "regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')"),
)


def _spans(kind: str, pattern: str, group: int, good: str, order: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""select rid, owner, repo, '{kind}' as kind, {order} as ord, start, start + length(m) as stop, value from (
    select *, regexp_extract(m, '{pattern}', {group}) as value from (
      select rid, owner, repo, i, split_part(part, chr(2), 1) as m, cast(sum(length(part) - cast(i > 1 as int)) over (partition by rid order by i rows unbounded preceding) - length(part) + cast(i > 1 as int) as bigint) as start
      from (select rid, owner, repo, unnest(parts) as part, generate_subscripts(parts, 1) as i from (
        select rid, owner, repo, string_split(regexp_replace(text, '{pattern}', concat(chr(1), '\\0', chr(2)), 'g'), chr(1)) as parts from t)))
    where i > 1) where {good}"""


_SECRETS = f"""
with t as (select doc_id, row_number() over () as rid, translate(coalesce(text, ''), concat(chr(1), chr(2)), concat(chr(3), chr(3))) as text, coalesce(source, '') as owner, coalesce(lang, '') as repo from documents),
base as ({" union all ".join(_spans(*k, i) for i, k in enumerate(_KINDS[:3]))}),
extra as (select * from ({_spans(*_KINDS[3], 3)}) g where not exists (select 1 from base b where b.rid = g.rid and b.start < g.stop and g.start < b.stop)),
a as (select * from base union all select * from extra),
used as (select value, count(distinct owner) < 3 as live, count(distinct (owner, repo)) > 1 as spread from a group by value),
j as (select a.*, live, spread from a join used using (value)),
b as (select rid, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  coalesce(string_agg(concat_ws(':', kind, start, stop), ',' order by start, ord) filter (where ord < 3), '') as base,
  coalesce(string_agg(concat_ws(':', kind, start, stop), ',' order by start, ord) filter (where ord < 3 or live), '') as spans,
  count(*) filter (where live) as n_live, count(*) filter (where not live) as n_example, count(*) filter (where live and spread) as n_spread from j group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example, coalesce(n_spread, 0) as n_spread from t left join b using (rid)"""

# Scales 16, 64, 256 and 1024, of each 16 parts; a term is 56 bits of its md5, and the scale of number k reads 14 of them.
_IMATCH = r"""
with recursive scale as (select unnest([0, 1, 2, 3]) as k, unnest([16, 64, 256, 1024]) as parts),
d as (select doc_id, coalesce(text, '') as text from documents),
o as (select doc_id, text, length(text) as n, row_number() over (order by doc_id desc) as i, count(*) over () as many from d),
p as (select a.*, b.text as next, b.doc_id as next_id, left(a.text, a.n - a.n // 2) || left(b.text, a.n // 2) as edited from o a join o b on b.i = a.i % a.many + 1),
total as (select count(distinct text) as n from d),
w as (select unnest(list_distinct(string_split(lower(regexp_replace(text, '[\t\n\v\f\r]', ' ', 'g')), ' '))) as word from (select distinct text from d)),
c as (select word, count(*) as df from w where word <> '' group by word having count(*) >= greatest(2, 0.002 * (select n from total))),
lex as (select word, cast('0x' || left(md5(word), 14) as bigint) as digest, case when df > greatest(2, 0.25 * (select n from total)) then df else 0 end as above from c),
both_ as (select doc_id, 0 as which, text from p union all select doc_id, 1, edited from p),
u as (select doc_id, which, unnest(list_distinct(string_split(lower(regexp_replace(text, '[\t\n\v\f\r]', ' ', 'g')), ' '))) as word from both_),
k as (select doc_id, which, digest, row_number() over (partition by doc_id, which order by above, digest) as r,
  greatest(count(*) filter (where above = 0) over (partition by doc_id, which), 4, ceil(count(*) over (partition by doc_id, which) / 4.0)) as wanted from u join lex using (word)),
m as (select doc_id, which, digest, scale.k * 16 + ((digest >> (14 * scale.k)) & 16383) % parts as subset from k cross join scale where r <= wanted and ((digest >> (14 * scale.k)) & 16383) % parts < 16),
s as (select doc_id, which, subset, left(md5(string_agg(cast(digest as varchar), ',' order by digest)), 8) as x from m group by all),
f as (select doc_id, which, string_agg(coalesce(x, '-'), '' order by g.subset) as fp from (select distinct doc_id, which from s) t cross join (select unnest(range(64)) as subset) g left join s using (doc_id, which, subset) group by all),
alike as (select a.doc_id, a.which as wa, b.doc_id as other, b.which as wb, count(*) as same from s a join p on p.doc_id = a.doc_id join s b on b.subset = a.subset and b.x = a.x
  and ((b.doc_id = a.doc_id and b.which = 1) or (b.doc_id = p.next_id and b.which = 0)) where a.which = 0 group by all),
used as (select p.doc_id, q.other, q.wb, (select count(*) from (select subset from s where s.doc_id = p.doc_id and s.which = 0 union select subset from s where s.doc_id = q.other and s.which = q.wb)) as n
  from p, lateral (select p.doc_id as other, 1 as wb union all select p.next_id, 0) q)
select p.doc_id, p.n as n_chars, sha256(edited) as edited_sha256, coalesce(f0.fp, left(md5(p.text), 16)) as fingerprint, coalesce(f1.fp, left(md5(edited), 16)) as edited_fingerprint,
  case when p.text = edited then 1.0 when f0.fp is null or f1.fp is null then 0.0 else coalesce(a1.same, 0) / u1.n end::double as near_edited,
  case when p.text = p.next then 1.0 when f0.fp is null or f2.fp is null then 0.0 else coalesce(a2.same, 0) / u2.n end::double as near_next
from p left join f f0 on f0.doc_id = p.doc_id and f0.which = 0 left join f f1 on f1.doc_id = p.doc_id and f1.which = 1 left join f f2 on f2.doc_id = p.next_id and f2.which = 0
left join alike a1 on a1.doc_id = p.doc_id and a1.other = p.doc_id and a1.wb = 1 left join alike a2 on a2.doc_id = p.doc_id and a2.other = p.next_id and a2.wb = 0
left join used u1 on u1.doc_id = p.doc_id and u1.wb = 1 left join used u2 on u2.doc_id = p.doc_id and u2.wb = 0"""

# Every window of 100 bytes by its digest; those that are not the first with theirs cover what goes. Long texts are cut
# into parts of 1000 bytes with 99 more, since places in a long string are slow to find.
_REPEATS = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select doc_id, h, length(h) // 2 as n from d),
c as (select doc_id, n, k, substr(h, 2000 * k + 1, 2198) as part from n, unnest(range(0, n, 1000)) as r(x), lateral (select x // 1000 as k)),
w as (select doc_id, 1000 * k + i as pos, md5(substr(part, 2 * i + 1, 200)) as m from c, unnest(range(0, 1000)) as r(i) where 1000 * k + i + 100 <= n),
again as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by m order by doc_id, pos) as r from w) where r > 1),
runs as (select doc_id, pos, sum(cast(coalesce(pos > before + 100, true) as int)) over (partition by doc_id order by pos) as run from (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before from again)),
spans as (select doc_id, run, min(pos) as a, max(pos) + 100 as b from runs group by all),
cut as (select n.doc_id, any_value(n) as n, sum(b - a) as removed, count(*) as spans, max(b) as last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as head, any_value(h) as h
  from (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans) s join n on n.doc_id = s.doc_id group by n.doc_id)
select n.doc_id, n.n as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(head || substr(cut.h, 2 * last + 1), n.h))) as kept_sha256 from n left join cut using (doc_id)"""

# The text of a page's article, which the driver's pages mark; menus, adverts and footers are beside it.
_ARTICLES = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as h from pages),
b as (select page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(h, '</?(p|h1)[^>]*>', chr(1), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), chr(1)) as blocks from a),
t as (select page_id, url, array_to_string(list_filter(list_transform(blocks, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as t from b)
select page_id, url, replace(replace(t, '&quot;', '"'), '&amp;', '&') as text, length(replace(replace(t, '&quot;', '"'), '&amp;', '&')) as n_chars from t"""

_VECTORS = """
with recursive g as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(embedding::double[], embedding::double[]) > 0),
l as (select a.vec_id as u, b.vec_id as v from g a join g b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  and list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
r as (select vec_id as node, vec_id as root from embeddings union select l.v, r.root from r join l on r.node = l.u),
c as (select node, min(root) as component_id from r group by node), n as (select u, count(*) as k from l group by u)
select vec_id, coalesce(k, 0) as n_links, component_id, vec_id = component_id as kept from embeddings join c on vec_id = node left join n on vec_id = u"""

_LINES = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, pos, lines[pos] as line, translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from d, unnest(range(1, len(lines) + 1)) as r(pos)),
shared as (select k, max(doc_id) as owner from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
m as (select doc_id, pos, line, owner is not null and owner <> doc_id as gone from l left join shared using (k))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256 from m group by doc_id"""

_NEGATIVES = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
n as (select anchor_id, positive_id, other as negative_id, positive_score, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, other) as rank
  from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3"""

# The plain way: every group has every kept term, and pairs of groups meet term by term.
_DIVERGENCE = r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n from w group by all having count(distinct k) >= 30),
size as (select lang, count(*) as v, sum(n) as total from kept group by lang),
held as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
own as (select lang, source, sum(n) as total from held group by all),
x as (select g.lang, g.source, kept.term, coalesce(held.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(held.n, 0) + 5)) // (coalesce(own.total, 0) + 5 * size.v) as p, 1 + (1000000000::hugeint * (kept.n + 5)) // (size.total + 5 * size.v) as q
  from g join kept using (lang) join size using (lang) left join held on held.lang = g.lang and held.source = g.source and held.term = kept.term left join own on own.lang = g.lang and own.source = g.source),
far as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from x a join x b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(far.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join far on far.lang = a.lang and far.source = a.source and far.item = b.source),
every as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', term, p - q from x where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50"""

ORACLE_SQL = {
    "op2_embedding_near_dedup": _VECTORS,
    "op4_mixing": _MIXING.replace("@1", _fill(1, "", "domain")).replace("@2", _fill(2, "domain", "lang")).replace("@3", _fill(3, "domain, lang", "source")),
    "op6_exact_repeats": _REPEATS,
    "op7_main_text": _ARTICLES,
    "op9_secret_scan": _SECRETS,
    "op10_imatch": _IMATCH,
    "op11_line_dedup": _LINES,
    "op12_hard_negatives": _NEGATIVES,
    "op13_source_divergence": _DIVERGENCE,
}
