"""DuckDB SQL of the training-data queries that SQL can express, without the operators' filters and trees."""

from __future__ import annotations

from lexiprop.llm.license_join import CLASSES, PHRASES, TEMPLATES, THRESHOLD

#: Every cell of the count matrix, for every pair of sources.
SOURCE_DIVERGENCE = r"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
           from documents),
numbered as (select row_number() over () as r, * from d),
c as (select r, lang, source, term, count(*) as n from (select r, lang, source, unnest(terms) as term from numbered) group by all),
kept as (select lang, term, sum(n) as n from c group by all having count(*) >= 10),
lt as (select lang, count(*) as v, sum(n) as n from kept group by lang),
g as (select distinct lang, source from d),
m as (select g.lang, g.source, k.term, coalesce(sum(c.n), 0) as n, any_value(k.n) as n_lang
      from g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term group by all),
gt as (select lang, source, sum(n) as n from m group by all),
p as (select m.lang, m.source, m.term, m.n,
             1 + (1000000000::hugeint * (m.n + 2)::hugeint) // (gt.n + 2 * lt.v)::hugeint as p,
             1 + (1000000000::hugeint * (m.n_lang + 2)::hugeint) // (lt.n + 2 * lt.v)::hugeint as q
      from m join gt using (lang, source) join lt using (lang)),
sums as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
         from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
          from g a join g b on a.lang = b.lang and a.source <> b.source
          left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
           from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10
"""


def license_scan() -> str:
    """Every block of every text against every template, without filters."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    rows = []
    for i, (label, text) in enumerate(TEMPLATES):
        span = next(s for s in CLASSES if len(text.split()) <= s)
        rows.append(f"({i}, '{label}', {span}, {sorted(set(text.split()))})")
    tests = []
    for phrase, label in PHRASES.items():
        same = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(), 1))
        tests.append(f"when {same} then '{label}'")
    return f"""
    with d as (select row_number() over () as r, doc_id, {words} as w from documents),
    t as (select * from (values {", ".join(rows)}) as v(id, label, span, members)),
    b as (select r, span, unnest(range(0, len(w), span)) as pos, w from d, (select distinct span from t)),
    m as (select b.r, t.label, len(list_intersect(t.members, w[pos + 1 : pos + 2 * b.span])) / len(t.members) as share from b join t using (span)),
    f as (select r, list(distinct label) as found, max(share) as best from m where round(share, 9) >= {THRESHOLD} group by r),
    i as (select r, w, unnest(range(0, len(w))) as i from d),
    p as (select r, i, case {" ".join(tests)} end as label from i),
    q as (select r, count(*) as n, min(i) as lo, max(i) as hi, list(distinct label) as base from p where label is not null group by r)
    select doc_id, len(w)::bigint as n_words, coalesce(q.n, 0)::bigint as n_base, q.lo as first_word, q.hi as last_word,
           array_to_string(list_sort(coalesce(q.base, []::varchar[])), ',') as base_labels,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(q.base, []::varchar[]), coalesce(f.found, []::varchar[])))), ',') as labels,
           case when q.n > 0 then 1.0::double else round(coalesce(f.best, 0), 9)::double end as score
    from d left join q using (r) left join f using (r)
    """


#: Nodes level by level, each leaf folded up through its siblings; CRC-32 bit by bit.
MERKLE_MANIFEST = r"""
with recursive
fields as (select row_number() over () as r, doc_id, lang, text,
                  case when doc_id is null then '-' else octet_length(encode(doc_id::varchar)) || ':' || doc_id end as a,
                  case when source is null then '-' else octet_length(encode(source)) || ':' || source end as b,
                  case when lang is null then '-' else octet_length(encode(lang)) || ':' || lang end as c,
                  case when n_chars is null then '-' else octet_length(encode(n_chars::varchar)) || ':' || n_chars end as d
           from documents),
crc as (select r, xor(4294967295::bigint, list_reduce(
               list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)),
               lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1))))) as crc
        from fields where doc_id is not null),
leaves as (select f.*, crc % 3 = 0 as hit,
                  sha256(a || b || c || d || case when text is null then '-' else octet_length(encode(text)) || ':' || text end) as leaf,
                  sha256(a || b || c || d || case when text is null then '-' else octet_length(encode(text)) || ':' ||
                         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end) as lowered
           from fields f left join crc using (r)),
placed as (select r, doc_id, leaf, case when hit then lowered else leaf end as start, dense_rank() over (order by lang nulls first) - 1 as g,
                  row_number() over (partition by lang order by doc_id nulls first, leaf, r) - 1 as pos, count(*) over (partition by lang) as n
           from leaves),
nodes as (select 0 as lvl, g, pos, n, leaf as digest from placed
          union all
          select lvl + 1, g, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' order by pos)) from nodes where n > 1 group by lvl, g, pos // 8),
subroots as (select g, digest from nodes where n = 1),
tops as (select 0 as lvl, g as pos, (select count(*) from subroots) as n, digest from subroots
         union all
         select lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' order by pos)) from tops where n > 1 group by lvl, pos // 8),
sib as (select lvl, g, pos, coalesce(string_agg(digest, '') over (run rows between unbounded preceding and 1 preceding), '') as before,
               coalesce(string_agg(digest, '') over (run rows between 1 following and unbounded following), '') as after
        from nodes where n > 1 window run as (partition by lvl, g, pos // 8 order by pos)),
top_sib as (select lvl, pos, coalesce(string_agg(digest, '') over (run rows between unbounded preceding and 1 preceding), '') as before,
                   coalesce(string_agg(digest, '') over (run rows between 1 following and unbounded following), '') as after
            from tops where n > 1 window run as (partition by lvl, pos // 8 order by pos)),
fold as (select r, 0 as lvl, g, pos, start as digest, '' as proof from placed
         union all
         select r, f.lvl + 1, f.g, f.pos // 8, sha256(before || digest || after), proof || before || after
         from fold f join sib s on s.lvl = f.lvl and s.g = f.g and s.pos = f.pos),
up as (select r, g, arg_max(digest, lvl) as digest, arg_max(proof, lvl) as proof from fold group by r, g),
top_fold as (select r, 0 as lvl, g as pos, digest, proof from up
             union all
             select r, f.lvl + 1, f.pos // 8, sha256(before || digest || after), proof || before || after
             from top_fold f join top_sib s on s.lvl = f.lvl and s.pos = f.pos),
ends as (select r, arg_max(digest, lvl) as digest, arg_max(proof, lvl) as proof from top_fold group by r)
select p.doc_id, p.leaf, s.digest as subroot, t.digest as root, sha256(e.proof) as proof_sha256, e.digest as folded_root, e.digest = t.digest as verified
from placed p join ends e using (r) join subroots s using (g), (select digest from tops where n = 1) t
"""
