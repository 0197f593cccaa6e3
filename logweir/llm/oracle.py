"""DuckDB SQL for the queries whose results SQL can state: every pair is compared, and links are followed to their ends."""

from __future__ import annotations

_REACH = """reach as (select x, x as y from nodes union select r.x, l.y from reach r join links l on r.y = l.x)"""

VECTOR_GROUPS = f"""with recursive
fine as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
links as (select a.vec_id x, b.vec_id y from fine a join fine b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
nodes as (select vec_id x from embeddings),
{_REACH}
select v.vec_id, coalesce(n.n_links, 0) n_links, g.component_id, v.vec_id = g.component_id kept from embeddings v
join (select x, min(y) component_id from reach group by x) g on g.x = v.vec_id left join (select x, count(*) n_links from links group by x) n on n.x = v.vec_id"""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

TEXT_GROUPS = f"""with recursive
worded as (select doc_id, {_WORDS} w from documents),
texts as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end g from worded),
runs as (select doc_id, unnest(g) run from texts),
common as (select a.doc_id x, b.doc_id y, count(*) n from runs a join runs b on a.run = b.run and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from common join texts a on a.doc_id = x join texts b on b.doc_id = y where n >= 0.8 * (len(a.g) + len(b.g) - n) - 1e-9),
nodes as (select doc_id x from documents),
{_REACH},
classes as (select doc_id, case when len(g) = 0 then doc_id else min(doc_id) over (partition by md5(array_to_string(list_sort(g), '|'))) end class_id from texts)
select c.doc_id, c.class_id, r.group_id, coalesce(n.n_links, 0) n_links, c.doc_id = r.group_id kept from classes c
join (select x, min(y) group_id from reach group by x) r on r.x = c.doc_id left join (select x, count(*) n_links from links group by x) n on n.x = c.doc_id"""

_DRAW = "cast('0x' || substr(h, {at}, 8) as bigint)"

FILL_IN_MIDDLE = f"""with texts as (select doc_id, coalesce(text, '') t, sha256('7:' || cast(doc_id as varchar)) h from documents),
lined as (select *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') u from texts),
drawn as (select *, len(u) n, {_DRAW.format(at=1)} % (len(u) + 1) c1, {_DRAW.format(at=9)} % (len(u) + 1) c2,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or {_DRAW.format(at=17)} % 100 >= 100 then 'plain'
    when {_DRAW.format(at=25)} % 100 < 50 then 'spm' else 'psm' end form from lined),
parts as (select *, array_to_string(u[1:least(c1, c2)], '') p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') m,
  array_to_string(u[greatest(c1, c2) + 1:], '') s from drawn)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
  sha256(t) restored_sha256 from parts"""

COLLOCATIONS = r"""with texts as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
cut as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p from texts),
pieces as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda w: w <> '') w from cut),
spots as (select lang, w, unnest(range(1, len(w) + 1)) i from pieces),
runs as (select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase from spots, (values (1), (2), (3)) t(k) where i + k - 1 <= len(w)),
f as (select lang, k, phrase, count(*) a from runs group by all),
totals as (select lang, sum(a)::bigint n from f where k = 1 group by 1),
several as (select *, string_split(phrase, ' ') w from f where k > 1 and a >= 10),
longer as (select lang, unnest([array_to_string(w[:-2], ' '), array_to_string(w[2:], ' ')]) phrase, a from several where k = 3),
most as (select lang, phrase, max(a) most from longer group by 1, 2),
free as (select s.* from several s left join most m on m.lang = s.lang and m.phrase = s.phrase where most is null or 100 * most < 50 * a),
cuts as (select *, array_to_string(w[:c], ' ') x, array_to_string(w[c + 1:], ' ') y from free, (values (1), (2)) t(c) where c < k),
scored as (select c.lang, c.phrase, c.c, c.a, x.a l, y.a r, cast((1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a) as bigint) score from cuts c
  join f x on x.lang = c.lang and x.phrase = c.x join f y on y.lang = c.lang and y.phrase = c.y),
least as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from least)
select r.lang, rank, phrase, a, l, r, n, score from ranked r join totals t on t.lang = r.lang where rank <= 2000"""
