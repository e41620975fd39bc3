"""SQL for the queries that SQL can express."""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = "d as (select doc_id, source, coalesce(text, '') t from documents), u as (select doc_id, source, t, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) i from d)"

OP5 = f"""with {_LINES}, k as (select *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from u),
over as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
m as (select k.*, o.key is not null as gone from k left join over o on o.key = k.key)
select doc_id, count(*) n_lines, count(*) filter (where gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256 from m group by doc_id"""

OP6 = f"""with {_LINES}, w as (select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') w from d),
x as (select doc_id, unnest(range(1, greatest(1, len(w) - 1))) i, w from w), y as (select doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] k from x),
z as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) n from y) where n > 1),
r as (select doc_id, sum(c) n from (select doc_id, least(3, coalesce(lead(i) over (partition by doc_id order by i) - i, 3)) c from z) group by 1),
b as (select doc_id, len(w) n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols from w),
dl as (select doc_id, count(*) - count(distinct line) n from u where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1),
k as (select doc_id, source, md5(t) th, lower(trim(line, {_SPACE})) as key from u),
h as (select source, count(distinct md5(t)) n from d group by 1),
f as (select k.source, key from k join h on h.source is not distinct from k.source where key <> '' group by 1, 2 having count(distinct th) > 10 and count(distinct th) > 0.05::double * max(h.n)),
g as (select k.doc_id, sum(length(k.key)) n, sum(len(regexp_extract_all(k.key, '[^\\x20\\x09-\\x0D]+'))) w from k join f on f.key = k.key and f.source is not distinct from k.source group by 1)
select b.doc_id, cast(b.n_words as bigint) n_words, cast(b.word_chars as bigint) word_chars, b.n_symbols, coalesce(dl.n, 0) n_dup_lines, cast(coalesce(r.n, 0) as bigint) n_repeat_words,
(b.n_words < 50 or 100 * coalesce(r.n, 0) > 50 * b.n_words) base_failed, cast(coalesce(g.n, 0) as bigint) n_line_chars, cast(coalesce(g.w, 0) as bigint) n_line_words,
not (b.n_words < 50 or 100 * coalesce(r.n, 0) > 50 * b.n_words) and not (length(d.t) - coalesce(g.n, 0) < 0.2::double * length(d.t) or b.n_words - coalesce(g.w, 0) < 50) kept
from b join d using (doc_id) left join r using (doc_id) left join dl using (doc_id) left join g using (doc_id)"""

ORACLE_SQL = {"op5_line_dedup": OP5, "op6_quality_rules": OP6}
