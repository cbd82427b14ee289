"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from docketry.llm.secrets import BASE, RULES, Rule

#: Words of a lower-cased text for contamination; ids of one row's text positions from 1.
OP4 = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select coalesce(cast(item_id as varchar), '') as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
wins as (
  select distinct item, array_to_string(w[i:i + 12], ' ') as win, len(w[i:i + 12]) as n
  from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from wins),
spots as (
  select r, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n),
hits as (
  select r, p, wins.n, item from spots join wins on wins.n = spots.n and wins.win = array_to_string(w[p:p + spots.n - 1], ' ')),
hit_words as (
  select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from hits) group by r),
hit_items as (
  select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit_words using (r) left join hit_items using (r)
"""

OP10 = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
g as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select r, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
rep as (
  select r, count(distinct q) as n from (
    select r, unnest(range(i, i + 3)) as q from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1)
  group by r),
l as (
  select r, count(*) as n_lines, count(*) - count(distinct x) as n_dup
  from (select r, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by r),
m as (
  select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
         coalesce(n_lines, 0) as n_lines
  from d left join rep using (r) left join l using (r)),
f as (
  select *, (case when n_words < 50 then 1 else 0 end) + (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end)
    + (case when 10 * n_symbols > 3 * n_words then 4 else 0 end)
    + (case when n_dup_lines >= 3 and 100 * n_dup_lines > 50 * n_lines then 8 else 0 end)
    + (case when n_words > 0 and (word_chars < 2 * n_words or word_chars > 40 * n_words) then 16 else 0 end) as fail_bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept,
       cast(fail_bits as bigint) as fail_bits
from f
"""

OP8 = r"""
with l as (
  select doc_id, i, lines[i] as x, lead(lines[i], 1) over w as y, lead(lines[i], 2) over w as z
  from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split(text, chr(10)) as lines from documents))
  window w as (partition by doc_id order by i)),
s as (
  select doc_id, i, row_number() over (partition by x, y, z order by doc_id, i) as copy from l where z is not null),
gone as (select distinct doc_id, unnest(range(i, i + 3)) as i from s where copy > 1),
runs as (
  select doc_id, count(*) as n_removed, count(*) filter (fresh) as n_runs
  from (select doc_id, i - coalesce(lag(i) over (partition by doc_id order by i), -9) > 1 as fresh from gone) group by doc_id),
kept as (
  select doc_id, string_agg(x, chr(10) order by i) as t from (select doc_id, i, x from l) anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, cast(coalesce(len(string_split(text, chr(10))), 0) as bigint) as n_lines, coalesce(n_removed, 0) as n_removed,
       coalesce(n_runs, 0) as n_runs, sha256(coalesce(t, '')) as kept_sha256
from documents d left join runs using (doc_id) left join kept using (doc_id)
"""


def _kind(number: int, rule: Rule) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  select r, {number} as k, '{rule.kind}' as kind, upto - length(m) as s, upto as e from (
    select r, m, g, sum(length(gap) + coalesce(length(m), 0)) over (partition by r order by i) as upto from (
      select r, i, gaps[i] as gap, ms[i] as m, gs[i] as g from (
        select r, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}') as ms, regexp_extract_all(t, '{p}', {rule.group}) as gs,
               unnest(range(1, len(gaps) + 1)) as i
        from d where regexp_matches(t, '{p}'))))
  where m is not null and length(g) >= {rule.least}"""


OP2 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
f as ({" union all ".join(_kind(i, rule) for i, rule in enumerate(RULES))}),
a as (
  select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < {BASE}) as base,
         string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans
  from (select r, k, kind, cast(s as bigint) as s, cast(e as bigint) as e from f) group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (r)
"""

OP3 = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1) as bigint) as formatted_chars
from t group by conv_id
"""


OP11 = r"""
with recursive tab as (
  select list(list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i) order by i) as t
  from range(256) r(i)),
runs as (
  select id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as c
  from (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]{6,}')) as x from documents)
  group by all),
bytes as (select run, c, hex(encode(id || ':' || run)) as h from runs),
crc as (
  select run, c, xor(4294967295, list_reduce([cast('0x' || substr(h, 2 * i + 1, 2) as bigint) for i in range(length(h) // 2)],
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), cast(4294967295 as bigint))) as h
  from bytes, tab),
made as (
  select case when h % 199 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from crc),
w as (select word, cast(sum(c) as bigint) as n from made where length(word) >= 6 group by word having sum(c) >= 5),
cuts as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
longer as (select distinct c.word as long, c.n as long_n, w.word as short, w.n as short_n from cuts c join w on w.word = c.rest),
near as (
  select a.word, b.word as other, b.n as m from cuts a join cuts b on a.rest = b.rest and a.i = b.i and length(a.word) = length(b.word) and a.word <> b.word
  union all select long, short, short_n from longer
  union all select short, long, long_n from longer),
best as (select word, count(*) as n_near, max(m) as m from near group by word),
form as (select b.word, b.n_near, b.m, min(other) as other from best b join near x on x.word = b.word and x.m = b.m group by all),
rated as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 5 * w.n then other end as form, case when m >= 5 * w.n then m end as form_n from w left join form using (word)),
chain as (
  select word, form as at, 1 as steps from rated where form is not null
  union all select c.word, r.form, steps + 1 from chain c join rated r on r.word = c.at where r.form is not null)
select r.word, r.form, coalesce(max_by(c.at, c.steps), r.word) as root, r.n, r.n_near, r.form_n
from rated r left join chain c using (word) group by r.word, r.form, r.n, r.n_near, r.form_n
"""

OP12 = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
ws as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from ws group by lang),
grams as (select lang, k, unnest([w[i : i + k - 1] for i in range(1, len(w) - k + 2)]) as g from ws, range(1, 5) r(k)),
f as (select lang, k, g, count(*) as f from grams group by all having count(*) >= 30),
scored as (
  select a.lang, a.k, a.g, a.f as a, j, l.f as l, r.f as r, cast(2000000 * cast(a.f as hugeint) // (l.f + r.f) as bigint) as score
  from (select *, unnest(range(1, k)) as j from f where k > 1) a
  join f l on l.lang = a.lang and l.g = a.g[1 : j] join f r on r.lang = a.lang and r.g = a.g[j + 1 : a.k]),
best as (select * from scored qualify row_number() over (partition by lang, g order by score, j) = 1),
inner_parts as (
  select distinct lang, a, g[i : i + m - 1] as g from (select lang, k, g, f as a, m, unnest(range(1, k - m + 2)) as i from f, range(2, 4) r(m) where m < k)),
held as (select lang, g, max(a) as longer from inner_parts group by all)
select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank, array_to_string(g, ' ') as phrase, a, l, r, n, score
from best join totals using (lang) left join held using (lang, g)
where coalesce(100 * longer < 80 * a, true)
qualify rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": OP2, "op3_chat": OP3, "op4_decontamination": OP4, "op8_line_dedup": OP8, "op10_quality": OP10, "op11_spelling_variants": OP11, "op12_collocations": OP12}
