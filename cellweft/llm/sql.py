"""DuckDB SQL of operators whose results brute force can give on the small tables."""

from __future__ import annotations

#: Smallest node reachable over e(a, b), for every end of an edge.
_REACH = "reach(node, other) as (select a, a from (select a from e union select b from e) union select r.node, u.b from reach r join (select a, b from e union select b, a from e) u on u.a = r.other), comp as (select node, min(other) component_id from reach group by node)"

SQL_OP3 = f"""
with recursive v as (
    select vec_id, embedding::double[] x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
e as (select p.vec_id a, q.vec_id b from v p join v q on p.vec_id < q.vec_id and len(p.x) = len(q.x) where list_cosine_similarity(p.x, q.x) >= 0.9),
n as (select id, count(*) n from (select a id from e union all select b from e) group by 1),
{_REACH}
select vec_id, coalesce(n, 0)::bigint n_links, coalesce(component_id, vec_id) component_id, vec_id = coalesce(component_id, vec_id) kept
from embeddings left join n on id = vec_id left join comp on node = vec_id
"""

SQL_OP8 = """
with d as (select doc_id, octet_length(encode(coalesce(text, ''))) n, encode(coalesce(text, '')) h from documents),
w as (select doc_id, unnest(range(0, n - 49)) i, h[i + 1:i + 50] s from d where n >= 50),
f as (select s, min(doc_id) m from w group by s having count(distinct doc_id) > 1),
hit as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 50, true) fresh from w join f using (s) where m < doc_id),
run as (select doc_id, min(i) a, max(i) + 50 b from (select *, sum(fresh::int) over (partition by doc_id order by i) k from hit) group by doc_id, k),
gap as (select doc_id, a, coalesce(lag(b) over (partition by doc_id order by a), 0) p from run union all select doc_id, n, max(b) from run join d using (doc_id) group by doc_id, n),
kept as (select doc_id, unhex(string_agg(hex(h[p + 1:a]), '' order by a)) t from gap join d using (doc_id) group by doc_id),
sums as (select doc_id, sum(b - a) r, count(*) k from run group by doc_id)
select doc_id, n::bigint n_bytes, coalesce(r, 0)::bigint n_removed, coalesce(k, 0)::bigint n_spans, sha256(coalesce(t, h)) kept_sha256
from d left join kept using (doc_id) left join sums using (doc_id)
"""

SQL_OP10 = rf"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from w where len(w) > 0),
c as (select doc_id, count(*) n, md5(string_agg(md5(g), '' order by g)) k from s group by doc_id),
cls as (select k, min(doc_id) id, count(*) weight, any_value(n) n from c group by k),
t as (select id, n, g from cls join s on s.doc_id = id),
p as (select x.id a, y.id b, x.n na, y.n nb, count(*) shared from t x join t y using (g) where x.id < y.id and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) group by all),
e as (select a, b from p where 5 * shared >= 4 * (na + nb - shared)),
m as (select z.x, sum(weight) n from (select a x, b o from e union all select b, a from e) z join cls on cls.id = z.o group by 1),
{_REACH}
select doc_id, coalesce(cls.id, doc_id) class_id, coalesce(weight - 1 + coalesce(m.n, 0), 0)::bigint n_links, coalesce(component_id, cls.id, doc_id) component_id,
    coalesce(component_id, cls.id, doc_id) = doc_id kept
from documents left join c using (doc_id) left join cls using (k) left join m on m.x = cls.id left join comp on node = cls.id
"""


def _add(state: str, cost: str, edit: str) -> str:
    """A state (cost in twelve digits, then the edits, so that text order is the order of cost and edits) after one more edit."""
    return f"lpad((substr({state}, 1, 12)::bigint + {cost})::varchar, 12, '0') || substr({state}, 13) || '{edit}'"


def _op12() -> str:
    """The search as a pass over each conversation's rows that keeps the best of each state; states: nothing yet, after s, u and a."""
    insert = lambda q: _add(f"s{q}", "3", "I")
    closed = "select {keep}, s0, s1, least(s2, " + ", ".join(insert(q) for q in (0, 1, 3)) + ") s2, s3 from ({rows})"
    closed = "select {keep}, s0, s1, s2, least(s3, " + insert(2) + ") s3 from (" + closed + ")"
    twice = closed.format(keep="{keep}", rows=closed)
    drop = lambda q: _add(f"s{q}", "4", "D")
    stay = lambda q, initial: f"case when fault < 2 and initial = '{initial}' then {_add(f's{q}', '3 * fault', 'K')} end"
    turn = lambda q: f"case when fault < 2 then {_add(f's{q}', '3 + 3 * fault', 'R')} end"
    step = f"""select w.conv_id, p.i + 1 i, {drop(0)} s0, least({drop(1)}, {stay(0, "s")}) s1,
        least({drop(2)}, {", ".join(f"{stay(q, 'u')}, {turn(q)}" for q in (0, 1, 3))}) s2, least({drop(3)}, {stay(2, "a")}, {turn(2)}) s3
        from p join w on w.conv_id = p.conv_id and w.i = p.i + 1"""
    start = "select conv_id, 0::bigint i, '000000000000' s0, null::varchar s1, null::varchar s2, null::varchar s3 from ids"
    return f"""
with recursive tab as (select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
k as (select coalesce(conv_id, -1) conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') x, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') key from conversations),
c as (select k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda h: ascii(h)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 f from k, tab),
d as (select conv_id, turn, case when f = 4 then 'user' else role end role, case when f = 1 then '' when f = 2 then regexp_replace(x, '[.!?]', '', 'g') else x end x, unnest(range(case when f = 0 then 0 when f = 3 then 2 else 1 end)) copy from c),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(x), copy) i, rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) core from d),
w as (select *, role[1] initial, case when core = '' then 2 when row_number() over (partition by conv_id, role, x order by i) > 1 then 3 when core[-1] in ('.', '!', '?') then 0 else 1 end fault,
    lag(role[1]) over (partition by conv_id order by i) || role[1] pair from o),
ids as (select distinct conv_id from k),
n as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) gaps, count(*) filter (fault = 2) blank, count(*) filter (fault = 3) dup, count(*) filter (fault = 1) trunc, count(*) filter (pair not in ('su', 'ua', 'au')) illegal, max(i) last from w group by 1),
p as ({twice.format(keep="conv_id, i", rows=start)} union all {twice.format(keep="conv_id, i", rows=step)}),
best as (select conv_id, least(s0, s3) s from p join n using (conv_id) where i = last),
cut as (select conv_id, s, unnest(range(13, length(s) + 1)) pos from best),
edit as (select conv_id, pos, s[pos] edit, count(*) filter (s[pos] <> 'I') over (partition by conv_id order by pos) i from cut),
kept as (select edit.conv_id, pos, edit, role, x, row_number() over (partition by edit.conv_id order by pos) e from edit left join w on w.conv_id = edit.conv_id and w.i = edit.i and edit <> 'I' where edit <> 'D'),
said as (select *, (first_value(edit = 'K' and role[1] = 's') over (partition by conv_id order by pos))::int lead from kept),
line as (select conv_id, pos, case when edit = 'K' then role when (e - lead) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(x, '') line from said),
fixed as (select conv_id, sha256(string_agg(line, chr(10) order by pos)) h from line group by 1)
select nullif(conv_id, -1) conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(dup, 0)::bigint duplicate, coalesce(trunc, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal,
    coalesce(substr(s, 1, 12)::bigint, 0) cost, coalesce(substr(s, 13), '') audit, coalesce(h, sha256('')) repaired_sha256
from ids left join n using (conv_id) left join best using (conv_id) left join fixed using (conv_id)
"""


SQL_OP12 = _op12()
