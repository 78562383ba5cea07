"""SQL (DuckDB) for the queries that SQL can express."""

_SPLIT = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP3 = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select * from (values (-1::bigint, 0::bigint, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e as (select *, length(role) + length(text) + 24 + length(text) - length(replace(text, '\', ''))
 + len(regexp_extract_all(text, '<\|(im_start|im_end|mask|endoftext|user|assistant|system)\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) as chars from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
 coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from e group by conv_id"""

OP4 = f"""
with d as (select doc_id, {_SPLIT.format(text="coalesce(text, '')")} as w from documents),
t as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i, len(w) as n from d),
g as (select *, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 19 following) as win from t),
r as (select *, i + 20 <= n and row_number() over (partition by win, i + 20 <= n order by doc_id, i) > 1 as late from g),
c as (select *, coalesce(max(late::int) over (partition by doc_id order by i rows between 19 preceding and current row), 0) = 1 as gone from r),
k as (select doc_id, sum(gone::int)::bigint as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from c group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = f"""
with recursive d as (select doc_id, {_SPLIT.format(text=_LOWER)} as w from documents),
t as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i, len(w) as n from d),
g as (select doc_id, n, i, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 2 following) as gram from t),
s as materialized (select distinct doc_id, gram from g where i + 3 <= n or (n < 3 and i = 0)),
z as materialized (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both_have from s a join s b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select a, b from p join z x on x.doc_id = a join z y on y.doc_id = b where 100 * both_have >= 90 * (x.n + y.n - both_have)),
e as materialized (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as here from d union select r.doc_id, e.b from r join e on e.a = r.here)
select doc_id, coalesce(any_value(z.n), 0)::bigint as n_shingles, min(here) as component_id from r left join z using (doc_id) group by doc_id"""

OP10 = f"""
with d as (select doc_id, source, coalesce(len({_SPLIT.format(text="text")}), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as k from d group by source),
w as (select *, ([1.0, 2.0, 3.0][k % 3 + 1])::double as weight, source_size * 3.0::double as cap, sum(source_size) over () as total from s),
o as (select *, row_number() over r as place, coalesce(sum(cap) over (r rows between unbounded preceding and 1 preceding), 0) as capped,
 sum(weight) over (r rows between current row and unbounded following) as open from w window r as (order by cap / weight, source nulls last)),
v as (select *, ((total - capped)::double / open) as level from o),
q as (select *, arg_min(level, place) filter (level <= cap / weight) over () as water from v),
b as (select source, source_size, least(cap, coalesce(water * weight, cap)) as target from q),
c as (select *, least(round(target)::bigint, 3 * source_size) as budget from b),
m as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from c),
x as (select d.*, coalesce(sum(size) over (partition by source order by md5('mix:' || doc_id), doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from d)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint as taken
from x join m on x.source is not distinct from m.source"""

#: CRC-32 of the last 32 bytes goes bit by bit; the constant is the polynomial, a fixed value.
OP9 = r"""with p as (select doc_id, encode(coalesce(text, '')) as raw from documents),
 q as (select doc_id, octet_length(raw) as n, raw || repeat('\xFF'::blob, case when octet_length(raw) = 0 then 576 else (576 - octet_length(raw) % 576) % 576 end) as payload from p),
 m as (select doc_id, n, payload, octet_length(payload) as size, encode('P5' || chr(10) || '24 ' || (octet_length(payload) // 24) || chr(10) || '255' || chr(10)) || payload as stored, hex(payload) as h from q),
 b as (select doc_id, ('0x' || h[2 * i + 1:2 * i + 2])::int as v from (select doc_id, h, unnest(range(size)) as i from m)),
 f as (select doc_id, avg(v) as mean, stddev_pop(v) as dev, avg((v < 64)::int) as a, avg((v between 64 and 127)::int) as b, avg((v between 128 and 191)::int) as c, avg((v >= 192)::int) as d from b group by doc_id)
select doc_id, cast(n as bigint) as n_bytes, cast(size as bigint) as payload_bytes, sha256(payload) as payload_sha256,
 cast(xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(32), lambda i: ('0x' || h[2 * (size - 32 + i) + 1:2 * (size - 32 + i) + 2])::bigint)),
 lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, t: case when s % 2 = 1 then xor(s >> 1, 3988292384) else s >> 1 end))) as bigint) as tail_crc32,
 cast(octet_length(stored) as bigint) as media_bytes, sha256(stored) as media_sha256,
 '24x' || (size // 24) || printf(';mean=%.4f;std=%.4f;%.4f,%.4f,%.4f,%.4f', mean, dev, a, b, c, d) as feature, 1 as position, 'payload of ' || n || ' bytes' as caption from m join f using (doc_id)"""
