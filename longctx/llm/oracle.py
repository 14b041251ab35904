"""SQL of registered training-data queries, for the database that checks them."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_steps() -> str:
    """Table of the CRC register after one byte, from its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [(v >> 1) ^ (0xEDB88320 if v & 1 else 0) for v in table]
    return "[" + ",".join(map(str, table)) + "]::bigint[]"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; needs a column ``tab`` with ``_crc_steps``."""
    octets = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda p: ('0x' || p)::bigint)"
    step = "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), {step}), 4294967295)"


def _base32(hexed: str) -> str:
    """Upper-case base32 of 40 hex digits: five digits are four characters."""
    pick = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((v >> {0}) & 31 as integer) + 1, 1)"
    four = " || ".join(pick.format(s) for s in (15, 10, 5, 0))
    values = f"list_transform(range(8), lambda j: ('0x' || substr({hexed}, cast(5 * j + 1 as integer), 5))::bigint)"
    return f"array_to_string(list_transform({values}, lambda v: {four}), '')"


OP8 = f"""
with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
g as (select *, max(page_id) over (partition by h, payload_bytes) as last from p)
select page_id, payload_bytes, {_base32('h')} as payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type,
       case when page_id <> last then last end as refers_to, true as valid, cast(null as varchar) as error
from g"""

OP10 = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')] else
             list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as g from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as m from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where 100 * m >= 75 * (p.n + q.n - m)),
edge as (select x, y from link union all select y, x from link),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, e.y from reach r join edge e on e.x = r.other),
comp as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join comp c using (doc_id) left join n using (doc_id)"""

OP11 = f"""
with tab as (select {_crc_steps()} as tab),
every as (select 0 as side, doc_id, text from documents union all select 1, item_id, text from benchmark),
w as (select side, doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from every),
f as (select side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as g from w),
crc as (select g, {_crc32('g')} % 10000 as bucket from (select distinct g from f) cross join tab),
b as (select side, doc_id, bucket from f join crc using (g)),
size as (select coalesce(sum((side = 0)::int), 0) as s_all, coalesce(sum((side = 1)::int), 0) as t_all from b),
per as (select bucket, sum((side = 0)::int) as s, sum((side = 1)::int) as t from b group by bucket),
gain as (select bucket, cast(floor(1000 * ln((t + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000)))) as bigint) as gain
         from per cross join size),
mine as (select doc_id, count(*) as n_features, cast(sum(gain) as bigint) as total from b join gain using (bucket) where side = 0 group by doc_id),
scored as (
  select w.doc_id, coalesce(n_features, 0) as n_features, len(w.w) as n_words,
         coalesce(case when total >= 0 then total // n_features else -((n_features - total - 1) // n_features) end, 0) as weight,
         cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))) as bigint) as noise
  from w left join mine using (doc_id) where side = 0),
ranked as (select doc_id, row_number() over (order by weight + noise desc, doc_id) as rank,
                  25 * count(*) over () // 100 as drawn from scored where n_words >= 20)
select s.doc_id, n_features, weight, weight + noise as score, case when rank <= drawn then rank end as rank, n_words
from scored s left join ranked using (doc_id)"""


def _next(capacity: str) -> str:
    """End of the shard that begins at byte ``pos``: as far as the capacity goes, at least one group."""
    return (f"coalesce(list_max(list_filter(ends, lambda e: e > pos and e <= pos + {capacity})), "
            f"list_min(list_filter(ends, lambda e: e > pos)))")


OP12 = f"""
with recursive tab as (select {_crc_steps()} as tab),
d as (select doc_id, coalesce(text, '') as body, ('0x' || substr(md5(coalesce(text, '')), 1, 16))::ubigint >> 1 as key,
             cast(strlen(coalesce(text, '')) + 8 as bigint) as size from documents),
g as (select key, cast(sum(size) as bigint) as bytes from d group by key),
e as (select key, bytes, cast(sum(bytes) over (order by key) as bigint) as stop from g),
all_ends as (select list(stop order by stop) as ends, max(stop) as total from e),
find as (
  select cast(0 as bigint) as lo, total as hi, cast(0 as bigint) as pos, 0 as k, ends, total from all_ends
  union all
  select case when nxt < total and k = 23 then mid + 1 else lo end, case when nxt = total then mid else hi end,
         case when nxt = total or k = 23 then 0 else nxt end, case when nxt = total or k = 23 then 0 else k + 1 end, ends, total
  from (select *, (lo + hi) // 2 as mid, {_next('(lo + hi) // 2')} as nxt from find where lo < hi)),
best as (select lo as capacity, ends, total from find where lo = hi),
cut as (
  select cast(0 as bigint) as pos, 0 as k, capacity, ends, total from best
  union all
  select {_next('capacity')}, k + 1, capacity, ends, total from cut where pos < total and k < 24),
shards as (select key, cast((select count(*) from cut where k > 0 and pos <= e.stop - e.bytes) as integer) as shard from e)
select doc_id, size, {_crc32('body')} as text_crc32, 'bytes' as law, shard,
       row_number() over (partition by shard order by doc_id, key) - 1 as slot, cast(null as integer) as grown_shard
from d join shards using (key) cross join tab"""

ORACLE = {"op8_warc": OP8, "op10_minhash": OP10, "op11_importance_resampling": OP11, "op12_sharding": OP12}
