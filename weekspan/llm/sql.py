"""DuckDB SQL for the queries that SQL can express, written from their contracts."""

#: Table of CRC-32 (reflected polynomial 0xEDB88320) by rule.
CRC_TABLE = """crc_table as materialized (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as entries
  from (select unnest(range(256)) as i)
)"""


def bytes_of(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: cast('0x' || x as bigint))"


def crc_of(bytes_list: str) -> str:
    """CRC-32 of a list of bytes, for a query that has ``crc_table`` in its from clause."""
    return f"xor(list_reduce([4294967295] || {bytes_list}, lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1])), 4294967295)"


OP9 = f"""
with {CRC_TABLE},
rows_in as materialized (
  select doc_id, strlen(coalesce(text, '')) + 1 as size, {bytes_of("coalesce(text, '')")} as body,
    case when source is null then '0' else '1' || source end as stratum,
    md5('interleave-1:' || coalesce(cast(doc_id as varchar), 'null')) as draw
  from documents
),
summed as (select doc_id, size, {crc_of("body")} as text_crc32, stratum, draw from rows_in, crc_table),
ranked as (
  select *, row_number() over (partition by stratum order by draw, doc_id nulls first, text_crc32, size) - 1 as rank_in,
    count(*) over (partition by stratum) as n_in
  from summed
),
placed as (
  select *, row_number() over (order by cast(2 * rank_in + 1 as double) / cast(2 * n_in as double), stratum, rank_in) - 1 as place,
    count(*) over () as total
  from ranked
)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law, cast(place * 8 // total as integer) as shard,
  cast(place - ((place * 8 // total) * total + 7) // 8 as bigint) as slot, cast(null as integer) as grown_shard
from placed
"""

#: SHA-1 as base32: the hash's hexadecimal digits as bits, read five at a time.
OP4 = """
with rows_in as (select page_id, coalesce(html, '') as body from pages),
hashed as (select page_id, strlen(body) as payload_bytes, sha1(body) as digest from rows_in),
bits as (
  select *, list_reduce(list_transform(regexp_extract_all(digest, '.'), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)]), lambda a, b: a || b) as b,
    max(page_id) over (partition by digest, payload_bytes) as head
  from hashed
),
shown as (
  select *, list_reduce(list_transform(regexp_extract_all(b, '.....'), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * cast(g[1] as int) + 8 * cast(g[2] as int) + 4 * cast(g[3] as int) + 2 * cast(g[4] as int) + cast(g[5] as int), 1)), lambda a, c: a || c) as payload_digest
  from bits
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when head is null or page_id = head then 'response' else 'revisit' end as record_type,
  case when head is null or page_id = head then null else head end as refers_to
from shown
"""

OP5 = r"""
with docs as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
),
items as materialized (
  select coalesce(cast(item_id as varchar), 'null') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
),
grams as materialized (
  select distinct item, least(len(w), 10) as size, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as gram
  from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from items where len(w) > 0)
),
sizes as (select distinct size from grams),
windows as materialized (
  select r, p, size, array_to_string(w[p : p + size - 1], ' ') as gram
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as p from docs, sizes where len(w) >= size)
),
hits as materialized (select r, p, windows.size, item from windows join grams using (size, gram)),
hit_words as (select r, count(distinct q) as n from (select r, unnest(range(p, p + size)) as q from hits) group by r),
hit_items as (select r, count(distinct item) as n, array_to_string(list_sort(list(distinct item)), ',') as names from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(h.n, 0) as bigint) as n_hit, cast(coalesce(i.n, 0) as bigint) as n_items,
  sha256(coalesce(i.names, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from docs left join hit_words h using (r) left join hit_items i using (r)
"""

OP10 = """
with recursive rows_in as materialized (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
),
sound as materialized (
  select r, vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u
  from rows_in where label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
),
links as materialized (
  select a.r as a, b.r as b from sound a join sound b on a.label = b.label and len(a.u) = len(b.u) and a.r <> b.r and list_inner_product(a.u, b.u) >= 0.98
),
reach(r, s) as (select r, r from rows_in union select reach.r, links.b from reach join links on reach.s = links.a),
parts as (select reach.r, min(other.vec_id) as component_id from reach join rows_in other on reach.s = other.r group by reach.r),
degrees as (select a as r, count(*) as n from links group by a)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from rows_in join parts using (r) left join degrees using (r)
"""

OP8 = r"""
with docs as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
),
windows as materialized (
  select r, coalesce(doc_id, 9223372036854775807) as d, p, md5(array_to_string(w[p : p + 12], ' ')) as gram
  from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as p from docs where len(w) >= 13)
),
firsts as materialized (select gram, min(d) as d from windows group by gram),
gone as (
  select distinct r, q from (select r, unnest(range(p, p + 13)) as q from windows join firsts using (gram) where windows.d > firsts.d)
),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as q from docs),
kept as (
  select words.r, string_agg(word, ' ' order by words.q) filter (gone.q is null) as body, count(gone.q) as n_removed
  from words left join gone on words.r = gone.r and words.q = gone.q group by words.r
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(body, '')) as kept_sha256
from docs left join kept using (r)
"""

OP3 = r"""
with recursive docs as materialized (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
),
grams as materialized (
  select distinct r, md5(array_to_string(w[p : p + 4], ' ')) as gram
  from (select r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from docs where len(w) > 0)
),
sizes as materialized (select r, count(*) as n from grams group by r),
common as (select a.r as a, b.r as b, count(*) as n from grams a join grams b on a.gram = b.gram and a.r <> b.r group by a.r, b.r),
links as materialized (
  select a, b from common join sizes x on a = x.r join sizes y on b = y.r where 5 * common.n >= 4 * (x.n + y.n - common.n)
),
reach(r, s) as (select r, r from docs union select reach.r, links.b from reach join links on reach.s = links.a),
classes as (select reach.r, min(other.doc_id) as class_id from reach join docs other on reach.s = other.r group by reach.r),
degrees as (select a as r, count(*) as n from links group by a)
select doc_id, class_id, cast(coalesce(n, 0) as bigint) as n_links from docs join classes using (r) left join degrees using (r)
"""

OP11 = """
with rows_in as materialized (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as materialized (
  select a.r as anchor, a.vec_id as anchor_id, b.r, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from rows_in a join rows_in b on a.vec_id % 100 = 0 and a.r <> b.r and len(a.v) = len(b.v)
),
positives as materialized (
  select * from scored where same qualify row_number() over (partition by anchor order by score desc, vec_id nulls last, r) <= 5
),
hits as (
  select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.anchor, p.r order by n.score desc, n.vec_id nulls last, n.r) as rank,
    n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
  from positives p join scored n on p.anchor = n.anchor and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from hits where rank <= 10
"""

OP12 = r"""
with recursive docs as materialized (
  select row_number() over () as r, doc_id, coalesce(source, '') as part, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    min(doc_id) over (partition by coalesce(text, '')) as first
  from documents
),
failing as materialized (
  select r, doc_id, part, unnest(['A', 'B', 'C', 'D', 'E']) as f,
    unnest([len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body), regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > first, false)]) as fails
  from docs
),
marks as (select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic from labels where doc_id is not null group by doc_id),
sets as materialized (select r, doc_id, part, coalesce(string_agg(f, '' order by f) filter (fails), '') as failed from failing group by r, doc_id, part),
kinds as materialized (
  select part, failed, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic
  from sets left join marks using (doc_id) group by part, failed
),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
orders(o) as (select c from letters union all select o || c from orders, letters where not contains(o, c)),
steps as (select o as filter_order, unnest(range(1, 6)) as step from orders where length(o) = 5),
cells as materialized (
  select part, filter_order, cast(step as int) as step, substr(filter_order, step, 1) as f,
    sum(n) filter (length(translate(substr(filter_order, 1, step), failed, '')) = step) as kept,
    sum(n) filter (contains(failed, substr(filter_order, step, 1)) and length(translate(substr(filter_order, 1, step - 1), failed, '')) = step - 1) as removed,
    sum(n) filter (contains(failed, substr(filter_order, step, 1)) and length(translate(substr(filter_order, 1, step - 1), failed, '')) < step - 1) as redundant,
    sum(n) filter (failed = substr(filter_order, step, 1)) as unique_fails,
    sum(n_good) filter (contains(failed, substr(filter_order, step, 1)) and length(translate(substr(filter_order, 1, step - 1), failed, '')) = step - 1) as good_lost,
    sum(n_toxic) filter (contains(failed, substr(filter_order, step, 1)) and length(translate(substr(filter_order, 1, step - 1), failed, '')) = step - 1) as toxic_lost
  from kinds, steps group by part, filter_order, step
)
select part, filter_order, step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
  cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
  cast(coalesce(sum(removed) over (partition by part, f), 0) as bigint) as shapley
from cells
"""

ORACLES: dict[str, str] = {"op3_jaccard": OP3, "op4_warc": OP4, "op5_decontamination": OP5, "op8_substrings": OP8, "op9_sharding": OP9, "op10_embeddings": OP10, "op11_negatives": OP11, "op12_filters": OP12}
