"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from .sharding import DIGITS, Feistel

WORDS = r"[^\x20\x09-\x0D]+"

#: The CRC-32 of the sixteen half bytes (polynomial EDB88320, reflected).
HALF_BYTES = "0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108"


def feistel_sql(seed: int, source: str) -> str:
    """One walk of the permutation over ``source`` (num, x, n, half): num, x after it, n and half. In 128-bit numbers."""
    word = "18446744073709551615::uhugeint"
    sql = f"select num, n, half, x >> half as l, x & ((1::uhugeint << half) - 1) as r from {source}"
    for key in Feistel(2, seed).keys.tolist():
        sql = f"select *, (xor(r, {key}::uhugeint) * {0x9E3779B97F4A7C15}::uhugeint) & {word} as a from ({sql})"
        sql = f"select *, (xor(a, a >> 29) * {0xBF58476D1CE4E5B9}::uhugeint) & {word} as b from ({sql})"
        sql = f"select num, n, half, r as l, xor(l, xor(b, b >> 32) & ((1::uhugeint << half) - 1)) as r from ({sql})"
    return f"select num, (l << half) | r as x, n, half from ({sql})"


ORACLE_SQL: dict[str, str] = {
    "op2_sharding": rf"""
        with recursive t as (select row_number() over () as i, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        halves as (select i, list_transform(regexp_extract_all(regexp_replace(h, '(.)(.)', '\2\1', 'g'), '.'), lambda c: instr('0123456789ABCDEF', c)::ubigint - 1) as hs from t),
        crc as (select i, cast(xor(list_reduce(hs, lambda a, c: xor(([{HALF_BYTES}]::ubigint[])[cast(xor(a, c) & 15 as bigint) + 1], a >> 4::ubigint), 4294967295::ubigint), 4294967295::ubigint) as bigint) as text_crc32 from halves),
        d as (select doc_id, cast(length(h) // 2 + 8 as bigint) as size, text_crc32 from t join crc using (i)),
        k as (select *, row_number() over (order by substr(md5(concat_ws(',', doc_id::varchar, size::varchar, text_crc32::varchar)), 1, {DIGITS}), doc_id nulls first, size, text_crc32) - 1 as num from d),
        c as (select count(*)::uhugeint as n, greatest(1, (length(bin(greatest(count(*) - 1, 1))) + 1) // 2) as half from d),
        walk as (
            select num, num::uhugeint as x, n, half::uhugeint as half, false as done from k, c
            union all select num, x, n, half, x < n as done from ({feistel_sql(20240229, "walk where not done")})
        )
        select doc_id, size, text_crc32, 'rows' as law, cast(x % 24 as integer) as shard, cast(x // 24 as bigint) as slot, cast(null as integer) as grown_shard
        from k join walk using (num) where done
    """,
    "op5_repeats": rf"""
        with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') as ws from documents),
        win as (select r, doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) as h from d, unnest(range(1, len(ws) - 48)) t(i)),
        least as (select h, min(doc_id) as m from win group by h),
        gone as (select distinct r, unnest(range(i, i + 50)) as p from win join least using (h) where m < doc_id),
        word as (select r, p, ws[p] as w from d, unnest(range(1, len(ws) + 1)) t(p)),
        kept as (select r, string_agg(w, ' ' order by p) as text, count(*) as n from word anti join gone using (r, p) group by r)
        select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256
        from d left join kept using (r)
    """,
    "op7_chat": r"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
        ), e as (
            select *, replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\', '\\'), chr(10), '\n') as role_e,
                   regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as text_e from t
        ), c as (
            select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
                   coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') as loss,
                   sum(length(role_e) + length(text_e) + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10))) as chars
            from e group by conv_id
        )
        select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from c
    """,
    "op8_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) as e from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
            from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
        ), r as (
            select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
        )
        select query_id, rank, vec_id, score from r where rank <= 5
    """,
    "op9_neardup": rf"""
        with recursive d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') as ws from documents
        ), s as (
            select distinct doc_id, array_to_string(ws[i:i + 1], ' ') as g from d, unnest(range(1, greatest(len(ws), 2))) t(i) where len(ws) > 0
        ), n as (select doc_id, count(*) as n from s group by doc_id),
        common as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id > b.doc_id group by all),
        link as (select u, v from common join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)),
        both_ways as (select u, v from link union all select v, u from link),
        reach(a, b) as (select u, v from both_ways union select a, v from reach join both_ways on b = u),
        root as (select a as doc_id, min(b) as m from reach group by a)
        select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id,
               doc_id <= coalesce(m, doc_id) as kept
        from d left join n using (doc_id) left join root using (doc_id)
    """,
    "op10_decontaminate": r"""
        with d as (
            select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
        ), b as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
        ), item as (
            select item_id, least(len(ws), 10) as n, array_to_string(ws[i:i + 9], ' ') as g from b, unnest(range(1, greatest(len(ws) - 8, 2))) t(i) where len(ws) > 0
        ), size as (select distinct n from item),
        win as (select r, i, n, array_to_string(ws[i:i + n - 1], ' ') as g from d, size, unnest(range(1, len(ws) - n + 2)) t(i)),
        met as (select r, i, win.n as n, item_id from win join item on win.g = item.g and win.n = item.n),
        hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from met) group by r),
        ids as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct r, cast(item_id as varchar) as id from met) group by r)
        select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (r) left join ids using (r)
    """,
}
