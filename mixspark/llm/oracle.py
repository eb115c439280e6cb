"""SQL twins of the queries that SQL can express."""

from mixspark.llm.common import LOWER, UPPER

LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

def _field(c: str) -> str:
    return f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# crc32 of the id's digits, bit by bit.
CRC = """xor(4294967295, list_reduce(
            list_prepend(4294967295::bigint, list_transform(
                string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
            lambda a, b: list_reduce(
                list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

ORACLE = {
    "op4_decontaminate": rf"""
        with w as (
            select doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
        b as (
            select item_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
        n as (select item_id, words, least(13, len(words)) as k from b where len(words) > 0),
        grams as (
            select distinct item_id, k, array_to_string(words[i:i + k - 1], ' ') as gram
            from n, lateral (select unnest(range(1, len(words) - k + 2)) as i)),
        windows as (
            select doc_id, i, k, array_to_string(words[i:i + k - 1], ' ') as gram
            from w, (select distinct k from grams) ks, lateral (select unnest(range(1, len(words) - k + 2)) as i)),
        hits as (select doc_id, i, w.k, item_id from windows w join grams g on w.k = g.k and w.gram = g.gram),
        places as (
            select doc_id, count(distinct p) as n_hit
            from hits, lateral (select unnest(range(i, i + k)) as p) group by doc_id),
        items as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
            from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
        select w.doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit,
            coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
            coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
        from w left join places using (doc_id) left join items using (doc_id)""",
    "op5_jaccard_join": rf"""
        with recursive w as (
            select doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') as words from documents),
        s as (
            select distinct doc_id, array_to_string(words[i:i + least(5, len(words)) - 1], ' ') as shingle
            from w, lateral (select unnest(range(1, greatest(2, len(words) - 3))) as i) where len(words) > 0),
        n as (select doc_id, count(*) as n from s group by doc_id),
        shared as (
            select a.doc_id as a, b.doc_id as b, count(*) as n_both
            from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
        links as (
            select a, b from shared join n x on a = x.doc_id join n y on b = y.doc_id
            where 100 * n_both >= 75 * (x.n + y.n - n_both)),
        reach as (
            select doc_id as a, doc_id as b from documents
            union select reach.a, links.b from reach join links on reach.b = links.a)
        select w.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
        from w left join n using (doc_id)
        join (select a as doc_id, min(b) as component_id from reach group by a) c using (doc_id)""",
    "op7_exact_dedup": f"""
        with t as (select doc_id, {LOW} as body from documents),
        g as (select body, max(doc_id) as keep_id, count(*) as group_size from t group by body)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256
        from t join g using (body)""",
    "op11_merkle_manifest": f"""
        with recursive d as (
            select doc_id, source, {_leaf("text")} as leaf,
                case when {CRC} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf("text")} end as tampered
            from documents),
        leaves as (
            select *, row_number() over (partition by source order by doc_id, leaf) - 1 as pos,
                count(*) over (partition by source) as n
            from d),
        tree as (
            select source, 0 as lvl, pos, n, leaf as h from leaves
            union all
            select source, lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by pos))
            from tree where n > 1 group by source, lvl, pos // 3),
        subroots as (
            select source, h, lvl as height, row_number() over (order by source nulls first) - 1 as pos,
                count(*) over () as n
            from tree where n = 1),
        top as (
            select 0 as lvl, pos, n, h from subroots
            union all
            select lvl + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by pos))
            from top where n > 1 group by lvl, pos // 3),
        root as (select h as root from top where n = 1),
        way as (
            select doc_id, leaves.source, leaves.pos as leaf_pos, leaf, tampered, subroots.h as subroot, lvl,
                cast(floor(leaves.pos / power(3, lvl)) as bigint) as p, lvl as step, false as up
            from leaves join subroots on leaves.source is not distinct from subroots.source,
                lateral (select unnest(range(0, height)) as lvl)
            union all
            select doc_id, leaves.source, leaves.pos, leaf, tampered, subroots.h, lvl,
                cast(floor(subroots.pos / power(3, lvl)) as bigint), height + lvl, true
            from leaves join subroots on leaves.source is not distinct from subroots.source,
                lateral (select unnest(range(0, (select max(lvl) from top))) as lvl)),
        steps as (
            select w.*,
                coalesce((select string_agg(t.h, '' order by t.pos) from tree t where not up and t.lvl = w.lvl
                    and t.source is not distinct from w.source and t.pos // 3 = w.p // 3 and t.pos < w.p), '') ||
                coalesce((select string_agg(t.h, '' order by t.pos) from top t where up and t.lvl = w.lvl
                    and t.pos // 3 = w.p // 3 and t.pos < w.p), '') as before,
                coalesce((select string_agg(t.h, '' order by t.pos) from tree t where not up and t.lvl = w.lvl
                    and t.source is not distinct from w.source and t.pos // 3 = w.p // 3 and t.pos > w.p), '') ||
                coalesce((select string_agg(t.h, '' order by t.pos) from top t where up and t.lvl = w.lvl
                    and t.pos // 3 = w.p // 3 and t.pos > w.p), '') as behind
            from way w),
        done as (
            select doc_id, source, leaf_pos, leaf, subroot,
                sha256(string_agg(before || behind, '' order by step)) as proof_sha256,
                list_reduce(
                    list_prepend(any_value(tampered),
                        list(before || '|' || behind order by step)),
                    lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) as folded_root
            from steps group by all)
        select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified
        from done, root""",
    "op13_warc": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        r as (select *, sha1(body) as hex, max(page_id) over (partition by body) as first from p)
        select page_id, strlen(body) as payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr(
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((cast('0x' || substr(hex, cast(i // 4 * 5 + 1 as bigint), 5) as bigint) >> (15 - i % 4 * 5)::bigint) & 31)::bigint,
                1)), '') as payload_digest,
            case when page_id = first then 'response' else 'revisit' end as record_type,
            case when page_id <> first then first end as refers_to
        from r""",
}
