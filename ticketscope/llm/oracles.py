"""DuckDB SQL for the queries that SQL can express: chats, line dedup, repeated bytes, decontamination, structure repair."""

OP2 = r"""
with turns as (
    select conv_id, turn, role, text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), whole as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
        regexp_replace(regexp_replace(coalesce(role, ''), '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') as safe_role,
        regexp_replace(regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') as safe_text
    from turns
), joined as (
    select conv_id,
        count(*) as n_turns,
        string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as lines,
        coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as under,
        sum(length('<|turn:') + length(safe_role) + length('|>') + 1 + length(safe_text) + length('<|end|>') + 1) as formatted_chars,
        string_agg(role, ',' order by turn nulls first, role, text) as roles
    from whole group by conv_id
)
select conv_id, n_turns, sha256(lines) as turns_sha256, length(under) as loss_chars, sha256(under) as loss_sha256,
    cast(formatted_chars as bigint) as formatted_chars, regexp_full_match(roles, '(system,)?user,assistant(,user,assistant)*') as valid
from joined
"""

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

OP10 = f"""
with items as (
    select item_id, {_WORDS} as w from benchmark
), windows as (
    select distinct coalesce(cast(item_id as varchar), '') as item, least(len(w), 10) as width, unnest([array_to_string(w[i:i + 9], ' ') for i in range(1, greatest(1, len(w) - 9) + 1)]) as phrase
    from items where len(w) > 0
), docs as (
    select row_number() over () as r, doc_id, {_WORDS} as w from documents
), widths as (select distinct width from windows),
starts as (
    select r, width, unnest(range(1, len(w) - width + 2)) as i, unnest([array_to_string(w[i:i + width - 1], ' ') for i in range(1, len(w) - width + 2)]) as phrase
    from docs, widths where len(w) >= width
), hits as (
    select r, s.width, i, item from starts s join windows using (phrase)
), covered as (
    select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + width)) as p from (select distinct r, width, i from hits)) group by r
), named as (
    select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hits) group by r
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join covered using (r) left join named using (r)
"""

OP11 = r"""
with keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        list_transform(range(1, length(k) + 1), lambda i: cast(ascii(k[i]) as bigint)) as bytes
    from (select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations)
), summed as (
    select conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b:
        list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 20 as fault
    from keyed
), damaged as (
    select conv_id, turn, case when fault = 4 then 'user' else role end as role,
        case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(range(case when fault = 0 then 0 when fault = 3 then 2 else 1 end)) as copy
    from summed
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as pos,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed, left(role, 1) as initial
    from damaged
), seen as (
    select *, row_number() over (partition by conv_id, role, md5(text) order by pos) > 1 as again from placed
), judged as (
    select *, trimmed = '' as blank, trimmed <> '' and again as duplicate,
        trimmed <> '' and not again and right(trimmed, 1) not in ('.', '!', '?') as truncated,
        coalesce(lag(initial) over (partition by conv_id order by pos) || initial not in ('su', 'ua', 'au'), false) as illegal
    from seen
), counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
        count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated, count(*) filter (illegal) as illegal, count(*) as n
    from judged group by conv_id
), costs as (
    select conv_id, pos, 4 as del, case when blank or duplicate then 90000000 else 3 end + case when truncated then 3 else 0 end as rerole,
        case when blank or duplicate or initial <> 's' then 90000000 when truncated then 3 else 0 end as keep_s,
        case when blank or duplicate or initial <> 'u' then 90000000 when truncated then 3 else 0 end as keep_u,
        case when blank or duplicate or initial <> 'a' then 90000000 when truncated then 3 else 0 end as keep_a
    from judged
), inserted(f, m, s, c) as (
    values (0, 0, '', 0), (0, 2, 'I', 3), (0, 3, 'II', 6), (1, 1, '', 0), (1, 2, 'I', 3), (1, 3, 'II', 6), (2, 2, '', 0), (2, 3, 'I', 3), (3, 3, '', 0), (3, 2, 'I', 3)
), acts(m, t, letter, kind) as (
    values (0, 0, 'D', 'del'), (1, 1, 'D', 'del'), (2, 2, 'D', 'del'), (3, 3, 'D', 'del'), (0, 2, 'R', 'rerole'), (1, 2, 'R', 'rerole'),
        (3, 2, 'R', 'rerole'), (2, 3, 'R', 'rerole'), (0, 1, 'K', 'keep_s'), (0, 2, 'K', 'keep_u'), (1, 2, 'K', 'keep_u'), (3, 2, 'K', 'keep_u'), (2, 3, 'K', 'keep_a')
), edits as (
    select f, t, s || letter as s, c, kind from inserted join acts using (m)
), priced as (
    select conv_id, pos, f, t, s, c + case kind when 'del' then del when 'rerole' then rerole when 'keep_s' then keep_s when 'keep_u' then keep_u else keep_a end as c
    from costs, edits
), steps as (
    select conv_id, pos, list({'f': f, 't': t, 's': s, 'c': c}) as ways from priced where c < 1000 group by conv_id, pos
), walk as (
    with recursive w(conv_id, pos, best) as (
        select distinct conv_id, cast(0 as bigint), [{'k': 0, 'a': ''}, {'k': 90000000, 'a': ''}, {'k': 90000000, 'a': ''}, {'k': 90000000, 'a': ''}] from counts
        union all
        select w.conv_id, s.pos, list_transform([0, 1, 2, 3], lambda to_state: coalesce(
            list_min(list_transform(list_filter(s.ways, lambda x: x.t = to_state), lambda x: {'k': w.best[x.f + 1].k + x.c, 'a': w.best[x.f + 1].a || x.s})), {'k': 90000000, 'a': ''}))
        from w join steps s on w.conv_id is not distinct from s.conv_id and s.pos = w.pos + 1
    ) select * from w
), ended as (
    select counts.conv_id, n, list_min([{'k': best[1].k, 'a': best[1].a}, {'k': best[2].k + 6, 'a': best[2].a || 'II'}, {'k': best[3].k + 3, 'a': best[3].a || 'I'}, best[4]]) as best
    from walk join counts on walk.conv_id is not distinct from counts.conv_id and walk.pos = counts.n
), letters as (
    select conv_id, best.a as audit, unnest(range(1, length(best.a) + 1)) as i from ended
), read as (
    select conv_id, i, audit[i] as letter, count(*) filter (audit[i] <> 'I') over (partition by conv_id order by i) as pos from letters
), stood as (
    select read.conv_id, i, letter, case when letter = 'I' then '' else text end as text, role,
        row_number() over (partition by read.conv_id order by i) - max(case when letter = 'K' and initial = 's' then 1 else 0 end) over (partition by read.conv_id) as place
    from read left join judged on read.conv_id is not distinct from judged.conv_id and judged.pos = read.pos and letter <> 'I' where letter <> 'D'
), lines as (
    select conv_id, string_agg(case when letter = 'K' then role when place % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by i) as whole
    from stood group by conv_id
)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
    coalesce(illegal, 0) as illegal, coalesce(best.k, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) ids
left join counts on ids.conv_id is not distinct from counts.conv_id
left join ended on ids.conv_id is not distinct from ended.conv_id
left join lines on ids.conv_id is not distinct from lines.conv_id
"""

# Distinct sets of words at their first place; pairs share one of the rarest words of both, then meet whole.
OP6 = r"""
with docs as (
    select distinct doc_id, text from documents
), lines as (
    select doc_id, unnest(range(len(l))) as line, unnest(l) as body from (select doc_id, string_split(text, chr(10)) as l from docs where text is not null)
), sets as (
    select doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(
        translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> ''))) as s from lines
), placed as (
    select *, row_number() over (order by doc_id nulls last, line) as place from sets where len(s) > 0
), kinds as (
    select s, min(place) as kind from placed group by s
), words as (
    select kind, len(s) as n, unnest(s) as w from kinds
), ranked as (
    select kind, n, w, row_number() over (partition by kind order by c, w) as p from words join (select w, count(*) as c from words group by w) using (w)
), prefixes as (
    select kind, n, w from ranked where p <= n // 5 + 1
), pairs as (
    select distinct a.kind as later, b.kind as earlier
    from prefixes a join prefixes b on a.w = b.w and b.kind < a.kind and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), gone as (
    select distinct later as kind from pairs join kinds a on later = a.kind join kinds b on earlier = b.kind
    where 9 * len(list_intersect(a.s, b.s)) >= 4 * (len(a.s) + len(b.s))
), lost as (
    select doc_id, line from placed join kinds using (s) left join gone using (kind) where gone.kind is not null or place <> kinds.kind
), kept as (
    select l.doc_id, count(*) as n_lines, count(lost.line) as n_removed,
        coalesce(string_agg(body, chr(10) order by l.line) filter (lost.line is null), '') as rest
    from lines l left join lost on l.doc_id is not distinct from lost.doc_id and l.line = lost.line group by l.doc_id
)
select doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed,
    sha256(rest) as kept_sha256
from documents left join kept using (doc_id)
"""

# All windows of 400 bytes, as hexadecimal text cut in tiles of 1000 starts.
OP9 = r"""
with docs as (
    select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as body from documents
), windows as (
    select r, 1000 * tile + i as i, md5_number(substr(part, 2 * i + 1, 800)) as w
    from (select r, tile, part, unnest(range(0, length(part) // 2 - 399)) as i
        from (select r, tile, substr(body, 2000 * tile + 1, 2798) as part from (select r, body, unnest(range(0, (length(body) // 2 - 400) // 1000 + 1)) as tile from docs where length(body) >= 800)))
), repeated as (
    select w from windows group by w having count(*) > 1
), starts as (
    select r, i, lag(i) over (partition by r order by i) as before from windows semi join repeated using (w)
), runs as (
    select r, i, sum(case when before is null or i > before + 400 then 1 else 0 end) over (partition by r order by i) as run from starts
), spans as (
    select r, min(i) as a, max(i) + 400 as b from runs group by r, run
), pieces as (
    select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as from_byte from spans
), kept as (
    select r, sum(b - a) as n_removed, count(*) as n_spans,
        string_agg(substr(body, 2 * from_byte + 1, 2 * (a - from_byte)), '' order by a) || any_value(substr(body, 2 * max_b + 1)) as rest
    from (select *, max(b) over (partition by r) as max_b from pieces) join docs using (r) group by r
)
select doc_id, cast(length(body) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
    cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(rest, body))) as kept_sha256
from docs left join kept using (r)
"""

ORACLES: dict[str, str] = {
    "op2_chat_format": OP2, "op6_line_dedup": OP6, "op9_suffix_dedup": OP9, "op10_decontaminate": OP10, "op11_repair_structure": OP11,
}
