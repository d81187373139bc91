"""DuckDB SQL of whole queries, written apart from the operators: plain joins and groupings that need not scale."""

from __future__ import annotations

from lexispark.llm.repetition import Limits

_WORD = r"[^\x20\x09-\x0D]+"
_UNIFORM = "(cast('0x' || substr(md5({}), 1, 13) as bigint) + 0.5) / 4503599627370496.0"

#: Every pair of texts that share a shingle is compared; components are the least id reached.
NEAR_DUPLICATES = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents),
s as (select doc_id, case when len(ws) >= 4 then list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
      when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as g from w),
n as (select doc_id, len(g) as n from s),
e as (select doc_id, unnest(g) as g from s),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
both_ as (select x, y from l union all select y, x from l),
reach as (select doc_id, doc_id as at_ from n union select r.doc_id, b.y from reach r join both_ b on b.x = r.at_)
select n.doc_id, n.n as n_shingles, min(at_) as component_id, n.doc_id = min(at_) as kept from n join reach r on r.doc_id = n.doc_id group by n.doc_id, n.n
"""

#: The even tree of 4 regions, 2 racks and 5 shards, so among children of equal weights the least draw has the greatest hash; an added shard has a tenth of a region's weight.
SHARDING = rf"""
with t as (select list(c order by b) as t from (select b, list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) x(b))),
d as (select row_number() over () as r, doc_id, coalesce(cast(doc_id as varchar), '~') as id, encode(coalesce(text, '')) as raw from documents),
b as (select r, doc_id, id, octet_length(raw) + 16 as size, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(raw), '..'), lambda h: cast('0x' || h as bigint))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32 from d, t),
region as (select r, arg_max(k, u) as region, max(u) as u from (select r, k, {_UNIFORM.format("id || '|region ' || k || '|'")} as u from b, range(4) x(k)) group by r),
rack as (select r, any_value(region) as region, any_value(ru) as ru, arg_max(k, u) as rack from (select r, region, region.u as ru, k, {_UNIFORM.format("id || '|rack ' || region || '.' || k || '|'")} as u from b join region using (r), range(2) x(k)) group by r),
shard as (select r, any_value(ru) as ru, any_value(region * 10 + rack * 5) + arg_max(k, u) as shard from (select r, ru, region, rack, k, {_UNIFORM.format("id || '|shard ' || region || '.' || rack || '.' || k || '|'")} as u from b join rack using (r), range(5) x(k)) group by r),
placed as (select b.*, cast(shard as integer) as shard, cast(case when -ln({_UNIFORM.format("id || '|added 0|'")}) < -ln(ru) / 10 then 40 else shard end as integer) as grown_shard,
           floor({_UNIFORM.format("id || '|slot'")} * greatest(1, (select count(*) from documents) // 4000000 * 2)) as block from b join shard using (r))
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'key' as law, shard,
       row_number() over (partition by shard order by block, doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard from placed
"""


def repetition(limits: Limits = Limits()) -> str:
    """Windows of 2 to 10 words as strings, counted within each text; null texts have none."""
    top, repeated = dict(limits.top), dict(limits.repeated)
    shares = {"dup_line_share": limits.lines, "dup_line_char_share": limits.line_chars} | {f"top_{k}gram_share": v for k, v in top.items()} | {f"dup_{k}gram_share": v for k, v in repeated.items()}
    lengths = sorted({3, *top, *repeated})
    leads = ", ".join([f"t{''.join(f" || ' ' || lead(t, {j}) over o" for j in range(1, k))} as g{k}, sum(length(t)) over (partition by r order by i rows between current row and {k - 1} following) as c{k}" for k in lengths])
    ctes = [
        "d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents)",
        f"w as (select r, unnest(regexp_extract_all(text, '{_WORD}')) as t, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) as i from d)",
        "n as (select r, count(*) as n_words, sum(length(t)) as word_chars from w group by r)",
        "l as (select r, line, at_, row_number() over (partition by r, line order by at_) as seen from (select r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as at_ from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]'))",
        f"lines as (select r, count(*) as n_lines, count(*) filter (seen > 1) as n_dup_lines, sum(case when seen > 1 then length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) else 0 end) as dup_chars from l group by r)",
        f"q as (select r, i, t, {leads} from w window o as (partition by r order by i))",
    ]
    for k in lengths:
        ctes.append(f"m{k} as (select * from (select r, i, c{k} as c, count(*) over (partition by r, g{k}) as n from q where g{k} is not null) where n > 1)")
        ctes.append(f"a{k} as (select r, max(n * c) as top from m{k} group by r)")
        ctes.append(f"v{k} as (select w.r, count(*) as words, sum(length(t)) as chars from w join (select distinct r, unnest(range(i, i + {k})) as i from m{k}) x on w.r = x.r and w.i = x.i group by w.r)")
    joins = " ".join(["left join n on n.r = d.r left join lines on lines.r = d.r", *[f"left join a{k} on a{k}.r = d.r left join v{k} on v{k}.r = d.r" for k in lengths]])
    per = "greatest(coalesce(word_chars, 0), 1)"
    ints = [
        "cast(coalesce(n_words, 0) as bigint) as n_words", "cast(coalesce(word_chars, 0) as bigint) as word_chars",
        "cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols", "cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines", "cast(coalesce(v3.words, 0) as bigint) as n_repeat_words",
        f"coalesce(n_words, 0) < {limits.least_words} or 100 * coalesce(v3.words, 0) > {limits.most_repeat_percent} * coalesce(n_words, 0) as base_failed",
    ]
    doubles = ["cast(coalesce(n_dup_lines, 0) as double) / greatest(coalesce(n_lines, 0), 1) as dup_line_share", f"cast(coalesce(dup_chars, 0) as double) / {per} as dup_line_char_share"]
    doubles += [f"least(cast(coalesce(a{k}.top, 0) as double) / {per}, 1.0) as top_{k}gram_share" for k in top] + [f"cast(coalesce(v{k}.chars, 0) as double) / {per} as dup_{k}gram_share" for k in repeated]
    ctes.append(f"f as (select d.doc_id, {', '.join([*ints, *doubles])} from d {joins})")
    good = " and ".join(["not base_failed", *[f"{c} <= cast('{v}' as double)" for c, v in shares.items()]])
    return f"with {', '.join(ctes)} select *, {good} as kept from f"


#: The mix of mixing.mix() for documents whose rows differ: targets by filling sources in the order of cap / weight, words laid out by a hash, blocks of 64, and the schedule's slots.
MIX = rf"""
with d as (select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as size, coalesce(cast(doc_id as varchar), '~') || '|' || coalesce(md5(text), '~') || '|mix' as id, md5(text) as h from documents),
s0 as (select source, sum(size) as n, [5.0::double, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from d group by source),
s1 as (select *, n * 3.0::double as cap from s0),
s2 as (select *, (sum(n) over () - coalesce(sum(cap) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level from s1 window before as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
s3 as (select *, least(cap, coalesce((select level from s2 where level * w <= cap order by cap / w, level limit 1) * w, cap)) as target from s2),
s4 as (select *, sum(target) over (order by source nulls last) / sum(target) over () as hi, cast(round(target) as hugeint) as take, greatest(1, cast(ceil(n / 64) as bigint)) as nb from s3),
s5 as (select *, coalesce(lag(hi) over (order by source nulls last), 0) as lo, n // nb as each, n % nb as more from s4),
plan as (select *, case when n = 0 then 0 else (take // n) * nb + case when take % n = 0 then 0 when take % n - 1 < more * (each + 1) then (take % n - 1) // (each + 1) + 1 else more + (take % n - 1 - more * (each + 1)) // each + 1 end end as slots from s5),
total as (select greatest(1, sum(n) // 64) as slots from plan),
x as (select i, cast((i::hugeint * 2783377641436327) % 4503599627370496 as double) / 4503599627370496.0 as x from (select unnest(range(cast(slots as bigint))) as i from total)),
drawn as (select source, i as slot, row_number() over (partition by source order by i) - 1 as rank from x join plan on x.x >= lo and x.x < hi),
every as (select p.source, p.rank, coalesce(drawn.slot, (select slots from total) + p.rank) as slot from (select source, unnest(range(cast(slots as bigint))) as rank from plan) p left join drawn on drawn.rank = p.rank and drawn.source is not distinct from p.source),
taken as (select plan.source, slot, rank % nb as block, (rank // nb) * n + (rank % nb) * each + least(rank % nb, more) as begins, each + case when rank % nb < more then 1 else 0 end as words, take from every join plan on plan.source is not distinct from every.source),
blocks as (select source, block, sum(case when begins + words <= take then 1 else 0 end) as whole, sum(case when begins + words <= take then 0 else take - begins end) as part, min(slot) as slot from taken group by 1, 2),
laid as (select r, source, size, coalesce(sum(size) over (partition by source order by {_UNIFORM.format("id")}, doc_id, h rows between unbounded preceding and 1 preceding), 0) as from_ from d),
edges as (select source, b as block, b * each + least(b, more) as lo, (b + 1) * each + least(b + 1, more) as hi from (select *, unnest(range(nb)) as b from plan where n > 0)),
pieces as (select r, e.source, e.block, least(from_ + size, hi) - greatest(from_, lo) as words, greatest(from_, lo) - lo as inside from laid join edges e on e.source is not distinct from laid.source and e.lo < from_ + size and e.hi > from_ where size > 0),
got as (select r, slot, whole * words + greatest(0, least(words, part - inside)) as got from pieces join blocks on blocks.block = pieces.block and blocks.source is not distinct from pieces.source),
sums as (select r, sum(got) as taken, min(case when got > 0 then slot end) as first_slot from got group by r)
select d.doc_id, cast(size as bigint) as size, cast(plan.n as bigint) as source_size, target, cast(coalesce(taken, 0) as bigint) as taken, cast(first_slot as bigint) as first_slot
from d join plan on plan.source is not distinct from d.source left join sums using (r)
"""
