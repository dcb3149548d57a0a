"""SQL (DuckDB) for those queries of this folder that SQL can express."""

from __future__ import annotations

from speechloom.llm import mixing, suffix_dedup, url_filter

ORACLE: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"

ORACLE["op1_source_mix"] = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
         md5(concat_ws('|', '42', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')))) as code
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
         row_number() over (order by source is null, source) - 1 as number
  from d group by source
), w as (
  select *, ([5.0, 2.0, 1.0]::double[])[number % 3 + 1] as weight,
         ({mixing.MOST} * source_size)::double as most, sum(source_size) over ()::double as total
  from s
), r as (select *, most / weight as ratio from w
), l as (
  select *, (total - coalesce(sum(most) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from r window before as (order by ratio, number rows between unbounded preceding and 1 preceding)
), f as (
  select *, first_value(case when level <= ratio then level end ignore nulls) over (
    order by ratio, number rows between unbounded preceding and unbounded following) as first
  from l
), t as (
  select source, source_size, number, total, round(least(most, coalesce(first, ratio) * weight), 6) as target from f
), p as (
  select *, coalesce(sum(target::decimal(30, 6)) over (order by number rows between unbounded preceding and 1 preceding), 0)::double as before,
         (sum(target::decimal(30, 6)) over (order by number))::double as upto, max(number) over () as last
  from t
), b as (
  select *, least(floor(before / greatest(total, 1) * {1 << mixing.BITS}.0::double), {1 << mixing.BITS})::bigint as low,
         case when number = last then {1 << mixing.BITS}
              else least(floor(upto / greatest(total, 1) * {1 << mixing.BITS}.0::double), {1 << mixing.BITS})::bigint end as high,
         ceil(source_size / {mixing.BLOCK}.0)::bigint as blocks
  from p
), slots as (
  select slot, list_sum([((slot >> k) & 1) << ({mixing.BITS - 1} - k) for k in range({mixing.BITS})])::bigint as point
  from (select unnest(range((select ceil(max(total) / {mixing.BLOCK}.0)::bigint from b))) as slot)
), u as (
  select number, blocks, row_number() over (partition by number order by slot) - 1 as rank
  from slots join b on low <= point and point < high
), times as (
  select number, rank % blocks as block, count(*) as times from u
  where rank < {mixing.MOST} * blocks group by all
), laid as (
  select d.*, b.number, b.source_size, b.target,
         coalesce(sum(size) over (partition by b.number order by code rows between unbounded preceding and 1 preceding), 0) as start,
         row_number() over () as row
  from d join b on d.source is not distinct from b.source
), given as (
  select row, sum((least(start + size, (block + 1) * {mixing.BLOCK}) - greatest(start, block * {mixing.BLOCK})) * times) as taken
  from laid join times on times.number = laid.number
    and block >= start // {mixing.BLOCK} and block <= (start + size - 1) // {mixing.BLOCK}
  where size > 0 group by row
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, source
from laid left join given using (row)
"""

_LAST = (1 << 63) - 1


def _op2(length: int = 50) -> str:
    return f"""
with d as (
  select row_number() over () as row, doc_id, coalesce(doc_id, {_LAST}) as id,
         hex(encode(coalesce(text, ''))) as h
  from documents
), p as (
  select row, id, pos, substr(h, 2 * pos + 1, {2 * length}) as s
  from (select row, id, h, unnest(range(length(h) // 2 - {length} + 1)) as pos from d)
), g as (
  select s, min(id) as least_id from p group by s having max(id) > min(id)
), m as (
  select row, pos, pos > lag(pos) over (partition by row order by pos) + {length} as gap
  from p join g using (s) where least_id < id
), n as (
  select row, pos, sum(case when gap then 1 else 0 end) over (partition by row order by pos) as span from m
), s as (
  select row, min(pos) as a, max(pos) + {length} as b from n group by row, span
), e as (
  select s.*, coalesce(lag(b) over (partition by row order by a), 0) as upto from s
), k as (
  select row, sum(b - a)::bigint as removed, count(*) as spans, max(b) as last_end,
         string_agg(substr(h, 2 * upto + 1, 2 * (a - upto)), '' order by a) as kept
  from e join d using (row) group by row
)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed,
       coalesce(spans, 0)::bigint as n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last_end, 0) + 1))) as kept_sha256
from d left join k using (row)
"""


ORACLE["op2_suffix_dedup"] = _op2()


def _op4(levels: int = 8) -> str:
    """For paths of at most ``levels`` segments."""
    u = url_filter
    rule = verdict = "null"
    for r in reversed(u.by_length(u.RULES)):
        fits = (
            f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
        )
        rule = f"case when {fits} then '{r.text}' else {rule} end"
        verdict = f"case when {fits} then '{r.verdict}' else {verdict} end"
    parts = [
        f"""
with a as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), b as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{u.UPPER}', '{u.LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from a
), c as (
  select *, {rule} as rule, {verdict} as ruled, string_split(path, '/') as raw from b
), d as (
  select *, [regexp_replace(x, '^[0-9]+(\\.[A-Za-z0-9]+)?$', '*\\1') for x in raw] as whole from c
), counted as (
  select host, array_to_string(whole, '/') as shape, any_value(whole) as whole, count(*) as n, count(ruled) as labelled,
         count(*) filter (ruled = 'block') as blocked
  from d group by host, shape
), r0 as (
  select host, shape, n, labelled, blocked, whole[2:] as segments, '' as node,
         (select ((sum(blocked) + 1) / (sum(labelled) + 2))::double from counted) as share
  from counted
)"""
    ]
    alike = (
        "({of} = 0 or abs({part}::double / {of} - all_{part}::double / all_{of})"
        f" < {u.BOUND} * (1 / sqrt({{of}}) + 1 / sqrt(all_{{of}})))"
    )
    both = alike.format(part="blocked", of="labelled") + " and " + alike.format(part="more", of="n")
    for k in range(levels):
        parts.append(
            f""", s{k} as (
  select *, case when len(segments) > {k} then segments[{k + 1}] end as segment,
         case when len(segments) > {k + 1} then n else 0 end as more
  from r{k}
), children{k} as (
  select host, node, segment, sum(n) as n, sum(labelled) as labelled, sum(blocked) as blocked, sum(more) as more, any_value(share) as share
  from s{k} where segment is not null group by host, node, segment
), nodes{k} as (
  select host, node, sum(n) as all_n, sum(labelled) as all_labelled, sum(blocked) as all_blocked, sum(more) as all_more, count(*) as kinds
  from children{k} group by host, node
), tokens{k} as (
  select *, case when kinds >= {u.LEAST_CHILDREN} and kinds >= {u.LEAST_VARIETY} * all_n
                  and not (n >= {u.OFTEN} and n >= {u.OFTEN_SHARE} * all_n) then '*' else segment end as token
  from children{k} join nodes{k} using (host, node)
), branches{k} as (
  select host, node, token, sum(n) as n, sum(labelled) as labelled, sum(blocked) as blocked, sum(more) as more,
         any_value(all_n) as all_n, any_value(all_labelled) as all_labelled, any_value(all_blocked) as all_blocked,
         any_value(all_more) as all_more, any_value(share) as share
  from tokens{k} group by host, node, token
), merged{k} as (
  select *, case when {both} then '+' else '=' || token end as branch from branches{k}
), shares{k} as (
  select host, node, branch,
         ((sum(blocked) + {u.SMOOTHING}::double * any_value(share)) / (sum(labelled) + {u.SMOOTHING}::double))::double as new_share
  from merged{k} group by host, node, branch
), r{k + 1} as (
  select s.host, s.shape, s.n, s.labelled, s.blocked, s.segments,
         case when m.branch is null then s.node else s.node || '/' || m.branch end as node,
         coalesce(h.new_share, s.share) as share
  from s{k} s
  left join tokens{k} t on t.host = s.host and t.node = s.node and t.segment = s.segment
  left join merged{k} m on m.host = t.host and m.node = t.node and m.token = t.token
  left join shares{k} h on h.host = m.host and h.node = m.node and h.branch = m.branch
)"""
        )
    parts.append(
        f"""
select page_id, host, path, rule,
       coalesce(ruled, case when known and share >= {u.REJECT} then 'block' else 'allow' end) as verdict,
       node as template, round(share, 9) as share
from d join (select host as h, shape, node, share, bool_or(labelled > 0) over (partition by host) as known from r{levels}) t
  on t.h = d.host and t.shape = array_to_string(d.whole, '/')
"""
    )
    return "".join(parts)


ORACLE["op4_url_filter"] = _op4()


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    return (
        f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''),"
        f" lambda x: ascii(x)::bigint)), lambda a, b: {step}), 4294967295)"
    )


ORACLE["op11_prefix_trie"] = f"""
with m as (
  select conv_id, turn, length(text)::bigint as chars,
         sha256(strlen(role)::varchar || ':' || role || text)[:32] as code
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations)
  where conv_id is not null
), own as (
  select conv_id, list({{'code': code, 'chars': chars}} order by turn nulls first, code) as l from m group by conv_id
), h as (
  select conv_id, l, {_crc32("conv_id::varchar")} % 6 as h from own
), r as (
  select h.conv_id, coalesce(b.l[1:h.h], []) || h.l[h.h + 1:] as p
  from h left join own b on b.conv_id = h.conv_id - h.conv_id % 100
), k as (
  select conv_id, d as depth, array_to_string(list_transform(p[1:d], lambda s: s.code), '') as node,
         case when d > 0 then p[d].chars else 0 end as chars, d = len(p) as ends
  from (select conv_id, p, unnest(range(len(p) + 1)) as d from r)
), n as (
  select node, any_value(depth) as depth, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs,
         string_agg(conv_id::varchar, ',' order by conv_id) filter (ends) as ids
  from k group by node
), t as (
  select n.*, node[:32 * (depth - 1)] as parent, coalesce(c.n, 0) as n_children
  from n left join (select node[:32 * (depth - 1)] as node, count(*) as n from n where depth > 0 group by 1) c using (node)
), s as (
  select node[:32 * up] as node, sum((n_convs - 1) * chars)::bigint as saved_tokens, count(*) filter (n_children = 0) as n_leaves
  from (select *, unnest(range(depth + 1)) as up from t) group by 1
)
select t.conv_id, t.depth, case when t.depth > 0 then a.conv_id end as parent_conv_id, t.n_convs, t.n_children,
       s.n_leaves, s.saved_tokens, sha256(coalesce(t.ids, '')) as ends_sha256
from t join s using (node) left join t a on a.node = t.parent
"""


def _op13(levels: int = 6, fan: int = 16) -> str:
    """Trees of up to ``fan`` to the ``levels`` leaves; a lone node goes up as it is."""
    field = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
    lower = f"case when {_crc32('doc_id::varchar')} % 5 = 0 then translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}') else text end"
    whole = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    parts = [
        f"""
with d as (
  select doc_id, source, sha256({whole} || {field.format('text')}) as leaf, sha256({whole} || {field.format(f'({lower})')}) as claim
  from documents
), r as (
  select *, row_number() over (partition by source order by doc_id nulls last, leaf) - 1 as rank from d
), a0 as (
  select source, rank, leaf as node, count(*) over (partition by source) as n from r
)"""
    ]

    def tree(name: str) -> None:
        beside = "coalesce(string_agg(node, '') over (partition by source, rank // {0} order by rank rows between {1}), '')"
        for k in range(levels):
            parts.append(
                f""", {name}s{k} as (
  select source, rank, n, {beside.format(fan, 'unbounded preceding and 1 preceding')} as l,
         {beside.format(fan, '1 following and unbounded following')} as r
  from {name}{k}
), {name}{k + 1} as (
  select source, rank // {fan} as rank, case when any_value(n) = 1 then any_value(node) else sha256(string_agg(node, '' order by rank)) end as node,
         ceil(any_value(n) / {fan}.0)::bigint as n
  from {name}{k} group by source, rank // {fan}
)"""
            )

    tree("a")
    parts.append(
        f""", b0 as (
  select '' as source, row_number() over (order by source nulls first) - 1 as rank, node, count(*) over () as n from a{levels}
), o as (
  select source, node as subroot, row_number() over (order by source nulls first) - 1 as place from a{levels}
)"""
    )
    tree("b")
    parts.append(", j0 as (select r.*, subroot, place, claim as node, '' as proof from r join o on o.source is not distinct from r.source)")
    for step in range(2 * levels):
        name, k = ("a", step) if step < levels else ("b", step - levels)
        at = f"s.source is not distinct from j.source and s.rank = j.rank // {fan**k}" if name == "a" else f"s.rank = j.place // {fan**k}"
        parts.append(
            f""", j{step + 1} as (
  select j.* exclude (node, proof), case when s.n = 1 then node else sha256(s.l || node || s.r) end as node, proof || s.l || s.r as proof
  from j{step} j join {name}s{k} s on {at}
)"""
        )
    parts.append(
        f"""
select doc_id, leaf, subroot, b.node as root, sha256(proof) as proof_sha256, j.node as folded_root, j.node = b.node as verified
from j{2 * levels} j join b{levels} b on true
"""
    )
    return "".join(parts)


ORACLE["op13_merkle_manifest"] = _op13()
