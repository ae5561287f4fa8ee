"""The planner in SQL: pieces of WITH lists, joined as each query needs them."""

from __future__ import annotations

SHARD_ROWS = 50


def hexkey(purpose: str, *ids: str, seed: int = 0, epoch: int = 0) -> str:
    return f"md5(concat_ws(':', '{seed}', '{epoch}', '{purpose}', {', '.join(ids)}))"


def uniform(key: str) -> str:
    return f"(cast('0x' || substr({key}, 1, 13) as bigint) / {float(1 << 52)!r})"


SAMPLES = f"""
    names as (
        select lang, count(*) as n, dense_rank() over (order by lang) - 1 as stream_id,
            coalesce(sum(count(*)) over (order by lang rows between unbounded preceding and 1 preceding), 0) as first,
            coalesce(sum(cast(ceil(count(*) / {SHARD_ROWS}.0) as bigint)) over (order by lang rows between unbounded preceding and 1 preceding), 0) as shards
        from documents group by lang
    ), samples as (
        select stream_id, cast(shards + pos // {SHARD_ROWS} as bigint) as shard_id, cast(pos % {SHARD_ROWS} as bigint) as place, cast(first + pos as bigint) as sample_id, doc_id as row_key
        from (select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as pos from documents) join names using (lang)
    ), shards as (select stream_id, shard_id, count(*) as n from samples group by all)"""


#: How many rows a plan has that draw() is for, whatever it draws.
ALL = "(select n_all from everything)"


def draw(choose: list[int] | str, granularity: int = 1, seed: int = 0, epoch: int = 0) -> str:
    """drawn: big_id, unit_begin, sample_id, stream_id, shard_id; units: unit_begin, size. choose: numbers, or an expression of stream_id and n."""
    rows = f"select stream_id, cast({choose} as bigint) as choose from names" if isinstance(choose, str) else "values " + ", ".join(f"({i}, {c})" for i, c in enumerate(choose))
    return f"""
    choices(stream_id, choose) as ({rows}), everything as (select cast(sum(choose) as bigint) as n_all from choices),
    base as (
        select s.*, choose // sum(n) over (partition by stream_id) as whole, choose % sum(n) over (partition by stream_id) as rest
        from shards s join choices using (stream_id)
    ), picks as (
        select *, least({granularity}, n - pick * {granularity}) as size, {hexkey('pick', 'shard_id', 'pick', seed=seed, epoch=epoch)} as k
        from (select *, unnest(range(cast(ceil(n / {granularity}.0) as bigint))) as pick from base where rest > 0)
    ), got as (
        select shard_id, sum(greatest(0, least(size, rest - before))) as got from (
            select *, coalesce(sum(size) over (partition by stream_id order by k rows between unbounded preceding and 1 preceding), 0) as before from picks
        ) group by shard_id
    ), chosen as (
        select b.stream_id, b.shard_id, b.n, cast(whole * n + coalesce(got, 0) as bigint) as chosen from base b left join got using (shard_id)
    ), all_units as (
        select *, coalesce(sum(size) over (order by stream_id, shard_id, copy rows between unbounded preceding and 1 preceding), 0) as begin
        from (select *, least(n, chosen - copy * n) as size from (select *, unnest(range(cast(ceil(chosen / cast(n as double)) as bigint))) as copy from chosen where chosen > 0))
    ), joined as (
        select s.*, u.copy, u.size, u.n, u.begin, row_number() over (partition by s.shard_id, u.copy order by {hexkey('draw', 's.sample_id', seed=seed, epoch=epoch)}) as r
        from samples s join all_units u using (shard_id)
    ), drawn as (
        select cast(begin + row_number() over (partition by shard_id, copy order by place) - 1 as bigint) as big_id, cast(begin as bigint) as unit_begin, sample_id, stream_id, shard_id
        from joined where r <= size
    ), units as (select unit_begin, count(*) as size from drawn group by unit_begin)"""


def grid(n: str | int, c: int, p: int, r: int, w: int, b: int, drop: int = 0, name: str = "cells") -> str:
    """cells: traversal, node, rank, worker, batch, slot, pos (-1: padding), in closed form."""
    q = p // c if c < p else 0
    k = name + "_k"
    return f"""
    {k}0 as (select cast({n} as bigint) as n, cast(ceil(cast({n} as double) / {c}) as bigint) as s, cast({drop - drop % p} as bigint) as d),
    {k}1 as (select *, {f'({q} - s % {q}) % {q}' if q else '0'} as pad from {k}0),
    {k}2 as (select *, ({c} * (s + pad) - d) // {p} as total from {k}1),
    {k}3 as (select *, ({r} - total % {r}) % {r} as u from {k}2),
    {k} as (select *, (total + u) // {r} as m_all, cast(ceil(((total + u) // {r}) / {w * b}.0) as bigint) as batches from {k}3),
    {name}_c as (
        select {k}.*, i as traversal, (i // {b * r}) % {p} as node, (i // {b}) % {r} as rank, (i // {b * r * p}) % {w} as worker, i // {b * r * p * w} as batch, i % {b} as slot
        from {k}, lateral (select unnest(range(batches * {w * p * r * b})) as i)
    ), {name}_t as (select *, (batch * {w} + worker) * {b} + slot as m, ((batch * {w} + worker) * {b} + slot) * {r} + rank as t0 from {name}_c),
    {name}_p as (
        select *, (case when t0 < total then t0 when {r} + u - 1 <= total then t0 - {r} - u + 1 else (t0 - total) % greatest(total, 1) end) * {p} + node + d as place from {name}_t
    ), {name}_j as (select *, place % {c} as cn, place // {c} as j0 from {name}_p),
    {name}_i as (select *, case when {q} > 0 and j0 >= s then j0 - {q} + 1 - pad else j0 end as j from {name}_j),
    {name} as (
        select traversal, node, rank, worker, batch, slot, case
            when m >= m_all then -1
            when n < {c} or (n = {c} and pad > 0) then (cn * (s + pad) + j0) % n
            else cn * n // {c} + j - (case when j = s - 1 and (cn + 1) * n // {c} - cn * n // {c} < s then 1 else 0 end) end as pos
        from {name}_i
    )"""


def shuffled(algorithm: str, n: str | int, c: int, seed: int = 0, epoch: int = 0, block: int | str = 200) -> str:
    """perm: pos, node, big_id, from units and n drawn rows."""
    edge = lambda x: f"(({x}) * {n} // {c})"
    node_of = f"((pos + 1) * {c} - 1) // {n}"
    if algorithm == "naive":
        return f"""
    perm as (
        select pos, {node_of} as node, big_id
        from (select big_id, row_number() over (order by {hexkey('naive', 'big_id', seed=seed, epoch=epoch)}) - 1 as pos from (select unnest(range(cast({n} as bigint))) as big_id))
    )"""
    out = f"""
    ordered as (
        select unit_begin, size, cast(coalesce(sum(size) over (order by {hexkey('unit', 'unit_begin', seed=seed)} rows between unbounded preceding and 1 preceding), 0) as bigint) as begin from units
    ), cut as (
        select *, unnest(range(((begin + 1) * {c} - 1) // {n}, ((begin + size) * {c} - 1) // {n} + 1)) as node from ordered
    ), spans as (
        select unit_begin, node, greatest(begin, {edge('node')}) as begin, least(begin + size, {edge('node + 1')}) - greatest(begin, {edge('node')}) as size,
            unit_begin + greatest(begin, {edge('node')}) - begin as first
        from cut
    ), placed as (
        select *, cast({edge('node')} + coalesce(sum(size) over (partition by node order by {hexkey('span', 'begin', seed=seed, epoch=epoch)} rows between unbounded preceding and 1 preceding), 0) as bigint) as start_at
        from spans where size > 0
    ), span_rows as (select *, first + i as big_id from (select *, unnest(range(size)) as i from placed))"""
    row = hexkey("row", "big_id", seed=seed, epoch=epoch)
    if algorithm == "py2s":
        out += f""",
    inner_rows as (select unit_begin + unnest(range(size)) as big_id, unit_begin from units),
    mixed as (select unit_begin + row_number() over (partition by unit_begin order by {hexkey('inner', 'big_id', seed=seed)}) - 1 as place, big_id as other from inner_rows),
    final_rows as (select r.start_at, r.node, m.other as big_id from span_rows r join mixed m on r.big_id = m.place)"""
    if algorithm in ("py1s", "py2s"):
        source = "final_rows" if algorithm == "py2s" else "span_rows"
        return out + f""",
    perm as (select start_at + row_number() over (partition by start_at order by {row}) - 1 as pos, node, big_id from {source})"""
    if algorithm == "py1br":
        stagger = f"cast(floor({uniform(hexkey('stagger', 'node', seed=seed, epoch=epoch))} * (0.75 * {block})) as bigint)"
        return out + f""",
    blocks as (select *, start_at + i as here, (start_at + i - {edge('node')} + {stagger}) // {block} as block from span_rows),
    perm as (select min(here) over (partition by node, block) + row_number() over (partition by node, block order by {row}) - 1 as pos, node, big_id from blocks)"""
    return out + f""",
    shifts as (
        select *, greatest({edge('node')} - start_at, -greatest(0.0, (cast({block} as double) - size) / 2)) as lo, least({edge('node + 1')} - start_at - size, greatest(0.0, (cast({block} as double) - size) / 2)) as hi,
            start_at + row_number() over (partition by start_at order by {row}) - 1 as here
        from span_rows
    ), moved as (select *, here + lo + (hi - lo) * {uniform(hexkey('shift', 'big_id', seed=seed, epoch=epoch))} as there from shifts),
    perm as (select {edge('node')} + row_number() over (partition by node order by there, big_id) - 1 as pos, node, big_id from moved)"""
