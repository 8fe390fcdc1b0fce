"""DuckDB twin of the nearest-neighbour mutual information."""

from __future__ import annotations

from churnspark.operators.neighbours import NEIGHBOURS, NOISE


def neighbour_mi_sql(long: str, k: int = NEIGHBOURS) -> str:
    """DuckDB twin over a relation (feature, key, y, x) without nulls: CTEs ending in ``nmi`` (feature, mi)."""
    def psi(x: str) -> str:
        z = f"({x} + 6.0)"
        tail = " - ".join(f"1 / ({x} + {i}.0)" for i in range(6))
        return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} * {z}) + 1 / (120 * {z} * {z} * {z} * {z}) - 1 / (252 * {z} * {z} * {z} * {z} * {z} * {z}) - {tail})"

    near = ", ".join(f"{f}(v, {j}) over w" for j in range(1, k + 1) for f in ("lag", "lead"))
    return f"""
nv as (select l.feature, l.key, l.y, l.x + (('0x' || substr(md5('mi|' || l.feature || '|' || l.key), 1, 13))::bigint / 4503599627370496.0 - 0.5)
       * (a.amp * {NOISE!r}) as v from {long} l join (select feature, max(abs(x)) as amp from {long} group by feature) a on a.feature = l.feature),
nn as (select *, count(*) over (partition by feature, y) as n_class, [{near}] as near from nv window w as (partition by feature, y order by v, key)),
nk as (select *, least({k}, n_class - 1) as k, list_sort(list_transform(list_filter(near, lambda z: z is not null), lambda z: {{'r': abs(z - v), 'v': z}})) as s
       from nn where n_class > 1),
nr as (select *, s[k].r as r, s[k].v as kv from nk),
nb as (select *, case when kv > v then v - r else kv end as lo, case when kv > v then kv else v + r end as hi from nr),
nm as (select b.feature, b.key, any_value(b.k) as k, any_value(b.n_class) as n_class, count(*) as m
       from nb b join nb o on o.feature = b.feature and o.v > b.lo and o.v < b.hi group by b.feature, b.key),
nmi as (select feature, case when max(n_class) < count(*) then greatest(0.0, {psi('count(*)')} + avg({psi('k')}) - avg({psi('n_class')}) - avg({psi('m')}))
        else 0.0 end as mi from nm group by feature)"""
