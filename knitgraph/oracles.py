"""The registered queries as SQL over the same tables, for checks in DuckDB.

Peeling is written as a recursive query whose state carries the round number.
Marker rows (an element without a cell) keep elements alive that have lost all
their cells, and one all-null row lets a graph peel down to nothing.
"""

from __future__ import annotations

SHIPMENTS = """
select distinct least(x, y) as src, greatest(x, y) as dst
from (with line as (select l_partkey * 3 as p, l_suppkey * 3 + 1 as s,
                           date_diff('day', date '1970-01-01', cast(l_shipdate as date)) * 3 + 2 as d
                    from lineitem)
      select p as x, s as y from line
      union all select p, d from line
      union all select s, d from line) as pairs
where x <> y"""

USERS = """
select distinct least(a.user_id, b.user_id) as src, greatest(a.user_id, b.user_id) as dst
from events a
join (select event_id - reach as follows, user_id, ts
      from events, (values (1), (2), (3)) as r(reach)) b on a.event_id = b.follows
where a.user_id <> b.user_id and b.ts <= a.ts + interval 1 minute"""

CUSTOMERS = """
select distinct least(a.o_custkey, b.o_custkey) as src, greatest(a.o_custkey, b.o_custkey) as dst
from orders a
join (select o_orderkey - reach as follows, o_custkey, o_orderpriority, o_orderstatus
      from orders, (values (1), (2), (3), (4)) as r(reach)) b
  on a.o_orderkey = b.follows and a.o_orderpriority = b.o_orderpriority
 and a.o_orderstatus = b.o_orderstatus
where a.o_custkey <> b.o_custkey"""



def _linked(rows: str) -> str:
    """All pairs of the ids x, y, z of each row, as 3x, 3y + 1 and 3z + 2."""
    return f"""
select distinct least(a, b) as src, greatest(a, b) as dst
from (with ids as (select x * 3 as x, y * 3 + 1 as y, z * 3 + 2 as z from ({rows}))
      select x as a, y as b from ids union all select x, z from ids union all select y, z from ids) as pairs"""


ORDERS = _linked("""select o_custkey as x, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as y,
       cast(substr(o_orderpriority, 1, 1) as bigint) as z from orders""")

EVENTS = _linked("""select user_id as x, cast(floor(epoch_us(ts) / 60000000) as bigint) as y,
       cast(ascii(event_type) as bigint) as z from events""")

GRAPHS = {
    "shipments": SHIPMENTS, "users": USERS, "customers": CUSTOMERS, "orders": ORDERS, "events": EVENTS,
}


def _edges(graph: str, name: str = "e") -> str:
    return f"{name} as materialized ({GRAPHS[graph]})"


def _degrees(graph: str) -> str:
    return f"""{_edges(graph)},
sym as (select src, dst from e union all select dst, src from e),
deg as materialized (select src as vertex, count(*) as degree from sym group by src)"""


def _oriented(graph: str) -> str:
    return f"""{_degrees(graph)},
ori as materialized (
  select case when up then src else dst end as low, case when up then dst else src end as high,
         case when up then ds else dd end as low_degree,
         case when up then dd else ds end as high_degree
  from (select e.src, e.dst, a.degree as ds, b.degree as dd,
               b.degree > a.degree or (b.degree = a.degree and e.dst > e.src) as up
        from e join deg a on a.vertex = e.src join deg b on b.vertex = e.dst))"""


def _directed(graph: str) -> str:
    return f"""{_oriented(graph)},
tri as materialized (
  select x.low, x.high as mid, y.high
  from ori x join ori y on x.high = y.low
  join ori z on z.low = x.low and z.high = y.high)"""


TRIANGLES = """t0 as materialized (
  select a.src as u, a.dst as v, b.dst as w
  from e a join e b on a.dst = b.src join e c on c.src = a.src and c.dst = b.dst)"""

SUPPORT = """(select src, dst, count(*) as support
 from (select u as src, v as dst from t0 union all select u, w from t0
       union all select v, w from t0) group by src, dst)"""


def _partners(graph: str) -> str:
    return f"""{_directed(graph)},
partners as (
  select least(low, mid) as src, greatest(low, mid) as dst, 'high' as role, high as third from tri
  union all select least(low, high), greatest(low, high), 'mid', mid from tri
  union all select least(mid, high), greatest(mid, high), 'low', low from tri)"""


# --- peeling ---------------------------------------------------------------


def _core_peel(graph: str, k: int, cap: int | None = None, edges: str = "e") -> str:
    bad = f"""(select u as x from peel where u is not null group by u having count(v) < {k})"""
    capped = "" if cap is None else f" and p.r < {cap}"
    return f"""{_edges(graph, edges)},
sym as (select src as u, dst as v from {edges} union all select dst, src from {edges}),
peel(r, u, v) as (
  select 0, u, v from (select u, v from sym union all select distinct u, null from sym
                       union all select null, null)
  union all
  select p.r + 1, p.u, p.v from peel p
  left join {bad} a on a.x = p.u
  left join {bad} c on c.x = p.v
  where a.x is null and c.x is null and exists (select 1 from {bad}){capped}),
rest as (select u, v from peel where r = (select max(r) from peel) and u is not null)"""


def _core_rest(graph: str, k: int) -> str:
    """Both directions of the edges of the k-core, as a query of its own over `e`."""
    return f"""with recursive {_core_peel(graph, k).replace(_edges(graph) + ",", "", 1)} select u, v from rest where v is not null"""


def core_subgraph(graph: str, k: int, cap: int | None = None) -> str:
    return f"""with recursive {_core_peel(graph, k, cap)}
select u as vertex, count(v) as degree from rest group by u"""


def core_edges(graph: str, k: int) -> str:
    return f"""with recursive {_core_peel(graph, k)}
select u as src, v as dst from rest where u < v"""


def core_rounds(graph: str, k: int) -> str:
    return f"""with recursive {_core_peel(graph, k)}
select cast(r + 1 as bigint) as round, count(*) as removed
from (select r, u from peel where u is not null group by r, u having count(v) < {k}) group by r"""


def _flat(table: str) -> str:
    """Edges of (u, v, w) rows; t is 0 for the marker rows of an edge."""
    return f"""(select u as x, v as y, case when w is null then 0 else 1 end as t, r from {table}
   union all select u, w, 1, r from {table} where w is not null
   union all select v, w, 1, r from {table} where w is not null)"""


def _truss_peel(graph: str, k: int) -> str:
    bad = f"""(select x, y from {_flat("peel")} where x is not null
   group by x, y having sum(t) < {k - 2})"""
    return f"""{_edges(graph)},
{TRIANGLES},
peel(r, u, v, w) as (
  select 0, u, v, w from (select u, v, w from t0
    union all select u, v, null from (select u, v from t0 union select u, w from t0
                                      union select v, w from t0)
    union all select null, null, null)
  union all
  select p.r + 1, p.u, p.v, p.w from peel p
  left join {bad} b1 on b1.x = p.u and b1.y = p.v
  left join {bad} b2 on b2.x = p.u and b2.y = p.w
  left join {bad} b3 on b3.x = p.v and b3.y = p.w
  where b1.x is null and b2.x is null and b3.x is null and exists (select 1 from {bad})),
rest as (select * from peel where r = (select max(r) from peel) and u is not null),
truss as (select x as src, y as dst, cast(sum(t) as bigint) as support
          from {_flat("rest")} group by x, y)"""


def truss_subgraph(graph: str, k: int) -> str:
    return f"""with recursive {_truss_peel(graph, k)} select src, dst, support from truss"""


def truss_edge_count(graph: str, k: int) -> str:
    return f"""with recursive {_truss_peel(graph, k)} select count(*) as edges from truss"""


def truss_triangles(graph: str, k: int) -> str:
    return f"""with recursive {_truss_peel(graph, k)}
select u as a, v as b, w as c from rest where w is not null"""


def _truss_partners(graph: str, k: int) -> str:
    """Third vertices of the triangles of the truss; roles by (degree, id) in the (k-1)-core."""
    return f"""{_truss_peel(graph, k)},
inner_sym as (select p.u, p.v from ({_core_rest(graph, k - 1)}) p),
inner_deg as materialized (select u as vertex, count(*) as degree from inner_sym group by u),
ranked as (
  select t.u, t.v, t.w, row(x.degree, t.u) as ru, row(y.degree, t.v) as rv, row(z.degree, t.w) as rw from rest t
  join inner_deg x on x.vertex = t.u join inner_deg y on y.vertex = t.v join inner_deg z on z.vertex = t.w where t.w is not null),
thirds as (
  select u as src, v as dst, w as third, (rw > ru)::int + (rw > rv)::int as above from ranked
  union all select u, w, v, (rv > ru)::int + (rv > rw)::int from ranked
  union all select v, w, u, (ru > rv)::int + (ru > rw)::int from ranked),
partners as (select src, dst, third, case above when 2 then 'high' when 1 then 'mid' else 'low' end as role from thirds)"""


def truss_partner_sizes(graph: str, k: int) -> str:
    return f"""with recursive {_truss_partners(graph, k)}
select src, dst, count(*) as support, count(*) filter (where role = 'high') as n_high,
       count(*) filter (where role = 'mid') as n_mid, count(*) filter (where role = 'low') as n_low
from partners group by src, dst"""


def _partner_lists(size: int) -> str:
    """Lists by role over `partners`, in parts of `size` consecutive third vertices."""
    return f"""select src, dst, cast((n - 1) // {size} as bigint) as part, max(support) as support,
       coalesce(string_agg(third, ',' order by third) filter (where role = 'high'), '') as high,
       coalesce(string_agg(third, ',' order by third) filter (where role = 'mid'), '') as mid,
       coalesce(string_agg(third, ',' order by third) filter (where role = 'low'), '') as low
from (select *, row_number() over (partition by src, dst order by third) as n,
             count(*) over (partition by src, dst) as support from partners)
group by src, dst, (n - 1) // {size}"""


def truss_partner_lists(graph: str, k: int, size: int) -> str:
    return f"with recursive {_truss_partners(graph, k)} {_partner_lists(size)}"


def truss_rounds(graph: str, k: int) -> str:
    return f"""with recursive {_truss_peel(graph, k)}
select cast(r + 1 as bigint) as round, count(*) as removed
from (select r, x, y from {_flat("peel")} where x is not null
      group by r, x, y having sum(t) < {k - 2}) group by r"""


# --- levels ----------------------------------------------------------------

INCIDENCE = """inc as materialized (
  select u as a, v as b, u as c, w as d, v as f, w as g from t0
  union all select u, w, u, v, v, w from t0
  union all select v, w, u, v, u, w from t0)"""


def _fix_point(edges: str) -> str:
    return f"""{edges},
{TRIANGLES},
{INCIDENCE},
it(r, a, b, tau, chg) as (
  select 0, a, b, count(*), true from inc group by a, b
  union all
  select r, a, b, h, bool_or(h <> old) over () from (
    select r + 1 as r, a, b, min(old) as old, max(least(m, rn)) as h from (
      select s.r, i.a, i.b, s.tau as old, least(x.tau, y.tau) as m,
             row_number() over (partition by i.a, i.b order by least(x.tau, y.tau) desc) as rn
      from inc i join it s on s.a = i.a and s.b = i.b
      join it x on x.a = i.c and x.b = i.d join it y on y.a = i.f and y.b = i.g where s.chg)
    group by r, a, b)),
levels as (select a as src, b as dst, tau from it where r = (select max(r) from it))"""


def _levels(graph: str, query: str) -> str:
    return f"with recursive {_fix_point(_edges(graph))} {query}"


def levels_in_core(graph: str, k: int) -> str:
    whole = _core_peel(graph, k, edges="whole")
    inner = f"{whole}, e as materialized (select u as src, v as dst from rest where u < v)"
    return f"with recursive {_fix_point(inner)} select src, dst, tau from levels"


ORACLES: dict[str, str] = {
    "adjacency_list_ranges": f"""with {_degrees('shipments')}
select vertex, cast((n - 1) // 50 as bigint) as part, max(degree) as degree, string_agg(dst, ',' order by dst) as neighbors
from (select s.src as vertex, s.dst, d.degree, row_number() over (partition by s.src order by s.dst) as n
      from sym s join deg d on d.vertex = s.src) group by vertex, (n - 1) // 50""",
    "triangle_partner_ranges": f"with {_partners('shipments')} {_partner_lists(50)}",
    "truss_subgraph_stripped": truss_subgraph("orders", 4),
    "truss_subgraph_stripped_shuffled": truss_subgraph("events", 4),
    "truss_levels_stripped": _levels("shipments", "select src, dst, tau from levels"),
    "truss_levels_stripped_shuffled": _levels("events", "select src, dst, tau from levels"),
    "truss_level_report": _levels(
        "events",
        """select tau, edges, cast(sum(edges) over () as bigint) as total
from (select tau, count(*) as edges from levels group by tau) order by tau limit 2""",
    ),
    "truss_partner_lists": truss_partner_lists("users", 5, 100_000),
    "truss_partner_lists_orders": truss_partner_lists("orders", 4, 50),
    "truss_partner_sizes_events": truss_partner_sizes("events", 4),
    "truss_triangles_orders": truss_triangles("orders", 4),
    "truss_subgraph_events_shuffled": truss_subgraph("events", 4),
    "core_subgraph_orders_shuffled": core_subgraph("orders", 6),
    "truss_levels_orders_shuffled": _levels("orders", "select src, dst, tau from levels"),
    "level_rounds_events": _levels(
        "events",
        """select cast(x.r as bigint) as round, count(*) filter (where x.tau <> y.tau) as changed
from it x join it y on y.a = x.a and y.b = x.b and y.r = x.r - 1 group by x.r""",
    ),
    "graph_shipments": SHIPMENTS,
    "graph_users": USERS,
    "graph_customers": CUSTOMERS,
    "graph_orders": ORDERS,
    "graph_events": EVENTS,
    "core_subgraph_orders": core_subgraph("orders", 6),
    "core_subgraph_events": core_subgraph("events", 3),
    "truss_subgraph_orders": truss_subgraph("orders", 4),
    "truss_subgraph_events": truss_subgraph("events", 4),
    "truss_levels_events": _levels("events", "select src, dst, tau from levels"),
    "edge_list_permissive": f"""select src, dst from ({USERS}) where src % 17 <> 0 and src % 19 <> 0""",
    "adjacency_lists_parts": f"""with {_degrees('shipments')}
select s.src as vertex, d.degree, s.dst as neighbor from sym s join deg d on d.vertex = s.src""",
    "triangle_list_salted": f"""with {_edges('shipments')}, {TRIANGLES}
select u as a, v as b, w as c from t0""",
    "core_subgraph_shuffled": core_subgraph("customers", 4),
    "core_subgraph_hubs_shuffled": core_subgraph("shipments", 36),
    "truss_subgraph_shuffled": truss_subgraph("users", 6),
    "truss_triangles": truss_triangles("users", 5),
    "truss_partner_sizes": truss_partner_sizes("users", 5),
    "truss_levels_shuffled": _levels("users", "select src, dst, tau from levels"),
    "level_rounds": _levels(
        "users",
        """select cast(x.r as bigint) as round, count(*) filter (where x.tau <> y.tau) as changed
from it x join it y on y.a = x.a and y.b = x.b and y.r = x.r - 1 group by x.r""",
    ),
    "edge_list_load": f"""with lines as (
  select case when src % 7 = 0 then '#' when dst % 13 = 0 then ' ' else '' end
         || src || chr(9) || dst || case when dst % 11 = 0 then chr(9) || '1' else '' end
         || case when src % 5 = 0 then '  ' else '' end as line
  from ({USERS})),
tokens as (select string_split_regex(rtrim(line), '[ \\t]+') as t from lines
           where not starts_with(line, '#'))
select distinct least(cast(t[1] as bigint), cast(t[2] as bigint)) as src,
       greatest(cast(t[1] as bigint), cast(t[2] as bigint)) as dst
from (select t from tokens where len(t) = 2 and t[1] <> '') where t[1] <> t[2]""",
    "symmetric_edges": f"with {_degrees('users')} select src, dst from sym",
    "vertex_degree": f"with {_degrees('shipments')} select vertex, degree from deg",
    "adjacency_lists": f"""with {_degrees('shipments')}
select src as vertex, cast(0 as bigint) as part, count(*) as degree,
       string_agg(dst, ',' order by dst) as neighbors
from sym group by src""",
    "oriented_edges": f"""with {_oriented('shipments')}
select low, high, low_degree, high_degree from ori""",
    "ordered_adjacency": f"""with {_oriented('shipments')}
select d.vertex, d.degree, coalesce(h.higher, '') as higher
from deg d left join (select low, string_agg(high, ',' order by high_degree, high) as higher
                      from ori group by low) h on h.low = d.vertex""",
    "wedge_candidates": f"""with {_oriented('users')}
select a.low, a.high as mid, string_agg(b.high, ',' order by b.high) as candidates
from ori a join ori b on a.low = b.low
 and (b.high_degree > a.high_degree or (b.high_degree = a.high_degree and b.high > a.high))
group by a.low, a.high""",
    "triangle_list": f"""with {_edges('shipments')}, {TRIANGLES}
select u as a, v as b, w as c from t0""",
    "triangle_count": f"""with {_edges('shipments')}, {TRIANGLES}
select count(*) as triangles from t0""",
    "edge_support": f"""with {_edges('shipments')}, {TRIANGLES}
select src, dst, support from {SUPPORT}""",
    "triangle_edge_count": f"""with {_edges('customers')}, {TRIANGLES}
select count(*) as edges from {SUPPORT}""",
    "triangle_partners": f"""with {_partners('users')}
select src, dst, role, third from partners""",
    "triangle_partner_lists": f"""with {_partners('users')}
select src, dst, cast(0 as bigint) as part, count(*) as support,
       coalesce(string_agg(third, ',' order by third) filter (where role = 'high'), '') as high,
       coalesce(string_agg(third, ',' order by third) filter (where role = 'mid'), '') as mid,
       coalesce(string_agg(third, ',' order by third) filter (where role = 'low'), '') as low
from partners group by src, dst""",
    "triangle_partner_sizes": f"""with {_partners('shipments')}
select src, dst, count(*) as support,
       count(*) filter (where role = 'high') as n_high,
       count(*) filter (where role = 'mid') as n_mid,
       count(*) filter (where role = 'low') as n_low
from partners group by src, dst""",
    "core_subgraph_3": core_subgraph("customers", 3),
    "core_subgraph_4": core_subgraph("customers", 4),
    "core_subgraph_vanishing": core_subgraph("customers", 6),
    "core_subgraph_hubs": core_subgraph("shipments", 36),
    "core_subgraph_capped": core_subgraph("customers", 4, cap=2),
    "core_subgraph_unpeeled": f"with {_degrees('customers')} select vertex, degree from deg",
    "core_edges": core_edges("customers", 4),
    "core_rounds": core_rounds("customers", 4),
    "truss_subgraph_4": truss_subgraph("shipments", 4),
    "truss_subgraph_5": truss_subgraph("shipments", 5),
    "truss_subgraph_6": truss_subgraph("users", 6),
    "truss_subgraph_vanishing": truss_subgraph("users", 8),
    "truss_subgraph_prefiltered": truss_subgraph("customers", 4),
    "truss_subgraph_no_prefilter": truss_subgraph("customers", 4),
    "truss_subgraph_part_prefilter": truss_subgraph("customers", 4),
    "truss_edge_count": truss_edge_count("users", 5),
    "truss_rounds": truss_rounds("users", 6),
    "truss_levels": _levels("users", "select src, dst, tau from levels"),
    "truss_levels_hubs": _levels("shipments", "select src, dst, tau from levels"),
    "truss_levels_in_core": levels_in_core("customers", 4),
    "level_histogram_per_edge": f"""with {_edges('users')}, {TRIANGLES},
sup as materialized {SUPPORT},
low as (select u, v, w, least(x.support, y.support, z.support) as value from t0
        join sup x on x.src = u and x.dst = v join sup y on y.src = u and y.dst = w
        join sup z on z.src = v and z.dst = w)
select src, dst, value, count(*) as triangles
from (select u as src, v as dst, value from low union all select u, w, value from low
      union all select v, w, value from low) group by src, dst, value""",
    "level_step": f"""with {_edges('shipments')}, {TRIANGLES}, {INCIDENCE},
sup as materialized {SUPPORT},
ranked as (select a, b, least(x.support, y.support) as m,
                  row_number() over (partition by a, b order by least(x.support, y.support) desc) as rn
           from inc join sup x on x.src = c and x.dst = d join sup y on y.src = f and y.dst = g)
select a as src, b as dst, max(least(m, rn)) as level from ranked group by a, b""",
    "truss_level_histogram": _levels(
        "shipments", "select tau, count(*) as edges from levels group by tau"
    ),
    "truss_level_histogram_top": _levels(
        "users", "select tau, count(*) as edges from levels group by tau order by tau limit 2"
    ),
    "truss_level_total": _levels("users", "select count(*) as edges from levels"),
    "truss_settled_below": _levels("users", "select src, dst, tau from levels where tau < 3"),
    "truss_remaining": _levels("users", "select src, dst, tau from levels where tau >= 3"),
}
