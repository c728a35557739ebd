"""DuckDB SQL for the registered queries: the same results by other means.

Loops are unrolled into chains of common table expressions or bounded recursion.
"""

from __future__ import annotations

from ..functions.stats import critical_correlation

RAW = """raw as (
  select lpad(cast(s_nationkey as varchar), 2, '0') as src, lpad(cast(c_nationkey as varchar), 2, '0') as dst,
         l_extendedprice * (1 - l_discount) as v, l_orderkey, l_linenumber
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)"""
#: The delivery network: each supplier is exposed to the next of the same part on the same day.
TRADE = """lines as (
  select lpad(cast(l_suppkey as varchar), 8, '0') as dst, l_extendedprice as v,
         lag(lpad(cast(l_suppkey as varchar), 8, '0')) over (partition by l_partkey, cast(l_shipdate as date) order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as src
  from lineitem),
te as materialized (select src, dst, round(sum(v) / 1e4, 6) as w from lines where src is not null and src <> dst group by src, dst),
tv as materialized (select src as id from te union select dst from te)"""
UND = """,
und as materialized (select least(src, dst) as a, greatest(src, dst) as b, arg_max(w, src) as w from te group by 1, 2),
arcs as materialized (select a as src, b as dst, w from und union all select b, a, w from und where a <> b)"""
SEEDS = """,
seeds as materialized (select dst as id from (select dst, count(*) as n from te group by dst order by n desc, dst limit 3))"""
COSHIP = TRADE + UND
MONTHLY = """ret as materialized (
  select date_trunc('month', o_orderdate) as t, lpad(cast(c_nationkey as varchar), 2, '0') as asset, round(sum(o_totalprice) / 1e6, 6) as r
  from orders join customer on o_custkey = c_custkey where o_orderdate < timestamp '2001-08-01' group by 1, 2)"""


def _events(unit: str) -> str:
    return f"""ret0 as (select date_trunc('{unit}', ts) as t, event_type as asset, round(sum(coalesce(value, 0.0)), 6) as r from events group by 1, 2),
ret as materialized (select t, asset, r from (select *, count(*) over (partition by t) as here from ret0) where here = (select count(distinct asset) from ret0))"""


LAYERS = """e as (select event_type as layer, ts, event_id, lpad(cast(user_id as varchar), 8, '0') as u from events),
p as (select layer, u, lag(u) over (partition by layer order by ts, event_id) as v from e),
lay as materialized (select layer, least(u, v) as src, greatest(u, v) as dst, count(*)::double as w from p where v is not null and u <> v group by 1, 2, 3),
lv as materialized (select src as id from lay union select dst from lay)"""

MONTHLY_EDGES = MONTHLY + """,
me as materialized (
  select a.asset as a, b.asset as b, round(corr(a.r, b.r), 6) as w from ret a join ret b on a.t = b.t and a.asset < b.asset
  group by 1, 2 having count(*) >= 4 and corr(a.r, b.r) is not null and not isnan(corr(a.r, b.r)))"""
DISTANCE = "round(round(sqrt(2 * (1 - greatest(-1.0, least(1.0, w)))), 6), 6)"


def _bfs(edges: str, vertices: str, depth: int) -> str:
    """``dist(root, id, d)``."""
    parts = [f"b0 as materialized (select id as root, id, 0 as d from {vertices})"]
    for k in range(1, depth + 1):
        parts.append(f"b{k} as materialized (select root, id, d from b{k - 1} union all select distinct b.root, e.dst, {k} from b{k - 1} b join {edges} e on e.src = b.id where b.d = {k - 1} and not exists (select 1 from b{k - 1} x where x.root = b.root and x.id = e.dst))")
    return ",\n".join([*parts, f"dist as (select * from b{depth})"])


def _contagion(threshold: float, own: str, other: str, rounds: int) -> str:
    """``failed(id, step)``."""
    parts = [f"tot as materialized (select {own} as id, sum(w) as total from te group by 1 having sum(w) > 0)", "f0 as materialized (select id, 0 as step from seeds)"]
    for k in range(1, rounds + 1):
        parts.append(
            f"f{k} as materialized (select id, step from f{k - 1} union all select h.id, {k} from (select te.{own} as id, sum(te.w) as lost from te join f{k - 1} f on te.{other} = f.id group by 1) h "
            f"join tot using (id) where h.lost / tot.total >= {threshold} and h.id not in (select id from f{k - 1}))"
        )
    return ",\n".join([*parts, f"failed as (select * from f{rounds})"])


def _cascade(rounds: int) -> str:
    parts = [
        "cap as materialized (select tv.id, round((0.10 + 0.20 * (((cast(tv.id as bigint) * 37) % 100) / 100.0)::double) * (coalesce(o.out, 0.0) + 10), 2) as capital from tv left join (select src as id, sum(w) as out from te group by 1) o using (id))",
        "f0 as materialized (select id, 0 as step from seeds)",
    ]
    for k in range(1, rounds + 1):
        parts.append(f"l{k} as materialized (select te.src as id, sum(te.w) as loss, max(case when f.step = {k - 1} then 1 else 0 end) as hit from te join f{k - 1} f on te.dst = f.id group by 1)")
        parts.append(f"f{k} as materialized (select id, step from f{k - 1} union all select l.id, {k} from l{k} l join cap using (id) where l.hit = 1 and l.loss >= cap.capital and l.id not in (select id from f{k - 1}))")
    return ",\n".join(parts)


def _chain(first: str, step: str, rounds: int) -> str:
    """CTEs x0..xN; ``step`` refers to the one before as ``{p}``."""
    return ",\n".join([f"x0 as materialized ({first})", *[f"x{k} as materialized ({step.format(p=f'x{k - 1}')})" for k in range(1, rounds + 1)]])


PAGERANK = "with " + TRADE + """,
n as (select count(*)::double as n from tv), out as (select src, sum(w) as total from te group by 1),
wn as materialized (select te.src, te.dst, te.w / out.total as w from te join out using (src)),
""" + _chain(
    "select id, 1.0 / n.n as x from tv, n",
    "select v.id, 0.85 * (coalesce(s.s, 0.0) + (select coalesce(sum(x), 0.0) from {p} where id not in (select src from wn)) / n.n) + 0.15 / n.n as x from tv v cross join n left join (select wn.dst as id, sum(p.x * wn.w) as s from wn join {p} p on p.id = wn.src group by 1) s using (id)",
    10,
) + " select id, round(x, 6) as pagerank from x10"

EIGENVECTOR = "with " + TRADE + UND + ",\n" + _chain(
    "select id, 1.0 / (select count(*) from tv) as x from tv",
    "select id, y / sqrt(sum(y * y) over ()) as x from (select p.id, p.x + coalesce(s.s, 0.0) as y from {p} p left join (select a.dst as id, sum(q.x) as s from arcs a join {p} q on q.id = a.src group by 1) s using (id))",
    10,
) + " select id, round(x, 6) as eigenvector from x10"

KATZ = "with " + TRADE + ",\n" + _chain(
    "select id, 1.0 as x from tv",
    "select v.id, 0.001 * coalesce(s.s, 0.0) + 1 as x from tv v left join (select te.dst as id, sum(p.x * te.w) as s from te join {p} p on p.id = te.src group by 1) s using (id)",
    10,
) + " select id, round(x / sqrt(sum(x * x) over ()), 6) as katz from x10"

DEBTRANK = "with " + TRADE + SEEDS + """,
wn as materialized (select te.src, te.dst, te.w / o.total as w from te join (select src, sum(w) as total from te group by 1) o using (src)),
""" + _chain(
    "select tv.id, case when s.id is not null then 0.5 else 0.0 end as h, case when s.id is not null then 0.5 else 0.0 end as prev from tv left join seeds s using (id)",
    "select p.id, least(1.0, p.h + coalesce(i.impact, 0.0)) as h, p.h as prev from {p} p left join (select wn.dst as id, sum(wn.w * q.prev) as impact from wn join {p} q on q.id = wn.src group by 1) i using (id)",
    5,
) + " select id, round(h, 6) as h from x5"

#: Rounds that loops are unrolled to; more than any needs at the scales the SQL is run at.
DEPTH, SPREAD = 20, 20

DEGREES = """deg as (select tv.id, coalesce(o.n, 0)::bigint as out_degree, coalesce(i.n, 0)::bigint as in_degree, coalesce(o.s, 0.0) as out_strength, coalesce(i.s, 0.0) as in_strength
  from tv left join (select src as id, count(*) as n, sum(w) as s from te group by 1) o using (id) left join (select dst as id, count(*) as n, sum(w) as s from te group by 1) i using (id)),
nn as (select count(*)::double as n from tv)"""

TRIANGLES = """ud as (select id, count(*) as k from (select src as id from arcs) group by id),
tri as (select x.src as id, count(*) / 2 as t from arcs x join arcs y on x.src = y.src and x.dst <> y.dst join arcs z on z.src = x.dst and z.dst = y.dst group by 1)"""

SLIDE = MONTHLY + """,
rt as materialized (select *, dense_rank() over (order by t) - 1 as k from ret),
tt as (select max(k) + 1 as total from rt),
spread0 as (select rt.asset, rt.r, rt.k, rt.t, s.snap_id from rt, tt, range(0, 100) s(snap_id) where s.snap_id * 6 <= total - 36 and {inside}),
whole as materialized (select * from (select *, count(*) over (partition by snap_id, k) as here from spread0) z where here = (select count(distinct asset) from spread0 y where y.snap_id = z.snap_id)),
ok as (select snap_id from whole group by 1 having count(distinct k) >= {least}),
snap_edges as materialized (select a.snap_id, a.asset as a, b.asset as b, round(corr(a.r, b.r), 6) as weight, corr(a.r, b.r) as c from whole a join whole b on a.snap_id = b.snap_id and a.k = b.k and a.asset < b.asset where a.snap_id in (select snap_id from ok) group by 1, 2, 3 having abs(corr(a.r, b.r)) >= 0.3)"""
SLIDING = SLIDE.format(inside="rt.k between s.snap_id * 6 and s.snap_id * 6 + 35", least=30)
EXPANDING = SLIDE.format(inside="rt.k < 36 + s.snap_id * 6", least=36)

RANKS = """pr as (select a.asset as a, b.asset as b, a.r as x, b.r as y from ret a join ret b on a.t = b.t and a.asset < b.asset),
rk as (select a, b, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2.0 as x, rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2.0 as y from pr)"""

Z = """s as (select date_trunc('day', ts) as ts, count(*)::double as value from events group by 1),
z as (select ts, value, case when count(*) over w >= 3 then (value - avg(value) over w) / (coalesce(stddev_samp(value) over w, 0) + 1e-9) end as z from s window w as (order by ts rows between 9 preceding and current row))"""


def _between(depth: int) -> str:
    """``b(v, s)``: dependencies on each vertex, from distances ``dist`` and the numbers of shortest paths."""
    counts = [f"s{k} as materialized (select s.root, a.dst as id, sum(s.c) as c from s{k - 1} s join arcs a on a.src = s.id join dm on dm.root = s.root and dm.id = a.dst and dm.d = {k} group by 1, 2)" for k in range(1, depth + 1)]
    together = " union all ".join(f"select * from s{k}" for k in range(depth + 1))
    return ",\n".join(["dm as materialized (select * from dist)", "s0 as materialized (select id as root, id, 1.0::double as c from tv)", *counts, f"sg as materialized ({together})"]) + """,
ds as materialized (select dm.root, dm.id, dm.d, sg.c from dm join sg using (root, id)),
b as (select x.id as v, sum(x.c * y.c / st.c) as s from ds st join ds x on x.root = st.root join ds y on y.root = x.id and y.id = st.id where st.d > 0 and x.id <> st.root and x.id <> st.id and x.d + y.d = st.d group by 1)"""


CORENESS = "with " + TRADE + UND + ",\nnear as materialized (select src as id, dst as other from arcs where src <> dst),\n" + _chain(
    "select tv.id, count(n.other) as x from tv left join near n using (id) group by 1",
    "select p.id, least(p.x, coalesce(h.h, 0)) as x from {p} p left join (select id, max(least(x, k)) as h from (select n.id, q.x, row_number() over (partition by n.id order by q.x desc) as k from near n join {p} q on q.id = n.other) group by 1) h using (id)",
    DEPTH,
)


def _mst() -> str:
    return "with recursive " + MONTHLY_EDGES + f""",
ranked as materialized (select a as src, b as dst, {DISTANCE} as distance, row_number() over (order by {DISTANCE}, a, b) as k from me),
ways as materialized (select src, dst, k from ranked union all select dst, src, k from ranked),
reach as (select k as e, src as id from ranked union select r.e, b.dst from reach r join ways b on b.src = r.id and b.k < r.e)
select src, dst, distance from ranked where not exists (select 1 from reach where reach.e = ranked.k and reach.id = ranked.dst)"""


def _attack(order: str = "select 1 as trial, id, row_number() over (order by k desc, id) as rank from ud") -> str:
    """The removal curve, averaged over the trials of ``order(trial, id, rank)``."""
    return "with recursive " + TRADE + UND + f""",
ud as (select tv.id, coalesce(count(a.src), 0) as k from tv left join arcs a on a.src = tv.id group by 1),
ord as materialized ({order}),
nv as (select count(*) as n from tv),
e as materialized (select x.trial, least(x.rank, y.rank) as lo, greatest(x.rank, y.rank) as hi from und join ord x on x.id = und.a join ord y on y.id = und.b and y.trial = x.trial),
two as materialized (select trial, lo as s, hi as t, lo as low from e union all select trial, hi, lo, lo from e),
reach as (select c.trial, c.rank as cut, o.rank as root, o.rank as id from ord c join ord o on o.trial = c.trial and o.rank > c.rank
  union select r.trial, r.cut, r.root, two.t from reach r join two on two.trial = r.trial and two.s = r.id and two.low > r.cut),
sizes as (select trial, cut, root, count(*) as n from reach group by 1, 2, 3),
best as (select trial, cut, max(n) as n from sizes group by 1, 2),
edges_left as (select c.trial, c.rank as cut, count(e.lo) as m from ord c left join e on e.trial = c.trial and e.lo > c.rank group by 1, 2)
select round(c.rank::double / any_value(nv.n), 4) as fraction_removed, round(avg(coalesce(best.n, 0)::double / nv.n), 6) as lcc, round(avg(m), 6) as edges
from ord c cross join nv join edges_left l on l.trial = c.trial and l.cut = c.rank left join best on best.trial = c.trial and best.cut = c.rank group by c.rank"""


RANDOM_ORDER = "select trial, id, row_number() over (partition by trial order by md5('42|' || trial || '|' || id) desc, id) as rank from tv, range(1, 6) t(trial)"


def _fragility() -> str:
    return "with curve as (" + _attack() + """),
s as (select *, lag(fraction_removed) over (order by fraction_removed) as pf, lag(lcc) over (order by fraction_removed) as pl from curve)
select round(sum((fraction_removed - pf) * (lcc + pl) / 2), 4) as nfi, coalesce(min(case when lcc < 0.5 then fraction_removed end), 1.0) as critical_fraction, round(sum(lcc) / (select count(*) from curve), 4) as r from s"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o["edge_load_sum"] = f"with {RAW} select src, dst, round(sum(v / 1e6), 6) as exposure from raw group by 1, 2"
    o["edge_load_last"] = f"with {RAW} select src, dst, round(v, 6) as weight from (select *, row_number() over (partition by src, dst order by l_orderkey desc, l_linenumber desc, v desc) as rn from raw) where rn = 1"
    o["capital_buffer"] = f"with {TRADE} select tv.id, round((0.10 + 0.20 * (((cast(tv.id as bigint) * 37) % 100) / 100.0)::double) * (coalesce(o.out, 0.0) + 10), 2) as capital from tv left join (select src as id, sum(w) as out from te group by 1) o using (id)"
    o["degree_metrics"] = f"with {TRADE}, {DEGREES} select id, in_degree + out_degree as degree, in_degree, out_degree, round((in_degree + out_degree) / (n - 1), 6) as degree_centrality, round(in_strength, 6) as in_strength, round(out_strength, 6) as out_strength from deg, nn"
    o["global_basic"] = f"with {TRADE}, {DEGREES} select count(*)::bigint as n_nodes, (select count(*) from te)::bigint as n_edges, round((select count(*) from te) / (count(*) * (count(*) - 1))::double, 6) as density, round(avg(in_degree + out_degree), 6) as avg_degree, max(in_degree + out_degree)::bigint as max_degree, round(stddev_pop(in_degree + out_degree) / (avg(in_degree + out_degree) + 1e-9), 6) as degree_heterogeneity, round(avg(in_strength + out_strength), 6) as avg_strength from deg"
    o["clustering"] = f"with {COSHIP}, {TRIANGLES} select tv.id, round(case when coalesce(k, 0) < 2 then 0.0 else 2 * coalesce(t, 0) / (k * (k - 1))::double end, 6) as clustering from tv left join ud using (id) left join tri using (id)"
    o["transitivity"] = f"with {COSHIP}, {TRIANGLES} select round((select sum(t) from tri) / (select sum(k * (k - 1) / 2.0) from ud), 6) as transitivity"
    o["assortativity"] = f"with {COSHIP}, ud as (select src as id, count(*)::double as k from arcs group by 1) select round(corr(x.k, y.k), 6) as degree_assortativity from arcs join ud x on x.id = arcs.src join ud y on y.id = arcs.dst"
    o["components"] = "with recursive " + COSHIP + ", reach as (select id as root, id from tv union select r.root, a.dst from reach r join arcs a on a.src = r.id) select root as id, min(id) as component from reach group by 1"
    bfs = "with " + TRADE + ",\n" + _bfs("te", "tv", DEPTH)
    o["bfs_paths"] = bfs + " select root, id, d::bigint as dist from dist"
    o["closeness"] = bfs + " select tv.id, round(coalesce((count(d.d) / sum(d.d)::double) * (count(d.d) / ((select count(*) from tv) - 1)::double), 0.0), 6) as closeness from tv left join (select * from dist where d > 0) d on d.id = tv.id group by 1"
    o["harmonic"] = bfs + " select tv.id, round(coalesce(sum(1.0 / d.d), 0.0), 6) as harmonic from tv left join (select * from dist where d > 0) d on d.id = tv.id group by 1"
    und_bfs = "with " + TRADE + UND + ",\n" + _bfs("arcs", "tv", DEPTH)
    o["path_length"] = und_bfs + """,
comp as (select root as id, min(id) as c from dist group by 1), sz as (select c, count(*) as n from comp group by 1), big as (select c, n from sz order by n desc, c limit 1),
dd as (select d.d from dist d join comp on comp.id = d.root join big on big.c = comp.c where d.d > 0)
select (select count(*) from sz)::bigint as n_components, round((select n from big)::double / (select count(*) from tv), 6) as lcc_fraction, (select max(d) from dd)::bigint as diameter, round((select avg(d) from dd), 6) as avg_path_length"""
    o["pagerank_k"], o["eigenvector_k"], o["katz_k"], o["debtrank_k"] = PAGERANK, EIGENVECTOR, KATZ, DEBTRANK
    o["top_influential"] = f"""with {TRADE}, {DEGREES}, long as (select id, 'degree' as metric, (in_degree + out_degree)::double as value from deg union all select id, 'in_degree', in_degree::double from deg union all select id, 'in_strength', in_strength from deg)
select metric, rank, id, round(value, 6) as value from (select *, row_number() over (partition by metric order by value desc, id) as rank from long) where rank <= 5"""
    o["modularity"] = f"""with {TRADE}{UND}, pt as (select lpad(cast(s_suppkey as varchar), 8, '0') as id, s_nationkey as c from supplier),
ee as (select x.c as ca, y.c as cb, w from und join pt x on x.id = und.a join pt y on y.id = und.b), m as (select sum(w) as m from ee),
inside as (select ca as c, sum(w) as i from ee where ca = cb group by 1), ends as (select c, sum(w) as d from (select ca as c, w from ee union all select cb, w from ee) group by 1)
select round(sum(coalesce(i, 0.0) / m - (d / (2 * m)) * (d / (2 * m))), 6) as q from ends left join inside using (c), m"""
    o["attack_curve"], o["fragility"] = _attack(), _fragility()
    base = "with " + TRADE + SEEDS + ",\n"
    o["contagion_threshold"] = base + _contagion(0.4, "src", "dst", SPREAD) + " select id, step::bigint as step from failed"
    o["contagion_legacy"] = base + _contagion(0.3, "dst", "src", 10) + " select id, step::bigint as step from failed"
    o["failures_over_time"] = base + _contagion(0.4, "src", "dst", SPREAD) + ", c as (select step + 1 as step, count(*) as n from failed group by 1) select step::bigint as step, n::bigint as new, sum(n) over (order by step)::bigint as cumulative from c"
    o["balance_sheet_cascade"] = base + _cascade(SPREAD) + f" select id, f.step::bigint as step, round(coalesce(l.loss, 0.0), 6) as loss from f{SPREAD} f full outer join l{SPREAD} l using (id)"
    o["contagion_index"] = bfs + " select tv.id, round(round(count(d.d) / (select count(*) from tv)::double, 6), 6) as contagion_index from tv left join (select * from dist where d > 0) d on d.root = tv.id group by 1"
    o["shock_topk"] = f"with {TRADE}, {DEGREES} select id, row_number() over (order by in_degree + out_degree desc, id)::bigint as rank from deg order by in_degree + out_degree desc, id limit 5"
    o["survivor_subgraph"] = base + _contagion(0.8, "src", "dst", SPREAD) + " select src, dst from te where src not in (select id from failed) and dst not in (select id from failed)"
    o["pearson_graph"] = f"with {MONTHLY} select a.asset as a, b.asset as b, round(corr(a.r, b.r), 6) as weight, count(*)::bigint as n_obs from ret a join ret b on a.t = b.t and a.asset < b.asset group by 1, 2 having count(*) >= 30 and abs(corr(a.r, b.r)) >= 0.2"
    o["spearman_graph"] = f"with {MONTHLY}, {RANKS} select a, b, round(corr(x, y), 6) as weight, count(*)::bigint as n_obs from rk group by 1, 2 having count(*) >= 30 and abs(corr(x, y)) >= 0.2"
    o["distance_graph"] = f"with {MONTHLY_EDGES} select a, b, w as weight, {DISTANCE} as distance from me"
    o["topk_sparsify"] = f"with {MONTHLY_EDGES} select a as src, b as dst, w as weight from (select *, row_number() over (order by abs(w) desc, a, b) as k, count(*) over () as n from me) where k <= greatest(1, floor(n * 0.2))"
    o["mst"] = _mst()
    o["bh_adjust"] = "with s as (select s_suppkey, (((s_suppkey * 7919) % 100003) + 1) / 100003.0::double as p from supplier) select s_suppkey, round(p, 6) as p_value, round(least(1.0, p * count(*) over () / row_number() over (order by p)), 6) as p_adj from s"
    o["mi_hist"] = f"""with {_events('hour')},
cells as (select t, asset, case when hi > lo then least(floor((r - lo) / (hi - lo) * 10), 9) else 0 end as c from (select *, min(r) over (partition by asset) as lo, max(r) over (partition by asset) as hi from ret)),
j as (select a.asset as a, b.asset as b, a.c as x, b.c as y, count(*)::double as c from cells a join cells b on a.t = b.t and a.asset < b.asset group by 1, 2, 3, 4),
m as (select *, sum(c) over (partition by a, b) as n, sum(c) over (partition by a, b, x) as cx, sum(c) over (partition by a, b, y) as cy from j)
select a, b, round(greatest(sum(c / n * ln(c * n / (cx * cy))), 0.0), 6) as mi from m group by a, b having max(n) >= 60"""
    o["transfer_entropy"] = f"""with {_events('hour')},
l as (select t, asset, r as x0, lead(r) over w as x1, lead(r, 2) over w as x2 from ret window w as (partition by asset order by t)),
s as (select t, asset, (x0 > x1)::int::varchar || (x0 > x2)::int::varchar || (x1 > x2)::int::varchar as sym from l where x2 is not null),
s2 as (select *, lead(sym) over (partition by asset order by t) as nxt from s),
c as (select x.asset as src, y.asset as dst, y.nxt as yf, y.sym as yp, x.sym as xp, count(*)::double as c from s2 x join s2 y on x.t = y.t and x.asset <> y.asset where y.nxt is not null group by 1, 2, 3, 4, 5),
m as (select *, sum(c) over (partition by src, dst) as n, sum(c) over (partition by src, dst, yp) as a, sum(c) over (partition by src, dst, yf, yp) as b, sum(c) over (partition by src, dst, yp, xp) as d from c)
select src, dst, round(greatest(sum(c / n * ln(c * a / (b * d))), 0.0), 6) as te from m group by src, dst having max(n) + 3 >= 100"""
    o["layer_union"] = f"with {LAYERS} select layer, src, dst, w as weight from lay"
    o["layer_summary"] = f"""with {LAYERS}, en as (select layer, count(distinct id) as nodes from (select layer, src as id from lay union all select layer, dst from lay) group by 1), ec as (select layer, count(*) as edges from lay group by 1)
select layer, nodes::bigint as nodes, edges::bigint as edges, round(edges / (nodes * (nodes - 1) / 2.0), 6) as density, round(2 * edges / nodes::double, 4) as avg_degree from en join ec using (layer)"""
    supra = f"""with {LAYERS}, vi as materialized (select id, row_number() over (order by id) - 1 as o from lv), li as materialized (select layer, row_number() over (order by layer) - 1 as k from (select distinct layer from lay)), nv as (select count(*) as n from lv),
ad as (select layer, src, dst, w from lay union all select layer, dst, src, w from lay),
sa as materialized (select (k * n + x.o)::bigint as i, (k * n + y.o)::bigint as j, w as v from ad join li using (layer) join vi x on x.id = ad.src join vi y on y.id = ad.dst, nv
  union all select (p.k * n + o)::bigint, (q.k * n + o)::bigint, 1.0 from vi, li p, li q, nv where p.k <> q.k)"""
    o["supra_adjacency"] = supra + " select i, j, v from sa"
    o["supra_laplacian"] = supra + " select i, j, -v as v from sa union all select i, i, sum(v) from sa group by i"
    o["fuse_weighted"] = f"""with {LAYERS}, nl as (select count(distinct layer)::double as n from lay), m as (select *, max(w) over (partition by layer) as top from lay)
select src as a, dst as b, round(sum(w / top / n), 6) as weight from m, nl group by 1, 2 having sum(w / top * (1 / n)) > 0.05"""
    o["fuse_intersection"] = f"with {LAYERS} select src as a, dst as b, round(round(avg(w), 6), 6) as weight, count(*)::bigint as layer_count from lay group by 1, 2 having count(*) >= 2"
    o["layer_jaccard"] = f"""with {LAYERS}, n as (select layer, count(*) as n from lay group by 1), b as (select x.layer as l1, y.layer as l2, count(*) as c from lay x join lay y using (src, dst) group by 1, 2)
select x.layer as l1, y.layer as l2, round(coalesce(c, 0) / (x.n + y.n - coalesce(c, 0))::double, 6) as jaccard from n x cross join n y left join b on b.l1 = x.layer and b.l2 = y.layer"""
    o["layer_degree_corr"] = f"""with {LAYERS}, d0 as (select layer, id, count(*) as d from (select layer, src as id from lay union all select layer, dst from lay) group by 1, 2),
d as (select l.layer, lv.id, coalesce(d0.d, 0)::double as d from (select distinct layer from lay) l cross join lv left join d0 on d0.layer = l.layer and d0.id = lv.id)
select x.layer as l1, y.layer as l2, round(corr(x.d, y.d), 6) as corr from d x join d y using (id) group by 1, 2"""
    o["sliding_corr"] = f"with {SLIDING} select snap_id, a, b, weight from snap_edges"
    o["expanding_corr"] = f"with {EXPANDING} select snap_id, a, b, weight from snap_edges"
    o["temporal_degree"] = f"""with {SLIDING}, d as (select snap_id, id, count(*) as d from (select snap_id, a as id from snap_edges union all select snap_id, b from snap_edges) group by 1, 2),
v as (select distinct s.snap_id, r.asset as id from spread0 s, (select distinct asset from ret) r)
select v.snap_id, v.id, round(coalesce(d.d, 0) / ((select count(distinct asset) from ret) - 1)::double, 6) as value from v left join d on d.snap_id = v.snap_id and d.id = v.id"""
    o["structural_breaks"] = f"with {Z} select strftime(ts, '%Y-%m-%d') as ts, value, round(z, 6) as z from z where abs(z) > 1.5"
    o["anomaly_flags"] = f"with {Z} select strftime(ts, '%Y-%m-%d') as ts, round(z, 6) as z, coalesce(abs(z) > 2.0, false) as flag from z"
    o["ewm_corr"] = f"""with {_events('day')},
pr as materialized (select a.asset as a, b.asset as b, a.r as x, b.r as y, row_number() over (partition by a.asset, b.asset order by a.t) as k from ret0 a join ret0 b on a.t = b.t and a.asset < b.asset),
m as (select p.a, p.b, p.k, sum(case when q.k = 1 then 1.0::double else 0.06::double end * power(0.94::double, p.k - q.k) * q.x) as mx, sum(case when q.k = 1 then 1.0::double else 0.06::double end * power(0.94::double, p.k - q.k) * q.y) as my
  from pr p join pr q on p.a = q.a and p.b = q.b and q.k <= p.k group by 1, 2, 3),
n as (select a, b, max(k) as n from pr group by 1, 2),
d as (select pr.a, pr.b, pr.k, pr.x - m.mx as dx, pr.y - m.my as dy from pr join m on pr.a = m.a and pr.b = m.b and m.k = pr.k - 1),
v as (select n.a, n.b, coalesce(sum(0.06::double * power(0.94::double, n - k) * dx * dx), 0) + power(0.94::double, max(n) - 1) * 0.01 as xx, coalesce(sum(0.06::double * power(0.94::double, n - k) * dy * dy), 0) + power(0.94::double, max(n) - 1) * 0.01 as yy,
  coalesce(sum(0.06::double * power(0.94::double, n - k) * dx * dy), 0) as xy from n left join d on n.a = d.a and n.b = d.b group by 1, 2)
select a, b, round(xy / ((sqrt(xx) + 1e-9) * (sqrt(yy) + 1e-9)), 6) as corr from v"""
    o["betweenness"] = und_bfs + ",\n" + _between(DEPTH) + """,
n as (select count(*)::double as n from tv)
select tv.id, round(coalesce(b.s, 0.0) / ((n - 1) * (n - 2)), 6) as betweenness from tv cross join n left join b on b.v = tv.id"""
    o["evolution_metrics"] = "with recursive " + SLIDING + """,
ids as materialized (select distinct asset as id from ret),
snaps as materialized (select snap_id, max(t) as ts from spread0 group by 1),
ad as materialized (select snap_id, a as s, b as d from snap_edges union all select snap_id, b, a from snap_edges),
reach as (select snap_id, id as root, id from snaps, ids union select r.snap_id, r.root, ad.d from reach r join ad on ad.snap_id = r.snap_id and ad.s = r.id),
comp as (select snap_id, count(distinct c) as n from (select snap_id, root, min(id) as c from reach group by 1, 2) group by 1),
k as (select snap_id, s as id, count(*) as k from ad group by 1, 2),
tri as (select x.snap_id, x.s as id, count(*) / 2 as t from ad x join ad y on x.snap_id = y.snap_id and x.s = y.s and x.d <> y.d join ad z on z.snap_id = x.snap_id and z.s = x.d and z.d = y.d group by 1, 2),
cl as (select snap_id, sum(case when k.k < 2 then 0.0 else 2 * coalesce(t, 0) / (k.k * (k.k - 1))::double end) / (select count(*) from ids) as c from k left join tri using (snap_id, id) group by 1),
m as (select s.snap_id, s.ts, count(e.a) as m, avg(e.weight) as w from snaps s left join snap_edges e using (snap_id) group by 1, 2),
kept as (select x.snap_id, count(*) as n from snap_edges x join snap_edges y on x.snap_id = y.snap_id + 1 and x.a = y.a and x.b = y.b group by 1),
o as (select m.*, lag(m) over (order by snap_id) as before, coalesce(kept.n, 0) as kept from m left join kept using (snap_id))
select strftime(ts, '%Y-%m-%d') as ts, o.m::bigint as n_edges, round(o.m / ((select count(*) from ids) * ((select count(*) from ids) - 1) / 2.0), 6) as density, round(coalesce(w, 0.0), 6) as avg_weight, round(coalesce(cl.c, 0.0), 6) as avg_clustering, comp.n::bigint as n_components,
  round(case when before is not null and (o.m > 0 or before > 0) then ((o.m - kept) + (before - kept)) / (o.m + before + 1e-9) end, 6) as edge_turnover
from o left join cl using (snap_id) left join comp using (snap_id)"""
    o["edge_index"] = f"with {TRADE}, vi as (select id, row_number() over (order by id) - 1 as o from tv) select x.o::bigint as src_ix, y.o::bigint as dst_ix from te join vi x on x.id = te.src join vi y on y.id = te.dst"
    o["edge_turnover"] = f"select ts, edge_turnover from ({o['evolution_metrics']})"
    for name in ("pearson", "spearman"):
        at = ", ".join(f"({n}, {critical_correlation(n, 0.05)!r}::double)" for n in range(30, 200))
        least = f"(values {at}) t(n_obs, least)"
        everything = o[f"{name}_graph"].replace(" and abs(corr(a.r, b.r)) >= 0.2", "").replace(" and abs(corr(x, y)) >= 0.2", "")
        o[f"{name}_significant"] = f"select g.* from ({everything}) g join {least} on t.n_obs = g.n_obs and abs(g.weight) >= t.least"
    o["attack_random"] = _attack(RANDOM_ORDER)
    o["coreness"] = CORENESS + f" select id, x::bigint as coreness from x{DEPTH}"
    o["contagion_index_undirected"] = "with recursive " + COSHIP + """,
reach as (select r.id as gone, v.id as root, v.id as id from tv r join tv v on v.id <> r.id union select x.gone, x.root, a.dst from reach x join arcs a on a.src = x.id and a.dst <> x.gone),
whole as (select root, id from reach where false union all select * from (with recursive w as (select id as root, id from tv union select w.root, a.dst from w join arcs a on a.src = w.id) select root, id from w)),
big as (select max(n) as n from (select count(*) as n from whole group by root)),
left_ as (select gone, max(n) as n from (select gone, root, count(*) as n from reach group by 1, 2) group by 1)
select tv.id, round((big.n - coalesce(left_.n, 0)) / (select count(*) from tv)::double, 6) as contagion_index from tv cross join big left join left_ on left_.gone = tv.id"""
    o["debtrank"] = "with " + TRADE + SEEDS + """,
wn as materialized (select te.src, te.dst, te.w / o.total as w from te join (select src, sum(w) as total from te group by 1) o using (src)),
""" + _chain(
        "select tv.id, case when s.id is not null then 0.5 else 0.0 end as h, case when s.id is not null then 0.5 else 0.0 end as prev, false as done from tv left join seeds s using (id)",
        """select id, case when stop then h else new end as h, case when stop then prev else h end as prev, stop as done from (
  select *, done or max(abs(new - prev)) over () < 1e-6 as stop from (
    select p.id, p.h, p.prev, p.done, case when p.h >= 1 then 1.0 else least(1.0, p.h + coalesce(i.impact, 0.0)) end as new
    from {p} p left join (select wn.dst as id, sum(wn.w * q.prev) as impact from wn join {p} q on q.id = wn.src group by 1) i using (id)))""",
        50,
    ) + " select id, round(h, 6) as debtrank from x50"
    radius = LAYERS + """,
ad as materialized (select layer, src, dst, w from lay union all select layer, dst, src, w from lay),
""" + _chain(
        "select distinct layer, src as id, 1.0 as x, 0.0 as r from ad",
        "select layer, id, y / sqrt(sum(y * y) over (partition by layer)) as x, sqrt(sum(y * y) over (partition by layer)) as r from (select p.layer, p.id, sum(ad.w * q.x) as y from {p} p join ad on ad.layer = p.layer and ad.dst = p.id join {p} q on q.layer = p.layer and q.id = ad.src group by 1, 2)",
        60,
    ) + ", rad as materialized (select layer, max(r) as r from x60 group by 1), score as materialized (select layer, round(r / (sum(r) over () + 1e-9), 6) as s from rad)"
    o["layer_importance"] = f"with {radius} select layer, round(s, 6) as score from score"
    o["fuse_eigen"] = f"""with {radius}, m as (select *, max(w) over (partition by layer) as top from lay), ws as (select layer, s / sum(s) over () as f from score)
select src as a, dst as b, round_even(sum(w / top * f), 6) as weight from m join ws using (layer) group by 1, 2 having sum(w / top * f) > 0.05"""
    snap = SLIDING + """,
tv as materialized (select distinct s.snap_id || '|' || r.asset as id from spread0 s, (select distinct asset from ret) r),
arcs as materialized (select snap_id || '|' || a as src, snap_id || '|' || b as dst from snap_edges union all select snap_id || '|' || b, snap_id || '|' || a from snap_edges)"""
    o["temporal_betweenness"] = "with " + snap + ",\n" + _bfs("arcs", "tv", DEPTH) + ",\n" + _between(DEPTH) + """,
n as (select count(distinct asset)::double as n from ret)
select cast(split_part(tv.id, '|', 1) as bigint) as snap_id, split_part(tv.id, '|', 2) as id, round(coalesce(b.s, 0.0) / ((n - 1) * (n - 2)), 6) as value from tv cross join n left join b on b.v = tv.id"""
    unrounded = {"eigenvector": EIGENVECTOR.replace("round(x, 6)", "x"), "pagerank": PAGERANK.replace("round(x, 6)", "x"), "betweenness": o["betweenness"].replace("round(coalesce(b.s, 0.0) / ((n - 1) * (n - 2)), 6)", "coalesce(b.s, 0.0) / ((n - 1) * (n - 2))")}
    scaled = "case when max({c}) over () > min({c}) over () then ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) else {c} end"
    o["systemic_importance"] = f"""with e as ({unrounded['eigenvector']}), p as ({unrounded['pagerank']}), b as ({unrounded['betweenness']}), c as (select id, coreness::double as coreness from ({o['coreness']})),
f as (select * from e join p using (id) join b using (id) join c using (id)),
s as (select id, ({' + '.join(scaled.format(c=x) for x in ('betweenness', 'eigenvector', 'pagerank', 'coreness'))}) / 4 as score from f)
select id, round(score, 6) as score from s order by s.score desc, id limit 5"""
    far = [f"d{k} as materialized (select root, id, min(d) as d from (select * from d{k - 1} union all select p.root, te.dst, p.d + te.w from d{k - 1} p join te on te.src = p.id) group by 1, 2)" for k in range(1, 2 * DEPTH + 1)]
    o["betweenness_weighted"] = "with recursive " + TRADE + ",\nd0 as materialized (select id as root, id, 0.0::double as d from tv),\n" + ",\n".join(far) + f""",
ds0 as materialized (select * from d{2 * DEPTH}),
steps as materialized (select q.root, te.src, te.dst from ds0 p join te on te.src = p.id join ds0 q on q.root = p.root and q.id = te.dst and p.d + te.w = q.d),
ways as (select id as root, id from tv union all select w.root, s.dst from ways w join steps s on s.root = w.root and s.src = w.id),
ds as materialized (select * from ds0 join (select root, id, count(*)::double as c from ways group by 1, 2) using (root, id)),
n as (select count(*)::double as n from tv),
b as (select x.id as v, sum(x.c * y.c / st.c) as s from ds st join ds x on x.root = st.root join ds y on y.root = x.id and y.id = st.id where st.id <> st.root and x.id <> st.root and x.id <> st.id and abs(x.d + y.d - st.d) < 1e-7 group by 1)
select tv.id, round(coalesce(b.s, 0.0) / ((n - 1) * (n - 2)), 6) as betweenness from tv cross join n left join b on b.v = tv.id"""
    return o
