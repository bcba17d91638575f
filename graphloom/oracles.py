"""DuckDB SQL for the graph queries."""

from __future__ import annotations

UNREACHED = 9223372036854775807

#: The graphs: vertices v, directed edges dense and sparse, unordered pairs.
BASE = """lines as (
  select l_orderkey, l_partkey as src, l_quantity,
         lead(l_partkey) over o as dst, lead(l_quantity) over o as weight
  from lineitem window o as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
dense as materialized (select src, dst, weight from lines where dst is not null and src <> dst),
sparse as materialized (select * from dense where weight >= 49),
pairs as materialized (select distinct least(src, dst) as a, greatest(src, dst) as b from dense),
v as materialized (select p_partkey as id from part)"""
SIMPLE = "adj as materialized (select a as src, b as dst from pairs union all select b, a from pairs)"
BOTH = "adj as materialized (select src, dst from sparse union all select dst, src from sparse)"
CHANGED = """changed as materialized (
  select src, dst, case when (src + dst) % 10 = 1 then max(weight) over (partition by src, dst) + 1 else weight end as weight
  from sparse where (src + dst) % 10 <> 0
  union all select src, dst, weight from dense where weight = 48)"""


def bfs(edges: str, more: str = "") -> str:
    return f"""with recursive {BASE}{more},
found(id, depth) using key (id) as (
  select 0::bigint, 0::bigint
  union
  select e.dst, min(f.depth + 1) from found f join {edges} e on e.src = f.id left join recurring.found r on r.id = e.dst
  where r.id is null group by e.dst)
select v.id, coalesce(f.depth, {UNREACHED}::bigint) as depth from v left join found f on f.id = v.id"""


def sssp(edges: str, more: str = "", value: str = "dist") -> str:
    return f"""with recursive {BASE}{more},
found(id, dist) using key (id) as (
  select 0::bigint, 0.0::double
  union
  select e.dst, min(f.dist + e.weight) from found f join {edges} e on e.src = f.id left join recurring.found r on r.id = e.dst
  where r.id is null or f.dist + e.weight < r.dist group by e.dst)
select v.id, coalesce(f.dist, 'infinity'::double) as {value} from v left join found f on f.id = v.id"""


def wcc(edges: str, more: str = "") -> str:
    return f"""with recursive {BASE}{more},
two_way as materialized (select src, dst from {edges} union select dst, src from {edges}),
found(id, comp) using key (id) as (
  select id, id from v
  union
  select e.dst, min(f.comp) from found f join two_way e on e.src = f.id join recurring.found r on r.id = e.dst
  where f.comp < r.comp group by e.dst)
select id, comp from found"""


def hits(edges: str, rounds: int) -> str:
    out = f"with {BASE}, h0 as materialized (select id, 1.0::double as hub, 1.0::double as authority from v)"
    for i in range(1, rounds + 1):
        norm = lambda c, i=i: f"(select sqrt(sum({c} * {c})) from h{i - 1})"
        out += f""",
o{i} as (select e.dst as id, sum(h.hub) / {norm("hub")} as x from {edges} e join h{i - 1} h on h.id = e.src group by e.dst),
n{i} as (select e.src as id, sum(h.authority) / {norm("authority")} as x from {edges} e join h{i - 1} h on h.id = e.dst group by e.src),
h{i} as materialized (select v.id, coalesce(n.x, 0) as hub, coalesce(o.x, 0) as authority from v left join n{i} n on n.id = v.id left join o{i} o on o.id = v.id)"""
    return f"{out}\nselect id, round(hub, 9) as hub, round(authority, 9) as authority from h{rounds}"


def tree(edges: str) -> str:
    """Of each vertex the smallest neighbour that is one level nearer."""
    return f"""with recursive {BASE},
found(id, depth, parent) using key (id) as (
  select 0::bigint, 0::bigint, 0::bigint
  union
  select e.dst, min(f.depth + 1), min(f.id) from found f join {edges} e on e.src = f.id left join recurring.found r on r.id = e.dst
  where r.id is null group by e.dst)
select v.id, f.depth, f.parent from v left join found f on f.id = v.id"""


def cdlp(adjacency: str, rounds: int = 10) -> str:
    out = f"with {BASE}, {adjacency}, l0 as materialized (select id, id as label from v)"
    for i in range(1, rounds + 1):
        out += f""",
c{i} as (select e.src, l.label, count(*) as n from adj e join l{i - 1} l on l.id = e.dst group by all),
b{i} as (select src, label from (select *, row_number() over (partition by src order by n desc, label) as r from c{i}) where r = 1),
l{i} as materialized (select l.id, coalesce(b.label, l.label) as label from l{i - 1} l left join b{i} b on b.src = l.id)"""
    return f"{out}\nselect id, label from l{rounds}"


def pagerank(adjacency: str, sinks: str = "ldbc", normalized: bool = True, digits: int = 10, rounds: int = 10, divide: str = "always") -> str:
    start, base = ("1.0::double / n", "0.15::double / n") if normalized else ("1.0::double", "0.15::double")
    out = f"""with {BASE}, {adjacency}, size as materialized (select count(*)::double as n from v),
deg as materialized (select v.id, coalesce(d.deg, 0) as deg from v left join (select src, count(*) as deg from adj group by src) d on d.src = v.id),
sinks as materialized (select count(*)::double as m from deg where deg = 0),
r0 as materialized (select id, deg, {start} as rank from deg, size)"""
    if normalized and sinks != "ldbc":
        out += ", own0 as materialized (select m / n as held from sinks, size)"
    for i in range(1, rounds + 1):
        if not normalized:
            out += f", own{i} as materialized (select {base} as own)"
        elif sinks == "ldbc":
            out += f", own{i} as materialized (select {base} + 0.85::double * (select coalesce(sum(rank), 0) from r{i - 1} where deg = 0) / n as own from size)"
        else:
            out += f", own{i} as materialized (select {base} + 0.85::double * held / n as own, ({base} + 0.85::double * held / n) * m as held from own{i - 1}, size, sinks)"
        given = "r.rank / r.deg" if divide == "always" or i == 1 else "r.rank"
        got = "0.85::double * coalesce(g.got, 0)"
        if normalized and sinks == "drop":
            got = f"case when r.deg = 0 then 0 else {got} end"
        out += f""",
g{i} as (select e.dst, sum({given}) as got from r{i - 1} r join adj e on e.src = r.id group by e.dst),
r{i} as materialized (select r.id, r.deg, o.own + {got} as rank from r{i - 1} r left join g{i} g on g.dst = r.id, own{i} o)"""
    return f"{out}\nselect id, round(rank, {digits}) as rank from r{rounds}"


TRIANGLES = """deg as materialized (select id, count(*) as d from (select a as id from pairs union all select b from pairs) group by id),
o as materialized (select case when up then a else b end as u, case when up then b else a end as w, case when up then da else db end as du
  from (select a, b, x.d as da, y.d as db, x.d < y.d or (x.d = y.d and a < b) as up from pairs join deg x on x.id = a join deg y on y.id = b)),
tri as materialized (select p.u as x, p.w as y, q.w as z from o p join o q on q.u = p.w join o r on r.u = p.u and r.w = q.w {where}),
corner as (select x as id, y as p, z as q from tri union all select y, x, z from tri union all select z, x, y from tri)"""


def lcc(where: str = "") -> str:
    return f"""with {BASE}, {TRIANGLES.format(where=where)}, n as (select id, count(*) as n from corner group by id)
select v.id, case when coalesce(d.d, 0) > 1 then round(2 * coalesce(n.n, 0) / (d.d * (d.d - 1))::double, 12) else 0.0::double end as lcc
from v left join deg d on d.id = v.id left join n on n.id = v.id"""


LCC_DIRECTED = f"""with {BASE}, {TRIANGLES.format(where="")},
times as (select least(src, dst) as a, greatest(src, dst) as b, count(*) as k from dense group by all),
n as (select c.id, sum(t.k) as n from corner c join times t on t.a = least(c.p, c.q) and t.b = greatest(c.p, c.q) group by c.id)
select v.id, case when coalesce(d.d, 0) > 1 then round(coalesce(n.n, 0)::double / (d.d * (d.d - 1))::double, 12) else 0.0::double end as lcc
from v left join deg d on d.id = v.id left join n on n.id = v.id"""


def peel(edges: str, k: int, rounds: int) -> str:
    """The edges that stay after so many rounds of peeling; more than enough at the sizes compared."""
    out = f"with {BASE}, e0 as materialized (select src, dst from {edges})"
    for i in range(1, rounds + 1):
        out += f""",
k{i} as materialized (select id from (select src as id from e{i - 1} union all select dst from e{i - 1}) group by id having count(*) >= {k}),
e{i} as materialized (select * from e{i - 1} where src in (from k{i}) and dst in (from k{i}))"""
    return out + f", core as (select id, count(*) as core_degree from (select src as id from e{rounds} union all select dst from e{rounds}) group by id)"


def coreness(rounds: int, both: str = BOTH, out: str = "v.id, coalesce(c.c, 0)::bigint as coreness") -> str:
    """The h-index of the neighbours' values, so many times."""
    last = out
    out = f"with {BASE}, {both}, c0 as materialized (select src as id, count(*) as c from adj group by src)"
    for i in range(1, rounds + 1):
        out += f""",
c{i} as materialized (select src as id, count(*) filter (where c >= r) as c from
  (select e.src, c.c, row_number() over (partition by e.src order by c.c desc) as r from adj e join c{i - 1} c on c.id = e.dst) group by src)"""
    return f"{out}\nselect {last} from v left join c{rounds} c on c.id = v.id"


def kclique(k: int, more: str = "", pairs: str = "pairs") -> str:
    out = f"with {BASE}{more}, c2 as (select a as v1, b as v2 from {pairs})"
    for j in range(3, k + 1):
        meets = " and ".join(f"(c.v{i}, p.b) in (select (a, b) from {pairs})" for i in range(1, j - 1))
        out += f", c{j} as materialized (select c.*, p.b as v{j} from c{j - 1} c join {pairs} p on p.a = c.v{j - 1} where {meets})"
    return f"{out} select {k}::int as k, count(*) as cliques from c{k}"


def bc(levels: int) -> str:
    out = f"with recursive {BASE}, {SIMPLE}, f0 as materialized (select 0::bigint as id, 1.0::double as sigma)"
    for i in range(1, levels + 1):
        seen = " and ".join(f"e.dst not in (select id from f{j})" for j in range(i))
        out += f", f{i} as materialized (select e.dst as id, sum(f.sigma) as sigma from f{i - 1} f join adj e on e.src = f.id where {seen} group by e.dst)"
    out += f", b{levels} as materialized (select id, sigma, 0.0::double as delta from f{levels})"
    for i in range(levels - 1, -1, -1):
        out += f""",
b{i} as materialized (select f.id, f.sigma, f.sigma * coalesce((select sum((1 + b.delta) / b.sigma) from adj e join b{i + 1} b on b.id = e.dst where e.src = f.id), 0) as delta from f{i} f)"""
    every = " union all ".join(f"select id, sigma, delta, {i}::bigint as depth from b{i}" for i in range(levels + 1))
    return f"""{out}
select v.id, round(coalesce(x.delta, 0), 6) as delta, round(coalesce(x.sigma, 0), 6) as sigma, coalesce(x.depth, {UNREACHED}::bigint) as depth
from v left join ({every}) x on x.id = v.id"""


def top_k(once: str = "select src, dst, min(weight) as weight from dense group by all") -> str:
    return f"""with {BASE},
once as ({once}),
idx as materialized (select src, dst, row_number() over (partition by src order by weight desc, dst desc) - 1 as r, count(*) over (partition by src) as n from once),
h1 as materialized (select v.id as root, i as place, x.dst as nbr from v cross join range(4) t(i)
  left join (select distinct src, n from idx) s on s.src = v.id left join idx x on x.src = v.id and x.r = i % s.n),
h2 as (select h.root, h.place * 3 + i as place, x.dst as nbr from h1 h cross join range(3) t(i)
  left join (select distinct src, n from idx) s on s.src = h.nbr left join idx x on x.src = h.nbr and x.r = i % s.n),
slots as (select root, place as slot, nbr from h1 union all select root, place + 4, nbr from h2)"""


def streamed(batch: int, once: str, known: str) -> str:
    return f"""select {batch}::int as batch, value from ({top_k(once)},
seen as (select src as id from dense where {known} union select dst from dense where {known})
select root || ' ' || string_agg(coalesce(nbr::varchar, '-'), ' ' order by slot) as value from slots where root in (from seen) group by root)"""


#: Heavy edges only; and all, where the lighter weight of the second batch replaces a heavy one.
HEAVY = "select src, dst, min(weight) as weight from dense where weight > 25 group by all"
REPLACED = "select src, dst, coalesce(min(weight) filter (where weight <= 25), min(weight)) as weight from dense group by all"
OTHERS = "select src, dst, min(51 - weight) as weight from dense group by all"
CHECKED = f"with {BASE} select v.id as root, 4::bigint as slots, case when v.id in (select src from dense) then 4 else 0 end::bigint as drawn, 0::bigint as wrong from v"

RANKED = f"with {BASE}, r as (select id, row_number() over (order by id) - 1 as place, count(*) over () as n from v)"


def rebalance(edges: str, ends: str, parts: int, factor: int, past: str) -> str:
    """The boundaries one after another, each the least running score beyond the last and the mean."""
    out = f"""with {BASE}, {ends},
s as (select v.id, coalesce(d.n, 0) + {factor} as score from v left join (select id, count(*) as n from ends group by id) d on d.id = v.id),
u as materialized (select id, sum(score) over (order by id) as upto from s),
m as materialized (select ceil(max(upto) / {parts}.0) as mean from u), c0 as (select 0 as c)"""
    for i in range(1, parts):
        out += f", c{i} as materialized (select min(upto) as c from u, m where upto {past} (select c from c{i - 1}) + mean)"
    part = " + ".join(f"coalesce((upto > (select c from c{i}))::int, 0)" for i in range(1, parts))
    return f"{out}\nselect id, ({part})::int as part from u"


SQL: dict[str, str] = {
    "bfs_dense": bfs("dense"),
    "bfs_sparse": bfs("sparse"),
    "bfs_simple": bfs("adj", ", " + SIMPLE),
    "sssp_dense": sssp("dense"),
    "sssp_sparse": sssp("sparse"),
    "sssp_near_far_dense": sssp("dense"),
    "bc_simple": bc(6),
    "wcc_sparse": wcc("sparse"),
    "cdlp_simple": cdlp(SIMPLE),
    "cdlp_dense_directed": cdlp("adj as materialized (select src, dst from dense union all select dst, src from dense)"),
    "pagerank_simple": pagerank(SIMPLE),
    "pagerank_sparse_ldbc": pagerank("adj as (select src, dst from sparse)"),
    "pagerank_sparse_drop": pagerank("adj as (select src, dst from sparse)", "drop"),
    "pagerank_sparse_push": pagerank("adj as (select src, dst from sparse)", "push"),
    "pagerank_local_simple": pagerank(SIMPLE, normalized=False, digits=8),
    "pagerank_local_undivided_simple": pagerank(SIMPLE, normalized=False, digits=4, rounds=3, divide="first"),
    "pagerank_local_undivided_ten_simple": f"select id, round(log10(rank), 8) as rank from ({pagerank(SIMPLE, normalized=False, digits=12, divide='first')})",
    "lcc_simple": lcc(),
    "lcc_simple_threshold": lcc("where p.du <= 45 and q.du <= 45"),
    "lcc_dense_directed": LCC_DIRECTED,
    "triangles_simple": f"with {BASE}, {TRIANGLES.format(where='')} select v.id, count(c.id) as triangles from v left join corner c on c.id = v.id group by v.id",
    "triangle_total_simple": f"with {BASE}, {TRIANGLES.format(where='')} select count(*) as triangles from tri",
    "kcore_simple_k30": peel("(select a as src, b as dst from pairs)", 30, 60) + " select id, core_degree from core",
    "kcore_size_simple_k31": peel("(select a as src, b as dst from pairs)", 31, 60) + " select 31::int as k, count(*) as vertices from core",
    "coreness_simple": coreness(60, SIMPLE),
    "coreness_total_simple": coreness(60, SIMPLE, "coalesce(sum(c.c), 0)::bigint as total, coalesce(max(c.c), 0)::bigint as largest"),
    "coreness_sparse": coreness(30),
    "kclique3_simple": kclique(3),
    "kclique4_simple": kclique(4),
    "kclique5_halved": kclique(5, ", half as materialized (select distinct least(a // 2, b // 2) as a, greatest(a // 2, b // 2) as b from pairs where a // 2 <> b // 2)", "half"),
    "degree_out_dense": f"with {BASE} select v.id, count(e.src) as degree from v left join dense e on e.src = v.id group by v.id",
    "degree_in_dense": f"with {BASE} select v.id, count(e.dst) as degree from v left join dense e on e.dst = v.id group by v.id",
    "neighbors_filtered_dense": f"with {BASE} select src as id, dst as neighbour, weight from dense where weight > 25",
    "neighbors_in_dense": f"with {BASE} select dst as id, src as neighbour, weight from dense",
    "has_parent_sparse": f"with {BASE} select distinct dst as id from sparse",
    "counts_dense": f"with {BASE} select (select count(*) from v) as vertices, (select count(*) from dense) as edges",
    "frontier_erase_sparse": f"with {BASE} select id from v where id % 3 <= 1 and id not in (select src from sparse)",
    "border_dense": f"with {BASE} select distinct src as id from dense where src % 4 <> dst % 4",
    "destinations_sparse": f"with {BASE} select src as id, string_agg(distinct (dst % 4)::varchar, ',' order by (dst % 4)::varchar) as parts from sparse group by src",
    "vertexcut_blocks": f"with {BASE}, c as (select ceil(count(*) / 2.0) as c from v) select (floor(src / c) * 2 + floor(dst / c))::int as block, count(*) as edges from dense, c group by all",
    "map_partition": f"{RANKED} select id, floor(place / ceil(n / 6.0))::int as part from r",
    "segment_partition": f"{RANKED} select id, floor(place / ceil(n / 6.0))::int as part from r",
    "rebalance_map": rebalance("dense", "ends as (select src as id from dense)", 4, 1, ">"),
    "rebalance_segment": rebalance("sparse", "ends as (select src as id from sparse union all select dst from sparse)", 4, 2, ">="),
    "mutate_then_bfs": bfs("changed", ", " + CHANGED),
    "mutate_then_sssp": sssp("changed", ", " + CHANGED),
    "mutate_then_wcc": wcc("changed", ", " + CHANGED),
    "mutate_vertices": f"""with {BASE}, kept as (select * from sparse where src % 10 <> 0 and dst % 10 <> 0),
ids as (select id, case when id % 10 = 1 or (id % 10 = 2 and id % 20 <> 2) then id % 5 + 100 else id % 7 end as data from v
  union all select id + 10000000, id % 5 + 100 from v where id % 20 = 2)
select i.id, i.data, count(k.src) as degree from ids i left join kept k on k.src = i.id group by i.id, i.data""",
    "sample_topk_dense": f"{top_k()} select root, slot::int as slot, nbr from slots",
    "sample_random_checked_dense": CHECKED,
    "sample_edge_weight_checked_dense": CHECKED,
    "stream_sampler_dense": f"{streamed(0, HEAVY, 'weight > 25')} union all {streamed(1, REPLACED, 'true')} union all {streamed(2, OTHERS, 'true')}",
    "stream_batches_events": """with recursive e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as i from events where ts is not null),
w as (select user_id, event_id, i, t, t as first, 1 as n, 0::bigint as batch from e where i = 1 union all
  select e.user_id, e.event_id, e.i, e.t, case when w.n >= 20 or w.t - w.first > 86400000000 then e.t else w.first end,
    case when w.n >= 20 or w.t - w.first > 86400000000 then 1 else w.n + 1 end, case when w.n >= 20 or w.t - w.first > 86400000000 then w.batch + 1 else w.batch end
  from w join e on e.user_id is not distinct from w.user_id and e.i = w.i + 1)
select user_id, event_id, batch from w""",
    "program_bfs_dense": bfs("dense"),
    "program_wcc_sparse": wcc("sparse"),
    "text_result_sssp_sparse": sssp("sparse", value="value"),
    "stored_counts_sparse": f"with {BASE} select (select count(*) from v) as vertices, (select count(*) from sparse) as edges",
    "stored_bfs_sparse": bfs("sparse"),
    "stored_bfs_both_sparse": bfs("adj", ", " + BOTH),
    "loaded_updated_sparse": f"with {BASE} select src, dst, max(weight) over (partition by src, dst) + 5 as weight from sparse",
    "loaded_degree_sparse": f"with {BASE} select v.id, count(e.src) as degree from v left join sparse e on e.src = v.id group by v.id",
    "program_in_dense": bfs("back", ", back as materialized (select dst as src, src as dst from dense)"),
    "program_mutated_sparse": wcc("sparse"),
    "program_pagerank_sparse": pagerank("adj as (select src, dst from sparse)"),
    "program_hits_sparse": hits("sparse", 6),
    "program_tree_dense": tree("dense"),
    "loaded_parsed_sparse": f"with {BASE} select v.id, count(e.dst) as degree from v left join sparse e on e.dst = v.id group by v.id",
    "loaded_changed_sparse": f"with {BASE}, {CHANGED} select v.id, count(e.src) as degree from v left join changed e on e.src = v.id group by v.id",
    "pagerank_numbered_simple": pagerank(SIMPLE),
    "appended_degree_sparse": f"""with {BASE}, more as (select src, dst + 10000000 as dst from dense where weight = 48),
every as (select src, dst from sparse union all select src, dst from more), ids as (select id from v union select dst from more)
select i.id, count(e.src) as degree from ids i left join every e on e.src = i.id group by i.id""",
    "compared_components": f"""with recursive a as ({wcc("sparse")}),
b as materialized (select 'same' as name, id, comp as x, comp::double as y from a union all select 'renamed', id, comp, comp + 1 from a
  union all select 'nearly', id, comp, comp * 1.00001::double from a union all select 'changed', id, comp, case when id % 100 = 3 then -1 else comp end from a)
select name, count(distinct x) = count(distinct (x, y)) and count(distinct y) = count(distinct (x, y)) as isomorphic, bool_and(x = y) as exact,
  bool_and(abs(x - y) <= 1e-4 * greatest(abs(x), abs(y)) or greatest(abs(x), abs(y)) < 1e-10) as within from b group by name""",
}
