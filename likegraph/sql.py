"""The same results as SQL over the provided tables, to hold the operators against."""

from __future__ import annotations

BASE = """
li as (
  select cast(l_suppkey as bigint) s,
    1000000 + cast(substr(p_brand, 7) as bigint) * 10 + case p_type when 'SMALL' then 0 when 'LARGE' then 1 when 'STANDARD' then 2 when 'ECONOMY' then 3 when 'MEDIUM' then 4 else 5 end p,
    2000000 + cast(c_nationkey as bigint) * 10 + case c_mktsegment when 'BUILDING' then 0 when 'AUTOMOBILE' then 1 when 'MACHINERY' then 2 when 'HOUSEHOLD' then 3 else 4 end c,
    r_name || case when l_linestatus = 'O' then '(L)' else '(R)' end region, p_type pt, c_mktsegment ct
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey),
half as (select c src, s dst, region, ct st, 'sup' dt from li union all select s, p, region, 'sup', pt from li union all select p, c, region, pt, ct from li),
eroi as (select src, dst, region, count(*) post from half group by all),
edges as (select src, dst, cast(sum(post) as bigint) weight from eroi group by all),
nroi as (select body, region, cast(sum(pre) as bigint) pre, cast(sum(post) as bigint) post from (select src body, region, 1 pre, 0 post from half union all select dst, region, 0, 1 from half) group by all),
nodes as (
  select body, case when body % 11 <> 0 then max(t) end as type, case when body % 3 <> 0 then 'Anchor' else 'Traced' end status, body % 7 = 0 cropped
  from (select src body, st t from half union all select dst, dt from half) group by body),
targets as (select cast(s_suppkey as bigint) bodyid from supplier),
touch as (
  select dst bodyid, 'in' direction, src partner, src, dst, weight from edges where src <> dst and dst in (from targets)
  union all select src, 'out', dst, src, dst, weight from edges where src <> dst and src in (from targets))"""

CONN = """
conn as (select bodyid, direction, partner, nullif(replace(replace(type, 'put_', ''), '_pct', ''), '') saved, cast(weight as double) as value from touch join nodes on body = partner where status = 'Anchor' and weight >= 3)"""

DIL = "case when direction = 'in' then '=>' else '<=' end"


def sorted_types(kind: str, source: str = "conn") -> str:
    return f"""select bodyid, direction, case when kind is null then 'c-' || partner || {DIL} else 'c-' || kind || '#' || row_number() over (partition by bodyid, direction, kind order by value desc, partner) || {DIL} end feature, value
from (select *, cast({kind} as varchar) kind from {source})"""


def scaled(name: str, raw: str, wi: float, wo: float, w: tuple[float, float, float]) -> str:
    """CTEs ending in ``name``(bodyid, block, feature, value) from ``raw``(bodyid, direction, feature, value)."""
    n = name
    out = f"""
{n}_t as (select bodyid, direction, sum(value) total from {raw} group by all),
{n}_f as (select bodyid, direction block, feature, coalesce(value / nullif(total, 0), 0) * case when direction = 'in' then {wi} else {wo} end as value from {raw} join {n}_t using (bodyid, direction)),
{n}_a as (select bodyid, 'share.' || block block, feature, coalesce(value / nullif(sqrt(sum(value * value) over (partition by bodyid)), 0), 0) * {w[0]} as value from {n}_f),
{n}_s as (select t.bodyid, d.direction, coalesce(total, 0) * d.w as value from targets t cross join (values ('in', {wi}), ('out', {wo})) d(direction, w) left join {n}_t x on x.bodyid = t.bodyid and x.direction = d.direction),
{n}_c as (select bodyid, 'size' block, case when direction = 'in' then 'post' else 'pre' end feature, coalesce((value - avg(value) over (partition by direction)) / nullif(stddev_pop(value) over (partition by direction), 0), 0) * {w[2]} as value from {n}_s)"""
    parts = [f"from {n}_a"]
    if w[1]:
        out += f""",
{n}_d as (select bodyid, block, feature, coalesce(value, 0) as value from targets cross join (select distinct block, feature from {n}_f) left join {n}_f using (bodyid, block, feature)),
{n}_z as (select bodyid, block, feature, coalesce((value - avg(value) over c) / nullif(stddev_pop(value) over c, 0), 0) as value from {n}_d window c as (partition by block, feature)),
{n}_b as (select bodyid, 'scaled.' || block block, feature || '-s' feature, coalesce(value / nullif(sqrt(sum(value * value) over (partition by bodyid)), 0), 0) * {w[1]} as value from {n}_z)"""
        parts.append(f"from {n}_b")
    parts.append(f"from {n}_c")
    return f"{out},\n{n} as ({' union all '.join(parts)})"


def with_(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",".join(ctes) + "\n" + select


OVERLAP = """
overlap as (
  select bodyid, direction, feature, cast(sum(n) as double) as value from (
    select body bodyid, 'in' direction, replace(replace(region, '(L)', ''), '(R)', '') || '<=' feature, pre n from nroi where pre > 0 and body in (from targets)
    union all select body, 'out', replace(replace(region, '(L)', ''), '(R)', '') || '=>', post * 5 from nroi where post > 0 and body in (from targets)) group by all)"""

PROJECTION = """
pt as (select t.* from touch t join nodes on body = partner where status = 'Traced' and weight >= 3),
own as (select pt.bodyid, pt.direction, pt.partner, region, post n from pt join eroi using (src, dst) where post >= 3),
seconds as (select distinct region from pt join nroi on body = partner where direction = 'in'),
places as (
  select partner, region other, side, m, sum(m) over (partition by partner, side) whole from (
    select distinct body partner, region, '<=' side, pre m from nroi join pt on partner = body where region in (from seconds)
    union all select distinct body, region, '=>', post from nroi join pt on partner = body where region in (from seconds))),
cells as (
  select bodyid, direction, region, other, side, sum(n * (cast(m as double) / whole)) as value, replace(replace(region, '(L)', ''), '(R)', '') a, replace(replace(other, '(L)', ''), '(R)', '') b
  from own join places using (partner) where m > 0 group by all),
projection as (
  select bodyid, direction, a || case when direction = 'in' then '<=' else '=>' end || '(' || b || side || ')#' || row_number() over (partition by bodyid, direction, a, b, side order by value desc, region, other) feature, value from cells)"""

RAW = "select bodyid, direction, feature, round(value, 6) as value from "
LONG = "select bodyid, block, feature, round(value, 6) as value from "
SORTED = f"raw as ({sorted_types('saved')})"
CONN_SCALED = scaled("feat", "raw", 0.5, 0.5, (0.9, 0.0, 0.1))
FEAT = (BASE, CONN, SORTED, CONN_SCALED)
PAIRS = """
norms as (select t.bodyid, coalesce(sum(value * value), 0) n from targets t left join feat using (bodyid) group by 1),
dots as (select a.bodyid b1, b.bodyid b2, sum(a.value * b.value) d from feat a join feat b on a.block = b.block and a.feature = b.feature and a.bodyid < b.bodyid group by 1, 2),
pairs as (
  select x.bodyid b1, y.bodyid b2, round_even(1e5 * sqrt(greatest(0, x.n + y.n - 2 * coalesce(d, 0))), 0) / 1e5 dist
  from norms x join norms y on x.bodyid < y.bodyid left join dots on b1 = x.bodyid and b2 = y.bodyid)"""
SUP_EXACT = "exact as (select x.bodyid b1, y.bodyid b2, sqrt(greatest(0, x.n + y.n - 2 * coalesce(d, 0))) dist from norms x join norms y on x.bodyid < y.bodyid left join dots on b1 = x.bodyid and b2 = y.bodyid)"
EMB = "emb as (select vec_id id, cast(embedding as double[]) v, label from embeddings)"
EMB_NEAR = "near as (select a.id bodyid, b.id match, a.label t1, b.label t2, row_number() over (partition by a.id order by round_even(1e5 * list_distance(a.v, b.v), 0) / 1e5, b.id) r from emb a join emb b on a.id <> b.id)"


def each(function: str, wi: float = 0.5, wo: float = 0.5) -> str:
    return with_(BASE, CONN, SORTED, select=f"select bodyid, direction block, feature, round(({function}) * case when direction = 'in' then {wi} else {wo} end, 6) as value from (select *, value x from raw)")


def slots(body: str, partner: str) -> str:
    return with_(
        BASE,
        f"""
ent as (
  select {body} bodyid, {partner} pid, weight, coalesce(nullif(type, ''), cast({partner} as varchar)) partner, nullif(type, '') is not null hastype
  from edges join nodes on body = {partner} where weight >= 3 and status = 'Traced' and {body} in (from targets) and (nullif(type, '') is not null or not cropped)),
seq as (select *, row_number() over o i, sum(weight) over (o rows unbounded preceding) cum, sum(weight) over (partition by bodyid) total from ent window o as (partition by bodyid order by weight desc, pid desc)),
imp as (select *, i <= 6 or weight >= max(case when cum > 0.25 * total then weight end) over (partition by bodyid) important from seq),
cols as (select partner, hastype, unnest(range(1, max(n) + 1)) slot from (select bodyid, partner, hastype, count(*) filter (important) n from imp group by all) group by 1, 2),
fil as (select *, row_number() over (partition by bodyid, partner, hastype order by weight desc, pid desc) slot from ent),
ful as (select t.bodyid, c.partner, c.hastype, cast(c.slot as int) slot, cast(coalesce(weight, 0) as double) weight from targets t cross join cols c left join fil f on f.bodyid = t.bodyid and f.partner = c.partner and f.hastype = c.hastype and f.slot = c.slot),
sta as (select partner, hastype, slot, var_samp(weight) v, median(weight) m from ful group by all)""",
        select="""select cast(bodyid as varchar) bodyid, partner, hastype, slot, round(weight, 6) weight, round(v, 6) var from ful join sta using (partner, hastype, slot)
union all select 'median', partner, hastype, slot, round(m, 6), round(v, 6) from sta""",
    )


def ward(n: str, bodies: str, exact: str) -> str:
    """CTEs {n}_m, the merges (step, left, right, height, size, id) of Ward's tree over exact(b1, b2, dist), rounded to 5 decimals, and {n}_up, the clusters of each leaf (its place among bodies), a leaf's own included; they need ``with recursive``."""
    return f"""
{n}_pos as (select bodyid, row_number() over (order by bodyid) - 1 pos, count(*) over () n from {bodies}),
{n}_all as (select least(x.pos, y.pos) a, greatest(x.pos, y.pos) b, dist, x.n from {exact} join {n}_pos x on x.bodyid = b1 join {n}_pos y on y.bodyid = b2),
{n}_w as (
  select 0 step, a, b, pow(round_even(1e5 * dist, 0) / 1e5, 2) d2, cast(1 as double) na, cast(1 as double) nb, n from {n}_all
  union all (
    with m as (select step, a p, b q, d2 dpq, na np, nb nq, n from {n}_w order by d2, a, b limit 1),
    kept as (select m.step + 1, a, b, d2, na, nb, {n}_w.n from {n}_w, m where a not in (p, q) and b not in (p, q)),
    near as (select case when a in (p, q) then b else a end k, case when a in (p, q) then nb else na end nk, case when a in (p, q) then na else nb end ne, d2, dpq, np + nq nm, m.n + m.step id, m.step, m.n from {n}_w, m where (a in (p, q)) <> (b in (p, q)))
    from kept union all select step + 1, k, id, (sum((nk + ne) * d2) - nk * dpq) / (nk + nm), nk, nm, n from near group by k, nk, dpq, nm, id, step, n)),
{n}_m as (select cast(step as int) step, a as "left", b as "right", sqrt(d2) height, na + nb size, n + step id from {n}_w qualify row_number() over (partition by step order by d2, a, b) = 1),
{n}_up as (select pos leaf, pos node, n from {n}_pos union all select leaf, id, n from {n}_up join {n}_m on node in ("left", "right"))"""


def widths(n: str) -> str:
    """CTE {n}_far after ``ward``: each merge with the largest exact distance within its cluster, and that pair."""
    return f"""
{n}_far as (
  select m.*, dist diameter, x.bodyid far1, y.bodyid far2
  from {n}_m m join {n}_up u on u.node = m.id join {n}_up v on v.node = m.id join {n}_all p on p.a = u.leaf and p.b = v.leaf join {n}_pos x on x.pos = p.a join {n}_pos y on y.pos = p.b
  qualify row_number() over (partition by m.id order by dist desc, p.a, p.b) = 1)"""


def cut(n: str, merged: str) -> str:
    """A select of (bodyid, type) after so many merges, clusters in order of their first body."""
    return f"""select bodyid, cast(dense_rank() over (order by first) - 1 as int) as type from (
  select leaf, min(leaf) over (partition by top) first from (select leaf, max(node) top from {n}_up where node < n + ({merged}) group by leaf)) join {n}_pos on pos = leaf"""


def leaves(n: str) -> str:
    """CTE {n}_leaf(node, start) after ``ward``: where each cluster begins in the order of leaves."""
    return f"""
{n}_size as (select node, count(*) k from {n}_up group by 1),
{n}_leaf as (
  select max(node) node, 0 start from {n}_up
  union all select unnest(["left", "right"]), unnest([start, start + k]) from {n}_leaf join {n}_m on id = {n}_leaf.node join {n}_size z on z.node = "left")"""


def exact_pairs(n: str, feat: str) -> str:
    """CTE {n}(b1, b2, dist): exact distances of all targets over feat(bodyid, block, feature, value)."""
    return f"""
{n}_norm as materialized (select t.bodyid, coalesce(sum(value * value), 0) n from targets t left join {feat} using (bodyid) group by 1),
{n}_dot as materialized (select a.bodyid b1, b.bodyid b2, sum(a.value * b.value) d from {feat} a join {feat} b on a.block = b.block and a.feature = b.feature and a.bodyid < b.bodyid group by 1, 2),
{n} as materialized (select x.bodyid b1, y.bodyid b2, sqrt(greatest(0, x.n + y.n - 2 * coalesce(d, 0))) dist from {n}_norm x join {n}_norm y on x.bodyid < y.bodyid left join {n}_dot on b1 = x.bodyid and b2 = y.bodyid)"""


def workflow_rounds(saved: str, w: tuple[float, float, float]) -> str:
    """Two rounds with all nodes as targets: clusters of projections are the types of the first round's features, and clusters of these the types of the second's. A partner without a cluster has the type ``saved``."""
    base = BASE.replace("targets as (select cast(s_suppkey as bigint) bodyid from supplier)", "targets as (select body bodyid from nodes)")
    parts = [base, CONN, PROJECTION, scaled("f0", "projection", 0.5, 0.5, (0.66, 0, 0.33))]
    for k in range(2):
        parts += [
            exact_pairs(f"e{k}", f"f{k}"),
            ward(f"w{k}", "targets", f"e{k}").replace(f"w{k}_m as (", f"w{k}_m as materialized ("),
            f"""
c{k} as materialized (select bodyid partner, 'cluster:{k}:' || type kind{k} from ({cut(f"w{k}", "n - greatest(1, n // 5)")}))""",
            f"""
raw{k + 1} as materialized ({sorted_types(f"coalesce(kind{k}, {saved})", f"(select * from conn left join c{k} using (partner))")})""",
            scaled(f"f{k + 1}", f"raw{k + 1}", 0.5, 0.5, w),
        ]
    return with_(*parts, recursive=True, select=LONG + "f2")


VI = """
cell as (select vec_id % 10 l, label g, count(*) n from embeddings group by all),
part as (select *, n / cast(sum(n) over () as double) * log2(sum(n) over (partition by l) / cast(n as double)) m, n / cast(sum(n) over () as double) * log2(sum(n) over (partition by g) / cast(n as double)) s, sum(n) over (partition by g) ng from cell)"""
DIFF_CTE = f"with {EMB} select a.id b1, b.id b2, round(list_distance(a.v, b.v), 6) dist from emb a join emb b on a.id < b.id and "
EMB_TREE = (EMB, "who as (select id bodyid from emb)", "exact as (select a.id b1, b.id b2, list_distance(a.v, b.v) dist from emb a join emb b on a.id < b.id)")
#: The row vectors of the rounded distance matrix, and the distances between them.
SUP_ROWS = """
square as (select b1 i, b2 k, dist from pairs union all select b2, b1, dist from pairs union all select bodyid, bodyid, 0 from targets),
apart as (select x.i b1, y.i b2, sqrt(sum((x.dist - y.dist) * (x.dist - y.dist))) dist from square x join square y on x.k = y.k and x.i < y.i group by 1, 2)"""
CENTRES = """
centre as (select row_number() over (order by id) - 1 c, v from emb order by id limit 10),
assigned as (select id, label, arg_min(c, (d, c)) c, min(d) d from (select e.id, e.label, c.c, list_distance(e.v, c.v) d from emb e cross join centre c) group by all)"""
#: Five of Lloyd's steps from the first ten bodies; a row for each body and step.
LLOYD = """
moved as (
  select 0 step, e.id, e.v, e.label, arg_min(c.c, (list_distance(e.v, c.v), c.c)) c from emb e cross join (select row_number() over (order by id) - 1 c, v from emb order by id limit 10) c group by e.id, e.v, e.label
  union all (
    with flat as (select step, c, unnest(v) x, unnest(range(len(v))) i from moved where step < 5),
    centre as (select step, c, list(m order by i) v from (select step, c, i, avg(x) m from flat group by all) group by step, c)
    select any_value(centre.step) + 1, e.id, e.v, e.label, arg_min(centre.c, (list_distance(e.v, centre.v), centre.c)) from emb e cross join centre group by e.id, e.v, e.label))"""
BOTH = """
both_v as (
  select f.block, f.feature, coalesce(a.value, 0) v1, coalesce(b.value, 0) v2 from (select distinct block, feature from feat) f
  left join feat a on a.bodyid = 1 and a.block = f.block and a.feature = f.feature left join feat b on b.bodyid = 2 and b.block = f.block and b.feature = f.feature),
d as (select *, abs(v1 - v2) diff, row_number() over (order by round(abs(v1 - v2), 9) desc, block, feature) rd, row_number() over (order by round(v1 + v2, 9) desc, block, feature) rs from both_v)"""
FINE = "case when partner >= 2000000 then 'seg' || partner % 4 || '_' || ['a', 'b', 'c'][partner % 3 + 1] end"
CUSTOM = "case when partner >= 2000000 then 'seg' || partner % 4 end"
RESTRICTED = f"""
conn as (
  select bodyid, direction, partner, nullif(replace(replace(type, 'put_', ''), '_pct', ''), '') saved, cast(v as double) as value
  from (select t.bodyid, t.direction, t.partner, sum(post) v from touch t join eroi using (src, dst) where weight >= 3 and region in ('ASIA(L)', 'ASIA(R)', 'EUROPE(L)') group by all) join nodes on body = partner where status = 'Anchor' and v >= 3)"""

SQL = {
    "graph_edges": with_(BASE, select="select src, dst, weight from edges"),
    "graph_nodes_roi": with_(BASE, select="select body bodyid, region, pre, post from nroi"),
    "neighbors": with_(BASE, select="select bodyid from targets union select p from (select src b, dst p, weight from edges union all select dst, src, weight from edges) join nodes on body = p where weight >= 3 and status = 'Traced' and b in (from targets)"),
    "roi_overlap_in": with_(BASE, OVERLAP, select=RAW + "overlap where direction = 'in'"),
    "roi_overlap_out": with_(BASE, OVERLAP, select=RAW + "overlap where direction = 'out'"),
    "projection_in": with_(BASE, PROJECTION, select=RAW + "projection where direction = 'in'"),
    "projection_out": with_(BASE, PROJECTION, select=RAW + "projection where direction = 'out'"),
    "conn_sorted": with_(BASE, CONN, SORTED, select=RAW + "raw"),
    "conn_collapsed": with_(BASE, CONN, select=f"select bodyid, direction, 'c-' || coalesce(saved, cast(partner as varchar)) || {DIL} feature, round(sum(value), 6) as value from conn group by all"),
    "conn_pattern_only": with_(BASE, CONN, f"raw as ({sorted_types(chr(39) + 'ph' + chr(39))})", select=RAW + "raw"),
    "conn_roi_restricted": with_(BASE, RESTRICTED, SORTED, select=RAW + "raw"),
    "conn_custom_types": with_(BASE, CONN, f"raw as ({sorted_types(f'coalesce({CUSTOM}, saved)')})", select=RAW + "raw"),
    "proc_sigmoid": each("1 / (1 + exp(-((x - 20.0) / 5.0)))"),
    "proc_piecewise": each("case when x < 20 then x else 20 + (x - 20) * 0.1 end"),
    "proc_clipped": each("case when x < 5 then 0 when x > 15 then 15 else x end"),
    "proc_noop": each("x", 0.3, 0.7),
    "proc_scaled": with_(BASE, CONN, SORTED, scaled("feat", "raw", 1.0, 1.0, (0.8, 0.1, 0.1)), select=LONG + "feat"),
    "combine_blocks": with_(BASE, CONN, SORTED, OVERLAP, select="select bodyid, 'roi.' || direction block, feature, round(value * 0.5 * 0.3, 6) as value from overlap union all select bodyid, 'conn.' || direction, feature, round(value * 0.5 * 0.7, 6) from raw"),
    "non_iterative": with_(
        BASE,
        CONN,
        f"raw as ({sorted_types(chr(39) + 'ph' + chr(39))})",
        OVERLAP,
        PROJECTION,
        scaled("pat", "raw", 0.5, 0.5, (0.9, 0.0, 0.1)),
        scaled("pro", "projection", 0.5, 0.5, (0.66, 0, 0.33)),
        scaled("ovl", "overlap", 0.5, 0.5, (0.66, 0, 0.33)),
        select=LONG + "(select bodyid, 'pattern.' || block block, feature, value * 0.4 as value from pat union all select bodyid, 'projection.' || block, feature, value * 0.4 from pro union all select bodyid, 'overlap.' || block, feature, value * 0.2 from ovl)",
    ),
    "feature_store": with_(*FEAT, select=LONG + "feat"),
    "distance_pairs": with_(*FEAT, PAIRS, select="select b1, b2, dist from pairs"),
    "closest_to_body": with_(*FEAT, PAIRS, select="select case when b1 = 1 then b2 else b1 end bodyid, dist from pairs where 1 in (b1, b2) union all select 1, 0.0"),
    "strongest_matches": with_(EMB, EMB_NEAR, select="select bodyid, match from near where r = 1"),
    "agreement_rate": with_(EMB, EMB_NEAR, select="select 100.0 * sum(case when t1 = t2 then 1.0 else 0 end) / count(*) rate from near where r = 1 and t1 in (select label from emb group by 1 having count(*) > 1)"),
    "agreement_mismatches": with_(EMB, EMB_NEAR, select="select bodyid, t1 type1, match, t2 type2 from near where r = 1 and t1 <> t2 and t1 in (select label from emb group by 1 having count(*) > 1)"),
    "vi_summary": with_(VI, select="select round(sum(m), 6) merge, round(sum(s), 6) split from part"),
    "vi_table": with_(VI, select='select g as type, round(sum(m) + sum(s), 6) "VI", round((sum(m) + sum(s)) / max(ng), 6) "VI_norm", round(sum(m), 6) false_merge, round(sum(s), 6) false_split from part group by 1'),
    "report_diffs": DIFF_CTE + "a.label = b.label and a.id % 10 <> b.id % 10",
    "cluster_diameter": DIFF_CTE + "a.label = b.label order by list_distance(a.v, b.v) desc, 1, 2 limit 1",
    "max_differences": with_(*FEAT, BOTH, select="select 'difference' kind, cast(rd as int) rank, block, feature, round(v1, 6) v1, round(v2, 6) v2, round(diff, 6) diff from d where rd <= 10 union all select 'sum', cast(rs as int), block, feature, round(v1, 6), round(v2, 6), round(diff, 6) from d where rs <= 10"),
    "max_range_features": with_(
        *FEAT,
        "spans as (select block, feature, round(case when count(*) < (select count(*) from targets) then greatest(max(value), 0) - least(min(value), 0) else max(value) - min(value) end, 9) s from feat group by all), top as (select block, feature from spans order by s desc, block, feature limit 40)",
        select=LONG + "feat join top using (block, feature)",
    ),
    "partner_slots_in": slots("dst", "src"),
    "partner_slots_out": slots("src", "dst"),
    "heatmap_long": with_(BASE, OVERLAP, scaled("feat", "overlap", 0.5, 0.5, (0.66, 0, 0.33)), select="select t.bodyid, f.block, f.feature, round(coalesce(v.value, 0), 6) as value from targets t cross join (select distinct block, feature from feat) f left join feat v on v.bodyid = t.bodyid and v.block = f.block and v.feature = f.feature"),
    "radar_table": with_(BASE, OVERLAP, scaled("feat", "overlap", 0.5, 0.5, (0.66, 0, 0.33)), select="select t.bodyid, cast(t.bodyid % 3 as varchar) as type, f.block, f.feature, round(coalesce(v.value, 0), 6) as value from targets t cross join (select distinct block, feature from feat) f left join feat v on v.bodyid = t.bodyid and v.block = f.block and v.feature = f.feature"),
    "scatter_join": "select vec_id bodyid, cast(vec_id % 10 as varchar) cluster, cast(label as varchar) truth from embeddings",
    "conn_morph_only": with_(BASE, CONN, "raw as (" + sorted_types(f"regexp_replace(coalesce({FINE}, saved), '^(.*)_[a-z]$', '\\1')") + ")", select=RAW + "raw"),
    "conn_replay": with_(BASE, CONN, f"raw as ({sorted_types(FINE)})", CONN_SCALED, select=LONG + "feat"),
    "distance_condensed": with_(*FEAT, PAIRS, "place as (select bodyid, row_number() over (order by bodyid) - 1 i, count(*) over () n from targets)", select="select cast(x.n * x.i - (x.i * (x.i + 1)) // 2 + y.i - x.i - 1 as bigint) k, dist from pairs join place x on x.bodyid = b1 join place y on y.bodyid = b2"),
    "report_diffs_second": DIFF_CTE + "a.label <> b.label and a.id % 10 = b.id % 10",
    "report_diffs_plain": "select a.vec_id b1, b.vec_id b2 from embeddings a join embeddings b on a.vec_id < b.vec_id and a.label = b.label and a.vec_id % 10 <> b.vec_id % 10",
    "ward_tree": with_(*FEAT, PAIRS, SUP_EXACT, ward("t", "targets", "exact"), widths("t"), recursive=True, select='select step, cast("left" as int) "left", cast("right" as int) "right", round(height, 6) height, cast(size as int) size, round(diameter, 6) diameter, far1, far2 from t_far'),
    "ward_partitions": with_(*FEAT, PAIRS, SUP_EXACT, ward("t", "targets", "exact"), recursive=True, select=cut("t", "(select count(*) from targets) - 10")),
    "leaf_order": with_(*FEAT, PAIRS, SUP_ROWS, f"""{ward("t", "targets", "apart").replace("pow(round_even(1e5 * dist, 0) / 1e5, 2)", "dist * dist")}""", leaves("t"), recursive=True, select="select bodyid, cast(start as int) ord from t_leaf join t_pos on pos = node"),
    "ward_dist_constraint": with_(*EMB_TREE, ward("t", "who", "exact"), widths("t"), recursive=True, select=cut("t", "select coalesce(min(step), (select count(*) from t_m)) from t_far where diameter > 1.5")),
    "ward_dist_diameter": with_(*EMB_TREE, ward("t", "who", "exact"), widths("t"), recursive=True, select="select round(diameter, 6) dist, far1 b1, far2 b2 from t_far where step < (select coalesce(min(step), 1000000000) from t_far where diameter > 1.5) order by diameter desc limit 1"),
    "ward_best_vi": with_(
        *EMB_TREE,
        ward("t", "who", "exact"),
        """
level as (select step + 1 l from t_m union all select 0),
top as (select l, leaf, max(node) c from level join t_up on node < n + l group by all),
cell as (select l, c, label g, count(*) k from top join t_pos on pos = leaf join emb on id = bodyid group by all),
part as (
  select l, c, g, k / cast(sum(k) over (partition by l) as double) * log2(sum(k) over (partition by l, c) / cast(k as double)) m, k / cast(sum(k) over (partition by l) as double) * log2(sum(k) over (partition by l, g) / cast(k as double)) s, sum(k) over (partition by l, g) ng from cell),
best as (select l, sum(m) m, sum(s) s, count(distinct c) k from part group by l order by round(sum(m) + sum(s), 9), l limit 1)""",
        recursive=True,
        select='select g as type, round(sum(part.m) + sum(part.s), 6) "VI", round((sum(part.m) + sum(part.s)) / max(ng), 6) "VI_norm", round(sum(part.m), 6) false_merge, round(sum(part.s), 6) false_split, round(any_value(best.m), 6) as merge, round(any_value(best.s), 6) split, any_value(best.k) clusters from part join best using (l) group by g',
    ),
    "kmeans_assigned": with_(EMB, CENTRES, select="select id bodyid, cast(c as int) as type, cast(row_number() over (partition by c order by id <> f, id) - 1 as int) ord from (select *, first_value(id) over (partition by c order by d, id) f from assigned)"),
    "kmeans_assigned_vi": with_(
        EMB,
        CENTRES,
        "cell as (select c l, label g, count(*) n from assigned group by all), part as (select *, n / cast(sum(n) over () as double) * log2(sum(n) over (partition by l) / cast(n as double)) m, n / cast(sum(n) over () as double) * log2(sum(n) over (partition by g) / cast(n as double)) s, sum(n) over (partition by g) ng from cell)",
        select='select g as type, round(sum(m) + sum(s), 6) "VI", round((sum(m) + sum(s)) / max(ng), 6) "VI_norm", round(sum(m), 6) false_merge, round(sum(s), 6) false_split from part group by 1',
    ),
    "pca_distances": with_(EMB, select="select a.id b1, b.id b2, round(list_distance(a.v, b.v), 6) dist from emb a join emb b on a.id < b.id"),
    "pca_moments": with_(
        EMB,
        """
flat as (select id, unnest(v) x, unnest(range(len(v))) i from emb),
c as (select a.i, b.i j, covar_samp(a.x, b.x) c from flat a join flat b using (id) group by a.i, b.i)""",
        select="select round(sum(c) filter (i = j), 6) total, round(sum(c * c), 6) squares, 0.0::double as between from c",
    ),
    "kmeans_lloyd": with_(EMB, LLOYD, recursive=True, select="select id bodyid, cast(c as int) as type from moved where step = 5"),
    "kmeans_lloyd_vi": with_(
        EMB,
        LLOYD,
        "cell as (select c l, label g, count(*) n from moved where step = 5 group by all), part as (select *, n / cast(sum(n) over () as double) * log2(sum(n) over (partition by l) / cast(n as double)) m, n / cast(sum(n) over () as double) * log2(sum(n) over (partition by g) / cast(n as double)) s, sum(n) over (partition by g) ng from cell)",
        recursive=True,
        select='select g as type, round(sum(m) + sum(s), 6) "VI", round((sum(m) + sum(s)) / max(ng), 6) "VI_norm", round(sum(m), 6) false_merge, round(sum(s), 6) false_split from part group by 1',
    ),
    "workflow_simple": workflow_rounds("null", (0.9, 0.0, 0.1)),
    "workflow": workflow_rounds("saved", (0.4, 0.4, 0.2)),
}
