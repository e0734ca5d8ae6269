"""Density clusters, voids, walks and tours over the map."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.operators import density, search, terrain, walks
from folioscope.plans.base import query
from folioscope.sources.views import graph_edges, vectors


def _neighbours(spark, sf_dir, k: int):
    return search.knn_graph(vectors(spark, sf_dir), k).withColumn("dist", F.round(1 - F.col("sim"), 9))


@query()
def density_clusters(spark, sf_dir):
    """Clusters of at least eight chunks by density among their twelve neighbours; noise to the nearest centroid."""
    found = density.density_clusters(vectors(spark, sf_dir), _neighbours(spark, sf_dir, 12), 8, 4)
    return found.select("chunk_id", "cluster", "noise")


_SIDE = 32
_POINTS = "pts as (select vec_id as chunk_id, (embedding[1]::double * 1.5 + 1) / 2 as x, (embedding[2]::double * 1.5 + 1) / 2 as y from embeddings)"


def _spread(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select("chunk_id", *(((F.col("embedding")[i] * 1.5 + 1) / 2).alias(n) for i, n in enumerate("xy")))


def _blur_sql(name: str, source: str, sigma: float) -> str:
    """Common table expressions for a blur that reads the mirrored map at every cell and offset."""
    r = int(4 * sigma + 0.5)
    w = f"{name}_w as (select d, exp(-0.5 * pow(d / {sigma}, 2)) as w from (select unnest(generate_series({-r}, {r})) as d)), {name}_k as (select d, w / (select sum(w) from {name}_w) as w from {name}_w)"
    fold = lambda c: f"case when ({c}) % {2 * _SIDE} < 0 then ({c}) % {2 * _SIDE} + {2 * _SIDE} else ({c}) % {2 * _SIDE} end"
    mirror = lambda c: f"(case when ({fold(c)}) >= {_SIDE} then {2 * _SIDE - 1} - ({fold(c)}) else ({fold(c)}) end)"
    x = f"{name}_x as (select a.gx, a.gy, sum(coalesce(s.v, 0) * w) as v from grid a cross join {name}_k k left join {source} s on s.gx = {mirror('a.gx + k.d')} and s.gy = a.gy group by 1, 2)"
    return f"{w}, {x}, {name} as (select a.gx, a.gy, sum(s.v * w) as v from grid a cross join {name}_k k join {name}_x s on s.gy = {mirror('a.gy + k.d')} and s.gx = a.gx group by 1, 2)"


_RELIEF = f"""{_POINTS}, grid as (select x.i as gx, y.i as gy from (select unnest(generate_series(0, {_SIDE - 1})) as i) x, (select unnest(generate_series(0, {_SIDE - 1})) as i) y),
counts as (select least({_SIDE - 1}, greatest(0, floor(x * {_SIDE})))::int as gx, least({_SIDE - 1}, greatest(0, floor(y * {_SIDE})))::int as gy, count(*)::double as v from pts group by 1, 2), ones as (select gx, gy, 1.0::double as v from counts),
{_blur_sql('wide', 'counts', 1.0)}, {_blur_sql('narrow', 'counts', 0.5)}, {_blur_sql('about', 'ones', 2.5)},
h as (select gx, gy, ln(1 + wide.v + 0.35 * narrow.v) as h from wide join narrow using (gx, gy)), relief as (select h.gx, h.gy, h / (select max(h) from h) as v, about.v > 0.02 as occupied from h join about using (gx, gy))"""


def _relief(spark, sf_dir):
    return terrain.relief(_spread(spark, sf_dir), _SIDE, 1.0, 0.5, 2.5)


@query(f"with {_RELIEF} select gx, gy, round(v, 6) as v, occupied from relief where v > 1e-7 or occupied")
def map_relief(spark, sf_dir):
    """Heights of the map in two blurs, and where chunks are about."""
    return _relief(spark, sf_dir).filter("v > 1e-7 or occupied").withColumn("v", F.round("v", 6))


@query(f"""with recursive {_RELIEF}, low as (select gy * {_SIDE} + gx as node, gx, gy from relief where v < 0.1 and occupied),
reach(node, root) as (select node, node from low union select l.node, r.root from reach r join low f on f.node = r.node join low l on abs(l.gx - f.gx) + abs(l.gy - f.gy) = 1 where r.root < l.node),
areas as (select c.void, count(*) as area, avg(gx) / {_SIDE} as x, avg(gy) / {_SIDE} as y from (select node, min(root) as void from reach group by 1) c join low using (node) group by 1 having count(*) >= 3),
largest as (select * from areas order by area desc, void limit 10),
near as (select void, chunk_id, row_number() over (partition by void order by round(pow(p.x - l.x, 2) + pow(p.y - l.y, 2), 12), chunk_id) as r from largest l, pts p)
select void, area, round(x, 6) as x, round(y, 6) as y, string_agg(chunk_id, ',' order by r) filter (r <= 12) as near from largest join near using (void) group by all""")
def map_voids(spark, sf_dir):
    """Low regions that chunks surround, and the twelve chunks nearest to each."""
    found = terrain.voids(_relief(spark, sf_dir), _SIDE, least_area=3)
    near = terrain.around(found, _spread(spark, sf_dir), "void").groupBy("void").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("l"))
    listed = F.array_join(F.transform("l", lambda x: x["chunk_id"].cast("string")), ",")
    return found.join(near, "void").select(F.col("void").cast("long").alias("void"), "area", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), listed.alias("near"))


_KNN = """n as (select vec_id, embedding::double[] as e from embeddings), s as (select a.vec_id as i, b.vec_id as j, round(greatest(0, list_cosine_similarity(a.e, b.e)), 6) as sim from n a join n b on a.vec_id <> b.vec_id),
g as (select * from (select i, j, sim, row_number() over (partition by i order by sim desc, j) as r from s) where r <= 8)"""


def _walk_sql(near: str, extra: str = "") -> str:
    scores = f"""list_transform(near, lambda c: (2.4 * c.sim - case when c.j = w.node then 4 else 0 end - case when c.j = w.previous then 1.7 else 0 end
        - case when list_contains(w.trail, c.j) then 1.25 * exp(-(list_position(w.trail, c.j) - 1) / 14.0) else 0 end {extra}) / 0.5)"""
    return f"""w(walk, step, node, previous, trail) as (select vec_id, 0, vec_id, cast(null as bigint), [vec_id] from embeddings where vec_id % 10 = 0 union all
    select walk, step + 1, j, node, list_prepend(j, trail) from (select walk, step, node, trail, near[least(len(near), 1 + len(list_filter(upto, lambda x: x < ((walk * 7919 + (step + 1) * 104729) % 10007) / 10007.0 * upto[-1])))].j as j from (
        select walk, step, node, trail, near, list_transform(generate_series(1, len(e)), lambda k: list_sum(e[1:k])) as upto from (
            select walk, step, node, trail, near, list_transform(v, lambda x: exp(x - list_max(v))) as e from (select w.walk, w.step, w.node, w.trail, near, {scores} as v from w join {near} near_lists on near_lists.i = w.node where w.step < 10)))))"""


_DRAW = "((walk * 7919 + step * 104729) % 10007) / 10007.0D"


def _graph(v):
    return search.knn_graph(v, 8).withColumn("sim", F.round("sim", 6))


def _starts(v):
    """Every tenth chunk begins a walk: a set of queries."""
    return v.filter("chunk_id % 10 = 0").select(F.col("chunk_id").alias("walk"), F.col("chunk_id").alias("node"))


@query(f"""with recursive {_KNN}, lists as (select i, list({{'j': j, 'sim': sim}} order by r) as near from g group by i), {_walk_sql('lists')} select walk, step, node from w""")
def random_walks(spark, sf_dir):
    """Ten steps over the neighbour graph from every tenth chunk."""
    v = vectors(spark, sf_dir)
    return walks.walk(_graph(v), _starts(v), 10, F.expr(_DRAW))


@query(f"""with recursive {_KNN}, {_POINTS}, q as (select vec_id, list_cosine_similarity(e, (select e from n where vec_id = 0)) as score from n), h as (select * from q order by score desc, vec_id limit 40),
hw as (select vec_id, 0.3 + 0.7 * (score - min(score) over ()) / (max(score) over () - min(score) over ()) as hit from h), c as (select sum(x * hit * hit) / sum(hit * hit) as cx, sum(y * hit * hit) / sum(hit * hit) as cy from hw join pts on chunk_id = vec_id),
far as (select chunk_id, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) as d from pts, c), sides as (select g.i, g.r, g.j, g.sim, e.d - f.d as gain, coalesce(hit, 0) as hit from g join far e on e.chunk_id = g.i join far f on f.chunk_id = g.j left join hw on hw.vec_id = g.j),
lists as (select i, list({{'j': j, 'sim': sim, 'gain': gain, 'hit': hit}} order by r) as near, greatest(1e-6, max(abs(gain))) as widest from sides group by i), {_walk_sql('lists', '+ 0.8 * 2.7 * c.gain / near_lists.widest + 0.8 * 1.6 * c.hit')} select walk, step, node from w""")
def station_walks(spark, sf_dir):
    """The same walks drawn towards the station of a query."""
    v = vectors(spark, sf_dir)
    points = _spread(spark, sf_dir)
    hits = search.vector_search(v, v.filter("chunk_id = 0").select(F.col("embedding").alias("q")), 40)
    return walks.walk(_graph(v), _starts(v), 10, F.expr(_DRAW), (points, *walks.station(hits, points)), 0.8)


_STAR = "stars as (select s_name as g, cast(regexp_extract(dst, '[0-9]+') as int) as seq, round(weight * 0.37 % 1, 6) as x, round(weight * cast(regexp_extract(dst, '[0-9]+') as int) * 0.113 % 1, 6) as y from starred)"


@query(f"""with recursive starred as (select s_name, p_brand as dst, count(*)::double as weight from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by 1, 2),
{_STAR}, ranked as (select *, row_number() over (partition by g order by seq) as n from stars), members as (select * from ranked where n <= 12),
first as (select g, seq, x, y from members qualify row_number() over (partition by g order by pow(x - 0.5, 2) + pow(y - 0.5, 2), seq) = 1),
way(g, step, seq, x, y, seen) as (select g, 1, seq, x, y, [seq] from first union all
    select g, step + 1, p.seq, p.x, p.y, list_append(seen, p.seq) from (select w.g, w.step, w.seen, list_min(list_transform(list_filter(l.ms, lambda m: not list_contains(w.seen, m.seq)), lambda m: {{'d': pow(m.x - w.x, 2) + pow(m.y - w.y, 2), 'seq': m.seq, 'x': m.x, 'y': m.y}})) as p
        from way w join (select g, list({{'seq': seq, 'x': x, 'y': y}}) as ms from members group by 1) l on l.g = w.g where len(w.seen) < len(l.ms)))
select g as name, step, seq from way""")
def constellation_tours(spark, sf_dir):
    """A way through the brands around each supplier, as a constellation's figure is drawn."""
    brands = graph_edges(spark, sf_dir).filter(F.col("dst").startswith("Brand")).withColumn("seq", F.regexp_extract("dst", "[0-9]+", 0).cast("int"))
    placed = brands.select(F.col("src").alias("name"), "seq", F.round(F.col("weight") * 0.37 % 1, 6).alias("x"), F.round(F.col("weight") * F.col("seq") * 0.113 % 1, 6).alias("y"))
    members = placed.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("seq"))).filter("n <= 12").drop("n")  # what a figure shows
    anchors = members.select("name").distinct().select("name", F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    return terrain.tour(members, anchors, "name")
