"""Queries on the surveyed grid: the depth cube, filters, terrain, streams, zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ponding.functions import hydro
from ponding.operators import flats, grid, simplify, streams, zones
from ponding.plans.domain import SURVEY, read, side, survey
from ponding.plans.registry import query

STORM = "(6 + 145 * exp(-((x - (0.15 + 0.70 * t / 180)) ** 2 + (y - (0.55 + 0.05 * sin(t / 40))) ** 2) / (2 * 0.22 * 0.22)) * exp(-(((t - 70.0) / 70) ** 2)))"
IMPERV = "(0.78 - 0.30 * exp(-((x - 0.7) ** 2 + (y - 0.25) ** 2) / (2 * 0.08 * 0.08)))"
CAPACITY = "(32 - 24 * (exp(-((x - 0.35) ** 2 + (y - 0.62) ** 2) / (2 * 0.04 * 0.04)) + exp(-((x - 0.62) ** 2 + (y - 0.55) ** 2) / (2 * 0.04 * 0.04)) + exp(-((x - 0.45) ** 2 + (y - 0.20) ** 2) / (2 * 0.04 * 0.04))))"
LOWNESS = "least(greatest(exp(-(25 * abs(y - (0.55 + 0.12 * sin(6.283185307179586 * 1.3 * x + 0.5))) ** 1.2) / 1.6) + 0.9 * (exp(-((x - 0.28) ** 2 + (y - 0.30) ** 2) / (2 * 0.035 ** 2)) + exp(-((x - 0.72) ** 2 + (y - 0.42) ** 2) / (2 * 0.03 ** 2)) + exp(-((x - 0.50) ** 2 + (y - 0.80) ** 2) / (2 * 0.04 ** 2))), 0), 1.4)"
CUBE = f"""{SURVEY}, net AS (SELECT row, col, x, y, t::DOUBLE AS t, ({STORM} * {IMPERV} - {CAPACITY} * (1 - 0.3 * blocked)) * (5 / 60.0::DOUBLE) AS net FROM dem, (SELECT (range * 5)::DOUBLE AS t FROM range(37))),
p AS (SELECT *, sum(net) OVER (PARTITION BY row, col ORDER BY t) AS p FROM net), s AS (SELECT *, p - least(0, min(p) OVER (PARTITION BY row, col ORDER BY t)) AS storage FROM p),
cube AS (SELECT t::INT AS lead, row, col, storage, least(greatest(storage * 0.42 * (0.12 + 2 * ({LOWNESS}) ** 1.3), 0), 150) AS depth_cm FROM s WHERE t::INT % 15 = 0)"""


def terrain(spark, sf_dir):
    """The surveyed city with its lowness, and the side of the grid."""
    c, n = survey(spark, sf_dir)
    low = hydro.clip(F.exp(-(hydro.synthetic_elevation(F.col("x"), F.col("y")) - 900.0 - 3.0 * (1.0 - F.col("x"))) / 1.6) + 0.9 * hydro.sinks(F.col("x"), F.col("y")), 0, 1.4)
    return c.withColumn("low", low), n


def depth_cube(spark, sf_dir):
    """Depth in cm for each lead and cell of the demonstration storm, before smoothing; drains take less where they are blocked."""
    x, y = F.col("x"), F.col("y")
    c, _ = terrain(spark, sf_dir)
    out = grid.storage_balance(c.select("row", "col", "x", "y", "blocked", "low"), hydro.storm(F.col("t"), x, y), hydro.synthetic_imperviousness(x, y), hydro.drain_capacity(x, y) * (1 - 0.3 * F.col("blocked")))
    return out.withColumn("depth_cm", hydro.depth_cm(F.col("storage"), F.col("low")))


@query(f"WITH {CUBE} SELECT lead, row, col, round(storage, 4) AS storage, round(depth_cm, 3) AS depth_cm FROM cube")
def storage_balance_cube(spark, sf_dir):
    return depth_cube(spark, sf_dir).select("lead", "row", "col", F.round("storage", 4).alias("storage"), F.round("depth_cm", 3).alias("depth_cm"))


ALERTS = f"""{CUBE}, segs AS (SELECT *, 'reach ' || (row // 4) || '-' || (col // 4) AS name FROM cube),
e AS (SELECT name, row, col, max(depth_cm) AS peak, min(CASE WHEN depth_cm >= 10 THEN lead END) AS onset, arg_min(lead, (-depth_cm, lead)) AS peak_lead FROM segs GROUP BY ALL)"""


@query(f"""WITH {ALERTS} SELECT name, round(peak, 2) AS peak_cm, onset, peak_lead FROM e QUALIFY row_number() OVER (PARTITION BY name ORDER BY peak DESC, row, col) = 1 ORDER BY peak DESC, name LIMIT 10""")
def alerts_top_ten(spark, sf_dir):
    """The worst cell of each reach with onset and peak, the ten worst reaches."""
    return alerts(depth_cube(spark, sf_dir).withColumn("name", F.concat(F.lit("reach "), F.floor(F.col("row") / 4).cast("string"), F.lit("-"), F.floor(F.col("col") / 4).cast("string"))), ["row", "col"], top=10)


def alerts(depths, edge: list[str], top: int = 10, flooded: float = hydro.FLOODED_CM):
    """depths: name, the edge columns, lead, depth_cm. Per name the edge with the highest peak (true maximum; ties: the first edge)."""
    per = depths.groupBy("name", *edge).agg(F.max("depth_cm").alias("peak"), F.min(F.when(F.col("depth_cm") >= flooded, F.col("lead"))).alias("onset"), F.min_by("lead", F.struct(-F.col("depth_cm"), "lead")).alias("peak_lead"))
    worst = per.groupBy("name").agg(F.min(F.struct((-F.col("peak")).alias("minus"), *edge, "onset", "peak_lead")).alias("b"))
    out = worst.select("name", (-F.col("b.minus")).alias("peak"), "b.onset", "b.peak_lead").orderBy(F.desc("peak"), "name").limit(top)
    return out.select("name", F.round("peak", 2).alias("peak_cm"), "onset", "peak_lead")


SIGMA, RADIUS = 1.2, 5
GAUSS = f"""{CUBE}, w0 AS (SELECT range - {RADIUS} AS k, exp(-0.5 * ((range - {RADIUS}) / {SIGMA}) ** 2) AS w FROM range({2 * RADIUS + 1})), w AS (SELECT k, w / (SELECT sum(w) FROM w0) AS w FROM w0),
a AS (SELECT c.lead, c.row, c.col, sum(d.depth_cm * w.w) AS v FROM cube c, w, cube d WHERE d.lead = c.lead AND d.row = c.row AND d.col = CASE WHEN c.col + k < 0 THEN -(c.col + k) - 1 WHEN c.col + k >= (SELECT n FROM g) THEN 2 * (SELECT n FROM g) - 1 - (c.col + k) ELSE c.col + k END GROUP BY ALL),
b AS (SELECT c.lead, c.row, c.col, sum(d.v * w.w) AS v FROM a c, w, a d WHERE d.lead = c.lead AND d.col = c.col AND d.row = CASE WHEN c.row + k < 0 THEN -(c.row + k) - 1 WHEN c.row + k >= (SELECT n FROM g) THEN 2 * (SELECT n FROM g) - 1 - (c.row + k) ELSE c.row + k END GROUP BY ALL)"""


@query(f"WITH {GAUSS} SELECT lead, row, col, round(v, 3) AS depth_cm FROM b")
def gaussian_depth(spark, sf_dir):
    d = depth_cube(spark, sf_dir).select("lead", "row", "col", "depth_cm")
    return grid.gaussian(d, side(spark, sf_dir), SIGMA, "depth_cm", ["lead"]).select("lead", "row", "col", F.round("depth_cm", 3).alias("depth_cm"))


@query(f"""WITH {SURVEY}, grad AS (SELECT row, col, z, lag(z) OVER r AS u, lead(z) OVER r AS d, lag(z) OVER c AS l, lead(z) OVER c AS e FROM dem WINDOW r AS (PARTITION BY col ORDER BY row), c AS (PARTITION BY row ORDER BY col)),
s AS (SELECT row, col, CASE WHEN u IS NULL THEN d - z WHEN d IS NULL THEN z - u ELSE (d - u) / 2 END / 1000 AS a, CASE WHEN l IS NULL THEN e - z WHEN e IS NULL THEN z - l ELSE (e - l) / 2 END / 1000 AS b FROM grad)
SELECT row, col, round(a, 5) AS dz_row, round(b, 5) AS dz_col, round(degrees(atan(sqrt(a * a + b * b))), 4) AS slope_deg FROM s""")
def terrain_slope(spark, sf_dir):
    return grid.slope(survey(spark, sf_dir)[0], 1000.0).select("row", "col", F.round("dz_row", 5).alias("dz_row"), F.round("dz_col", 5).alias("dz_col"), F.round("slope_deg", 4).alias("slope_deg"))


@query(f"""WITH {SURVEY}, m AS (SELECT row, col, n FROM dem, g WHERE z < 400) SELECT DISTINCT m.row + a AS row, m.col + b AS col FROM m, (VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) o(a, b) WHERE m.row + a BETWEEN 0 AND n - 1 AND m.col + b BETWEEN 0 AND n - 1""")
def binary_dilation(spark, sf_dir):
    c, n = survey(spark, sf_dir)
    return grid.dilate(c.where("z < 400").select("row", "col"), n)


def downhill(spark, sf_dir):
    """The terrain, each cell's receiver, and the side of the grid."""
    d, n = survey(spark, sf_dir)
    return d, grid.settle(grid.receivers(grid.flow_direction(d), n)), n


FLOW = f"""{SURVEY}, o(k, code, a, b) AS (VALUES (1,64,-1,0),(2,128,-1,1),(3,1,0,1),(4,2,1,1),(5,4,1,0),(6,8,1,-1),(7,16,0,-1),(8,32,-1,-1)),
best AS (SELECT d.cell, d.row, d.col, e.cell AS rec, code FROM dem d, o, dem e WHERE e.row = d.row + a AND e.col = d.col + b AND d.z > e.z QUALIFY row_number() OVER (PARTITION BY d.cell ORDER BY (d.z - e.z) / sqrt(abs(a) + abs(b)) DESC, k) = 1),
flow AS (SELECT d.cell, coalesce(best.rec, d.cell) AS rec, best.code FROM dem d LEFT JOIN best USING (cell))"""


@query(f"WITH {FLOW} SELECT cell // n AS row, cell % n AS col, code, rec FROM flow, g")
def flow_direction(spark, sf_dir):
    c, n = survey(spark, sf_dir)
    d = grid.flow_direction(c)
    r = grid.receivers(d, n)
    return d.withColumn("cell", (F.col("row") * n + F.col("col")).cast("long")).join(r, "cell").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "code", "rec")


@query(f"""WITH RECURSIVE {FLOW}, walk AS (SELECT cell, cell AS pos FROM flow UNION ALL SELECT w.cell, f.rec FROM walk w JOIN flow f ON f.cell = w.pos WHERE f.rec <> f.cell)
SELECT pos AS cell, count(*)::DOUBLE AS acc FROM walk GROUP BY pos""")
def flow_accumulation(spark, sf_dir):
    _, flow, n = downhill(spark, sf_dir)
    return grid.accumulate(flow, n=n)


@query(f"""WITH RECURSIVE {FLOW}, walk AS (SELECT f.cell, f.cell AS pos, 0 AS n FROM flow f UNION ALL SELECT w.cell, f.rec, n + 1 FROM walk w JOIN flow f ON f.cell = w.pos JOIN dem d ON d.cell = w.pos WHERE f.rec <> f.cell AND d.z >= 400),
t AS (SELECT cell, arg_max(pos, n) AS target FROM walk GROUP BY cell) SELECT t.cell, t.target, greatest(d.z - e.z, 0) / 100 AS hand_m FROM t JOIN dem d ON d.cell = t.cell JOIN dem e ON e.cell = t.target""")
def height_above_drainage(spark, sf_dir):
    """Each cell's first low cell downstream, and its height above it."""
    d, flow, n = downhill(spark, sf_dir)
    target = grid.jump(flow, d.where("z < 400").select("cell"), n=n)
    d = d.select("cell", "z")
    at = d.select(F.col("cell").alias("target"), F.col("z").alias("z_t"))
    return target.join(d, "cell").join(at, "target").select("cell", "target", (F.greatest(F.col("z") - F.col("z_t"), F.lit(0.0)) / 100).alias("hand_m"))


#: Cells that drain so many make a stream.
STREAM = 12
STREAMS = f"""{FLOW}, walk AS (SELECT cell, cell AS pos FROM flow UNION ALL SELECT w.cell, f.rec FROM walk w JOIN flow f ON f.cell = w.pos WHERE f.rec <> f.cell), acc AS (SELECT pos AS cell, count(*) AS acc FROM walk GROUP BY pos),
st AS (SELECT f.cell, f.rec, acc FROM flow f JOIN acc USING (cell) WHERE acc >= {STREAM}), infl AS (SELECT rec AS cell, count(*) AS inflow FROM st WHERE rec <> cell GROUP BY rec),
t AS (SELECT st.cell, st.rec, st.acc, coalesce(i.inflow, 0) AS inflow, st.rec = st.cell OR b.cell IS NULL OR coalesce(ib.inflow, 0) >= 2 AS terminal FROM st LEFT JOIN infl i ON i.cell = st.cell LEFT JOIN st b ON b.cell = st.rec LEFT JOIN infl ib ON ib.cell = st.rec),
lw AS (SELECT cell, cell AS pos FROM t UNION ALL SELECT l.cell, t.rec FROM lw l JOIN t ON t.cell = l.pos WHERE NOT t.terminal), linked AS (SELECT lw.cell, lw.pos AS link FROM lw JOIN t ON t.cell = lw.pos WHERE t.terminal)"""


def routed(spark, sf_dir):
    """The terrain, its cells with their receivers, the linked stream cells, and the side of the grid."""
    d, flow, n = downhill(spark, sf_dir)
    return d, flow, streams.links_of(streams.stream_cells(flow, grid.accumulate(flow, n=n), STREAM), n), n


@query(f"WITH RECURSIVE {STREAMS} SELECT t.cell, inflow, terminal, link FROM t JOIN linked USING (cell)")
def stream_cells(spark, sf_dir):
    """Stream cells with their inflows, terminals and links."""
    return routed(spark, sf_dir)[2].select("cell", "inflow", "terminal", "link")


@query(f"""WITH RECURSIVE {STREAMS}, own AS (SELECT link, count(*) AS cells, max(acc)::DOUBLE AS acc, arg_min(z, acc) - arg_max(z, acc) AS fall, sum(CASE WHEN rec <> t.cell THEN 10 * sqrt((rec // n - t.cell // n) ** 2 + (rec % n - t.cell % n) ** 2) ELSE 0 END) AS length_m FROM t JOIN linked USING (cell) JOIN dem USING (cell), g GROUP BY link),
down AS (SELECT t.cell AS link, l.link AS downstream FROM t LEFT JOIN linked l ON l.cell = t.rec AND t.rec <> t.cell WHERE terminal)
SELECT link, downstream, cells, round(length_m, 3) AS length_m, fall AS drop_m, round(CASE WHEN length_m > 0 THEN greatest(fall, 0) / length_m ELSE 0 END, 6) AS gradient, acc FROM own JOIN down USING (link)""")
def stream_links(spark, sf_dir):
    """Links with what lies below, length, drop and gradient."""
    d, _, linked, n = routed(spark, sf_dir)
    out = streams.stream_links(linked, d.select("cell", "z"), n, 10.0)
    return out.select("link", "downstream", F.col("cells").cast("long").alias("cells"), F.round("length_m", 3).alias("length_m"), "drop_m", F.round("gradient", 6).alias("gradient"), "acc")


@query(f"""WITH RECURSIVE {STREAMS}, cw AS (SELECT f.cell, f.cell AS pos FROM flow f UNION ALL SELECT c.cell, f.rec FROM cw c JOIN flow f ON f.cell = c.pos LEFT JOIN st ON st.cell = c.pos WHERE st.cell IS NULL AND f.rec <> f.cell)
SELECT link, count(*) AS cells, round(avg(greatest(a.z - b.z, 0)), 4) AS mean_hand, max(greatest(a.z - b.z, 0)) AS top FROM cw JOIN linked l ON l.cell = cw.pos JOIN dem a ON a.cell = cw.cell JOIN dem b ON b.cell = cw.pos GROUP BY link""")
def micro_catchments(spark, sf_dir):
    """The cells that drain into each link, and their height above it."""
    d, flow, linked, n = routed(spark, sf_dir)
    c = streams.catchments(flow, linked, d.select("cell", "z"), n=n).where("link is not null")
    return c.groupBy("link").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("hand"), 4).alias("mean_hand"), F.max("hand").alias("top"))


@query(f"""WITH {SURVEY}, l AS (FROM dem), burn AS (SELECT row, col, 2.0::DOUBLE AS depth FROM l WHERE class = 80 UNION ALL SELECT row, col, 3.0::DOUBLE FROM l WHERE col % 9 = 0 UNION ALL SELECT row, col, 1.5::DOUBLE FROM l WHERE row % 7 = 0)
SELECT l.row, l.col, z - coalesce(max(depth), 0) AS burnt, class = 80 AND z <= 300 AS sea FROM l LEFT JOIN burn b ON b.row = l.row AND b.col = l.col GROUP BY l.row, l.col, z, class""")
def burned_terrain(spark, sf_dir):
    """Drains and water cut into the terrain, the deepest layer of each cell; low open water is sea."""
    c, _ = survey(spark, sf_dir)
    layer = lambda where, depth: c.where(where).select("row", "col", F.lit(depth).alias("depth"))
    out = streams.burn(c, layer("class = 80", 2.0), layer("col % 9 = 0", 3.0), layer("row % 7 = 0", 1.5))
    return out.select("row", "col", (F.col("z") - F.col("burn")).alias("burnt"), streams.sea(F.col("class"), F.col("z"), level=300.0).alias("sea"))


@query(f"""WITH RECURSIVE {STREAMS}, near AS (SELECT DISTINCT st.cell // n + a AS row, st.cell % n + b AS col FROM st, g, (VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) o(a, b)),
d AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'Primary' ELSE 'Secondary' END AS kind, (c_custkey * 7919) % (n - 8) + 0.5 AS x, (c_custkey * 104729) % n + 0.5 AS y, 2 + c_custkey % 5 AS w, n FROM customer, g),
s AS (SELECT kind, floor(y)::INT AS row, floor(x + k * w / (2.0 * w))::INT AS col FROM d, range(17) t(k) WHERE k <= 2 * w)
SELECT kind, round(avg((near.row IS NOT NULL)::INT), 6) AS share, count(*) AS samples FROM s LEFT JOIN near USING (row, col) GROUP BY kind""")
def drain_alignment(spark, sf_dir):
    """The share of samples, two for each cell's width along each drain, that lie on or beside a stream."""
    _, _, linked, n = routed(spark, sf_dir)
    k = F.col("c_custkey")
    x, y, w = k * 7919 % (n - 8) + 0.5, k * 104729 % n + 0.5, 2 + k % 5
    point = lambda lon, lat: F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))
    drains = read(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 0, "Primary").otherwise("Secondary").alias("kind"), F.array(point(x, y), point(x + w, y)).alias("coords"))
    cells = linked.select(F.floor(F.col("cell") / n).cast("int").alias("row"), F.pmod("cell", F.lit(n)).cast("int").alias("col"))
    return streams.alignment(streams.samples_along(drains, 0.5), grid.dilate(cells, n)).select("kind", F.round("share", 6).alias("share"), "samples")


@query(f"""WITH {SURVEY}, f AS (SELECT *, cell % 53 AS zone, CASE WHEN cell % 7 <> 0 THEN z END AS v FROM dem)
SELECT zone, count(*) AS cells, round(sum(coalesce(v, 0)), 2) AS sum_v, round(sum(coalesce(v, 0)) / count(*), 4) AS mean_v, round(avg((z < 400)::INT), 4) AS low_share, round(avg(row), 3) AS y, round(avg(col), 3) AS x FROM f GROUP BY zone""")
def zonal_statistics(spark, sf_dir):
    f = survey(spark, sf_dir)[0].withColumn("zone", F.col("cell") % 53).withColumn("v", F.when(F.col("cell") % 7 != 0, F.col("z")))
    share = f.groupBy("zone").agg(F.round(F.avg((F.col("z") < 400).cast("int")), 4).alias("low_share"), F.round(F.avg("row"), 3).alias("y"), F.round(F.avg("col"), 3).alias("x"))
    return grid.zonal(f, "zone", "v").join(share, "zone").select("zone", "cells", F.round("sum_v", 2).alias("sum_v"), F.round("mean_v", 4).alias("mean_v"), "low_share", "y", "x")


@query(f"""WITH {SURVEY} SELECT floor((row + 0.5) * 16 / n)::INT AS row, floor((col + 0.5) * 16 / n)::INT AS col, round(avg(z), 4) AS z FROM dem, g GROUP BY 1, 2""")
def regrid_average(spark, sf_dir):
    c, n = survey(spark, sf_dir)
    return grid.regrid(c, n, 16, "z").select("row", "col", F.round("z", 4).alias("z"))


@query(f"""WITH {SURVEY}, l AS (SELECT row, col, x, y, class FROM dem)
SELECT class, count(*) AS cells, any_value(CASE class WHEN 10 THEN 70 WHEN 20 THEN 73 WHEN 30 THEN 74 WHEN 40 THEN 85 WHEN 50 THEN 79 WHEN 60 THEN 91 WHEN 70 THEN 74 WHEN 80 THEN 100 WHEN 90 THEN 85 WHEN 95 THEN 70 ELSE 74 END)::DOUBLE AS cn,
 round(avg(least(greatest(greatest(CASE class WHEN 10 THEN 0.05 WHEN 20 THEN 0.10 WHEN 30 THEN 0.15 WHEN 40 THEN 0.20 WHEN 50 THEN 0.85 WHEN 60 THEN 0.40 WHEN 100 THEN 0.05 ELSE 0 END, x * y), 0), 0.98)), 5) AS imperv FROM l GROUP BY class""")
def land_cover_lookup(spark, sf_dir):
    c, _ = survey(spark, sf_dir)
    share = hydro.clip(F.greatest(hydro.lookup(hydro.IMPERVIOUS, F.col("class")), F.col("x") * F.col("y")), 0, 0.98)
    return c.groupBy("class").agg(F.count(F.lit(1)).alias("cells"), F.max(hydro.lookup(hydro.CURVE_NUMBER, F.col("class"))).alias("cn"), F.round(F.avg(share), 5).alias("imperv"))


@query()
def filled_depressions(spark, sf_dir):
    """Pits raised to their spill level (iterative; a test compares these rows with a priority queue)."""
    c, n = survey(spark, sf_dir)
    return grid.fill_depressions(c, n).select("row", "col", "z", "w")


@query()
def flow_across_flats(spark, sf_dir):
    """Directions on the survey in steps of half a metre, depressions filled and flats resolved (iterative; a test compares these rows with plain loops)."""
    c, n = survey(spark, sf_dir)
    level = grid.fill_depressions(c.withColumn("z", F.floor(F.col("z") / 50) * 50.0), n)
    return flats.flow_across_flats(level, n).select("row", "col", "code", "row2", "col2")


AREAS = f"""{STREAMS}, cw AS (SELECT f.cell, f.cell AS pos FROM flow f UNION ALL SELECT c.cell, f.rec FROM cw c JOIN flow f ON f.cell = c.pos LEFT JOIN st ON st.cell = c.pos WHERE st.cell IS NULL AND f.rec <> f.cell),
z AS (SELECT cw.cell // n AS row, cw.cell % n AS col, link AS zone FROM cw JOIN linked l ON l.cell = cw.pos, g)"""


@query(f"""WITH RECURSIVE {AREAS}, size AS (SELECT zone, count(*)::DOUBLE AS area FROM z GROUP BY zone), rim AS (SELECT a.zone, 4 * count(DISTINCT (a.row, a.col)) - count(b.zone) AS perimeter FROM z a CROSS JOIN (VALUES (-1,0),(1,0),(0,-1),(0,1)) o(i, j) LEFT JOIN z b ON b.row = a.row + i AND b.col = a.col + j AND b.zone = a.zone GROUP BY a.zone),
corner AS (SELECT zone, row + i AS r, col + j AS c, sum(CASE WHEN i = j THEN 1 ELSE 4 END) AS kinds, count(*) AS k FROM z, (VALUES (0,0),(0,1),(1,0),(1,1)) o(i, j) GROUP BY ALL),
turns AS (SELECT zone, sum(CASE WHEN k = 1 THEN 1 WHEN k = 3 THEN -1 WHEN k = 2 AND kinds IN (2, 8) THEN 2 ELSE 0 END) // 4 AS balance FROM corner GROUP BY zone)
SELECT zone, area, perimeter::DOUBLE AS perimeter, balance::BIGINT AS balance FROM size JOIN rim USING (zone) JOIN turns USING (zone)""")
def catchment_polygons(spark, sf_dir):
    """The catchments of all links as polygons: their areas and perimeters, and outer rings less holes."""
    _, flow, linked, n = routed(spark, sf_dir)
    c = streams.reached(flow, linked, n)
    cells = c.select(F.floor(F.col("cell") / n).alias("row"), F.pmod("cell", F.lit(n)).alias("col"), F.col("link").alias("zone"))
    rings = zones.vectorise(cells)
    size = F.size("coords")
    steps = F.zip_with(F.slice("coords", F.lit(1), size - 1), F.slice("coords", F.lit(2), size - 1), lambda a, b: F.abs(a.lon - b.lon) + F.abs(a.lat - b.lat))
    around = rings.withColumn("around", F.aggregate(steps, F.lit(0.0), lambda s, x: s + x))
    return around.groupBy("zone").agg(F.sum("area").alias("area"), F.sum("around").alias("perimeter"), F.sum(F.signum("area")).cast("long").alias("balance"))


#: Drains as straight lines over the grid: sx, sy, ex, ey in cells, and a depth.
DRAINS = f"""{SURVEY}, drains AS (SELECT c_custkey AS id, (c_custkey * 7919) % n + 0.313 AS sx, (c_custkey * 104729) % n + 0.677 AS sy, (c_custkey * 7919) % n + 0.313 + (c_custkey * 31) % 13 - 6.1457 AS ex, (c_custkey * 104729) % n + 0.677 + (c_custkey * 17) % 11 - 5.0731 AS ey, 1.5 * (1 + c_custkey % 3) AS depth FROM customer, g)"""


@query(f"""WITH {DRAINS}, near AS (SELECT d.*, r, c FROM drains d, g, range(-7, 8) i(i), range(-6, 7) j(j), LATERAL (SELECT floor(sx)::INT + i AS c, floor(sy)::INT + j AS r) WHERE r BETWEEN 0 AND n - 1 AND c BETWEEN 0 AND n - 1),
t AS (SELECT *, least((c - sx) / (ex - sx), (c + 1 - sx) / (ex - sx)) AS a, greatest((c - sx) / (ex - sx), (c + 1 - sx) / (ex - sx)) AS b, least((r - sy) / (ey - sy), (r + 1 - sy) / (ey - sy)) AS p, greatest((r - sy) / (ey - sy), (r + 1 - sy) / (ey - sy)) AS q FROM near)
SELECT r AS row, c AS col, max(depth)::DOUBLE AS depth FROM t WHERE greatest(a, p, 0) <= least(b, q, 1) GROUP BY ALL""")
def rasterised_drains(spark, sf_dir):
    """Every cell that a drain touches, with the deepest of them."""
    n, k = side(spark, sf_dir), F.col("c_custkey")
    x, y = k * 7919 % n + 0.313, k * 104729 % n + 0.677
    point = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    drains = read(spark, sf_dir, "customer").select((1.5 * (1 + k % 3)).alias("depth"), F.array(point(x, y), point(x + k * 31 % 13 - 6.1457, y + k * 17 % 11 - 5.0731)).alias("coords"))
    return simplify.rasterise_lines(drains, "depth", n).select("row", "col", "depth")
