"""Queries on layers, nodes and series: filters, optional joins, tallies and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ponding.functions import hydro, presentation
from ponding.operators import grid, runoff, stats, streams
from ponding.plans.domain import CATCHMENTS, CONDUITS, SURVEY, catchments, conduits, read, survey
from ponding.plans.grid_queries import CUBE, depth_cube
from ponding.plans.registry import query
from ponding.plans.runoff_queries import WALK
from ponding.sources import model

KINDS = " economy, Small ,PROMO"


@query(f"SELECT p_partkey, p_type AS kind FROM part WHERE lower(trim(p_type)) IN (SELECT lower(trim(k)) FROM (SELECT unnest(string_split('{KINDS}', ',')) AS k))")
def drains_of_kinds(spark, sf_dir, kinds=KINDS):
    """The drains of a comma list of kinds, whatever their case and spaces."""
    wanted = [k.strip().lower() for k in kinds.split(",")]
    return read(spark, sf_dir, "part").where(F.lower(F.trim("p_type")).isin(wanted)).select("p_partkey", F.col("p_type").alias("kind"))


STRAHLER = f"""{CATCHMENTS}, c AS (SELECT id, downstream, CASE WHEN id > 0 THEN floor(log2(id))::INT ELSE 0 END AS lvl FROM catchments),
r AS (SELECT id, downstream, lvl, 1 AS s FROM c WHERE lvl = (SELECT max(lvl) FROM c) UNION ALL
 (WITH up AS (SELECT downstream AS id, max(s) AS m, count(*) AS n, arg_max(k, s) AS k FROM (SELECT downstream, s, count(*) AS k FROM r GROUP BY downstream, s) GROUP BY downstream), k AS (SELECT min(lvl) - 1 AS lvl FROM r)
 SELECT c.id, c.downstream, c.lvl, CASE WHEN up.id IS NULL THEN 1 WHEN up.k > 1 THEN up.m + 1 ELSE up.m END FROM c JOIN k ON c.lvl = k.lvl LEFT JOIN up ON up.id = c.id))"""


@query(f"WITH RECURSIVE {STRAHLER} SELECT s AS strahler, count(*) AS links FROM r GROUP BY s")
def strahler_orders(spark, sf_dir):
    c = catchments(spark, sf_dir)
    return runoff.strahler(c.select("id", "downstream")).groupBy("strahler").agg(F.count(F.lit(1)).alias("links"))


@query(f"WITH RECURSIVE {STRAHLER} SELECT id, s AS strahler FROM r WHERE s BETWEEN 2 AND 12")
def streams_of_order(spark, sf_dir, least=2, most=12):
    """Links of at least an order: the corridors, and what the map asks for."""
    return runoff.strahler(catchments(spark, sf_dir).select("id", "downstream")).where(F.col("strahler").between(least, most))


@query(f"""WITH {CONDUITS}, c AS (SELECT eid, nullif(depth, 0) AS depth, CASE WHEN width > 5 THEN width END AS width, CASE WHEN length_m > 100 THEN length_m END AS length_m FROM conduits)
SELECT count(*) AS conduits, count(*) FILTER (WHERE depth IS NOT NULL AND width IS NOT NULL AND length_m IS NOT NULL) AS complete, round(avg(coalesce(depth, (SELECT avg(depth) FROM c))), 6) AS depth_imputed, round(avg(coalesce(depth, (SELECT quantile_cont(depth, 0.5) FROM c))), 6) AS depth_by_median FROM c""")
def complete_conduits(spark, sf_dir):
    """Conduits with all measures, and the mean depth with missing ones set to the mean or the median of the others."""
    c = conduits(spark, sf_dir).select(F.nullif("depth", F.lit(0.0)).alias("depth"), F.when(F.col("width") > 5, F.col("width")).alias("width"), F.when(F.col("length_m") > 100, F.col("length_m")).alias("length_m"))
    mean = c.agg(F.avg("depth").alias("mean"))
    median = stats.quantiles(c, "depth", [0.5]).select(F.col("cut").alias("median"))
    filled = c.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(median))  # one row each
    complete = F.count_if(F.col("depth").isNotNull() & F.col("width").isNotNull() & F.col("length_m").isNotNull())
    return filled.agg(F.count(F.lit(1)).alias("conduits"), complete.alias("complete"), F.round(F.avg(F.coalesce("depth", "mean")), 6).alias("depth_imputed"), F.round(F.avg(F.coalesce("depth", "median")), 6).alias("depth_by_median"))


@query("""WITH spots AS (SELECT 'customer' AS layer, c_nationkey AS zone FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier UNION ALL SELECT 'nation', n_nationkey FROM nation)
SELECT zone, count(*) AS spots, count(DISTINCT layer) AS layers, (count(*) FILTER (WHERE layer = 'supplier'))::VARCHAR || ' of ' || count(*)::VARCHAR AS named FROM spots GROUP BY zone""")
def flood_spots(spark, sf_dir):
    """Three layers of spots put together as they are, and "x of y" by zone."""
    layer = lambda name, key: read(spark, sf_dir, name).select(F.lit(name).alias("layer"), F.col(key).alias("zone"))
    spots = layer("customer", "c_nationkey").unionByName(layer("supplier", "s_nationkey")).unionByName(layer("nation", "n_nationkey"))
    named = F.format_string("%d of %d", F.count_if(F.col("layer") == "supplier"), F.count(F.lit(1)))
    return spots.groupBy("zone").agg(F.count(F.lit(1)).alias("spots"), F.count_distinct("layer").alias("layers"), named.alias("named"))


VOLUMES = "volumes AS (SELECT user_id * 3 AS node, sum(value) AS volume FROM events WHERE event_type = 'error' GROUP BY 1)"
NODES = "nodes AS (SELECT node, count(*) AS degree, max(width) AS top FROM (SELECT u AS node, width FROM conduits UNION ALL SELECT v, width FROM conduits) GROUP BY node)"


def volumes(spark, sf_dir):
    return read(spark, sf_dir, "events").where("event_type = 'error'").groupBy((F.col("user_id") * 3).alias("node")).agg(F.sum("value").alias("volume"))


def nodes(spark, sf_dir):
    c = conduits(spark, sf_dir)
    return c.select(F.explode(F.array("u", "v")).alias("node"), "width").groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.max("width").alias("top"))


@query(f"WITH {CONDUITS}, {NODES}, {VOLUMES} SELECT node, round(coalesce(volume, 0), 2) AS volume FROM nodes LEFT JOIN volumes USING (node)")
def node_volumes(spark, sf_dir):
    """Flood volume of every node, 0 where none is reported."""
    return nodes(spark, sf_dir).join(volumes(spark, sf_dir), "node", "left").select("node", F.round(F.coalesce("volume", F.lit(0.0)), 2).alias("volume"))


@query(f"WITH {CONDUITS}, {NODES}, {VOLUMES} SELECT node, degree, top, round(volume, 2) AS volume FROM volumes JOIN nodes USING (node)")
def flooded_nodes(spark, sf_dir):
    """Reported nodes with what the network knows of them."""
    return volumes(spark, sf_dir).join(nodes(spark, sf_dir), "node").select("node", "degree", "top", F.round("volume", 2).alias("volume"))


@query(f"WITH {CONDUITS}, {NODES} SELECT c_custkey AS node FROM customer WHERE NOT EXISTS (SELECT 1 FROM nodes WHERE node = c_custkey)")
def unattached_nodes(spark, sf_dir):
    """Junctions without a road: no route can start or end there."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")).join(nodes(spark, sf_dir), "node", "left_anti")


@query("SELECT p_partkey, ('L' || lpad(p_partkey::VARCHAR, 5, '0'))[2:]::BIGINT AS number FROM part")
def label_numbers(spark, sf_dir):
    """The number in a label such as L00012."""
    label = F.concat(F.lit("L"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    return read(spark, sf_dir, "part").select("p_partkey", F.substring(label, 2, 20).cast("long").alias("number"))


@query(f"WITH {CUBE} SELECT round(max(depth_cm), 3) AS deepest_cm, round(max(storage), 4) AS most_mm, count(DISTINCT (row, col)) FILTER (WHERE depth_cm >= 10) AS flooded, (SELECT max(value) FROM events) AS peak_mm_per_h FROM cube")
def cube_maxima(spark, sf_dir):
    """The deepest water, the most stored, how many cells flood at any lead, and the strongest rain of all gauges."""
    d = depth_cube(spark, sf_dir)
    return d.agg(F.round(F.max("depth_cm"), 3).alias("deepest_cm"), F.round(F.max("storage"), 4).alias("most_mm"), F.count_distinct(F.when(F.col("depth_cm") >= 10, F.struct("row", "col"))).alias("flooded")).crossJoin(F.broadcast(read(spark, sf_dir, "events").agg(F.max("value").alias("peak_mm_per_h"))))


@query(f"WITH {CUBE} SELECT lead, count(*) FILTER (WHERE depth_cm >= 10) AS flooded FROM cube GROUP BY lead")
def flooded_counts(spark, sf_dir):
    """How many cells are flooded at each lead."""
    return depth_cube(spark, sf_dir).groupBy("lead").agg(F.count_if(F.col("depth_cm") >= 10).alias("flooded"))


@query("""WITH h AS (SELECT user_id AS gauge, date_trunc('hour', ts) AS hour, round(sum(value), 3) AS mm FROM events GROUP BY ALL), t AS (SELECT TIMESTAMP '2024-01-10 06:00:00' + INTERVAL (range) HOUR AS hour, range AS k FROM range(4))
SELECT g.gauge, k, coalesce(mm, 0) AS mm FROM (SELECT DISTINCT user_id AS gauge FROM events) g CROSS JOIN t LEFT JOIN h USING (gauge, hour)""")
def next_three_hours(spark, sf_dir, now="2024-01-10 06:40:00"):
    """Four hourly points of each gauge from the current hour on, 0 where none is known."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("gauge"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "value")
    hourly = e.groupBy("gauge", "hour").agg(F.round(F.sum("value"), 3).alias("mm"))
    first = F.date_trunc("hour", F.lit(now).cast("timestamp"))
    points = e.select("gauge").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("hour", F.timestamp_seconds(F.unix_timestamp(first) + F.col("k") * 3600))
    return points.join(hourly, ["gauge", "hour"], "left").select("gauge", "k", F.coalesce("mm", F.lit(0.0)).alias("mm"))


@query("""WITH v AS (SELECT c_nationkey AS n, round(avg(c_acctbal), 4) AS score FROM customer GROUP BY 1 HAVING count(*) >= 5 AND avg(c_acctbal) > 4500)
SELECT n_nationkey, coalesce(score::VARCHAR, 'not validated') AS validation FROM nation LEFT JOIN v ON n = n_nationkey""".replace("score::VARCHAR", "printf('%.4f', score)"))
def validation_status(spark, sf_dir):
    """Every terrain, with its validation where there is one."""
    v = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.avg("c_acctbal"), 4).alias("score"), F.count(F.lit(1)).alias("k"), F.avg("c_acctbal").alias("mean")).where("k >= 5 and mean > 4500")
    return read(spark, sf_dir, "nation").join(v, "n_nationkey", "left").select("n_nationkey", F.coalesce(F.when(F.col("score").isNotNull(), F.format_string("%.4f", "score")), F.lit("not validated")).alias("validation"))


@query(f"""WITH {CONDUITS} SELECT eid FROM conduits WHERE u % 20 BETWEEN 3 AND 15 AND u // 20 BETWEEN 3 AND 15 AND v % 20 BETWEEN 3 AND 15 AND v // 20 BETWEEN 3 AND 15
AND (u % 20 // 2, u // 20 // 2) <> (v % 20 // 2, v // 20 // 2)""")
def conduits_inside(spark, sf_dir):
    """Conduits with both ends in the box, and not both snapped to one node."""
    at = lambda n: (F.col(n) % 20, F.floor(F.col(n) / 20))
    (ux, uy), (vx, vy) = at("u"), at("v")
    inside = ux.between(3, 15) & uy.between(3, 15) & vx.between(3, 15) & vy.between(3, 15)
    apart = (F.floor(ux / 2) != F.floor(vx / 2)) | (F.floor(uy / 2) != F.floor(vy / 2))
    return conduits(spark, sf_dir).where(inside & apart).select("eid")


@query(f"""WITH RECURSIVE {WALK}, rs AS (SELECT DISTINCT receiver AS id FROM hit JOIN catchments c USING (id) JOIN catchments r ON r.id = receiver WHERE c.overflow_m3 > 0 AND r.water_share < 0.3)
SELECT round(sum(area_ha) FILTER (WHERE rs.id IS NOT NULL) / sum(area_ha), 6) AS land_share, count(*) FILTER (WHERE rs.id IS NOT NULL AND cn >= 90) AS spots_inside, count(*) FILTER (WHERE cn >= 90) AS spots FROM catchments c LEFT JOIN rs USING (id)""")
def receiver_shares(spark, sf_dir):
    """How much land lies in catchments where overflow stands, and how many spots lie in them."""
    c = catchments(spark, sf_dir)
    ponds = runoff.arrivals(c).where("pond_cm > 0").select("id", F.lit(True).alias("in"))
    both = c.join(ponds.hint("merge"), "id", "left").withColumn("in", F.coalesce("in", F.lit(False)))
    return both.agg(F.round(F.sum(F.when(F.col("in"), F.col("area_ha"))) / F.sum("area_ha"), 6).alias("land_share"), F.count_if(F.col("in") & (F.col("cn") >= 90)).alias("spots_inside"), F.count_if(F.col("cn") >= 90).alias("spots"))


@query(f"""WITH RECURSIVE {STRAHLER}, {SURVEY}, sea AS (SELECT avg((class = 80 AND z <= 300)::INT) AS share FROM dem), o AS (SELECT s, count(*) AS k FROM r GROUP BY s)
SELECT round(sum(length_m) / 1000, 3) AS stream_km, round(avg(imperv), 6) AS mean_imperv, round(avg((water_share >= 0.5)::INT), 6) AS water_share, (SELECT round(share, 6) FROM sea) AS sea_share, (SELECT string_agg(s || ':' || k, ' ' ORDER BY s) FROM o) AS links_by_order FROM catchments""")
def stream_totals(spark, sf_dir):
    """Length, mean imperviousness, shares of water and of sea, and links by order."""
    c = catchments(spark, sf_dir)
    totals = c.agg(F.round(F.sum("length_m") / 1000, 3).alias("stream_km"), F.round(F.avg("imperv"), 6).alias("mean_imperv"), F.round(F.avg((F.col("water_share") >= 0.5).cast("int")), 6).alias("water_share"))
    sea = survey(spark, sf_dir)[0].agg(F.round(F.avg(streams.sea(F.col("class"), F.col("z"), level=300.0).cast("int")), 6).alias("sea_share"))
    orders = runoff.strahler(c.select("id", "downstream")).groupBy("strahler").count().agg(F.sort_array(F.collect_list(F.struct("strahler", "count"))).alias("o"))
    text = F.concat_ws(" ", F.transform("o", lambda x: F.concat_ws(":", x.strahler, x["count"]))).alias("links_by_order")
    return totals.crossJoin(F.broadcast(sea)).crossJoin(F.broadcast(orders.select(text)))  # one row each


@query("""WITH s AS (SELECT d.source, l.quality AS label, d.n_chars AS v FROM labels l JOIN documents d USING (doc_id)),
m AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY v) + (count(*) OVER (PARTITION BY source, v) - 1) / 2.0 AS mid FROM s)
SELECT source, count(*) AS n, round((sum(CASE WHEN label = 1 THEN mid ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 8) AS auc FROM m GROUP BY source HAVING sum(label) >= 5 AND count(*) - sum(label) >= 5""")
def auc_by_file(spark, sf_dir):
    """The AUC within each file that has five of both kinds."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("v"))
    s = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(d, "doc_id")
    return stats.auc(s, ["source"]).where("n1 >= 5 and n0 >= 5").select("source", (F.col("n1") + F.col("n0")).alias("n"), F.round("auc", 8).alias("auc"))


PIPES = f"""{CONDUITS}, p AS (SELECT row_number() OVER (ORDER BY eid, u, v, depth, width, length_m, bad, name) AS link, u, v, depth AS a, width / 100 AS b, length_m, bad FROM conduits WHERE u <> v), ends AS (SELECT u AS node, a AS invert, a + 1.5 AS top FROM p UNION ALL SELECT v, b, b + 1.5 FROM p), floors AS (SELECT node, min(invert) AS elev, max(top) AS street FROM ends GROUP BY node)"""


@query(f"""WITH {PIPES} SELECT printf('N%d %.3f %.3f 0 0 0', node, elev, greatest(street - elev, 0.2)) AS line FROM floors
UNION ALL SELECT printf('N%d N%d %.1f %s %.3f %.3f 0 0', p.u, p.v, length_m, CASE WHEN bad THEN '0.03' ELSE '0.015' END, a - f.elev, b - t.elev) FROM p JOIN floors f ON f.node = p.u JOIN floors t ON t.node = p.v""")
def model_sections(spark, sf_dir):
    """Junctions and conduits of the register as the drainage model reads them (without the conduits' numbers)."""
    c = conduits(spark, sf_dir).where("u <> v")
    links = c.select(F.col("eid").alias("link"), "u", "v", F.col("depth").alias("invert_u"), (F.col("width") / 100).alias("invert_v"), (F.col("depth") + 1.5).alias("top_u"), (F.col("width") / 100 + 1.5).alias("top_v"), "length_m", F.lit(1.5).alias("depth"), "width", F.lit(True).alias("closed"), "bad")
    nodes = model.nodes_of(links)
    pipes = model.conduit_lines(links, nodes).where(F.col("section") == model.SECTIONS.index("CONDUITS")).select(F.regexp_replace("line", "^C\\d+ ", "").alias("line"))
    return model.node_lines(nodes).select("line").unionByName(pipes)


@query("SELECT p_partkey AS id, round(2.5 + 8.5 * least(sqrt(greatest((p_retailprice - 910) / 15, 0)) / sqrt(5.3), 1), 6) AS radius FROM part")
def marker_radii(spark, sf_dir):
    """The size of a node's marker from the volume that floods it."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(presentation.radius_of((F.col("p_retailprice") - 910) / 15), 6).alias("radius"))


@query(f"WITH {CATCHMENTS} SELECT round(avg(imperv * 100), 6) AS areal_mm, count(*) AS catchments FROM catchments WHERE area_ha > 0")
def areal_rain(spark, sf_dir):
    """Mean rain over the catchments that have cells."""
    return catchments(spark, sf_dir).where("area_ha > 0").agg(F.round(F.avg(F.col("imperv") * 100), 6).alias("areal_mm"), F.count(F.lit(1)).alias("catchments"))


@query("""SELECT CASE WHEN p_size % 3 = 0 THEN 'Tertiary' WHEN p_size % 3 = 1 THEN 'Secondary' ELSE 'Primary' END AS layer, count(*) AS drains, round(sum(p_retailprice) / 1000, 3) AS km FROM part GROUP BY 1""")
def drain_layers(spark, sf_dir):
    """Each class of drains as the map's layer of it: its own features only."""
    kind = F.when(F.col("p_size") % 3 == 0, "Tertiary").when(F.col("p_size") % 3 == 1, "Secondary").otherwise("Primary")
    drains = read(spark, sf_dir, "part").select(kind.alias("type"), "p_retailprice")
    layers = [drains.where(F.col("type") == k).agg(F.lit(k).alias("layer"), F.count(F.lit(1)).alias("drains"), F.round(F.sum("p_retailprice") / 1000, 3).alias("km")) for k in ("Tertiary", "Secondary", "Primary")]
    return layers[0].unionByName(layers[1]).unionByName(layers[2])


@query(f"""WITH {SURVEY}, h AS (SELECT cell, CASE WHEN blocked < 0.9 THEN z / 100 END AS h FROM dem), s AS (SELECT cell, h, least(greatest(coalesce(h, 14), 0), 14) AS c FROM h)
SELECT cell, floor(CASE WHEN c < 2 THEN 8 + 25 * c / 2 WHEN c < 5 THEN 33 + 33 * (c - 2) / 3 WHEN c < 9 THEN 66 + 92 * (c - 5) / 4 WHEN c < 14 THEN 158 + 64 * (c - 9) / 5 ELSE 222 END)::INT AS r,
 CASE WHEN h IS NULL THEN 0 ELSE floor(CASE WHEN c < 2 THEN 230 - 25 * c / 2 WHEN c < 5 THEN 205 - 45 * (c - 2) / 3 WHEN c < 9 THEN 160 - 70 * (c - 5) / 4 WHEN c < 14 THEN 90 - 90 * (c - 9) / 5 ELSE 0 END)::INT END AS a FROM s""")
def height_overlay(spark, sf_dir):
    """Red and alpha of the overlay of heights, clear where a height is unknown."""
    c, _ = survey(spark, sf_dir)
    colour = presentation.hand_colour(F.when(F.col("blocked") < 0.9, F.col("z") / 100))
    return c.select("cell", colour.alias("c")).select("cell", "c.r", "c.a")


@query(f"""WITH {SURVEY}, grad AS (SELECT cell, z, lag(z) OVER r AS u, lead(z) OVER r AS d, lag(z) OVER c AS l, lead(z) OVER c AS e FROM dem WINDOW r AS (PARTITION BY col ORDER BY row), c AS (PARTITION BY row ORDER BY col)),
s AS (SELECT cell, sqrt(pow(CASE WHEN u IS NULL THEN d - z WHEN d IS NULL THEN z - u ELSE (d - u) / 2 END / 1000, 2) + pow(CASE WHEN l IS NULL THEN e - z WHEN e IS NULL THEN z - l ELSE (e - l) / 2 END / 1000, 2)) AS g FROM grad)
SELECT cell, round(ln(greatest(1 + cell % 50, 1) * 10 / greatest(g, 0.001)), 5) AS wetness FROM s""")
def topographic_wetness(spark, sf_dir):
    """Wetness from the slope and the cells drained (here a stand-in from the cell's number)."""
    c, _ = survey(spark, sf_dir)
    s = grid.slope(c, 1000.0)
    return s.select("cell", F.round(hydro.topographic_wetness(1 + F.col("cell") % 50, 10.0, F.col("slope_deg")), 5).alias("wetness"))
