"""Queries on networks, spatial joins and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ponding.functions import geo, hydro
from ponding.operators import nearest, network, spatial, stats
from ponding.plans.domain import CATCHMENTS, CONDUITS, catchments, conduits, read, stations, stations_sql
from ponding.plans.registry import query

PER = "111320.0 * cos(radians(12.95))"
CUST, SUPP = stations_sql("cust", "customer", "c_custkey"), stations_sql("supp", "supplier", "s_suppkey")
XY = f"p AS (SELECT id, lon * {PER} AS x, lat * 111320.0 AS y FROM cust), q AS (SELECT id, lon * {PER} AS x, lat * 111320.0 AS y FROM supp)"


def points(spark, sf_dir):
    return spatial.metres(stations(spark, sf_dir), 12.95), spatial.metres(stations(spark, sf_dir, "supplier", "s_suppkey"), 12.95)


@query(f"WITH {CUST}, {SUPP}, d AS (SELECT c.id, s.id AS other, sqrt(pow((s.lon - c.lon) * 111320.0 * cos(radians((c.lat + s.lat) / 2)), 2) + pow((s.lat - c.lat) * 110570.0, 2)) AS d FROM cust c, supp s) SELECT id, arg_min(other, (d, other)) AS other, round(min(d), 2) AS d FROM d GROUP BY id")
def nearest_station(spark, sf_dir):
    """The nearest station of each customer, however many there are and however far."""
    return nearest.nearest(stations(spark, sf_dir), stations(spark, sf_dir, "supplier", "s_suppkey")).select("id", "other", F.round("d", 2).alias("d"))


@query(f"WITH {CUST}, {SUPP}, {XY}, d AS (SELECT p.id, q.id AS other, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS d FROM p, q WHERE abs(p.x - q.x) <= 250 AND abs(p.y - q.y) <= 250), b AS (SELECT id, arg_min(other, (d, other)) AS other, min(d) AS d FROM d WHERE d <= 250 GROUP BY id) SELECT p.id, b.other, round(b.d, 2) AS d FROM p LEFT JOIN b USING (id)")
def nearest_outlet_within(spark, sf_dir):
    p, q = points(spark, sf_dir)
    return spatial.nearest_within(p, q, 250.0).select("id", "other", F.round("d", 2).alias("d"))


@query(f"WITH {CUST}, {SUPP}, {XY} SELECT p.id FROM p WHERE EXISTS (SELECT 1 FROM q WHERE abs(p.x - q.x) < 150 AND abs(p.y - q.y) < 150 AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) < 150)")
def within_radius(spark, sf_dir):
    p, q = points(spark, sf_dir)
    return spatial.within(p, q, 150.0).select("id")


@query(f"WITH {CUST}, {SUPP}, {XY} SELECT a.id, count(*) AS near FROM p a JOIN p b ON abs(a.x - b.x) <= 300 AND abs(a.y - b.y) <= 300 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 300 GROUP BY a.id")
def radius_count(spark, sf_dir):
    return spatial.crowd(points(spark, sf_dir)[0], 300.0)


@query(f"WITH {CUST}, r AS (SELECT (range // 60)::INT AS row, (range % 60)::INT AS col, CASE WHEN range % 7 <> 3 THEN (range * 31) % 1000 END AS value FROM range(3600)), c AS (SELECT id, floor((13.01e0 - lat) / (13.01e0 - 12.91e0) * 60)::INT AS row, floor((lon - 77.59e0) / (77.69e0 - 77.59e0) * 60)::INT AS col FROM cust) SELECT id, row, col, value FROM c JOIN r USING (row, col) WHERE value IS NOT NULL")
def raster_sample(spark, sf_dir):
    r = spark.range(3600).select((F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"), F.when(F.col("id") % 7 != 3, (F.col("id") * 31) % 1000).alias("value"))
    return spatial.sample_raster(stations(spark, sf_dir), r, 77.59, 12.91, 77.69, 13.01, 60).select("id", "row", "col", "value")


@query(f"WITH {CUST} SELECT id, least(greatest(trunc((13.01 - lat) / 0.1 * 240)::INT, 0), 239) AS row, least(greatest(trunc((lon - 77.6) / 0.1 * 240)::INT, 0), 239) AS col, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(12.95 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(12.95)) * pow(sin(radians(77.64 - lon) / 2), 2))), 2) AS metres FROM cust")
def cell_and_haversine(spark, sf_dir):
    s = stations(spark, sf_dir)
    row = F.least(F.greatest(((13.01 - F.col("lat")) / 0.1 * 240).cast("int"), F.lit(0)), F.lit(239))
    col = F.least(F.greatest(((F.col("lon") - 77.6) / 0.1 * 240).cast("int"), F.lit(0)), F.lit(239))
    return s.select("id", row.alias("row"), col.alias("col"), F.round(geo.haversine(F.col("lat"), F.col("lon"), F.lit(12.95), F.lit(77.64)), 2).alias("metres"))


@query(f"WITH {CONDUITS}, e AS (SELECT u AS node, depth, width, bad FROM conduits WHERE u <> v UNION ALL SELECT v, depth, width, bad FROM conduits WHERE u <> v) SELECT node, count(*) AS degree, min(depth) AS invert, max(width) AS top, bool_or(bad) AS bad FROM e GROUP BY node")
def node_degrees(spark, sf_dir):
    """Degree, lowest invert, highest top and whether any conduit is bad, per node."""
    c = conduits(spark, sf_dir).where("u <> v")
    ends = c.select(F.explode(F.array("u", "v")).alias("node"), "depth", "width", "bad")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.min("depth").alias("invert"), F.max("width").alias("top"), F.bool_or("bad").alias("bad"))


@query(f"""WITH {CATCHMENTS}, e AS (SELECT id AS node, imperv AS own, downstream AS other FROM catchments WHERE downstream IS NOT NULL), ends AS (SELECT e.node, e.own, c.imperv AS far FROM e JOIN catchments c ON c.id = e.other UNION ALL SELECT e.other, c.imperv, e.own FROM e JOIN catchments c ON c.id = e.other)
SELECT node FROM ends GROUP BY node HAVING count(*) = 1 AND bool_or(own <= far)""")
def outfalls(spark, sf_dir):
    """Nodes of one conduit that lie no higher than its other end."""
    c = catchments(spark, sf_dir)
    far = c.select(F.col("id").alias("downstream"), F.col("imperv").alias("far"))
    e = c.where("downstream is not null").select("id", F.col("imperv").alias("own"), "downstream").join(far, "downstream")
    return low_ends(e.select(F.col("id").alias("u"), F.col("downstream").alias("v"), "own", "far"), 1)


def low_ends(c, most):
    """Nodes of at most so many conduits (u, v, own, far: the inverts at both ends) where an own invert is no higher than the far one."""
    ends = c.select(F.col("u").alias("node"), "own", "far").unionByName(c.select(F.col("v").alias("node"), F.col("far").alias("own"), F.col("own").alias("far")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.bool_or(F.col("own") <= F.col("far")).alias("low")).where((F.col("degree") <= most) & F.col("low")).select("node")


@query(f"WITH {CONDUITS} SELECT * FROM (SELECT u, v, length_m, eid FROM conduits QUALIFY row_number() OVER (PARTITION BY u, v ORDER BY length_m, eid) = 1)")
def parallel_edges(spark, sf_dir):
    return network.shortest_parallel(conduits(spark, sf_dir))


@query(f"WITH {CONDUITS} SELECT eid, least(u, v) AS a, greatest(u, v) AS b, name FROM conduits WHERE depth >= 0.05 AND u <> v QUALIFY row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY eid, name) = 1")
def flooded_pairs(spark, sf_dir):
    """The filter comes before the choice of the first edge of each pair."""
    c = conduits(spark, sf_dir).where("depth >= 0.05 and u <> v")
    return network.first_of_pair(c).select("eid", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "name")


@query(f"WITH {CONDUITS} SELECT name, count(DISTINCT eid) AS pieces, count(*) // 2 AS segments, round(sum(length_m) / 2000, 1) AS km FROM conduits GROUP BY ROLLUP (name)")
def network_summary(spark, sf_dir):
    c = conduits(spark, sf_dir).withColumnRenamed("eid", "ord")
    return network.summary(c).select("name", "pieces", "segments", F.round("km", 1).alias("km"))


@query(f"""WITH RECURSIVE {CONDUITS}, e AS (SELECT u, v, min(length_m) AS w FROM conduits WHERE depth < 0.03 GROUP BY u, v), adj AS (SELECT u, v, w FROM e),
r AS (SELECT 0::BIGINT AS node, 0::DOUBLE AS cost, 0 AS n UNION ALL SELECT v, min(cost + w), any_value(n) + 1 FROM r JOIN adj ON u = node WHERE n < 40 GROUP BY v)
SELECT node, round(min(cost), 1) AS metres FROM r GROUP BY node""")
def shortest_distances(spark, sf_dir):
    """Cheapest way from node 0 to every node over edges that are not under water."""
    c = conduits(spark, sf_dir).where("depth < 0.03")
    e = network.shortest_parallel(c).withColumnRenamed("length_m", "w")
    return network.distances(e, F.lit(0)).select("node", F.round("cost", 1).alias("metres"))


def street_lines(spark, sf_dir):
    """Of parallel conduits the shortest, with its depth and its line over the lattice of nodes."""
    c = conduits(spark, sf_dir).where("u <> v").withColumn("depth_cm", F.col("depth") * 400)
    e = c.groupBy("u", "v").agg(F.min(F.struct("length_m", "eid", "depth_cm")).alias("b")).select("u", "v", "b.length_m", "b.depth_cm")
    at = lambda k: F.struct((77.5 + (F.col(k) % 20) / 100).alias("lon"), (12.9 + F.floor(F.col(k) / 20) / 100).alias("lat"))
    middle = F.struct((77.5 + (F.col("u") % 20 + F.col("v") % 20) / 200).alias("lon"), (12.9 + (F.floor(F.col("u") / 20) + F.floor(F.col("v") / 20)) / 200).alias("lat"))
    return e.withColumn("coords", F.array(at("u"), middle, at("v")))


@query()
def route_lines(spark, sf_dir):
    """The line of the normal way between two nodes and of each stretch of it under water (iterative; a test compares it with a plain loop)."""
    e = street_lines(spark, sf_dir)
    best = network.distances(e.select("u", "v", F.col("length_m").alias("w")), F.lit(0))
    out = network.path_lines(network.path_to(best, 233), e, 4.0)
    line = F.concat_ws(" ", F.transform("coords", lambda c: F.format_string("%.3f,%.3f", c.lon, c.lat)))
    return out.select("kind", "first", "last", F.round("length_m", 1).alias("length_m"), F.round("max_depth_cm", 4).alias("max_depth_cm"), line.alias("line"))


@query()
def flood_safe_route(spark, sf_dir):
    """The normal and the passable way between two nodes (tests compare it with a plain loop)."""
    c = conduits(spark, sf_dir).where("u <> v").withColumn("depth_cm", F.col("depth") * 400)
    # eids repeat in the register, so the depth is chosen with the edge.
    e = c.groupBy("u", "v").agg(F.min(F.struct("length_m", "eid", "depth_cm")).alias("b")).select("u", "v", "b.length_m", "b.depth_cm")
    out = network.compare_routes(e, 0, 233, hydro.PASSABLE_CM["two-wheeler"])
    return out.withColumns({"minutes": F.round(hydro.route_minutes(F.col("normal_m")), 2), **{m: F.round(m, 1) for m in ("normal_m", "safe_m", "extra_m")}})


@query(f"""WITH RECURSIVE {CONDUITS}, e AS (SELECT DISTINCT u, v FROM conduits WHERE u <> v), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.seen) SELECT node, min(seen) AS comp FROM r GROUP BY node""")
def components(spark, sf_dir):
    return network.components(conduits(spark, sf_dir).where("u <> v"))


@query()
def built_network(spark, sf_dir):
    """From polylines to a network: runs inside the box, pieces of at least 4 km, directed edges between snapped ends; the largest component's size and length."""
    runs = network.clip_runs(lines(spark, sf_dir), 77.61, 12.91, 77.69, 12.99)
    pieces = runs.select(F.concat(F.lit("drain "), (F.col("id") % 40).cast("string")).alias("name"), (F.col("id") * 1000 + F.col("first")).alias("k"), F.posexplode(network.chunk_points(F.col("coords"), 4000.0)).alias("p", "coords"))
    edges = network.build_network(pieces.select("name", (F.col("k") * 1000 + F.col("p")).alias("ord"), "coords"), 12.95, snap_m=250.0)
    keyed = edges.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"), "length_m")
    inside = network.largest_component(keyed)
    return inside.agg((F.count(F.lit(1)) / 2).cast("long").alias("segments"), F.round(F.sum("length_m") / 2000, 2).alias("km"), F.count_distinct("u").alias("nodes"))


LINES = """v AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, 77.60::DOUBLE + ((o_orderkey * 7919) % 1000) / 10000.0::DOUBLE AS lon, 12.90::DOUBLE + ((o_orderkey * 104729) % 1000) / 10000.0::DOUBLE AS lat FROM orders)"""


def lines(spark, sf_dir):
    """A polyline per customer: one vertex per order."""
    k = F.col("o_orderkey")
    c = F.struct((77.60 + ((k * 7919) % 1000) / 10000.0).alias("lon"), (12.90 + ((k * 104729) % 1000) / 10000.0).alias("lat"))
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), c.alias("c")))), lambda x: x.c).alias("coords"))


@query(f"""WITH {LINES}, i AS (SELECT *, lon BETWEEN 77.62 AND 77.67 AND lat BETWEEN 12.91 AND 12.98 AS inside FROM v), r AS (SELECT *, sum((NOT inside)::INT) OVER (PARTITION BY id ORDER BY pos) AS run FROM i)
SELECT id, min(pos)::INT AS first, count(*)::INT AS vertices FROM r WHERE inside GROUP BY id, run HAVING count(*) >= 2""")
def clip_to_box(spark, sf_dir):
    return network.clip_runs(lines(spark, sf_dir), 77.62, 12.91, 77.67, 12.98).select("id", "first", F.size("coords").alias("vertices"))


@query()
def corridor_pieces(spark, sf_dir):
    """Polylines cut into pieces of at least 4 km (a fold; tests compare it with a plain loop)."""
    pieces = lines(spark, sf_dir).select("id", F.posexplode(network.chunk_points(F.col("coords"), 4000.0)).alias("k", "piece"))
    return pieces.select("id", "k", F.size("piece").alias("vertices"), F.round(geo.polyline_length(F.col("piece")), 1).alias("metres"))


@query(f"""WITH {LINES}, s AS (SELECT id, pos, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM v WINDOW w AS (PARTITION BY id ORDER BY pos)), m AS (SELECT id, max(pos) - 1 AS last FROM v GROUP BY id),
n AS (SELECT s.*, last, greatest(1, ceil(sqrt(pow((lon2 - lon) * 111320.0 * cos(radians((lat + lat2) / 2)), 2) + pow((lat2 - lat) * 111320.0, 2)) / 60))::INT AS parts FROM s JOIN m USING (id) WHERE lon2 IS NOT NULL),
p AS (SELECT id, lon + (lon2 - lon) * (i / parts::DOUBLE) AS x, lat + (lat2 - lat) * (i / parts::DOUBLE) AS y FROM n, LATERAL (SELECT unnest(range(0, CASE WHEN pos = last THEN parts + 1 ELSE parts END)) AS i) t),
c AS (SELECT DISTINCT id, least(greatest(trunc((13.00e0 - y) / (13.00e0 - 12.90e0) * 60)::INT, 0), 59) AS row, least(greatest(trunc((x - 77.60e0) / (77.70e0 - 77.60e0) * 60)::INT, 0), 59) AS col FROM p)
SELECT id AS eid, lead, max((row * 7 + col * 13 + lead) % 151) AS depth_cm FROM c, (SELECT (range * 60)::BIGINT AS lead FROM range(4)) GROUP BY ALL""")
def edge_depths(spark, sf_dir):
    """Densified edges meet the depth cube by cells; the deepest cell counts."""
    e = lines(spark, sf_dir).where(F.size("coords") >= 2).withColumnRenamed("id", "eid")
    bridge = network.edge_points(e, 77.60, 12.90, 77.70, 13.00, step_m=60.0, n=60)
    cube = spark.range(3600).select((F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col")).crossJoin(F.broadcast(spark.range(4).select((F.col("id") * 60).alias("lead"))))
    return network.edge_depths(bridge, cube.withColumn("depth_cm", (F.col("row") * 7 + F.col("col") * 13 + F.col("lead")) % 151))


SCORES = "s AS (SELECT l.doc_id, l.quality AS label, d.n_chars AS v, length(d.lang || d.source) + d.n_chars % 17 AS size FROM labels l JOIN documents d USING (doc_id))"


def scores(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return read(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("label"), F.col("n_chars").alias("v"), (F.length(F.concat("lang", "source")) + F.col("n_chars") % 17).alias("size"))


AUC = "SELECT {by} sum(label)::BIGINT AS n1, (count(*) - sum(label))::BIGINT AS n0, round((sum(CASE WHEN label = 1 THEN mid ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 8) AS auc FROM (SELECT *, rank() OVER (PARTITION BY 1 {part} ORDER BY v) + (count(*) OVER (PARTITION BY v {part}) - 1) / 2.0 AS mid FROM {src})"


#: The normal tail by the same published polynomial.
TAIL = "(exp(-{z} * {z} / 2) / sqrt(2 * pi()) * (1 / (1 + 0.2316419::DOUBLE * {z})) * (0.319381530::DOUBLE + (1 / (1 + 0.2316419::DOUBLE * {z})) * (-0.356563782::DOUBLE + (1 / (1 + 0.2316419::DOUBLE * {z})) * (1.781477937::DOUBLE + (1 / (1 + 0.2316419::DOUBLE * {z})) * (-1.821255978::DOUBLE + (1 / (1 + 0.2316419::DOUBLE * {z})) * 1.330274429::DOUBLE)))))"


@query(f"WITH {SCORES}, a AS (" + AUC.format(by="", part="", src="s") + f"""), tied AS (SELECT sum(k ** 3 - k) AS t FROM (SELECT count(*)::DOUBLE AS k FROM s GROUP BY v)),
d AS (SELECT *, auc * n1 * n0 - n1 * n0 / 2.0::DOUBLE AS off, sqrt(n1::DOUBLE * n0 / 12 * (n1 + n0 + 1 - t / ((n1 + n0) * (n1 + n0 - 1)))) AS sd FROM a, tied), z AS (SELECT *, greatest((abs(off) - 0.5) / sd, 0) AS z, (-off - 0.5) / sd AS l FROM d)
SELECT n1, n0, auc, round(least(2 * {TAIL.format(z='z')}, 1), 6) AS p, round(CASE WHEN l >= 0 THEN {TAIL.format(z='l')} ELSE 1 - {TAIL.format(z='(-l)')} END, 6) AS p_less FROM z""")
def auc_midrank(spark, sf_dir):
    return stats.auc(scores(spark, sf_dir)).select("n1", "n0", F.round("auc", 8).alias("auc"), F.round("p", 6).alias("p"), F.round("p_less", 6).alias("p_less"))


@query(f"""WITH {SCORES}, e AS (SELECT i + 1 AS stratum, quantile_cont(size, i / 5.0) AS lo, quantile_cont(size, (i + 1) / 5.0) AS hi FROM s, (SELECT unnest([0, 1, 2, 3, 4]) AS i) GROUP BY i),
t AS (SELECT s.*, stratum FROM s JOIN e ON s.size BETWEEN lo AND hi), a AS ({AUC.format(by="stratum,", part=", stratum", src="t")} GROUP BY stratum) SELECT round(avg(auc), 6) AS auc, count(*) AS strata FROM a WHERE n1 > 0 AND n0 > 0""".replace("quantile_cont(size, i / 5.0)", "(SELECT quantile_cont(size, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) FROM s)[i + 1]").replace("quantile_cont(size, (i + 1) / 5.0)", "(SELECT quantile_cont(size, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) FROM s)[i + 2]").replace("FROM s, (SELECT unnest([0, 1, 2, 3, 4]) AS i) GROUP BY i", "FROM (SELECT unnest([0, 1, 2, 3, 4]) AS i)"))
def auc_by_size(spark, sf_dir):
    return stats.stratified_auc(scores(spark, sf_dir), "size").select(F.round("auc", 6).alias("auc"), "strata")


@query("""WITH c AS (SELECT quantile_cont(c_acctbal, [0.1, 0.2, 0.3, 0.5, 0.7]) AS q FROM customer), x AS (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7])::DOUBLE AS share, unnest(q) AS cut FROM c)
SELECT share, round(avg((s_acctbal <= cut)::INT), 6) AS captured FROM x, supplier GROUP BY share""")
def capture_curve(spark, sf_dir):
    spots = read(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("v"))
    return stats.capture_curve(spots, read(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v"))).select("share", F.round("captured", 6).alias("captured"))


@query("SELECT c_custkey FROM customer ORDER BY md5('7|' || c_custkey::VARCHAR), c_custkey LIMIT 200")
def background_sample(spark, sf_dir):
    return stats.hash_sample(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 200, "7")


@query("""SELECT p_type AS zone, quantile_cont(p_retailprice, 0.1) AS p10, quantile_cont(p_retailprice, 0.5) AS p50, quantile_cont(p_retailprice, 0.9) AS p90, avg((p_size <= 2)::INT) AS low_share FROM part GROUP BY p_type""".replace("quantile_cont(p_retailprice, 0.1)", "round(quantile_cont(p_retailprice, 0.1), 4)").replace("quantile_cont(p_retailprice, 0.5)", "round(quantile_cont(p_retailprice, 0.5), 4)").replace("quantile_cont(p_retailprice, 0.9)", "round(quantile_cont(p_retailprice, 0.9), 4)").replace("avg((p_size <= 2)::INT)", "round(avg((p_size <= 2)::INT), 6)"))
def zone_percentiles(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumnRenamed("p_type", "zone")
    q = stats.quantiles(p, "p_retailprice", [0.1, 0.5, 0.9], ["zone"]).groupBy("zone").agg(*[F.round(F.max(F.when(F.col("share") == x, F.col("cut"))), 4).alias(n) for n, x in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])
    return p.groupBy("zone").agg(F.round(F.avg((F.col("p_size") <= 2).cast("int")), 6).alias("low_share")).join(q, "zone").select("zone", "p10", "p50", "p90", "low_share")


@query()
def bootstrap_interval(spark, sf_dir):
    """95 % interval of the mean account balance of suppliers over 1,000 hash-drawn resamples."""
    return stats.bootstrap_mean(read(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal")
