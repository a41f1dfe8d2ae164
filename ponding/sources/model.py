"""The drainage model's input file, section by section, from tables of nodes, conduits, sub-catchments and rain.

Lines are (section, ord, line); :func:`write_model` sorts them over all tasks and writes
files whose names follow the order, so no task holds the model and joining the files gives it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ponding.functions.hydro import channel_width

#: Sections in the order of the file, with the lines that never change (fixed values of the format and of the model).
SECTIONS = ("TITLE", "OPTIONS", "RAINGAGES", "SUBCATCHMENTS", "SUBAREAS", "INFILTRATION", "JUNCTIONS", "OUTFALLS", "CONDUITS", "XSECTIONS", "TIMESERIES", "REPORT", "COORDINATES")
OPTIONS = ("FLOW_UNITS CMS", "INFILTRATION CURVE_NUMBER", "FLOW_ROUTING DYNWAVE", "LINK_OFFSETS DEPTH", "REPORT_STEP 00:05:00", "WET_STEP 00:01:00", "DRY_STEP 00:05:00", "ROUTING_STEP 0:00:05", "ALLOW_PONDING NO")
GAGE, REPORT = "RG1 INTENSITY 0:05 1.0 TIMESERIES STORM", ("INPUT NO", "CONTROLS NO", "SUBCATCHMENTS NONE", "NODES NONE", "LINKS NONE")
#: Roughness of sound and of bad conduits, the least depth of a junction in m and the least slope in percent (fixed values).
ROUGHNESS, ROUGH_BAD, LEAST_DEPTH, LEAST_SLOPE = 0.015, 0.030, 0.2, 0.3


def nodes_of(links: DataFrame, outfalls: DataFrame | None = None) -> DataFrame:
    """node, elev (the lowest invert of its conduits), street (the highest top), outfall. links: u, v, invert_u, invert_v, top_u, top_v."""
    end = lambda k: links.select(F.col(k).alias("node"), F.col(f"invert_{k}").alias("invert"), F.col(f"top_{k}").alias("top"))
    nodes = end("u").unionByName(end("v")).groupBy("node").agg(F.min("invert").alias("elev"), F.max("top").alias("street"))
    if outfalls is None:
        return nodes.withColumn("outfall", F.lit(False))
    return nodes.join(outfalls.select("node", F.lit(True).alias("outfall")), "node", "left").withColumn("outfall", F.coalesce("outfall", F.lit(False)))


def offsets(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds offset_u and offset_v, how far a conduit's ends lie above the floors of their nodes."""
    for k in ("u", "v"):
        links = links.join(nodes.select(F.col("node").alias(k), F.col("elev").alias(f"elev_{k}")), k).withColumn(f"offset_{k}", F.col(f"invert_{k}") - F.col(f"elev_{k}"))
    return links


def _name(letter: str, c: Column) -> Column:
    return F.concat(F.lit(letter), c.cast("string"))


def conduit_lines(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sections CONDUITS and XSECTIONS. links: link, u, v, invert_u, invert_v, length_m, depth, width, closed, bad."""
    o = offsets(links, nodes)
    rough = F.when(F.col("bad"), F.lit(str(ROUGH_BAD))).otherwise(F.lit(str(ROUGHNESS)))
    pipe = F.format_string("%s %s %s %.1f %s %.3f %.3f 0 0", _name("C", F.col("link")), _name("N", F.col("u")), _name("N", F.col("v")), "length_m", rough, "offset_u", "offset_v")
    shape = F.format_string("%s %s %.3f %.3f 0 0 1", _name("C", F.col("link")), F.when(F.col("closed"), "RECT_CLOSED").otherwise("RECT_OPEN"), "depth", "width")
    return _lines("CONDUITS", o, "link", pipe).unionByName(_lines("XSECTIONS", o, "link", shape))


def node_lines(nodes: DataFrame) -> DataFrame:
    """Sections JUNCTIONS and OUTFALLS."""
    deep = F.greatest(F.col("street") - F.col("elev"), F.lit(LEAST_DEPTH))
    junction = F.format_string("%s %.3f %.3f 0 0 0", _name("N", F.col("node")), "elev", deep)
    outfall = F.format_string("%s %.3f FREE NO", _name("N", F.col("node")), "elev")
    return _lines("JUNCTIONS", nodes.where("not outfall"), "node", junction).unionByName(_lines("OUTFALLS", nodes.where("outfall"), "node", outfall))


def catchment_lines(subs: DataFrame) -> DataFrame:
    """Sections SUBCATCHMENTS, SUBAREAS and INFILTRATION. subs: id, node (its outlet), area_ha, imperv (share), length_m, slope_pct, cn."""
    width, slope = channel_width(F.col("area_ha"), F.col("length_m")), F.greatest(F.col("slope_pct"), F.lit(LEAST_SLOPE))
    s = _name("S", F.col("id"))
    area = F.format_string("%s RG1 %s %.4f %.1f %.1f %.2f 0", s, _name("N", F.col("node")), "area_ha", F.col("imperv") * 100, width, slope)
    parts = (("SUBCATCHMENTS", area), ("SUBAREAS", F.format_string("%s 0.013 0.15 1.27 5.08 25 OUTLET", s)), ("INFILTRATION", F.format_string("%s %.1f 0.5 7", s, "cn")))
    out = _lines(parts[0][0], subs, "id", parts[0][1])
    for section, line in parts[1:]:
        out = out.unionByName(_lines(section, subs, "id", line))
    return out


def rain_lines(series: DataFrame) -> DataFrame:
    """Section TIMESERIES. series: minute, mm_per_h."""
    m = F.col("minute").cast("int")
    return _lines("TIMESERIES", series, "minute", F.format_string("STORM %d:%02d %.3f", (m / 60).cast("int"), m % 60, "mm_per_h"))


def _lines(section: str, df: DataFrame, order: str, line: Column) -> DataFrame:
    return df.select(F.lit(SECTIONS.index(section)).alias("section"), F.col(order).cast("long").alias("ord"), line.alias("line"))


def model_lines(spark: SparkSession, title: str, minutes: int, links: DataFrame, nodes: DataFrame, subs: DataFrame, series: DataFrame) -> DataFrame:
    """section, ord, line of the whole file. nodes: of :func:`nodes_of`, with x and y; minutes: how long the model runs."""
    day, rest = divmod(minutes, 1440)
    run = ["START_DATE 01/01/2026", "START_TIME 00:00:00", f"END_DATE 01/{1 + day:02d}/2026", f"END_TIME {rest // 60:02d}:{rest % 60:02d}:00"]
    fixed = {"TITLE": [title], "OPTIONS": [*OPTIONS, *run], "RAINGAGES": [GAGE], "REPORT": list(REPORT)}
    rows = [(k, -1, f"[{name}]") for k, name in enumerate(SECTIONS)] + [(k, 2**62, "") for k in range(len(SECTIONS) - 1)]
    rows += [(SECTIONS.index(name), i, line) for name, lines in fixed.items() for i, line in enumerate(lines)]
    out = spark.createDataFrame(rows, "section int, ord long, line string")
    place = _lines("COORDINATES", nodes, "node", F.format_string("%s %.2f %.2f", _name("N", F.col("node")), "x", "y"))
    for part in (catchment_lines(subs), node_lines(nodes), conduit_lines(links, nodes), rain_lines(series), place):
        out = out.unionByName(part)
    return out


def write_model(lines: DataFrame, path: str, files: int | None = None) -> None:
    """Text files in the order of the model: each holds a range of (section, ord), so joined by name they are the file."""
    keys = ["section", "ord", "line"]
    dealt = lines.repartitionByRange(files, *keys) if files else lines.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).select("line").write.mode("overwrite").text(path)
