"""Hydrology as column expressions: storm, storage, depth, losses, lag, capacity, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP_MIN, STEPS, LEADS = 5, 37, tuple(range(0, 181, 15))
FLOODED_CM, SPEED_KMH = 10.0, 22.0
#: Water depth in cm that a vehicle passes (fixed values).
PASSABLE_CM = {"two-wheeler": 15.0, "car": 30.0, "emergency": 45.0}
#: Colour stops: depth in cm, opacity (fixed values).
OPACITY = ((0.0, 0.0), (4.0, 0.0), (5.0, 0.45), (15.0, 0.70), (30.0, 0.78), (50.0, 0.85), (80.0, 0.92))
#: Curve number on soil group C and imperviousness by land-cover class (fixed values).
CURVE_NUMBER = {10: 70, 20: 73, 30: 74, 40: 85, 50: 79, 60: 91, 70: 74, 80: 100, 90: 85, 95: 70, 100: 74}
IMPERVIOUS = {10: 0.05, 20: 0.10, 30: 0.15, 40: 0.20, 50: 0.85, 60: 0.40, 70: 0.0, 80: 0.0, 90: 0.0, 95: 0.0, 100: 0.05}
#: Places of blocked drains and of low ground (x, y and width) in the demonstration city (fixed values).
BLOCKED_DRAINS = ((0.35, 0.62), (0.62, 0.55), (0.45, 0.20))
SINKS = ((0.28, 0.30, 0.035), (0.72, 0.42, 0.03), (0.50, 0.80, 0.04))


def square(x: Column) -> Column:
    return x * x


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def storm(t: Column, x: Column, y: Column) -> Column:
    """The demonstration storm in mm/h at minute t and place (x, y) of the unit square."""
    cx = 0.15 + 0.70 * t / 180.0
    cy = 0.55 + 0.05 * F.sin(t / 40.0)
    near = F.exp(-(square(x - cx) + square(y - cy)) / (2 * 0.22 * 0.22))
    return 6.0 + 145.0 * near * F.exp(-square((t - 70.0) / 70.0))


def drain_capacity(x: Column, y: Column) -> Column:
    """mm/h that drains carry away; less around three blocked ones."""
    out = F.lit(32.0)
    for cx, cy in BLOCKED_DRAINS:
        out = out - 24.0 * F.exp(-(square(x - cx) + square(y - cy)) / (2 * 0.04 * 0.04))
    return out


def synthetic_imperviousness(x: Column, y: Column) -> Column:
    return 0.78 - 0.30 * F.exp(-(square(x - 0.7) + square(y - 0.25)) / (2 * 0.08 * 0.08))


def synthetic_elevation(x: Column, y: Column) -> Column:
    """Ground around a winding valley (without random relief)."""
    valley = 0.55 + 0.12 * F.sin(F.lit(6.283185307179586) * 1.3 * x + 0.5)
    return 900.0 + 25.0 * F.pow(F.abs(y - valley), F.lit(1.2)) + 3.0 * (1.0 - x)


def sinks(x: Column, y: Column) -> Column:
    return sum((F.exp(-(square(x - a) + square(y - b)) / (2 * s * s)) for a, b, s in SINKS), F.lit(0.0))


def lowness(valley_hand: Column, local_hand: Column) -> Column:
    """How low ground lies, from height above nearest drainage; missing heights count as 30 and 10 m."""
    hv, hl = F.coalesce(F.nanvl(valley_hand, F.lit(None)), F.lit(30.0)), F.coalesce(F.nanvl(local_hand, F.lit(None)), F.lit(10.0))
    return clip(F.exp(-hv / 2.5) + 0.25 * F.exp(-hl / 0.8), 0, 1.3)


def clamp_imperviousness(x: Column) -> Column:
    return F.when(x <= 0.01, F.lit(0.0)).otherwise(clip(x, 0.05, 0.98))


def depth_cm(storage: Column, low: Column) -> Column:
    return clip(storage * 0.42 * (0.12 + 2.0 * F.pow(low, F.lit(1.3))), 0, 150)


def scs_runoff(p_mm: Column, cn: Column) -> Column:
    """Runoff in mm of rain p on curve number cn, with an initial loss of a fifth of the retention."""
    s = 25400.0 / cn - 254.0
    excess = p_mm - 0.2 * s
    return F.when(excess > 0, square(excess) / (excess + s)).otherwise(F.lit(0.0))


def composite_runoff(p_mm: Column, impervious: Column, cn: Column) -> Column:
    """Pervious and impervious parts run off by themselves and are added by share."""
    return impervious * scs_runoff(p_mm, F.lit(98.0)) + (1.0 - impervious) * scs_runoff(p_mm, cn)


def lag_hours(area_ha: Column, cn: Column, slope_pct: Column) -> Column:
    """Catchment lag with the flow length from the area; never under one time step."""
    length_ft = 1.4 * F.pow(area_ha / 259.0, F.lit(0.6)) * 5280.0
    retention_in = 1000.0 / cn - 10.0
    lag = F.pow(length_ft, F.lit(0.8)) * F.pow(retention_in + 1.0, F.lit(0.7)) / (1900.0 * F.sqrt(F.greatest(slope_pct, F.lit(0.5))))
    return F.greatest(lag, F.lit(STEP_MIN / 60.0))


def rational_capacity(impervious_area: Column, area_ha: Column, intensity: float = 40.0) -> Column:
    return (0.3 + 0.6 * impervious_area / area_ha) * intensity * area_ha / 360.0


def ponding_cm(overflow_m3: Column, low_area_m2: Column, area_ha: Column, water_share: Column) -> Column:
    """Overflow spread over low ground (a tenth of the catchment where none is known); lakes store it."""
    spread = F.when(low_area_m2 > 0, low_area_m2).otherwise(area_ha * 10_000.0 * 0.1)
    return F.when(water_share >= 0.3, F.lit(0.0)).otherwise(F.least(overflow_m3 / spread * 100.0, F.lit(150.0)))


def waterlogging(depth: Column, water_share: Column) -> Column:
    return F.when(water_share >= 0.3, "lake storage").when(depth >= 45, "high").when(depth >= 15, "moderate").when(depth >= 5, "low").otherwise("none")


def topographic_wetness(flow_cells: Column, cell_m: float, slope_deg: Column) -> Column:
    return F.log(F.greatest(flow_cells, F.lit(1.0)) * cell_m / F.greatest(F.tan(F.radians(slope_deg)), F.lit(1e-3)))


def lookup(table: dict[int, float], key: Column) -> Column:
    """Value of a class from a fixed table; 0 for classes it lacks."""
    pairs = [F.lit(x) for k, v in sorted(table.items()) for x in (k, float(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key.cast("int")), F.lit(0.0))


def piecewise(x: Column, stops: tuple[tuple[float, float], ...]) -> Column:
    """Linear between stops; the ends hold their value."""
    out = F.when(x <= stops[0][0], F.lit(stops[0][1]))
    for (a, u), (b, v) in zip(stops, stops[1:]):
        out = out.when(x < b, u + (v - u) * (x - a) / (b - a))
    return out.otherwise(F.lit(stops[-1][1]))


def bounded_number(value: Column, low: float, high: float) -> Column:
    """A number from text; null unless finite and within bounds."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & x.between(low, high), x)


def route_minutes(metres: Column) -> Column:
    return metres / 1000.0 / SPEED_KMH * 60.0


def channel_width(area_ha: Column, length_m: Column) -> Column:
    """Overland flow width of a sub-catchment for the drainage model, at least 5 m."""
    return F.greatest(area_ha * 10_000.0 / F.greatest(length_m, F.lit(10.0)), F.lit(5.0))
