"""Colours, leads, labels and checks of requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ponding.functions.hydro import LEADS, OPACITY, PASSABLE_CM, piecewise

CITIES = ("bengaluru", "chennai", "mumbai", "delhi")


def hex_channel(colour: Column, k: int) -> Column:
    """Red (0), green (1) or blue (2) of "#rrggbb"."""
    return F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("int")


def ramp(depth: Column, stops: tuple[tuple[float, str], ...]) -> Column:
    """rgb of a depth between colour stops, each channel linear; the ends hold."""
    channel = lambda k: piecewise(depth, tuple((d, float(int(c[1 + 2 * k : 3 + 2 * k], 16))) for d, c in stops))
    return F.struct(*[F.round(channel(k)).cast("int").alias(n) for k, n in enumerate(("r", "g", "b"))])


#: Red, green, blue and alpha of heights above drainage in metres (fixed values).
HAND_STOPS = ((0.0, 8, 48, 107, 230), (2.0, 33, 113, 181, 205), (5.0, 66, 146, 198, 160), (9.0, 158, 202, 225, 90), (14.0, 222, 235, 247, 0))


def hand_colour(height: Column) -> Column:
    """r, g, b, a of a height above drainage, cut to whole numbers; the deepest blue where it is lowest, clear at 14 m and where it is unknown."""
    known = height.isNotNull() & ~F.isnan(height)
    h = F.when(known, F.least(F.greatest(height, F.lit(0.0)), F.lit(14.0))).otherwise(F.lit(14.0))
    channel = lambda k: F.floor(piecewise(h, tuple((s[0], float(s[k])) for s in HAND_STOPS))).cast("int")
    return F.struct(*[channel(k).alias(n) for k, n in enumerate(("r", "g", "b"), 1)], F.when(known, channel(4)).otherwise(0).alias("a"))


def opacity(depth: Column) -> Column:
    return piecewise(depth, OPACITY)


def nearest_lead(minute: Column) -> Column:
    """The lead next to a minute, the lower of two equally near; null outside 0 to 180."""
    near = F.array_min(F.array(*[F.struct(F.abs(minute - m).alias("d"), F.lit(m).alias("lead")) for m in LEADS])).lead
    return F.when(minute.between(LEADS[0], LEADS[-1]), near)


def local_hour(ts: Column) -> Column:
    """The hour in Indian time, UTC+5:30, as text."""
    return F.date_format(F.from_utc_timestamp(ts, "Asia/Kolkata"), "yyyy-MM-dd'T'HH:00")


def radius_of(volume: Column) -> Column:
    """Marker radius: 2.5 to 11 with the root of a volume from 0 to 5.3, clamped."""
    share = F.least(F.greatest(F.sqrt(F.greatest(volume, F.lit(0.0))) / F.sqrt(F.lit(5.3)), F.lit(0.0)), F.lit(1.0))
    return 2.5 + 8.5 * share


def check_request(city: str, mode: str = "car", lead: int = 0) -> None:
    """ValueError for an unknown city or vehicle or a lead out of range."""
    if city not in CITIES:
        raise ValueError(f"unknown city {city!r}")
    if mode not in PASSABLE_CM:
        raise ValueError(f"unknown vehicle {mode!r}")
    if not LEADS[0] <= lead <= LEADS[-1]:
        raise ValueError(f"a lead lies between {LEADS[0]} and {LEADS[-1]} minutes")
