"""Rows of two tables that lie within a distance of each other."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..defaults import EARTH_RADIUS_KM
from ..functions.geo import arc_km, haversine_km  # noqa: F401  (haversine_km for callers)

#: How many bands of latitude the distance is high: with more, fewer pairs meet for nothing, and a row of left looks into more cells.
BANDS = 2
#: Rows of right that meet those of left in one task; a cell with more is cut into parts.
PART = 4_000


def grid(km: float) -> tuple[float, int]:
    """Degrees that a band of latitude is high, and how many bands there are: one is at least as high as the distance, or as a millionth of the globe."""
    degrees = max(math.degrees(km / EARTH_RADIUS_KM) * (1 + 1e-9), 180e-6)
    bands = max(1, int(180 // degrees))
    return 180 / bands, bands


def cells_round(band: Column, height: float) -> Column:
    """How many cells a band is cut into: none is narrower, anywhere in the band, than the band is high."""
    south = F.lit(-90.0) + band * height
    narrow = F.least(F.cos(F.radians(south)), F.cos(F.radians(south + height)))
    return F.greatest(F.floor(360 / height * F.greatest(narrow, F.lit(0.0))), F.lit(1)).cast("int")


def cell(lon: Column, n: Column) -> Column:
    """The cell of a longitude (any number of degrees) in a band of n cells."""
    return F.pmod(F.floor((lon + 180) / 360 * n), n).cast("int")


def located(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows with a place on the globe."""
    return df.where(F.col(lat).between(-90, 90) & (F.abs(F.col(lon)) <= 360) & ~F.isnan(F.col(lat).cast("double")) & ~F.isnan(F.col(lon).cast("double")))


def pointed(df: DataFrame, lat: str, lon: str, side: str) -> DataFrame:
    """Rows with what their distances are worked out from: place in radians, cosine of the latitude, point on the unit sphere."""
    a, b = F.radians(F.col(lat)), F.radians(F.col(lon))
    at = {"lat": a, "cos": F.cos(a), "lon": b, "x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)}
    return located(df, lat, lon).withColumns({f"__{side}_{name}": value for name, value in at.items()})


def half_width(lat: Column, south: Column, north: Column, d: float) -> Column:
    """How many degrees of longitude a circle of d radians spans to either side within a band, at least; all if it holds a pole there."""
    if d >= math.pi / 2:
        return F.lit(180.0)
    a = F.radians(lat)
    # The circle is widest where its outline runs north; a band that doesn't reach there has its widest part at the nearer edge.
    widest = F.asin(F.greatest(F.least(F.sin(a) / math.cos(d), F.lit(1.0)), F.lit(-1.0)))
    at = F.greatest(F.least(widest, F.radians(north)), F.radians(south))
    # The margins are above the rounding of sines, and of the arc's cosine next to 1.
    cosine = (math.cos(d) - 1e-13 - F.sin(a) * F.sin(at)) / (F.cos(a) * F.cos(at))
    return F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))) + 1e-7


def within_km(left: DataFrame, right: DataFrame, km: float, left_at: tuple[str, str], right_at: tuple[str, str], distance: str = "distance_km") -> DataFrame:
    """All pairs of a row of left and one of right at most km apart, with their distance; the columns' names must differ.

    The globe is cut into bands of latitude, half as high as km, and these into cells about as wide or more. A row of right is in one cell; one of
    left looks into the cells that its circle can reach in each band, all of them around a pole it holds, and those beyond the date line. So rows
    meet by an equal cell; chords decide all pairs but those next to the limit, and exact distances these; each pair meets once. Cells are shuffled,
    and those with more than PART rows of right are cut, so dense places and few files still make many even tasks. left is what is repeated, so it
    should be the smaller one; right is read twice, once to count its cells.
    Rows without a place (null, not a number, beyond the poles) are near to none.
    """
    height, bands = grid(km / BANDS)
    d = km / EARTH_RADIUS_KM
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}")
    (la, lo), (ra, ro) = left_at, right_at
    band = lambda lat: F.least(F.floor((lat + 90) / height), F.lit(bands - 1)).cast("int")
    reach = math.degrees(d) * (1 + 1e-9) + 1e-9
    looks = pointed(left, la, lo, "l").withColumn("__band", F.explode(F.sequence(band(F.greatest(F.col(la) - reach, F.lit(-90.0))), band(F.least(F.col(la) + reach, F.lit(90.0))))))
    south = F.lit(-90.0) + F.col("__band") * height
    looks = looks.withColumn("__n", cells_round(F.col("__band"), height)).withColumn("__wide", half_width(F.col(la), south, south + height, d))
    turn = [F.floor((F.col(lo) + sign * F.col("__wide") + 180) / 360 * F.col("__n")).cast("int") for sign in (-1, 1)]
    last = F.least(turn[1], turn[0] + F.col("__n") - 1)
    looks = looks.withColumn("__cell", F.explode(F.transform(F.sequence(turn[0], last), lambda c: F.pmod(c, F.col("__n")))))

    placed = pointed(right, ra, ro, "r").withColumn("__band", band(F.col(ra))).withColumn("__cell", cell(F.col(ro), cells_round(band(F.col(ra)), height)))
    full = placed.groupBy("__band", "__cell").agg(F.count("*").alias("__rows")).where(F.col("__rows") > PART)
    # One row for each PART rows of right at most.
    full = F.broadcast(full.select("__band", "__cell", F.ceil(F.col("__rows") / PART).cast("int").alias("__parts")))
    key = ["__band", "__cell", "__part"]
    spread = F.xxhash64(*[name for name, kind in right.dtypes if "map<" not in kind])
    looks = looks.join(full, key[:2], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    placed = placed.join(full, key[:2], "left").withColumn("__part", F.when(F.col("__parts") > 1, F.pmod(spread, F.col("__parts"))).otherwise(0).cast("int"))

    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    looks, placed = looks.drop("__n", "__wide", "__parts").repartition(n, *key), placed.drop("__parts").repartition(n, *key)
    arc = arc_km(*[F.col(f"__{side}_{name}") for side in "lr" for name in ("lat", "cos", "lon")])
    gaps = [F.col(f"__l_{axis}") - F.col(f"__r_{axis}") for axis in "xyz"]
    chord = gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]
    limit = 2 * math.sin(min(d, math.pi) / 2)
    sure, may = (limit - 1e-12) ** 2 if limit > 1e-12 else -1.0, (limit + 1e-12) ** 2
    near = (chord <= sure) | ((chord <= may) & (arc <= km))
    pairs = looks.hint("merge").join(placed.withColumnsRenamed({k: f"{k}_r" for k in key}), [F.col(k) == F.col(f"{k}_r") for k in key] + [near])
    return pairs.select(*left.columns, *right.columns, arc.alias(distance))
