"""Tile geometry and projection to degrees as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilescope.config import SceneExtent
from tilescope.functions.identity import grid_position

# WGS84 ellipsoid and UTM constants.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0


def window_bounds(row: Column, col: Column, size: int, affine: Column) -> Column:
    """array(left, bottom, right, top) of a pixel window; affine is (a, b, c, d, e, f)."""
    a, b, c, d, e, f = (affine[i] for i in range(6))
    x0, y0 = a * col + b * row + c, d * col + e * row + f
    x1, y1 = a * (col + size) + b * (row + size) + c, d * (col + size) + e * (row + size) + f
    return F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def bbox(bounds: Column, crs: Column) -> Column:
    """GeoJSON-like polygon struct of array(left, bottom, right, top)."""
    left, bottom, right, top = (bounds[i] for i in range(4))
    ring = F.array(
        F.array(right, bottom),
        F.array(right, top),
        F.array(left, top),
        F.array(left, bottom),
        F.array(right, bottom),
    )
    return F.struct(
        F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"), crs.alias("crs"), bounds.alias("bounds")
    )


def bbox_center(bounds: Column) -> tuple[Column, Column]:
    """(x, y) of the middle of the bounds."""
    return (bounds[0] + bounds[2]) / 2.0, (bounds[1] + bounds[3]) / 2.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body` by name.

    Plain expressions are copied wherever they are used: nested series would
    outgrow what Spark can compile, above all once the optimizer copies them into
    filters and join keys.
    """
    return F.transform(F.array(value), body)[0]


def utm_to_degrees(easting: Column, northing: Column, epsg: Column) -> Column:
    """struct(lat, lng) by the inverse transverse Mercator series in the third flattening.

    The zone comes from EPSG 326xx / 327xx.
    """
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )

    south = F.floor(epsg / 100) == 327
    xi = (northing - F.when(south, F.lit(UTM_FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))) / (UTM_SCALE * radius)
    eta = (easting - UTM_FALSE_EASTING) / (UTM_SCALE * radius)

    def straighten(p: Column) -> Column:
        x, y = p["xi"], p["eta"]
        for k, b in enumerate(beta, 1):
            x = x - b * F.sin(2 * k * p["xi"]) * F.cosh(2 * k * p["eta"])
            y = y - b * F.cos(2 * k * p["xi"]) * F.sinh(2 * k * p["eta"])
        return F.struct(x.alias("xi"), y.alias("eta"))

    def to_sphere(p: Column) -> Column:
        chi = F.asin(F.sin(p["xi"]) / F.cosh(p["eta"]))
        turn = F.atan2(F.sinh(p["eta"]), F.cos(p["xi"]))
        return F.struct(chi.alias("chi"), turn.alias("turn"))

    def to_ellipsoid(p: Column) -> Column:
        lat = p["chi"]
        for k, c in enumerate(delta, 1):
            lat = lat + c * F.sin(2 * k * p["chi"])
        return F.struct(F.degrees(lat).alias("lat"), (meridian + F.degrees(p["turn"])).alias("lng"))

    meridian = (epsg % 100) * 6 - 183
    grid = F.struct(xi.alias("xi"), eta.alias("eta"))
    return _let(_let(_let(grid, straighten), to_sphere), to_ellipsoid)


def degrees_to_utm(lat: Column, lng: Column, epsg: Column) -> tuple[Column, Column]:
    """(easting, northing) by the forward series, for placing points of interest in a scene."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    e = 2 * math.sqrt(n) / (1 + n)

    phi = F.radians(lat)
    turn = F.radians(lng - ((epsg % 100) * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi = F.atan2(t, F.cos(turn))
    eta = F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    south = F.floor(epsg / 100) == 327
    shift = F.when(south, F.lit(UTM_FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))
    return UTM_FALSE_EASTING + UTM_SCALE * radius * x, shift + UTM_SCALE * radius * y


def add_center_wgs84(
    df: DataFrame, bounds: str = "bounds", crs: str = "crs", lat: str = "lat", lng: str = "lng"
) -> DataFrame:
    """Add the centre of a bbox in degrees. (0, 0) without bounds; a CRS other than degrees, UTM and 3857 is an error."""
    x, y = bbox_center(F.col(bounds))
    code = F.upper(F.trim(F.col(crs)))
    epsg = F.regexp_extract(code, r"^EPSG:(32[67](?:0[1-9]|[1-5]\d|60))$", 1).try_cast("int")
    out = df.withColumn("__spot", utm_to_degrees(x, y, epsg))
    planar = F.col(crs).isNull() | (code == "") | (code == "EPSG:4326")
    missing = F.col(bounds).isNull() | (F.size(bounds) != 4)
    unknown = F.raise_error(F.concat(F.lit("no projection for "), F.col(crs))).cast("double")

    web = code == "EPSG:3857"
    radius = F.lit(6378137.0)

    def pick(projected: Column, mercator: Column, plain: Column) -> Column:
        return (
            F.when(missing, F.lit(0.0))
            .when(planar, plain)
            .when(web, mercator)
            .when(epsg.isNotNull(), projected)
            .otherwise(unknown)
        )

    spot = F.col("__spot")
    web_lat = F.degrees(2 * F.atan(F.exp(y / radius)) - F.pi() / 2)
    return out.withColumns(
        {lat: pick(spot["lat"], web_lat, y), lng: pick(spot["lng"], F.degrees(x / radius), x)}
    ).drop("__spot")


def grid_geolocate(tile_id: Column, extent: SceneExtent) -> Column:
    """struct(lat, lng) of a tile centre, linear in the row and column of its id."""
    row, col = grid_position(tile_id)
    lat = F.lit(extent.top) - (row + extent.tile_px / 2) / extent.scene_px * extent.height_deg
    lng = F.lit(extent.left) + (col + extent.tile_px / 2) / extent.scene_px * extent.width_deg
    return F.struct(lat.alias("lat"), lng.alias("lng"))
