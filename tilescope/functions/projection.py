"""Projected coordinates to degrees, for any reference system that is described by its parameters.

A definition is a text of `+name=value` parts, as in

    +proj=lcc +lat_1=28.3833 +lat_2=30.2833 +lat_0=27.8333 +lon_0=-99 +x_0=609601.2 +y_0=0 +ellps=clrk66 +units=us-ft

with proj one of lcc (Lambert conformal conic, one or two standard parallels), aea (Albers equal area), stere
(polar stereographic, by scale or by latitude of true scale), tmerc and utm (transverse Mercator), merc
(Mercator) and longlat. Definitions are parsed once into a small table of numbers, at most MOST_SYSTEMS rows;
rows meet it by the code of their system, and the series are column expressions over its numbers. There is no
change of datum: results are degrees on the definition's own ellipsoid. A system that is not in the table gives
null positions and a flag, not an error.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescope.functions.geodesy import _let

MOST_SYSTEMS = 10_000

# Ellipsoids (semi-major axis, inverse flattening) and units in metres.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "GRS80": (6378137.0, 298.257222101),
    "clrk66": (6378206.4, 294.9786982138982),
    "intl": (6378388.0, 297.0),
    "bessel": (6377397.155, 299.1528128),
    "airy": (6377563.396, 299.3249646),
}
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200 / 3937}


def parse_definition(text: str) -> dict[str, str]:
    """Names and values of a definition's parts."""
    parts = (p.lstrip("+").partition("=") for p in text.split())
    return {name: value or "true" for name, _, value in parts}


def _series(e2: float) -> list[float]:
    """Coefficients of sin 2x .. sin 8x from conformal to geodetic latitude."""
    return [
        e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360,
        7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
        7 * e2**3 / 120 + 81 * e2**4 / 1120,
        4279 * e2**4 / 161280,
    ]


def parameters(text: str) -> dict:
    """The numbers of a definition: kind, centre, false origin, unit, latitude series, and p, what the kind needs."""
    d = parse_definition(text)
    kind = d.get("proj", "")
    a, rf = ELLIPSOIDS[d.get("ellps", d.get("datum", "WGS84"))]
    a, rf = float(d.get("a", a)), float(d.get("rf", rf))
    f = 1 / rf if rf else 0.0
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    if kind == "utm":
        zone = int(d["zone"])
        d |= {"lon_0": str(zone * 6 - 183), "k": "0.9996", "x_0": "500000", "y_0": "10000000" if "south" in d else "0"}
        kind = "tmerc"

    def angle(name: str, otherwise: float = 0.0) -> float:
        return math.radians(float(d.get(name, otherwise)))

    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    def t(phi: float) -> float:
        s = e * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    def q(phi: float) -> float:
        s = math.sin(phi)
        if not e:
            return 2 * s
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    k0, phi0 = float(d.get("k_0", d.get("k", 1.0))), angle("lat_0")
    series, p = _series(e2), []
    if kind == "lcc":
        one = angle("lat_1", d.get("lat_0", 0.0))
        two = angle("lat_2", math.degrees(one))
        n = math.sin(one) if one == two else math.log(m(one) / m(two)) / math.log(t(one) / t(two))
        scale = a * k0 * m(one) / (n * t(one) ** n)
        rho0 = 0.0 if abs(phi0) >= math.pi / 2 else scale * t(phi0) ** n
        p = [n, scale, rho0]
    elif kind == "aea":
        one, two = angle("lat_1"), angle("lat_2", d.get("lat_1", 0.0))
        n = math.sin(one) if one == two else (m(one) ** 2 - m(two) ** 2) / (q(two) - q(one))
        c = m(one) ** 2 + n * q(one)
        p = [n, c, a * math.sqrt(c - n * q(phi0)) / n, a, q(math.pi / 2)]
        series = [
            e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040,
            23 * e2**2 / 360 + 251 * e2**3 / 3780,
            761 * e2**3 / 45360,
            0.0,
        ]
    elif kind == "stere":
        pole = 1.0 if float(d["lat_0"]) > 0 else -1.0
        true = pole * angle("lat_ts", 90 * pole)
        if abs(true - math.pi / 2) < 1e-12:
            reach = 2 * a * k0 / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        else:
            reach = a * m(true) / t(true)
        p = [pole, reach]
    elif kind == "merc":
        p = [a * (m(angle("lat_ts")) if "lat_ts" in d else k0)]
    elif kind == "tmerc":
        n = f / (2 - f)
        radius = k0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        beta = [
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        ]
        alpha = [
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        ]
        # The false origin's latitude as a distance along the central meridian.
        chi = math.asin(math.tanh(math.atanh(math.sin(phi0)) - e * math.atanh(e * math.sin(phi0))))
        origin = chi + sum(c * math.sin(2 * (k + 1) * chi) for k, c in enumerate(alpha))
        p = [radius, origin, *beta]
    elif kind != "longlat":
        raise ValueError(f"no projection for +proj={kind}")
    unit = float(d.get("to_meter", UNITS[d.get("units", "m")]))
    return {
        "kind": kind, "lon_0": float(d.get("lon_0", 0.0)), "x_0": float(d.get("x_0", 0.0)), "y_0": float(d.get("y_0", 0.0)),
        "unit": 1.0 if kind == "longlat" else unit, "series": series, "p": [float(x) for x in p],
    }


def system_table(spark: SparkSession, definitions: Mapping[str, str]) -> DataFrame:
    """(code, system) of some definitions by code; codes compare in upper case."""
    if len(definitions) > MOST_SYSTEMS:
        raise ValueError(f"{len(definitions)} systems; at most {MOST_SYSTEMS} are sent to every task")
    kind = "struct<kind:string,lon_0:double,x_0:double,y_0:double,unit:double,series:array<double>,p:array<double>>"
    rows = [(code.strip().upper(), tuple(parameters(text).values())) for code, text in definitions.items()]
    return spark.createDataFrame(rows, f"code string, system {kind}")


def _latitude(chi: Column, s: Column) -> Column:
    """Radians: an auxiliary latitude and its series."""
    return _let(chi, lambda x: sum((s["series"][k] * F.sin(2 * (k + 1) * x) for k in range(4)), x))


def _degrees(lat: Column, turn: Column, s: Column) -> Column:
    lng = F.degrees(turn) + s["lon_0"]
    return F.struct(F.degrees(lat).alias("lat"), (lng - 360 * F.floor((lng + 180) / 360)).alias("lng"))


def to_degrees(x: Column, y: Column, s: Column) -> Column:
    """struct(lat, lng) of a position in the system s of system_table; null if s is."""
    p = s["p"]
    spot = F.struct((x * s["unit"] - s["x_0"]).alias("x"), (y * s["unit"] - s["y_0"]).alias("y"))
    half = math.pi / 2

    def conic(at: Column) -> Column:
        n, sign = p[0], F.signum(p[0])
        rho = sign * F.sqrt(at["x"] ** 2 + (p[2] - at["y"]) ** 2)
        turn = F.atan2(sign * at["x"], sign * (p[2] - at["y"])) / n
        return F.struct(rho.alias("rho"), turn.alias("turn"))

    def lcc(c: Column) -> Column:
        chi = half - 2 * F.atan(F.pow(c["rho"] / p[1], 1 / p[0]))
        return _degrees(_latitude(chi, s), c["turn"], s)

    def aea(c: Column) -> Column:
        q = (p[1] - (c["rho"] * p[0] / p[3]) ** 2) / p[0]
        return _degrees(_latitude(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / p[4]))), s), c["turn"], s)

    def stere(at: Column) -> Column:
        pole = p[0]
        chi = half - 2 * F.atan(F.sqrt(at["x"] ** 2 + at["y"] ** 2) / p[1])
        return _degrees(pole * _latitude(chi, s), F.atan2(at["x"], -pole * at["y"]), s)

    def merc(at: Column) -> Column:
        return _degrees(_latitude(half - 2 * F.atan(F.exp(-at["y"] / p[0])), s), at["x"] / p[0], s)

    def straighten(at: Column) -> Column:
        xi, eta = at["y"] / p[0] + p[1], at["x"] / p[0]

        def series(g: Column) -> Column:
            u, v = g["xi"], g["eta"]
            for k in range(4):
                m = 2.0 * (k + 1)
                u = u - p[2 + k] * F.sin(m * g["xi"]) * F.cosh(m * g["eta"])
                v = v - p[2 + k] * F.cos(m * g["xi"]) * F.sinh(m * g["eta"])
            return F.struct(u.alias("xi"), v.alias("eta"))

        return _let(F.struct(xi.alias("xi"), eta.alias("eta")), series)

    def tmerc(g: Column) -> Column:
        chi = F.asin(F.sin(g["xi"]) / F.cosh(g["eta"]))
        return _degrees(_latitude(chi, s), F.atan2(F.sinh(g["eta"]), F.cos(g["xi"])), s)

    def pick(at: Column) -> Column:
        kind = s["kind"]
        return (
            F.when(kind == "lcc", _let(conic(at), lcc))
            .when(kind == "aea", _let(conic(at), aea))
            .when(kind == "stere", stere(at))
            .when(kind == "merc", merc(at))
            .when(kind == "tmerc", _let(straighten(at), tmerc))
            .when(kind == "longlat", F.struct(at["y"].alias("lat"), at["x"].alias("lng")))
        )

    return F.when(s.isNotNull() & x.isNotNull() & y.isNotNull(), _let(spot, pick))


def add_degrees(
    df: DataFrame, systems: DataFrame, x: Column, y: Column, crs: str = "crs", lat: str = "lat", lng: str = "lng", known: str = "crs_known"
) -> DataFrame:
    """Add the position in degrees, and whether its system is in the table; null positions where it is not."""
    # The table holds MOST_SYSTEMS rows at most.
    side = F.broadcast(systems.select(F.col("code").alias("__code"), F.col("system").alias("__system")))
    placed = df.join(side, F.upper(F.trim(F.col(crs))) == F.col("__code"), "left").withColumn("__spot", to_degrees(x, y, F.col("__system")))
    return placed.withColumns(
        {lat: F.col("__spot.lat"), lng: F.col("__spot.lng"), known: F.col("__system").isNotNull()}
    ).drop("__spot", "__system", "__code")
