"""Coordinates of projected systems to longitude and latitude, as column expressions (inverse transverse Mercator series)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import let

#: Names that mean longitude and latitude already, and the ellipsoids' semi-axis and inverse flattening.
GEOGRAPHIC = (
    "4326", "epsg:4326", "urn:ogc:def:crs:epsg::4326", "crs84", "ogc:crs84", "urn:ogc:def:crs:ogc::crs84", "ogc:1.3:crs84", "http://www.opengis.net/def/crs/epsg/0/4326", "http://www.opengis.net/def/crs/ogc/1.3/crs84",
    "https://www.opengis.net/def/crs/epsg/0/4326", "https://www.opengis.net/def/crs/ogc/1.3/crs84", "urn:ogc:def:crs:ogc:1.3:crs84",
)
GRS80, WGS84 = (6378137.0, 298.257222101), (6378137.0, 298.257223563)
SCALE, EASTING = 0.9996, 500000.0
#: The last number of a system's name is its code.
CODE = r"(?:^|[:/])([0-9]+)\]?\s*$"


@dataclass(frozen=True)
class Zone:
    """A transverse Mercator zone: central meridian in degrees, false northing, ellipsoid, scale, false easting."""

    meridian: float
    northing: float
    axis: float
    flattening: float
    scale: float = SCALE
    easting: float = EASTING

    def series(self) -> dict:
        """What lon_lat reads: radius with the scale, and the series of fourth order in the third flattening."""
        f = 1 / self.flattening
        n = f / (2 - f)
        radius = self.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
        return {"method": "transverse", "radius": self.scale * radius, "meridian": self.meridian, "easting": self.easting, "northing": self.northing, "beta": beta, "delta": delta}


def is_geographic(name: str | None) -> bool:
    """Whether a system's name means longitude and latitude; no name means it too."""
    return name is None or name.strip().strip("[]").lower() in GEOGRAPHIC


def zones() -> dict[int, Zone]:
    """The projected systems that are known, by code: MGA2020, MGA94, UTM and NZTM2000."""
    out = {2193: Zone(173.0, 10_000_000.0, *GRS80, 0.9996, 1_600_000.0)}
    for i in range(46, 60):
        out[7800 + i] = out[28300 + i] = Zone(6.0 * i - 183, 10_000_000.0, *GRS80)
    for i in range(1, 61):
        out[32600 + i], out[32700 + i] = Zone(6.0 * i - 183, 0.0, *WGS84), Zone(6.0 * i - 183, 10_000_000.0, *WGS84)
    return out


def zone(name: str | None) -> Zone | None:
    """The zone of a projected system by its code; None for any other, which stays as it is."""
    found = re.search(CODE, name or "")
    return zones().get(int(found[1])) if found else None


def systems(spark: SparkSession) -> DataFrame:
    """code and system (what ``moved`` reads) of every projected system that is known, spherical Mercator too: some 150 rows."""
    rows = [(code, tuple(z.series().values())) for code, z in sorted(zones().items())] + [(3857, ("mercator", 6378137.0, 0.0, 0.0, 0.0, (), ()))]
    return spark.createDataFrame(rows, f"code int, system {SYSTEM}")


SYSTEM = "struct<method:string,radius:double,meridian:double,easting:double,northing:double,beta:array<double>,delta:array<double>>"


def code_of(name: Column) -> Column:
    """The code of a system's name; null where the name means longitude and latitude, or has none."""
    plain = F.lower(F.trim(F.translate(F.trim(name), "[]", "")))
    return F.when(~plain.isin(*GEOGRAPHIC), F.nullif(F.regexp_extract(name, CODE, 1), F.lit("")).try_cast("int"))


def lon_lat(x: Column, y: Column, z: Zone | Column) -> Column:
    """[longitude, latitude] in degrees of easting x and northing y.  z: a zone, or a column with its series."""
    q = z.series() if isinstance(z, Zone) else z
    term = (lambda name, j: q[name][j]) if isinstance(z, Zone) else (lambda name, j: F.get(q[name], F.lit(j)))
    xi, eta = (y - q["northing"]) / q["radius"], (x - q["easting"]) / q["radius"]

    def straightened(v: Column) -> Column:
        a, b = v["xi"], v["eta"]
        for j in range(4):
            a = a - term("beta", j) * F.sin(2 * (j + 1) * v["xi"]) * F.cosh(2 * (j + 1) * v["eta"])
            b = b - term("beta", j) * F.cos(2 * (j + 1) * v["xi"]) * F.sinh(2 * (j + 1) * v["eta"])
        return let(F.struct(a.alias("xi"), b.alias("eta")), conformal)

    def conformal(v: Column) -> Column:
        chi = F.asin(F.sin(v["xi"]) / F.cosh(v["eta"]))
        return let(F.struct(chi.alias("chi"), F.atan2(F.sinh(v["eta"]), F.cos(v["xi"])).alias("l")), degrees)

    def degrees(v: Column) -> Column:
        phi = v["chi"]
        for j in range(4):
            phi = phi + term("delta", j) * F.sin(2 * (j + 1) * v["chi"])
        return F.array(q["meridian"] + v["l"] * (180 / math.pi), phi * (180 / math.pi))

    return let(F.struct(xi.alias("xi"), eta.alias("eta")), straightened)


def _with_rest(position: Column, moved_: Column) -> Column:
    rest = F.slice(position, F.lit(3), F.greatest(F.size(position) - 2, F.lit(0)))
    return F.when(F.size(position) >= 2, F.concat(moved_, rest)).otherwise(position)


def moved(position: Column, system: Column) -> Column:
    """A position [x, y, …] of the row's own system (null: it stays) in longitude and latitude; further ordinates stay."""
    x, y = F.get(position, F.lit(0)), F.get(position, F.lit(1))
    mercator = F.array(x / system["radius"] * (180 / math.pi), (2 * F.atan(F.exp(y / system["radius"])) - math.pi / 2) * (180 / math.pi))
    return F.when(system.isNull(), position).otherwise(_with_rest(position, F.when(system["method"] == "mercator", mercator).otherwise(lon_lat(x, y, system))))


def reprojected(position: Column, name: str | None) -> Column:
    """A position [x, y, …] in longitude and latitude; further ordinates, and positions in systems that are not known, stay."""
    z = None if is_geographic(name) else zone(name)
    return position if z is None else _with_rest(position, lon_lat(F.get(position, F.lit(0)), F.get(position, F.lit(1)), z))
