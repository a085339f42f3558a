"""Transverse Mercator between degrees and metres, as Column expressions.

Krueger's series in the third flattening, to its fourth power, with the public
parameters of the grid on the WGS84 ellipsoid.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Fixed values of the grid: ellipsoid, origin in degrees, scale and false origin in metres."""

    a: float = 6378137.0
    inverse_flattening: float = 298.257223563
    lat0: float = 1.0 + 22.0 / 60
    lon0: float = 103.0 + 50.0 / 60
    k0: float = 1.0
    east0: float = 28001.642
    north0: float = 38744.572

    @property
    def n(self) -> float:
        f = 1 / self.inverse_flattening
        return f / (2 - f)

    @property
    def eccentricity(self) -> float:
        return 2 * math.sqrt(self.n) / (1 + self.n)

    @property
    def radius(self) -> float:
        """Radius of the rectifying sphere, scaled."""
        n = self.n
        return self.k0 * self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def alpha(self) -> tuple[float, ...]:
        n = self.n
        return n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280

    @property
    def beta(self) -> tuple[float, ...]:
        n = self.n
        return n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280

    @property
    def delta(self) -> tuple[float, ...]:
        n = self.n
        return 2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630

    @property
    def xi0(self) -> float:
        """The origin's place on the meridian."""
        s = math.sin(math.radians(self.lat0))
        t = math.sinh(math.atanh(s) - self.eccentricity * math.atanh(self.eccentricity * s))
        xi = math.atan(t)
        return xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(self.alpha))


GRID = Grid()


def to_grid(lon: Column, lat: Column, g: Grid = GRID) -> tuple[Column, Column]:
    """(x, y) in metres."""
    e = g.eccentricity
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    d = F.radians(lon - g.lon0)
    xi = F.atan2(t, F.cos(d))
    eta = F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
    north, east = xi, eta
    for j, a in enumerate(g.alpha, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return g.east0 + g.radius * east, g.north0 + g.radius * (north - g.xi0)


def to_degrees(x: Column, y: Column, g: Grid = GRID) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    xi, eta = (y - g.north0) / g.radius + g.xi0, (x - g.east0) / g.radius
    u, v = xi, eta
    for j, b in enumerate(g.beta, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(g.delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return g.lon0 + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)
