"""Geometry and projection as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84, and UTM zone 20 north.
A, INV_F = 6378137.0, 298.257223563
K0, LON0, EASTING = 0.9996, -63.0, 500_000.0


def angular_distance(a: Column, b: Column | float) -> Column:
    """Smallest angle between two directions, 0 to 180."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def bearing(dx: Column, dy: Column) -> Column:
    """Compass bearing of a step east dx, north dy."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def ray_end(x: Column, y: Column, radius: Column | float, direction: Column) -> tuple[Column, Column]:
    turn = F.radians(direction)
    return x + F.sin(turn) * radius, y + F.cos(turn) * radius


def utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing by the transverse Mercator series."""
    n = (1 / INV_F) / (2 - 1 / INV_F)
    e = math.sqrt(1 - (1 - 1 / INV_F) ** 2)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(lat), F.radians(lon - LON0)
    sin = F.sin(phi)
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    u = atanh(sin) - e * atanh(e * sin)
    t = (F.exp(u) - F.exp(-u)) / 2
    xi = F.atan2(t, F.cos(lam))
    eta = atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        grow, fall = F.exp(eta * (2 * j)), F.exp(-eta * (2 * j))
        x = x + a * F.cos(xi * (2 * j)) * (grow - fall) / 2
        y = y + a * F.sin(xi * (2 * j)) * (grow + fall) / 2
    return EASTING + x * (K0 * radius), y * (K0 * radius)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from the edge a-b."""
    along = edge_fraction(px, py, ax, ay, bx, by)
    return F.hypot(px - (ax + along * (bx - ax)), py - (ay + along * (by - ay)))


def edge_fraction(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on the edge a-b (0 to 1) the point is nearest; 0 on an edge without length."""
    square = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    raw = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.when(square > 0, square)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))


def capsule_span(y: Column, ax: Column, ay: Column, bx: Column, by: Column, radius: Column | float) -> tuple[Column, Column]:
    """The interval of x in which a point at height ``y`` lies within ``radius`` of the edge a-b;
    null where there is none. It is the hull of both ends' discs and of the band between."""
    dx, dy = bx - ax, by - ay
    size = F.hypot(dx, dy)
    nx, ny = -dy / F.when(size > 0, size) * radius, dx / F.when(size > 0, size) * radius

    def disc(x: Column, at: Column) -> tuple[Column, Column]:
        square = radius * radius - (y - at) * (y - at)
        half = F.when(square >= 0, F.sqrt(square))
        return x - half, x + half

    def side(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        t = (y - y0) / F.when(y1 != y0, y1 - y0)
        return F.when((t >= 0) & (t <= 1), x0 + t * (x1 - x0))

    corners = ((ax + nx, ay + ny), (bx + nx, by + ny), (bx - nx, by - ny), (ax - nx, ay - ny))
    band = [side(*corners[k], *corners[(k + 1) % 4]) for k in range(4)]
    first, last = disc(ax, ay), disc(bx, by)
    return F.least(first[0], last[0], *band), F.greatest(first[1], last[1], *band)


def length_inside(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, radius: float) -> Column:
    """Length of the part of the edge a-b that lies within ``radius`` of a point."""
    dx, dy, fx, fy = bx - ax, by - ay, ax - px, ay - py
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - radius * radius
    root = b * b - 4 * a * c
    half = F.sqrt(F.greatest(root, F.lit(0.0)))
    first = F.greatest((-b - half) / (2 * a), F.lit(0.0))
    last = F.least((-b + half) / (2 * a), F.lit(1.0))
    return F.when((a > 0) & (root > 0), F.greatest(last - first, F.lit(0.0)) * F.sqrt(a)).otherwise(0.0)


def hidden_arcs(met: DataFrame, skip: float, radius: float) -> DataFrame:
    """``met`` (x, y, ax, ay, bx, by, ...) once for each part of the edge a-b within ``radius`` of (x, y) on either
    side of the disc of ``skip`` around it, with the directions that this part hides:
    __start and __width in degrees. Each step is a projection of its own, and both parts take
    the same ones, so that the compiled code stays short enough to be optimised."""
    c = F.col
    met = met.withColumns({"__dx": c("bx") - c("ax"), "__dy": c("by") - c("ay"), "__fx": c("ax") - c("x"), "__fy": c("ay") - c("y")})
    met = met.withColumns({"__a": 2 * (c("__dx") * c("__dx") + c("__dy") * c("__dy")), "__b": 2 * (c("__fx") * c("__dx") + c("__fy") * c("__dy")), "__c": c("__fx") * c("__fx") + c("__fy") * c("__fy")})
    # Where on the edge's line (0 to 1 on the edge) its distance from the point is r: roots of a square equation.
    met = met.where("__a > 0").withColumns({f"__q{k}": c("__b") * c("__b") - 2 * c("__a") * (c("__c") - r * r) for k, r in (("out", radius), ("in", skip))}).where("__qout >= 0")
    met = met.withColumns({"__hout": F.sqrt("__qout"), "__hin": F.sqrt(F.greatest("__qin", F.lit(0.0)))})
    met = met.withColumns({"__low": F.greatest((-c("__b") - c("__hout")) / c("__a"), F.lit(0.0)), "__high": F.least((c("__hout") - c("__b")) / c("__a"), F.lit(1.0))}).where("__low <= __high")
    # Without a crossing of the inner disc the first part is the whole edge and there is no second.
    crossed = c("__qin") >= 0
    met = met.withColumns({"__near": F.when(crossed, F.least((-c("__b") - c("__hin")) / c("__a"), c("__high"))).otherwise(c("__high")), "__far": F.when(crossed, F.greatest((c("__hin") - c("__b")) / c("__a"), c("__low"))).otherwise(F.lit(2.0))})
    parts = F.explode(F.array(F.struct(c("__low").alias("first"), c("__near").alias("last")), F.struct(c("__far").alias("first"), c("__high").alias("last"))))
    met = met.withColumn("__part", parts).where("__part.first <= __part.last")
    towards = lambda t: bearing(c("__fx") + c(t) * c("__dx"), c("__fy") + c(t) * c("__dy"))
    met = met.withColumns({"__from": towards("__part.first"), "__to": towards("__part.last")})
    met = met.withColumn("__turn", F.pmod(c("__to") - c("__from") + 180, F.lit(360.0)) - 180)
    met = met.withColumns({"__start": F.when(c("__turn") >= 0, c("__from")).otherwise(c("__to")), "__width": F.abs("__turn")})
    return met.drop(*(x for x in met.columns if x.startswith("__") and x not in ("__start", "__width")))


def rays_in(off: str, width: str, step: int, first: int, last: int) -> Column:
    """Bits of the rays ``first`` to ``last`` - 1, ``step`` degrees apart over half a circle, in an arc of less
    than 180 degrees that starts ``off`` (-180 to 180) degrees from ray 0."""
    low, high = f"greatest(ceil({off} / {step}), {first})", f"least(floor(({off} + {width}) / {step}), {last - 1})"
    return F.expr(f"case when {low} <= {high} then shiftleft(1L, cast({high} - {first - 1} as int)) - shiftleft(1L, cast({low} - {first} as int)) else 0L end")


def swell_exposure(orientation: Column, arc: Column, main: float = 170.0) -> Column:
    """Facing the main swell, times the open arc, of 40 points. The steps at 30, 60
    and 90 degrees, with the jump just above 60, are part of the definition."""
    return facing_share(orientation, main) * F.least(arc / 120, F.lit(1.0)) * 40


def facing_share(orientation: Column, main: float = 170.0) -> Column:
    """How well a place faces the main swell, 0 to 1."""
    off = angular_distance(orientation, main)
    return F.when(off <= 30, 1.0).when(off <= 60, 1 - (off - 30) / 30).when(off <= 90, 0.5 * (1 - (off - 60) / 30)).otherwise(0.0)


def road_access(distance: Column) -> Column:
    """15 points up to 200 m, none from 5 km on, a straight line between."""
    return F.when(distance.isNull(), 0.0).when(distance <= 200, 15.0).when(distance >= 5000, 0.0).otherwise(15 * (1 - (distance - 200) / 4800))


def landward_offset(facing: Column, reach: float = 200.0, lat: float = 44.6) -> tuple[Column, Column]:
    """Degrees east and north that move a place ``reach`` metres away from the sea, at the scale of one latitude."""
    turn = F.radians(F.pmod(facing + 180, F.lit(360.0)))
    return F.sin(turn) * (reach / (111_000 * math.cos(math.radians(lat)))), F.cos(turn) * (reach / 111_000)


def bathymetry(n_wet: Column, slope: Column) -> Column:
    """20 points for a slope of 5 % and more; 5 points with fewer than two cells under water."""
    return F.when(n_wet >= 2, F.least(slope / 0.05, F.lit(1.0)) * 20).otherwise(5.0)


def sinuosity_bonus(length: Column, straight: Column, points: Column) -> Column:
    """How much longer than straight the line is, up to 0.3; three points at least."""
    return F.when((points >= 3) & (straight > 0), F.least((length / F.when(straight > 0, straight) - 1) * 5, F.lit(0.3))).otherwise(0.0)


def shape_score(ring_length: Column, bonus: Column) -> Column:
    """Coastline within the ring around a place, up to 6 km, and the bonus, of 25 points."""
    return F.least((F.least(ring_length / 6000, F.lit(1.0)) + bonus) * 25, F.lit(25.0))


def to_pixel(lat: Column, lon: Column, box: tuple[float, float, float, float], width: int, height: int, margin: float = 0.001) -> tuple[Column, Column]:
    """(x, y) in an image of the box (west, south, east, north); null outside by more than the margin."""
    w, s, e, n = box
    inside = (lat >= s - margin) & (lat <= n + margin) & (lon >= w - margin) & (lon <= e + margin)
    x = ((lon - w) / (e - w) * width).cast("int")
    y = ((n - lat) / (n - s) * height).cast("int")
    clamp = lambda v, most: F.greatest(F.lit(0), F.least(v, F.lit(most - 1)))
    return F.when(inside, clamp(x, width)), F.when(inside, clamp(y, height))
