"""Bins, sectors, colours and texts as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.rounding import binary_rounded

# Bin limits and labels.
SWELL_EDGES = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 8.0)
SECTORS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
GALLERY_EDGES = (0.0, 0.3, 0.6, 0.8, 1.0, 1.2, 1.5, 1.8, 2.2, 2.8, 3.5, 5.0, 99.0)
GALLERY_LABELS = ("glass", "flat", "small-", "small", "small+", "moderate", "moderate+", "big", "big+", "storm", "storm+", "xxl")
SEGMENT_COLOURS = ((80, "#14b8a6"), (60, "#fb923c"), (40, "#eab308"), (20, "#64748b"), (None, "#475569"))
SECTION_COLOURS = ((70, "#14b8a6"), (60, "#2dd4bf"), (50, "#fb923c"), (None, "#64748b"))
BADGES = {3: "Satellite verified", 2: "Partial data", None: "Geometry only"}


def band(value: Column, edges: Sequence[float], labels: Sequence[str], above: str | None = None) -> Column:
    """Label of the half-open band [lo, hi) that holds the value; first match."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        hit = (value >= lo) & (value < hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.when(value.isNotNull(), above) if above else out


def band_labels(edges: Sequence[float], unit: str = "m") -> list[str]:
    return [f"{lo}-{hi}{unit}" for lo, hi in zip(edges, edges[1:], strict=False)]


def swell_bin(height: Column) -> Column:
    """Ten labels; what lies above the last edge (or below the first) is the overflow."""
    return band(height, SWELL_EDGES, band_labels(SWELL_EDGES), f">{SWELL_EDGES[-1]}m")


def gallery_bin(height: Column) -> Column:
    """Twelve labels; null outside."""
    return band(height, GALLERY_EDGES, GALLERY_LABELS)


def sector(degrees: Column) -> Column:
    """Eight sectors of 45 degrees, the first from 0 on."""
    at = F.floor(F.pmod(degrees, F.lit(360.0)) / 45).cast("int")
    return F.when(degrees.isNotNull(), F.get(F.array(*map(F.lit, SECTORS)), at))


def compass(degrees: Column) -> Column:
    """Sixteen points, each centred on its direction."""
    at = F.pmod(F.floor(degrees / 22.5 + 0.5), F.lit(16)).cast("int")
    return F.when(degrees.isNotNull(), F.get(F.array(*map(F.lit, COMPASS)), at))


def steps(value: Column, limits: Sequence[tuple[float | None, str]]) -> Column:
    """Label of the first limit that the value reaches; the last one has no limit."""
    out = None
    for limit, label in limits[:-1]:
        out = F.when(value >= limit, label) if out is None else out.when(value >= limit, label)
    return out.otherwise(limits[-1][1])


def confidence_badge(confidence: Column) -> Column:
    return F.when(confidence == 3, BADGES[3]).when(confidence == 2, BADGES[2]).otherwise(BADGES[None])


def range_label(low: Column, high: Column, unit: str = "m") -> Column:
    return F.when(low.isNotNull(), F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(unit)))


def percent(value: Column, most: float = 1.0) -> Column:
    """Rounded half up."""
    return F.floor(value / most * 100 + 0.5).cast("long")


def tide_glyph(state: Column) -> Column:
    return F.when(state == "high", "▲").when(state == "low", "▼").when(state == "mid", "◆").otherwise("")


def scene_name(slug: Column, day: Column, height: Column, kind: str, suffix: str = "") -> Column:
    """File name of a scene's picture."""
    return F.concat(slug, F.lit("_"), F.date_format(day, "yyyy-MM-dd"), F.lit("_"), F.round(height, 1).cast("string"), F.lit(f"m_{kind}{suffix}.png"))


def long_date(text: Column) -> Column:
    """'March 5, 2024' for an ISO date; a text without three parts stays as it is."""
    day = F.try_to_date(text)
    return F.when(day.isNotNull(), F.date_format(day, "MMMM d, yyyy")).otherwise(text)


def head_of(ids: Column, n: int = 3, size: Column | None = None) -> Column:
    """The first ``n`` of a list and how many more there are; ``size``, if not all are in the list."""
    more = (F.size(ids) if size is None else size) - n
    return F.concat(F.array_join(F.slice(ids, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))


# Texts of the score explanations, with the least score or share each is for.
FACING = ((0.8, "directly into Atlantic swell window"), (0.4, "oblique to primary swell"), (None, "poor alignment with Atlantic swell"))
HIGHLIGHTS = {"swell": ((30, "Excellent swell exposure"), (20, "Good swell alignment")), "shape": ((15, "Favorable coastal geometry"),), "road": ((10, "Good road access"),)}
CAVEATS = {"bathymetry": "No bathymetry data available", "road": "Remote — no nearby road access", "arc": "Limited ocean exposure"}
LEAST_ARC = 60
SLOPE_TEXTS = ("Bathymetry data not available (GEBCO not loaded)", "Shallow nearshore area", "Nearshore gradient: %.3f m/m")
ROAD_TEXTS = ("No road within 5km", "Road access within ", "m", "Road ", "m away")


def facing_text(orientation: Column, share: Column) -> Column:
    """How the place faces the swell; ``share`` is the direction part of its score, 0 to 1."""
    return F.concat(F.lit("Faces "), F.bround(orientation).cast("long").cast("string"), F.lit("° — "), steps(share, FACING))


def slope_text(n_wet: Column, slope: Column) -> Column:
    return F.when(n_wet.isNull(), SLOPE_TEXTS[0]).when(n_wet < 2, SLOPE_TEXTS[1]).otherwise(F.format_string(SLOPE_TEXTS[2], binary_rounded(slope, 3)))


def road_text(distance: Column) -> Column:
    metres = F.bround(distance).cast("long").cast("string")
    return F.when(distance.isNull(), ROAD_TEXTS[0]).when(distance <= 200, F.concat(F.lit(ROAD_TEXTS[1]), metres, F.lit(ROAD_TEXTS[2]))).otherwise(F.concat(F.lit(ROAD_TEXTS[3]), metres, F.lit(ROAD_TEXTS[4])))


def highlights(swell: Column, shape: Column, road: Column) -> Column:
    """Texts of what is good about a place, in order."""
    found = []
    for name, value in (("swell", swell), ("shape", shape), ("road", road)):
        text = F.lit(None).cast("string")
        for least, label in reversed(HIGHLIGHTS[name]):
            text = F.when(value >= least, label).otherwise(text)
        found.append(text)
    return F.array_compact(F.array(*found))


def caveats(bathymetry: Column, road: Column, arc: Column) -> Column:
    """Texts of what is not, in order."""
    return F.array_compact(F.array(F.when(bathymetry == 0, CAVEATS["bathymetry"]), F.when(road == 0, CAVEATS["road"]), F.when(arc < LEAST_ARC, CAVEATS["arc"])))
