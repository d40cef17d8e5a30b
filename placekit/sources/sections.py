"""Sections of the source data: which features of a service are asked for, and the rows that are made of them.

A raw feature has ``attributes`` (map of texts), ``x`` and ``y`` of its own point and ``cx`` and ``cy`` of its centroid, of which a
service gives one pair, and ``seq``, its place in the answer. A section names the filter that is pushed to the service; the
same filter as a column is applied again here, so that a service which ignores it does no harm. Missing access counts as allowed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds that sections ask for, words that are no value, square metres to acres and the least water area.
STATE_LAND = ["Wildlife Area", "Wildlife Sanctuary", "Flood Control", "Fish Hatchery"]
GROUNDS = ["recreation_ground", "village_green", "forest"]
FACILITIES = ["pitch", "track", "swimming_pool", "playground", "dog_park", "sports_centre", "fitness_station", "beach_resort"]
SHUT, SHUT_PARKING = ["private", "no"], ["private", "no", "customers", "permit"]
NO_CLASS = ["N/A", "UNCLASSIFIED", "None"]
ACRES, LEAST_WATER, LEAST_STATE = 0.000247105, 2000.0, 5


def attr(name: str) -> Column:
    return F.col("attributes")[name]


def named(name: str) -> Column:
    """The attribute, unless it is missing or empty."""
    return F.when(attr(name) != "", attr(name))


def number(name: str) -> Column:
    return F.coalesce(attr(name).try_cast("double"), F.lit(0.0))


def web(name: str) -> Column:
    """An address on the web, or none."""
    return F.when(attr(name).startswith("http"), attr(name))


def allowed(shut: list[str]) -> Column:
    return attr("access").isNull() | ~attr("access").isin(*shut)


def at(c: str) -> Column:
    """Latitude or longitude: of the centroid if there is one, else of the feature's own point, to five places."""
    return F.round(F.coalesce(F.col(f"c{c}"), F.col(c)), 5)


def acres(area: Column, lat: Column) -> Column:
    """Area on the map's projection as whole acres on the ground."""
    k = F.cos(F.radians(lat))
    return F.floor(area * k * k * ACRES + 0.5)


@dataclass(frozen=True)
class Section:
    """One section: layers of the service, what is asked of it, and the rows made of the answer."""

    name: str
    layers: tuple[str, ...]
    where: str
    fields: tuple[str, ...]
    keep: Callable[[], Column]
    columns: Callable[[], dict[str, Column]]
    after: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)
    point: bool = False  # a layer of points, which has no centroids


def _best_of_name(df: DataFrame) -> DataFrame:
    """The largest of each name, the first of equal ones; small ones go."""
    best = df.groupBy("n").agg(F.min(F.struct((-F.col("a")).alias("o"), "seq", "t", "a", "lat", "lng")).alias("b"))
    return best.select("n", "b.t", "b.a", "b.lat", "b.lng", "b.seq").where(F.col("a") >= LEAST_STATE)


def _first_of_spot(df: DataFrame) -> DataFrame:
    """The first of each name and spot of some fifty metres."""
    spot = [F.lower("n").alias("k"), F.floor(F.col("lat") * 2000 + 0.5).alias("i"), F.floor(F.col("lng") * 2000 + 0.5).alias("j")]
    first = df.groupBy(*spot).agg(F.min_by(F.struct(*df.columns), "seq").alias("r"))
    return first.select("r.*")


_PUBLIC = "(access IS NULL OR access NOT IN ('private','no'))"


def _spot() -> dict[str, Column]:
    return {"lat": at("y"), "lng": at("x")}


SECTIONS = {
    s.name: s
    for s in (
        Section(
            "state_extra", ("state_property",), "AV_LEGEND IN (" + ",".join(f"'{k}'" for k in STATE_LAND) + ")", ("PROPERTY", "AV_LEGEND", "ACRE_GIS"),
            lambda: attr("AV_LEGEND").isin(*STATE_LAND) & named("PROPERTY").isNotNull(),
            lambda: {"n": attr("PROPERTY"), "t": attr("AV_LEGEND"), "a": F.floor(number("ACRE_GIS") + 0.5), **_spot()}, _best_of_name,
        ),
        Section(
            "boats", ("launches_trailered", "launches_carried"), "1=1", ("ACCSS_NAME", "PROPERTY", "ACCSS_TOWN", "WATERBODY", "TRAILER", "CARRY_IN", "HANDICAP", "LINK"),
            lambda: F.coalesce(named("ACCSS_NAME"), named("PROPERTY")).isNotNull(),
            lambda: {"n": F.coalesce(named("ACCSS_NAME"), attr("PROPERTY")), "town": F.coalesce(attr("ACCSS_TOWN"), F.lit("")), "w": F.coalesce(attr("WATERBODY"), F.lit("")), "trailer": attr("TRAILER"), "carry": attr("CARRY_IN"), "hc": attr("HANDICAP"), "url": attr("LINK"), **_spot()},
            _first_of_spot, True,
        ),
        Section(
            "agency_land", ("agency_land",), "1=1", ("CATEGORY", "FACILITY", "CLASS", "COUNTY", "ACRES", "URL"),
            lambda: (F.trim(attr("FACILITY")) != "") & (F.coalesce(F.trim(attr("CATEGORY")), F.lit("")) != "ADMINISTRATIVE"),
            lambda: {"n": F.trim(attr("FACILITY")), "cat": F.coalesce(F.trim(attr("CATEGORY")), F.lit("")), "cls": F.when((F.trim(attr("CLASS")) != "") & ~F.trim(attr("CLASS")).isin(*NO_CLASS), F.trim(attr("CLASS"))), "a": F.when(number("ACRES") != 0, F.floor(number("ACRES") + 0.5)), "county": named("COUNTY"), "url": F.when(F.trim(attr("URL")).startswith("http"), F.trim(attr("URL"))), **_spot()},
        ),
        Section(
            "town_parks", ("leisure",), f"leisure='park' AND name IS NOT NULL AND {_PUBLIC}", ("name", "access", "website", "Shape__Area"),
            lambda: (attr("leisure") == "park") & named("name").isNotNull() & allowed(SHUT),
            lambda: {"n": attr("name"), **_spot(), "a": F.when(acres(number("Shape__Area"), at("y")) >= 1, acres(number("Shape__Area"), at("y"))), "w": web("website")},
        ),
        Section(
            "landuse", ("landuse",), "landuse IN (" + ",".join(f"'{k}'" for k in GROUNDS) + f") AND name IS NOT NULL AND {_PUBLIC}", ("name", "landuse", "operator", "Shape__Area"),
            lambda: attr("landuse").isin(*GROUNDS) & named("name").isNotNull() & allowed(SHUT),
            lambda: {"n": attr("name"), "k": attr("landuse"), "op": F.coalesce(attr("operator"), F.lit("")), "a": acres(number("Shape__Area"), at("y")), **_spot()},
        ),
        Section(
            "preserves", ("leisure",), f"leisure='nature_reserve' AND {_PUBLIC}", ("name", "operator", "website", "Shape__Area"),
            lambda: (attr("leisure") == "nature_reserve") & allowed(SHUT),
            lambda: {"n": F.coalesce(attr("name"), F.lit("")), "op": F.coalesce(attr("operator"), F.lit("")), "w": web("website"), **_spot()},
        ),
        Section(
            "cemeteries", ("landuse",), f"landuse='cemetery' AND name IS NOT NULL AND {_PUBLIC}", ("name", "website", "Shape__Area"),
            lambda: (attr("landuse") == "cemetery") & named("name").isNotNull() & allowed(SHUT),
            lambda: {"n": attr("name"), "w": web("website"), **_spot()},
        ),
        Section(
            "museums", ("tourism",), "tourism='museum' AND name IS NOT NULL AND historic IS NOT NULL", ("name", "historic", "operator", "website"),
            lambda: (attr("tourism") == "museum") & named("name").isNotNull() & attr("historic").isNotNull(),
            lambda: {"n": attr("name"), "h": attr("historic"), "op": F.coalesce(attr("operator"), F.lit("")), "w": web("website"), **_spot()}, point=True,
        ),
        Section(
            "facilities", ("leisure",), "leisure IN (" + ",".join(f"'{k}'" for k in FACILITIES) + f") AND {_PUBLIC}", ("leisure", "sport"),
            lambda: attr("leisure").isin(*FACILITIES) & allowed(SHUT),
            lambda: {**_spot(), "leisure": attr("leisure"), "sport": F.coalesce(attr("sport"), F.lit(""))},
        ),
        Section(
            "parking", ("pois",), "amenity='parking' AND (access IS NULL OR access NOT IN (" + ",".join(f"'{k}'" for k in SHUT_PARKING) + "))", ("OBJECTID",),
            lambda: (attr("amenity") == "parking") & allowed(SHUT_PARKING), lambda: _spot(), point=True,
        ),
        Section(
            "water", ("water",), "name IS NOT NULL", ("name", "Shape__Area", "water", "waterway"),
            lambda: named("name").isNotNull() & (_water() >= LEAST_WATER),
            lambda: {**_spot(), "name": attr("name"), "radius": F.floor(F.sqrt(_water() / F.pi()) + 0.5), "kind": F.lower(F.coalesce(named("water"), named("waterway"), F.lit("")))},
        ),
        Section(
            "protected", ("protected",), "Unit_Nm<>'Unknown' AND Pub_Access<>'XA'", ("Unit_Nm", "Own_Name", "Mang_Name", "Pub_Access", "Des_Tp", "GIS_Acres"),
            lambda: named("Unit_Nm").isNotNull() & (attr("Unit_Nm") != "Unknown") & (F.coalesce(attr("Pub_Access"), F.lit("UK")) != "XA") & (F.coalesce(attr("Own_Name"), F.lit("")) != "TRIB") & (F.coalesce(attr("Mang_Name"), F.lit("")) != "TRIB"),
            lambda: {"n": F.trim(attr("Unit_Nm")), "own": F.coalesce(named("Own_Name"), F.lit("UNK")), "acc": F.coalesce(named("Pub_Access"), F.lit("UK")), "des": F.coalesce(attr("Des_Tp"), F.lit("")), "a": F.floor(number("GIS_Acres") + 0.5), **_spot()},
        ),
    )
}

# Layers that are kept whole, with the attributes that ride along.
LAYERS = {
    "stateland": ("state_property", "1=1", ("AV_LEGEND", "PROPERTY", "ACRE_GIS")),
    "townparks": ("leisure", f"leisure='park' AND {_PUBLIC}", ("name", "operator", "access")),
    "preserves": ("leisure", f"leisure='nature_reserve' AND {_PUBLIC}", ("name", "operator", "access")),
    "cemeteries": ("landuse", f"landuse='cemetery' AND {_PUBLIC}", ("name", "operator")),
    "landuse": ("landuse", "landuse IN (" + ",".join(f"'{k}'" for k in GROUNDS) + f") AND {_PUBLIC}", ("name", "landuse", "operator")),
    "protected": ("protected", "1=1", ("Unit_Nm", "Own_Name", "Mang_Name", "Pub_Access", "Des_Tp", "GIS_Acres")),
    "agency": ("agency_land", "CATEGORY <> 'ADMINISTRATIVE'", ("FACILITY", "CATEGORY", "ACRES")),
    "trails": ("trails", "highway IN ('path','track','bridleway')", ("name", "highway", "surface", "access")),
}


def _water() -> Column:
    k = F.cos(F.radians(at("y")))
    return number("Shape__Area") * k * k


def rows_of(raw: DataFrame, section: str) -> DataFrame:
    """The rows of a section, made of raw features; features without a place go."""
    s = SECTIONS[section]
    placed = raw.where(at("y").isNotNull() & at("x").isNotNull() & s.keep())
    made = placed.select("seq", *[c.alias(n) for n, c in s.columns().items()])
    return s.after(made).drop("seq")


def fetch(spark: SparkSession, read: Callable[[str, Section], DataFrame], names: list[str] | None = None, last: Callable[[str], DataFrame | None] = lambda _: None) -> tuple[dict[str, DataFrame], list[str]]:
    """All sections (or some), each from the layers it names, and the names of those that came from the last run.

    ``read(layer, section)`` gives raw features. A layer of several may fail; a section whose every layer fails takes what
    ``last`` has of it, and raises where that is nothing: no section is silently empty.
    """
    out, stale = {}, []
    for name in names or SECTIONS:
        s, parts, failure = SECTIONS[name], [], None
        for layer in s.layers:
            try:
                part = read(layer, s)
                part.limit(1).count()
                parts.append(part)
            except Exception as e:  # a service may fail in any way
                failure = e
        if parts:
            raw = parts[0]
            for more in parts[1:]:
                raw = raw.unionByName(more)
            out[name] = rows_of(raw, name)
            continue
        before = last(name)
        if before is None:
            raise RuntimeError(f"{name}: no layer answers, and there is nothing of the last run") from failure
        out[name] = before
        stale.append(name)
    return out, stale
