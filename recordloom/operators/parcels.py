"""Parcel lookup: exact by five keys, then by parts of names, and the verdict on area and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import geometry, units

KEYS = ("state", "district", "tehsil", "village", "khasra_number")
AREA_PERCENT = 10.0


def registry(features: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Parcels with upper-case keys; aliases of the parcel number are further keys, and of equal keys the last loaded counts.

    features: the five keys, area_hectares, gis_layer_name, aliases, ring, load_ord.
    """
    rows = features if extra is None else features.unionByName(extra)
    numbers = F.array_distinct(F.concat(F.array("khasra_number"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = rows.withColumn("khasra_number", F.explode(numbers))
    for k in KEYS:
        rows = rows.withColumn(k, F.upper(F.coalesce(F.col(k), F.lit("UNKNOWN"))))
    rest = [c for c in rows.columns if c not in KEYS]
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "load_ord").alias("p")).select(*KEYS, "p.*")


def lookup(records: DataFrame, parcels: DataFrame, key: str = "document_id") -> DataFrame:
    """Each record's parcel by all keys; records without one look again by state and number where a part
    of the village's or district's name agrees, first in loading order. Adds parcel (struct) and matched_by."""
    rest = [c for c in parcels.columns if c not in KEYS]
    upper = records
    for k in KEYS:
        upper = upper.withColumn(f"_{k}", F.upper(F.coalesce(F.col(k), F.lit(""))))
    side = parcels.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.struct(*KEYS, *rest).alias("parcel"))
    exact = upper.join(side, [f"_{k}" for k in KEYS], "left")
    hit = exact.where("parcel is not null").withColumn("matched_by", F.lit("exact"))
    missed = exact.where("parcel is null").drop("parcel")
    near = parcels.select(F.col("state").alias("_state"), F.col("khasra_number").alias("_khasra_number"), F.col("village").alias("_v"), F.col("district").alias("_d"), F.struct(*KEYS, *rest).alias("candidate"))
    either = lambda a, b: (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    joined = missed.join(near, ["_state", "_khasra_number"], "left")
    agrees = either(F.col("_village"), F.col("_v")) | either(F.col("_district"), F.col("_d"))
    found = joined.where(agrees).groupBy(key).agg(F.min_by("candidate", F.col("candidate.load_ord")).alias("parcel"))
    rest_of = missed.join(found, key, "left").withColumn("matched_by", F.when(F.col("parcel").isNotNull(), "part"))
    out = hit.unionByName(rest_of)
    return out.drop(*[f"_{k}" for k in KEYS])


def verdict(looked_up: DataFrame, percent: float = AREA_PERCENT) -> DataFrame:
    """gis_status MATCH, MISMATCH, UNKNOWN or INSUFFICIENT_DATA, with the figures behind it.

    Columns of the record: the keys, area (hectares, may be null), lon, lat (may be null), parcel.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    poor = blank("khasra_number") | (blank("village") & blank("district"))
    area, base = F.col("area"), F.col("parcel.area_hectares")
    off = F.when(area > 0, units.deviation_percent(area, base))
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    inside = F.when(placed, geometry.contains(F.col("parcel.ring"), F.col("lon"), F.col("lat")))
    centre = geometry.centroid(F.col("parcel.ring"))
    out = looked_up.withColumns({"area_deviation_percent": F.bround(off, 2), "area_mismatch": F.coalesce(off > percent, F.lit(False)), "point_in_polygon": inside, "_centre": centre})
    away = F.when(placed, geometry.planar_metres(F.col("_centre.lon"), F.col("_centre.lat"), F.col("lon"), F.col("lat")))
    out = out.withColumn("spatial_deviation_meters", away).drop("_centre")
    status = (
        F.when(poor, "INSUFFICIENT_DATA").when(F.col("parcel").isNull(), "UNKNOWN").when(F.col("area_mismatch") | ~F.coalesce("point_in_polygon", F.lit(True)), "MISMATCH").otherwise("MATCH")
    )
    out = out.withColumn("gis_status", status)
    reasons: list[Column] = [
        F.when(F.col("gis_status") == "INSUFFICIENT_DATA", "identifiers missing"),
        F.when(F.col("gis_status") == "UNKNOWN", "parcel not in layer"),
        F.when((F.col("gis_status") == "MISMATCH") & F.col("area_mismatch"), "area differs"),
        F.when((F.col("gis_status") == "MISMATCH") & ~F.col("point_in_polygon"), "point outside"),
    ]
    return out.withColumn("flag_reasons", F.array_compact(F.array(*reasons)))
