"""Search, field lists and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import strip


def like(x: Column | str, q: str) -> Column:
    """q anywhere in x, any case; % and _ in q are wild cards."""
    return (F.col(x) if isinstance(x, str) else x).ilike(f"%{q}%")


def search(documents: DataFrame, fields: DataFrame, q: str, field_name: str | None = None, status: str | None = None, skip: int = 0, limit: int = 20, key: str = "id", name: str = "filename", order: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(page, total). A document matches by its name or by the value of a field (of that name, if given).

    page has matched_fields (array of struct(field_name, value)) and match_source; total has one row. The
    matching fields are found once, in one left join, both for the filter and for the page.
    """
    own = fields.where(like("normalized_value", q) | like("original_value", q))
    if field_name:
        own = own.where(F.col("field_name") == field_name)
    matched = own.groupBy(F.col("document_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("field_name", F.coalesce("normalized_value", "original_value").alias("value")))).alias("matched_fields"))
    rows = documents if status is None else documents.where(F.col("status") == status)
    by_name = F.lit(False) if field_name else F.coalesce(like(name, q), F.lit(False))
    found = rows.join(matched, key, "left").where(by_name | F.col("matched_fields").isNotNull())
    found = found.withColumn("match_source", F.when(by_name & F.col("matched_fields").isNotNull(), "both").when(by_name, "filename").otherwise("field"))
    return page(found, [F.desc(order), F.col(key)], skip, limit), found.agg(F.count(F.lit(1)).alias("total"))


def page(rows: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """The order must end with a unique key."""
    return rows.orderBy(*order).offset(skip).limit(limit)


def field_list(fields: DataFrame, min_confidence: float | None = None, field_name: str | None = None, contains: bool = False) -> DataFrame:
    """fields at or above a confidence, by exact name or (contains) by a part of it in any case."""
    out = fields
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    if field_name is not None:
        out = out.where(like("field_name", field_name) if contains else F.col("field_name") == field_name)
    return out


def mean_confidence(fields: DataFrame, places: int = 2, default: float = 0.0) -> DataFrame:
    """F02 (2 places, 0.0), F03 and A28 (4 places, 0.85): one row, also for no fields."""
    return fields.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bround(F.avg("confidence"), places), F.lit(default)).alias("average"))


def latest_by(rows: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The row with the largest order values of each key."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def wide_fields(fields: DataFrame, names: list[str], document: str = "document_id") -> DataFrame:
    """A column for each field, and for its English and Kannada values and status."""
    return fields.groupBy(document).pivot("field_name", names).agg(F.first("value").alias("value"), F.first("english").alias("english"), F.first("kannada").alias("kannada"), F.first("status").alias("translation_status"))


def with_aliases(fields: Column, aliases: dict[str, str]) -> Column:
    """A map with an alias for each field that has one and lacks the alias."""
    extra = F.map_filter(F.create_map(*[x for a, c in aliases.items() for x in (F.lit(a), F.try_element_at(fields, F.lit(c)))]), lambda k, v: v.isNotNull() & ~F.map_contains_key(fields, k))
    return F.map_concat(fields, extra)


# Names under which a response repeats a field.
RESPONSE_ALIASES = {"survey_number": "khasra_number", "property_number": "khatauni_number", "taluk": "tehsil", "date": "document_date"}


def merged_reasons(warnings: Column | str, reasons: Column | str) -> Column:
    """Both lists without blanks and repeats, in order."""
    w, r = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")) for c in (warnings, reasons))
    return F.array_distinct(F.filter(F.concat(w, r), lambda x: F.coalesce(x != "", F.lit(False))))


# The names of fields in the main schema, and names of other states with the field and the tradition they stand for.
MAIN_FIELDS = (
    "document_type", "district", "taluk", "hobli", "village", "survey_number", "hissa_number", "khata_number", "owner_name", "cultivator_name", "extent", "land_type",
    "assessment", "mutation_number", "registration_number", "record_date", "remarks",
)
REGIONAL_NAMES = {
    "Maharashtra": {
        "survey_number": ("gat_number", "gat_no", "gat"), "hissa_number": ("pot_hissa", "pothissa"), "owner_name": ("khatedar", "khatedar_name", "bhogwathdar", "occupant", "occupant_khatedar"),
        "extent": ("kshetra", "area_hec"), "assessment": ("aakar", "assessment_rs"), "taluk": ("taluka",), "district": ("jilha",), "village": ("gav",), "mutation_number": ("ferfar_number", "ferfar_no"),
    },
    "Tamil Nadu": {
        "khata_number": ("patta_number", "patta_no", "patta"), "survey_number": ("pula_en", "pula_number"), "hissa_number": ("sub_division", "utpirivu"), "owner_name": ("pattadharar", "pattadar_name"),
        "extent": ("parappalavu",), "taluk": ("vattam",), "district": ("maavattam",), "village": ("kiramam",),
    },
    "North India": {
        "survey_number": ("khasra_number", "khasra_no", "khasra"), "khata_number": ("khatauni_number", "khatauni_no", "khatauni"), "owner_name": ("bhumidhar",), "cultivator_name": ("kastakar",),
        "taluk": ("tehsil",), "village": ("mauza",), "extent": ("rakba",), "assessment": ("lagan",), "mutation_number": ("dakhil_kharij",),
    },
}


def canonical_field(name: Column | str, main: tuple[str, ...] = MAIN_FIELDS, regional: dict = REGIONAL_NAMES) -> Column:
    """struct(field, region): the main schema's name of a field, and the tradition its own name comes from (null: none)."""
    clean = F.replace(F.lower(strip(name)), F.lit(" "), F.lit("_"))
    pairs = [F.struct(F.lit(alias), F.struct(F.lit(field).alias("field"), F.lit(region).alias("region"))) for region, fields in regional.items() for field, own in fields.items() for alias in own if alias not in main]
    return F.coalesce(F.try_element_at(F.map_from_entries(F.array(*pairs)), clean), F.struct(clean.alias("field"), F.lit(None).cast("string").alias("region")))
