"""Small operators on records: point filters, regions and evidence, engine answers, summaries, and tables as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions.text import _c, plain_digits, strip
from recordloom.operators.confidence import token_mean, token_min

# ------------------------------------------------------------------ filters


def corrections(rows: DataFrame, document: str | None = None, language: str | None = None, limit: int | None = None, order: str = "line_no") -> DataFrame:
    """corrections of a document (exact) and language (any case), the first in file order; unreadable rows (null ids) are left out."""
    out = rows.where(F.col("document_id").isNotNull())
    if document:
        out = out.where(F.col("document_id") == document)
    if language:
        out = out.where(F.lower("language") == language.lower())
    return out.orderBy(order).limit(limit) if limit else out


def unpromoted(rows: DataFrame) -> DataFrame:
    """F05."""
    return rows.where(~F.coalesce("is_promoted", F.lit(False)))


def point(rows: DataFrame, **keys) -> DataFrame:
    """the rows with these values, as by id, by hash, or by document and field name."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows


def overlay_tier(confidence: Column | str, needs_review: Column | str) -> Column:
    """LOW for what needs a review, has no confidence or less than 0.60; HIGH from 0.85; else MEDIUM."""
    c = _c(confidence)
    return F.when(F.coalesce(_c(needs_review), F.lit(False)) | c.isNull() | (c < 0.60), "LOW").when(c >= 0.85, "HIGH").otherwise("MEDIUM")


def overlay_engine(handwritten: Column | str, recognizer: Column | str) -> Column:
    """F19, by engine: HANDWRITTEN or PRINTED."""
    name = F.lower(F.coalesce(_c(recognizer), F.lit("")))
    return F.when(F.coalesce(_c(handwritten), F.lit(False)) | name.contains("trocr") | name.contains("iitb"), "HANDWRITTEN").otherwise("PRINTED")


# ------------------------------------------------------------------ regions and evidence


def regions(rows: DataFrame, document: str = "document_id", order: str = "ordinal", language: str = "kannada", script: str = "Kannada", handwritten: bool | None = None) -> DataFrame:
    """Regions with the defaults of their page: ids region_001, ... by their place, language, script, handwriting."""
    place = F.row_number().over(Window.partitionBy(document).orderBy(order))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.withColumns({"region_id": F.coalesce(blank("region_id"), F.format_string("region_%03d", place)), "language": F.coalesce(blank("language"), F.lit(language)), "script": F.coalesce(blank("script"), F.lit(script)), "is_handwritten": F.coalesce("is_handwritten", F.lit(handwritten).cast("boolean"))})


def lines_and_writing(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every region as a line, and the handwritten ones as handwriting as well."""
    return rows, rows.where(F.coalesce("is_handwritten", F.lit(False)))


def region_of_value(fields: DataFrame, regions_: DataFrame, document: str = "document_id", order: str = "ordinal") -> DataFrame:
    """Fields with the region they name, else the first region of their document that holds the raw value; null without one."""
    by_id = regions_.select(document, F.col("region_id").alias("source_region_id"), F.lit(True).alias("_named"))
    own = fields.join(by_id, [document, "source_region_id"], "left")
    known = own.where("_named").drop("_named")
    rest = own.where("_named is null").drop("_named")
    pairs = rest.select(document, "field_name", "raw_value").distinct().join(regions_.select(document, "region_id", order, F.col("text").alias("_t")), document).where(F.contains("_t", "raw_value"))
    first = pairs.groupBy(document, "field_name", "raw_value").agg(F.min_by("region_id", order).alias("_r"))
    found = rest.join(first, [document, "field_name", "raw_value"], "left").withColumn("source_region_id", F.col("_r")).drop("_r")
    return known.select(*fields.columns).unionByName(found.select(*fields.columns))


def evidence(page, box, raw_text, engine=None, rule=None, source=None, written=None, notes=None) -> Column:
    """P10: where a value comes from, with the usual engine and rule where none is given."""
    text = lambda c: F.lit(None).cast("string") if c is None else _c(c)
    return F.struct(
        _c(page).alias("page_number"), _c(box).alias("bbox"), _c(raw_text).alias("raw_ocr_text"), text(written).alias("handwriting_text"),
        F.coalesce(text(engine), F.lit("paddleocr")).alias("ocr_engine"), F.coalesce(text(rule), F.lit("regex_default")).alias("extraction_rule_id"),
        text(source).alias("source_record"), F.coalesce(F.lit(None).cast("array<string>") if notes is None else _c(notes), F.array().cast("array<string>")).alias("validation_notes"),
    )


def with_note(notes: Column | str, note: Column | str) -> Column:
    """A note at the end of a list that does not hold it yet."""
    n = _c(notes)
    return F.when(F.array_contains(n, _c(note)), n).otherwise(F.array_append(F.coalesce(n, F.array().cast("array<string>")), _c(note)))


def audit(probabilities: Column | str, method: str = "token_mean") -> Column:
    """How a confidence was found; least and mean only where there are probabilities."""
    p = _c(probabilities)
    return F.struct(F.lit(method).alias("calculation_method"), F.when(p.isNotNull(), F.size(p)).alias("token_count"), F.coalesce(F.size(p) > 0, F.lit(False)).alias("has_token_probabilities"), token_min(p).alias("min_token_confidence"), token_mean(p).alias("mean_token_confidence"))


# ------------------------------------------------------------------ values


def entity_value(name: Column | str, value: Column | str) -> Column:
    """Survey and khata numbers with digits, slashes and hyphens only; areas with ASCII digits; other values stripped."""
    v = strip(value)
    digits = plain_digits(v)
    return F.when(_c(name).isin("survey_number", "khata_number"), F.regexp_replace(digits, r"[^\p{Nd}/\-]", "")).when(_c(name) == "extent_area", digits).otherwise(v)


def ordered_unique(items: Column | str) -> Column:
    """U07."""
    return F.array_distinct(_c(items))


def by_key(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The values of each key in order."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("items"))


def batch_name(at: Column | str) -> Column:
    """batch_YYYYMMDD of a time; iso_time() writes it in ISO form. The session's zone counts, UTC by agreement."""
    return F.concat(F.lit("batch_"), F.date_format(_c(at), "yyyyMMdd"))


def iso_time(at: Column | str | None = None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else _c(at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


# The fields that an engine's answer may hold by name.
ANSWER_FIELDS = (
    "district", "taluk", "hobli", "village", "survey_number", "hissa_number", "khata_number", "owner_name", "cultivator_name", "extent", "land_type", "mutation_number",
    "registration_number", "record_date",
)
_VALUE = "struct<field_name:string,raw_value:string,normalized_value:string,source_region_id:string,model_confidence:double>"


def engine_answer(answer: Column | str, default_type: str) -> Column:
    """struct(status, document_type, fields) of an engine's JSON, which may stand between code fences.

    fields: the known ones, then extra_fields (a list or an object); of one name the last counts; blank values are none.
    What is no JSON object gives status error and no fields.
    """
    text = strip(F.regexp_replace(F.regexp_replace(strip(answer), "^```(?:json)?", ""), "```$", ""))
    top = F.from_json(text, "map<string,string>")
    value = lambda name, v: F.struct(
        name.alias("name"), strip(v["raw_value"]).alias("raw_value"), strip(F.coalesce(F.nullif(v["normalized_value"], F.lit("")), v["raw_value"])).alias("normalized_value"), v["source_region_id"].alias("source_region_id"), v["model_confidence"].alias("model_confidence")
    )
    own = [value(F.lit(k), F.from_json(F.try_element_at(top, F.lit(k)), _VALUE)) for k in ANSWER_FIELDS]
    extra = F.try_element_at(top, F.lit("extra_fields"))
    listed = F.transform(F.from_json(extra, f"array<{_VALUE}>"), lambda v: value(v["field_name"], v))
    keyed = F.transform(F.map_entries(F.from_json(extra, f"map<string,{_VALUE}>")), lambda e: value(e["key"], e["value"]))
    more = F.when(extra.startswith("["), listed).when(extra.startswith("{"), keyed)
    all_ = F.filter(F.concat(F.array(*own), F.coalesce(more, F.slice(F.array(*own), 1, 0))), lambda x: F.coalesce(F.length(x["name"]) > 0, F.lit(False)) & F.coalesce(F.length(x["raw_value"]) > 0, F.lit(False)))
    last = F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda y: y["name"] == x["name"]))
    fine = top.isNotNull() & text.startswith("{")
    return F.struct(
        F.when(fine, "success").otherwise("error").alias("status"),
        F.coalesce(F.when(fine, F.nullif(F.try_element_at(top, F.lit("document_type")), F.lit(""))), F.lit(default_type)).alias("document_type"),
        F.when(fine, last).otherwise(F.slice(last, 1, 0)).alias("fields"),
    )


# ------------------------------------------------------------------ summaries


def semantic_summary(fields: DataFrame, document: str = "document_id") -> DataFrame:
    """Numbers of valid, warning and invalid fields, mean confidence (two places, 0 without any), and whether a person must look."""
    n = lambda s: F.count_if(F.lower("validation_status") == s)
    out = fields.groupBy(document).agg(F.count(F.lit(1)).alias("total"), n("valid").alias("valid"), n("warning").alias("warning"), n("invalid").alias("invalid"), F.coalesce(F.bround(F.avg("confidence"), 2), F.lit(0.0)).alias("confidence"))
    return out.withColumn("overall_valid", (F.col("invalid") == 0) & (F.col("total") > 0)).withColumn("needs_review", (F.col("invalid") > 0) | (F.col("warning") > 0) | (F.col("confidence") < 0.70))


def engine_counts(regions_: DataFrame, engine: str = "engine") -> DataFrame:
    """Regions of each engine."""
    return regions_.groupBy(engine).agg(F.count(F.lit(1)).alias("n"))


def stage_times(timings: DataFrame, document: str = "document_id") -> DataFrame:
    """Each document's seconds by stage, summed."""
    return timings.groupBy(document).agg(F.sum("seconds").alias("seconds"), F.count_distinct("stage").alias("n_stages"))


# ------------------------------------------------------------------ tables as JSON


def save_json(rows: DataFrame, path: str) -> None:
    """A review queue, a provenance manifest or calibration parameters as JSON lines, with null fields kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same back, with the schema they were written with."""
    return spark.read.schema(schema).json(path)
