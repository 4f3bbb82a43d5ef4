"""Field rules, domain checks and checks across the fields and tables of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import dates, units
from recordloom.functions.text import _c, indic_digits, strip, tokens

YEAR_LIKE = r"^(?:19|20)[0-9]{2}$"
# Words in a table's header that name its columns.
AREA_HEADERS = ("area", "रकबा", "क्षेत्रफल", "rakba", "क्षेत्र")
SHARE_HEADERS = ("share", "अंश", "हिस्सा", "भाग")
PARCEL_HEADERS = ("khasra", "खसरा", "गाटा", "plot", "survey")


def _say(status: str, reason: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))


def _blank(x: Column) -> Column:
    return x.isNull() | (strip(x) == "")


def survey_number(x: Column | str) -> Column:
    """struct(status, reason)."""
    x = _c(x)
    return (
        F.when(_blank(x), _say("INVALID", "Survey number value is empty"))
        .when(strip(x).rlike(r"^[1-9][0-9]{0,4}(?:[/_\-.][0-9A-Za-z+\-_]+)*$"), _say("VALID", "Valid cadastral survey number format"))
        .when(~x.rlike(r"\p{Nd}"), _say("INVALID", "Survey number contains no numeric digits"))
        .otherwise(_say("WARNING", "Non-standard cadastral survey number format; officer inspection recommended"))
    )


def khata_number(x: Column | str) -> Column:
    x = _c(x)
    return (
        F.when(_blank(x), _say("INVALID", "Khata number value is empty"))
        .when(strip(x).rlike(r"^(?:[1-9][0-9]{0,5}[A-Za-z]?|[A-Za-z]{1,3}[-_/]?[0-9]{1,5})$"), _say("VALID", "Valid khata number format"))
        .when(x.rlike(r"\p{Nd}"), _say("WARNING", "Non-standard khata number format"))
        .otherwise(_say("INVALID", "Khata number contains no digits"))
    )


def extent(x: Column | str) -> Column:
    """Acres and guntas; 40 guntas or more are an acre, so they are a warning."""
    x = _c(x)
    unit = "(?:ಎಕರೆ|ಗುಂಟೆ|acres?|guntas?|hec|ha)?"
    fits = strip(x).rlike(rf"(?iu)^(?:[0-9]{{1,4}}[-\s.:][0-9]{{1,2}}(?:[-\s.:][0-9]{{1,2}})?|[0-9]{{1,4}}(?:\.[0-9]{{1,4}})?|[0-9]{{1,4}}\s*(?:ಎಕರೆ|acres?)\s*[0-9]{{1,2}}\s*(?:ಗುಂಟೆ|guntas?))\s*{unit}$")
    guntas = F.get(F.split(strip(x), r"[-\s.:]"), F.lit(1)).try_cast("int")
    over = F.struct(F.lit("WARNING").alias("status"), F.concat(F.lit("Gunta value "), guntas.cast("string"), F.lit(" >= 40 (1 acre = 40 guntas)")).alias("reason"))
    return (
        F.when(_blank(x), _say("INVALID", "Extent value is empty"))
        .when(fits & (guntas >= 40), over)
        .when(fits, _say("VALID", "Valid land measurement extent format"))
        .otherwise(_say("WARNING", "Non-standard extent measurement format"))
    )


def name_or_place(x: Column | str, kind: str = "name") -> Column:
    x, title = _c(x), kind.replace("_", " ").title()
    letters = F.length(F.regexp_replace(x, r"\P{L}", ""))
    return F.when(_blank(x), _say("INVALID", f"{title} is empty")).when(letters < 2, _say("INVALID", f"{title} contains insufficient alphabetic characters")).otherwise(_say("VALID", f"{title} format plausible"))


def hissa_number(x: Column | str) -> Column:
    x = _c(x)
    return F.when(_blank(x), _say("INVALID", "Hissa number value is empty")).when(strip(x).rlike(r"^[0-9A-Za-z+\-_/]+$"), _say("VALID", "Valid hissa number format")).otherwise(_say("WARNING", "Non-standard hissa number format"))


def mutation_number(x: Column | str) -> Column:
    x = _c(x)
    return F.when(_blank(x), _say("INVALID", "Mutation number value is empty")).when(x.rlike(r"\p{Nd}"), _say("VALID", "Valid mutation record identifier")).otherwise(_say("WARNING", "Mutation number lacks numeric digits"))


def grounding(value: Column | str, source: Column | str, texts: Column | str) -> Column:
    """own_region, other_region, tokens or none: where the value's words stand."""
    value, source, texts = strip(value), _c(source), _c(texts)
    words = F.array_distinct(F.flatten(F.transform(texts, lambda t: tokens(t))))
    return (
        F.when(F.coalesce(source.contains(value), F.lit(False)), "own_region")
        .when(F.exists(texts, lambda t: F.contains(t, value)), "other_region")
        .when((F.size(tokens(value)) > 0) & (F.size(F.array_except(tokens(value), words)) == 0), "tokens")
        .otherwise("none")
    )


def field_verdict(name: Column | str, value: Column | str, grounded: Column | str | None = None) -> Column:
    """the check that the field's name asks for; a valid value that stands nowhere in the text becomes a warning."""
    name, value = _c(name), _c(value)
    found = (
        F.when(name.isin("survey_number", "khasra_number"), survey_number(value))
        .when(name == "hissa_number", hissa_number(value))
        .when(name.isin("khata_number", "khatauni_number"), khata_number(value))
        .when(name == "mutation_number", mutation_number(value))
        .when(name.endswith("date"), dates.verdict(value))
        .when(name.isin("extent", "land_area", "site_area"), extent(value))
        .otherwise(name_or_place(value, "value"))
    )
    if grounded is None:
        return found
    lost = (found["status"] == "VALID") & (_c(grounded) == "none")
    return F.when(lost, F.struct(F.lit("WARNING").alias("status"), F.lit("Value not grounded in recognized text").alias("reason"))).otherwise(found)


def missing_required(documents: DataFrame, fields: DataFrame, required: DataFrame, key: str = "document_id") -> DataFrame:
    """(document, field_name) of each required field that is absent or blank.

    required has a row for each field of a state's configuration, so it is small; documents x required
    is the result's own size before the anti join.
    """
    wanted = documents.select(key, "state").join(required.select("state", "field_name"), "state")
    present = fields.where(~_blank(F.col("raw_value"))).select(key, "field_name").distinct()
    return wanted.join(present, [key, "field_name"], "left_anti").select(key, "field_name", F.lit("required").alias("rule"), F.lit("error").alias("severity"))


def rule_items(fields: DataFrame, rules: DataFrame, key: str = "document_id") -> DataFrame:
    """violations of the rules joined by state and field name: min, max, pattern (as a prefix), min_length, max_length, date.

    rules: state, field_name, min, max, pattern, min_length, max_length, is_date. Patterns are compared by
    regexp functions on the joined column, so any number of rules is one pass.
    """
    f = fields.join(rules, ["state", "field_name"])
    value = F.coalesce(F.col("normalized_value"), F.col("raw_value"))
    number = value.try_cast("double")
    bounded = F.col("min").isNotNull() | F.col("max").isNotNull()
    item = lambda when, rule, severity: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    items = F.array_compact(
        F.array(
            item(bounded & number.isNull(), "numeric_type", "error"),
            item(number < F.col("min"), "min", "error"),
            item(number > F.col("max"), "max", "error"),
            item(F.col("pattern").isNotNull() & ~F.regexp(value, F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")"))), "pattern", "error"),
            item(F.coalesce(F.col("is_date"), F.lit(False)) & ~dates.is_calendar_date(value), "calendar_date", "error"),
            item(F.length(value) < F.col("min_length"), "min_length", "warning"),
            item(F.length(value) > F.col("max_length"), "max_length", "warning"),
        )
    )
    return f.select(key, "field_name", F.explode(items).alias("i")).select(key, "field_name", "i.*")


def worst(severity: Column | str) -> Column:
    """A07, as an aggregate: invalid with any error, warning with any warning, else valid."""
    s = _c(severity)
    return F.when(F.coalesce(F.bool_or(s == "error"), F.lit(False)), "invalid").when(F.coalesce(F.bool_or(s == "warning"), F.lit(False)), "warning").otherwise("valid")


def _cells(tables: DataFrame, words: tuple[str, ...], key: str) -> DataFrame:
    """Cells under headers that hold one of the words, in reading order."""
    named = F.filter(F.transform("headers", lambda h, i: F.struct(F.lower(h).alias("h"), i.alias("i"))), lambda x: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x["h"], w)))
    rows = tables.select(key, "headers", F.posexplode("rows").alias("row_no", "cells")).withColumn("c", F.explode(named))
    return rows.select(key, "row_no", F.col("c.i").alias("column_no"), F.get("cells", F.col("c.i")).alias("cell")).where("cell is not null")


def table_area_sums(tables: DataFrame, key: str = "document_id") -> DataFrame:
    """The sum of the first numbers of all area cells."""
    return _cells(tables, AREA_HEADERS, key).groupBy(key).agg(F.bround(F.coalesce(F.sum(units.magnitude("cell")), F.lit(0.0)), 6).alias("table_area"))


def share_of(cell: Column | str) -> Column:
    """A fraction a/b or a number; null for neither."""
    x = strip(cell)
    a, b = F.regexp_extract(x, "^([0-9]+)/([0-9]+)$", 1).try_cast("double"), F.regexp_extract(x, "^([0-9]+)/([0-9]+)$", 2).try_cast("double")
    return F.when(x.contains("/"), F.when(b > 0, a / b)).otherwise(units.magnitude(x))


def owner_share_sums(tables: DataFrame, key: str = "document_id") -> DataFrame:
    """The sum of shares; null where no cell holds one."""
    return _cells(tables, SHARE_HEADERS, key).groupBy(key).agg(F.sum(share_of("cell")).alias("share_sum"))


def table_parcels(tables: DataFrame, key: str = "document_id") -> DataFrame:
    """Parcel numbers in reading order."""
    found = _cells(tables, PARCEL_HEADERS, key).withColumn("cell", strip(indic_digits("cell"))).where("cell != ''")
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "column_no", "cell"))), lambda x: x["cell"]).alias("parcels"))


def sum_matches(header: Column | str, total: Column | str, percent: float = 5.0) -> Column:
    """Whether total is within percent of header; null unless both are above 0."""
    h, t = _c(header), _c(total)
    return F.when((h > 0) & (t > 0), F.abs(h - t) / h * 100.0 <= percent)


def shares_match(total: Column | str) -> Column:
    t = _c(total)
    return t.between(0.98, 1.02) | t.between(98.0, 102.0)


def cross_record(records: DataFrame, tables: DataFrame, key: str = "document_id") -> DataFrame:
    """One row for each record (land_area, site_area, built_up_area, survey_number, khata_number, record_date, khasra_number):
    three-state results and the inconsistencies found. khasra_count_matches is true wherever the tables name parcels;
    khasra_in_tables says whether the record's own is among them."""
    out = records
    for sums in (table_area_sums(tables, key), owner_share_sums(tables, key), table_parcels(tables, key)):
        out = out.join(sums, key, "left")
    out = out.withColumn("area_sum_matches", sum_matches("land_area", "table_area")).withColumn("share_sum_matches", shares_match("share_sum"))
    own = F.col("khasra_number")
    out = out.withColumn("khasra_count_matches", F.when(own.isNotNull() & (F.size("parcels") > 0), True))
    out = out.withColumn("khasra_in_tables", F.when(own.isNotNull() & (F.size("parcels") > 0), F.exists("parcels", lambda p: F.contains(p, own))))
    site, built = units.magnitude(F.coalesce("site_area", F.col("land_area").cast("string"))), units.magnitude("built_up_area")
    day, month = (F.date_format(dates.parse("record_date"), f).try_cast("int") for f in ("d", "M"))
    number = F.col("survey_number").try_cast("int")
    found = F.array_compact(
        F.array(
            F.when(~F.col("area_sum_matches"), "area_sum"),
            F.when(~F.col("share_sum_matches"), "share_sum"),
            F.when(F.col("record_date").isNotNull() & ~dates.is_calendar_date("record_date"), "record_date"),
            F.when((site > 0) & (built > site), "site_area"),
            F.when(F.col("survey_number").rlike(YEAR_LIKE), "survey_number_is_year"),
            F.when(F.col("khata_number").rlike(YEAR_LIKE), "khata_number_is_year"),
            F.when((number == day) | (number == month), "survey_number_is_date_part"),
        )
    )
    return out.withColumn("inconsistencies", found).withColumn("passed", F.size("inconsistencies") == 0)
