"""Fields that no configured pattern has found: a table of general patterns over a document's whole text.

All rules are column expressions. Rewrites that fit a single known document are left out; names of places, wards and
addresses that are looked up in the text are the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import indic_digits, strip

# Patterns of fields, and characters that are cut off the ends of values.
_TITLED = (
    r"(?:\b(?:Mrs?|Miss|Dr|Sri|Smt|Sir[\s/|]*Smt|Shri)\.?\s+|ಶ್ರೀ/ಶ್ರೀಮತಿ|ಶ್ರೀ|ಶ್ರೀಮತಿ)[A-Za-zಀ-೿\s.,&]{3,40}?"
    r"(?=\s*(?:ರವರ|ರವರಿಗೆ|ಇವರ|ದಾಖಲಾಗಿರುತ್ತದೆ|ದಾಖಲಾಗ|Bangalore|Bengaluru|in\s*the\s*register|\n|$))"
)
_OWNED = r"([A-Za-zಀ-೿\s.,&]{3,40}?)\s*(?:ರವರ\s*ಹೆಸರಿನಲ್ಲಿ|ರವರ\s*ಹೆಸಂನಳ|ರವರಿಗೆ|ಇವರ\s*ಹೆಸರಿನಲ್ಲಿ)"
_PROPERTY = (
    r"\b([0-9]{2,4}-[0-9]{2,4}-[0-9]{2,4}(?:/[a-zA-Z0-9]+)?)\b",
    r"(?:PID|Property\s*No|Khata\s*No|ಆಸ್ತಿ\s*ಸಂಖ್ಯೆ|ಖಾತಾ\s*ನಂ)[\s:.-]*([A-Za-z0-9/\-.]+)",
    r"\b([0-9]{2,4}/[0-9]{2,4}/[A-Za-z0-9\-]+)\b",
)
_SURVEY = r"(?:Survey\s*(?:Number|No|Num)|ಸವee\s*ಸoui|ಸರ್ವೆ\s*(?:ನಂ|ನಂಬರ್|ಸಂಖ್ಯೆ)?|ಸಮೀಕ್ಷೆ\s*ಸಂಖ್ಯೆ|ಸ\.ನಂ|ಸೈಬ್ವೇ[\s\-_]*ನಂಬರ್)[\s:.\-_|I]*([0-9a-zA-Z/\-.\s]+?)(?=\s*(?:\n|Site|ಸೈಟ್|Plot|ನಿವೇಶನ|$))"
_SITE = r"(?:Site\s*Area|ನಿವೇಶನದ\s*ವಿಸ್ತೀರ್ಣ|ನವೇಶನದ\s*ಏ೯ೀಣ೯|ಸೈಟ್\s*ಎಣ)[\s:.\-_|I]*([0-9೦-೯]+(?:\.[0-9೦-೯]+)*)"
_BUILT = r"(?:Built-?up\s*Area|ಕಟ್ಟಡದ\s*ವಿಸ್ತೀರ್ಣ|ಕಟಡದ\s*ಎನೀಣ೯|2ದ-ತ\s*aೃದe|Plinth\s*Area)[\s:.\-_|I]*([0-9೦-೯]+(?:\.[0-9೦-೯]+)*)"
_WARD = r"(?:Ward|ವಾರ್ಡ್|ವಾಡ್s)\s*(?:No|Number|Name|ಸಂಖ್ಯೆ|ಸoag)?[\s:.\-_|I]*([A-Za-z0-9\-\s]+?)(?=\s*(?:,|\n|$|Sub|Zone|Hobli|ಕೋರಮಂಗಲ|S\.T\.))"
_LOCALITY = r"(?:Locality|ಸಳಸಳೀಯಹೆಸರು|ಸ್ಥಳೀಯ\s*ಹೆಸರು|ಬಡಾವಣೆ)[\s:.\-_|I]*([A-Za-z0-9ಀ-೿\s,.\-]+?)(?=\s*(?:\n|Hobli|ಹೋಬಳಿ|Taluk|ತಾಲೂಕು|Ward|ವಾಡ್|$))"
_TALUK = r"(?:Taluk|ತಾಲೂಕು|ತಾಲ್ಲೂಕು|ತಾಲೂಕ್)[\s:.\-_|I]*([A-Za-z0-9ಀ-೿\s,.\-]+?)(?=\s*(?:\n|District|ಜಿಲ್ಲೆ|Hobli|ಹೋಬಳಿ|$))"
_DISTRICT = r"(?:District|ಜಿಲ್ಲೆ|ಬಲೈ)[\s:.\-_|I]*([A-Za-z0-9ಀ-೿\s,.\-]+?)(?=\s*(?:\n|Property|ಅಸಯ|$))"
_DATED = r"(?:Date|Dated|ದಿನಾಂಕ|ದಿನಾ೦ಕ|ದನಾ0ಕ|ಎನಾ೦ಕ|ಎನಾಂಕ)[\s:.\-_|I]*([0-9]{1,2}(?:[\s\-_.:/]+[0-9]{1,2}){2}(?:[0-9]{2})?)"
_DATE = r"\b([0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})\b"
_NO_NAME = ("kannada", "english", "document")
_NO_DISTRICT = ("bbmp", "ward")
DISTRICT_CUES = {"Bengaluru Urban": ("urban", "bengaluru urban", "bangalore urban"), "Bengaluru": ("bangalore", "bengaluru", "ಬೆಂಗಳೂರು", "ಬೆಂಗಳೂದು", "bbmp", "bruhat")}


def _first(text: Column, pattern: str, group: int = 1, flags: str = "iuU") -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, f"(?{flags}){pattern}", group), F.lit(""))


def _cut(x: Column, chars: str) -> Column:
    return F.regexp_replace(F.regexp_replace(x, f"^[{chars}]+", ""), f"[{chars}]+$", "")


def _long(x: Column, n: int) -> Column:
    return F.when(F.length(x) >= n, x)


def _listed(low: Column, names: dict[str, str]) -> tuple[Column, Column]:
    """The first name (any case) that the text holds, and what it is called."""
    held = [F.contains(low, F.lit(k.lower())) for k in names]
    pick = lambda values: F.coalesce(F.lit(None).cast("string"), *[F.when(h, F.lit(v)) for h, v in zip(held, values, strict=True)])
    return pick([*names]), pick([*names.values()])


def general_fields(documents: DataFrame, text: str = "full_text", lines: str = "lines", localities: dict[str, str] | None = None, taluks: dict[str, str] | None = None, wards: dict[str, str] | None = None, addresses: dict[str, str] | None = None, document: str = "document_id") -> DataFrame:
    """field_name, raw_value, confidence, line_no, rule of each general field that the text shows.

    lines: array of struct(line_no, text, confidence) in order; a value's line is the first that holds it or one of its words
    of three letters or more, and gives its confidence. localities, taluks, wards, addresses: words to look for, with what they
    stand for, where no label names the field. land_area is the site's area, else the building's.
    """
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    ends = r" \t\n,.\-:|I"
    found: list[Column] = []

    def put(names: str, value: Column, probe: Column, default: float, rule: str, lined: bool = True) -> Column:
        """One struct for each name; null without a value."""
        holds = lambda x: F.contains(x, probe) | F.exists(F.filter(F.split(probe, r"\s+"), lambda w: F.length(w) > 2), lambda w: F.contains(x, w))
        line = F.get(F.filter(lines, lambda l: holds(l["text"])), F.lit(0)) if lined else F.lit(None).cast("struct<line_no:int,text:string,confidence:double>")
        one = lambda n: F.struct(F.lit(n).alias("field_name"), value.alias("raw_value"), F.coalesce(line["confidence"], F.lit(default)).alias("confidence"), line["line_no"].cast("int").alias("line_no"), F.lit(rule).alias("rule"))
        found.extend(F.when(value.isNotNull(), one(n)) for n in names.split())
        return F.when(value.isNotNull(), one(names.split()[0]))

    titled = strip(_first(t, f"({_TITLED})"))
    owned = _long(_cut(_first(t, _OWNED, flags="uU"), r" \t\n,.\-"), 3)
    owned = F.when(titled.isNull() & ~F.lower(owned).rlike("|".join(_NO_NAME)), owned)
    put("owner_name", titled, titled, 0.88, "semantic_titled_owner_name")
    put("owner_name", owned, owned, 0.85, "semantic_kannada_owner_phrase")

    numbers = [strip(_first(t, p)) for p in _PROPERTY]
    number = F.coalesce(*[F.when((F.length(n) >= 4) & ~n.startswith("202"), n) for n in numbers])
    put("khatauni_number", number, number, 0.85, "semantic_property_khata_number")

    raw = _cut(_first(t, _SURVEY), r" \t\n.\-/:|I")
    survey = indic_digits(raw)
    for misread in (r"([0-9]+)1[sS3]$", r"([0-9]+)/[sS3]$", r"([0-9]+)\.[sS3]$"):
        survey = F.regexp_replace(survey, misread, "$1/3")
    survey = F.nullif(_cut(F.regexp_replace(survey, r"[\s\-_]+", "/"), "/"), F.lit(""))
    put("khasra_number survey_number", survey, raw, 0.90, "semantic_survey_number")

    areas = []
    for name, pattern in (("site_area", _SITE), ("built_up_area", _BUILT)):
        size = strip(indic_digits(_first(t, pattern)))
        areas.append(put(name, F.concat(size, F.lit(" Sq Ft")), size, 0.90, f"semantic_{name}"))
    found.append(F.coalesce(*[F.when(a.isNotNull(), F.struct(F.lit("land_area").alias("field_name"), a["raw_value"].alias("raw_value"), a["confidence"].alias("confidence"), a["line_no"].alias("line_no"), a["rule"].alias("rule"))) for a in areas]))

    said = _first(t, _WARD)
    ward = _long(_cut(said, ends), 2)
    put("ward", ward, ward, 0.88, "semantic_ward")
    _, known = _listed(low, wards or {})
    put("ward", F.when(said.isNull(), known), known, 0.90, "semantic_ward_lookup", lined=False)

    for names, pattern, places, rule in (("locality village", _LOCALITY, localities, "semantic_locality"), ("taluk tehsil sub_division", _TALUK, taluks, "semantic_taluk")):
        place = _long(_cut(_first(t, pattern), r" \t\n.\-:|I"), 2)
        put(names, place, place, 0.92, rule)
        word, called = _listed(low, places or {})
        put(names, F.when(place.isNull(), called), word, 0.88, rule)

    district = _long(_cut(_first(t, _DISTRICT), r" \t\n.\-:|I"), 2)
    district = F.when(~F.lower(district).isin(*_NO_DISTRICT), district)
    put("district", district, district, 0.94, "semantic_district_explicit")
    urban, city = (low.rlike("|".join(words)) for words in DISTRICT_CUES.values())
    for name, holds, default, rule in (("Bengaluru Urban", urban, 0.92, "semantic_district_urban"), ("Bengaluru", city & ~urban, 0.90, "semantic_district_bengaluru")):
        put("district", F.when(district.isNull() & holds, F.lit(name)), F.lit(name), default, rule, lined=False)

    day = strip(F.coalesce(_first(t, _DATED), _first(t, _DATE)))
    clean = _cut(F.regexp_replace(day, r"[\s\-_.:/]+", "-"), r"\-")
    clean = F.regexp_replace(clean, r"^([^-]*-[^-]*)-([0-9]{2})[0-9]?$", "$1-20$2")
    put("document_date date", clean, day, 0.90, "semantic_date")

    _, address = _listed(low, addresses or {})
    put("address", address, address, 0.88, "semantic_address", lined=False)
    return documents.select(document, F.explode(F.array_compact(F.array(*found))).alias("f")).select(document, "f.*")
