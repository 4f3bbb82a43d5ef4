"""Areas and their units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import _c, indic_digits

# Hectares of one unit; of units named in a text the first of this list counts.
HECTARES = {
    "hectare": 1.0,
    "हेक्टेयर": 1.0,
    "हे": 1.0,
    "acre": 0.404686,
    "एकड़": 0.404686,
    "bigha": 0.2529,
    "बीघा": 0.2529,
    "biswa": 0.012645,
    "बिसवा": 0.012645,
    "guntha": 0.010117,
    "गुंठा": 0.010117,
    "sq_meter": 0.0001,
    "वर्ग मीटर": 0.0001,
}


def magnitude(x: Column | str) -> Column:
    """The first number in a text; null without any."""
    return F.regexp_extract(indic_digits(x), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def unit_in(x: Column | str, units: dict[str, float] = HECTARES) -> Column:
    """The first unit of the list that the text names."""
    low = F.lower(indic_digits(x))
    return F.coalesce(*[F.when(low.contains(u.lower()), u) for u in units])


def to_hectares(x: Column | str, unit: Column | str | None = None, units: dict[str, float] = HECTARES) -> Column:
    """The first number times its unit's hectares, six places; 0 without a number, factor 1 without a known unit."""
    own = unit_in(x, units) if unit is None else F.coalesce(F.nullif(_c(unit), F.lit("")), unit_in(x, units))
    factor = F.try_element_at(F.create_map(*[F.lit(v) for kv in units.items() for v in kv]), F.lower(F.trim(own)))
    return F.coalesce(F.bround(magnitude(x) * F.coalesce(factor, F.lit(1.0)), 6), F.lit(0.0))


def deviation_percent(value: Column | str, base: Column | str) -> Column:
    """How far value is off base, in percent of base; null for a base of 0."""
    return F.try_divide(F.abs(_c(value) - _c(base)) * 100.0, _c(base))
