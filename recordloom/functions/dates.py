"""Date and era columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import _c, indic_digits, strip

#: Order matters: the first format that parses wins.
FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d", "d MMM yyyy", "d MMMM yyyy")


def parse(x: Column | str, formats: tuple[str, ...] = FORMATS) -> Column:
    """The date in the first format that fits; null if none does."""
    x = strip(indic_digits(x))
    return F.coalesce(*[F.try_to_date(x, f) for f in formats])


def normalize(x: Column | str) -> Column:
    """ISO text, or the text itself (ASCII digits, stripped) if it is no date; null for an empty one."""
    clean = strip(indic_digits(x))
    return F.when(_c(x) == "", None).otherwise(F.coalesce(F.date_format(parse(x), "yyyy-MM-dd"), clean))


def is_calendar_date(x: Column | str) -> Column:
    """A date of the years 1900 to 2099 in one of the first five formats."""
    d = parse(x, FORMATS[:5])
    return F.coalesce(F.year(d).between(1900, 2099), F.lit(False))


def verdict(x: Column | str) -> Column:
    """struct(status, reason) for d/m/y and y/m/d with / - or ., years 1800 to 2100."""
    x = strip(x)
    sep = r"[/\-.]"
    dmy, ymd = rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{4}})$", rf"^(\d{{4}}){sep}(\d{{1,2}}){sep}(\d{{1,2}})$"
    part = lambda p, i: F.regexp_extract(x, p, i).try_cast("int")
    first = x.rlike(dmy)
    y, m, d = (F.when(first, part(dmy, a)).otherwise(part(ymd, b)) for a, b in ((3, 1), (2, 2), (1, 3)))
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    say = lambda status, *reason: F.struct(F.lit(status).alias("status"), F.concat(*[r if isinstance(r, Column) else F.lit(r) for r in reason]).alias("reason"))
    return (
        F.when(x.isNull() | (x == ""), say("INVALID", "Date value is empty"))
        .when(~(first | x.rlike(ymd)), say("WARNING", "Unrecognized date format; manual verification required"))
        .when(~y.between(1800, 2100), say("INVALID", "Date year ", y.cast("string"), " is outside plausible range [1800, 2100]"))
        .when(~m.between(1, 12), say("INVALID", "Impossible calendar month: ", m.cast("string"), " (must be 1-12)"))
        .when(date.isNull(), say("INVALID", "Impossible calendar date"))
        .otherwise(say("VALID", "Valid calendar date (", F.date_format(date, "yyyy-MM-dd"), ")"))
    )


def fasli_start(x: Column | str) -> Column:
    """The first four digits as a Fasli year, in Gregorian years (592 later); null without any."""
    return F.regexp_extract(indic_digits(x), "([0-9]{4})", 1).try_cast("int") + 592


def repair_year(x: Column | str) -> Column:
    """Years of two digits, and of three that begin with 0 or 2, as 20yy."""
    x = _c(x)
    return F.when(F.length(x) == 2, F.concat(F.lit("20"), x)).when(F.length(x) == 3, F.concat(F.lit("20"), F.right(x, F.lit(2)))).otherwise(x)
