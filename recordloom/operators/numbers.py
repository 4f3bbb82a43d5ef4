"""Roles of the numbers in a text: passes in a fixed order, each of which leaves what an earlier one has taken.

The passes depend on one another through what has been taken, so a text is read in one piece by an Arrow function; texts
are independent of each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from recordloom.functions.text import _FROM, _TO

# Words and forms that name a role, units of areas, and words that tell a building's area from a plot's.
_DATE = "(?:Date|Dated|ದಿನಾಂಕ|ದಿನಾ೦ಕ|ದನಾ0ಕ|ಎನಾ೦ಕ|ಎನಾಂಕ|bನಾoಕ)"
_DATE_FORMS = (
    _DATE + r"[\s:.\-_|I]*([0-9]{1,2}\s*[-/._\s]+\s*[0-9]{1,2}\s*[-/._\s]+\s*[0-9]{2,4})",
    _DATE + r"[\s:.\-_|I]*([0-9]{4}\s*[-/._\s]+\s*[0-9]{1,2}\s*[-/._\s]+\s*[0-9]{1,2})",
    r"\b([0-9]{1,2}\s*[-/.]{1,3}\s*[0-9]{1,2}\s*[-/.]{1,3}\s*[0-9]{2,4})\b",
    r"\b([0-9]{4}\s*[-/.]{1,3}\s*[0-9]{1,2}\s*[-/.]{1,3}\s*[0-9]{1,2})\b",
)
_AREA_FORM = r"([0-9೦-೯]+(?:\.[0-9೦-೯]+)*)\s*((?:sa|sq|sg|sq\.)\.?\s*ft\.?|sqft|sq\.?\s*m\.?|sqm|ಚದರ\s*ಅಡಿ|ಚದರ\s*ಅಜ|ಚದರ\s*ಅa|gunta|ಗುಂಟೆ|acre|ಏಕರೆ|hectare|ಹೆಕ್ಟೇರ್)"
_BUILDING = ("ಕಟ್ಟಡದ ವಿಸ್ತೀರ್ಣ", "ಕಟ್ಟಡ ವಿಸ್ತೀರ್ಣ", "ಕಟಡದ ಎನೀಣ೯", "ಕಟಡದ", "built-up", "built up", "plinth", "plinth area")
_UNITS = {
    "Sq Ft": ("sq ft", "sa ft", "sg ft", "sq. ft.", "sq.ft", "sqft", "ಚದರ ಅಡಿ", "ಚದರ ಅಜ", "ಚದರ ಅa", "ಅಡಿ"),
    "sq m": ("sq m", "sq. m.", "sqm", "ಚದರ ಮೀಟರ್"),
    "gunta": ("gunta", "guntha", "ಗುಂಟೆ"),
    "acre": ("acre", "acres", "ಏಕರೆ"),
    "hectare": ("hectare", "हेक्टेयर", "ಹೆಕ್ಟೇರ್"),
}
_YEAR_FORM = r"\b(20\d{2}[-\/]\d{2,4})\b"
_WARD_FORM = r"(?:Ward|ವಾರ್ಡ್|ವಾಡ್s)\s*(?:No|Number|Name|ಸಂಖ್ಯೆ|ಸoag)?[\s:.\-_|I]*([A-Za-z0-9\-\s]+?)(?=\s*(?:,|\n|$|Sub|Zone|Hobli|ಕೋರಮಂಗಲ|S\.T\.))"
_KHATA_FORMS = (
    r"(?:PID|Property\s*No|Khata\s*(?:No|Number)|ಆಸ್ತಿ\s*ಸಂಖ್ಯೆ|ಖಾತಾ\s*(?:ನಂ|ಸಂಖ್ಯೆ)|ಸ್ವತ್ತಿನ\s*ಸಂಖ್ಯೆ|ಬಾತಾಸಂಭೈ)[\s:.\-_|I]*([A-Za-z0-9\/\-\.]+)",
    r"\b([0-9]{2,4}-[0-9]{2,4}-[0-9]{2,4}(?:\/[a-zA-Z0-9]+)?)\b",
    r"\b([0-9]{2,4}\/[0-9]{2,4}\/[A-Za-z0-9\-]+)\b",
)
_NO_KHATA = (r"\d{1,2}[-/.calendar]\d{1,2}[-/.calendar]\d{2,4}", r"(?:19|20)\d{2}")
_SURVEY_FORMS = (
    r"(?:(?:Survey\s*(?:Number|No|Num)|ಸವee\s*ಸoui|ಸರ್ವೆ\s*(?:ನಂ|ನಂಬರ್|ಸಂಖ್ಯೆ)|ಸೈಬ್ವೇ[\s\-_]*ನಂಬರ್)[\s:.\-_|I]*([0-9a-zA-Z\/\-\.\s]+?))(?=\s*(?:\n|Site|ಸೈಟ್|Plot|ನಿವೇಶನ|$))",
    r"(?:(?:ಸೈ|ಸರ್|ಸ[\.\s]*ನಂ|Sy|Surve|Survey)[^\s0-9]{0,12}[\s\-_.:]*(?:ನಂ[^\s0-9]{0,10}|Number|No|Num)?|ನಿವೇಶನ|ನವೇಶನ)[\s\-_.:]*([0-9೦-೯]+(?:\s*[\/\-]\s*[0-9೦-೯]+)*(?:\/[A-Za-z0-9]+)?)",
    r"\b([0-9೦-೯]+[\/][0-9೦-೯]+)\b",
)
_MISREAD_THREE = (r"(\d+)1[sS3]$", r"(\d+)/[sS3]$", r"(\d+)\.[sS3]$")
_REST_FORM = r"\b(\d+[\/\-]?\d*)\b"
_EDGES = " \t\n,.-:|I"
_OTHERS = frozenset(("date", "khata_number", "site_area", "built_up_area", "year"))
_DIGITS = str.maketrans(_FROM, _TO)


def _ascii(x: str) -> str:
    return re.sub("(?<=[0-9೦-೯])ಂ|ಂ(?=[0-9೦-೯])", "0", x).translate(_DIGITS)


@dataclass
class Number:
    token: str
    value: str
    role: str
    start: int
    unit: str | None = None


@dataclass
class Reading:
    """A text, the numbers found in it, and the strings that no later pass takes again."""

    text: str
    found: list[Number] = field(default_factory=list)
    seen: set[str] = field(default_factory=set)


def _date(m: re.Match, _: Reading) -> Number:
    token = m[1].strip()
    parts = re.sub(r"[\s\-_.:/]+", "-", token).strip("-").split("-")
    if len(parts) == 3 and len(parts[2]) in (2, 3):
        parts[2] = "20" + parts[2][:2]
    return Number(token, "-".join(parts), "date", m.start())


def _area(m: re.Match, r: Reading) -> Number:
    before = r.text[max(0, m.start() - 60) : m.start()].lower()
    said = m[2].strip().lower()
    unit = next((u for u, forms in _UNITS.items() if any(f in said for f in forms)), "Sq Ft")
    return Number(m[1].strip(), _ascii(m[1]).strip(), "built_up_area" if any(w in before for w in _BUILDING) else "site_area", m.start(), unit)


def _ward(m: re.Match, _: Reading) -> Number | None:
    token = m[1].strip(_EDGES)
    return Number(token, token, "ward", m.start()) if token else None


def _khata(m: re.Match, _: Reading) -> Number | None:
    token = m[1].strip(" \t\n.-/:|I")
    if len(token) < 2 or any(re.fullmatch(p, token) for p in _NO_KHATA):
        return None
    return Number(token, re.sub(r"\s*/\s*", "/", token), "khata_number", m.start())


def _survey(m: re.Match, r: Reading) -> Number | None:
    token = m[1].strip(" \t\n.-/:|I")
    value = _ascii(token)
    for form in _MISREAD_THREE:
        value = re.sub(form, r"\1/3", value)
    value = re.sub(r"[\s\-_]+", "/", value).strip("/")
    if not value or re.fullmatch(r"(?:19|20)\d{2}", value) or ("/" not in value and len(value) >= 4):
        return None
    within = lambda a, b: a in b or b in a
    if any(within(value, n.value) if n.role in _OTHERS else n.role == "survey_number" and within(token, n.token) for n in r.found):
        return None
    return Number(token, value, "survey_number", m.start())


def _as(role: str) -> Callable[[re.Match, Reading], Number]:
    return lambda m, _: Number(m[1].strip(), m[1].strip(), role, m.start())


@dataclass
class Pass:
    """forms: tried in order; read: a match as a number, or None; known, marks: what must not have been seen, and what will have been."""

    forms: tuple[str, ...]
    read: Callable[[re.Match, Reading], Number | None]
    known: str
    marks: tuple[str, ...]
    confidence: float
    reach: int = 30
    any_case: bool = True


PASSES = (
    Pass(_DATE_FORMS, _date, "token", ("token", "span"), 0.94),
    Pass((_AREA_FORM,), _area, "span", ("span",), 0.92, 40),
    Pass((_YEAR_FORM,), _as("year"), "token", ("token",), 0.90, any_case=False),
    Pass((_WARD_FORM,), _ward, "token", ("token", "span"), 0.92),
    Pass(_KHATA_FORMS, _khata, "token", ("token",), 0.91),
    Pass(_SURVEY_FORMS, _survey, "token", ("token", "value"), 0.92),
    Pass((_REST_FORM,), _as("unclassified"), "token", ("token",), 0.35, any_case=False),
)
_COMPILED = [(p, [re.compile(f, re.IGNORECASE if p.any_case else 0) for f in p.forms]) for p in PASSES]


def read_numbers(text: str) -> list[tuple]:
    """(token, value, role, unit, confidence, context) of each number, in the order of the passes."""
    r, out = Reading(text), []
    for p, forms in _COMPILED:
        for form in forms:
            for m in form.finditer(text):
                n = p.read(m, r)
                if n is None:
                    continue
                names = {"token": n.token, "span": m[0], "value": n.value}
                if names[p.known] in r.seen:
                    continue
                r.seen.update(names[k] for k in p.marks)
                r.found.append(n)
                out.append((n.token, n.value, n.role, n.unit, p.confidence, text[max(0, m.start() - p.reach) : m.end() + p.reach]))
    return out


def number_roles(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Every number of a text with its role: dates, areas of plots and buildings, years, wards, khata and survey numbers, and the rest."""
    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [(k, *n) for k, t in zip(pdf[key], pdf[text], strict=True) for n in read_numbers(t or "")]
            yield pd.DataFrame(found, columns=[key, "token", "value", "role", "unit", "confidence", "context"])

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, token string, value string, role string, unit string, confidence double, context string")
