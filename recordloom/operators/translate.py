"""Protection of verbatim parts, repair of recognized text, transliteration and the field ladder."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.text import _c, collapse, fold_replace, nfc, script_is_kannada, strip, tokens

#: Passes in order; what an earlier one has taken is out of reach for the later ones.
_VERBATIM = (
    ("EMAIL", r"[\w.+-]+@[\w-]+\.[\w.]+"),
    ("URL", r"https?://\S+"),
    ("DATE", r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b"),
    ("ACCOUNT", r"\b[A-Z]{1,4}[-/]\d[\w/-]*"),
    ("PARCEL", r"\b\d+(?:/\d+[A-Za-z]?)+\b"),
    ("MONEY", r"(?:₹|Rs\.?)\s*\d[\d,]*(?:\.\d+)?"),
    ("AREA", r"\b\d+(?:\.\d+)?\s*(?:sq\.?\s*ft|acres?|guntas?|hectares?)\b"),
    ("PHONE", r"\b\d{10}\b"),
    ("NUMBER", r"\b\d+(?:\.\d+)?\b"),
)
_PATTERN = re.compile("|".join(f"(?P<{n}>{p})" for n, p in _VERBATIM))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("parts", T.MapType(T.StringType(), T.StringType()))]))
def protect(s: pd.Series) -> pd.DataFrame:
    """Numbered place holders for what must not be translated, and what they stand for."""

    def one(t):
        if t is None:
            return None, None
        parts: dict[str, str] = {}

        def put(m: re.Match) -> str:
            name = f"[[{m.lastgroup}_{len(parts)}]]"
            parts[name] = m.group()
            return name

        return _PATTERN.sub(put, t), parts

    rows = [one(t) for t in s]
    return pd.DataFrame({"text": [r[0] for r in rows], "parts": [r[1] for r in rows]})


def restore(text: Column | str, parts: Column | str) -> Column:
    """The place holders' contents back in their places."""
    return F.aggregate(F.map_entries(_c(parts)), _c(text), lambda t, e: F.replace(t, e["key"], e["value"]))


def repair(text: Column | str, corrections: dict[str, str], noise: tuple[str, ...] = ()) -> Column:
    """Known misreadings, spacing around punctuation, and no lines that hold a noise word."""
    lines = F.split(fold_replace(text, corrections), "\n")
    if noise:
        lines = F.filter(lines, lambda x: ~F.exists(F.array(*[F.lit(n.lower()) for n in noise]), lambda n: F.contains(F.lower(x), n)))
    fixed = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(collapse(x), r"\s+([,.;:])", "$1"), r"([,;:])(?=[^\s\d])", "$1 "))
    return F.array_join(F.filter(fixed, lambda x: x != ""), "\n")


def polish(text: Column | str) -> Column:
    """Single blanks, no blank before punctuation, no repeated word, a capital at the start."""
    t = F.regexp_replace(collapse(text), r"\s+([,.;:!?])", "$1")
    t = F.regexp_replace(t, r"(?i)\b(\w+)(?:\s+\1\b)+", "$1")
    return F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, F.lit(2), F.length(t)))


def purity(kannada: Column | str, english: Column | str, allowed: tuple[str, ...] = ()) -> Column:
    """struct(latin, kannada, pure): the first five foreign words on each side."""
    latin = F.array_distinct(F.array_except(F.regexp_extract_all(_c(kannada), F.lit("([A-Za-z]{2,})"), F.lit(1)), F.array(*[F.lit(a) for a in allowed]).cast("array<string>")))
    other = F.array_distinct(F.regexp_extract_all(_c(english), F.lit("([ಀ-೿]+)"), F.lit(1)))
    return F.struct(F.slice(latin, 1, 5).alias("latin"), F.slice(other, 1, 5).alias("kannada"), ((F.size(latin) == 0) & (F.size(other) == 0)).alias("pure"))


def gate(confidence: Column | str) -> Column:
    """F25."""
    c = _c(confidence)
    return F.when(c.isNull() | (c < 0.60), "BLOCKED").when(c < 0.85, "FLAGGED").otherwise("COMPLETED")


def is_translated(text: Column | str) -> Column:
    """some letters, and fewer than a fifth of them Kannada."""
    t = F.coalesce(_c(text), F.lit(""))
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    return (letters > 0) & (F.regexp_count(t, F.lit("[ಀ-೿]")) / F.greatest(letters, F.lit(1)) < 0.20)


def failure_mode(text: Column | str, reference: Column | str) -> Column:
    """the first kind of failure that a translation shows against its reference."""
    t, r = F.coalesce(_c(text), F.lit("")), F.coalesce(_c(reference), F.lit(""))
    words, want = F.array_distinct(tokens(F.lower(t))), F.array_distinct(tokens(F.lower(r)))
    common = F.size(F.array_intersect(words, want)) / F.greatest(F.size(want), F.lit(1))
    return (
        F.when(F.contains(t, F.lit("[GATED_REPO")) | F.contains(t, F.lit("[LOAD_FAILED")), "MODEL_ACCESS_OR_LOAD_BLOCKED")
        .when(F.regexp_count(t, F.lit("[ಀ-೿]")) / F.greatest(F.length(t), F.lit(1)) > 0.30, "UNTRANSLATED_KANNADA_REMAINS")
        .when(F.length(t) < 5, "EMPTY_OR_TOO_SHORT")
        .when(common < 0.20, "WRONG_CONTENT_HALLUCINATED")
        .when(common < 0.50, "PARTIAL_TRANSLATION_MISSING_CONTENT")
        .otherwise("ACCEPTABLE")
    )


# Latin letters for Kannada consonants, vowels and signs, two short words, and fields that are never translated.
CONSONANTS = {
    "ಕ": "k", "ಖ": "kh", "ಗ": "g", "ಘ": "gh", "ಙ": "ng",
    "ಚ": "ch", "ಛ": "chh", "ಜ": "j", "ಝ": "jh", "ಞ": "ny",
    "ಟ": "t", "ಠ": "th", "ಡ": "d", "ಢ": "dh", "ಣ": "n",
    "ತ": "t", "ಥ": "th", "ದ": "d", "ಧ": "dh", "ನ": "n",
    "ಪ": "p", "ಫ": "ph", "ಬ": "b", "ಭ": "bh", "ಮ": "m",
    "ಯ": "y", "ರ": "r", "ಱ": "r", "ಲ": "l", "ವ": "v",
    "ಶ": "sh", "ಷ": "sh", "ಸ": "s", "ಹ": "h", "ಳ": "l",
}
VOWELS = {"ಅ": "a", "ಆ": "aa", "ಇ": "i", "ಈ": "ee", "ಉ": "u", "ಊ": "oo", "ಋ": "ru", "ಎ": "e", "ಏ": "e", "ಐ": "ai", "ಒ": "o", "ಓ": "o", "ಔ": "au"}
SIGNS = {"ಾ": "a", "ಿ": "i", "ೀ": "ee", "ು": "u", "ೂ": "oo", "ೃ": "ru", "ೆ": "e", "ೇ": "e", "ೈ": "ai", "ೊ": "o", "ೋ": "o", "ೌ": "au", "ಂ": "m", "ಃ": "h", "್": ""}
SHORT_WORDS = {"ಬಿನ್": "Bin", "ಬಿನ್:": "Bin", "ಕೋಂ": "Kom", "ಕೋಂ:": "Kom"}
NOT_TRANSLATED = (
    "survey_number", "hissa_number", "khata_number", "property_number", "mutation_number", "registration_number", "date", "document_date", "record_date", "total_extent",
    "cultivable_area", "pot_kharab", "site_area", "built_up_area", "land_revenue", "khasra_number", "khatauni_number", "patta_number", "gat_number",
)


def transliterate_word(word: str, known: dict[str, str] | None = None) -> str:
    """A word of the dictionary, else letter by letter.

    A consonant carries an a only before another letter than a sign; at the end of the word it carries none.
    """
    said = {**SHORT_WORDS, **(known or {})}.get(word)
    if said is not None:
        return said
    latin = {**CONSONANTS, **VOWELS, **SIGNS}
    out = [latin.get(c, c) + ("a" if c in CONSONANTS and after and after not in SIGNS else "") for c, after in zip(word, [*word[1:], ""], strict=True)]
    return "".join(out).capitalize()


def transliterate(x: Column | str, known: dict[str, str] | None = None) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: " ".join(transliterate_word(w, known) for w in t.split()), na_action="ignore")

    return run(_c(x))


def _said(v: Column, words: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in (words or {"": ""}).items() for x in kv]), v)


def translate_field(name: Column | str, value: Column | str, names: dict[str, str], places: dict[str, str], terms: dict[str, str]) -> Column:
    """struct(english, status, engine) of a field's value, by the first rule that holds:

    fields of NOT_TRANSLATED, empty values, values without Kannada letters, whole entries of names, places and terms,
    entries of places and terms within the value (longest first) if they leave no Kannada letter, transliteration.
    """
    v = F.coalesce(strip(value), F.lit(""))
    clean = strip(nfc(v))
    whole = F.coalesce(_said(clean, names), _said(clean, places), _said(clean, terms))
    parts = clean
    for words in (places, terms):
        for k in sorted(words, key=lambda w: -len(w)):
            parts = F.replace(parts, F.lit(k), F.lit(words[k]))
    titled = F.array_join(F.transform(tokens(parts), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")
    latin = transliterate(clean, {**places, **SHORT_WORDS, **names})
    s = lambda e, status, engine: F.struct((e if isinstance(e, Column) else F.lit(e).cast("string")).alias("english"), F.lit(status).alias("status"), F.lit(engine).alias("engine"))
    return (
        F.when(F.lower(strip(name)).isin(*NOT_TRANSLATED), s(None, "NOT_APPLICABLE", "passthrough"))
        .when(v == "", s(None, "UNAVAILABLE", "unavailable"))
        .when(~script_is_kannada(v), s(v, "ALREADY_ENGLISH", "passthrough"))
        .when(whole.isNotNull(), s(whole, "TRANSLATED", "domain_glossary"))
        .when(~script_is_kannada(parts), s(titled, "TRANSLATED", "domain_glossary"))
        .when(~script_is_kannada(latin) & (latin != ""), s(latin, "TRANSLATED", "phonetic"))
        .otherwise(s(None, "FAILED", "unavailable"))
    )
