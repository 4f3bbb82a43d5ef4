"""Text columns: digits, clean-up, names, places, parcel identifiers, edit distances, digests.

All but the Unicode normalizers are built-in expressions; those are Arrow UDFs, as Spark has no such function.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First code points of the decimal digits of Devanagari, Kannada, Tamil, Telugu, Bengali and Gujarati.
DIGIT_ZEROS = (0x0966, 0x0CE6, 0x0BE6, 0x0C66, 0x09E6, 0x0AE6)
_FROM = "".join(chr(z + d) for z in DIGIT_ZEROS[:5] for d in range(10))
_TO = "0123456789" * 5
_FROM2 = "".join(chr(z + d) for z in DIGIT_ZEROS[:2] for d in range(10))

# Titles before a name, words after it, and labels before places and parcel numbers.
TITLES = "श्रीमान|श्रीमती|सुश्री|श्री|ಶ್ರೀ|ಶ್ರೀಮತಿ|ತಿರು|திருமதி|स्व०|स्वर्गवासी|मर्हूम|जनाब|shri|smt|mr|mrs|miss|late|dr"
NAME_TAILS = r"ರವರ\s*ಹೆಸರಿನಲ್ಲಿ|ರವರ|ರವರಿಗೆ|ಇವರ|ದಾಖಲಾಗಿರುತ್ತದೆ|in\s*the\s*register|Bangalore|Bengaluru"
LOCALITY_LABELS = r"Locality|ಸಳಸಳೀಯಹೆಸರು|ಸ್ಥಳೀಯ\s*ಹೆಸರು|ಬಡಾವಣೆ|Village|ಗ್ರಾಮ"
TALUK_LABELS = r"Taluk|ತಾಲೂಕು|ತಾಲ್ಲೂಕು|ತಾಲೂಕ್|Sub\s*Division|ಉಪ\s*ವಿಭಾಗ|ಉಪಏಭಾಗ"
DISTRICT_LABELS = "District|ಜಿಲ್ಲೆ|ಬಲೈ"
PARCEL_LABELS = r"Survey[\s\-_/]*(?:Number|No|Num)?|Sy\.?[\s\-_/]*No\.?|ಸರ್ವೆ[\s\-_/]*(?:ನಂ|ನಂಬರ್)?|ಸವee[\s\-_/]*ಸoui"
LOCALITIES = {
    "ಜಯನಗರ": "Jayanagar",
    "ಕೋರಮಂಗಲ": "Koramangala",
    "ನಾರಾಯಣಘಟ್ಟ": "Narayanaghatta",
    "ಕೆಂಗೇರಿ": "Kengeri",
    "ಇಜಿಪುರ": "Ejipura",
    "ಮಲ್ಲೇಶ್ವರಂ": "Malleshwaram",
    "ಇಂದಿರಾನಗರ": "Indiranagar",
    "ಬಸವನಗುಡಿ": "Basavanagudi",
    "ಯಲಹಂಕ": "Yelahanka",
    "ರಾಜಾಜಿನಗರ": "Rajajinagar",
    "ಮಹಾದೇವಪುರ": "Mahadevapura",
}
TALUKS = {
    "ಜಯನಗರಿಉಪಏಭಾಗ": "Jayanagar Sub-division",
    "ಜಯನಗರ ಉಪವಿಭಾಗ": "Jayanagar Sub-division",
    "ಜಯನಗರ ಉಪ-ವಿಭಾಗ": "Jayanagar Sub-division",
    "ಕೋರಮಂಗಲ ಉಪವಿಭಾಗ": "Koramangala Sub-division",
    "ಬೆಂಗಳೂರು ದಕ್ಷಿಣ": "Bangalore South",
}
DISTRICTS = {"ಬೆಂಗಳೂದು": "Bengaluru", "ಬೆಂಗಳೂರು": "Bengaluru"}
LANGUAGES = {"kn": "kannada", "kan": "kannada", "hi": "hindi", "hin": "hindi", "ta": "tamil", "tam": "tamil", "te": "telugu", "tel": "telugu", "en": "english", "eng": "english"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at both ends (trim() takes blanks only)."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"^[\s ]+", ""), r"[\s ]+$", "")


def collapse(x: Column | str) -> Column:
    """strip(), and one blank for every run of white space."""
    return strip(F.regexp_replace(_c(x), r"\s+", " "))


def tokens(x: Column | str) -> Column:
    """Words between white space; none for a blank text."""
    return F.filter(F.split(strip(x), r"\s+"), lambda t: t != "")


def lookup(values: dict[str, str], x: Column) -> Column:
    """The value for x, or x itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), x), x)


def indic_digits(x: Column | str) -> Column:
    """Digits of five scripts as ASCII, and the Kannada anusvara next to a digit as 0."""
    near = F.regexp_replace(_c(x), "(?<=[0-9೦-೯])ಂ|ಂ(?=[0-9೦-೯])", "0")
    return F.translate(near, _FROM, _TO)


def plain_digits(x: Column | str) -> Column:
    """Digits of Devanagari and Kannada as ASCII."""
    return F.translate(_c(x), _FROM2, _TO[:20])


def _normalizer(form: str):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return run


def nfc(x: Column | str) -> Column:
    return _normalizer("NFC")(_c(x))


def nfkc(x: Column | str) -> Column:
    return _normalizer("NFKC")(_c(x))


def clean_ocr(x: Column | str) -> Column:
    """NFKC, no joiners or byte order marks, a visarga before a blank or digit as colon, single blanks."""
    out = F.regexp_replace(nfkc(x), "[‌‍﻿]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"ः(?=\s|\d)", ":"), "[ \t]+", " ")
    return F.coalesce(strip(out), F.lit(""))


def semantic_normalize(x: Column | str) -> Column:
    """struct(raw, normalized, changed): NFC, plain quotes, dashes and ellipses, blanks, digits."""
    raw = _c(x)
    out = F.translate(nfc(raw), "‘’‚“”„–—−", "'''\"\"\"---")
    out = plain_digits(collapse(F.replace(out, F.lit("…"), F.lit("..."))))
    return F.struct(raw.alias("raw"), out.alias("normalized"), (~raw.eqNullSafe(out)).alias("changed"))


def kannada_normalize(x: Column | str) -> Column:
    """struct(normalized, rules): NFC, isolated zero-width marks gone, white space; rules names what changed it."""
    raw = _c(x)
    a = nfc(raw)
    b = F.regexp_replace(a, "(?<![ಀ-೿])[‌‍]|[‌‍](?![ಀ-೿])", "")
    c = collapse(b)
    rules = F.array_compact(F.array(F.when(a != raw, "nfc"), F.when(b != a, "zero_width"), F.when(c != b, "whitespace")))
    return F.struct(c.alias("normalized"), rules.alias("rules"))


def manifest_text(x: Column | str) -> Column:
    """NFC without white space at the ends."""
    return strip(nfc(x))


def person_name(x: Column | str) -> Column:
    """A name without one title, circled digits, parentheses, trailing register words and punctuation."""
    out = F.regexp_replace(strip(x), rf"(?iu)^(?:{TITLES})\.?\s+", "")
    out = F.regexp_replace(out, r"[①②③④⑤⑥⑦⑧⑨⑩()]", "")
    out = F.regexp_replace(out, rf"(?iu)(?:\s*(?:{NAME_TAILS}))+$", "")
    return F.coalesce(collapse(F.regexp_replace(out, r"[/\-:,.]+$", "")), F.lit(""))


def _place(x: Column | str, labels: str, known: dict[str, str]) -> Column:
    out = F.regexp_replace(strip(x), rf"(?iu)^(?:{labels})[\s:.\-_|I]*", "")
    out = F.regexp_replace(F.regexp_replace(out, r"^[ \t\n,.\-:|I]+", ""), r"[ \t\n,.\-:|I]+$", "")
    return F.coalesce(lookup(known, out), F.lit(""))


def locality(x: Column | str) -> Column:
    """X08."""
    return _place(x, LOCALITY_LABELS, LOCALITIES)


def taluk(x: Column | str) -> Column:
    return _place(x, TALUK_LABELS, TALUKS)


def district(x: Column | str) -> Column:
    return _place(x, DISTRICT_LABELS, DISTRICTS)


def parcel_id(x: Column | str) -> Column:
    """Label gone, ASCII digits, hyphens as slashes; a bare slash and letter after the number go, any other rest stays."""
    text = strip(indic_digits(F.regexp_replace(strip(x), rf"(?iu)^(?:{PARCEL_LABELS})[\s:.\-_|I]*", "")))
    ward = F.upper(text).contains("W.NO") | F.upper(text).contains("WARD")
    from_digit = F.regexp_replace(text, "^[^0-9]+(?=[0-9])", "")
    core = F.regexp_extract(from_digit, "^([0-9]+(?:[/-][0-9]+)*)", 1)
    rest = strip(F.substring(from_digit, F.length(core) + 1, F.length(from_digit)))
    slashes = lambda c: F.regexp_replace(c, r"\s*/\s*", "/")
    out = (
        F.when(ward, collapse(text))
        .when(~text.rlike("[0-9]"), text)
        .when((rest != "") & ~rest.rlike("^[/-][A-Za-z]$"), slashes(from_digit))
        .otherwise(F.regexp_replace(core, r"\s*[/-]\s*", "/"))
    )
    return F.coalesce(out, F.lit(""))


def after_anchor(line: Column | str, anchor: Column | str, others: list[str]) -> Column:
    """X11: what stands after the anchor (any case) up to the first other anchor."""
    line, anchor = _c(line), _c(anchor)
    at = F.position(F.lower(anchor), F.lower(line))
    rest = F.when(at > 0, F.substring(line, at + F.length(anchor), F.length(line)))
    cuts = F.filter(F.array(*[F.position(F.lit(o.lower()), F.lower(rest)) for o in others]), lambda p: p > 0) if others else F.array().cast("array<int>")
    cut = F.array_min(cuts)
    return F.regexp_replace(strip(F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(rest)), r"^[\s:=\-.]+", "")


def inline_value(x: Column | str) -> Column:
    """What follows the first colon, else equals sign, else hyphen; null without any."""
    x = _c(x)
    found = [F.regexp_extract(x, f"^[^{s}]*{s}(.*)$", 1) for s in (":", "=", "\\-")]
    return F.nullif(strip(F.coalesce(*[F.nullif(f, F.lit("")) for f in found])), F.lit(""))


def script_is_kannada(x: Column | str) -> Column:
    """X32."""
    return F.coalesce(_c(x).rlike("[\\u0C80-\\u0CFF]"), F.lit(False))


def cer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Edit distance over the reference's length; an empty reference gives 0 for an empty hypothesis, else 1."""
    r, h = _c(reference), _c(hypothesis)
    return F.when(F.length(r) == 0, F.when(F.length(h) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, h) / F.length(r))


@F.pandas_udf(T.IntegerType())
def _word_distance(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    def one(r: str | None, h: str | None) -> int | None:
        if r is None or h is None:
            return None
        names: dict[str, int] = {}
        a, b = (np.array([names.setdefault(w, len(names)) for w in x.split()], np.int64) for x in (r, h))
        row = at = np.arange(len(b) + 1)
        for i, w in enumerate(a, 1):  # one row of the table; insertions by a running minimum
            best = np.append(i, np.minimum(row[1:] + 1, row[:-1] + (b != w)))
            row = np.minimum.accumulate(best - at) + at
        return int(row[-1])

    return pd.Series([one(r, h) for r, h in zip(reference, hypothesis, strict=True)], dtype="Int32")


def word_distance(reference: Column | str, hypothesis: Column | str) -> Column:
    """X20 over words between white space. Spark's levenshtein() counts letters, so this is an Arrow UDF."""
    return _word_distance(_c(reference), _c(hypothesis))


def wer(reference: Column | str, hypothesis: Column | str) -> Column:
    n = F.size(tokens(reference))
    return F.when(n == 0, F.when(F.size(tokens(hypothesis)) == 0, 0.0).otherwise(1.0)).otherwise(word_distance(reference, hypothesis) / n)


def capped_cer(reference: Column | str, hypothesis: Column | str) -> Column:
    """Stripped, at most 1."""
    return F.least(F.lit(1.0), cer(strip(reference), strip(hypothesis)))


def normalized_distance(a: Column | str, b: Column | str) -> Column:
    """Edit distance over the longer length; 0 for two empty texts."""
    a, b = _c(a), _c(b)
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 0.0).otherwise(F.levenshtein(a, b) / most)


def sha256(x: Column | str) -> Column:
    """X24."""
    return F.sha2(_c(x).cast("binary"), 256)


def fingerprint(x: Column | str) -> Column:
    """The first 16 hex digits of the SHA-256 of the NFC text without white space at its ends."""
    return F.left(sha256(nfc(strip(x))), F.lit(16))


def file_name(x: Column | str) -> Column:
    """The last part of a path with letters, digits, dot, hyphen and underscore only."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(_c(x), r"([^/\\]*)$", 1), r"[^A-Za-z0-9._\-]", "_"), F.lit("")), F.lit("unnamed"))


def language(x: Column | str, default: str = "kannada") -> Column:
    """X36."""
    return lookup(LANGUAGES, F.coalesce(F.nullif(F.lower(strip(x)), F.lit("")), F.lit(default)))


def squeezed(x: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(x), r"[\s,._\-/:]", ""))


def fuzzy_match(predicted: Column | str, expected: Column | str) -> Column:
    """Equal without punctuation, or one within the other when both have three letters or more."""
    p, e = squeezed(predicted), squeezed(expected)
    return F.coalesce((p == e) | ((F.length(p) >= 3) & (F.length(e) >= 3) & (F.contains(p, e) | F.contains(e, p))), F.lit(False))


def has_content(x: Column | str) -> Column:
    """a letter or digit of any script besides punctuation."""
    return F.coalesce(_c(x).rlike(r"[\p{L}\p{N}]"), F.lit(False))


def is_repetitive(x: Column | str, share: float = 0.4) -> Column:
    """at least three words, one of which makes up more than share of them."""
    t = tokens(x)
    most = F.array_max(F.transform(F.array_distinct(t), lambda w: F.size(F.filter(t, lambda v: v == w))))
    return (F.size(t) >= 3) & (most / F.size(t) > share)


def latin_words(predicted: Column | str, truth: Column | str) -> Column:
    """Latin letters in the prediction when the truth has none."""
    return F.when(_c(truth).rlike("[A-Za-z]"), 0).otherwise(F.regexp_count(_c(predicted), F.lit("[A-Za-z]")))


def set_f1(a: Column | str, b: Column | str) -> Column:
    """F1 of the sets of characters."""
    x, y = (F.array_distinct(F.filter(F.split(_c(c), ""), lambda ch: ch != "")) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def fold_replace(x: Column | str, glossary: dict[str, str]) -> Column:
    """Replaces glossary terms, longest first."""
    out = _c(x)
    for k in sorted(glossary, key=lambda k: (-len(k), k)):
        out = F.replace(out, F.lit(k), F.lit(glossary[k]))
    return out
