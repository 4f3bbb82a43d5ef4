"""Fields from lines, tokens and tables: patterns, neighbours, precedence and reconciliation."""

from __future__ import annotations

import re
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.text import _c, has_content, inline_value, strip, tokens

BELOW_PX, RIGHT_PX, ROW_PX, COLUMN_PX = 120.0, 200.0, 12.0, 30.0
# Keyword lists of document types.
KEYWORDS = {
    "rtc": ("ಪಹಣಿ", "pahani", "ಭೂಮಿ", "rtc", "ಹಕ್ಕು ದಾಖಲೆ", "ಖಾತೆದಾರರ ವಿವರ", "ಸರ್ವೆ ನಂ", "ಸರ್ವೇ ನಂ", "survey no", "ಕಂದಾಯ", "ಹಿಸ್ಸಾ", "ಆರ್ ಟಿ ಸಿ", "ಹಿಡುವಳಿ", "ಸರ್ವೆ", "ಸರ್ವೇ", "ವಿಸ್ತೀರ್ಣ", "ಸರ್ವೆ ಸಂಖ್ಯೆ", "ಸರ್ವೇ ಸಂಖ್ಯೆ", "survey number"),
    "khata": ("ಖಾತಾ ಪ್ರಮಾಣ", "ಖಾತಾ ದೃಢೀಕರಣ", "khata certificate", "khata extract", "ಖಾತೆ", "ದೃಢೀಕರಣ ಪತ್ರ", "ಬೃಹತ್ ಬೆಂಗಳೂರು", "bbmp", "bruhat bangalore", "ಆಸ್ತಿ ಸಂಖ್ಯೆ", "ಸ್ವತ್ತಿನ ಸಂಖ್ಯೆ", "ನಿವೇಶನದ ವಿಸ್ತೀರ್ಣ", "ಕಟ್ಟಡದ ವಿಸ್ತೀರ್ಣ", "pid", "ಅಸೆಸ್ಮೆಂಟ್", "ಸಹಾಯಕ ಕಂದಾಯ ಅಧಿಕಾರಿ", "assistant revenue officer", "ಬಾತಾದಾಖಲೆ", "ಖಾತಾ"),
    "mutation": ("ಮ್ಯುಟೇಶನ್", "mutation", "ನಮೂನೆ ೧೨", "ನಮೂನೆ 12", "ಜಂಟಿ ಹಕ್ಕು", "ವಾರಸುದಾರರು", "ಹಕ್ಕು ಬದಲಾವಣೆ", "mutation register", "ಹಿಸ್ಸಾ ನಂ"),
    "other": ("ಕ್ರಯಪತ್ರ", "sale deed", "ದಾನಪತ್ರ", "gift deed", "ಭಾಗಪತ್ರ", "partition deed", "ನೋಂದಣಿ ಇಲಾಖೆ", "sub-registrar", "encumbrance certificate", "ಋಣಭಾರ ಪ್ರಮಾಣ", "tahsildar", "ತಹಶೀಲ್ದಾರ್", "order", "ಆದೇಶ", "ಸ್ವಾಧೀನ ಪತ್ರ"),
    "general": ("ಸರ್ವೆ ನಂಬರ್", "ಸರ್ವೇ ನಂಬರ್", "survey number", "khasra", "khatauni", "patta", "chitta", "satbara", "7/12", "jamabandi", "ವಿಸ್ತೀರ್ಣ", "extent", "ಚದರ ಅಡಿ", "sq ft", "sq. ft.", "acres", "guntas", "ಗುಂಟೆ", "village", "ಗ್ರಾಮ", "taluk", "ತಾಲೂಕು", "hobli", "ಹೋಬಳಿ", "district", "ಜಿಲ್ಲೆ", "land", "plot", "site", "revenue department", "ಕಂದಾಯ ಇಲಾಖೆ", "ಕಂದಾಯ"),
    "not_land": ("cash receipt", "tax invoice", "bill of supply", "table no", "server:", "cashier", "prescription", "patient name", "dr.", "curriculum vitae", "resume", "experience", "boarding pass", "flight ticket", "hotel booking", "restaurant menu"),
}
# Words and scripts that name a state, in the order in which they count.
STATES = (
    ("KA", r"ಕರ್ನಾಟಕ|karnataka|ಭೂಮಿ|ಪಹಣಿ|pahani|ಸರ್ವೆ ನಂ|ಖಾತೆದಾರ|ಬೆಂಗಳೂರು|bangalore|bengaluru|bbmp|mahanagara palike|khatha|ಪ್ರಮಾಣ ಪತ್ರ|mutation|rule 46|ಮ್ಯುಟೇಶನ್"),
    ("KA", r"[ಀ-೿]"),
    ("TN", r"[஀-௿]"),
    ("TN", "தமிழ்நாடு|tamil nadu|tamilnadu|பட்டா|patta|சிட்டா|chitta|புல எண்"),
    ("UP", "उत्तर प्रदेश|uttar pradesh|खातौनी|गाटा संख्या|भौमिक अधिकार|fasli"),
    ("MP", "मध्य प्रदेश|madhya pradesh|भू-अभिलेख|भूमिस्वामी|खसरा क्रमांक"),
    ("MH", r"महाराष्ट्र|maharashtra|सातबारा|satbara|भोगवटादार|गट क्रमांक|हे\.आर\."),
    ("BR", "बिहार|bihar|जमाबंदी|खतियान|रैयत का नाम|खेसरा संख्या"),
)


def hits(text: Column, words) -> Column:
    """Number of the words that the text holds."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: F.contains(text, w)))


def document_type(text: Column | str, keywords: dict = KEYWORDS, portals: tuple[str, ...] = (), rtc_type: str = "rtc") -> Column:
    """struct(type, confidence) by keyword counts and an ordered list of decisions.

    portals: names of the record portal (lower case) in the caller's configuration; each is one more word of the rtc list,
    and one of them beside "rtc" or its Kannada name is enough. rtc_type: what the caller calls that type.
    """
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    n = {k: hits(low, (*w, *portals) if k == "rtc" else w) for k, w in keywords.items()}
    land = n["rtc"] + n["khata"] + n["mutation"] + n["other"] + n["general"]
    # fixed values: the types' names as stored, and their confidences
    say = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    has = lambda w: F.contains(low, F.lit(w))
    return (
        F.when((land == 0) | ((n["not_land"] >= 2) & (land <= 1)), say("not_land_record", 0.95))
        .when((n["rtc"] >= 2) | ((hits(low, portals) > 0) & (has("rtc") | has("ಪಹಣಿ"))), say(rtc_type, 0.95))
        .when((n["khata"] >= 2) | (has("bbmp") & has("ಖಾತಾ")) | has("khata certificate"), say("khata_certificate", 0.95))
        .when((n["mutation"] >= 2) | has("mutation register"), say("mutation_register", 0.92))
        .when((n["other"] >= 2) | has("sale deed") | has("sub-registrar"), say("other_gov_property", 0.90))
        .when(n["general"] >= 2, say("land_record", 0.88))
        .otherwise(say("not_land_record", 0.80))
    )


def state_of(text: Column | str, further: dict[str, tuple[str, ...]] | None = None) -> Column:
    """F16: the first state whose words or script the text has; further: the caller's own words (lower case) of a state, before all others."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    own = [(state, "|".join(re.escape(w) for w in words)) for state, words in (further or {}).items()]
    rules = [*own, *STATES]
    out = F.when(low.rlike(rules[0][1]), rules[0][0])
    for state, pattern in rules[1:]:
        out = out.when(low.rlike(pattern), state)
    return out.otherwise("DEFAULT")


def rule_scores(text: Column | str, rules: list[dict], has_table: Column | None = None) -> Column:
    """the best of rules {type, mandatory, optional, negative, min_matches, weight, needs_table}: struct(score, type), null without one."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    table = F.lit(False) if has_table is None else has_table
    found = []
    for i, r in enumerate(rules):
        some = hits(low, r.get("optional", ())) if r.get("optional") else F.lit(0)
        must = hits(low, r["mandatory"]) == len(r["mandatory"]) if r.get("mandatory") else F.lit(True)
        none = hits(low, r["negative"]) == 0 if r.get("negative") else F.lit(True)
        signals = F.lit(len(r.get("mandatory", ()))) + some + F.when(table & F.lit(bool(r.get("needs_table"))), 1).otherwise(0)
        ok = must & none & (signals >= r.get("min_matches", 1))
        score = F.least((0.5 + 0.1 * signals) * r.get("weight", 1.0), F.lit(0.99))
        found.append(F.when(ok, F.struct(score.alias("score"), F.lit(-i).alias("o"), F.lit(r["type"]).alias("type"))))
    return F.array_max(F.array_compact(F.array(*found)))


def by_patterns(lines: DataFrame, patterns: dict[str, list[str]], document: str = "document_id", line_no: str = "line_no", text: str = "text") -> DataFrame:
    """For each document and field the match of the first pattern that matches any line, on the first such line.

    Patterns are literals of one plan (compiled once); group 1 is the value, group 2, if there, the unit.
    """
    found = []
    for field, own in patterns.items():
        for i, p in enumerate(own):
            groups = re.compile(p).groups
            value = strip(F.regexp_extract(text, p, 1 if groups else 0))
            unit = strip(F.regexp_extract(text, p, 2)) if groups > 1 else F.lit("")
            found.append(F.when(F.col(text).rlike(p) & has_content(value), F.struct(F.lit(field).alias("field_name"), F.lit(i).alias("pattern_ord"), value.alias("raw_value"), F.nullif(unit, F.lit("")).alias("raw_unit"))))
    rows = lines.select(document, F.col(line_no).alias("line_no"), F.explode(F.array_compact(F.array(*found))).alias("m")).select(document, "line_no", "m.*")
    first = rows.groupBy(document, "field_name").agg(F.min_by(F.struct("raw_value", "raw_unit", "pattern_ord", "line_no"), F.struct("pattern_ord", "line_no")).alias("m"))
    return first.select(document, "field_name", "m.*")


def adjacent_values(lines: DataFrame, terms: dict[str, list[str]], document: str = "document_id", line_no: str = "line_no", text: str = "text") -> DataFrame:
    """What stands after a field's term on its line, else on the next line, else, if that has one letter at most, on the one after."""
    w = Window.partitionBy(document).orderBy(line_no)
    rows = lines.select(document, F.col(line_no).alias("line_no"), F.col(text).alias("t"), F.lead(text, 1).over(w).alias("n1"), F.lead(text, 2).over(w).alias("n2"))
    found = []
    for field, own in terms.items():
        for i, term in enumerate(own):
            at = F.position(F.lit(term.lower()), F.lower("t"))
            rest = F.regexp_replace(F.substring(F.col("t"), at + len(term), F.length("t")), r"^[\s:=\-.]+", "")
            far = F.when(F.length(strip("n1")) <= 1, strip("n2"))
            value = F.when(has_content(rest), strip(rest)).when(has_content("n1") & (F.length(strip("n1")) > 1), strip("n1")).when(has_content(far), far)
            found.append(F.when((at > 0) & value.isNotNull(), F.struct(F.lit(field).alias("field_name"), F.lit(i).alias("term_ord"), value.alias("raw_value"))))
    rows = rows.select(document, "line_no", F.explode(F.array_compact(F.array(*found))).alias("m")).select(document, "line_no", "m.*")
    return rows.groupBy(document, "field_name").agg(F.min_by("raw_value", F.struct("line_no", "term_ord")).alias("raw_value"))


def next_line_values(lines: Column, anchors: dict[str, list[str]], threshold: float = 0.65) -> Column:
    """Folds a document's lines (array of struct(text, confidence)): a field's value after its anchor, or on the next
    line if that has none; a better confidence replaces a value until one is good enough. map(field -> struct(value, confidence))."""
    all_terms = [t.lower() for own in anchors.values() for t in own]
    anchored = lambda t: F.exists(F.array(*[F.lit(a) for a in all_terms]), lambda a: F.contains(F.lower(t), a))
    n = F.size(lines)

    def hits_of(own: list[str]) -> Column:
        def hit(i: Column) -> Column:
            line, after = F.get(lines, i), F.get(lines, i + 1)
            at = [F.position(F.lit(t.lower()), F.lower(line["text"])) for t in own]
            rests = [F.when(p > 0, F.regexp_replace(F.substring(line["text"], p + len(t), F.length(line["text"])), r"^[\s:=\-.]+", "")) for p, t in zip(at, own, strict=True)]
            rest = strip(F.coalesce(*rests))
            use_next = rest.isNotNull() & ~has_content(rest) & after.isNotNull() & ~anchored(after["text"])
            value = F.when(has_content(rest), rest).when(use_next, strip(after["text"]))
            conf = F.when(has_content(rest), line["confidence"]).otherwise(F.least(line["confidence"], after["confidence"]))
            return F.when(has_content(value), F.struct(value.alias("value"), conf.cast("double").alias("confidence")))

        numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_compact(F.transform(numbers, hit))

    found = []
    for field, own in anchors.items():
        start = F.lit(None).cast("struct<value:string,confidence:double>")
        best = F.aggregate(hits_of(own), start, lambda s, h: F.when(s.isNull() | ((s["confidence"] < threshold) & (h["confidence"] > s["confidence"])), h).otherwise(s))
        found += [F.lit(field), best]
    return F.map_filter(F.create_map(*found), lambda k, v: v.isNotNull())


def table_values(tables: DataFrame, columns: dict[str, list[str]], document: str = "document_id") -> DataFrame:
    """The first cell with content under a header that holds one of a field's words."""
    rows = tables.select(document, "headers", F.posexplode("rows").alias("row_no", "cells"))

    def cells_of(field: str, words: list[str]) -> Column:
        named = F.transform("headers", lambda h, i: F.struct(F.lower(h).alias("h"), i.alias("i")))
        at = F.filter(named, lambda x: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(x["h"], w)))
        return F.transform(at, lambda x: F.struct(F.lit(field).alias("field_name"), x["i"].alias("column_no"), F.get("cells", x["i"]).alias("raw_value")))

    found = [cells_of(field, words) for field, words in columns.items()]
    cells = rows.select(document, "row_no", F.explode(F.concat(*found)).alias("m")).select(document, "row_no", "m.*").where(has_content("raw_value"))
    return cells.groupBy(document, "field_name").agg(F.min_by(strip("raw_value"), F.struct("column_no", "row_no")).alias("raw_value"))


def by_precedence(candidates: DataFrame, document: str = "document_id", rank: str = "source_rank") -> DataFrame:
    """Of each field's candidates the one with the smallest rank."""
    rest = [c for c in candidates.columns if c not in (document, "field_name")]
    return candidates.groupBy(document, "field_name").agg(F.min_by(F.struct(*rest), rank).alias("c")).select(document, "field_name", "c.*")


def reconcile(semantic: DataFrame, regex: DataFrame, document: str = "document_id", equivalents: dict[str, str] | None = None) -> DataFrame:
    """Full outer join of two channels (raw_value, confidence) with the channel chosen."""
    same = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in (equivalents or {"": ""}).items() for v in kv]), F.lower(strip(c))), F.lower(strip(c)))
    s = semantic.select(document, "field_name", F.col("raw_value").alias("s_value"), F.col("confidence").alias("s_conf"))
    r = regex.select(document, "field_name", F.col("raw_value").alias("r_value"), F.col("confidence").alias("r_conf"))
    both = s.join(r, [document, "field_name"], "full")
    place = F.col("field_name").isin("locality", "village", "taluk", "district")
    agree = (F.lower(strip("s_value")) == F.lower(strip("r_value"))) | (place & (same("s_value") == same("r_value")))
    choice = (
        F.when(F.col("r_value").isNull(), "semantic")
        .when(F.col("s_value").isNull(), "regex")
        .when(agree, "consensus")
        .when(F.col("s_conf") >= F.col("r_conf"), "semantic")
        .when((F.col("s_conf") > 0.80) & (F.col("r_conf") < 0.90), "semantic")
        .otherwise("regex")
    )
    out = both.withColumn("channel", choice)
    by = F.col("channel") == "semantic"
    boosted = F.least(F.lit(1.0), F.greatest("s_conf", "r_conf") + 0.05)
    return out.select(document, "field_name", F.when(by, F.col("s_value")).otherwise(F.col("r_value")).alias("raw_value"), F.when(F.col("channel") == "consensus", boosted).when(by, F.col("s_conf")).otherwise(F.col("r_conf")).alias("confidence"), "channel")


def source_line(snippets: DataFrame, lines: DataFrame, document: str = "document_id") -> DataFrame:
    """Each snippet's first line that holds it or one of its words of three letters or more; null without one."""
    words = F.filter(tokens("snippet"), lambda w: F.length(w) > 2)
    pairs = snippets.join(lines.select(document, "line_no", F.col("text").alias("line_text")), document)
    held = pairs.where(F.contains("line_text", "snippet") | F.exists(words, lambda w: F.contains(F.col("line_text"), w)))
    first = held.groupBy(document, "snippet").agg(F.min("line_no").alias("line_no"))
    return snippets.join(first, [document, "snippet"], "left")


def anchor_of(text: Column | str, anchors: dict[str, str]) -> Column:
    """Field of the first anchor that equals the text, begins it, or, with over five letters, stands in it."""
    low = F.regexp_replace(F.lower(strip(text)), r"[\s:.\-]+$", "")
    tests = [F.when((low == a.lower()) | low.startswith(a.lower()) | (F.contains(low, F.lit(a.lower())) if len(a) > 5 else F.lit(False)), F.lit(f)) for a, f in anchors.items()]
    return F.coalesce(*tests)


def values_by_layout(tokens_: DataFrame, anchors: dict[str, str], page: list[str]) -> DataFrame:
    """For each anchor token its inline value, else the nearest token below, else the nearest to the right; the first anchor of a field counts.

    tokens_: page columns, token_no, text, confidence, x_min, y_min, x_max, y_max. Joined on the page only.
    """
    t = tokens_.withColumn("field", anchor_of("text", anchors)).withColumn("cx", (F.col("x_min") + F.col("x_max")) / 2).withColumn("cy", (F.col("y_min") + F.col("y_max")) / 2)
    a = t.where("field is not null").withColumn("inline", inline_value("text"))
    v = t.where("field is null").select(*page, *[F.col(c).alias(f"v_{c}") for c in ("token_no", "text", "confidence", "x_min", "y_min", "x_max", "y_max", "cx", "cy")])
    below = (F.col("v_y_min") - F.col("y_max")).alias("d")
    right = F.col("v_x_min") - F.col("x_max")
    is_below = below.between(0, BELOW_PX) & F.col("v_cx").between(F.col("x_min") - COLUMN_PX, F.col("x_max") + COLUMN_PX)
    is_right = right.between(0, RIGHT_PX) & (F.abs(F.col("v_cy") - F.col("cy")) <= 2 * ROW_PX)
    pairs = a.where("inline is null").join(v, page).withColumn("way", F.when(is_below, 1).when(is_right, 2)).where("way is not null")
    near = pairs.groupBy(*page, "token_no").agg(F.min_by(F.struct("way", "v_text", "v_confidence"), F.struct("way", F.when(F.col("way") == 1, below).otherwise(right).alias("d"), "v_token_no")).alias("m"))
    out = a.join(near, [*page, "token_no"], "left").where("inline is not null or m is not null")
    out = out.select(
        *page,
        F.col("field").alias("field_name"),
        "token_no",
        F.coalesce("inline", "m.v_text").alias("value_text"),
        F.when(F.col("inline").isNotNull(), F.col("confidence")).otherwise(F.least("confidence", "m.v_confidence")).alias("confidence"),
        F.when(F.col("inline").isNotNull(), "inline").when(F.col("m.way") == 1, "below").otherwise("right").alias("relationship"),
    )
    rest = [c for c in out.columns if c not in (*page, "field_name")]
    return out.groupBy(*page, "field_name").agg(F.min_by(F.struct(*rest), "token_no").alias("r")).select(*page, "field_name", "r.*")


def values_exclusive(regions: DataFrame, anchors: dict[str, str], page: list[str], right: float = 350.0, down: float = 120.0) -> DataFrame:
    """Anchors in reading order take their inline value, else the nearest region to the right or below that no anchor has taken yet."""
    rows = regions.withColumn("field", anchor_of("text", anchors)).withColumn("inline", inline_value("text"))
    kept = ", ".join(f"{c} {dict(regions.dtypes)[c]}" for c in page)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y_min", "x_min"], kind="stable")
        free = {r.Index: r for r in pdf.itertuples() if not isinstance(r.field, str)}
        out, seen = [], set()
        for a in pdf.itertuples():
            if not isinstance(a.field, str) or a.field in seen:
                continue
            if isinstance(a.inline, str):
                seen.add(a.field)
                out.append((*[getattr(a, c) for c in page], a.field, a.inline, 0.0))
                continue
            best = None
            for i, v in free.items():
                dx, dy = v.x_min - a.x_max, v.y_min - a.y_max
                same_row = min(a.y_max, v.y_max) - max(a.y_min, v.y_min) > 0
                same_column = min(a.x_max, v.x_max) - max(a.x_min, v.x_min) > 0
                d = dx if same_row and 0 <= dx <= right else dy if same_column and 0 <= dy <= down else None
                if d is not None and (best is None or d < best[0]):
                    best = (d, i)
            if best:
                v = free.pop(best[1])
                seen.add(a.field)
                out.append((*[getattr(a, c) for c in page], a.field, v.text, float(best[0])))
        return pd.DataFrame(out, columns=[*page, "field_name", "value_text", "distance"])

    return rows.groupBy(*page).applyInPandas(work, f"{kept}, field_name string, value_text string, distance double")


# Forms of the labels of each field, the preferred one first; where a sign ends a label before a boundary, a letter or digit must follow.
LABELS = {
    "survey_number": (r"ಸರ್ವೆ\s*ನಂ[ಬರ\.]*", r"ಸರ್ವೇ\s*ನಂ[ಬರ\.]*", r"ಸರ್ವೆ\s*ಸಂಖ್ಯೆ", r"ಸರ್ವೇ\s*ಸಂಖ್ಯೆ", r"ಸರ್ವೆ\s*ನಂಬರ್", r"ಸರ್ವೇ\s*ನಂಬರ್", "ಸರ್ವೆ", "ಸರ್ವೇ", r"survey\s*no[\.]*", r"survey\s*number", r"sy\s*no[\.]*"),
    "owner_name": (r"ಖಾತೆದಾರರ\s*ಹೆಸರು", r"ಮಾಲೀಕರ\s*ಹೆಸರು", r"ಹಿಡುವಳಿದಾರರ\s*ಹೆಸರು", r"ಅನುಭೋಗದಾರರ\s*ಹೆಸರು", "ಖಾತೆದಾರರು", "ಮಾಲೀಕರು", "ಹೆಸರು", r"khatadar\s*name", r"owner\s*name", r"occupant\s*name", "name"),
    "hissa_number": (r"ಹಿಸ್ಸಾ\s*ನಂ[ಬರ\.]*", r"ಹಿಸ್ಸೆ\s*ನಂ[ಬರ\.]*", r"ಹಿಸ್ಸಾ\s*ಸಂಖ್ಯೆ", "ಹಿಸ್ಸಾ", r"hissa\s*no[\.]*", "hissa"),
    "khata_number": (r"ಖಾತಾ\s*ಸಂಖ್ಯೆ", r"ಖಾತೆ\s*ಸಂಖ್ಯೆ", r"ಖಾತಾ\s*ನಂ[ಬರ\.]*", r"ಖಾತೆ\s*ನಂ[ಬರ\.]*", r"ಖಾತಾ(?=[\p{L}\p{N}_])", r"ಖಾತೆ(?=[\p{L}\p{N}_])", r"khata\s*no[\.]*", r"khata\s*number", r"(?<![\p{L}\p{N}_])khata(?![\p{L}\p{N}_])"),
    "father_name": (r"ತಂದೆಯ\s*ಹೆಸರು", r"ಗಂಡನ\s*ಹೆಸರು", "ತಂದೆ", "ಗಂಡ", r"father['\s]*s\s*name", r"husband['\s]*s\s*name", "s/o", "w/o", "d/o"),
    "district": ("ಜಿಲ್ಲೆ", "ಜಿಲ್ಲಾ", "district", r"dist[\.]*"),
    "taluk": ("ತಾಲೂಕು", "ತಾಲ್ಲೂಕು", "ತಾಲೂಕ", "taluk", "taluka", "tehsil"),
    "hobli": ("ಹೋಬಳಿ", "ಹೋಬಲಿ", "hobli", "circle"),
    "village": (r"ಗ್ರಾಮದ\s*ಹೆಸರು", r"ದಖಲೆ\s*ಗ್ರಾಮ", r"ಹಳ್ಳಿಯ\s*ಹೆಸರು", "ಗ್ರಾಮ", "village"),
    "extent": (r"ಒಟ್ಟು\s*ವಿಸ್ತೀರ್ಣ", r"ಹಿಡುವಳಿ\s*ವಿಸ್ತೀರ್ಣ", "ವಿಸ್ತೀರ್ಣ", "ವಿಸ್ತಾರ", r"total\s*extent", "extent", "area"),
    "land_type": (r"ಜಮೀನಿನ\s*ವಿವರ", r"ಭೂಮಿಯ\s*ವಿಧ", "ಖುಷ್ಕಿ", "ತರಿ", "ಬಾಗಾಯ್ತು", r"land\s*nature", r"land\s*type", "dry", "wet", "garden"),
    "assessment": ("ಕಂದಾಯ", "ಆಕಾರಬಂದ್", r"ಕಂದಾಯದ\s*ವಿವರ", "assessment", r"land\s*revenue"),
    "mutation_number": (r"ಮ್ಯುಟೇಶನ್\s*ನಂ[ಬರ\.]*", r"ಮ್ಯುಟೇಶನ್\s*ಸಂಖ್ಯೆ", r"ಎಂ\s*ಆರ್\s*ನಂ", r"ಎಂ\.ಆರ್\.", r"mutation\s*no[\.]*", r"mr\s*no[\.]*"),
    "document_number": (r"ದಾಖಲೆ\s*ಸಂಖ್ಯೆ", r"ನೋಂದಣಿ\s*ಸಂಖ್ಯೆ", r"ದಸ್ತಾವೇಜು\s*ಸಂಖ್ಯೆ", r"document\s*no[\.]*", r"registration\s*no[\.]*"),
    "registration_date": ("ದಿನಾಂಕ", r"ನೋಂದಣಿ\s*ದಿನಾಂಕ", r"ಆದೇಶದ\s*ದಿನಾಂಕ", "date", r"registration\s*date"),
    "boundaries": ("ಚಕ್ಕುಬಂದಿ", "ಚತುಸ್ಸೀಮೆ", "ಗಡಿಗಳು", "boundaries"),
    "remarks": ("ಷರಾ", r"ವಿಶೇಷ\s*ಷರಾ", "ಟಿಪ್ಪಣಿ", "remarks", "notes"),
}


def label_anchors(regions: DataFrame, labels: dict[str, tuple[str, ...]] = LABELS, text: str = "text") -> DataFrame:
    """One row for each region and field whose label it holds: field_name, label as it stands, inline_value after it (null: none).

    Of a field's labels the preferred one that matches counts; an inline value needs a separator (: - . = or a blank) before it.
    """
    found = []
    for name, forms in labels.items():
        one = [F.when(F.col(text).rlike(f"(?iu){p}"), F.struct(F.regexp_extract(text, f"(?iu)({p})", 1).alias("label"), F.regexp_extract(text, f"(?ius)^.*?(?:{p})(.*)$", 1).alias("rest"))) for p in forms]
        hit = F.coalesce(*one)
        rest = strip(hit["rest"])
        # white space before the value has been stripped, so the separator must be a mark
        value = F.nullif(strip(F.regexp_extract(rest, r"^[:\-.=\s]+(.*)$", 1)), F.lit(""))
        found.append(F.when(hit.isNotNull(), F.struct(F.lit(name).alias("field_name"), hit["label"].alias("label"), value.alias("inline_value"))))
    return regions.withColumn("_a", F.explode(F.array_compact(F.array(*found)))).select(*regions.columns, "_a.*")
