"""Confidence of fields and documents, calibration, and reliability."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import geometry
from recordloom.functions.text import _c, strip, tokens

HIGH, MEDIUM = 0.85, 0.65
# How far each way of extraction is trusted.
PATTERN = {"regex": 0.95, "semantic_understanding": 0.95, "table_lookup": 0.90, "handwriting_fusion": 0.85}
PLACE_FIELDS = ("khasra_number", "land_area", "village", "tehsil", "district")


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def field_score(ocr, method, errors, warnings, infos, name, area_matches, khasra_matches, cross_passed, flagged, gis_verified, gis_found, gis_mismatch, conflict) -> Column:
    """Product of recognition, pattern and rules, scaled by context, less penalties; four places."""
    pattern = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in PATTERN.items() for v in kv]), F.lower(_c(method))), F.lit(0.75))
    rule = F.when(_c(errors) > 0, 0.0).when(_c(warnings) > 0, 0.60).when(_c(infos) > 0, 0.85).otherwise(1.0)
    name, area, passed = _c(name), _c(area_matches), _c(cross_passed)
    cross = (
        F.when(name == "land_area", F.when(area, 1.0).when(~area, 0.40).otherwise(0.85))
        .when(name == "khasra_number", F.when(_c(khasra_matches), 1.0).otherwise(0.85))
        .otherwise(F.when(passed, 0.90).otherwise(0.75))
    )
    verified, found, off = _c(gis_verified), _c(gis_found), _c(gis_mismatch)
    gis = F.when(name.isin(*PLACE_FIELDS), F.when(verified, 1.0).when(found & ~off, 0.90).when(off, 0.35).otherwise(0.70)).otherwise(F.when(verified, 0.90).otherwise(0.80))
    passes = rule * F.when(_c(flagged), 0.5).otherwise(1.0)
    context = 0.85 + 0.15 * (gis + cross) / 2.0
    penalty = F.when(_c(conflict), 0.25).otherwise(0.0) + F.when(_c(errors) > 0, 0.20).otherwise(0.0)
    return unit(F.bround(unit(_c(ocr)) * pattern * passes * context - penalty, 4))


def documents(scored: DataFrame, all_documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Mean of a document's field scores, reasons for review and whether it goes there.

    scored: key, field_name, score, conflict. all_documents: key, has_errors, inconsistencies, gis_reasons, duplicate_of;
    documents without fields stay, with confidence 0.
    """
    reasons = F.array_compact(
        F.flatten(
            F.collect_list(
                F.array(
                    F.when(F.col("score") < MEDIUM, F.concat(F.lit("Low confidence in field '"), "field_name", F.lit("' ("), F.format_string("%.2f", "score"), F.lit(")"))),
                    F.when(F.col("conflict"), F.concat(F.lit("Unresolved OCR disagreement in field '"), "field_name", F.lit("'"))),
                )
            )
        )
    )
    own = scored.groupBy(key).agg(F.bround(F.avg("score"), 4).alias("confidence"), F.array_sort(reasons).alias("_field_reasons"))
    none = F.array().cast("array<string>")
    out = all_documents.join(own, key, "left")
    said = F.concat(
        F.coalesce("_field_reasons", none),
        F.when(F.col("confidence").isNull(), F.array(F.lit("No structured fields could be extracted from document"))).otherwise(none),
        F.when(F.col("has_errors"), F.array(F.lit("Document failed mandatory rule validations"))).otherwise(none),
        F.coalesce("inconsistencies", none),
        F.coalesce("gis_reasons", none),
        F.when(F.col("duplicate_of").isNotNull(), F.array(F.lit("Potential duplicate record"))).otherwise(none),
    )
    out = out.withColumn("review_reasons", said).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).drop("_field_reasons")
    return out.withColumn("requires_review", (F.col("confidence") < HIGH) | (F.size("review_reasons") > 0))


def evidence_score(value, source, status, has_region, has_box, conflicts, table_cell) -> Column:
    """Grounding, validation, provenance and place, weighted; at most 0.25 if invalid or not grounded."""
    value, source, status = strip(value), strip(source), _c(status)
    own, there = tokens(value), tokens(source)
    ground = (
        F.when(source.isNull(), 0.0)
        .when(source == "", 0.5)
        .when(F.contains(source, value), 1.0)
        .when(F.size(F.array_except(own, there)) == 0, 0.9)
        .when(F.size(F.array_intersect(own, there)) > 0, 0.6)
        .otherwise(0.0)
    )
    valid = F.when(status == "VALID", 1.0).when(status == "WARNING", 0.6).when(status == "UNVERIFIED", 0.5).otherwise(0.0)
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    known = flag(_c(has_region), 0.4) + flag(_c(has_box), 0.3) + flag(F.coalesce(source != "", F.lit(False)), 0.3)
    place = F.when(_c(table_cell), 1.0).when(_c(has_box), 0.85).otherwise(0.5)
    base = F.greatest(F.lit(0.0), 0.35 * ground + 0.30 * valid + 0.20 * known + 0.15 * place - flag(_c(conflicts), 0.4))
    base = F.when((status == "INVALID") | (ground == 0), F.least(base, F.lit(0.25))).otherwise(base)
    return F.when(value.isNull() | (value == ""), 0.0).otherwise(F.bround(base, 4))


def token_mean(p: Column | str) -> Column:
    """Mean of token probabilities; null if empty or any is not in [0, 1]."""
    return F.when(_sound(p), F.aggregate(_c(p), F.lit(0.0), lambda s, v: s + v) / F.size(_c(p)))


def token_geometric_mean(p: Column | str) -> Column:
    p = _c(p)
    return F.when(_sound(p), F.when(F.exists(p, lambda v: v == 0), 0.0).otherwise(F.exp(F.aggregate(p, F.lit(0.0), lambda s, v: s + F.ln(v)) / F.size(p))))


def token_min(p: Column | str) -> Column:
    return F.when(_sound(p), F.array_min(_c(p)))


def _sound(p: Column | str) -> Column:
    p = _c(p)
    return (F.size(p) > 0) & F.forall(p, lambda v: F.coalesce(~F.isnan(v) & v.between(0.0, 1.0), F.lit(False)))


def tier(confidence: Column | str, high: float = 0.85, low: float = 0.60) -> Column:
    """F18."""
    c = _c(confidence)
    return F.when(c.isNull(), "UNKNOWN").when(c >= high, "HIGH").when(c >= low, "MEDIUM").otherwise("LOW")


def disagreement(printed, printed_conf, written, written_conf) -> Column:
    """struct(value, source, strategy, penalty, confidence, conflict) for two readings that differ."""
    p, pc, w, wc = _c(printed), _c(printed_conf), _c(written), _c(written_conf)
    by_hand = (wc > pc + 0.15) & (F.length(w) > 0)
    printed_wins = ~by_hand & (pc > wc + 0.20)
    penalty = F.when(by_hand | printed_wins, 0.10).otherwise(0.30)
    return F.struct(
        F.when(by_hand, w).otherwise(p).alias("value"),
        F.when(by_hand, "handwriting_ocr").otherwise("printed_ocr").alias("source"),
        F.when(by_hand, "handwriting_high_confidence").when(printed_wins, "printed_high_confidence").otherwise("unresolved_ambiguity").alias("strategy"),
        penalty.alias("penalty"),
        F.greatest(F.lit(0.05), pc - penalty).alias("confidence"),
        (~by_hand & ~printed_wins).alias("conflict"),
    )


def resolve_conflicts(value: Column | str, confidence: Column | str, readings: Column | str) -> Column:
    """Folds handwritten readings (array of struct(text, confidence), in order) into a printed value.

    Each reading meets the value that the ones before have left. struct(value, confidence, conflict, fused).
    """
    start = F.struct(_c(value).alias("value"), _c(confidence).cast("double").alias("confidence"), F.lit(False).alias("conflict"), F.lit(False).alias("fused"))

    def step(s: Column, r: Column) -> Column:
        d = disagreement(s["value"], s["confidence"], r["text"], r["confidence"])
        same = F.lower(strip(s["value"])) == F.lower(strip(r["text"]))
        pick = lambda a, b, n: F.when(same, a).otherwise(b).alias(n)
        return F.struct(pick(s["value"], d["value"], "value"), pick(s["confidence"], d["confidence"], "confidence"), pick(s["conflict"], s["conflict"] | d["conflict"], "conflict"), pick(s["fused"], s["fused"] | (d["source"] == "handwriting_ocr"), "fused"))

    return F.aggregate(_c(readings), start, step)


def resolve_fields(fields: DataFrame, writing: DataFrame, threshold: float = 0.25, document: str = "document_id") -> DataFrame:
    """Fields (field_name, page, box, value, confidence) with the handwritten regions (region_no, page, box, text,
    confidence) of their page that overlap them by threshold or more, folded in region order. Adds resolved (as resolve_conflicts())."""
    side = writing.select(F.col(document), F.col("page"), F.struct("region_no", "text", "confidence").alias("_r"), F.col("box").alias("_box"))
    met = fields.join(side, [document, "page"]).where(geometry.overlaps(F.col("box"), F.col("_box"), threshold))
    lists = met.groupBy(document, "field_name").agg(F.array_sort(F.collect_list("_r")).alias("_readings"))
    readings = F.transform(F.coalesce("_readings", F.array().cast("array<struct<region_no:int,text:string,confidence:double>>")), lambda r: F.struct(r["text"].alias("text"), r["confidence"].alias("confidence")))
    return fields.join(lists, [document, "field_name"], "left").withColumn("resolved", resolve_conflicts("value", "confidence", readings)).drop("_readings")


def grounding_score(value: Column | str, source: Column | str) -> Column:
    """1 where the value stands in the source, 0.9 where all its words do, 0.6 where some do, else 0."""
    v, s = strip(value), strip(source)
    words, held = F.array_distinct(tokens(v)), tokens(s)
    some = F.size(words) > 0
    return F.when(F.contains(s, v), 1.0).when(some & (F.size(F.array_except(words, held)) == 0), 0.9).when(some & F.arrays_overlap(words, held), 0.6).otherwise(0.0)


def document_means(regions: DataFrame, document: str = "document_id") -> DataFrame:
    """Mean detection and routing confidence (1.0 without any), four places; the calibrated mean only if every region has one."""
    mean = lambda c: F.coalesce(F.bround(F.avg(c), 4), F.lit(1.0)).alias(c)
    return regions.groupBy(document).agg(mean("detection"), mean("routing"), F.bround(mean_if_all("calibrated"), 4).alias("calibrated"))


def platt(score, a, b) -> Column:
    """Four places."""
    return F.bround(1.0 / (1.0 + F.exp(-(_c(a) * _c(score) + _c(b)))), 4)


def temperature(score, t) -> Column:
    s = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), _c(score)))
    return F.bround(1.0 / (1.0 + F.exp(-F.ln(s / (1 - s)) / F.greatest(F.lit(0.01), _c(t)))), 4)


def fit_calibrators(samples: DataFrame, engine: str = "engine", score: str = "score", label: str = "label", least: int = 50, steps: int = 25) -> DataFrame:
    """Each engine's Platt parameters (a, b) by Newton's method on its whole data, and the temperature with the least log loss on a grid.

    Scores are first summed in bins of 1e-4, so what one task fits for an engine is at most 10,001 rows,
    however many samples there are. Engines with fewer than least samples are left out.
    """
    rows = samples.select(F.col(engine).alias("engine"), F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(score).cast("double"))).alias("s"), F.col(label).cast("double").alias("y")).where("s is not null and y is not null and not isnan(s)")
    bins = rows.groupBy("engine", F.bround("s", 4).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"), F.avg("s").alias("s"))
    total = rows.groupBy("engine").agg(F.count(F.lit(1)).alias("n_samples")).where(F.col("n_samples") >= least)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        s, n, k = (pdf[c].to_numpy(float) for c in ("s", "n", "k"))
        a, b = 0.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * s + b)))
            g = np.array([(s * (k - n * p)).sum(), (k - n * p).sum()])
            w = n * p * (1 - p)
            h = np.array([[(w * s * s).sum() + 1e-9, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-9]])
            step = np.clip(np.linalg.solve(h, g), -5, 5)
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-10:
                break
        grid = np.linspace(0.1, 5.0, 50)
        logit = np.log(s / (1 - s))
        loss = [-(k * np.log(np.clip(q, 1e-12, 1)) + (n - k) * np.log(np.clip(1 - q, 1e-12, 1))).sum() for q in (1 / (1 + np.exp(-np.clip(logit / t, -700, 700))) for t in grid)]
        return pd.DataFrame({"engine": [pdf["engine"].iloc[0]], "n_samples": [int(n.sum())], "a": [a], "b": [b], "temperature": [float(grid[int(np.argmin(loss))])]})

    kept = bins.join(total.select("engine"), "engine")
    return kept.groupBy("engine").applyInPandas(fit, "engine string, n_samples long, a double, b double, temperature double")


def calibrate(rows: DataFrame, parameters: DataFrame, engine: str = "engine", score: str = "score") -> DataFrame:
    """Adds calibrated (null without parameters or score) and state."""
    own = parameters.select(F.col("engine").alias(engine), "a", "b")
    out = rows.join(own, engine, "left").withColumn("calibrated", platt(score, "a", "b"))
    return out.withColumn("state", F.when(F.col("calibrated").isNotNull(), "CALIBRATED").otherwise("UNCALIBRATED")).drop("a", "b")


def bin_of(score: Column | str, bins: int = 10) -> Column:
    """The equal-width bin by comparison with its edges; the last one is closed."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]
    s = _c(score)
    out = F.when(s.between(edges[-2], edges[-1]), bins - 1)
    for i in range(bins - 2, -1, -1):
        out = out.when((s >= edges[i]) & (s < edges[i + 1]), i)
    return out


def reliability(rows: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """A row for each bin, empty ones too, with ECE and MCE repeated on each."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]
    spark = rows.sparkSession
    all_bins = spark.createDataFrame([(i, (edges[i] + edges[i + 1]) / 2) for i in range(bins)], "bin int, middle double")
    own = rows.groupBy(bin_of(score, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("acc"), F.avg(score).alias("conf"))
    out = all_bins.join(own, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gap = F.abs(F.col("acc") - F.col("conf"))
    sums = out.agg(F.bround(F.sum(F.col("n") * gap) / F.sum("n"), 4).alias("ece"), F.bround(F.max(gap), 4).alias("mce"))
    return out.crossJoin(F.broadcast(sums)).select("bin", "n", F.coalesce(F.bround("acc", 4), F.lit(0.0)).alias("accuracy"), F.coalesce(F.bround("conf", 4), F.bround("middle", 4)).alias("confidence"), "ece", "mce")


def summary(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Accuracy, mean and population deviation of the score."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("accuracy"), F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))


def weighted_mean(value: str, weight: Column | str) -> Column:
    """A10, as an aggregate: weights of at least 1, null values left out."""
    w = F.greatest(F.lit(1), _c(weight))
    return F.try_divide(F.sum(F.when(F.col(value).isNotNull(), F.col(value) * w)), F.sum(F.when(F.col(value).isNotNull(), w)))


def mean_if_all(value: str) -> Column:
    """A11, as an aggregate: the mean if no value is null."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def features(ocr, method, errors, warnings, cross_passed, parcel_verified, parcel_mismatch, conflict) -> Column:
    """The nine numbers that a learned calibrator reads.

    Recognition confidence, strength of the pattern (0.95 for regex, else 0.85), whether regex and whether table lookup,
    numbers of errors and warnings, cross-record check passed, parcel verified (0.5: undecided), conflict.
    """
    flag = lambda c: F.coalesce(_c(c).cast("double"), F.lit(0.0))
    regex = F.lower(_c(method)).eqNullSafe(F.lit("regex"))
    parcel = F.when(flag(parcel_verified) > 0, 1.0).when(flag(parcel_mismatch) > 0, 0.0).otherwise(0.5)
    return F.array(flag(ocr), F.when(regex, 0.95).otherwise(0.85), regex.cast("double"), F.lower(_c(method)).eqNullSafe(F.lit("table_lookup")).cast("double"), flag(errors), flag(warnings), flag(cross_passed), parcel, flag(conflict))


def fit_correctness(rows: DataFrame, vector: str = "features", label: str = "label"):
    """A logistic regression of correctness on features(), with the ridge penalty 1 of the usual default, fitted by Spark."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.col(vector)).alias("features"), F.col(label).cast("double").alias("label"))
    n = data.count()
    return LogisticRegression(regParam=1.0 / max(1, n), standardization=False, maxIter=500).fit(data)


def correctness(vector: Column | str, model) -> Column:
    """The model's probability of correctness, from 0 to 1, four places."""
    z = F.aggregate(F.zip_with(_c(vector), F.array(*[F.lit(float(w)) for w in model.coefficients]), lambda x, w: x * w), F.lit(float(model.intercept)), lambda a, x: a + x)
    return F.round(1 / (1 + F.exp(-z)), 4)


def blended(learned: Column | str, weighted: Column | str) -> Column:
    """60 percent learned and 40 percent rule score where a learned one exists, four places."""
    return F.coalesce(F.round(0.60 * _c(learned) + 0.40 * _c(weighted), 4), _c(weighted))
