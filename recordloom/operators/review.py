"""Review: routing of regions, the queue, its state and its audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import _c, strip

OPEN = ("PENDING", "ASSIGNED", "IN_REVIEW")
DONE = ("APPROVED", "EDITED", "REJECTED")


def region_status(handwritten, raw_confidence, calibrated, region_type, text, warnings=None) -> Column:
    """struct(status, reason), the first reason that holds."""
    hand, raw, t = F.coalesce(_c(handwritten), F.lit(False)), _c(raw_confidence), _c(text)
    review = lambda r: F.struct(F.lit("REVIEW_REQUIRED").alias("status"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    warn = F.array().cast("array<string>") if warnings is None else F.coalesce(_c(warnings), F.array().cast("array<string>"))
    return (
        F.when(t.isNull() | (strip(t) == ""), review("OCR output is empty; officer inspection required"))
        .when(hand & (_c(region_type) == "line"), review("Multi-word line crop routed to a word model; officer review required"))
        .when(hand & _c(calibrated).isNull(), review("Handwritten region lacks calibrated confidence; officer review required"))
        .when(raw < 0.60, review(F.concat(F.lit("Low recognizer confidence ("), F.format_string("%.2f", raw), F.lit(" < 0.60)"))))
        .when(F.size(warn) > 0, review(F.array_join(warn, "; ")))
        .otherwise(F.struct(F.lit("AUTO_ACCEPT").alias("status"), F.lit(None).cast("string").alias("reason")))
    )


def priority(confidence, critical, text) -> Column:
    """10 for each unit of missing confidence, 10 for critical fields, 5 for empty text."""
    return (1.0 - F.coalesce(_c(confidence), F.lit(0.0))) * 10.0 + F.when(_c(critical), 10.0).otherwise(0.0) + F.when(F.coalesce(strip(text), F.lit("")) == "", 5.0).otherwise(0.0)


def pending(queue: DataFrame, n: int | None = None) -> DataFrame:
    """Open items by falling priority, ties by id."""
    out = queue.where(F.col("lifecycle_state").isin(*OPEN)).orderBy(F.desc("priority"), "review_id")
    return out if n is None else out.limit(n)


def stats(queue: DataFrame, state: str = "lifecycle_state") -> DataFrame:
    """One row: total, pending, completed, and a count n_ for each state."""
    count = lambda *s: F.count_if(F.col(state).isin(*s))
    return queue.agg(F.count(F.lit(1)).alias("total"), count(*OPEN).alias("pending"), count(*DONE).alias("completed"), *[count(s).alias(f"n_{s.lower()}") for s in (*OPEN, *DONE)])


def supplement(reviews: DataFrame, fields: DataFrame, below: float = 0.70, document: str = "document_id") -> DataFrame:
    """the review list and the fields below a confidence that are not in it."""
    extra = fields.where(F.col("confidence") < below).join(reviews.select(document, "field_name").distinct(), [document, "field_name"], "left_anti")
    both = [document, "field_name", "confidence"]
    return reviews.select(*both, F.lit("review").alias("origin")).unionByName(extra.select(*both, F.lit("low_confidence").alias("origin")))


def submit(items: Column | str, review_id: Column | str, decision: str, corrected: Column | str | None = None) -> Column:
    """An array of items (review_id, raw_text, status, decision, corrected_text) with one decided; raw text stays."""
    new = F.lit(None).cast("string") if corrected is None else _c(corrected)
    return F.transform(
        _c(items),
        lambda x: F.when(
            x["review_id"] == _c(review_id), x.withField("status", F.lit("COMPLETED")).withField("decision", F.lit(decision)).withField("corrected_text", F.coalesce(new, x["corrected_text"]))
        ).otherwise(x),
    )


def any_pending(items: Column | str) -> Column:
    return F.exists(_c(items), lambda x: x["status"] != "COMPLETED")


def current_state(events: DataFrame, item: str = "review_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Each item's last event; raw evidence is taken from the first."""
    return events.groupBy(item).agg(F.max_by("state", F.struct(*order)).alias("state"), F.max_by("corrected_text", F.when(F.col("corrected_text").isNotNull(), F.struct(*order))).alias("corrected_text"), F.min_by("raw_text", F.struct(*order)).alias("raw_text"), F.count(F.lit(1)).alias("n_events"))
