"""Writers: keyed replacement, logs and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import file_name


def replaced(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Old without the keys that new has, and new. Written to a new version, never over what is read."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def deleted(tables: dict[str, DataFrame], ids: DataFrame, parent: str, key: str = "document_id") -> dict[str, DataFrame]:
    """All tables without the ids; the parent's key is id or document_id."""
    out = {}
    for name, df in tables.items():
        own = "id" if name == parent and key not in df.columns else key
        out[name] = df.join(ids.select(F.col(key).alias(own)).distinct(), own, "left_anti")
    return out


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys old lacks are added; the others stay as they are."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def sound_hash(given: Column, name: Column, text: Column) -> Column:
    """A digest of 64 letters as given, else one of name, text and what was given."""
    return F.when(F.length(given) == 64, given).otherwise(F.sha2(F.concat_ws("_", name, text, given), 256))


def object_key(digest: Column, name: Column) -> Column:
    """S19."""
    return F.concat(F.lit("uploads/"), F.left(digest, F.lit(16)), F.lit("_"), file_name(name))


def append_log(rows: DataFrame, path: str) -> None:
    """Adds JSON lines."""
    rows.write.mode("append").json(path)


def batch_export(log: DataFrame, batch_id: str, only_unpromoted: bool = False) -> DataFrame:
    """The log's rows, marked with the batch and their number; all of them, or those not yet promoted."""
    rows = log.where("not coalesce(is_promoted, false)") if only_unpromoted else log
    n = rows.agg(F.count(F.lit(1)).alias("batch_size"))
    return rows.withColumn("batch_id", F.lit(batch_id)).crossJoin(F.broadcast(n))


def training_manifest(corrections: DataFrame, language: str | None = None, handwritten_only: bool = True, min_confidence: float | None = None, max_confidence: float | None = None) -> DataFrame:
    """Corrections as training rows; rows without text or image are left out."""
    rows = corrections.where((F.trim("corrected_text") != "") & (F.trim("image_path") != ""))
    if handwritten_only:
        rows = rows.where("is_handwritten")
    if language:
        rows = rows.where(F.lower("language") == language.lower())
    if min_confidence is not None:
        rows = rows.where(F.col("ai_confidence") >= min_confidence)
    if max_confidence is not None:
        rows = rows.where(F.col("ai_confidence") <= max_confidence)
    return rows.select(F.col("image_path").alias("image"), F.col("corrected_text").alias("text"), "language", "script", F.map_from_arrays(F.array(F.lit("source"), F.lit("correction_id")), F.array(F.lit("human_correction"), "correction_id")).alias("metadata"))


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """A folder of JSON lines for each split."""
    rows.write.mode("overwrite").partitionBy(split).json(path)
