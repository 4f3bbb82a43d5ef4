"""Training data: manifests, splits, leakage, audits and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.text import _c, strip

RATIOS = (0.8, 0.1, 0.1)
RARE = 50


def first_seen(rows: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """Adds is_duplicate: whether an earlier row has the key."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def manifest(lines: DataFrame, known_images: DataFrame | None = None, corrupt_images: DataFrame | None = None, default_language: str = "kannada") -> DataFrame:
    """Lines (line_no, line) as rows with issue: invalid_json, missing_field, empty_text, duplicate_path, missing_image, corrupt_image or null.

    Blank lines and comments (#) are skipped. Aliases: image or image_path, text or ground_truth.
    """
    rows = lines.where(~strip("line").rlike("^(?:#.*)?$"))
    v = F.from_json("line", "image string, image_path string, text string, ground_truth string, language string, script string, metadata map<string,string>, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = rows.withColumn("_v", v)
    bad = F.col("_v").isNull() | F.col("_v._corrupt").isNotNull()
    rows = rows.select("line_no", bad.alias("_bad"), F.coalesce("_v.image", "_v.image_path").alias("image"), F.coalesce("_v.text", "_v.ground_truth").alias("text"), F.coalesce("_v.language", F.lit(default_language)).alias("language"), F.col("_v.script").alias("script"), F.col("_v.metadata").alias("metadata"))
    rows = first_seen(rows, "image", "line_no")
    flag = lambda known, name: rows.join(known.select("image").distinct().withColumn(name, F.lit(True)), "image", "left") if known is not None else rows.withColumn(name, F.lit(None).cast("boolean"))
    rows = flag(known_images, "_known")
    rows = flag(corrupt_images, "_corrupt_image")
    issue = (
        F.when(F.col("_bad"), "invalid_json")
        .when(F.col("image").isNull() | F.col("text").isNull(), "missing_field")
        .when(strip("text") == "", "empty_text")
        .when(F.col("is_duplicate"), "duplicate_path")
        .when(F.lit(known_images is not None) & F.col("_known").isNull(), "missing_image")
        .when(F.coalesce("_corrupt_image", F.lit(False)), "corrupt_image")
    )
    return rows.withColumn("issue", issue).drop("_bad", "_known", "_corrupt_image", "is_duplicate")


def calibration_rows(rows: DataFrame) -> DataFrame:
    """engine, score, label, and is_valid; columns engine_name|engine|recognizer, raw_score|confidence|score, label|is_correct|correct, or texts that are compared."""
    have = set(rows.columns)
    pick = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(None).cast("string"))
    score = pick("raw_score", "confidence", "score").try_cast("double")
    raw = F.lower(strip(pick("label", "is_correct", "correct")))
    label = F.when(raw.isin("1", "1.0", "true", "yes"), 1).when(raw.isin("0", "0.0", "false", "no"), 0)
    texts = (strip(pick("predicted_text", "pred")) == strip(pick("ground_truth", "gt"))).cast("int")
    out = rows.select("*", pick("engine_name", "engine", "recognizer").alias("_engine"), score.alias("_score"), F.coalesce(label, texts).alias("_label"))
    sound = F.col("_engine").isNotNull() & F.coalesce(~F.isnan("_score") & F.col("_score").between(0, 1), F.lit(False)) & F.col("_label").isNotNull()
    return out.select(F.col("_engine").alias("engine"), F.col("_score").alias("score"), F.col("_label").alias("label"), sound.alias("is_valid"))


def text_kind(metadata: Column, path: Column | str) -> Column:
    """handwritten, printed or unknown, from the metadata, then from the path."""
    said = F.lower(F.coalesce(F.try_element_at(metadata, F.lit("source_type")), F.try_element_at(metadata, F.lit("source")), F.lit("")))
    p = F.lower(_c(path))
    test = lambda c: F.when(c.rlike("hand|hw|written"), "handwritten").when(c.rlike("print|synth|font"), "printed")
    return F.coalesce(test(said), test(p), F.lit("unknown"))


def portable_order(key: Column | str, seed: int = 42) -> Column:
    """A shuffled order that any engine can repeat: the SHA-256 of seed and key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), _c(key).cast("string")), 256)


def sizes(n: Column, ratios: tuple[float, float, float] = RATIOS) -> tuple[Column, Column]:
    """Numbers of training and validation rows of a group of n: one row trains, of two the second validates."""
    train_share, val_share, test_share = ratios
    train = F.when(n <= 1, n).when(n == 2, 1).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.bround(n * train_share).cast("long"))))
    rest = n - train
    val = F.bround(n * val_share).cast("long")
    if val_share > 0 and test_share > 0:
        val = F.when(rest > 1, F.greatest(F.lit(1), F.least(rest - 1, val))).otherwise(rest)
    else:
        val = rest if val_share > 0 else F.lit(0)
    return train.cast("long"), F.when(n == 2, 1).when(n <= 1, 0).otherwise(val).cast("long")


def stratified_split(rows: DataFrame, stratum: str, key: str, ratios: tuple[float, float, float] = RATIOS, seed: int = 42) -> DataFrame:
    """Adds split: train, val or test, by place in the stratum's portable order.

    Places are counted without one task for each stratum: rows are ranked within 4,096 slices of the
    order, and slices are summed up.
    """
    slices = F.conv(F.substring("_o", 1, 3), 16, 10).cast("int")
    keyed = rows.withColumn("_o", portable_order(key, seed)).withColumn("_s", slices)
    counts = keyed.groupBy(stratum, "_s").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(stratum)
    offsets = counts.withColumn("_before", F.sum("_k").over(w.orderBy("_s")) - F.col("_k")).withColumn("_n", F.sum("_k").over(w)).withColumnRenamed(stratum, "_stratum")
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_s").orderBy("_o", key)))
    out = ranked.join(offsets.withColumnRenamed("_s", "_s2"), F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_s") == F.col("_s2")))
    train, val = sizes(F.col("_n"), ratios)
    place = F.col("_before") + F.col("_r")
    return out.withColumn("split", F.when(place <= train, "train").when(place <= train + val, "val").otherwise("test")).select(*rows.columns, "split")


def group_split(rows: DataFrame, groups: list[str], key: str, ratios: tuple[float, float, float] = RATIOS, seed: int = 42) -> DataFrame:
    """All rows of a writer (else of a document, else the row itself) go to one split."""
    unit = F.coalesce(*[F.concat(F.lit(f"{g}:"), F.col(g).cast("string")) for g in groups], F.concat(F.lit("row:"), F.col(key).cast("string")))
    keyed = rows.withColumn("_unit", unit)
    units = stratified_split(keyed.select("_unit", F.lit(1).alias("_all")).distinct(), "_all", "_unit", ratios, seed)
    return keyed.join(units.select("_unit", "split"), "_unit").drop("_unit")


def split_counts(rows: DataFrame, stratum: str, split: str = "split") -> DataFrame:
    """A20."""
    out = rows.groupBy(stratum).pivot(split, ["train", "val", "test"]).count().na.fill(0, ["train", "val", "test"])
    return out.withColumn("total", F.col("train") + F.col("val") + F.col("test"))


def leakage(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """For each pair of splits the number of keys that are in both."""
    own = rows.where(F.col(key).isNotNull()).select(key, split).distinct()
    sets = own.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("n_shared"))


def assignment_digest(rows: DataFrame, sample: str = "sample_id", split: str = "split", digest: str = "sha256") -> DataFrame:
    """SHA-256 of all lines id:split:sha, sorted. One digest of one text: a row for each sample goes to one task."""
    lines = rows.select(F.concat_ws(":", sample, split, digest).alias("l"))
    return lines.agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list("l")), "\n"), F.lit("\n")), 256).alias("digest"))


def label_audit(rows: DataFrame, text: str) -> DataFrame:
    """Characters by count, with class and whether rare."""
    chars = rows.select(F.explode(F.split(text, "")).alias("ch")).where("ch != ''")
    kind = F.when(F.col("ch").rlike(r"^\p{L}$"), "letter").when(F.col("ch").rlike(r"^\p{M}$"), "mark").when(F.col("ch").rlike(r"^\p{N}$"), "number").when(F.col("ch").rlike(r"^\s$"), "space").otherwise("other")
    return chars.groupBy("ch").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", kind).withColumn("rare", F.col("n") < RARE)


def conjuncts(rows: DataFrame, text: str) -> DataFrame:
    """Kannada conjuncts (consonant, virama, consonant) by count."""
    return rows.select(F.explode(F.regexp_extract_all(text, F.lit("([ಕ-ಹ]್[ಕ-ಹ])"), F.lit(1))).alias("conjunct")).groupBy("conjunct").agg(F.count(F.lit(1)).alias("n"))


def dataset_audit(rows: DataFrame, language: str, kind: str, enough: int = 1000) -> DataFrame:
    """Numbers by language and kind with a verdict on their sufficiency."""
    return rows.groupBy(language, kind).agg(F.count(F.lit(1)).alias("n")).withColumn("sufficiency", F.when(F.col("n") == 0, "none").when(F.col("n") < enough // 10, "insufficient").when(F.col("n") < enough, "limited").otherwise("sufficient"))


def builder_stats(rows: DataFrame, text: str) -> DataFrame:
    """Rows, repeated texts, mean length, share with conjuncts."""
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.count(text) - F.count_distinct(text)).alias("n_repeated"), F.avg(F.length(text)).alias("mean_length"), F.avg(F.col(text).rlike("[ಕ-ಹ]್[ಕ-ಹ]").cast("double")).alias("conjunct_share"))


def exclude(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """J14, U03."""
    return rows.join(other.select(key).distinct(), key, "left_anti")


def merged(real: DataFrame, synthetic: DataFrame, held_out: DataFrame | None = None, factor: int = 15) -> DataFrame:
    """Real rows, each synthetic training row factor times, and held-out rows, with origin and copy_no."""
    one = lambda df, o: df.withColumns({"origin": F.lit(o), "copy_no": F.lit(1)})
    times = synthetic.where("split = 'train'").withColumn("origin", F.lit("synthetic")).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(factor))))
    out = one(real, "real").unionByName(times)
    return out if held_out is None else out.unionByName(one(held_out, "held_out"))


def coverage_sample(rows: DataFrame, key: str, tags: str, per_tag: int, seed: int = 42) -> DataFrame:
    """Up to per_tag rows of each tag in portable order; each row once, with the tags it was taken for."""
    tagged = rows.select(key, F.explode(tags).alias("tag")).distinct()
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(portable_order(key, seed), key))
    return tagged.withColumn("_r", rank).where(F.col("_r") <= per_tag).groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def balanced(rows: DataFrame, key: str, tags: str, per_tag: int, total: int, most: int = 3, seed: int = 42) -> DataFrame:
    """A coverage sample, filled up in portable order to total rows, then rows of scarce tags repeated up to most times."""
    covered = coverage_sample(rows, key, tags, per_tag, seed).select(key)
    missing = rows.join(covered, key, "left_anti").orderBy(portable_order(key, seed), key)
    fill = missing.limit(total).withColumn("_r", F.lit(1)).select(key)
    n = covered.agg(F.count(F.lit(1)).alias("n"))
    ranked = fill.withColumn("_o", portable_order(key, seed)).withColumn("_r", F.row_number().over(Window.orderBy("_o", key)))  # at most total rows
    filled = ranked.crossJoin(F.broadcast(n)).where(F.col("_r") <= F.lit(total) - F.col("n")).select(key)
    chosen = covered.unionByName(filled)
    scarce = rows.select(key, F.explode(tags).alias("tag")).join(chosen, key, "left_semi").groupBy("tag").agg(F.count(F.lit(1)).alias("k"))
    times = rows.select(key, F.explode_outer(tags).alias("tag")).join(chosen, key, "left_semi").join(scarce, "tag", "left")
    copies = times.groupBy(key).agg(F.greatest(F.lit(1), F.least(F.lit(most), F.max(F.ceil(F.lit(per_tag) / F.col("k"))))).cast("int").alias("copies"))
    return rows.join(copies, key).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1))))).drop("copies")


def labels_by_stem(images: DataFrame, labels: DataFrame, path: str = "path") -> DataFrame:
    """Images with the last label of their file stem."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    last = labels.groupBy(stem("file").alias("stem")).agg(F.max_by("label", "line_no").alias("label"))
    return images.withColumn("stem", stem(path)).join(last, "stem", "left")


def promotes(base_cer, new_cer, base_accuracy, new_accuracy, least_gain: float = 0.01) -> Column:
    """a strictly lower error and a gain in accuracy."""
    return (_c(new_cer) < _c(base_cer)) & (_c(new_accuracy) - _c(base_accuracy) >= least_gain)
