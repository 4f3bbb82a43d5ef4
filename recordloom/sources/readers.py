"""Readers: files, layers, manifests, labels, archives, configurations."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions.text import lookup, strip

IMAGES = ("bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp")
LABEL_FILE_COLUMNS = ("filename", "file", "image", "image_path", "path", "name")
LABEL_TEXT_COLUMNS = ("text", "label", "ground_truth", "transcription", "word")


def file_kind(content: Column) -> Column:
    """Pdf, tiff, raster, empty or corrupt, from the first bytes."""
    head = F.hex(F.substring(content, 1, 1024))
    raster = F.exists(F.array(*[F.lit(m) for m in ("FFD8FF", "89504E47", "424D", "47494638", "52494646")]), lambda m: F.startswith(head, m))
    return F.when(F.octet_length(content) == 0, "empty").when(F.contains(head, F.lit("25504446")), "pdf").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff").when(raster, "raster").otherwise("corrupt")


def load_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, content, kind and digest of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", file_kind(F.col("content")).alias("kind"), F.sha2("content", 256).alias("sha256"))


def pages(files: DataFrame, decode: Callable[[bytes, str], list[bytes]] | None = None) -> DataFrame:
    """One row for each page. decode(content, kind) makes the pages; without it a file is one page, as it is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(p, i, b) for p, k, c in zip(pdf["path"], pdf["kind"], pdf["content"], strict=True) if k not in ("empty", "corrupt") for i, b in enumerate(decode(c, k) if decode else [c], 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "content"])

    return files.select("path", "kind", "content").mapInPandas(run, "path string, page_no int, content binary")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON layers (files in name order): keys, area, layer, label, aliases, outer ring, load_ord."""
    schema = """features array<struct<properties:struct<state:string,district:string,tehsil:string,village:string,khasra_number:string,
        area_hectares:double,gis_layer_name:string,data_source_label:string,aliases:array<string>>,
        geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.input_file_name().alias("file"), F.posexplode("features").alias("i", "f"))
    ring = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    order = F.dense_rank().over(Window.orderBy("file")) * 1_000_000 + F.col("i")
    return rows.select("f.properties.*", ring.alias("ring"), order.cast("long").alias("load_ord"))


def ring_is_valid(ring: Column) -> Column:
    """At least four points, closed, finite, with an area."""
    from recordloom.functions.geometry import _edges

    area = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])
    finite = F.forall(ring, lambda p: p["lon"].between(-180, 180) & p["lat"].between(-90, 90))
    return F.coalesce((F.size(ring) >= 4) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1)) & finite & (F.abs(area) > 0), F.lit(False))


def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with numbers from 1; line_no orders the lines of a file, which Spark may read in parts."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).select("file", (F.col("i") + 1).alias("line_no"), "line")


def _one_of(columns: list[str], wanted: tuple[str, ...]) -> str:
    low = {c.lower().strip(): c for c in columns}
    found = [low[w] for w in wanted if w in low]
    if not found:
        raise ValueError(f"none of the columns {wanted} in {columns}")
    return found[0]


def csv_labels(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """File, label, line_no of a delimited file whose columns go by one of several names."""
    rows = spark.read.option("header", "true").option("sep", sep).csv(path)
    return rows.select(F.col(_one_of(rows.columns, LABEL_FILE_COLUMNS)).alias("file"), F.col(_one_of(rows.columns, LABEL_TEXT_COLUMNS)).alias("label"), F.monotonically_increasing_id().alias("line_no"))


def json_labels(spark: SparkSession, path: str) -> DataFrame:
    """File, label, line_no from {file: text}, {file: {text: ...}} or [{file: ..., text: ...}]."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    whole.createOrReplaceTempView("_json_labels")
    rows = spark.sql("SELECT t.pos, t.key, t.value FROM _json_labels, LATERAL variant_explode(v) AS t")
    get = lambda names: F.coalesce(*[F.try_variant_get("value", f"$.{n}", "string") for n in names])
    return rows.select(F.coalesce("key", get(LABEL_FILE_COLUMNS)).alias("file"), F.coalesce(get(LABEL_TEXT_COLUMNS), F.try_variant_get("value", "$", "string")).alias("label"), F.col("pos").cast("long").alias("line_no"))


def safe_member(name: str) -> bool:
    """A path that stays below its folder."""
    p = PurePosixPath(name.replace("\\", "/"))
    return not p.is_absolute() and ".." not in p.parts and ":" not in name


def zip_members(files: DataFrame) -> DataFrame:
    """Members of ZIP files as rows; unsafe ones are listed without content, a file that is no archive gives one row with an issue."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                ok = safe_member(m.filename)
                                yield pd.DataFrame([(path, m.filename, m.filename.rpartition(".")[2].lower(), z.read(m) if ok else None, None if ok else "unsafe_path")], columns=["path", "member", "extension", "content", "issue"])
                except zipfile.BadZipFile:
                    yield pd.DataFrame([(path, None, None, None, "not_an_archive")], columns=["path", "member", "extension", "content", "issue"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, extension string, content binary, issue string")


def is_image(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).isin(*IMAGES)


def ground_truth(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, issues) from lines of a file name, white space and the transcription."""
    p = r"^\s*(\S+)\s+(\S.*?)\s*$"
    rows = lines.where(F.trim("line") != "").withColumns({"image": F.regexp_extract("line", p, 1), "text": F.regexp_extract("line", p, 2)})
    return rows.where("image != ''").select("line_no", "image", "text"), rows.where("image = ''").select("line_no", "line", F.lit("malformed").alias("issue"))


def state_configs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Configuration files as dimensions: terms, units, patterns, rules (all with state)."""
    whole = spark.read.text(path, wholetext=True).select(F.upper(F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1)).alias("state"), "value")
    c = whole.select("state", F.from_json("value", "terminology map<string,array<string>>, unit_conversions_to_hectares map<string,double>, fields map<string,struct<type:string,required:boolean,patterns:array<string>>>, validation_rules map<string,struct<min:double,max:double,pattern:string,min_length:int,max_length:int,message:string>>").alias("c"))
    fields = c.select("state", F.explode("c.fields").alias("field_name", "f"))
    return {
        "terms": c.select("state", F.explode("c.terminology").alias("field_name", "terms")).select("state", "field_name", F.posexplode("terms").alias("term_ord", "term")),
        "units": c.select("state", F.explode("c.unit_conversions_to_hectares").alias("unit", "hectares")),
        "patterns": fields.select("state", "field_name", F.col("f.type").alias("type"), F.col("f.required").alias("required"), F.posexplode_outer("f.patterns").alias("pattern_ord", "pattern")),
        "rules": c.select("state", F.explode("c.validation_rules").alias("field_name", "r")).select("state", "field_name", "r.*"),
    }


# Codes and names of states, and the configuration file of each.
STATE_FILES = {
    "ka": "karnataka", "karnataka": "karnataka", "tn": "tamilnadu", "tamilnadu": "tamilnadu", "tamil_nadu": "tamilnadu", "mh": "maharashtra", "maharashtra": "maharashtra",
    "br": "bihar", "bihar": "bihar", "up": "up", "uttar_pradesh": "up", "mp": "mp", "madhya_pradesh": "mp",
}


def with_state_config(documents: DataFrame, config: DataFrame, default: str = "DEFAULT", files: dict[str, str] = STATE_FILES) -> DataFrame:
    """Each document's rows of a dimension: those of its state's file, else of the file named as its code, else of the default one."""
    code = F.lower(strip(F.coalesce("state", F.lit(default))))
    known = F.broadcast(config.select(F.col("state").alias("config_state")).distinct())  # a row for each configuration file
    placed = documents.withColumns({"_file": F.upper(lookup(files, code)), "_code": F.upper(code)})
    for key, mark in (("_file", "_has_file"), ("_code", "_has_code")):
        placed = placed.join(known.select(F.col("config_state").alias(key), F.lit(True).alias(mark)), key, "left")
    placed = placed.withColumn("config_state", F.when(F.col("_has_file"), F.col("_file")).when(F.col("_has_code"), F.col("_code")).otherwise(default))
    return placed.drop("_file", "_code", "_has_file", "_has_code").join(config.withColumnRenamed("state", "config_state"), "config_state")


def flat_lines(documents: DataFrame) -> DataFrame:
    """Pages of blocks of lines as rows in order."""
    pages_ = documents.select("document_id", F.posexplode("pages").alias("page_i", "p"))
    blocks = pages_.select("document_id", "page_i", F.coalesce("p.page_number", F.col("page_i") + 1).alias("page_no"), F.posexplode("p.blocks").alias("block_i", "b"))
    return blocks.select("document_id", "page_no", "block_i", F.posexplode("b.lines").alias("line_i", "l")).select("document_id", "page_no", "block_i", "line_i", "l.*")


def unannotated(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images without a label, as a template with empty texts."""
    return files.where(is_image(F.col("path"))).join(annotations.select(F.col("image").alias("path")), "path", "left_anti").select(F.col("path").alias("image"), F.lit("").alias("text"))
