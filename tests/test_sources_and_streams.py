import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from recordloom.sources import readers, writers
from recordloom.streaming import arrivals


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.tif").write_bytes(b"II*\0xxxx")
    (tmp_path / "c.png").write_bytes(b"\x89PNG....")
    (tmp_path / "d.bin").write_bytes(b"what")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("ok/a.png", b"x")
        z.writestr("../evil.png", b"y")
    (tmp_path / "e.zip").write_bytes(buffer.getvalue())
    files = readers.load_files(spark, str(tmp_path))
    assert {r.path.rpartition("/")[2]: r.kind for r in files.collect()} == {"a.pdf": "pdf", "b.tif": "tiff", "c.png": "raster", "d.bin": "corrupt", "e.zip": "corrupt"}
    assert readers.pages(files, lambda c, k: [c, c] if k == "tiff" else [c]).count() == 4
    got = {r.member: r.issue for r in readers.zip_members(files.where("path like '%.zip' or path like '%.bin'")).collect()}
    assert got == {"ok/a.png": None, "../evil.png": "unsafe_path", None: "not_an_archive"}
    assert readers.unannotated(files, spark.createDataFrame([("x",)], "image string")).count() == 2


def test_layers_labels_and_configs(spark, tmp_path):
    square = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    (tmp_path / "l.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"state": "KA", "khasra_number": "1", "area_hectares": 2.0, "aliases": ["1a"]}, "geometry": {"type": "Polygon", "coordinates": square}}]}))
    (r,) = readers.geojson(spark, str(tmp_path / "l.geojson")).select("*", readers.ring_is_valid(F.col("ring")).alias("ok")).collect()
    assert (r.state, r.aliases, len(r.ring), r.ok) == ("KA", ["1a"], 4, True)
    (tmp_path / "l.csv").write_text("Filename,Label\na.png,x\nb.png,y\n")
    assert {(r.file, r.label) for r in readers.csv_labels(spark, str(tmp_path / "l.csv")).collect()} == {("a.png", "x"), ("b.png", "y")}
    (tmp_path / "bad.csv").write_text("p,q\n1,2\n")
    with pytest.raises(ValueError):
        readers.csv_labels(spark, str(tmp_path / "bad.csv"))
    for i, value in enumerate(({"a.png": "x"}, {"a.png": {"text": "x"}}, [{"file": "a.png", "text": "x"}])):
        (tmp_path / f"{i}.json").write_text(json.dumps(value))
        assert [(r.file, r.label) for r in readers.json_labels(spark, str(tmp_path / f"{i}.json")).collect()] == [("a.png", "x")]
    (tmp_path / "gt.txt").write_text("a.png  some words here\n\nbroken\n")
    good, bad = readers.ground_truth(readers.manifest_lines(spark, str(tmp_path / "gt.txt")))
    assert [(r.line_no, r.image, r.text) for r in good.collect()] == [(1, "a.png", "some words here")] and [r.line_no for r in bad.collect()] == [3]
    conf = tmp_path / "states"
    conf.mkdir()
    body = {"terminology": {"owner": ["Owner"]}, "unit_conversions_to_hectares": {"acre": 0.4}, "fields": {"owner": {"type": "name", "required": True, "patterns": ["a", "b"]}}, "validation_rules": {"owner": {"min_length": 2}}}
    (conf / "default.json").write_text(json.dumps(body))
    dims = readers.state_configs(spark, str(conf))
    assert dims["patterns"].count() == 2 and dims["terms"].first().term == "Owner" and dims["rules"].first().min_length == 2
    docs = spark.createDataFrame([("d", "XX")], "document_id string, state string")
    assert readers.with_state_config(docs, dims["units"]).first().hectares == 0.4
    units = spark.createDataFrame([("DEFAULT", 0.4), ("KARNATAKA", 0.5), ("ZZ", 0.6)], "state string, hectares double")
    many = spark.createDataFrame([("a", "KA"), ("b", " karnataka "), ("c", "zz"), ("d", "Tamil_Nadu"), ("e", None)], "document_id string, state string")
    assert {r.document_id: r.hectares for r in readers.with_state_config(many, units).collect()} == {"a": 0.5, "b": 0.5, "c": 0.6, "d": 0.4, "e": 0.4}


def test_writers(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "document_id string, v int")
    new = spark.createDataFrame([("a", 9)], "document_id string, v int")
    assert sorted(tuple(r) for r in writers.replaced(old, new, "document_id").collect()) == [("a", 9), ("b", 3)]
    assert sorted(tuple(r) for r in writers.upserted(old, new.union(spark.createDataFrame([("c", 5)], new.schema)), ["document_id"]).collect()) == [("a", 1), ("a", 2), ("b", 3), ("c", 5)]
    parent = spark.createDataFrame([("a",), ("b",)], "id string")
    out = writers.deleted({"documents": parent, "fields": old}, new, "documents")
    assert [r.id for r in out["documents"].collect()] == ["b"] and [r.v for r in out["fields"].collect()] == [3]
    row = spark.createDataFrame([("x" * 64, "f n.pdf", "t"), ("short", "f", "t")], "h string, n string, t string").select(writers.sound_hash(F.col("h"), F.col("n"), F.col("t")).alias("s"), writers.object_key(F.col("h"), F.col("n")).alias("k")).collect()
    assert row[0].s == "x" * 64 and len(row[1].s) == 64 and row[0].k == "uploads/" + "x" * 16 + "_f_n.pdf"
    schema = "correction_id string, image_path string, corrected_text string, language string, script string, is_handwritten boolean, ai_confidence double, is_promoted boolean"
    log = spark.createDataFrame([("1", "a", "x", "Kannada", "K", True, 0.4, True), ("2", "b", " ", "kannada", "K", True, 0.4, False), ("3", "c", "z", "hindi", "D", True, 0.9, None)], schema)
    assert [r.image for r in writers.training_manifest(log, language="KANNADA", max_confidence=0.5).collect()] == ["a"]
    assert writers.batch_export(log, "b1").first().batch_size == 3 and writers.batch_export(log, "b1", only_unpromoted=True).count() == 2
    writers.append_log(log, str(tmp_path / "log"))
    writers.append_log(log, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    writers.write_splits(log.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=train").exists()


def collected(spark, df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("d1", "h1", "2024-01-01T00:00:00", "upload"), ("d2", "h1", "2024-01-01T00:01:00", "upload"), ("d1", "h2", "2024-01-01T00:02:00", "start"), ("d1", "h3", "2024-01-01T00:03:00", "fail"), ("d1", "h4", "2024-01-01T00:04:00", "upload"), ("d2", "h5", "2024-01-01T00:05:00", "done")]
    (src / "a.json").write_text("\n".join(json.dumps(dict(zip(("document_id", "digest", "ts", "kind"), r, strict=True))) for r in rows))
    stream = arrivals.arrivals(spark, str(src), "document_id string, digest string, ts timestamp, kind string")
    assert collected(spark, arrivals.deduplicated(stream, "digest", "ts"), "append", "dedup", tmp_path).count() == 5
    got = {r.document_id: (r.status, r.n_ignored) for r in collected(spark, arrivals.statuses(stream), "update", "status", tmp_path).collect()}
    assert got == {"d1": ("UPLOADED", 0), "d2": ("UPLOADED", 1)}
    events = stream.withColumnsRenamed({"document_id": "review_id", "kind": "state"}).withColumn("event_id", F.col("digest"))
    assert {r.review_id: r.state for r in collected(spark, arrivals.review_states(events), "complete", "review", tmp_path).collect()} == {"d1": "upload", "d2": "done"}
    out = tmp_path / "out"
    arrivals.persisted(stream.select("document_id", "digest"), str(out), str(tmp_path / "cp"), "document_id").awaitTermination(120)
    assert spark.read.parquet(str(out / "v0")).count() == 6
    arrivals.log(stream, str(tmp_path / "log"), str(tmp_path / "cl")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    assert collected(spark, arrivals.windowed_counts(stream, "ts", "document_id"), "complete", "win", tmp_path).count() == 2
