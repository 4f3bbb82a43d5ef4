import json

from pyspark.sql import functions as F

from recordloom.operators import confidence, datasets, duplicates, extract, layout, metrics, numbers, parcels, records, review, search, translate, validate


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_domain_checks(spark):
    status = lambda f, v: one(spark, f(F.lit(v).cast("string")))["status"]
    assert [status(validate.survey_number, v) for v in ("125/1A", "abc", "0/1", "", None)] == ["VALID", "INVALID", "WARNING", "INVALID", "INVALID"]
    assert [status(validate.khata_number, v) for v in ("K-12", "102", "12/34/5", "none")] == ["VALID", "VALID", "WARNING", "INVALID"]
    assert [status(validate.extent, v) for v in ("1-20", "1-45", "2.5", "lots")] == ["VALID", "WARNING", "VALID", "WARNING"]
    assert [status(validate.name_or_place, v) for v in ("Anil", "1", " ")] == ["VALID", "INVALID", "INVALID"]
    assert [status(validate.hissa_number, v) for v in ("1A", "a b")] == ["VALID", "WARNING"]
    assert [status(validate.mutation_number, v) for v in ("MR 12", "MR")] == ["VALID", "WARNING"]
    texts = F.array(F.lit("Owner Anil Kumar"), F.lit("Village Shirur"))
    ground = lambda v: one(spark, validate.grounding(F.lit(v), F.lit("Owner Anil Kumar"), texts))
    assert [ground(v) for v in ("Anil", "Shirur", "Shirur Anil", "Ravi")] == ["own_region", "other_region", "tokens", "none"]
    assert one(spark, validate.field_verdict(F.lit("owner_name"), F.lit("Ravi"), F.lit("none")))["status"] == "WARNING"


def test_rules(spark):
    f = spark.createDataFrame([("d", "UP", "land_area", "-1", None), ("d", "UP", "record_date", "31/02/2020", None), ("d", "UP", "owner", "A", None), ("d", "UP", "land_area2", "x", None)], "document_id string, state string, field_name string, raw_value string, normalized_value string")
    rules = spark.createDataFrame([("UP", "land_area", 0.0, None, None, None, None, None), ("UP", "land_area2", 0.0, None, None, None, None, None), ("UP", "record_date", None, None, None, None, None, True), ("UP", "owner", None, None, "[A-Z]{2}", 2, None, None)], "state string, field_name string, min double, max double, pattern string, min_length int, max_length int, is_date boolean")
    got = {(r.field_name, r.rule, r.severity) for r in validate.rule_items(f, rules).collect()}
    assert got == {("land_area", "min", "error"), ("land_area2", "numeric_type", "error"), ("record_date", "calendar_date", "error"), ("owner", "pattern", "error"), ("owner", "min_length", "warning")}


def test_cross_record(spark):
    schema = "document_id string, land_area double, site_area string, built_up_area string, survey_number string, khata_number string, record_date string, khasra_number string"
    records = spark.createDataFrame([("ok", 2.0, None, None, "12", None, "15/08/2023", "101"), ("bad", 5.0, "100", "200", "2019", None, "31/02/2020", "9"), ("none", 1.0, None, None, None, None, None, None)], schema)
    tables = spark.createDataFrame(
        [("ok", ["Khasra", "Area (Ha)"], [["101", "1.2500"], ["102", "0.7500"]]), ("ok", ["Owner", "Share"], [["A", "1/2"], ["B", "1/2"]]), ("bad", ["Khasra", "Area (Ha)"], [["101", "1.0"], ["102", "1.0"]])], "document_id string, headers array<string>, rows array<array<string>>"
    )
    got = {r.document_id: r for r in validate.cross_record(records, tables).collect()}
    assert got["ok"].area_sum_matches is True and got["ok"].share_sum_matches is True and got["ok"].passed and got["ok"].khasra_in_tables
    assert got["bad"].area_sum_matches is False and set(got["bad"].inconsistencies) == {"area_sum", "site_area", "survey_number_is_year", "record_date"}
    assert got["bad"].khasra_count_matches is True and got["bad"].khasra_in_tables is False
    assert got["none"].area_sum_matches is None and got["none"].share_sum_matches is None


def test_parcels(spark):
    ring = [(77.48, 12.91), (77.49, 12.91), (77.49, 12.92), (77.48, 12.92), (77.48, 12.91)]
    schema = "state string, district string, tehsil string, village string, khasra_number string, area_hectares double, gis_layer_name string, aliases array<string>, ring array<struct<lon:double,lat:double>>, load_ord long"
    layer = spark.createDataFrame([("KA", "Bengaluru Urban", "South", "Kengeri", "42/1", 0.8094, "l", ["42-1"], ring, 1), ("UP", "Lucknow", "M", "Rampur", "142/1", 0.45, "l", None, ring, 2)], schema)
    registry = parcels.registry(layer)
    assert registry.count() == 3
    probes = spark.createDataFrame(
        [
            ("a", "KA", "Bengaluru Urban", "South", "Kengeri", "42/1", 0.8094, 77.485, 12.915),
            ("b", "ka", "x", None, "Kengeri Hobli", "42-1", 0.8, None, None),
            ("c", "UP", "Lucknow", "M", "Rampur", "142/1", 2.85, None, None),
            ("d", "UP", "Lucknow", "M", "Rampur", "142/1", 0.45, 77.209, 28.6139),
            ("e", "UP", "Lucknow", "M", "Rampur", "999999", 0.45, None, None),
            ("f", "UP", "Lucknow", "M", "Rampur", None, 0.45, None, None),
        ],
        "document_id string, state string, district string, tehsil string, village string, khasra_number string, area double, lon double, lat double",
    )
    got = {r.document_id: (r.gis_status, r.matched_by) for r in parcels.verdict(parcels.lookup(probes, registry)).collect()}
    assert got == {"a": ("MATCH", "exact"), "b": ("MATCH", "part"), "c": ("MISMATCH", "exact"), "d": ("MISMATCH", "exact"), "e": ("UNKNOWN", None), "f": ("INSUFFICIENT_DATA", None)}


def test_duplicates(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 3, "x"), ("d", 4, None), ("e", 5, None)], "id string, n int, h string")
    assert {r.id: r.duplicate_of for r in duplicates.exact(rows, "id", "n", "h").collect()} == {"a": None, "b": "a", "c": "b", "d": None, "e": None}
    same = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    assert one(spark, duplicates.field_digest(same("a", "1", "b", "2"))) == one(spark, duplicates.field_digest(same("b", "2", "a", "1", "c", " ")))
    assert one(spark, duplicates.hamming(F.lit("0" * 64), F.lit("0" * 62 + "0f"))) == 4
    p = spark.createDataFrame([("p", "0" * 64), ("q", "f" * 64)], "id string, h string")
    s = spark.createDataFrame([("s", "1" + "0" * 63), ("t", "7" + "0" * 63)], "id string, h string")
    assert [(r.id, r.sample_id, r.distance) for r in duplicates.perceptual_matches(p, s, "id", "h").collect()] == [("p", "s", 1)]
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 0)], "id long, v array<double>, b int")
    assert {r.id: r.other_id for r in duplicates.nearest_in_block(v, "id", "v", "b").collect()} == {1: 2, 2: 1, 3: 2}
    assert len(one(spark, duplicates.hash_embedding(F.array(F.lit("a"), F.lit("b")), 16))) == 16


def test_confidence(spark):
    t, f = F.lit(True), F.lit(False)
    n = F.lit(0)
    s = one(spark, confidence.field_score(F.lit(0.9), F.lit("regex"), n, n, n, F.lit("land_area"), t, t, t, f, t, t, f, f))
    assert abs(s - round(0.9 * 0.95 * (0.85 + 0.15), 4)) < 1e-9
    s = one(spark, confidence.field_score(F.lit(0.9), F.lit("regex"), F.lit(1), n, n, F.lit("owner"), t, t, t, f, t, t, f, f))
    assert s == 0.0
    assert one(spark, confidence.token_geometric_mean(F.array(F.lit(0.25), F.lit(1.0)))) == 0.5
    assert one(spark, confidence.token_mean(F.array(F.lit(0.5), F.lit(1.5)))) is None
    assert one(spark, confidence.token_min(F.array(F.lit(0.5), F.lit(0.2)))) == 0.2
    d = one(spark, confidence.disagreement(F.lit("a"), F.lit(0.5), F.lit("b"), F.lit(0.9)))
    assert (d.value, d.strategy, round(d.confidence, 3)) == ("b", "handwriting_high_confidence", 0.4)
    d = one(spark, confidence.resolve_conflicts(F.lit("a"), F.lit(0.8), F.array(F.struct(F.lit("A ").alias("text"), F.lit(0.9).alias("confidence")), F.struct(F.lit("c").alias("text"), F.lit(0.8).alias("confidence")))))
    assert (d.value, d.conflict, round(d.confidence, 2)) == ("a", True, 0.5)
    e = lambda v, src, st: one(spark, confidence.evidence_score(F.lit(v), F.lit(src), F.lit(st), t, t, f, f))
    assert abs(e("Anil", "Owner Anil", "VALID") - (0.35 + 0.3 + 0.2 + 0.15 * 0.85)) < 1e-4
    assert e("Ravi", "Owner Anil", "VALID") == 0.25 and e("", "x", "VALID") == 0.0
    docs = spark.createDataFrame([("a", False, [], [], None), ("b", False, [], [], None)], "document_id string, has_errors boolean, inconsistencies array<string>, gis_reasons array<string>, duplicate_of string")
    scored = spark.createDataFrame([("a", "x", 0.9, False), ("a", "y", 0.95, False)], "document_id string, field_name string, score double, conflict boolean")
    got = {r.document_id: (r.confidence, r.requires_review, len(r.review_reasons)) for r in confidence.documents(scored, docs).collect()}
    assert got == {"a": (0.925, False, 0), "b": (0.0, True, 1)}


def test_calibration(spark):
    rows = [("e", (i % 100) / 100, int((i * 37) % 100 < (i % 100))) for i in range(2000)] + [("few", 0.5, 1)] * 10
    p = confidence.fit_calibrators(spark.createDataFrame(rows, "engine string, score double, label int"))
    (r,) = p.collect()
    assert r.engine == "e" and r.n_samples == 2000 and r.a > 3 and 0.1 <= r.temperature <= 5
    probes = spark.createDataFrame([("e", 0.9), ("e", 0.1), ("few", 0.9)], "engine string, score double")
    got = [(x.engine, x.state) for x in confidence.calibrate(probes, p).orderBy("engine", "score").collect()]
    assert got == [("e", "CALIBRATED"), ("e", "CALIBRATED"), ("few", "UNCALIBRATED")]
    bins = confidence.reliability(spark.createDataFrame([(0.3, 1), (0.95, 1), (1.0, 0)], "s double, y int"), "s", "y").orderBy("bin").collect()
    assert [b.n for b in bins] == [0, 0, 1, 0, 0, 0, 0, 0, 0, 2] and bins[0].confidence == 0.05


def test_layout(spark):
    a = F.array(*[F.lit(float(v)) for v in (1, 10, 20, 30, 31)])
    assert one(spark, layout.anchored_clusters(a, 12.0)) == [0, 0, 1, 1, 1]
    assert one(spark, layout.mean_clusters(a, 12.0)) == [0, 0, 1, 1, 1]
    words = spark.createDataFrame([("l", "Hel", 0.0, 10.0, 0.0, 10.0), ("l", "lo", 10.5, 20.0, 0.0, 10.0), ("l", "you", 25.0, 40.0, 0.0, 10.0)], "line string, text string, x_min double, x_max double, y_min double, y_max double")
    assert layout.spaced_text(words, ["line"]).first().text == "Hello you"
    lines = spark.createDataFrame([("p", 0.0, 10.0, 0.0), ("p", 15.0, 25.0, 0.0), ("p", 70.0, 80.0, 0.0)], "page string, y_min double, y_max double, x_min double")
    assert [r.block for r in layout.blocks(lines, ["page"]).orderBy("y_min").collect()] == [0, 0, 1]
    boxes = F.array(*[F.struct(F.lit(float(x)).alias("x_min"), F.lit(0.0).alias("y_min"), F.lit(float(y)).alias("x_max"), F.lit(1.0).alias("y_max")) for x, y in ((0, 10), (2, 9), (9, 30))])
    assert [(b.x_min, b.x_max) for b in one(spark, layout.merged_boxes(boxes))] == [(0, 10), (9, 30)]
    assert one(spark, layout.markdown(F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.lit("1"))))) == "| a | b |\n| --- | --- |\n| 1 |  |"
    w = one(spark, layout.word_boxes(F.lit("ab c"), F.struct(F.lit(0.0).alias("x_min"), F.lit(4.0).alias("x_max"))))
    assert [(x.text, x.x_min, x.x_max) for x in w] == [("ab", 0.0, 2.0), ("c", 3.0, 4.0)]
    b = spark.createDataFrame([("p", 0.0, 0.0, 5.0, 10.0), ("p", 10.0, 3.0, 15.0, 13.0), ("p", 0.0, 40.0, 5.0, 50.0)], "page string, x_min double, y_min double, x_max double, y_max double")
    assert [r.line for r in layout.line_clusters(b, ["page"]).orderBy("y_min").collect()] == [0, 0, 1]
    assert {(r.row_no, r.column_no) for r in layout.grid(b, ["page"], 5.0).collect()} == {(0, 0), (0, 1), (1, 0)}
    assert tuple(one(spark, layout.table_size(F.array(F.struct(F.lit(0).alias("row"), F.lit(2).alias("col")))))) == (1, 3)


def test_extraction(spark):
    lines = spark.createDataFrame([("d", 0, "Survey No: 42/1"), ("d", 1, "Area 2.5 acre"), ("d", 2, "Owner"), ("d", 3, "Anil Kumar")], "document_id string, line_no int, text string")
    got = {r.field_name: (r.raw_value, r.raw_unit) for r in extract.by_patterns(lines, {"survey": [r"Khasra:? (\S+)", r"Survey No: (\S+)"], "area": [r"([0-9.]+) (acre)"]}).collect()}
    assert got == {"survey": ("42/1", None), "area": ("2.5", "acre")}
    assert {r.field_name: r.raw_value for r in extract.adjacent_values(lines, {"owner": ["Owner"], "survey": ["survey no"]}).collect()} == {"owner": "Anil Kumar", "survey": "42/1"}
    arr = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(c).alias("confidence")) for t, c in (("Owner", 0.5), ("Anil", 0.9), ("Owner: Ravi", 0.8))])
    m = one(spark, extract.next_line_values(arr, {"owner": ["owner"], "village": ["village"]}))
    assert {k: v.value for k, v in m.items()} == {"owner": "Ravi"}
    tok = spark.createDataFrame(
        [("p", 0, "Village: Shirur", 0.9, 0.0, 0.0, 50.0, 10.0), ("p", 1, "Owner Name", 0.9, 0.0, 100.0, 50.0, 110.0), ("p", 2, "Anil", 0.8, 5.0, 130.0, 30.0, 140.0), ("p", 3, "Taluk", 0.9, 0.0, 300.0, 40.0, 310.0), ("p", 4, "South", 0.7, 60.0, 301.0, 90.0, 311.0)],
        "page string, token_no int, text string, confidence double, x_min double, y_min double, x_max double, y_max double",
    )
    anchors = {"village": "village", "owner name": "owner", "taluk": "taluk"}
    got = {r.field_name: (r.value_text, r.relationship) for r in extract.values_by_layout(tok, anchors, ["page"]).collect()}
    assert got == {"village": ("Shirur", "inline"), "owner": ("Anil", "below"), "taluk": ("South", "right")}
    got = {r.field_name: r.value_text for r in extract.values_exclusive(tok, anchors, ["page"]).collect()}
    assert got["owner"] == "Anil" and got["taluk"] == "South"
    s = spark.createDataFrame([("d", "a", "X", 0.9), ("d", "b", "Y", 0.85), ("d", "c", "Z", 0.5)], "document_id string, field_name string, raw_value string, confidence double")
    r = spark.createDataFrame([("d", "a", "x ", 0.8), ("d", "b", "W", 0.88), ("d", "e", "V", 0.7)], "document_id string, field_name string, raw_value string, confidence double")
    got = {x.field_name: (x.raw_value.strip(), x.channel, round(x.confidence, 2)) for x in extract.reconcile(s, r).collect()}
    assert got == {"a": ("x", "consensus", 0.95), "b": ("Y", "semantic", 0.85), "c": ("Z", "semantic", 0.5), "e": ("V", "regex", 0.7)}
    assert one(spark, extract.document_type(F.lit("Portal RTC extract"), portals=("portal",), rtc_type="portal_rtc"))["type"] == "portal_rtc"
    assert one(spark, extract.document_type(F.lit("RTC of the survey no. 5")))["type"] == "rtc"
    assert one(spark, extract.document_type(F.lit("ಬಾತಾದಾಖಲೆ ಖಾತಾ")))["type"] == "khata_certificate"
    assert one(spark, extract.state_of(F.lit("Portal extract"), {"KA": ("portal",)})) == "KA" 
    assert one(spark, extract.document_type(F.lit("cash receipt, cashier")))["type"] == "not_land_record"
    assert one(spark, extract.state_of(F.lit("ಅ"))) == "KA" and one(spark, extract.state_of(F.lit("Bihar"))) == "BR" and one(spark, extract.state_of(F.lit(None).cast("string"))) == "DEFAULT"
    best = one(spark, extract.rule_scores(F.lit("sale deed of land"), [{"type": "a", "mandatory": ["sale deed"], "optional": ["land"]}, {"type": "b", "mandatory": ["rtc"]}]))
    assert (best.type, round(best.score, 2)) == ("a", 0.7)
    c = spark.createDataFrame([("d", "x", "1", 2), ("d", "x", "2", 1)], "document_id string, field_name string, v string, source_rank int")
    assert extract.by_precedence(c).first().v == "2"
    t = spark.createDataFrame([("d", ["Khasra", "Name"], [["", "A"], ["7", "B"]])], "document_id string, headers array<string>, rows array<array<string>>")
    assert {x.field_name: x.raw_value for x in extract.table_values(t, {"khasra": ["khasra"], "owner": ["name"]}).collect()} == {"khasra": "7", "owner": "A"}
    sn = spark.createDataFrame([("d", "42/1"), ("d", "zz")], "document_id string, snippet string")
    assert {x.snippet: x.line_no for x in extract.source_line(sn, lines).collect()} == {"42/1": 0, "zz": None}


def test_review_and_search(spark):
    s = lambda *a: one(spark, review.region_status(*[F.lit(x) for x in a]))["status"]
    assert s(False, 0.9, None, "word", "x") == "AUTO_ACCEPT" and s(True, 0.9, None, "word", "x") == "REVIEW_REQUIRED" and s(False, 0.5, None, "word", "x") == "REVIEW_REQUIRED"
    items = F.from_json(F.lit(json.dumps([{"review_id": "1", "raw_text": "r", "status": "PENDING"}, {"review_id": "2", "raw_text": "q", "status": "PENDING"}])), "array<struct<review_id:string,raw_text:string,status:string,decision:string,corrected_text:string>>")
    done = review.submit(items, F.lit("1"), "EDIT", F.lit("new"))
    got = one(spark, done)
    assert (got[0].status, got[0].corrected_text, got[0].raw_text, got[1].status) == ("COMPLETED", "new", "r", "PENDING") and one(spark, review.any_pending(done))
    q = spark.createDataFrame([("a", "PENDING", 1.0), ("b", "APPROVED", 9.0), ("c", "ASSIGNED", 5.0)], "review_id string, lifecycle_state string, priority double")
    assert [r.review_id for r in review.pending(q).collect()] == ["c", "a"]
    st = review.stats(q).first()
    assert (st.total, st.pending, st.completed) == (3, 2, 1)
    docs = spark.createDataFrame([(1, "deed.pdf", "DONE", 3), (2, "other.pdf", "DONE", 2), (3, "x.pdf", "FAILED", 1)], "id int, filename string, status string, created_at int")
    fields = spark.createDataFrame([(2, "owner", "Deedar", None), (3, "owner", "deed", None)], "document_id int, field_name string, original_value string, normalized_value string")
    page, total = search.search(docs, fields, "deed")
    assert [(r.id, r.match_source) for r in page.collect()] == [(1, "filename"), (2, "field"), (3, "field")] and total.first().total == 3
    page, total = search.search(docs, fields, "deed", field_name="owner", status="DONE")
    assert [r.id for r in page.collect()] == [2]
    assert search.search(docs, fields, "zzz")[1].first().total == 0
    al = one(spark, search.with_aliases(F.create_map(F.lit("khasra"), F.lit("1")), {"survey": "khasra", "taluk": "tehsil"}))
    assert al == {"khasra": "1", "survey": "1"}


def test_datasets(spark):
    lines = ["", "# note", '{"image": "a.png", "text": "x"}', '{"image_path": "a.png", "ground_truth": "y"}', "{broken", '{"image": "b.png"}', '{"image": "c.png", "text": " "}', '{"image": "d.png", "text": "z"}']
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")
    known = spark.createDataFrame([("a.png",), ("c.png",)], "image string")
    assert {r.line_no: r.issue for r in datasets.manifest(df, known).collect()} == {3: None, 4: "duplicate_path", 5: "invalid_json", 6: "missing_field", 7: "empty_text", 8: "missing_image"}
    rows = spark.createDataFrame([("l", i) for i in range(10)] + [("m", 100), ("n", 200), ("n", 201), (None, 300)], "lang string, id int")
    counts = {r.lang: (r.train, r.val, r.test) for r in datasets.split_counts(datasets.stratified_split(rows, "lang", "id"), "lang").collect()}
    assert counts == {"l": (8, 1, 1), "m": (1, 0, 0), "n": (1, 1, 0), None: (1, 0, 0)}
    g = spark.createDataFrame([(i, f"w{i % 7}" if i % 2 else None) for i in range(60)], "id int, writer string")
    by = datasets.group_split(g, ["writer"], "id").where("writer is not null").groupBy("writer").agg(F.count_distinct("split").alias("n"))
    assert {r.n for r in by.collect()} == {1}
    leak = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "train"), ("c", "test"), ("c", "train")], "k string, split string")
    assert {(r.split_a, r.split_b, r.n_shared) for r in datasets.leakage(leak, "k").collect()} == {("train", "val", 1), ("test", "train", 1)}
    cal = spark.createDataFrame([("e", "0.5", "yes"), ("e", "2", "1"), ("e", "nan", "0"), (None, "0.5", "0")], "engine string, score string, label string")
    assert [r.is_valid for r in datasets.calibration_rows(cal).collect()] == [True, False, False, False]
    real = spark.createDataFrame([("r", "train")], "id string, split string")
    synth = spark.createDataFrame([("s", "train"), ("v", "val")], "id string, split string")
    assert datasets.merged(real, synth, factor=3).count() == 4
    tags = spark.createDataFrame([(i, ["a"] if i < 20 else ["a", "b"]) for i in range(24)], "id int, t array<string>")
    assert datasets.coverage_sample(tags, "id", "t", 3).count() <= 6
    bal = datasets.balanced(tags, "id", "t", 6, 10)
    assert bal.select("id").distinct().count() == 10 and bal.count() > 10
    img = spark.createDataFrame([("/x/a.png",), ("/x/b.png",)], "path string")
    lab = spark.createDataFrame([("a.jpg", "old", 1), ("a.png", "new", 2)], "file string, label string, line_no int")
    assert {r.stem: r.label for r in datasets.labels_by_stem(img, lab).collect()} == {"a": "new", "b": None}
    assert datasets.assignment_digest(spark.createDataFrame([("1", "t", "x")], "sample_id string, split string, sha256 string")).first().digest == one(spark, F.sha2(F.lit("1:t:x\n"), 256))
    assert one(spark, datasets.promotes(F.lit(0.3), F.lit(0.2), F.lit(0.8), F.lit(0.82))) is True


def test_metrics(spark):
    rows = spark.createDataFrame([("abc", "abd", "k"), ("ab", "ab", "k"), ("", "x", "e")], "r string, h string, lang string")
    got = {r.lang if not r.is_total else "all": (r.cer, r.n) for r in metrics.error_rates(rows, "r", "h", "lang").collect()}
    assert got == {"k": (0.2, 2), "e": (1.0, 1), "all": (0.4, 3)}
    conf = {(r.ref, r.hyp): r.n for r in metrics.confusions(rows, "r", "h").collect()}
    assert conf[("c", "d")] == 1 and conf[("", "x")] == 1 and conf[("a", "a")] == 2
    assert metrics.class_accuracy(metrics.confusions(rows, "r", "h")).where("kind = 'letter'").first().accuracy == 0.8
    out = spark.createDataFrame([("CORRECT",), ("INCORRECT",), ("MISSING",), ("FALSE_POSITIVE",)], "outcome string")
    s = metrics.extraction_scores(out).first()
    assert (round(s.precision, 4), round(s.recall, 4)) == (0.3333, 0.3333)
    e = one(spark, metrics.engine_consensus(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(c).alias("confidence")) for t, c in (("abcd", 0.9), ("abcx", 0.8))])))
    assert (e.text, round(e.disagreement, 2), round(e.confidence, 3)) == ("abcd", 0.25, 0.675)
    v = spark.createDataFrame([("k", "v1", "x", 0.9), ("k", "v2", "x", 0.7), ("k", "v3", "y", 0.95)], "k string, variant string, text string, probability double")
    assert metrics.variant_consensus(v, "k").where("rank = 1").first().text == "x"
    w = spark.createDataFrame([("helo",), ("zzzzz",)], "word string")
    lex = spark.createDataFrame([("hello",), ("help",)], "entry string")
    assert [(r.word, r.entry) for r in metrics.lexicon_matches(w, lex).collect()] == [("helo", "hello")]
    c = spark.createDataFrame([("k", 0, 0.9), ("k", 1, 0.88)], "k string, candidate_no int, score double")
    r = metrics.rescored(c, "k").where("rank = 1").first()
    assert r.needs_review and 0.5 < r.softmax < 0.51


def test_translation(spark):
    df = spark.createDataFrame([("Plot 12/3 dated 15/08/2023 cost Rs. 500",), (None,)], "t string").select("t", translate.protect("t").alias("p"))
    rows = df.select("t", "p", translate.restore("p.text", "p.parts").alias("back")).collect()
    assert rows[0].back == rows[0].t and "15/08/2023" not in rows[0].p.text and rows[1].back is None
    words = {"ರಾಮ": "Ram", "ಕ್ಷ": "Ksh", "ಕೂದಲು": "Koodalu", "ಗೀತಾ": "Geeta", "ಬಿನ್": "Bin", "ಕೋಂ": "Kom", "ಅಂಬಾ": "Amba", "ಕಮಲ": "Kamal"}
    assert {w: translate.transliterate_word(w) for w in words} == words
    cases = [
        ("survey_number", "ರಾಮ", None, "NOT_APPLICABLE", "passthrough"),
        ("village", "  ", None, "UNAVAILABLE", "unavailable"),
        ("village", "Anil 12", "Anil 12", "ALREADY_ENGLISH", "passthrough"),
        ("village", "ಗ್ರಾಮ", "Village", "TRANSLATED", "domain_glossary"),
        ("village", "ಬೆಂಗಳೂರು ಉತ್ತರ", "Bengaluru North", "TRANSLATED", "domain_glossary"),
        ("owner_name", "ರಾಮ ಬಿನ್ ಗೀತಾ", "Ram Bin Geeta", "TRANSLATED", "phonetic"),
        ("owner_name", "೧೨", None, "FAILED", "unavailable"),
    ]
    df = spark.createDataFrame([(c[0], c[1]) for c in cases], "n string, v string")
    got = df.select(translate.translate_field("n", "v", {}, {"ಬೆಂಗಳೂರು": "bengaluru"}, {"ಗ್ರಾಮ": "Village", "ಉತ್ತರ": "North"}).alias("r")).collect()
    assert [(r.r.english, r.r.status, r.r.engine) for r in got] == [c[2:] for c in cases]
    assert one(spark, translate.polish(F.lit("the the  land , is"))) == "The land, is"
    assert one(spark, translate.repair(F.lit("a  b ,c\nnoise here"), {"b": "B"}, ("noise",))) == "a B, c"
    assert one(spark, translate.purity(F.lit("ಅ ab"), F.lit("x ಅ")))["pure"] is False
    assert one(spark, translate.gate(F.lit(0.7))) == "FLAGGED"


def test_tfidf_matches_are_all_found(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(duplicates, "ASKED_ROWS", 7)
    monkeypatch.setattr(duplicates, "SEARCHED_ROWS", 30)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(1000, "zeta eta theta iota"), (1001, "zeta eta theta iota"), (1002, "zeta eta theta iota"), (1003, ""), (1004, None), (None, "zeta eta theta iota")], "doc_id long, text string")
    rows = duplicates.tfidf_vectors(docs.union(extra), "text", 3000).cache()
    known = [(r.doc_id, r.tfidf.toArray()) for r in rows.where("doc_id is not null").collect()]
    ids, v = np.array([k for k, _ in known]), np.array([x for _, x in known])
    cos = np.round(v @ v.T, 12)
    cos[ids[:, None] == ids] = -1
    want = {}
    for i, k in enumerate(ids):
        if k % 5 == 0 and cos[i].max() >= 0.85:
            want[int(k)] = (int(ids[cos[i] == cos[i].max()].min()), round(float(cos[i].max()), 9))
    got = duplicates.most_similar(rows, "doc_id", "tfidf", F.col("doc_id") % 5 == 0).collect()
    assert {r.id: (r.other_id, round(r.similarity, 9)) for r in got} == want
    assert len(got) == len(want) > 5 and want[1000] == (1001, 1.0)


def test_tfidf_query_gives_matches(spark):
    from recordloom import catalog

    got = catalog.queries()["tfidf_lengths"](spark, "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.match_id) for r in got} >= {(0, 61), (120, 2)}
    assert all(r.doc_id % 20 == 0 and r.match_id != r.doc_id and 0.85 <= r.similarity <= 1 for r in got)


def test_mode_ties_go_to_the_first_text(spark):
    rows = spark.createDataFrame([("a", "x", "k"), ("a", "x", "b"), ("a", "x", "k"), ("a", "x", "b"), ("a", "x", "z")], "s string, r string, h string")
    assert [(r.mode_text, r.mode_count, r.n_distinct) for r in metrics.subset_summary(rows, "r", "h", "s").collect()] == [("b", 2, 3)]


def test_learned_confidence(spark):
    f = one(spark, confidence.features(F.lit(0.9), F.lit("REGEX"), F.lit(1), F.lit(2), F.lit(True), F.lit(False), F.lit(False), F.lit(True)))
    assert f == [0.9, 0.95, 1.0, 0.0, 1.0, 2.0, 1.0, 0.5, 1.0]
    assert one(spark, confidence.features(F.lit(0.5), F.lit("table_lookup"), F.lit(0), F.lit(0), F.lit(None).cast("boolean"), F.lit(False), F.lit(True), F.lit(False))) == [0.5, 0.85, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    rows = spark.createDataFrame([([i / 40, 0.85, 0.0, 0.0, float(i % 3 == 0), 0.0, 1.0, 1.0, 0.0], int(i > 20)) for i in range(40)], "features array<double>, label int")
    model = confidence.fit_correctness(rows)
    p = rows.select("label", confidence.correctness("features", model).alias("p")).groupBy("label").agg(F.avg("p").alias("p")).collect()
    assert {r.label: r.p > 0.5 for r in p} == {0: False, 1: True}
    assert one(spark, confidence.blended(F.lit(0.5), F.lit(1.0))) == 0.7 and one(spark, confidence.blended(F.lit(None).cast("double"), F.lit(0.3))) == 0.3


def test_regional_names(spark):
    rows = spark.createDataFrame([("Gat Number",), (" patta_no ",), ("TEHSIL",), ("survey_number",), ("Odd Name",), (None,)], "n string").select(search.canonical_field("n").alias("c")).collect()
    assert [(r.c.field, r.c.region) for r in rows] == [("survey_number", "Maharashtra"), ("khata_number", "Tamil Nadu"), ("taluk", "North India"), ("survey_number", None), ("odd_name", None), (None, None)]


def test_rescoring_by_lexicon_and_signs(spark):
    score = lambda t: one(spark, metrics.orthographic_score(F.lit(t)))
    assert [score(t) for t in ("", "abc", "ಕನ್ನಡ", "ಾಕ", "ಕಾಿ", "ಕ್ಾ", "ಕ್್")] == [0.0, 0.5, 1.0, 0.5, 0.6, 0.6, 0.5]
    rows = spark.createDataFrame(
        [(1, 1, "ಗ್ರಾಮ", -0.1), (1, 2, "ಗ್ರಾಂ", -3.0), (2, 1, "ತಾಲೂಕ", -0.1), (2, 2, "ತಾಲೂಕು", -0.2), (3, 1, "xyz", -0.5)], "k int, candidate_no int, text string, score double"
    )
    lexicon = spark.createDataFrame([("ಗ್ರಾಮ",), ("ತಾಲೂಕು",)], "entry string")
    got = {r.k: r for r in metrics.rescored_best(rows, lexicon, "k").collect()}
    assert (got[1].text, got[1].is_switched, got[1].needs_review) == ("ಗ್ರಾಮ", False, False)
    # 0.5 * softmax + 0.35 * 1.0 + 0.15 against a lexicon similarity of 5/6 and a small lead of the model
    assert (got[2].text, got[2].is_switched, got[2].needs_review) == ("ತಾಲೂಕು", True, True)
    assert (got[3].text, got[3].confidence, got[3].needs_review) == ("xyz", 0.575, True)


def test_roles_of_numbers(spark):
    text = "Survey No: 42/1\nDated 15-08-23, plot 2.5 acre, Plinth area 900 sq ft\nWard No. 7, Khata No: 708/417/F-104\n2021-22 and 99"
    got = {(x.value, x.role, x.unit) for x in numbers.number_roles(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t").collect() if x.role != "unclassified"}
    assert got == {("42/1", "survey_number", None), ("15-08-2023", "date", None), ("900", "built_up_area", "Sq Ft"), ("2.5", "site_area", "acre"), ("7", "ward", None), ("708/417/F-104", "khata_number", None), ("2021-22", "year", None)}
    rest = [n[0] for n in numbers.read_numbers(text) if n[2] == "unclassified"]
    assert "99" in rest and "2021-22" not in rest
    # an area's digits are no survey number, nor is a number of four digits without a slash
    assert [n[2] for n in numbers.read_numbers("Survey 1234")] == ["unclassified"]


def test_label_anchors(spark):
    rows = spark.createDataFrame([(1, "Survey No: 125/1"), (2, "Village"), (3, "ಜಿಲ್ಲೆ - Mysuru"), (4, "nothing"), (5, "Owner Name Ravi"), (6, None)], "id int, text string")
    got = {(r.id, r.field_name): (r.label, r.inline_value) for r in extract.label_anchors(rows).collect()}
    assert got == {(1, "survey_number"): ("Survey No", "125/1"), (2, "village"): ("Village", None), (3, "district"): ("ಜಿಲ್ಲೆ", "Mysuru"), (5, "owner_name"): ("Owner Name", None)}


def test_small_record_operators(spark, tmp_path):
    assert one(spark, records.with_note(F.array(F.lit("a")), F.lit("a"))) == ["a"] and one(spark, records.with_note(F.array(F.lit("a")), F.lit("b"))) == ["a", "b"]
    e = one(spark, records.evidence(F.lit(1), F.lit(None).cast("string"), F.lit("raw")))
    assert (e.ocr_engine, e.extraction_rule_id, e.validation_notes, e.source_record) == ("paddleocr", "regex_default", [], None)
    a = one(spark, records.audit(F.array(F.lit(0.5), F.lit(1.0))))
    assert (a.token_count, a.has_token_probabilities, a.min_token_confidence, a.mean_token_confidence) == (2, True, 0.5, 0.75)
    assert one(spark, records.audit(F.lit(None).cast("array<double>"))).has_token_probabilities is False
    assert one(spark, records.overlay_engine(F.lit(False), F.lit("TrOCR-x"))) == "HANDWRITTEN" and one(spark, records.overlay_engine(F.lit(None).cast("boolean"), F.lit("p"))) == "PRINTED"
    assert one(spark, records.ordered_unique(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == ["b", "a"]
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "review_id string, priority int, note string")
    records.save_json(rows, f"{tmp_path}/queue")
    assert sorted(map(tuple, records.load_json(spark, f"{tmp_path}/queue", "review_id string, priority int, note string").collect())) == sorted(map(tuple, rows.collect()))
    assert [r.review_id for r in records.point(rows, review_id="b", priority=2).collect()] == ["b"]
    lines, writing = records.lines_and_writing(spark.createDataFrame([(1, True), (2, None)], "id int, is_handwritten boolean"))
    assert lines.count() == 2 and [r.id for r in writing.collect()] == [1]
    engines = spark.createDataFrame([("p", "d", "a", 1.0), ("p", "d", "b", 0.5)], "engine string, document_id string, stage string, seconds double")
    assert records.engine_counts(engines).first().n == 2 and tuple(records.stage_times(engines).first()) == ("d", 1.5, 2)
