"""Queries that call the record rules: over the driver's tables with SQL of the same rule, or over a few literal rows.

For literal rows the SQL states the values that the surveyed rules prescribe.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordloom.functions import dates, geometry, text
from recordloom.operators import confidence, extract, fallbacks, layout, metrics, numbers, parcels, records, review, search, translate, validate
from recordloom.plans.queries import QUERIES, SQL, query, rnd, t


def literal(columns: str, rows: list[tuple], values: str, names: str):
    """Registers a query over literal rows; values, names: the expected rows as SQL."""

    def register(f):
        def run(spark, d):
            return f(spark.createDataFrame(rows, columns))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        SQL[f.__name__] = f"SELECT * FROM (VALUES {values}) v({names})"
        return f

    return register


# ------------------------------------------------------------------ review and state


@query("""
WITH q AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'IN_REVIEW' ELSE 'APPROVED' END AS s FROM orders)
SELECT count(*) AS total, count_if(s IN ('PENDING', 'IN_REVIEW'))::BIGINT AS pending, count_if(s = 'APPROVED')::BIGINT AS completed, count_if(s = 'IN_REVIEW')::BIGINT AS n_in_review FROM q
""")
def review_stats(spark, d):
    """The queue's numbers, with orders as reviews."""
    s = F.col("o_orderstatus")
    q = t(spark, d, "orders").select(F.when(s == "O", "PENDING").when(s == "P", "IN_REVIEW").otherwise("APPROVED").alias("lifecycle_state"))
    return review.stats(q).select("total", "pending", "completed", "n_in_review")


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_min(event_type, (ts, event_id)) AS raw_text, count(*) AS n_events,
       arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS corrected_text FROM events GROUP BY user_id
""")
def review_state(spark, d):
    """Each user's last event as state, the first as raw evidence, and the last correction."""
    e = t(spark, d, "events").select(F.col("user_id").alias("review_id"), "ts", "event_id", F.col("event_type").alias("state"), F.col("event_type").alias("raw_text"), F.when(F.col("event_type") == "purchase", F.col("event_type")).alias("corrected_text"))
    return review.current_state(e).withColumnRenamed("review_id", "user_id")


@query("""
SELECT review_id, priority FROM (SELECT o_orderkey AS review_id, round(o_totalprice, 2) AS priority, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')) ORDER BY priority DESC, review_id LIMIT 40
""")
def pending_reviews(spark, d):
    """The forty open items of highest priority."""
    q = t(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), rnd("o_totalprice").alias("priority"), F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "IN_REVIEW").otherwise("APPROVED").alias("lifecycle_state"))
    return review.pending(q, 40).select("review_id", "priority")


# ------------------------------------------------------------------ parcels


@query("""
WITH parcel AS (SELECT n_nationkey, n_name FROM nation),
probe AS (SELECT s_suppkey AS id, s_nationkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'NATION' WHEN s_suppkey % 3 = 1 THEN (SELECT n_name FROM nation n WHERE n.n_nationkey = s_nationkey) ELSE 'X' || s_nationkey END AS given FROM supplier),
exact AS (SELECT p.*, q.n_name AS name FROM probe p LEFT JOIN parcel q ON p.k = q.n_nationkey AND upper(p.given) = upper(q.n_name))
SELECT e.id, coalesce(e.name, q.n_name) AS parcel_name, CASE WHEN e.name IS NOT NULL THEN 'exact' WHEN q.n_name IS NOT NULL THEN 'part' END AS matched_by
FROM exact e LEFT JOIN parcel q ON e.name IS NULL AND e.k = q.n_nationkey AND (contains(upper(q.n_name), upper(e.given)) OR contains(upper(e.given), upper(q.n_name)))
""")
def parcel_lookup(spark, d):
    """Suppliers to nations by all keys, then by number and a part of the village's name."""
    n = t(spark, d, "nation")
    some = lambda c: F.lit(c).cast("string")
    features = n.select(F.lit("IN").alias("state"), some("").alias("district"), some("").alias("tehsil"), F.col("n_name").alias("village"), F.col("n_nationkey").cast("string").alias("khasra_number"), F.array().cast("array<string>").alias("aliases"), F.col("n_nationkey").alias("load_ord"), F.col("n_name").alias("shown"))
    s = t(spark, d, "supplier").join(F.broadcast(n.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")), "s_nationkey")  # twenty-five rows
    given = F.when(F.col("s_suppkey") % 3 == 0, "NATION").when(F.col("s_suppkey") % 3 == 1, F.col("n_name")).otherwise(F.concat(F.lit("X"), F.col("s_nationkey").cast("string")))
    records = s.select(F.col("s_suppkey").alias("document_id"), F.lit("in").alias("state"), some("").alias("district"), some("").alias("tehsil"), given.alias("village"), F.col("s_nationkey").cast("string").alias("khasra_number"))
    return parcels.lookup(records, parcels.registry(features)).select(F.col("document_id").alias("id"), F.col("parcel.shown").alias("parcel_name"), "matched_by")


# ------------------------------------------------------------------ scores


@query("""
SELECT event_id, round_even(1.0 / (1.0 + exp(-(3.0 * least(value / 100.0, 1.0) - 1.5))), 4) AS calibrated FROM events
""")
def platt_scores(spark, d):
    """A score through Platt's curve."""
    return t(spark, d, "events").select("event_id", confidence.platt(F.least(F.col("value") / 100.0, F.lit(1.0)), F.lit(3.0), F.lit(-1.5)).alias("calibrated"))


@query("""
WITH r AS (SELECT o_custkey AS k, o_orderkey, o_totalprice / 100000.0 AS s FROM orders),
w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, o_orderkey) AS rank, s - lead(s) OVER (PARTITION BY k ORDER BY s DESC, o_orderkey) AS lead, exp(s - max(s) OVER (PARTITION BY k)) AS e FROM r),
x AS (SELECT *, sum(e) OVER (PARTITION BY k) AS total FROM w)
SELECT k, o_orderkey AS candidate_no, rank::INTEGER AS rank, round(e / total, 6) AS softmax, coalesce(lead < 0.04, false) AS needs_review FROM x WHERE rank <= 3
""")
def rescored_candidates(spark, d):
    """The three best candidates of each customer, with softmax and lead."""
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("candidate_no"), (F.col("o_totalprice") / 100000.0).alias("score"))
    return metrics.rescored(rows, "k").where("rank <= 3").select("k", "candidate_no", "rank", F.round("softmax", 6).alias("softmax"), "needs_review")


@query("""
WITH g AS (SELECT o_custkey AS k, o_orderpriority AS variant, o_orderstatus AS text, o_totalprice / 1000000.0 AS p FROM orders),
a AS (SELECT k, text, count(DISTINCT variant) AS n_variants, avg(p) AS mean_p, max(p) AS max_p FROM g GROUP BY k, text),
n AS (SELECT k, count(DISTINCT variant) AS v FROM g GROUP BY k)
SELECT k, text, n_variants, round(0.5 * n_variants / v + 0.3 * mean_p + 0.2 * max_p, 6) AS score FROM a JOIN n USING (k)
""")
def consensus_of_variants(spark, d):
    """Readings of each customer pooled by text."""
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("variant"), F.col("o_orderstatus").alias("text"), (F.col("o_totalprice") / 1000000.0).alias("probability"))
    return metrics.variant_consensus(rows, "k").select("k", "text", "n_variants", F.round("score", 6).alias("score"))


@query("""
WITH a AS (SELECT l_orderkey, list(l_discount * 10 ORDER BY l_linenumber) AS p FROM lineitem GROUP BY l_orderkey),
s AS (SELECT l_orderkey, p, len(list_filter(p, lambda v: v < 0 OR v > 1)) = 0 AS sound, len(list_filter(p, lambda v: v = 0)) > 0 AS zero FROM a)
SELECT l_orderkey, CASE WHEN sound THEN round(list_avg(p), 6) END AS mean, CASE WHEN sound THEN round(CASE WHEN zero THEN 0.0 ELSE exp(list_avg(list_transform(p, lambda v: ln(CASE WHEN v = 0 THEN 1 ELSE v END)))) END, 6) END AS geometric, CASE WHEN sound THEN round(list_min(p), 6) END AS least FROM s
""")
def token_confidences(spark, d):
    """Means and minimum of an order's values as token probabilities."""
    a = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_discount") * 10).alias("v")))), lambda x: x["v"]).alias("p"))
    return a.select("l_orderkey", F.round(confidence.token_mean("p"), 6).alias("mean"), F.round(confidence.token_geometric_mean("p"), 6).alias("geometric"), F.round(confidence.token_min("p"), 6).alias("least"))


@query("""
WITH e AS (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'CORRECT' WHEN quality = 1 THEN 'INCORRECT' WHEN toxic = 1 THEN 'FALSE_POSITIVE' ELSE 'MISSING' END AS o FROM labels),
n AS (SELECT count_if(o = 'CORRECT')::DOUBLE AS r, count_if(o = 'INCORRECT')::DOUBLE AS w, count_if(o = 'MISSING')::DOUBLE AS m, count_if(o = 'FALSE_POSITIVE')::DOUBLE AS f FROM e)
SELECT round(r / (r + w + f), 6) AS precision, round(r / (r + w + m), 6) AS recall, round(2 * (r / (r + w + f)) * (r / (r + w + m)) / (r / (r + w + f) + r / (r + w + m)), 6) AS f1, round(f / (r + w + f), 6) AS false_positive_rate FROM n
""")
def extraction_figures(spark, d):
    """Precision, recall, F1 and rate of false positives of outcomes made from the labels."""
    o = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "CORRECT").when(F.col("quality") == 1, "INCORRECT").when(F.col("toxic") == 1, "FALSE_POSITIVE").otherwise("MISSING")
    return metrics.extraction_scores(t(spark, d, "labels").select(o.alias("outcome"))).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "false_positive_rate")])


@query("""
SELECT p_partkey, least(1.0, levenshtein(p_type, p_brand) / length(p_type)) AS capped, levenshtein(p_type, p_brand) / greatest(length(p_type), length(p_brand)) AS normalized FROM part
""")
def edit_shares(spark, d):
    """Edit distances between two fields of a part."""
    return t(spark, d, "part").select("p_partkey", text.capped_cer("p_type", "p_brand").alias("capped"), text.normalized_distance("p_type", "p_brand").alias("normalized"))


@query("""
WITH g AS (SELECT p_brand AS subset, p_type AS p, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT subset, arg_min(p, (-n, p)) AS mode_text, arg_min(n, (-n, p)) AS mode_count FROM g GROUP BY subset)
SELECT subset, count(*) AS n, count_if(p_name = p_type)::BIGINT AS n_exact, count(DISTINCT p_type) AS n_distinct, any_value(mode_text) AS mode_text, any_value(mode_count) AS mode_count
FROM part JOIN m ON p_brand = subset GROUP BY subset
""")
def frequent_predictions(spark, d):
    """Each brand's most frequent type, ties to the first by text, with exact and distinct counts."""
    p = t(spark, d, "part").withColumn("subset", F.col("p_brand"))
    return metrics.subset_summary(p, "p_name", "p_type", "subset").select("subset", "n", "n_exact", "n_distinct", "mode_text", "mode_count")


# ------------------------------------------------------------------ boxes and order


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_linenumber * 3.0 AS y0, l_quantity + 10.0 AS x1, l_linenumber * 3.0 + 8.0 AS y1 FROM lineitem)
SELECT l_orderkey, l_linenumber, round_even(least(1.0, x0 / 60.0), 3) AS x_min, round_even(least(1.0, y0 / 40.0), 3) AS y_min, round_even(least(1.0, x1 / 60.0), 3) AS x_max, round_even(least(1.0, y1 / 40.0), 3) AS y_max, round((x1 - x0) * (y1 - y0), 4) AS area FROM b
""")
def unit_boxes(spark, d):
    """Boxes as shares of a page, and their areas."""
    y = F.col("l_linenumber") * 3.0
    b = geometry.box(F.col("l_quantity").cast("double"), y, F.col("l_quantity") + 10.0, y + 8.0)
    n = geometry.normalized(b, F.lit(60.0), F.lit(40.0))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.bround(n[c], 3).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")], F.round(geometry.area(b), 4).alias("area"))


@query("""
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_extendedprice / 24) * 24, l_quantity, l_linenumber) AS place,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(l_extendedprice / 25, 0) * 25, l_quantity, l_linenumber) AS rounded_place FROM lineitem
""")
def reading_places(spark, d):
    """Lines in reading order, by rows of 24 and by rounded rows of 25; what the SQL leaves tied goes by its exact top, and in both orders alike."""

    def place(order, *ties):
        return F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*[F.asc_nulls_last(c) for c in (*order, "l_linenumber", *ties)])).cast("long")

    first = t(spark, d, "lineitem").withColumn("place", place(layout.reading_order("l_extendedprice", "l_quantity"), "l_extendedprice"))
    return first.select("l_orderkey", "l_linenumber", "place", place(layout.rounded_order("l_extendedprice", "l_quantity"), "l_extendedprice", "place").alias("rounded_place"))


# ------------------------------------------------------------------ literal rows


@literal(
    "id int, raw string",
    [(1, "१४२ / १"), (2, "142-2"), (3, "89/1/A"), (4, "708/417/F-104"), (5, "708 / 417 / A"), (6, "W.NO.  84"), (7, "Survey No. 42/1"), (8, "none"), (9, None), (10, "Khasra: 12-3")],
    "(1, '142/1'), (2, '142/2'), (3, '89/1'), (4, '708/417/F-104'), (5, '708/417/A'), (6, 'W.NO. 84'), (7, '42/1'), (8, 'none'), (9, ''), (10, '12/3')",
    "id, parcel",
)
def parcel_numbers(rows):
    """X09, X01."""
    return rows.select("id", text.parcel_id("raw").alias("parcel"))


@literal(
    "id int, kind string, raw string",
    [(1, "locality", "Village: ಜಯನಗರ"), (2, "locality", "ಬಡಾವಣೆ - Shirur."), (3, "taluk", "Taluk: ಜಯನಗರಿಉಪಏಭಾಗ"), (4, "taluk", "ತಾಲೂಕು ಬೆಂಗಳೂರು ದಕ್ಷಿಣ"), (5, "district", "District: ಬೆಂಗಳೂದು"), (6, "district", "ಜಿಲ್ಲೆ Mysuru"), (7, "district", None)],
    "(1, 'Jayanagar'), (2, 'Shirur'), (3, 'Jayanagar Sub-division'), (4, 'Bangalore South'), (5, 'Bengaluru'), (6, 'Mysuru'), (7, '')",
    "id, place",
)
def place_names(rows):
    """X08."""
    k = F.col("kind")
    return rows.select("id", F.when(k == "locality", text.locality("raw")).when(k == "taluk", text.taluk("raw")).otherwise(text.district("raw")).alias("place"))


@literal(
    "id int, raw string",
    [(1, "Shri Ram Lal"), (2, "Smt. Gita Devi:"), (3, "श्री मोहन"), (4, "Dr. A (late) "), (5, "Ravi ರವರ ಹೆಸರಿನಲ್ಲಿ"), (6, None)],
    "(1, 'Ram Lal'), (2, 'Gita Devi'), (3, 'मोहन'), (4, 'A late'), (5, 'Ravi'), (6, '')",
    "id, name",
)
def person_names(rows):
    """X07."""
    return rows.select("id", text.person_name("raw").alias("name"))


@literal(
    "id int, raw string",
    [(1, "Owner: Ravi"), (2, "a = b"), (3, "x - y"), (4, "none"), (5, "a: b = c"), (6, None)],
    "(1, 'Ravi'), (2, 'b'), (3, 'y'), (4, NULL), (5, 'b = c'), (6, NULL)",
    "id, value",
)
def inline_values(rows):
    """X12."""
    return rows.select("id", text.inline_value("raw").alias("value"))


@literal(
    "id int, raw string",
    [(1, "ರಾಮ"), (2, "ಕ್ಷ"), (3, "ಗೀತಾ ಬಿನ್ ರಾಮ"), (4, "ಕೂದಲು"), (5, "ಅಂಬಾ"), (6, None)],
    "(1, 'Ram'), (2, 'Ksh'), (3, 'Geeta Bin Ram'), (4, 'Koodalu'), (5, 'Amba'), (6, NULL)",
    "id, latin",
)
def latin_names(rows):
    """X30."""
    return rows.select("id", translate.transliterate("raw").alias("latin"))


@literal(
    "id int, name string, value string",
    [(1, "survey_number", "ರಾಮ"), (2, "village", " "), (3, "village", "Anil"), (4, "village", "ಗ್ರಾಮ"), (5, "village", "ಬೆಂಗಳೂರು ಉತ್ತರ"), (6, "owner_name", "ರಾಮ"), (7, "owner_name", "೧೨")],
    "(1, NULL, 'NOT_APPLICABLE', 'passthrough'), (2, NULL, 'UNAVAILABLE', 'unavailable'), (3, 'Anil', 'ALREADY_ENGLISH', 'passthrough'), (4, 'Village', 'TRANSLATED', 'domain_glossary'), (5, 'Bengaluru North', 'TRANSLATED', 'domain_glossary'), (6, 'Ram', 'TRANSLATED', 'phonetic'), (7, NULL, 'FAILED', 'unavailable')",
    "id, english, status, engine",
)
def field_ladder(rows):
    """X31."""
    return rows.select("id", translate.translate_field("name", "value", {}, {"ಬೆಂಗಳೂರು": "bengaluru"}, {"ಗ್ರಾಮ": "Village", "ಉತ್ತರ": "North"}).alias("r")).select("id", "r.*")


@literal(
    "id int, raw string",
    [(1, ""), (2, "abc"), (3, "ಕನ್ನಡ"), (4, "ಾಕ"), (5, "ಕಾಿ"), (6, "ಕ್ಾ"), (7, "ಕ್್"), (8, None)],
    "(1, 0.0::DOUBLE), (2, 0.5), (3, 1.0), (4, 0.5), (5, 0.6), (6, 0.6), (7, 0.5), (8, 0.0)",
    "id, score",
)
def orthographic_scores(rows):
    """F28."""
    return rows.select("id", metrics.orthographic_score("raw").alias("score"))


@literal(
    "id int, raw string",
    [(1, "Gat Number"), (2, " patta_no "), (3, "TEHSIL"), (4, "survey_number"), (5, "Odd Name"), (6, "khatauni")],
    "(1, 'survey_number', 'Maharashtra'), (2, 'khata_number', 'Tamil Nadu'), (3, 'taluk', 'North India'), (4, 'survey_number', NULL), (5, 'odd_name', NULL), (6, 'khata_number', 'North India')",
    "id, field, region",
)
def regional_fields(rows):
    """P04."""
    return rows.select("id", search.canonical_field("raw").alias("c")).select("id", "c.*")


@literal(
    "k int, candidate_no int, text string, score double",
    [(1, 1, "ಗ್ರಾಮ", -0.1), (1, 2, "ಗ್ರಾಂ", -3.0), (2, 1, "ತಾಲೂಕ", -0.1), (2, 2, "ತಾಲೂಕು", -0.2), (3, 1, "xyz", -0.5)],
    "(1, 'ಗ್ರಾಮ', false, false), (2, 'ತಾಲೂಕು', true, true), (3, 'xyz', false, true)",
    "k, text, is_switched, needs_review",
)
def rescored_texts(rows):
    """The chosen candidate by model, lexicon and orthography."""
    lexicon = rows.sparkSession.createDataFrame([("ಗ್ರಾಮ",), ("ತಾಲೂಕು",)], "entry string")
    return metrics.rescored_best(rows, lexicon, "k").select("k", "text", "is_switched", "needs_review")


@literal(
    "id int, raw string",
    [(1, "ಪಹಣಿ ಸರ್ವೆ ನಂ 5"), (2, "ಬಾತಾದಾಖಲೆ ಖಾತಾ"), (3, "mutation register"), (4, "sale deed"), (5, "village taluk"), (6, "cash receipt, cashier"), (7, None)],
    "(1, 'rtc', 'KA'), (2, 'khata_certificate', 'KA'), (3, 'mutation_register', 'KA'), (4, 'other_gov_property', 'DEFAULT'), (5, 'land_record', 'DEFAULT'), (6, 'not_land_record', 'DEFAULT'), (7, 'not_land_record', 'DEFAULT')",
    "id, type, state",
)
def document_types(rows):
    """F14, F16."""
    return rows.select("id", extract.document_type("raw")["type"].alias("type"), extract.state_of("raw").alias("state"))


@literal(
    "id int, raw string",
    [(1, "15/08/2023"), (2, "30/02/2020"), (3, "01-01-1850"), (4, "2020.13.01"), (5, "soon"), (6, " ")],
    "(1, 'VALID', true), (2, 'INVALID', false), (3, 'VALID', false), (4, 'INVALID', false), (5, 'WARNING', false), (6, 'INVALID', false)",
    "id, status, plausible",
)
def date_verdicts(rows):
    """D02, D03."""
    return rows.select("id", dates.verdict("raw")["status"].alias("status"), dates.is_calendar_date("raw").alias("plausible"))


@literal(
    "id int, raw string, year string",
    [(1, "Fasli 1430", "23"), (2, "೧೪೩೦", "023"), (3, "none", "2023"), (4, "1429-30", "223")],
    "(1, 2022, '2023'), (2, 2022, '2023'), (3, NULL, '2023'), (4, 2021, '2023')",
    "id, gregorian, repaired",
)
def year_repairs(rows):
    """D04, D05."""
    return rows.select("id", dates.fasli_start("raw").alias("gregorian"), dates.repair_year("year").alias("repaired"))


@literal(
    "id int, printed string, printed_conf double, written string, written_conf double",
    [(1, "a", 0.5, "b", 0.9), (2, "a", 0.9, "b", 0.5), (3, "a", 0.7, "b", 0.7), (4, "a", 0.2, "", 0.9)],
    "(1, 'b', 'handwriting_high_confidence', 0.4::DOUBLE, false), (2, 'a', 'printed_high_confidence', 0.8, false), (3, 'a', 'unresolved_ambiguity', 0.4, true), (4, 'a', 'unresolved_ambiguity', 0.05, true)",
    "id, value, strategy, confidence, conflict",
)
def reading_conflicts(rows):
    """M13."""
    return rows.select("id", confidence.disagreement("printed", "printed_conf", "written", "written_conf").alias("r")).select("id", "r.value", "r.strategy", F.round("r.confidence", 4).alias("confidence"), "r.conflict")


@literal(
    "id int, method string, errors int, warnings int, cross boolean, verified boolean, mismatch boolean, conflict boolean",
    [(1, "regex", 1, 2, True, False, False, True), (2, "table_lookup", 0, 0, None, False, True, False), (3, "semantic", 0, 1, True, True, False, False)],
    "(1, [0.5, 0.95, 1, 0, 1, 2, 1, 0.5, 1]), (2, [0.5, 0.85, 0, 1, 0, 0, 0, 0, 0]), (3, [0.5, 0.85, 0, 0, 0, 1, 1, 1, 0])",
    "id, f",
)
def learned_features(rows):
    """The nine numbers, joined as text."""
    f = confidence.features(F.lit(0.5), "method", "errors", "warnings", "cross", "verified", "mismatch", "conflict")
    return rows.select("id", F.concat_ws(",", F.transform(f, lambda x: F.format_number(x, 2))).alias("f"))


SQL["learned_features"] = "SELECT * FROM (VALUES (1, '0.50,0.95,1.00,0.00,1.00,2.00,1.00,0.50,1.00'), (2, '0.50,0.85,0.00,1.00,0.00,0.00,0.00,0.00,0.00'), (3, '0.50,0.85,0.00,0.00,0.00,1.00,1.00,1.00,0.00')) v(id, f)"


@literal(
    "document_id string, headers array<string>, rows array<array<string>>, land_area double",
    [("a", ["Khasra", "Area (Ha)"], [["101", "1.2500"], ["102", "0.7500"]], 2.0), ("b", ["Khasra", "Area (Ha)"], [["101", "1.0000"], ["102", "1.0000"]], 5.0), ("c", ["Owner", "Share"], [["A", "1/2"], ["B", "1/2"]], 1.0)],
    "('a', true, NULL, '101,102'), ('b', false, NULL, '101,102'), ('c', NULL, true, NULL)",
    "document_id, area_sum_matches, share_sum_matches, parcels",
)
def table_sums(rows):
    """Sums of area and share cells against the header, and the parcels named."""
    tables = rows.select("document_id", "headers", "rows")
    out = rows.select("document_id", "land_area")
    for sums in (validate.table_area_sums(tables), validate.owner_share_sums(tables), validate.table_parcels(tables)):
        out = out.join(sums, "document_id", "left")
    return out.select("document_id", validate.sum_matches("land_area", "table_area").alias("area_sum_matches"), validate.shares_match("share_sum").alias("share_sum_matches"), F.array_join("parcels", ",").alias("parcels"))


@literal(
    "page string, token_no int, text string, confidence double, x_min double, y_min double, x_max double, y_max double",
    [("p", 0, "Village: Shirur", 0.9, 0.0, 0.0, 50.0, 10.0), ("p", 1, "Owner Name", 0.9, 0.0, 100.0, 50.0, 110.0), ("p", 2, "Anil", 0.8, 5.0, 130.0, 30.0, 140.0), ("p", 3, "Taluk", 0.9, 0.0, 300.0, 40.0, 310.0), ("p", 4, "South", 0.7, 60.0, 301.0, 90.0, 311.0)],
    "('village', 'Shirur', 'inline'), ('owner', 'Anil', 'below'), ('taluk', 'South', 'right')",
    "field_name, value_text, relationship",
)
def layout_values(rows):
    """An anchor's value inline, below or to the right."""
    return extract.values_by_layout(rows, {"village": "village", "owner name": "owner", "taluk": "taluk"}, ["page"]).select("field_name", "value_text", "relationship")


@literal(
    "id int, text string",
    [(1, "Survey No: 125/1"), (2, "Village"), (3, "ಜಿಲ್ಲೆ - Mysuru"), (4, "nothing"), (5, "Owner Name Ravi"), (6, None)],
    "(1, 'survey_number', 'Survey No', '125/1'), (2, 'village', 'Village', NULL), (3, 'district', 'ಜಿಲ್ಲೆ', 'Mysuru'), (5, 'owner_name', 'Owner Name', NULL)",
    "id, field_name, label, inline_value",
)
def label_anchors(rows):
    """Labels with the values that follow them."""
    return extract.label_anchors(rows).select("id", "field_name", "label", "inline_value")


@literal(
    "id int, text string",
    [(1, "Survey No: 42/1\nDated 15-08-23, plot 2.5 acre, Plinth area 900 sq ft"), (2, "Ward No. 7, Khata No: 708/417/F-104\n2021-22"), (3, None)],
    "(1, '42/1', 'survey_number', NULL), (1, '15-08-2023', 'date', NULL), (1, '900', 'built_up_area', 'Sq Ft'), (1, '2.5', 'site_area', 'acre'), (2, '7', 'ward', NULL), (2, '708/417/F-104', 'khata_number', NULL), (2, '2021-22', 'year', NULL)",
    "id, value, role, unit",
)
def labelled_numbers(rows):
    """Numbers with a role, of a few texts."""
    return numbers.number_roles(rows, "id", "text").where("role != 'unclassified'").select("id", "value", "role", "unit")


@literal(
    "document_id string, line_no int, text string",
    [("d", 0, "Owner: Ravi"), ("d", 1, "Village"), ("d", 2, "-"), ("d", 3, "Shirur"), ("d", 4, "Taluk"), ("d", 5, "South")],
    "('owner', 'Ravi'), ('village', 'Shirur'), ('taluk', 'South')",
    "field_name, raw_value",
)
def line_values(rows):
    """Values on the rest of a term's line, on the next one, or on the one after."""
    return extract.adjacent_values(rows, {"owner": ["owner"], "village": ["village"], "taluk": ["taluk"]}).select("field_name", "raw_value")


@literal(
    "origin string, field_name string, raw_value string, confidence double",
    [("s", "a", "X", 0.9), ("s", "b", "Y", 0.85), ("s", "c", "Z", 0.5), ("r", "a", "x ", 0.8), ("r", "b", "W", 0.88), ("r", "e", "V", 0.7)],
    "('a', 'consensus', 0.95::DOUBLE), ('b', 'semantic', 0.85), ('c', 'semantic', 0.5), ('e', 'regex', 0.7)",
    "field_name, channel, confidence",
)
def reconciled_fields(rows):
    """Semantic and regex values of a document in a full outer join."""
    side = lambda o: rows.where(F.col("origin") == o).select(F.lit("d").alias("document_id"), "field_name", "raw_value", "confidence")
    return extract.reconcile(side("s"), side("r")).select("field_name", "channel", F.round("confidence", 2).alias("confidence"))


ANSWER = '```json\n{"document_type": "", "village": {"raw_value": " Shirur ", "model_confidence": 0.9}, "taluk": {"raw_value": ""}, "extra_fields": [{"field_name": "village", "raw_value": "X", "normalized_value": "Y"}, {"field_name": "plot", "raw_value": 7}]}\n```'


@literal(
    "id int, answer string",
    [(1, ANSWER), (2, "not json"), (3, '{"document_type": "rtc", "extra_fields": {"a": {"raw_value": "1"}}}'), (4, "[1]"), (5, None)],
    "(1, 'success', 'none', 'village=Y,plot=7'), (2, 'error', 'none', ''), (3, 'success', 'rtc', 'a=1'), (4, 'error', 'none', ''), (5, 'error', 'none', '')",
    "id, status, document_type, fields",
)
def engine_answers(rows):
    """Y07."""
    r = rows.select("id", records.engine_answer("answer", "none").alias("r"))
    return r.select("id", "r.status", "r.document_type", F.array_join(F.transform("r.fields", lambda x: F.concat(x["name"], F.lit("="), x["normalized_value"])), ",").alias("fields"))


@query("""
SELECT lang AS document_id, count(*) AS total, count_if(quality = 1 AND toxic = 0)::BIGINT AS valid, count_if(quality = 0)::BIGINT AS warning, count_if(quality = 1 AND toxic = 1)::BIGINT AS invalid,
       count_if(quality = 1 AND toxic = 1) > 0 OR count_if(quality = 0) > 0 OR avg(quality) < 0.695 AS needs_review FROM labels JOIN documents USING (doc_id) GROUP BY lang
""")
def semantic_summaries(spark, d):
    """Statuses made from the labels, by language."""
    status = F.when(F.col("quality") == 0, "WARNING").when(F.col("toxic") == 1, "INVALID").otherwise("VALID")
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", F.col("lang").alias("document_id")), "doc_id")
    return records.semantic_summary(rows.select("document_id", status.alias("validation_status"), F.col("quality").cast("double").alias("confidence"))).select("document_id", "total", "valid", "warning", "invalid", "needs_review")


@query("""
SELECT event_id, 'batch_' || strftime(ts, '%Y%m%d') AS batch, CASE WHEN value IS NULL OR value / 100.0 < 0.60 OR event_type = 'purchase' THEN 'LOW' WHEN value / 100.0 >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END AS tier FROM events
""")
def overlay_tiers(spark, d):
    """An event's tier, the review flag first, and the batch of its day."""
    return t(spark, d, "events").select("event_id", records.batch_name("ts").alias("batch"), records.overlay_tier(F.col("value") / 100.0, F.col("event_type") == "purchase").alias("tier"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def grouped_roles(spark, d):
    """The roles of a conversation in order."""
    return records.by_key(t(spark, d, "conversations"), "conv_id", "role", "turn").select("conv_id", F.array_join("items", ",").alias("roles"))


@literal(
    "id int, name string, raw string",
    [(1, "survey_number", " ನಂ ೧೨/ ೩ a"), (2, "khata_number", "No. 45-6"), (3, "extent_area", "೨ acre "), (4, "village", " Shirur "), (5, "survey_number", None)],
    "(1, '12/3'), (2, '45-6'), (3, '2 acre'), (4, 'Shirur'), (5, NULL)",
    "id, value",
)
def entity_values(rows):
    """X10."""
    return rows.select("id", records.entity_value("name", "raw").alias("value"))


@literal(
    "kind string, ordinal int, region_id string, text string",
    [("region", 1, "r1", "Survey 42/1"), ("region", 2, None, "Owner Ravi"), ("region", 3, "r9", "Ravi again"), ("field", 1, "r9", "Ravi"), ("field", 2, "zz", "Ravi"), ("field", 3, None, "42/1"), ("field", 4, "", "absent")],
    "(1, 'r9'), (2, 'region_002'), (3, 'r1'), (4, NULL)",
    "id, region",
)
def field_regions(rows):
    """Fields with the region they name, or the first that holds their value."""
    some = rows.where("kind = 'region'").select(F.lit("d").alias("document_id"), "ordinal", "region_id", "text", F.lit("").alias("language"), F.lit("").alias("script"), F.lit(None).cast("boolean").alias("is_handwritten"))
    fields = rows.where("kind = 'field'").select(F.lit("d").alias("document_id"), F.col("ordinal").cast("string").alias("field_name"), F.col("text").alias("raw_value"), F.col("region_id").alias("source_region_id"))
    return records.region_of_value(fields, records.regions(some)).select(F.col("field_name").cast("int").alias("id"), F.col("source_region_id").alias("region"))


@literal(
    "line_no int, document_id string, language string, is_promoted boolean",
    [(1, "a", "Kannada", True), (2, None, "kannada", False), (3, "b", "kannada", None), (4, "a", "KANNADA", False), (5, "a", "hindi", False), (6, "a", "kannada", False)],
    "('list', 1), ('list', 4), ('open', 3), ('open', 4), ('open', 5), ('open', 6)",
    "kind, line_no",
)
def correction_lists(rows):
    """the first two corrections of a document in a language, and those that are not promoted."""
    some = records.corrections(rows, "a", "kannada", 2).select(F.lit("list").alias("kind"), "line_no")
    return some.unionByName(records.unpromoted(rows.where("document_id is not null")).select(F.lit("open").alias("kind"), "line_no"))


@literal(
    "id int, raw string",
    [(1, "ಗ್ರಾಮ"), (2, "ತಾಲೂಕ"), (3, " survey of land "), (4, "lend"), (5, "lxnx"), (6, " "), (7, None)],
    "(1, 'ಗ್ರಾಮ'), (2, 'ತಾಲೂಕು'), (3, 'land,survey'), (4, 'land'), (5, ''), (6, ''), (7, '')",
    "id, terms",
)
def term_suggestions(rows):
    """O10."""
    return rows.select("id", F.array_join(F.coalesce(metrics.suggestions("raw", ["ಗ್ರಾಮ", "ತಾಲೂಕು", "land", "survey"]), F.array().cast("array<string>")), ",").alias("terms"))


@query("""
WITH w AS (SELECT conv_id, turn, trim(text) AS v, lead(trim(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations),
x AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(v, '\\s+'), lambda w: w <> '')) AS a, list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '') AS b FROM w WHERE s IS NOT NULL)
SELECT conv_id, turn, CASE WHEN contains(s, v) THEN 1.0 WHEN len(a) > 0 AND len(list_filter(a, lambda w: NOT list_contains(b, w))) = 0 THEN 0.9 WHEN len(a) > 0 AND len(list_intersect(a, b)) > 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS score FROM x
""")
def grounding_scores(spark, d):
    """How far each turn's words stand in the next one."""
    c = t(spark, d, "conversations").withColumn("s", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("s is not null")
    return c.select("conv_id", "turn", confidence.grounding_score("text", "s").alias("score"))


@query("""
SELECT o_orderpriority AS document_id, round_even(avg(o_totalprice / 1000000.0), 3) AS detection, 1.0::DOUBLE AS routing, CASE WHEN count(CASE WHEN o_orderstatus <> 'F' OR o_orderpriority LIKE '1%' THEN 1 END) = count(*) THEN 0.5::DOUBLE END AS calibrated FROM orders GROUP BY o_orderpriority
""")
def document_confidences(spark, d):
    """Means by priority, with the defaults for what is missing."""
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("document_id"), (F.col("o_totalprice") / 1000000.0).alias("detection"), F.lit(None).cast("double").alias("routing"), F.when((F.col("o_orderstatus") != "F") | F.col("o_orderpriority").startswith("1"), 0.5).alias("calibrated"))
    return confidence.document_means(o).withColumn("detection", F.bround("detection", 3))


@literal(
    "kind string, name string, page int, x0 double, x1 double, value string, confidence double, region_no int",
    [("field", "owner", 1, 0.0, 10.0, "Ravi", 0.5, None), ("field", "village", 1, 50.0, 60.0, "Shirur", 0.9, None), ("field", "taluk", 2, 0.0, 10.0, "South", 0.9, None), ("hand", None, 1, 0.0, 9.0, "Rama", 0.9, 2), ("hand", None, 1, 1.0, 10.0, " ravi", 0.9, 1), ("hand", None, 1, 58.0, 80.0, "Other", 0.99, 3), ("hand", None, 1, 0.0, 10.0, "Raju", 0.1, 4)],
    "('owner', 'Rama', 0.3::DOUBLE, true), ('village', 'Shirur', 0.9, false), ('taluk', 'South', 0.9, false)",
    "field_name, value, confidence, fused",
)
def resolved_fields(rows):
    """Printed fields against the handwriting that overlaps them, in region order."""
    box = geometry.box(F.col("x0"), F.lit(0.0), F.col("x1"), F.lit(10.0)).alias("box")
    fields = rows.where("kind = 'field'").select(F.lit("d").alias("document_id"), F.col("name").alias("field_name"), "page", box, "value", "confidence")
    hand = rows.where("kind = 'hand'").select(F.lit("d").alias("document_id"), "page", "region_no", box, F.col("value").alias("text"), "confidence")
    return confidence.resolve_fields(fields, hand).select("field_name", "resolved.value", F.round("resolved.confidence", 4).alias("confidence"), "resolved.fused")


@literal(
    "id int, raw string, reference string",
    [(1, "[LOAD_FAILED x]", "a b"), (2, "ಗ್ರಾಮ ಗ್ರಾಮ", "a b"), (3, "abc", "abc"), (4, "one two three", "four five six seven eight"), (5, "one two x y", "one two three four five"), (6, "one two three", "One two THREE"), (7, None, "a")],
    "(1, 'MODEL_ACCESS_OR_LOAD_BLOCKED', true), (2, 'UNTRANSLATED_KANNADA_REMAINS', false), (3, 'EMPTY_OR_TOO_SHORT', true), (4, 'WRONG_CONTENT_HALLUCINATED', true), (5, 'PARTIAL_TRANSLATION_MISSING_CONTENT', true), (6, 'ACCEPTABLE', true), (7, 'EMPTY_OR_TOO_SHORT', false)",
    "id, mode, translated",
)
def translation_failures(rows):
    """F27."""
    return rows.select("id", translate.failure_mode("raw", "reference").alias("mode"), translate.is_translated("raw").alias("translated"))


@literal(
    "id int, fields map<string,string>, a array<string>, b array<string>",
    [(1, {"tehsil": "T", "document_date": "D", "date": "E"}, ["x", ""], ["y", "x"]), (2, {"owner": "O"}, None, ["z", None])],
    "(1, 'date=E,document_date=D,taluk=T,tehsil=T', 'x,y'), (2, 'owner=O', 'z')",
    "id, fields, reasons",
)
def unified_responses(rows):
    """Aliases only where absent, and reasons merged in order."""
    f = F.array_sort(F.map_entries(search.with_aliases(F.col("fields"), search.RESPONSE_ALIASES)))
    return rows.select("id", F.array_join(F.transform(f, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields"), F.array_join(search.merged_reasons("a", "b"), ",").alias("reasons"))


PAGE = "Shri Ramesh Kumar\nSurvey No: 142 - 3\nKhata No: 68-76-470/a\nSite Area: 2200.00 Sq Ft\nWard No: 148-North, Zone 2\nLocality: Shirur\nTaluk: Hosur\nDistrict: Mysuru\nDated 20-09-24"


@literal(
    "document_id string, full_text string",
    [("a", PAGE), ("b", "ರಮೇಶ ರವರ ಹೆಸರಿನಲ್ಲಿ\nnear Kengeri, Bangalore"), ("c", None)],
    "('a', 'owner_name', 'Shri Ramesh Kumar', 0), ('a', 'khasra_number', '142/3', 1), ('a', 'survey_number', '142/3', 1), ('a', 'khatauni_number', '68-76-470/a', 2), ('a', 'site_area', '2200.00 Sq Ft', 3), ('a', 'land_area', '2200.00 Sq Ft', 3), ('a', 'ward', '148-North', 4), ('a', 'locality', 'Shirur', 5), ('a', 'village', 'Shirur', 5), ('a', 'taluk', 'Hosur', 6), ('a', 'tehsil', 'Hosur', 6), ('a', 'sub_division', 'Hosur', 6), ('a', 'district', 'Mysuru', 7), ('a', 'document_date', '20-09-2024', 8), ('a', 'date', '20-09-2024', 8), ('b', 'owner_name', 'ರಮೇಶ', 0), ('b', 'locality', 'Kengeri', 1), ('b', 'village', 'Kengeri', 1), ('b', 'district', 'Bengaluru', NULL)",
    "document_id, field_name, raw_value, line_no",
)
def general_fields(rows):
    """Fields of whole texts by general patterns, with their lines."""
    lines = F.transform(F.split("full_text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("text"), F.lit(0.9).alias("confidence")))
    return fallbacks.general_fields(rows.withColumn("lines", lines), localities={"Kengeri": "Kengeri"}).select("document_id", "field_name", "raw_value", "line_no")
