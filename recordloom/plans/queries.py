"""Queries over the driver's tables, each with its SQL where SQL has the same semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions import dates, geometry, text, units
from recordloom.operators import confidence, datasets, duplicates, extract, layout, metrics, numbers, review, search, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rnd(x: Column | str, n: int = 2) -> Column:
    return F.round(x, n)


def epoch(c: str = "ts") -> Column:
    """Whole seconds of a time without zone; the session's zone is UTC."""
    return F.unix_timestamp(F.col(c).cast("timestamp"))


# ------------------------------------------------------------------ totals and rules


@query("""
WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS line_sum FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, round(o_totalprice, 2) AS header_total, round(line_sum, 2) AS line_total,
       CASE WHEN o_totalprice > 0 AND line_sum > 0 THEN abs(o_totalprice - line_sum) / o_totalprice * 100.0 <= 5.0 END AS sum_matches
FROM orders LEFT JOIN s ON o_orderkey = l_orderkey
""")
def header_vs_lines(spark, d):
    """Header totals against the sums of their lines, within 5 percent; null without lines."""
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("line_sum"))
    out = t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select("o_orderkey", rnd("o_totalprice").alias("header_total"), rnd("line_sum").alias("line_total"), validate.sum_matches("o_totalprice", "line_sum").alias("sum_matches"))


@query("""
WITH items AS (
  SELECT 'supplier' AS kind, s_suppkey AS id, 'acctbal' AS field_name, 'min' AS rule, 'error' AS severity FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT 'customer', c_custkey, 'acctbal', 'min', 'error' FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'part', p_partkey, 'name', 'max_length', 'warning' FROM part WHERE length(p_name) > 12
  UNION ALL SELECT 'part', p_partkey, 'brand', 'pattern', 'error' FROM part WHERE NOT regexp_matches(p_brand, '^(?:Brand#[1-3][0-9]*)')
),
everyone AS (SELECT 'supplier' AS kind, s_suppkey AS id FROM supplier UNION ALL SELECT 'customer', c_custkey FROM customer UNION ALL SELECT 'part', p_partkey FROM part)
SELECT e.kind, e.id, count(i.rule) AS n_items,
       CASE WHEN coalesce(bool_or(i.severity = 'error'), false) THEN 'invalid' WHEN coalesce(bool_or(i.severity = 'warning'), false) THEN 'warning' ELSE 'valid' END AS status
FROM everyone e LEFT JOIN items i USING (kind, id) GROUP BY e.kind, e.id
""")
def rule_violations(spark, d):
    """Violations of minimum, length and pattern rules, and the worst severity of each row."""
    c, s, p = t(spark, d, "customer"), t(spark, d, "supplier"), t(spark, d, "part")
    field = lambda kind, key, name, value: F.struct(F.lit(kind).alias("state"), F.lit(name).alias("field_name"), F.col(value).cast("string").alias("raw_value"))
    rows = (
        s.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.array(field("supplier", "id", "acctbal", "s_acctbal")).alias("f"))
        .unionByName(c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.array(field("customer", "id", "acctbal", "c_acctbal")).alias("f")))
        .unionByName(p.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.array(field("part", "id", "name", "p_name"), field("part", "id", "brand", "p_brand")).alias("f")))
    )
    rules = spark.createDataFrame(
        [("supplier", "acctbal", 0.0, None, None, None, None, None), ("customer", "acctbal", 0.0, None, None, None, None, None), ("part", "name", None, None, None, None, 12, None), ("part", "brand", None, None, "Brand#[1-3][0-9]*", None, None, None)],
        "state string, field_name string, min double, max double, pattern string, min_length int, max_length int, is_date boolean",
    )
    fields = rows.select("kind", "id", F.explode("f").alias("f")).select(F.struct("kind", "id").alias("document_id"), "f.*", F.lit(None).cast("string").alias("normalized_value"))
    items = validate.rule_items(fields, F.broadcast(rules)).select("document_id.*", "rule", "severity")  # four rules
    return rows.select("kind", "id").join(items, ["kind", "id"], "left").groupBy("kind", "id").agg(F.count("rule").alias("n_items"), validate.worst("severity").alias("status"))


@query("""
SELECT l_orderkey, l_linenumber, l_shipdate < o_orderdate AS ships_before_order,
       regexp_matches(CAST(l_partkey AS VARCHAR), '^(?:19|20)[0-9]{2}$') AS part_is_year,
       (l_suppkey = day(l_shipdate) OR l_suppkey = month(l_shipdate)) AS supplier_is_date_part,
       (CAST(l_shipdate < o_orderdate AS INTEGER) + CAST(regexp_matches(CAST(l_partkey AS VARCHAR), '^(?:19|20)[0-9]{2}$') AS INTEGER)
        + CAST((l_suppkey = day(l_shipdate) OR l_suppkey = month(l_shipdate)) AS INTEGER)) AS n_inconsistent
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def cross_field_checks(spark, d):
    """Dates out of order, numbers that look like a year, numbers that are part of a date."""
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    late = F.col("l_shipdate") < F.col("o_orderdate")
    year = F.col("l_partkey").cast("string").rlike(validate.YEAR_LIKE)
    part = (F.col("l_suppkey") == F.dayofmonth("l_shipdate")) | (F.col("l_suppkey") == F.month("l_shipdate"))
    return j.select("l_orderkey", "l_linenumber", late.alias("ships_before_order"), year.alias("part_is_year"), part.alias("supplier_is_date_part"), (late.cast("int") + year.cast("int") + part.cast("int")).alias("n_inconsistent"))


@query("""
SELECT n.n_nationkey, n.n_name, 'required' AS rule FROM nation n
WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000)
""")
def missing_required(spark, d):
    """nations without the field that all need: a supplier with a balance over 9000."""
    have = t(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("document_id"), F.lit("rich_supplier").alias("field_name"), F.lit("x").alias("raw_value"))
    docs = t(spark, d, "nation").select(F.col("n_nationkey").alias("document_id"), F.lit("ANY").alias("state"), "n_name")
    need = spark.createDataFrame([("ANY", "rich_supplier")], "state string, field_name string")
    out = validate.missing_required(docs, have, F.broadcast(need)).join(docs.select("document_id", "n_name"), "document_id")
    return out.select(F.col("document_id").alias("n_nationkey"), "n_name", "rule")


# ------------------------------------------------------------------ search and review


@query("""
WITH m AS (SELECT o_custkey, min(o_orderkey) AS first_order, count(*) AS n_orders FROM orders WHERE o_orderpriority ILIKE '%urgent%' GROUP BY o_custkey)
SELECT c_custkey, c_name, CASE WHEN c_name ILIKE '%00001%' AND m.o_custkey IS NOT NULL THEN 'both' WHEN c_name ILIKE '%00001%' THEN 'filename' ELSE 'field' END AS match_source,
       coalesce(n_orders, 0) AS n_matched
FROM customer LEFT JOIN m ON c_custkey = o_custkey
WHERE c_name ILIKE '%00001%' OR m.o_custkey IS NOT NULL
ORDER BY c_acctbal DESC, c_custkey OFFSET 20 LIMIT 50
""")
def search_page(spark, d):
    """Customers by name or by an order's priority, one page of them."""
    orders = t(spark, d, "orders").where(search.like("o_orderpriority", "urgent"))
    matched = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_matched"))
    by_name = search.like("c_name", "00001")
    found = t(spark, d, "customer").join(matched, "c_custkey", "left").where(by_name | F.col("n_matched").isNotNull())
    found = found.withColumn("match_source", F.when(by_name & F.col("n_matched").isNotNull(), "both").when(by_name, "filename").otherwise("field"))
    out = search.page(found, [F.desc("c_acctbal"), F.col("c_custkey")], 20, 50)
    return out.select("c_custkey", "c_name", "match_source", F.coalesce("n_matched", F.lit(0)).alias("n_matched"))


@query("""
SELECT l_returnflag AS field_name, count(*) AS n, coalesce(round(avg(l_discount), 2), 0.0) AS average
FROM lineitem WHERE l_discount >= 0.05 GROUP BY l_returnflag
UNION ALL SELECT 'none', 0, 0.0
""")
def field_filter_avg(spark, d):
    """numbers and means above a threshold, and the default for a filter that leaves nothing."""
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("field_name"), F.col("l_discount").alias("confidence"))
    kept = search.field_list(rows, 0.05)
    per = kept.groupBy("field_name").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg("confidence"), 2), F.lit(0.0)).alias("average"))
    none = search.mean_confidence(search.field_list(rows, 0.05, "absent")).select(F.lit("none").alias("field_name"), "n", "average")
    return per.unionByName(none)


@query("""
SELECT l.doc_id, 'review' AS origin FROM labels l WHERE l.toxic = 1
UNION ALL
SELECT l.doc_id, 'low_confidence' FROM labels l WHERE l.quality = 0 AND l.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def low_conf_supplement(spark, d):
    """Flagged documents, and those of low quality that are not flagged."""
    rows = t(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.lit("all").alias("field_name"), F.col("quality").cast("double").alias("confidence"), "toxic")
    out = review.supplement(rows.where("toxic = 1").drop("toxic"), rows.drop("toxic"))
    return out.select(F.col("document_id").alias("doc_id"), "origin")


@query("""
SELECT event_id, user_id, round((1.0 - least(value / 100.0, 1.0)) * 10.0 + CASE WHEN event_type = 'purchase' THEN 10.0 ELSE 0.0 END, 4) AS priority
FROM events ORDER BY (1.0 - least(value / 100.0, 1.0)) * 10.0 + CASE WHEN event_type = 'purchase' THEN 10.0 ELSE 0.0 END DESC, event_id LIMIT 100
""")
def review_priority(spark, d):
    """The hundred most urgent events."""
    p = review.priority(F.least(F.col("value") / 100.0, F.lit(1.0)), F.col("event_type") == "purchase", F.lit("x"))
    return t(spark, d, "events").withColumn("p", p).orderBy(F.desc("p"), "event_id").limit(100).select("event_id", "user_id", rnd("p", 4).alias("priority"))


@query("""
SELECT count(*) AS total, count_if(o_orderstatus IN ('O', 'P'))::BIGINT AS pending, count_if(o_orderstatus = 'F')::BIGINT AS completed,
       round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS completed_value FROM orders
""")
def queue_stats(spark, d):
    """Numbers of pending and completed rows."""
    s = F.col("o_orderstatus")
    return t(spark, d, "orders").agg(F.count(F.lit(1)).alias("total"), F.count_if(s.isin("O", "P")).alias("pending"), F.count_if(s == "F").alias("completed"), rnd(F.sum(F.when(s == "F", F.col("o_totalprice")).otherwise(0.0))).alias("completed_value"))


@query("""
SELECT conv_id, turn, CASE
  WHEN text IS NULL OR regexp_replace(text, '\\s', '', 'g') = '' THEN 'OCR output is empty; officer inspection required'
  WHEN role = 'user' AND length(text) > 200 THEN 'Multi-word line crop routed to a word model; officer review required'
  WHEN least(length(text) / 100.0, 1.0) < 0.60 THEN 'low'
  END AS reason FROM conversations
""")
def region_routing(spark, d):
    """turns as regions, with the first reason for review."""
    raw = F.least(F.length("text") / 100.0, F.lit(1.0))
    kind = F.when(F.length("text") > 200, "line").otherwise("word")
    s = review.region_status(F.col("role") == "user", raw, F.lit(0.5), kind, F.col("text"))
    return t(spark, d, "conversations").select("conv_id", "turn", F.when(s["reason"].startswith("Low recognizer"), "low").otherwise(s["reason"]).alias("reason"))


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(event_id) FILTER (WHERE event_type = 'purchase') AS last_purchase, count(*) AS n_events
FROM events GROUP BY user_id
""")
def latest_state(spark, d):
    """Each user's last event."""
    e = t(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("last_purchase"), F.count(F.lit(1)).alias("n_events"))


# ------------------------------------------------------------------ joins


@query("""
WITH parcel AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
probe AS (SELECT s_suppkey AS id, s_nationkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'NATION' ELSE 'X' || s_nationkey END AS given, s_acctbal FROM supplier),
exact AS (SELECT p.*, q.n_name AS exact_name FROM probe p LEFT JOIN parcel q ON p.k = q.n_nationkey AND p.given = upper(q.n_name)),
part AS (SELECT e.id, min(q.n_name) AS part_name FROM exact e JOIN parcel q ON e.k = q.n_nationkey
         WHERE e.exact_name IS NULL AND (contains(upper(q.n_name), e.given) OR contains(e.given, upper(q.n_name))) GROUP BY e.id)
SELECT e.id, coalesce(e.exact_name, p.part_name) AS parcel,
       CASE WHEN coalesce(e.exact_name, p.part_name) IS NULL THEN 'UNKNOWN' WHEN e.s_acctbal < 0 THEN 'MISMATCH' ELSE 'MATCH' END AS status
FROM exact e LEFT JOIN part p USING (id)
""")
def parcel_exact_fuzzy(spark, d):
    """Suppliers to nations by all keys, then by a part of the name under the same number."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("k"), F.when(F.col("s_suppkey") % 3 == 0, "NATION").otherwise(F.concat(F.lit("X"), F.col("s_nationkey").cast("string"))).alias("given"), "s_acctbal")
    e = s.join(n.withColumnRenamed("n_name", "exact_name"), (F.col("k") == F.col("n_nationkey")) & (F.col("given") == F.upper("exact_name")), "left").drop("n_nationkey")
    part = e.where("exact_name is null").join(n, F.col("k") == F.col("n_nationkey")).where(F.contains(F.upper("n_name"), "given") | F.contains("given", F.upper("n_name"))).groupBy("id").agg(F.min("n_name").alias("part_name"))
    out = e.join(part, "id", "left").withColumn("parcel", F.coalesce("exact_name", "part_name"))
    return out.select("id", "parcel", F.when(F.col("parcel").isNull(), "UNKNOWN").when(F.col("s_acctbal") < 0, "MISMATCH").otherwise("MATCH").alias("status"))


@query("""
WITH a AS (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY l_partkey)
SELECT p_partkey, round(abs(p_retailprice - price) * 100.0 / nullif(price, 0), 2) AS deviation, abs(p_retailprice - price) * 100.0 / nullif(price, 0) > 10.0 AS mismatch
FROM part LEFT JOIN a ON p_partkey = l_partkey
""")
def area_deviation(spark, d):
    """A part's price against the mean of its lines; over 10 percent is a mismatch."""
    a = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    off = units.deviation_percent("p_retailprice", "price")
    return t(spark, d, "part").join(a, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", rnd(off).alias("deviation"), (off > 10.0).alias("mismatch"))


@query("""
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT vec_id,
  ((CASE WHEN (-0.1 > y) <> (-0.1 > y) THEN 1 ELSE 0 END)
  + (CASE WHEN (-0.1 > y) <> (0.12 > y) AND x < 0.1 + (y + 0.1) * (0.0 - 0.1) / (0.12 + 0.1) THEN 1 ELSE 0 END)
  + (CASE WHEN (0.12 > y) <> (-0.1 > y) AND x < 0.0 + (y - 0.12) * (-0.1 - 0.0) / (-0.1 - 0.12) THEN 1 ELSE 0 END)) % 2 = 1 AS inside,
  round(round_even(sqrt(pow((y - (-0.08 / 3)) * 111320.0, 2) + pow(x * 111320.0 * cos(radians(-0.08 / 3)), 2)), 1), 0) AS metres
FROM p
""")
def point_in_polygon(spark, d):
    """Two components of each vector as a point, against a triangle and its centre."""
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((-0.1, -0.1), (0.1, -0.1), (0.0, 0.12))])
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    c = geometry.centroid(ring)
    return e.select("vec_id", geometry.contains(ring, F.col("x"), F.col("y")).alias("inside"), F.round(geometry.planar_metres(c["lon"], c["lat"], F.col("x"), F.col("y")), 0).alias("metres"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x0, l_linenumber * 3.0 AS y0, l_quantity + 10.0 + l_discount * 100 AS x1, l_linenumber * 3.0 + 8.0 AS y1 FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_linenumber AS a, c.l_linenumber AS b,
       greatest(0.0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0.0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i,
       (a.x1 - a.x0) * (a.y1 - a.y0) AS u, (c.x1 - c.x0) * (c.y1 - c.y0) AS v
      FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.l_linenumber < c.l_linenumber)
SELECT l_orderkey, a, b, round(i / (u + v - i), 4) AS iou FROM p WHERE i / (u + v - i) >= 0.25
""")
def iou_pairs(spark, d):
    """Boxes made from lines, overlapping pairs within an order."""
    l = t(spark, d, "lineitem")
    y = F.col("l_linenumber") * 3.0
    b = l.select("l_orderkey", "l_linenumber", geometry.box(F.col("l_quantity"), y, F.col("l_quantity") + 10.0 + F.col("l_discount") * 100, y + 8.0).alias("box"))
    other = b.select("l_orderkey", F.col("l_linenumber").alias("b"), F.col("box").alias("box_b"))
    j = b.join(other, "l_orderkey").where(F.col("l_linenumber") < F.col("b"))
    value = geometry.iou(F.col("box"), F.col("box_b"))
    return j.where(value >= 0.25).select("l_orderkey", F.col("l_linenumber").alias("a"), "b", rnd(value, 4).alias("iou"))


@query("""
SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)
""")
def contains_benchmark(spark, d):
    """Documents that hold a benchmark text; its longest word is the equi key before the comparison."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([^ \\t-\\r]+)"), F.lit(1)))
    b = t(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    inner = F.slice(words("passage"), 1, 1_000_000)
    # words at the edges may stand within longer ones of the document, so the key is an inner word
    whole = F.regexp_extract_all("passage", F.lit("(?<= )([^ \\t-\\r]+)(?= )"), F.lit(1))
    key = F.element_at(F.array_sort(F.transform(whole, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    keyed = b.withColumn("w", F.when(F.size(whole) > 0, key))
    docs = t(spark, d, "documents").select("doc_id", "text")
    wanted = keyed.where("w is not null").select("w").distinct()
    parts = docs.select("doc_id", F.explode(words("text")).alias("w")).join(wanted, "w").join(keyed, "w").select("doc_id", "item_id", "passage")
    found = parts.join(docs, "doc_id").where(F.contains("text", "passage")).select("doc_id", "item_id")
    short = keyed.where("w is null").select("item_id", "passage")
    rest = docs.join(short, F.contains("text", "passage")).select("doc_id", "item_id")
    return found.unionByName(rest)


@query("""
WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
b AS (SELECT event_id AS p, user_id, ts AS pts FROM events WHERE event_type = 'purchase'),
j AS (SELECT a.event_id, p, pts, a.ts, row_number() OVER (PARTITION BY a.event_id ORDER BY pts, p) AS r FROM a JOIN b USING (user_id) WHERE pts >= a.ts AND pts <= a.ts + INTERVAL 7 DAY)
SELECT event_id, p AS purchase_id, floor(epoch(pts))::BIGINT - floor(epoch(ts))::BIGINT AS seconds FROM j WHERE r = 1
""")
def nearest_right(spark, d):
    """For each view the user's nearest purchase within seven days; purchases are read once, in order, not joined pairwise."""
    e = t(spark, d, "events").where("event_type in ('view', 'purchase')")
    buy = F.when(F.col("event_type") == "purchase", F.struct(epoch().alias("at"), "event_id", "ts"))
    order = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(0, Window.unboundedFollowing)
    out = e.withColumn("next", F.first(buy, ignorenulls=True).over(order)).where("event_type = 'view'")
    near = F.col("next.ts") <= F.col("ts") + F.expr("INTERVAL 7 DAY")
    return out.where(near).select("event_id", F.col("next.event_id").alias("purchase_id"), (F.col("next.at") - epoch()).alias("seconds"))


@query("""
WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS t FROM conversations),
j AS (SELECT a.conv_id, a.turn, a.t AS x, b.t AS y FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, len(list_intersect(x, y))::INTEGER AS n_common, len(list_filter(x, lambda v: NOT list_contains(y, v))) = 0 AS subset FROM j
""")
def token_overlap(spark, d):
    """Words that a turn shares with the next one."""
    w = t(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("x"))
    j = w.join(w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])
    return j.select("conv_id", "turn", F.size(F.array_intersect("x", "y")).alias("n_common"), (F.size(F.array_except("x", "y")) == 0).alias("subset"))


# ------------------------------------------------------------------ duplicates


@query("""
WITH h AS (SELECT doc_id, coalesce(sha256(text), 'row ' || doc_id) AS h FROM documents)
SELECT doc_id, lag(doc_id) OVER (PARTITION BY h ORDER BY doc_id) AS duplicate_of, min(doc_id) OVER (PARTITION BY h) AS first_id, count(*) OVER (PARTITION BY h) AS n FROM h
""")
def exact_duplicates(spark, d):
    """Each document's last and first earlier copy; a null text is no copy of another."""
    docs = t(spark, d, "documents").select("doc_id", text.sha256("text").alias("h"))
    one = docs.groupBy(F.col("h").alias("g")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    found = duplicates.exact(docs, "doc_id", "doc_id", "h")
    return found.join(one, found["h"].eqNullSafe(one["g"])).select("doc_id", F.when(F.col("h").isNotNull(), F.col("duplicate_of")).alias("duplicate_of"), F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("first_id"), F.when(F.col("h").isNull(), 1).otherwise(F.col("n")).alias("n"))


@query("""
WITH k AS (SELECT p_partkey, concat_ws('|', p_brand, p_type, CAST(p_size AS VARCHAR)) AS key FROM part)
SELECT p_partkey, min(p_partkey) OVER (PARTITION BY key) AS first_key, count(*) OVER (PARTITION BY key) AS n FROM k
""")
def field_hash_duplicates(spark, d):
    """Parts by the digest of their sorted fields."""
    p = t(spark, d, "part")
    h = duplicates.field_digest(F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string")))
    p = p.select("p_partkey", h.alias("h"))
    # the digest of a map is never null
    return p.join(p.groupBy("h").agg(F.min("p_partkey").alias("first_key"), F.count(F.lit(1)).alias("n")), "h").select("p_partkey", "first_key", "n")


@query("""
WITH p AS (SELECT a.vec_id, b.vec_id AS other, a.label,
   round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS k FROM p)
SELECT vec_id, other AS other_id, round(s, 6) AS similarity FROM r WHERE k = 1
""")
def vector_top1(spark, d):
    """The nearest vector of the same label, for the vectors whose id is divisible by 20, in blocks and without emitting pairs."""
    found = duplicates.nearest_in_block(t(spark, d, "embeddings"), "vec_id", "embedding", "label", asked=F.col("vec_id") % 20 == 0)
    return found.select(F.col("id").alias("vec_id"), "other_id", rnd("similarity", 6).alias("similarity"))


# ------------------------------------------------------------------ text


@query("""
WITH l AS (SELECT doc_id, lower(text) AS t, lang FROM documents),
h AS (SELECT doc_id, lang, (contains(t, 'the '))::INT + (contains(t, 'and '))::INT + (contains(t, 'tion'))::INT AS a,
   (contains(t, 'der '))::INT + (contains(t, 'und '))::INT + (contains(t, 'sch'))::INT AS b, (contains(t, 'ñ'))::INT + (contains(t, 'ción'))::INT AS c, contains(t, 'license') AS lic FROM l)
SELECT doc_id, CASE WHEN a + b + c = 0 THEN 'none' WHEN lic THEN 'licensed' WHEN c >= 2 THEN 'es' WHEN b >= 2 THEN 'de' WHEN a >= 2 THEN 'en' ELSE 'other' END AS kind, a + b + c AS n_hits FROM h
""")
def keyword_classify(spark, d):
    """Keyword counts and an ordered list of decisions."""
    low = F.lower("text")
    a, b, c = extract.hits(low, ("the ", "and ", "tion")), extract.hits(low, ("der ", "und ", "sch")), extract.hits(low, ("ñ", "ción"))
    kind = F.when(a + b + c == 0, "none").when(F.contains(low, F.lit("license")), "licensed").when(c >= 2, "es").when(b >= 2, "de").when(a >= 2, "en").otherwise("other")
    return t(spark, d, "documents").select("doc_id", kind.alias("kind"), (a + b + c).alias("n_hits"))


@query("""
WITH p AS (SELECT role, text AS r, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations),
u AS (SELECT list_sort(list(DISTINCT ch)) AS chars FROM (SELECT unnest(string_split(text, '')) AS ch FROM conversations) WHERE unicode(ch) > 126 OR unicode(ch) < 32),
t AS (SELECT array_to_string(chars, '') AS chars, array_to_string(list_transform(range(len(chars)), lambda i: chr((i + 1)::INTEGER)), '') AS codes, len(chars) AS k FROM u),
e AS (SELECT role, CASE WHEN k < 32 THEN levenshtein(translate(r, chars, codes), translate(h, chars, codes)) END AS d, length(r) AS n, length(h) AS m FROM p, t WHERE h IS NOT NULL)
SELECT role, count(*) AS n_pairs, sum(d)::BIGINT AS char_edits, sum(n)::BIGINT AS chars, round(sum(d) / sum(n), 4) AS cer, grouping(role)::INTEGER AS is_total FROM e GROUP BY ROLLUP (role)
""")
def cer_by_role(spark, d):
    """Edits from each turn to the next one, by role and in all.

    SQL counts edits of bytes, so there each of the few other characters stands for a control character of one byte.
    """
    c = t(spark, d, "conversations").withColumn("r", F.col("text"))
    p = c.withColumn("h", F.lead("r").over(Window.partitionBy("conv_id").orderBy("turn"))).where("h is not null")
    out = metrics.error_rates(p, "r", "h", "role")
    return out.select("role", F.col("n").alias("n_pairs"), F.col("char_edits").cast("long").alias("char_edits"), F.col("chars").cast("long").alias("chars"), F.round(F.col("char_edits") / F.col("chars"), 4).alias("cer"), "is_total")


@query("""
WITH s AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), g AS (SELECT ch, count(*) AS n FROM s WHERE ch <> '' GROUP BY ch)
SELECT ch, n, n < 50 AS rare FROM g ORDER BY n DESC, ch LIMIT 30
""")
def char_audit(spark, d):
    """The thirty most frequent characters."""
    return datasets.label_audit(t(spark, d, "documents"), "text").select("ch", "n", "rare").orderBy(F.desc("n"), "ch").limit(30)


@query("""
SELECT user_id, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum, max((props->>'$.k')::BIGINT) AS k_max FROM events GROUP BY user_id
""")
def json_props(spark, d):
    """Typed values out of JSON text."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query(r"""
SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::INTEGER AS n_links,
       length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')))::INTEGER AS n_text
FROM pages
""")
def html_pages(spark, d):
    """Titles, links and plain text of pages."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))
    return t(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("n_links"), F.length(plain).alias("n_text"))


_AREAS = (("2 bigha", 0.2529), ("1.5 acre", 0.404686), ("3 hectare", 1.0), ("12.25 guntha", 0.010117), ("no number", 1.0), ("7", 1.0))


@query("""
WITH v(i, raw, f) AS (VALUES (0, '2 bigha', 0.2529::DOUBLE), (1, '1.5 acre', 0.404686::DOUBLE), (2, '3 hectare', 1.0::DOUBLE), (3, '12.25 guntha', 0.010117::DOUBLE), (4, 'no number', 1.0::DOUBLE), (5, '7', 1.0::DOUBLE))
SELECT p_partkey, raw, coalesce(round(try_cast(nullif(regexp_extract(raw, '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE) * f, 6), 0.0) AS hectares FROM part JOIN v ON p_partkey % 6 = i
""")
def unit_convert(spark, d):
    """Areas in several units as hectares."""
    raw = F.get(F.array(*[F.lit(a) for a, _ in _AREAS]), (F.col("p_partkey") % 6).cast("int"))
    return t(spark, d, "part").select("p_partkey", raw.alias("raw")).withColumn("hectares", units.to_hectares("raw"))


_DATES = ("15/08/2023", "26-01-2024", "1/2/2020", "31.12.1999", "2021-07-04", "2021/02/30", "soon")


@query("""
WITH v(i, raw) AS (VALUES (0, '15/08/2023'), (1, '26-01-2024'), (2, '1/2/2020'), (3, '31.12.1999'), (4, '2021-07-04'), (5, '2021/02/30'), (6, 'soon'))
SELECT s_suppkey, raw, coalesce(strftime(coalesce(try_strptime(raw, '%d/%m/%Y'), try_strptime(raw, '%d-%m-%Y'), try_strptime(raw, '%d.%m.%Y'), try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%Y/%m/%d')), '%Y-%m-%d'), raw) AS iso
FROM supplier JOIN v ON s_suppkey % 7 = i
""")
def date_parse(spark, d):
    """Dates in several formats as ISO text; what is no date stays."""
    raw = F.get(F.array(*[F.lit(x) for x in _DATES]), (F.col("s_suppkey") % 7).cast("int"))
    return t(spark, d, "supplier").select("s_suppkey", raw.alias("raw")).withColumn("iso", dates.normalize("raw"))


# ------------------------------------------------------------------ windows


@query("""
WITH c AS (SELECT conv_id, turn, trim(text) AS x FROM conversations),
w AS (SELECT conv_id, turn, x, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2 FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, 1 AS window_size, sha256(x) AS digest FROM w
UNION ALL SELECT conv_id, turn, 2, sha256(x || ' ' || x1) FROM w WHERE x1 IS NOT NULL
UNION ALL SELECT conv_id, turn, 3, sha256(x || ' ' || x1 || ' ' || x2) FROM w WHERE x2 IS NOT NULL
""")
def line_windows(spark, d):
    """One to three turns from each one on, joined."""
    out = layout.line_windows(t(spark, d, "conversations"), "conv_id", ["turn"], "text")
    return out.select("conv_id", "turn", "window_size", text.sha256("window_text").alias("digest"))


@query("""
SELECT conv_id, turn, lead(turn) OVER w AS answer_turn, length(lead(text) OVER w)::INTEGER AS answer_length FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY role = 'user' AND lead(role) OVER w = 'assistant'
""")
def adjacent_value(spark, d):
    """The answer that follows a user's turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t(spark, d, "conversations").withColumns({"answer_turn": F.lead("turn").over(w), "answer_length": F.length(F.lead("text").over(w)), "next_role": F.lead("role").over(w)})
    return c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "answer_turn", "answer_length")


@query("""
WITH g AS (SELECT event_id, user_id, ts, CASE WHEN floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800 THEN 1 ELSE 0 END AS n FROM events)
SELECT event_id, user_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS island FROM g
""")
def gap_islands(spark, d):
    """A user's sessions with gaps of half an hour."""
    e = t(spark, d, "events").withColumn("at", epoch())
    return layout.islands(e, "user_id", ["ts", "event_id"], "at", F.lit(1800)).select("event_id", "user_id", "island")


@query("""
WITH RECURSIVE v AS (SELECT user_id, round(value, 2) AS x, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 2), event_id) AS k FROM events),
f AS (SELECT user_id, k, x, x AS first, 0 AS row_no FROM v WHERE k = 1
      UNION ALL SELECT v.user_id, v.k, v.x, CASE WHEN abs(v.x - f.first) > 12 THEN v.x ELSE f.first END, f.row_no + CASE WHEN abs(v.x - f.first) > 12 THEN 1 ELSE 0 END
      FROM f JOIN v ON v.user_id = f.user_id AND v.k = f.k + 1)
SELECT user_id, count(*) AS n, max(row_no)::INTEGER + 1 AS n_rows FROM f GROUP BY user_id
""")
def row_cluster_anchor(spark, d):
    """Values of a user as rows of tokens, by the distance from a row's first."""
    e = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.round("value", 2))).alias("v"))
    return e.select("user_id", F.size("v").cast("long").alias("n"), (F.element_at(layout.anchored_clusters(F.col("v"), 12.0), -1) + 1).alias("n_rows"))


@query("""
SELECT conv_id, turn, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) > 1 AS is_duplicate FROM conversations
""")
def first_seen_dup(spark, d):
    """Turns whose text stood before."""
    return datasets.first_seen(t(spark, d, "conversations"), "text", "conv_id", "turn").select("conv_id", "turn", "is_duplicate")


_SPLIT = """
k AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
z AS (SELECT *, CASE WHEN n <= 1 THEN n WHEN n = 2 THEN 1 ELSE greatest(1, least(n - 1, round_even(n * 0.8, 0)::BIGINT)) END AS tr FROM k),
y AS (SELECT *, CASE WHEN n = 2 THEN 1 WHEN n <= 1 THEN 0 WHEN n - tr > 1 THEN greatest(1, least(n - tr - 1, round_even(n * 0.1, 0)::BIGINT)) ELSE n - tr END AS va FROM z),
s AS (SELECT doc_id, lang, text, CASE WHEN r <= tr THEN 'train' WHEN r <= tr + va THEN 'val' ELSE 'test' END AS split FROM y)
"""


@query(f"WITH {_SPLIT.strip()} SELECT doc_id, lang, split FROM s")
def stratified_split(spark, d):
    """Training, validation and test rows of each language, by a portable order."""
    return datasets.stratified_split(t(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(f"""WITH {_SPLIT.strip()} SELECT lang, count_if(split = 'train')::BIGINT AS train, count_if(split = 'val')::BIGINT AS val, count_if(split = 'test')::BIGINT AS test, count(*) AS total FROM s GROUP BY lang""")
def split_distribution(spark, d):
    """A20."""
    return datasets.split_counts(datasets.stratified_split(t(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id"), "lang")


@query(f"""WITH {_SPLIT.strip()}, h AS (SELECT DISTINCT sha256(text) AS h, split FROM s)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_shared FROM h a JOIN h b ON a.h = b.h AND a.split < b.split GROUP BY ALL""")
def split_leakage(spark, d):
    """Texts that stand in two splits."""
    rows = datasets.stratified_split(t(spark, d, "documents").select("doc_id", "lang", text.sha256("text").alias("h")), "lang", "doc_id")
    return datasets.leakage(rows, "h")


@query("""
WITH x AS (SELECT doc_id, unnest(list_distinct([lang, source, CASE WHEN n_chars > 4000 THEN 'long' ELSE 'short' END])) AS tag FROM documents),
r AS (SELECT doc_id, tag, row_number() OVER (PARTITION BY tag ORDER BY sha256('42:' || doc_id), doc_id) AS k FROM x)
SELECT doc_id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM r WHERE k <= 20 GROUP BY doc_id
""")
def coverage_sample(spark, d):
    """Up to twenty documents of each language, source and length, with the tags they were taken for."""
    docs = t(spark, d, "documents").select("doc_id", F.array("lang", "source", F.when(F.col("n_chars") > 4000, "long").otherwise("short")).alias("tags"))
    return datasets.coverage_sample(docs, "doc_id", "tags", 20).select("doc_id", F.array_join("tags", ",").alias("tags"))


# ------------------------------------------------------------------ confidence


@query("""
WITH s AS (SELECT l.doc_id, least(d.n_chars / 4000.0::DOUBLE, 1.0) AS c, l.quality AS y FROM labels l JOIN documents d USING (doc_id)),
b AS (SELECT i, i * 0.1::DOUBLE AS lo, (i + 1) * 0.1::DOUBLE AS hi FROM range(0, 10) r(i)),
g AS (SELECT i, count(c) AS n, avg(y::DOUBLE) AS acc, avg(c) AS conf, (any_value(lo) + any_value(hi)) / 2 AS mid
      FROM b LEFT JOIN s ON (c >= lo AND c < hi) OR (i = 9 AND c = 1.0) GROUP BY i),
e AS (SELECT round(round_even(sum(n * abs(acc - conf)) / sum(n), 4), 3) AS ece, round(round_even(max(abs(acc - conf)), 4), 3) AS mce FROM g)
SELECT i::INTEGER AS bin, n, coalesce(round(round_even(acc, 4), 3), 0.0) AS accuracy, round(round_even(coalesce(conf, mid), 4), 3) AS confidence, ece, mce FROM g, e
""")
def reliability_bins(spark, d):
    """Bins of a score made from the length, against quality; empty bins stay."""
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("c"), F.col("quality").alias("y"))
    out = confidence.reliability(rows, "c", "y")
    return out.select("bin", "n", *[rnd(c, 3).alias(c) for c in ("accuracy", "confidence", "ece", "mce")])


@query("""
WITH s AS (SELECT d.lang, l.quality::DOUBLE AS c, greatest(1, d.n_chars) AS w FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT lang, round(sum(CASE WHEN c IS NOT NULL THEN c * w END) / sum(CASE WHEN c IS NOT NULL THEN w END), 4) AS weighted, CASE WHEN count(c) = count(*) THEN round(avg(c), 4) END AS mean_if_all, count(c) AS n FROM s GROUP BY lang
""")
def length_weighted_mean(spark, d):
    """Quality weighted by length; a plain mean only where all rows have a label."""
    rows = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(t(spark, d, "labels"), "doc_id", "left").withColumn("c", F.col("quality").cast("double"))
    return rows.groupBy("lang").agg(rnd(confidence.weighted_mean("c", "n_chars"), 4).alias("weighted"), rnd(confidence.mean_if_all("c"), 4).alias("mean_if_all"), F.count("c").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount IS NULL THEN 'UNKNOWN' WHEN 1 - l_discount * 8 >= 0.85 THEN 'HIGH' WHEN 1 - l_discount * 8 >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM lineitem
""")
def confidence_tiers(spark, d):
    """F18."""
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", confidence.tier(1 - F.col("l_discount") * 8).alias("tier"))


@query("""
SELECT event_id, round(1.0 / (1.0 + exp(-(3.0 * least(value / 100.0, 1.0) - 1.5))), 4) AS calibrated FROM events
""")
def calibrated_scores(spark, d):
    """Platt scaling of a score."""
    s = 1.0 / (1.0 + F.exp(-(3.0 * F.least(F.col("value") / 100.0, F.lit(1.0)) - 1.5)))
    return t(spark, d, "events").select("event_id", rnd(s, 4).alias("calibrated"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS rank, o_totalprice - lead(o_totalprice) OVER w AS lead_price FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
SELECT o_custkey, o_orderkey, rank::INTEGER AS rank, coalesce(lead_price < 1000, false) AS needs_review FROM r WHERE rank <= 3
""")
def ranked_candidates(spark, d):
    """The three best candidates with their lead over the next."""
    rows = t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("candidate_no"), F.col("o_totalprice").alias("score"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("score"), "candidate_no")
    out = rows.withColumns({"rank": F.row_number().over(w), "lead": F.col("score") - F.lead("score").over(w)}).where("rank <= 3")
    return out.select("o_custkey", F.col("candidate_no").alias("o_orderkey"), "rank", F.coalesce(F.col("lead") < 1000, F.lit(False)).alias("needs_review"))


@query("""
SELECT label, l.split, count(*) AS n FROM (SELECT label, CASE WHEN vec_id % 10 < 8 THEN 'train' ELSE 'val' END AS split FROM embeddings) l GROUP BY label, l.split
""")
def dataset_counts(spark, d):
    """Numbers by class and split."""
    e = t(spark, d, "embeddings").withColumn("split", F.when(F.col("vec_id") % 10 < 8, "train").otherwise("val"))
    return datasets.dataset_audit(e, "label", "split").select("label", "split", "n")


@query("""
WITH e AS (SELECT doc_id, quality AS v FROM labels WHERE doc_id % 2 = 0), p AS (SELECT doc_id, toxic AS v FROM labels WHERE doc_id % 3 = 0)
SELECT coalesce(e.doc_id, p.doc_id) AS doc_id, CASE WHEN e.doc_id IS NULL THEN 'FALSE_POSITIVE' WHEN p.doc_id IS NULL THEN 'MISSING' WHEN e.v = p.v THEN 'CORRECT' ELSE 'INCORRECT' END AS outcome FROM e FULL JOIN p ON e.doc_id = p.doc_id
""")
def eval_outcomes(spark, d):
    """Expected and predicted values in a full outer join."""
    l = t(spark, d, "labels")
    e = l.where("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("e"))
    p = l.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("p"))
    return e.join(p, "doc_id", "full").select("doc_id", metrics.outcome("e", "p", F.col("e") == F.col("p")).alias("outcome"))


# ------------------------------------------------------------------ without SQL


@query()
def number_roles(spark, d):
    """Numbers in documents and their roles."""
    return numbers.number_roles(t(spark, d, "documents"), "doc_id", "text")


@query()
def word_error_rates(spark, d):
    """X20 over words, A02: each turn against the next one."""
    c = t(spark, d, "conversations")
    p = c.withColumn("h", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("h is not null")
    return metrics.subset_summary(p, "text", "h", "role")


@query()
def tfidf_lengths(spark, d):
    """For documents with ids divisible by 20, the most similar other document by TF-IDF of words and pairs, from a cosine of 0.85."""
    rows = duplicates.tfidf_vectors(t(spark, d, "documents").select("doc_id", "text"), "text")
    out = duplicates.most_similar(rows, "doc_id", "tfidf", F.col("doc_id") % 20 == 0, 0.85)
    return out.select(F.col("id").alias("doc_id"), F.col("other_id").alias("match_id"), rnd("similarity", 4).alias("similarity"))


@query()
def calibrators(spark, d):
    """Calibration parameters of each language's length score."""
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return confidence.fit_calibrators(rows.select(F.col("lang").alias("engine"), F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("score"), F.col("quality").alias("label")))
