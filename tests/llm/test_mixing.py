from collections import Counter

from pyspark.sql import functions as F

from recordloom.llm import mixing
from tests.llm.plain import copies


def test_counts_equal_the_plain_inverse(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    rows = mixing.op10_mixing(spark, small).collect()
    got = Counter(r.doc_id for r in rows)
    want = copies([(d.doc_id, d.source) for d in docs])
    assert [got[d.doc_id] for d in docs] == want
    assert all(r.n_copies == got[r.doc_id] and 1 <= r.copy_no <= r.n_copies for r in rows)
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows)


def test_shares_follow_the_weights(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "b").when(F.col("id") < 50_000, "a").otherwise("c").alias("source"))
    out = {r.source: r["count"] for r in mixing.mix_sources(df, weights={"a": 1.0, "b": 3.0}, output_rows=40_000).groupBy("source").count().collect()}
    assert set(out) == {"a", "b"}
    assert abs(out["a"] - 10_000) < 500 and abs(out["b"] - 30_000) < 900


def test_large_means_and_poisson_spread(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("x").alias("source"))
    n = [r.n_copies for r in mixing.mix_sources(df, output_rows=200 * 900).where("copy_no = 1").collect()]
    mean = sum(n) / len(n)
    assert abs(mean - 900) < 10
    assert 0.6 * 900 < sum((x - mean) ** 2 for x in n) / len(n) < 1.5 * 900


def test_odd_rows(spark, odd, none):
    df = odd.withColumn("copy_no", F.lit("clash"))
    rows = mixing.mix_sources(df, output_rows=40).collect()
    again = mixing.mix_sources(df.repartition(3), output_rows=40).collect()
    key = lambda r: (str(r.doc_id), r.copy_no, str(r.text), str(r.score))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert {r.source for r in rows} >= {"a", "b"}
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mix_sources(odd, weights={}).count() == 0


def test_many_sources_give_the_same_rows(spark, monkeypatch, odd):
    """Beyond the broadcast bound, with hot and null sources."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 40).cast("string")).alias("source"))
    key = lambda r: (r.doc_id, r.copy_no, r.n_copies, str(r.source))
    want = sorted(map(key, mixing.mix_sources(rows).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(key, mixing.mix_sources(rows).collect())) == want
    assert len([w for w in want if w[3] == "None"]) > 0


def test_names_that_clash(spark):
    names = ["_rate", "_name", "rate", "n"]
    df = spark.createDataFrame([(i, "s", *["x"] * len(names)) for i in range(20)], f"doc_id long, source string, {', '.join(f'{n} string' for n in names)}")
    rows = mixing.mix_sources(df).collect()
    assert rows and {(r.rate, r.n) for r in rows} == {("x", "x")} and "_rate" not in rows[0].asDict()
