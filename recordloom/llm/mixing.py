"""Mixing sources to target weights by Poisson replication.

Each source's mean repetition rate is its target share of the output over its share of the input. A
document's count is the inverse of the Poisson distribution with that mean at a number in [0, 1) that
is hashed from the seed and its id; the document is exploded by its count and all copies are
shuffled globally by a hash of seed, id and copy number. Every row takes part; nothing is sampled by
a random generator, so a lost task gives the same rows again.

Defined cases: a null source is a source of its own with its share by the same rule; a null id is
hashed as the word null; repeated rows with one id share that id's count; sources without a stated
weight have weight 0 and leave the mix; an empty table gives an empty table; columns whose names clash with
copy_no, n_copies and shuffle_key are replaced, and those named as in OWN are not passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import spread_join, stored, table

SEED = "mix-1"
#: Share of a source in the output: its number of rows to this power, over the sum for all sources.
TEMPER = 0.5
#: A Poisson number with a larger mean is a sum of several with smaller ones.
MEAN_LIMIT = 200.0
#: The table of rates (a row for each source, a few hundred bytes) is broadcast up to this many rows.
BROADCAST_SOURCES = 10_000


#: Names of columns on the way; a column of the input with one of them is not passed on.
OWN = ("_none", "_name", "_rows", "_rate", "_parts", "_cdf")


def unit_hash(*parts: Column) -> Column:
    """A double in [0, 1) with 52 bits from the md5 of the parts joined by |."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))).cast("double")


def long_hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = TEMPER, output_rows: int | None = None, source: str = "source") -> DataFrame:
    """One row for each source: its rows, mean repetition rate, and the distribution function at 0, 1, 2, ..."""
    counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("_rows"))
    if weights is None:
        counts = counts.withColumn("_weight", F.pow(F.col("_rows").cast("double"), F.lit(temper)))
    else:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        counts = counts.withColumn("_weight", F.coalesce(F.try_element_at(known, F.col("_source")).cast("double"), F.lit(0.0)))
    total = counts.agg(F.sum("_weight").alias("_weights"), F.sum("_rows").alias("_all"))
    wanted = F.lit(output_rows) if output_rows is not None else F.col("_all")
    out = counts.crossJoin(F.broadcast(total))  # one row of totals
    out = out.withColumn("_rate", F.coalesce(F.try_divide(F.col("_weight") * wanted, F.col("_weights") * F.col("_rows")), F.lit(0.0)))
    out = out.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / MEAN_LIMIT)).cast("int"))
    out = out.withColumn("_mean", F.col("_rate") / F.col("_parts"))
    return out.withColumn(
        "_cdf",
        F.expr(
            """aggregate(sequence(1, cast(_mean + 12 * sqrt(_mean) + 30 as int)),
                 struct(exp(-_mean) as p, exp(-_mean) as c, array(exp(-_mean)) as f),
                 (s, k) -> struct(s.p * _mean / k as p, s.c + s.p * _mean / k as c, array_append(s.f, s.c + s.p * _mean / k) as f),
                 s -> s.f)"""
        ),
    ).select("_source", "_rows", "_rate", "_parts", "_cdf")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = TEMPER, output_rows: int | None = None, seed: str = SEED, source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with each row repeated by its count, in global random order, with copy_no (from 1), n_copies and shuffle_key."""
    keep = [c for c in docs.columns if c not in ("copy_no", "n_copies", "shuffle_key", *OWN)]
    rate = rates(docs, weights, temper, output_rows, source)
    own = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    names = lambda c: {"_none": F.col(c).isNull(), "_name": F.coalesce(F.col(c).cast("string"), F.lit(""))}
    rate = stored(rate.withColumns(names("_source")).drop("_source"), "rates")
    rows = docs.select(*keep).withColumns(names(source))
    # many sources: the largest ones meet their rows by broadcast, so a hot one is in no single task
    joined = rows.join(F.broadcast(rate), ["_none", "_name"]) if rate.count() <= BROADCAST_SOURCES else spread_join(rows, rate, ["_none", "_name"], "_rows")
    # each draw is hashed once, and then held against the distribution
    draws = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda j: unit_hash(F.lit(seed), own, j.cast("string")))
    drawn = F.transform(draws, lambda u: F.aggregate(F.col("_cdf"), F.lit(0), lambda n, f: n + (u >= f).cast("int")))
    joined = joined.withColumn("n_copies", F.aggregate(drawn, F.lit(0), lambda a, b: a + b)).where("n_copies > 0")
    copies = joined.select(*keep, F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"), "n_copies")
    copies = copies.withColumn("shuffle_key", long_hash(F.lit(f"{seed}-order"), own, F.col("copy_no").cast("string")))
    return copies.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed so that a source's share goes with the square root of its size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "copy_no", "n_copies", "shuffle_key", F.sha2("text", 256).alias("text_sha256"))


OP10_SQL = f"""
WITH counts AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w * (SELECT sum(n) FROM counts) / ((SELECT sum(w) FROM counts) * n) AS rate FROM counts),
steps AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS cdf
          FROM rates, range(0, 200) AS r(k)),
drawn AS (SELECT d.doc_id, d.source, d.text,
                 CAST('0x' || substr(md5('{SEED}|' || d.doc_id || '|1'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
          FROM documents d),
counted AS (SELECT d.doc_id, d.source, d.text, count(*) FILTER (WHERE d.u >= s.cdf) AS n_copies
            FROM drawn d JOIN steps s ON d.source = s.source AND s.k < 60 GROUP BY ALL)
SELECT doc_id, source, copy_no::INTEGER AS copy_no, n_copies::INTEGER AS n_copies,
       CAST('0x' || substr(md5('{SEED}-order|' || doc_id || '|' || copy_no), 1, 15) AS BIGINT) AS shuffle_key,
       sha256(text) AS text_sha256
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM counted WHERE n_copies > 0)
"""
