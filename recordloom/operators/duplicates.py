"""Duplicates: by digest, by fields, by vector and by perceptual hash. Only earlier rows count as originals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.text import _c

#: Vectors of one block of the search, on the side that is asked and on the side that is searched.
ASKED_ROWS, SEARCHED_ROWS = 4096, 2048


def exact(rows: DataFrame, key: str, arrival: str, digest: Column | str) -> DataFrame:
    """For each row the last earlier row with its digest (duplicate_of), null for the first."""
    before = Window.partitionBy(F.col("_digest")).orderBy(arrival, key)
    return rows.withColumn("_digest", _c(digest)).withColumn("duplicate_of", F.when(F.col("_digest").isNotNull(), F.lag(key).over(before))).drop("_digest")


def field_digest(fields: Column) -> Column:
    """SHA-256 of a map's JSON with sorted keys, null values and blank ones left out."""
    entries = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: v.isNotNull() & (F.trim(v) != ""))))
    return F.sha2(F.to_json(F.map_from_entries(entries)), 256)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two numeric arrays; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = _c(a), _c(b)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def nearest_in_block(rows: DataFrame, key: str, vector: str, block: str, threshold: float | None = None, asked: Column | None = None) -> DataFrame:
    """For each asked row (all, if not given) the most similar other row of its block: id, other_id, similarity.

    Cosines are rounded to nine places, ties go to the smaller key; vectors are of one length, and null or zero ones take no
    part. A block is cut into parts by its number of rows; the asked rows meet each part, which yields one row for each.
    """
    v = F.col(vector).cast("array<double>")
    sound = rows.where(F.col(key).isNotNull() & F.col(block).isNotNull() & F.exists(vector, lambda x: x != 0))
    sizes = sound.groupBy(F.col(block).alias("block")).agg(F.ceil(F.count(F.lit(1)) / SEARCHED_ROWS).cast("int").alias("parts"))
    own = sound.select(F.col(key).alias("id"), v.alias("v"), F.col(block).alias("block"), (F.lit(True) if asked is None else asked).alias("_asks")).join(sizes, "block")
    searched = own.select("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "v")
    asking = own.where("_asks").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "id", "v")

    def best(t: pa.Table) -> pa.Table:
        asks, ids = t.column("asks").to_numpy(), t.column("id").to_numpy()
        m = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        at = np.flatnonzero(~asks)
        at = at[np.argsort(ids[at], kind="stable")]
        found = []
        for a in range(0, int(asks.sum()), 512):
            who = np.flatnonzero(asks)[a : a + 512]
            cos = np.round(m[who] @ m[at].T, 9)
            cos[ids[who][:, None] == ids[at][None, :]] = -2
            j = cos.argmax(axis=1) if len(at) else np.empty(0, np.int64)
            real = np.flatnonzero(cos[np.arange(len(j)), j] > -2)
            found.append((ids[who[real]], ids[at[j[real]]], cos[real, j[real]]))
        columns = [np.concatenate([f[i] for f in found]) if found else np.empty(0) for i in range(3)]
        return pa.table({"id": pa.array(columns[0], pa.int64()), "other_id": pa.array(columns[1], pa.int64()), "similarity": pa.array(columns[2], pa.float64())})

    near = searched.unionByName(asking).groupBy("block", "part").applyInArrow(best, "id long, other_id long, similarity double")
    out = near.groupBy("id").agg(F.min_by(F.struct("other_id", "similarity"), F.struct((-F.col("similarity")).alias("m"), "other_id")).alias("b")).select("id", "b.*")
    return out if threshold is None else out.where(F.col("similarity") >= threshold)


def tfidf_vectors(rows: DataFrame, text: str, features: int = 1000) -> DataFrame:
    """J18, its vectors: unit TF-IDF vectors of words and word pairs, fitted once on the whole corpus."""
    split = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}\p{M}\p{N}_]+", minTokenLength=2).transform(rows.na.fill("", [text]))
    pairs = NGram(n=2, inputCol="_w", outputCol="_p").transform(split).withColumn("_t", F.concat("_w", "_p"))
    counted = CountVectorizer(vocabSize=features, inputCol="_t", outputCol="_c").fit(pairs).transform(pairs)
    weighed = IDF(inputCol="_c", outputCol="_i").fit(counted).transform(counted)
    return Normalizer(inputCol="_i", outputCol="tfidf").transform(weighed).drop("_w", "_p", "_t", "_c", "_i")


def most_similar(rows: DataFrame, key: str, vector: str, asked: Column, threshold: float = 0.85) -> DataFrame:
    """J18, its search: for each asked row the other row with the highest cosine, where that is threshold or more.

    Vectors are unit vectors as tfidf_vectors makes them. Every asked row is compared with all rows, in double precision,
    block by block; cosines equal to 12 digits go to the smaller key. Rows with null keys or without terms match nothing.
    Returns id, other_id, similarity. Work grows with asked rows times rows.
    """
    small = lambda df, n: max(1, -(-df.count() // n))
    v = F.unwrap_udt(F.col(vector))
    entries = lambda df: df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), v["size"].alias("size"), v["indices"].alias("at"), v["values"].alias("value")).where(F.size("at") > 0)
    id_type = rows.schema[key].dataType
    packed = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("size", T.IntegerType()), T.StructField("n", T.BinaryType()), T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType())])

    def pack(t: pa.Table) -> pa.RecordBatch:
        t = t.select(["id", "size", "at", "value"]).sort_by("id").combine_chunks()
        at, value = t["at"].combine_chunks(), t["value"].combine_chunks()
        one = lambda a, kind: pa.array([a.to_numpy(zero_copy_only=False).astype(kind).tobytes()], pa.binary())
        ids = pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t["id"].combine_chunks())
        return pa.RecordBatch.from_arrays([ids, pa.array([t["size"][0].as_py()], pa.int32()), one(at.value_lengths(), np.int32), one(at.flatten(), np.int32), one(value.flatten(), np.float64)], ["ids", "size", "n", "at", "value"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, SEARCHED_ROWS):
                part = batch.slice(first, SEARCHED_ROWS)
                if n + part.num_rows > SEARCHED_ROWS:
                    yield pack(pa.Table.from_batches(held))
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield pack(pa.Table.from_batches(held))

    def dense(size: int, n: bytes, at: bytes, value: bytes) -> np.ndarray:
        n = np.frombuffer(n, np.int32)
        out = np.zeros((len(n), size))
        out[np.repeat(np.arange(len(n)), n), np.frombuffer(at, np.int32)] = np.frombuffer(value, np.float64)
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                load = lambda side: dense(row[f"{side}_size"].as_py(), *(row[f"{side}_{c}"].as_py() for c in ("n", "at", "value")))  # noqa: B023, E731
                asked_ids, ids = row["a_ids"].values, row["s_ids"].values
                if last is None or not last.equals(asked_ids):
                    last, a = asked_ids, load("a")
                cos = np.round(a @ load("s").T, 12)
                known = asked_ids.unique()
                mine, theirs = (pc.index_in(x, known).fill_null(-1).to_numpy(zero_copy_only=False) for x in (asked_ids, ids))
                for j in np.flatnonzero(theirs >= 0):  # not itself, nor a row of its key
                    cos[mine == theirs[j], j] = -1.0
                best = cos.argmax(axis=1)
                top = cos[np.arange(len(best)), best]
                hit = np.flatnonzero(top >= threshold)
                yield pa.RecordBatch.from_arrays([asked_ids.take(pa.array(hit)), ids.take(pa.array(best[hit])), pa.array(top[hit])], ["id", "other_id", "similarity"])

    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in packed.names])
    asked_rows = rows.where(asked)
    n_asked, n_searched = small(asked_rows, ASKED_ROWS), small(rows, SEARCHED_ROWS)
    blocks = entries(asked_rows).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_asked))).groupBy("block")
    a = side(blocks.applyInArrow(lambda t: pa.Table.from_batches([pack(t)]), packed).repartition(n_asked), "a")
    s = side(entries(rows).mapInArrow(packs, packed).repartition(n_searched), "s")
    found = T.StructType([T.StructField("id", id_type), T.StructField("other_id", id_type), T.StructField("similarity", T.DoubleType())])
    # one row a pair of blocks
    matches = s.crossJoin(a).mapInArrow(compare, found)
    return matches.groupBy("id").agg(F.min_by(F.struct("other_id", "similarity"), F.struct(-F.col("similarity"), "other_id")).alias("m")).select("id", "m.*")


def hash_bits(x: Column | str, words: int = 4) -> list[Column]:
    """A hex digest of 64 x words bits as numbers, from its halves of 32 bits."""
    x = _c(x)
    return [F.conv(F.substring(x, 8 * i + 1, 8), 16, 10).cast("long") for i in range(2 * words)]


def hamming(a: Column | str, b: Column | str, words: int = 4) -> Column:
    """Differing bits of two hex digests."""
    total = F.lit(0)
    for x, y in zip(hash_bits(a, words), hash_bits(b, words), strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def perceptual_matches(probes: DataFrame, samples: DataFrame, key: str, digest: str, most: int = 14, words: int = 4) -> DataFrame:
    """The nearest sample within most differing bits. Digests within most bits share one of most + 1 bands, so bands are the equi key."""
    bits = 64 * words // 4  # hex digits
    bands = most + 1
    cut = [(i * bits // bands, (i + 1) * bits // bands) for i in range(bands)]
    band = F.explode(F.array(*[F.concat(F.lit(f"{i}:"), F.substring(F.col(digest), a + 1, b - a)) for i, (a, b) in enumerate(cut)]))
    left = probes.select(F.col(key).alias("id"), F.col(digest).alias("p"), band.alias("band"))
    right = samples.select(F.col(key).alias("sample_id"), F.col(digest).alias("s"), band.alias("band"))
    pairs = left.join(right, "band").select("id", "sample_id", "p", "s").distinct().withColumn("distance", hamming("p", "s", words)).where(F.col("distance") <= most)
    return pairs.groupBy("id").agg(F.min_by(F.struct("sample_id", "distance"), F.struct("distance", "sample_id")).alias("m")).select("id", "m.*")


def hash_embedding(words: Column | str, size: int = 256) -> Column:
    """Unit vector of hashed word counts."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(_c(words), lambda w: F.pmod(F.xxhash64(w), F.lit(size)) == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(counts, lambda v: F.coalesce(F.try_divide(v, norm), F.lit(0.0)))
