"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are hashed by floor((a.x + b) / w) with Gaussian a, several functions a table; the number of functions
grows with the logarithm of the number of vectors, so that buckets do not. A query visits its own bucket and perturbed
ones (some functions one step up or down) in the order of their estimated success: the sum of squared distances to the
bucket edges that are crossed. The number of probes is the smallest at which a bounded sample, taken as queries against
itself, reaches the target recall; every vector is indexed. Buckets are dealt into groups of bounded size, to which a
query goes once with all its buckets there. Each group gives a query its best few in single precision; the tables' and
groups' candidates are merged and ranked again by the exact cosine in double precision.

A query for which the probes found fewer than k vectors is compared with all vectors, in blocks.

Equal vectors are indexed once, with their smallest ids, as no result can need more: a vector that is
repeated by a third of all rows is one entry.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; ties go
to the smaller id; with fewer than k candidates all are returned; rows with one id and one vector
count once; sound vectors of several lengths are a ValueError; an empty table has no rows; components of any finite size
are scaled by a power of two before they are squared; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.common import grouped, mix, spread_join, stored, table

TABLES = 3
#: Fewest and most functions of a table, and vectors of a bucket that the number of functions aims at.
FEW_FUNCTIONS, MOST_FUNCTIONS, BUCKET = 2, 12, 64
#: Bucket width in standard deviations of a projection of the sample.
WIDTH = 2.0
SAMPLE = 4096
TARGET = 0.97
SEED = 20240229
#: Vectors of a group of buckets, or of a part of a larger one.
BLOCK_ROWS = 4096
#: Perturbations among which a query orders its probes: as many functions changed as give no more than this.
MOST_PROBES = 4096
#: Single precision may misplace two cosines that are closer than this.
SLACK = 2e-6


def functions_for(n: int) -> int:
    """Functions of a table for n vectors; a function of this width tells about four halves apart."""
    return int(np.clip(round(np.log2(max(n, 2) / BUCKET) / 2), FEW_FUNCTIONS, MOST_FUNCTIONS))


def perturbations(m: int, most: int = MOST_PROBES) -> np.ndarray:
    """Steps of -1, 0, +1 in m functions, fewest changes first, as far as whole numbers of changes go."""
    out = [np.zeros(m, np.int64)]
    for changes in range(1, m + 1):
        some = []
        for at in combinations(range(m), changes):
            for steps in product((-1, 1), repeat=changes):
                delta = np.zeros(m, np.int64)
                delta[list(at)] = steps
                some.append(delta)
        if len(out) + len(some) > most:
            break
        out += some
    return np.array(out)


class Index:
    """Projections, offsets, width and number of probes."""

    def __init__(self, dim: int, functions: int, width: float, probes: int = 1, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((TABLES, functions, dim))
        self.b = rng.uniform(0, width, (TABLES, functions))
        self.width, self.probes = width, probes
        self.deltas = perturbations(functions)
        self.down, self.up = (self.deltas == -1).astype(np.float64), (self.deltas == 1).astype(np.float64)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Real-valued places (rows, tables, functions); their floors name the bucket."""
        return (np.einsum("nd,tfd->ntf", x, self.a) + self.b) / self.width

    @staticmethod
    def names(cells: np.ndarray) -> np.ndarray:
        out = np.zeros(cells.shape[:-1], np.int64)
        for j in range(cells.shape[-1]):
            out = out * 1_000_003 + cells[..., j]
        return out

    def probe_names(self, place: np.ndarray, most: int) -> np.ndarray:
        """Buckets (rows, most) of one table in the order of their estimated success; place: (rows, functions)."""
        cell = np.floor(place)
        inside = place - cell
        score = inside**2 @ self.down.T + (1 - inside) ** 2 @ self.up.T
        order = np.argsort(score, axis=1, kind="stable")[:, :most]
        return self.names(cell.astype(np.int64)[:, None, :] + self.deltas[order])


def fit(x: np.ndarray, k: int, target: float = TARGET, n: int | None = None) -> Index:
    """x: unit vectors of the sample; n: vectors in all. Picks the fewest probes a table at which the sample's own neighbours are found."""
    width = WIDTH * float(np.std(x @ np.random.default_rng(SEED).standard_normal((x.shape[1], 16)))) if len(x) else 1.0
    index = Index(x.shape[1], functions_for(n or len(x)), width or 1.0)
    if len(x) < 2:
        return index
    asked = min(len(x), 128)
    cos = x[:asked] @ x.T
    cos[np.arange(asked), np.arange(asked)] = -2
    near = np.argsort(-cos, axis=1)[:, : min(k, len(x) - 1)]
    place = index.places(x)
    names = index.names(np.floor(place).astype(np.int64))
    all_ = len(index.deltas)
    rank = np.full(near.shape, all_ + 1)
    for t in range(TABLES):
        order = index.probe_names(place[:asked, t], all_)
        for j in range(near.shape[1]):
            same = order == names[near[:, j], t][:, None]
            rank[:, j] = np.minimum(rank[:, j], np.where(same.any(axis=1), same.argmax(axis=1) + 1, all_ + 1))
    ranks = np.sort(rank.ravel())
    index.probes = int(min(all_, ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]))
    return index


def _group(names: np.ndarray, n: int) -> np.ndarray:
    """The group of each bucket."""
    return (mix(names.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would overflow or vanish, times a power of two; the others as they are."""
    most = np.abs(x).max(axis=1, initial=0)
    odd = (most > 1e100) | (most < 1e-100)
    if odd.any():
        x = x.copy()
        x[odd] = np.ldexp(x[odd], -np.frexp(most[odd])[1][:, None])
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _single(x: np.ndarray) -> pa.Array:
    """Unit vectors in single precision, as binary values."""
    data = np.ascontiguousarray(x, np.float32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * 4 * data.shape[1]).astype(np.int32)), pa.py_buffer(data.tobytes())])


def _singles(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


_CANDIDATES = "query_id long, id long, near double"


def _best(k: int, dim: int):
    def run(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Vectors and queries of a part of a group, each query with its buckets there: its k + 1 best, and those that single precision cannot tell from the last."""
        side = rows.column("side").to_numpy()
        data, ask = rows.filter(pa.array(side == 0)).combine_chunks(), rows.filter(pa.array(side == 1)).combine_chunks()
        if not len(data) or not len(ask):
            return
        bucket = np.asarray(data.column("buckets").combine_chunks().flatten())
        order = np.argsort(bucket, kind="stable")
        bucket, ids, x = bucket[order], data.column("id").to_numpy()[order], _singles(data.column("v"), dim)[order]
        lists = ask.column("buckets").combine_chunks()
        wanted = np.asarray(lists.flatten())
        asker = np.repeat(np.arange(len(ask)), lists.value_lengths().to_numpy())
        by = np.argsort(wanted, kind="stable")
        wanted, asker, q = wanted[by], asker[by], _singles(ask.column("v"), dim)
        found: list[tuple] = []
        for name in np.unique(bucket):
            lo, hi = np.searchsorted(bucket, [name, name + 1])
            a, b = np.searchsorted(wanted, [name, name + 1])
            for at in range(a, b, 512):
                who = asker[at : min(b, at + 512)]
                cos = q[who] @ x[lo:hi].T
                most = min(k + 1, hi - lo)
                edge = -np.partition(-cos, most - 1, axis=1)[:, most - 1 : most]
                i, j = np.nonzero(cos >= edge - SLACK)
                found.append((who[i], ids[lo + j], cos[i, j]))
        if not found:
            return
        who, at, cos = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((-cos, who))
        who, at, cos = who[order], at[order], cos[order]
        first = np.searchsorted(who, who)
        edge = cos[np.minimum(first + k, np.searchsorted(who, who, side="right") - 1)]
        keep = cos >= edge - SLACK
        yield pa.RecordBatch.from_arrays([ask.column("id").combine_chunks().take(pa.array(who[keep])), pa.array(at[keep]), pa.array(cos[keep].astype(np.float64))], ["query_id", "id", "near"])

    return run


def _met(data: DataFrame, asks: DataFrame, k: int, dim: int) -> DataFrame:
    """data (t, g, buckets of one, id, v) and asks (t, g, buckets, id, v) of the same groups; groups over BLOCK_ROWS are split by id."""
    sizes = data.groupBy("t", "g").agg(F.count(F.lit(1)).alias("n"))
    left = spread_join(data, sizes, ["t", "g"], "n").withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    left = left.select("t", "g", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "buckets", "v")
    right = spread_join(asks, sizes, ["t", "g"], "n").withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCK_ROWS).cast("int") - 1)))
    return grouped(left.unionByName(right.select("t", "g", "part", F.lit(1).alias("side"), "id", "buckets", "v")), ["t", "g", "part"], _best(k, dim), _CANDIDATES)


def _reranked(found: DataFrame, entries: DataFrame, asked: DataFrame, k: int, dim: int) -> DataFrame:
    """The exact cosine of the candidates that can be among the k best, and the k best of each query."""
    by = Window.partitionBy("query_id")
    found = found.groupBy("query_id", "id").agg(F.max("near").alias("near")).withColumn("r", F.row_number().over(by.orderBy(F.desc("near"))))
    found = found.withColumn("edge", F.min(F.when(F.col("r") <= k + 1, F.col("near"))).over(by)).where(F.col("near") >= F.col("edge") - 2 * SLACK).select("query_id", "id")
    pairs = found.join(entries, "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("u")), "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                rows = batch.slice(a, 4096)
                u, v = (_scaled(_matrix(rows.column(c), dim)) for c in ("u", "v"))
                score = np.einsum("nd,nd->n", u, v) / (np.sqrt(np.einsum("nd,nd->n", u, u)) * np.sqrt(np.einsum("nd,nd->n", v, v)))
                yield pa.RecordBatch.from_arrays([rows.column("query_id"), rows.column("ids"), pa.array(np.clip(score, -1, 1))], ["query_id", "ids", "score"])

    ranked = pairs.select("query_id", "ids", "u", "v").mapInArrow(exact, "query_id long, ids array<long>, score double")
    ranked = ranked.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    return ranked.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest by cosine among all vectors but the query's own id."""
    spark = vectors.sparkSession
    sound = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    # a query may meet its own id once, so k + 1 ids of equal vectors are enough
    entries = stored(_entries(sound(vectors), k), "ann-entries")
    asked = sound(queries).groupBy("id").agg(F.min("v").alias("v"))
    seen = entries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if not seen.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = seen.least
    asked_sizes = asked.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if {dim, seen.most, asked_sizes.least or dim, asked_sizes.most or dim} != {dim}:
        raise ValueError("vectors of several lengths")
    sample = entries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    index = spark.sparkContext.broadcast(fit(_unit(_matrix(sample, dim)), k, target, seen.n))
    n_groups = max(1, -(-seen.n // BLOCK_ROWS))

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                rows = batch.slice(a, 4096)
                x = _unit(_matrix(rows.column("v"), dim))
                cells = own.names(np.floor(own.places(x)).astype(np.int64))
                one = np.arange(len(x) + 1, dtype=np.int32)
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(_group(cells[:, t], n_groups)), pa.ListArray.from_arrays(pa.array(one), pa.array(cells[:, t])), rows.column("id"), _single(x)], ["t", "g", "buckets", "id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                x = _unit(_matrix(rows.column("v"), dim))
                place = own.places(x)
                for t in range(TABLES):
                    # a query goes to a group once, with the buckets that it visits there
                    names = own.probe_names(place[:, t], own.probes)
                    row, name = np.repeat(np.arange(len(x)), names.shape[1]), names.ravel()
                    g = _group(name, n_groups)
                    order = np.lexsort((g, row))
                    row, name, g = row[order], name[order], g[order]
                    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(name))
                    who = rows.column("id").take(pa.array(row[first]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), t, np.int32)), pa.array(g[first]), lists, who, _single(x[row[first]])], ["t", "g", "buckets", "id", "v"])

    kind = "t int, g long, buckets array<long>, id long, v binary"
    found = _met(entries.select("id", "v").mapInArrow(bucket, kind), asked.select("id", "v").mapInArrow(probe, kind), k, dim)
    ranked = stored(_reranked(found, entries, asked, k, dim), "ann-found")
    # queries that found too few are compared with all vectors
    enough = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, seen.ids))
    short = stored(asked.join(enough, asked["id"] == enough["query_id"], "left_anti"), "ann-short")
    if short.isEmpty():
        return ranked

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), _single(_unit(_matrix(batch.column("v"), dim)))], ["id", "v"])

    one = F.array(F.lit(0).cast("long"))
    alike = lambda df: df.select("id", "v").mapInArrow(whole, "id long, v binary").select(F.lit(0).alias("t"), F.lit(0).cast("long").alias("g"), one.alias("buckets"), "id", "v")
    more = _reranked(_met(alike(entries), alike(short), k, dim), entries, short, k, dim)
    return ranked.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """One row for each distinct vector: its smallest id and its k + 1 smallest ids."""
    # the rank's bound is applied in each task before the shuffle, so a vector with many ids is no large group
    few = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    merged = few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return merged.select(F.element_at("ids", 1).alias("id"), "ids", "v")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of each vector of embeddings whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
