"""Shared pieces: scratch tables, byte-level word hashing, streams of sorted groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes and rows that numpy code works on at a time. Spark itself bounds an Arrow batch by bytes; no setting is changed.
PIECE_BYTES, PIECE_ROWS = 2 << 20, 1024

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- scratch


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='recordloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and returns it as read from there."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.add(path)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by stored(), once all that is read from them is stored itself."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    for paths in _OPEN:
        paths.discard(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Paths of the tables that each open temporary_tables() has seen.
_OPEN: list[set[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables that stored() makes in the block, but for those put into the list: only what is stored may leave the block."""
    paths, kept = set(), []
    _OPEN.append(paths)
    try:
        yield kept
    finally:
        _OPEN.remove(paths)
        for path in paths - {df.stored_at for df in kept}:
            _delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose labels are never learned: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most bound labelled documents (doc_id, text, _label), none of them held out: those whose ids come first by hash.

    Ids that are null or labelled both ways are left out; of documents with one id one is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.min(label).alias("_label"), F.max(label).alias("_most")).where("_label = _most")
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select("doc_id", "_label")
    # at most bound rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))


def join_path(*parts: str) -> str:
    return str(PurePosixPath(*parts))


# ---------------------------------------------------------------- joins

#: Bits of a sieve: at most SIEVE_BITS / 64 rows of two numbers are broadcast (some 20 MB), whatever the number of ids.
SIEVE_BITS = 1 << 25
#: Groups that meet their rows by broadcast, and the rows from which a group may be one of them.
HOT_GROUPS, HOT_ROWS = 10_000, 256


def _bit(keys: tuple[str, ...]):
    return F.pmod(F.xxhash64(*keys), F.lit(SIEVE_BITS))


def _mask(keys: tuple[str, ...]):
    return F.call_function("shiftleft", F.lit(1).cast("long"), (_bit(keys) % 64).cast("int"))


def sieve(ids: DataFrame, *keys: str) -> DataFrame:
    """A hashed bitmap of ids, as words of 64 bits; more ids than bits let more through, and lose none."""
    words = ids.select(F.floor(_bit(keys) / 64).cast("int").alias("_word"), _mask(keys).alias("_m"))
    return stored(words.groupBy("_word").agg(F.bit_or("_m").alias("_mask")), "sieve")


def sieved(df: DataFrame, words: DataFrame, *keys: str) -> DataFrame:
    """df with _maybe: false for rows whose keys are surely not among the ids of the sieve."""
    named = df.withColumn("_word", F.floor(_bit(keys) / 64).cast("int")).join(F.broadcast(words), "_word", "left")
    return named.withColumn("_maybe", F.coalesce(F.col("_mask").bitwiseAND(_mask(keys)) != 0, F.lit(False))).drop("_word", "_mask")


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """Inner or left join of rows with groups, unique by keys and with their number of rows in size.

    The HOT_GROUPS largest groups meet their rows by broadcast, so that no hot key lands in one task; all others by a shuffle.
    """
    hot = stored(groups.where(F.col(size) >= HOT_ROWS).orderBy(F.desc(size), *keys).limit(HOT_GROUPS), "hot-groups")
    if hot.isEmpty():
        return rows.join(groups, keys, how)
    few = F.broadcast(hot.select(*keys))
    rest = rows.join(few, keys, "left_anti").join(groups.join(few, keys, "left_anti"), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer; x is uint64 and is not changed."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse mod 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.up = self.down = np.empty(0, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.n < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                out = np.full(size, b, U64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
            self.n = size
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_BASE2)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; data is uint8."""
    up, down = _BYTES.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes: item i stands for words[i:i+k]."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    up, down = _WORDS.upto(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n] + U64(k))


# ---------------------------------------------------------------- words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of many texts as flat arrays.

    data: all texts' UTF-8 bytes; start, end: each word's bytes in data; doc: its text's index;
    first: index of each text's first word, one more than there are texts.
    """

    def __init__(self, texts: pa.Array, between: np.ndarray = _SPACE):
        """between: for each byte value whether it stands between words."""
        offsets, self.data = text_bytes(texts)
        self.offsets = offsets
        space = np.ones(len(self.data) + 2, bool)
        space[1:-1] = between[self.data]
        inner = offsets[1:-1]
        change = np.flatnonzero(space[1:] != space[:-1])
        start, end = change[0::2], change[1::2]
        # a word that runs over the end of a text is two words
        if len(inner):
            cut = np.unique(inner[(inner > 0) & (inner < len(self.data))])
            at = np.searchsorted(start, cut, side="left") - 1
            ok = (at >= 0) & (cut > start[at]) & (cut < end[at]) if len(start) else np.zeros(len(cut), bool)
            cut = cut[ok]
            if len(cut):
                start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets, side="left")
        self.first[-1] = len(start)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and UTF-8 bytes of the texts; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text and at most so many rows each; one text is never split."""
    texts = batch.column(batch.schema.get_field_index(column))
    offsets, _ = text_bytes(texts)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, min(at + rows, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1))
        yield batch.slice(at, to - at)
        at = to


def segments(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of all items of the ranges [start, start+length), one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


# ---------------------------------------------------------------- groups


def by_group(keys: list[str], work: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]]):
    """A mapInArrow function over partitions that are hash-partitioned and sorted by keys: calls work(key, rows) for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                key = tuple(c[a].item() for c in columns)
                if key != now and held:
                    yield from work(now, pa.Table.from_batches(held))
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(now, pa.Table.from_batches(held))

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Of batches sorted by key: tables of about so many rows that never split a key's rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            edge = int(np.flatnonzero(np.append(keys[1:] != keys[:-1], False)).max(initial=-1)) + 1
            if edge:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, edge)])
                held = [batch.slice(edge)]
                n = batch.num_rows - edge
    if held:
        yield pa.Table.from_batches(held)


def grouped(df: DataFrame, keys: list[str], work, schema: str, n: int | None = None, direct: bool = False) -> DataFrame:
    """One shuffle by keys, then work() for each key's rows. Keys must not be null; groups must be of bounded size.

    direct: the only key is a number below n, and each group has a partition of its own.
    """
    spread = df.repartitionById(n, F.col(keys[0])) if direct else df.repartition(n, *keys) if n else df.repartition(*keys)
    return spread.sortWithinPartitions(*keys).mapInArrow(by_group(keys, work), schema)


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
