"""Token-id shards in Re-Pair grammar compression.

Documents are dealt to tasks by ranges of doc_id and sorted within them; each task writes a run of shards. A shard is
closed at SHARD_IDS ids and has one grammar: frequent pairs of neighbouring ids are replaced by nonterminals, round
after round, until no pair stands MIN_COUNT times. It stores its rules, the rules' expansion lengths and the compressed
sequence, so a range of ids is decoded without expanding the rest, and the number of ids before it in its run, so that
places in the whole corpus need only the totals of the runs.

Shards are rows of a Parquet table in the shared folder, one binary value a shard: Spark's committer
makes them survive lost executors, and any store that Spark writes to will do.

Defined cases: doc_id is an integer, anything else is an error; a null text counts as empty and has only the end id; documents with one id keep a
fixed order among themselves (by text); null ids come first; an empty table has no shards; extra
columns are not carried.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.common import partitions, pieces, segments, span_hashes, stored, text_bytes

END_ID = 2
#: A shard is closed at this many ids; a longer document gets a shard of its own.
SHARD_IDS = 1 << 19
#: Pairs of a round must occur this often; all positions count. Any choice of rules is lossless.
MIN_COUNT = 6
#: Most bits of the slots in which pairs are counted before they are sorted.
PAIR_BITS = 20
#: Places for remembered pieces, and ids that are kept for them.
SLOT_BITS = 21
SLOTS = 1 << SLOT_BITS
KEPT_IDS = 3_500_000
#: Text bytes that a worker looks at together: its arrays are some tens of times as large.
ENCODE_BYTES = 1 << 19
MAGIC, HEAD = b"RPG2", "<4sBBIIII"


class PieceEncoder:
    """Ids by the tokenizers library, which sees each piece of text once while it is remembered.

    A piece is a blank with what follows it up to the next blank, cut again between a word and a mark or a
    line feed: byte-level BPE never joins what stands on both sides. Texts in which white space follows a blank, that end in one or that may hold a special
    token go to the library as they are. Pieces are found, hashed and looked up in numpy; the memory is a
    direct-mapped table of SLOTS piece hashes, in which a new piece takes the place of an old one.
    """

    _space = re.compile(r"\s")
    #: 1: ASCII letters and digits, 2: other visible ASCII, 0: the rest.
    _kind = np.array([1 if chr(c).isalnum() and c < 128 else 2 if 0x20 < c < 0x7F else 0 for c in range(256)], np.uint8)
    _ascii_space = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
    #: First and second bytes of other white space in UTF-8 (and of a little more).
    _wide = ((0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80))

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread; the library's own pool costs memory in each worker
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)  # of byte-level tokens: one character a byte
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self.key, self.start, self.n = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.flat = np.empty(0, np.uint32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.array([len(i) for i in ids], np.int64)
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n

    def _joined(self, texts: list[str], between: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after another, and their numbers: encoded a few hundred at a time, joined, and told apart by their bytes."""
        ids, _ = self._library([between.join(texts[i : i + 256]) + between for i in range(0, len(texts), 256)])
        sizes = np.array([len(t.encode()) for t in texts], np.int64)
        start = np.cumsum(sizes + len(between)) - sizes - len(between)
        ends = np.cumsum(self.bytes_of[ids])
        first = np.searchsorted(ends, start, side="right")
        n = np.searchsorted(ends, start + sizes, side="right") - first
        return ids[segments(first, n)], n

    def _learn(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and their numbers. Pieces that begin with a blank can follow each other, those
        that begin with a letter or digit can stand on lines of their own; the rest is encoded one by one."""
        space = self._space.match
        kinds = np.array([2 if space(p[-1]) or p == " " else 0 if p[0] == " " else 1 if p[0].isascii() and p[0].isalnum() else 2 for p in fresh])
        which = [np.flatnonzero(kinds == k) for k in range(3)]
        groups = [[fresh[i] for i in w.tolist()] for w in which]
        found = [self._joined(groups[0], ""), self._joined(groups[1], "\n"), self._library(groups[2])]
        total, sizes = (np.concatenate([f[i] for f in found]) for i in range(2))
        place = np.empty(len(fresh), np.int64)
        place[np.concatenate(which)] = np.arange(len(fresh))
        starts = np.cumsum(sizes) - sizes
        return total[segments(starts[place], sizes[place])], sizes[place]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where blanks stand, and whether each text must go to the library as it is."""
        n = len(offsets) - 1
        blank = np.flatnonzero(data == 0x20)
        after = np.append(data, np.zeros(2, np.uint8))
        a, b = after[blank + 1], after[blank + 2]
        bad = self._ascii_space[a]
        for x, y in self._wide:
            bad |= (a == x) & (b == y)
        last = np.searchsorted(offsets, blank, side="right") - 1
        bad |= blank + 1 == offsets[last + 1]
        odd = np.bincount(last[bad], minlength=n) > 0
        special = np.flatnonzero((after[:-2] == 0x3C) & (after[1:-1] == 0x7C))
        odd[np.searchsorted(offsets, special, side="right") - 1] = True
        return blank, odd

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and each text's number of ids."""
        offsets, data = text_bytes(texts)
        blank, odd = self._pieces(data, offsets)
        mark = np.zeros(len(data) + 1, bool)
        mark[blank] = mark[offsets] = True
        # more places that no token spans: before a mark after a letter or digit, before a line feed, and after a single one
        if len(data) > 2:
            kind = self._kind[data]
            mark[1:-1] |= (kind[:-1] == 1) & (kind[1:] == 2)
            feed = (data[1:] == 0x0A) & (kind[:-1] > 0)
            mark[1:-1] |= feed
            mark[2:-1] |= feed[:-1] & (kind[2:] == 1)
        edge = np.flatnonzero(mark)
        start, end = edge[:-1], edge[1:]
        doc = np.searchsorted(offsets, start, side="right") - 1
        keep = ~odd[doc]
        start, end, doc = start[keep], end[keep], doc[keep]
        h = span_hashes(data, start, end) | np.uint64(1)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, n = self.start[slot], self.n[slot].astype(np.int64)
        missed = np.flatnonzero(self.key[slot] != h)
        if len(missed):
            names, first, inverse = np.unique(h[missed], return_index=True, return_inverse=True)
            raw = data.tobytes()
            some = missed[first]
            ids, sizes = self._learn([raw[a:b].decode() for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
            starts = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat = np.concatenate([self.flat, ids])
            at[missed], n[missed] = starts[inverse], sizes[inverse]
            s = slot[some]
            self.key[s], self.start[s], self.n[s] = names, starts, sizes
        found = self.flat[segments(at, n)]
        count = np.bincount(doc, n, len(texts)).astype(np.int64)
        if odd.any():
            which = np.flatnonzero(odd)
            more, sizes = self._library([texts[i].as_py() for i in which.tolist()])
            begin = np.cumsum(count) - count
            begin[which], count[which] = len(found) + np.cumsum(sizes) - sizes, sizes
            found = np.concatenate([found, more])[segments(begin, count)]
        if len(self.flat) > KEPT_IDS:  # what no slot names any more goes
            live = np.flatnonzero(self.key)
            sizes = self.n[live].astype(np.int64)
            self.flat = self.flat[segments(self.start[live], sizes)]
            self.start[live] = np.cumsum(sizes) - sizes
            if len(self.flat) > KEPT_IDS * 7 // 8:
                self.key[:] = 0
                self.flat = self.flat[:0]
        return found, count


@lru_cache(maxsize=1)
def encoder_of(source: str) -> PieceEncoder:
    """A worker's encoder, which keeps what it remembers from task to task."""
    return PieceEncoder(source)


def _often(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pairs stand that do so MIN_COUNT times or more, each one's rank there (0: the most frequent), and the pairs by rank.

    Positions whose slot stands more seldom need no sort.
    """
    bits = min(PAIR_BITS, len(key).bit_length() + 1)
    slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)
    some = np.flatnonzero((np.bincount(slot, minlength=1 << bits) >= MIN_COUNT)[slot])
    seen, own, count = np.unique(key[some], return_inverse=True, return_counts=True)
    kept = np.flatnonzero(count >= MIN_COUNT)
    kept = kept[np.lexsort((seen[kept], -count[kept]))]
    rank = np.full(len(seen), -1, np.int32)
    rank[kept] = np.arange(len(kept))
    rank = rank[own]
    often = rank >= 0
    return some[often], rank[often], seen[kept]


def _packed(x: np.ndarray, bits: int) -> bytes:
    return np.packbits(((x.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)).tobytes()


def _unpacked(data: bytes, n: int, bits: int, at: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8, -(-n * bits // 8), at), count=n * bits).reshape(n, bits)
    out = np.zeros(n, np.int64)
    for i in range(bits):
        out |= flat[:, i].astype(np.int64) << i
    return out


def compress(ids: np.ndarray) -> bytes:
    """A shard: header, rules (left and right symbols), their expansion lengths, the sequence; symbols take as many bits as they need.

    Round after round all frequent pairs are counted, and where they overlap the more frequent one is replaced, until no
    pair stands MIN_COUNT times.
    """
    s = ids.astype(np.uint64)
    base = int(s.max()) + 1 if len(s) else 0
    left, right, made = [], [], 0
    # pairs that can be frequent: all at first, then those that were and those with a symbol of the last round
    live = np.ones(max(0, len(s) - 1), bool)
    while True:
        where = np.flatnonzero(live)
        some, rank, pair = _often((s[where] << np.uint64(32)) | s[where + 1])
        if not len(pair):
            break
        at = where[some]
        n, spot = len(at), np.arange(len(at))
        beside = at[1:] == at[:-1] + 1
        worse = np.zeros(n, bool)
        worse[1:] = beside & (rank[:-1] < rank[1:])
        worse[:-1] |= beside & (rank[1:] < rank[:-1])
        # of a run of one id every second pair is taken
        first = np.ones(n, bool)
        first[1:] = ~beside | (rank[1:] != rank[:-1])
        taken = ~worse & ((spot - np.maximum.accumulate(np.where(first, spot, 0))) % 2 == 0)
        used = np.bincount(rank[taken], minlength=len(pair))
        # the most frequent pair always stands, so a round is never without a rule
        good = used >= min(MIN_COUNT // 2, int(used.max()))
        taken &= good[rank]
        pick = at[taken]
        new = base + made
        left.append((pair[good] >> np.uint64(32)).astype(np.int64))
        right.append((pair[good] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        s[pick] = (np.cumsum(good) - 1 + new)[rank[taken]].astype(np.uint64)
        made += int(good.sum())
        keep = np.ones(len(s), bool)
        keep[pick + 1] = False
        live = np.zeros(len(s), bool)
        live[at] = True
        s, live = s[keep], live[keep][:-1]
        fresh = np.flatnonzero(s >= new)
        live[fresh[fresh < len(live)]] = True
        live[fresh[fresh > 0] - 1] = True
    empty = np.empty(0, np.int64)
    lengths, done = np.ones(made, np.int64), 0
    for a, b in zip(left, right, strict=True):  # a round's rules use earlier rounds' ones
        known = np.concatenate([np.ones(base, np.int64), lengths[:done]])
        lengths[done : done + len(a)] = known[a] + known[b]
        done += len(a)
    left, right = np.concatenate([empty, *left]), np.concatenate([empty, *right])
    bits, wide = max(1, (base + made - 1).bit_length() if base else 1), max(1, int(lengths.max(initial=1)).bit_length())
    head = struct.pack(HEAD, MAGIC, bits, wide, base, made, len(s), len(ids))
    return head + _packed(left, bits) + _packed(right, bits) + _packed(lengths, wide) + _packed(s, bits)


class Shard:
    """A compressed shard; ids(a, b) decodes a range."""

    def __init__(self, data: bytes):
        magic, bits, wide, self.base, rules, n, self.n_ids = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a grammar shard")
        at, parts = struct.calcsize(HEAD), []
        for count, size in ((rules, bits), (rules, bits), (rules, wide), (n, bits)):
            parts.append(_unpacked(data, count, size, at))
            at += -(-count * size // 8)
        self.left, self.right, self.lengths, self.sequence = parts
        rule = self.sequence >= self.base
        size = np.ones(n, np.int64)
        size[rule] = self.lengths[self.sequence[rule] - self.base]
        self.ends = np.cumsum(size)

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n_ids if b is None else min(b, self.n_ids)
        if a >= b:
            return np.empty(0, np.uint32)
        first, last = np.searchsorted(self.ends, a, side="right"), np.searchsorted(self.ends, b, side="left")
        s = self.sequence[first : last + 1]
        skip = a - (int(self.ends[first - 1]) if first else 0)
        rule = np.flatnonzero(s >= self.base)
        if len(rule):
            used, which = np.unique(s[rule], return_inverse=True)
            size = np.ones(len(s), np.int64)
            size[rule] = self.lengths[s[rule] - self.base]
            flat, each = self._expanded(used), self.lengths[used - self.base]
            # the used rules' ids, and then the plain ids, as one table from which the sequence is read
            start = len(flat) + np.arange(len(s))
            start[rule] = (np.cumsum(each) - each)[which]
            s = np.concatenate([flat, s])[segments(start, size)]
        return s[skip : skip + b - a].astype(np.uint32)

    def _expanded(self, s: np.ndarray) -> np.ndarray:
        """The ids that some rules stand for, one rule after another."""
        while len(rule := np.flatnonzero(s >= self.base)):
            at = rule + np.arange(len(rule))
            out = np.empty(len(s) + len(rule), np.int64)
            plain = np.ones(len(out), bool)
            plain[at] = plain[at + 1] = False
            out[plain] = s[s < self.base]
            out[at], out[at + 1] = self.left[s[rule] - self.base], self.right[s[rule] - self.base]
            s = out
        return s


SHARDS = "run int, shard int, first_in_run long, n_docs long, n_ids long, doc_ids binary, ends binary, payload binary"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes doc_id and text and returns the table of shards as written, in ascending doc_id order by (run, shard)."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, own, shard, before = encoder_of(source.value), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # doc ids, ids, numbers of ids

        def close() -> pa.RecordBatch:
            ids, n = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            keys = pa.concat_arrays([x[0] for x in held])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("k", pa.int64())])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([keys], ["k"]))
            row = {"run": [own], "shard": [shard], "first_in_run": [before], "n_docs": [len(n)], "n_ids": [len(ids)], "doc_ids": [sink.getvalue().to_pybytes()], "ends": [np.cumsum(n).astype("<i8").tobytes()], "payload": [compress(ids)]}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], [*row])

        for batch in batches:
            for piece in pieces(batch, limit=ENCODE_BYTES):
                ids, n = encoder.ids(piece.column(1))
                out = np.full(len(ids) + len(n), end_id, np.uint32)
                ends = np.cumsum(n + 1)
                body = np.ones(len(out), bool)
                body[ends - 1] = False
                out[body] = ids
                held.append((piece.column(0).cast(pa.int64()), out, n + 1))
                now = sum(len(x[1]) for x in held)
                if now >= shard_ids:
                    yield close()
                    held, shard, before = [], shard + 1, before + now
        if held:
            yield close()

    # the start of the text splits one id that very many rows hold; the order by text agrees with it
    keys = [F.col("doc_id"), F.substring("text", 1, 32)]
    spread = docs.select("doc_id", "text").repartitionByRange(partitions(spark), *keys).sortWithinPartitions("doc_id", "text")
    return stored(spread.mapInArrow(run, SHARDS), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """From shards: doc_id, start, n_tokens, ids_crc32, in the shards' order. Only the runs' totals (a row for each task that wrote) are summed in one place."""
    order = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.groupBy("run").agg(F.sum("n_ids").alias("n")).select("run", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    # as many rows as tasks have written
    spans = shards.join(F.broadcast(totals), "run").select((F.col("before") + F.col("first_in_run")).alias("first"), "doc_ids", "ends", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = pa.ipc.open_stream(row["doc_ids"]).read_all().column("k").combine_chunks()
                ends = np.frombuffer(row["ends"], "<i8")
                ids = Shard(row["payload"]).ids().astype("<u4")
                starts = np.append(0, ends[:-1])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(starts + row["first"]), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spans.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as ids of the public byte-level vocabulary, written in grammar shards and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(write_shards(docs, public_tokenizers.path("byte_bpe_50k.json")))
