"""Substring deduplication over prefix-partitioned suffix trees.

A suffix is a word position; a window is WINDOW words. Of each run of windows only the suffix at its
anchor (the 5-word prefix with the smallest hash in the window) stands for it, so equal windows of
different documents meet under equal prefixes and a fifth of all suffixes is enough.

1. Census: how often each prefix stands in different documents. Prefixes of one document are leaves and leave.
   A prefix that is too frequent for one group is lengthened, two words at a time, for each of its windows by
   itself, and the longer prefixes are counted in turn, up to the whole window.
2. The other suffixes go, with the words of their windows, to groups of a bounded number of bytes, one group to a task.
3. A group's suffix tree is its suffix array with the common prefixes of neighbours: an internal node of depth WINDOW
   or more is a stretch of suffixes that have as many words in common. Each such node's smallest doc_id owns its windows.
4. Words covered by a window whose owner has a smaller doc_id are removed; windows that follow one another make a
   maximal repeat, which is one range of the removed words.

Words are compared as they are, by numbers from a dictionary of them; hashes only deal them to groups and look them up.

Documents travel in chunks (Arrow, zstandard) that are written once to the shared folder, and all
messages are per chunk: a passage in any number of documents is one entry for each chunk that holds
it, so no group grows with the number of copies.

Defined cases: keys are integers (of any width), others are an error; a null text has no words; a text of fewer than WINDOW words keeps all; a row with a null
id neither loses words nor takes any from others; rows with one id do not take words from each other;
a document whose words all stay keeps its text as it is; an empty table gives an empty table; extra
columns are passed on unless they clash with n_words, n_removed, kept_sha256, removed.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import _WORDS, Words, gram_hashes, grouped, mix, partitions, pieces, segments, stored, table

WINDOW = 13
PREFIX = 5
CHUNK_BYTES = 2 << 20
#: Words of all text for a group of the census, and bytes of suffixes, about, for a group of trees.
CENSUS_WORDS = 6_000_000
TREE_BYTES = 8 << 20
#: A prefix in more chunks than this is lengthened.
HOT_CHUNKS = 4096
#: Words by which a prefix is lengthened.
LONGER = 2
NOBODY = np.int64(2**63 - 1)
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(columns: dict) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict(columns)
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def message(arrays: list[np.ndarray], body: bytes = b"") -> bytes:
    """Arrays of one length and a body, without a schema: there are many small messages."""
    return _PACK.compress(struct.pack("<I", len(arrays[0])) + b"".join(a.tobytes() for a in arrays) + body)


def read_message(blob: bytes, kinds: str) -> tuple[list[np.ndarray], bytes]:
    raw = _UNPACK.decompress(blob)
    n, at, out = struct.unpack_from("<I", raw)[0], 4, []
    for kind in kinds.split():
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * out[-1].itemsize
    return out, raw[at:]


def _packed(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "level": pa.int32(), "hot": pa.int64(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kinds[n]) for i, n in enumerate(names)], names)


def numbered(w: Words) -> np.ndarray:
    """For each word its number in the dictionary of all of them."""
    size = w.end - w.start
    ends = np.concatenate([[0], np.cumsum(size)])
    data = w.data[segments(w.start, size)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(size) else np.empty(0, np.int64)


class Chunk:
    """A chunk's documents, their words, and the runs of windows with one anchor."""

    def __init__(self, docs: pa.Table, text: str, key: str, window: int):
        self.docs, self.window = docs, window
        self.words = w = Words(docs.column(text).combine_chunks())
        self.hash = w.hashes()
        ids = docs.column(key).combine_chunks().cast(pa.int64())
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(int(NOBODY)).to_numpy()
        n = len(self.hash) - window + 1
        self._numbers = None
        self.valid = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :]) if n > 0 else np.empty(0, np.int64)

    @property
    def numbers(self) -> np.ndarray:
        if self._numbers is None:
            self._numbers = numbered(self.words)
        return self._numbers

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and prefix hash of each run."""
        s, prefix = self.valid, min(PREFIX, self.window)
        gram = gram_hashes(self.hash, prefix)
        if not len(s):
            return s, s, gram[:0]
        least, anchor = gram[s], s.copy()
        for off in range(1, self.window - prefix + 1):
            g = gram[s + off]
            less = g < least
            least = np.where(less, g, least)
            anchor[less] = s[less] + off
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)])
        at = np.flatnonzero(new)
        return s[at], np.diff(np.append(at, len(s))), least[at]

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a on are those from b on."""
        out = np.ones(len(a), bool)
        for k in range(int(n.max(initial=0))):
            at = np.flatnonzero(out & (n > k))
            out[at] = self.numbers[a[at] + k] == self.numbers[b[at] + k]
        return out

    def placed(self, known: list[np.ndarray], lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and prefix hash of what stands under repeated prefixes of the lengths counted so far,
        and the windows whose longest prefix of these is still too frequent."""
        start, n, prefix = self.runs()
        hit, hot = _known(known[0], prefix)
        out = [(start[hit & ~hot], n[hit & ~hot], prefix[hit & ~hot])]
        rest = segments(start[hot], n[hot])
        for entries, length in zip(known[1:], lengths[1:], strict=False):
            prefix = self.spans(rest, np.full(len(rest), length))
            hit, hot = _known(entries, prefix)
            cool = hit & ~hot
            out.append((rest[cool], np.ones(int(cool.sum()), np.int64), prefix[cool]))
            rest = rest[hot]
        return *(np.concatenate(x) for x in zip(*out, strict=True)), rest

    def spans(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hashes of the words start:start+n."""
        up, down = _WORDS.upto(len(self.hash) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * up[: len(self.hash)])])
        return mix((total[start + n] - total[start]) * down[start] + n.astype(np.uint64))


def _known(entries: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether prefixes are among the repeated ones, and whether they are too frequent (in the lowest bit)."""
    if not len(entries):
        return np.zeros(len(prefix), bool), np.zeros(len(prefix), bool)
    at = np.minimum(np.searchsorted(entries & ~np.uint64(1), prefix & ~np.uint64(1)), len(entries) - 1)
    hit = (entries[at] & ~np.uint64(1)) == (prefix & ~np.uint64(1))
    return hit, hit & ((entries[at] & np.uint64(1)) == 1)


class Subtree:
    """Suffixes of contexts in order, with the words that neighbours have in common; nodes of depth window or more.

    order: suffixes (indexes into start) in the order of their words; common: words that each has in common with the one
    before, up to the end of their contexts, or 0 if fewer than window; node: of each suffix; depth: of each node.
    """

    def __init__(self, numbers: np.ndarray, start: np.ndarray, end: np.ndarray, window: int):
        """numbers: words of all contexts; start, end: each suffix's first word and the end of its context."""
        bits = max(1, int(numbers.max(initial=0)).bit_length())
        keys = []
        for a in range(0, window, 63 // bits):
            key = np.zeros(len(start), np.int64)
            for k in range(a, min(window, a + 63 // bits)):
                key = (key << bits) | numbers[start + k]
            keys.append(key)
        self.order = np.lexsort(keys[::-1])
        same = np.zeros(len(start), bool)
        if len(start):
            same[1:] = np.logical_and.reduce([k[self.order][1:] == k[self.order][:-1] for k in keys])
        self.common = np.where(same, window, 0)
        pair = np.flatnonzero(same)
        a, b = start[self.order[pair - 1]], start[self.order[pair]]
        room = np.minimum(end[self.order[pair - 1]] - a, end[self.order[pair]] - b)
        depth = window
        while len(pair):
            on = np.flatnonzero(room > depth)
            on = on[numbers[a[on] + depth] == numbers[b[on] + depth]]
            pair, a, b, room = pair[on], a[on], b[on], room[on]
            depth += 1
            self.common[pair] = depth
        begin = np.flatnonzero(~same)
        self.node = np.empty(len(start), np.int64)
        self.node[self.order] = np.cumsum(~same) - 1
        inner = np.where(same, self.common, np.iinfo(np.int64).max)
        self.depth = np.minimum.reduceat(inner, begin) if len(begin) else inner
        self.depth[self.depth == np.iinfo(np.int64).max] = 0  # a leaf

    def owners(self, ids: np.ndarray) -> np.ndarray:
        """The smallest id below each suffix's node."""
        out = np.full(len(self.depth), NOBODY)
        np.minimum.at(out, self.node, ids)
        return out[self.node]


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, spans: bool = False) -> DataFrame:
    """docs with the text less its repeated words, n_words, n_removed, kept_sha256 and, with spans, removed: ranges of words."""
    spark = docs.sparkSession
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if spans:
        added.append(T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))))
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256", "removed")]
    schema = T.StructType([docs.schema[c] for c in keep] + added)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = TaskContext.get().partitionId() << 33, [], 0

        def close() -> pa.RecordBatch:
            docs = pa.Table.from_batches(held).combine_chunks()
            n = int(Words(docs.column(text).combine_chunks()).n.sum())
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([pack({c: docs.column(c).combine_chunks() for c in keep})], pa.binary())], ["chunk", "words", "bytes", "blob"])

        for batch in batches:
            for piece in pieces(batch, text, CHUNK_BYTES // 4):
                held.append(piece)
                size += piece.column(piece.schema.get_field_index(text)).nbytes
                if size >= CHUNK_BYTES:
                    yield close()
                    at, held, size = at + 1, [], 0
        if held:
            yield close()

    chunks = stored(docs.select(*keep).mapInArrow(chunked, "chunk long, words long, bytes long, blob binary"), "chunks", "none")
    total = chunks.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    census_groups = max(partitions(spark), math.ceil(total.words / CENSUS_WORDS))
    lengths = [*range(min(PREFIX, window), window, LONGER)] or [window]

    def counts(chunk: int, prefix: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A chunk's distinct prefixes, with a bit for those of several documents, dealt to groups."""
        order = np.lexsort((doc, prefix))
        prefix, doc = prefix[order], doc[order]
        at = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(prefix) else np.empty(0, np.int64)
        if not len(at):
            return
        several = doc[at] != doc[np.append(at[1:], len(doc)) - 1]
        entry = prefix[at] & ~np.uint64(1) | several.astype(np.uint64)
        group = ((prefix[at] >> np.uint64(32)) % np.uint64(census_groups)).astype(np.int32)
        order = np.argsort(group, kind="stable")
        entry, group = entry[order], group[order]
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        yield _packed([(int(group[a]), chunk, entry[a:b].tobytes()) for a, b in zip(edge, edge[1:], strict=False)], ["bucket", "chunk", "blob"])

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk"), batch.column("blob"), strict=True):
                c = Chunk(unpack(blob.as_buffer()), text, key, window)
                start, _, prefix = c.runs()
                yield from counts(chunk.as_py(), prefix, c.words.doc[start])

    def repeated(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Of each chunk the prefixes that stand in several documents, with a bit for those that are too frequent."""
        chunk = rows.column("chunk").to_numpy()
        parts = [np.frombuffer(b, np.uint64) for b in rows.column("blob").to_pylist()]
        entry = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        _, inverse, count = np.unique(entry & ~np.uint64(1), return_inverse=True, return_counts=True)
        several = np.zeros(len(count), bool)
        several[inverse[(entry & np.uint64(1)) == 1]] = True
        stays = ((count > 1) | several)[inverse]
        hot = (count > HOT_CHUNKS)[inverse]
        entry, hot, owner = (entry & ~np.uint64(1) | hot.astype(np.uint64))[stays], hot[stays], owner[stays]
        n = np.bincount(owner, minlength=len(parts))
        edge = np.concatenate([[0], np.cumsum(n)])
        some = np.flatnonzero(n)
        if len(some):
            yield _packed([(int(chunk[i]), int(hot[edge[i] : edge[i + 1]].sum()), entry[edge[i] : edge[i + 1]].tobytes()) for i in some.tolist()], ["chunk", "hot", "blob"])

    def meet(rows: pa.Table) -> tuple[bytes, list[tuple[int, bytes]]]:
        """A chunk, and the messages to it by level."""
        level, blobs = rows.column("level").to_pylist(), rows.column("blob").to_pylist()
        return blobs[level.index(-1)], [(n, b) for n, b in zip(level, blobs, strict=True) if n >= 0]

    def entries_of(answers: list[tuple[int, bytes]], levels: int) -> list[np.ndarray]:
        return [np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(b, np.uint64) for n, b in answers if n == k)])) for k in range(levels)]

    def next_census(levels: int):
        def run(chunk_key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            blob, answers = meet(rows)
            if answers:
                c = Chunk(unpack(blob), text, key, window)
                *_, rest = c.placed(entries_of(answers, levels), lengths)
                yield from counts(chunk_key[0], c.spans(rest, np.full(len(rest), lengths[levels])), c.words.doc[rest])

        return run

    def sides(other: DataFrame) -> DataFrame:
        return chunks.select("chunk", F.lit(-1).alias("level"), "blob").unionByName(other.select("chunk", "level", "blob"))

    def counted(found: DataFrame, level: int) -> DataFrame:
        return stored(grouped(found, ["bucket"], repeated, "chunk long, hot long, blob binary", census_groups, direct=True).withColumn("level", F.lit(level)), "prefixes", "none")

    prefixes = [counted(chunks.select("chunk", "blob").mapInArrow(census, "bucket int, chunk long, blob binary"), 0)]
    while len(prefixes) < len(lengths) and not prefixes[-1].where("hot > 0").isEmpty():
        levels = reduce(DataFrame.unionByName, prefixes)
        prefixes.append(counted(grouped(sides(levels), ["chunk"], next_census(len(prefixes)), "bucket int, chunk long, blob binary"), len(prefixes)))
    n_levels, prefixes = len(prefixes), reduce(DataFrame.unionByName, prefixes)
    n_entries = prefixes.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()[0] / 8
    tree_groups = max(partitions(spark), math.ceil(n_entries * (window + 4) * (total.bytes / max(total.words, 1)) / TREE_BYTES))

    def contexts(chunk_key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        blob, answers = meet(rows)
        if not answers:
            return
        c = Chunk(unpack(blob), text, key, window)
        start, n, group, rest = c.placed(entries_of(answers, n_levels), lengths)
        # what is too frequent at every length goes under its whole window
        group = np.concatenate([group, c.spans(rest, np.full(len(rest), window))])
        start, n = np.concatenate([start, rest]), np.concatenate([n, np.ones(len(rest), np.int64)])
        if not len(start):
            return
        # equal contexts of the chunk go once, with their smallest and largest id
        _, first, inverse = np.unique(c.spans(start, n + window - 1), return_index=True, return_inverse=True)
        if not ((n == n[first[inverse]]) & c.same(start, start[first[inverse]], n + window - 1)).all():
            first = inverse = np.arange(len(start))  # hashes of different words are equal
        doc = c.id[c.words.doc[start]]
        low, high = np.full(len(first), NOBODY), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, np.where(doc == NOBODY, np.iinfo(np.int64).min, doc))
        start, n = start[first], n[first]
        group = (mix(group[first] >> np.uint64(1)) % np.uint64(tree_groups)).astype(np.int32)
        order = np.lexsort((start, group))
        group, start, n, low, high = group[order], start[order], n[order], low[order], high[order]
        a, b = c.words.start[start], c.words.end[start + n + window - 2]
        data = c.words.data[segments(a, b - a)]
        ends = np.concatenate([[0], np.cumsum(b - a)])
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        found = []
        for x, y in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            arrays = [start[x:y].astype("<i4"), n[x:y].astype("<i2"), low[x:y].astype("<i8"), high[x:y].astype("<i8"), (b - a)[x:y].astype("<i4")]
            found.append((int(group[x]), chunk_key[0], message(arrays, data[ends[x] : ends[y]].tobytes())))
        yield _packed(found, ["bucket", "chunk", "blob"])

    def tree(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        parts = [read_message(b.as_buffer(), "<i4 <i2 <i8 <i8 <i4") for b in rows.column("blob")]
        chunk = np.repeat(rows.column("chunk").to_numpy(), [len(p[0][0]) for p in parts])
        at, n, low, high, size = (np.concatenate([p[0][i] for p in parts]).astype(np.int64) for i in range(5))
        body = pa.py_buffer(b"".join(p[1] for p in parts))
        del parts
        w = Words(pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).tobytes()), body))
        start = segments(w.first[:-1], n)
        subtree = Subtree(numbered(w), start, np.repeat(w.first[1:], n), window)
        owner = subtree.owners(np.repeat(low, n))
        place = segments(at, n)
        taken = np.flatnonzero(owner < np.repeat(high, n))
        if not len(taken):
            return
        chunk, place, owner = np.repeat(chunk, n)[taken], place[taken], owner[taken]
        order = np.lexsort((place, chunk))
        chunk, place, owner = chunk[order], place[order], owner[order]
        edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])).tolist()
        yield _packed([(int(chunk[a]), 0, message([place[a:b].astype("<i4"), owner[a:b].astype("<i8")])) for a, b in zip(edge, edge[1:], strict=False)], ["chunk", "level", "blob"])

    def removed(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        blob, answers = meet(rows)
        c = Chunk(unpack(blob), text, key, window)
        w = c.words
        gone = np.zeros(len(c.hash) + 1, np.int64)
        if answers:
            found = [read_message(b, "<i4 <i8")[0] for _, b in answers]
            where, owner = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(2))
            gram = gram_hashes(c.hash, window)
            names, first = np.unique(gram[where], return_index=True)
            own = gram[c.valid]
            at = np.minimum(np.searchsorted(names, own), len(names) - 1)
            hit = np.flatnonzero(names[at] == own)
            least = owner[first][at[hit]]
            if not c.same(c.valid[hit], where[first][at[hit]], np.full(len(hit), window)).all():  # hashes of different words are equal
                by = {c.numbers[i : i + window].tobytes(): o for i, o in zip(where.tolist(), owner.tolist(), strict=True)}
                least = np.array([by.get(c.numbers[i : i + window].tobytes(), int(NOBODY)) for i in c.valid[hit].tolist()], np.int64)
            doc = w.doc[c.valid[hit]]
            hit = hit[c.known[doc] & (least < c.id[doc])]
            np.add.at(gone, c.valid[hit], 1)
            np.add.at(gone, c.valid[hit] + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        stay = np.flatnonzero(~gone)
        size = w.end[stay] - w.start[stay] + 1
        out = np.append(w.data, np.uint8(32))[segments(w.start[stay], size)]
        to = np.cumsum(size)
        out[to - 1] = 32
        n_removed = np.bincount(w.doc[gone], minlength=len(w.n))
        last = np.concatenate([[0], to])[np.cumsum(np.append(0, w.n - n_removed))].tolist()
        view = memoryview(out)
        kept = [view[a : b - 1] if b > a else view[a:a] for a, b in zip(last, last[1:], strict=False)]
        columns = {x: c.docs.column(x).combine_chunks() for x in keep}
        if n_removed.any():
            texts = columns[text]
            columns[text] = pa.array([str(k, "utf-8") if r else t for k, r, t in zip(kept, n_removed.tolist(), texts.to_pylist(), strict=True)], texts.type)
        columns |= {"n_words": pa.array(w.n, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if spans:
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            cut = w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] < len(gone))]  # a range ends with its document
            inside = cut[gone[cut] & gone[cut - 1]] if len(cut) else cut
            a, b = np.sort(np.concatenate([a, inside])), np.sort(np.concatenate([b, inside]))
            doc = w.doc[a]
            pairs = pa.StructArray.from_arrays([pa.array(a - w.first[doc], pa.int32()), pa.array(b - w.first[doc], pa.int32())], ["start", "end"])
            columns["removed"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(w.n) + 1)), pa.int32()), pairs)
        yield pa.RecordBatch.from_pydict(columns)

    met = grouped(sides(prefixes), ["chunk"], contexts, "bucket int, chunk long, blob binary")
    owners = grouped(met, ["bucket"], tree, "chunk long, level int, blob binary", tree_groups, direct=True)
    return grouped(sides(owners), ["chunk"], removed, schema)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of documents without passages of 13 words or more that a document with a smaller id has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM words WHERE len(w) >= 13),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS g FROM starts),
owned AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY g) AS owner FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM owned WHERE owner < doc_id),
listed AS (SELECT doc_id, list(i ORDER BY i) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, w.w, coalesce(l.gone, []) AS gone,
                CASE WHEN l.gone IS NULL THEN w.w ELSE list_filter(w.w, lambda x, i: NOT list_contains(l.gone, i)) END AS k
         FROM words w LEFT JOIN listed l USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256
FROM kept
"""
