"""BPE encoding and decoding by batched numpy merge rounds.

Symbols of many words lie in one flat array. In each round every word finds its lowest-ranked pair
(binary search over the sorted pair keys) and merges it; words without a pair leave the array.
Results equal those of the tokenizers library for word-level BPE files (an end-of-word suffix, words
cut by a pattern, byte-level alphabet).

Defined cases: a null text counts as empty; an empty or blank text has no tokens; equal texts give
equal rows; repeated rows and null ids are kept as they are; other columns are passed on unchanged
by `encode_documents` unless they clash with its own, which then win.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from recordloom.llm.common import pieces, segments

#: White space of the tokenizer's patterns (Unicode White_Space).
SPACE = "\t-\r \x85   -     　"
#: Words kept between batches in one Python worker.
CACHE_WORDS = 800_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class MergeTable:
    """Vocabulary and merges as arrays; built from the text of a tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        alphabet = byte_alphabet()
        self.inner = np.array([self.vocab[c] for c in alphabet], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in alphabet], np.int64)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the words' numbers of ids."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        full = lengths > 0
        symbols[ends[full]] = self.last[data[ends[full]]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        none = len(self.keys)

        def ranked(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Place in the sorted keys and rank of the pairs that begin at i."""
            key = (symbols[i] << 32) | symbols[i + 1]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            return at, np.where((self.keys[at] == key) & (owner[i] == owner[i + 1]), self.rank[at], none)

        place, rank = np.zeros(len(symbols), np.int64), np.full(len(symbols), none, np.int64)
        place[:-1], rank[:-1] = ranked(np.arange(len(symbols) - 1))
        while len(symbols):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, begin)
            least_of = np.repeat(least, np.diff(np.append(begin, len(symbols))))
            live = least_of < none
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, place, rank, least_of = symbols[live], owner[live], place[live], rank[live], least_of[live]
                if not len(symbols):
                    break
            # in a run of equal symbols the pairs overlap: take every second one from the left
            run = np.flatnonzero(rank == least_of)
            fresh = np.concatenate([[True], np.diff(run) > 1])
            run = run[(run - run[np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))]) % 2 == 0]
            symbols[run] = self.made[place[run]]
            keep = np.ones(len(symbols), bool)
            keep[run + 1] = False
            now = run - np.arange(len(run))  # where the merged symbols are after the others have gone
            symbols, owner, place, rank = symbols[keep], owner[keep], place[keep], rank[keep]
            mark = np.zeros(len(symbols) + 1, bool)
            mark[now] = mark[now - 1] = True
            touched = np.flatnonzero(mark[:-1])
            rank[touched] = none
            touched = touched[touched < len(symbols) - 1]
            place[touched], rank[touched] = ranked(touched)
        ids = np.concatenate(done_symbols) if done_symbols else np.empty(0, np.int64)
        owner = np.concatenate(done_owner) if done_owner else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))


class Joiner:
    """Joins the texts of ids with one space, many documents at a time."""

    def __init__(self, texts: list[str]):
        raw = [b" " + t.encode() for t in texts]
        self.n = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.short = np.zeros((len(raw), 8), np.uint8)
        for i, r in enumerate(raw):
            self.short[i, : min(8, len(r))] = np.frombuffer(r[:8], np.uint8)
        self.mask = np.arange(8) < self.n[:, None]

    def join(self, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """One item for each document; ends: where its ids end."""
        n = self.n[ids]
        to = np.cumsum(n)
        if len(n) and n.max() <= 8:
            data = self.short[ids][self.mask[ids]]
        else:
            data = self.data[segments(self.start[ids], n)]
        edge = np.concatenate([[0], to])[np.concatenate([[0], ends])].tolist()
        view = memoryview(data)
        return [view[a + 1 : b] if b > a else view[a:b] for a, b in zip(edge, edge[1:], strict=False)]


class WordEncoder:
    """Texts to ids: lower case, words by pattern, merges in numpy for all words not seen lately."""

    _odd_space = regex.compile("[\x1c-\x1f]")

    def __init__(self, source: str):
        spec = json.loads(source)
        self.table = MergeTable(source)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace("[^\\s", f"[^{SPACE}"))
        self.special = regex.compile("|".join(regex.escape(t) for t in self.table.special)) if self.table.special else None
        self.alphabet = byte_alphabet()
        spelled = [self.table.tokens.get(i, "") for i in range(max(self.table.tokens) + 1)]
        self.as_ids, self.as_tokens = Joiner([str(i) for i in range(len(spelled))]), Joiner(spelled)
        #: chunk without white space -> its number; ids of all chunks, where they start and how many they are
        self.number: dict = {}
        self.flat, self.start, self.n = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def _normal(chunk: str) -> str:
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()

    def _chunks(self, text: str) -> list:
        return regex.findall(f"[^{SPACE}]+", text) if self._odd_space.search(text) else text.split()

    def _learn(self, chunks: list[str]) -> None:
        words: list[str] = []  # of all chunks, one after another
        counts = []
        find, normal = self.words.findall, self._normal
        for c in chunks:
            c = c.lower() if c.isascii() else normal(c)
            if c.isalpha():  # one word of letters
                words.append(c)
                counts.append(1)
            else:
                found = find(c)
                words += found
                counts.append(len(found))
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        numbers = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        ids, n = self.table.encode_words([w.encode() for w in index])
        start = np.cumsum(n) - n
        self._add(chunks, ids[segments(start[numbers], n[numbers])], np.add.reduceat(np.append(n[numbers], 0), np.cumsum([0, *counts[:-1]])))

    def _add(self, chunks: list, ids: np.ndarray, n: np.ndarray) -> None:
        self.number.update(zip(chunks, range(len(self.n), len(self.n) + len(chunks)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's ids end."""
        if len(self.number) > CACHE_WORDS:
            self.number.clear()
            self.flat, self.start, self.n = self.flat[:0], self.start[:0], self.n[:0]
        split = []
        for text in texts:
            if self.special and "<|" in text and self.special.search(text):
                parts, at = [], 0
                for m in self.special.finditer(text):
                    own = (m.group(),)  # a tuple: the same letters within a chunk are no special token
                    if own not in self.number:
                        self._add([own], np.array([self.table.special[own[0]]]), np.array([1]))
                    parts += [*self._chunks(text[at : m.start()]), own]
                    at = m.end()
                split.append(parts + self._chunks(text[at:]))
            else:
                split.append(self._chunks(text))
        known = self.number
        fresh = {c for parts in split for c in parts if c not in known}
        if fresh:
            self._learn([*fresh])
        sizes = np.array([len(p) for p in split], np.int64)
        number = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        n = self.n[number]
        return self.flat[segments(self.start[number], n)], np.concatenate([[0], np.cumsum(n)])[np.cumsum(sizes)]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: tokens joined by one space."""
        return " ".join(self.table.tokens[i] for i in ids if i in self.table.tokens)


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", lists: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 to docs; with lists also ids (array<int>) and decoded (string).

    tokenizer: the tokenizer file's path, read on the driver only; its content (under 2 MB) goes with the tasks.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    own = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if lists:
        own += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    names = {f.name for f in own}
    keep = [c for c in docs.columns if c not in names]
    schema = T.StructType([f for f in docs.schema if f.name in keep] + own)
    carried = [c for c in keep if c != text or lists]
    if not lists:
        schema = T.StructType([f for f in docs.schema if f.name in carried] + own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(source.value)
        for batch in batches:
            for piece in pieces(batch, text):
                texts = [t or "" for t in piece.column(piece.schema.get_field_index(text)).to_pylist()]
                ids, ends = encoder.ids(texts)
                n = np.diff(ends, prepend=0)
                tokens = encoder.as_tokens.join(ids, ends)
                columns = {c: piece.column(piece.schema.get_field_index(c)) for c in carried}
                columns |= {"n_tokens": pa.array(n, pa.int64())}
                columns |= {"ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in encoder.as_ids.join(ids, ends)], pa.string())}
                columns |= {"decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in tokens], pa.string())}
                if lists:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
                    columns["decoded"] = pa.array([str(x, "utf-8") for x in tokens], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(*keep).mapInArrow(run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded with the public word-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
