"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document's terms are its words (lower case, hashed to WORD_TERMS), and, for how it is written, the trigrams of its
bytes' classes (small letter, capital, digit, blank, kinds of punctuation, ...) and words that repeat the one before.
Square roots of the terms' shares, words and writing apart, words weighted by inverse document frequency in the sample,
are projected on the leading singular vectors of a bounded labelled sample (TRAIN_ROWS). The sample's
latent vectors are broadcast (TRAIN_ROWS x DIMENSIONS doubles at most); every document takes exact
cosine products with all of them in blocks, and its nearest neighbours vote with their similarity.

Defined cases: a null text counts as empty; an empty text, whose vector is zero, gets the sample's
mean label; without any labels all scores are 0; equal texts get equal scores; of neighbours with one
similarity those with smaller ids vote first; repeated rows and null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import Words, held_out, pieces, span_hashes, table, text_bytes, training_rows

TRAIN_ROWS = 4000
DIMENSIONS = 48
NEIGHBOURS = 15
#: A neighbour's vote is its cosine to this power.
SHARPNESS = 16
BLOCK_ROWS = 256
#: Rounds of orthogonal iteration.
ITERATIONS = 12


def _classes() -> np.ndarray:
    out = np.full(256, 11, np.uint16)
    for c, members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n\r\t\x0b\x0c", b".", b",", b"!?", b"#$%&*@^~=+<>_\\", b"|", b"-:;'\"()[]{}/`")):
        out[[*members]] = c
    out[128:] = 12
    out[[*range(9), *range(14, 32), 127]] = 11
    return out


CLASSES = _classes()
N_CLASSES = 13
#: Terms of the writing, and of the words.
FORM_TERMS = N_CLASSES**3 + 1
WORD_TERMS = 2048
TERMS = FORM_TERMS + WORD_TERMS
#: Weight of the words' part against that of the writing.
WORDS_WEIGHT = 0.5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def term_shares(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of each term in each text: of writing (the last one: words that equal the one before), then of words."""
    n = len(texts)
    offsets, data = text_bytes(texts)
    c = CLASSES[data].astype(np.int64)
    out = np.zeros((n, FORM_TERMS))
    if len(c) >= 3:
        code = (c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:]
        doc = np.repeat(np.arange(n), np.diff(offsets))
        own = doc[:-2] == doc[2:]
        out[:, :-1] = np.bincount(doc[:-2][own] * (FORM_TERMS - 1) + code[own], minlength=n * (FORM_TERMS - 1)).reshape(n, FORM_TERMS - 1)
    w = Words(texts)
    if len(w.doc) > 1:
        h = w.hashes()
        again = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
        # a repeated word weighs as much as its letters would
        out[:, -1] = np.bincount(w.doc[1:][again], (w.end - w.start + 1)[1:][again], n)
    w = Words(texts, _BETWEEN)
    slot = (span_hashes(_LOWER[w.data], w.start, w.end) >> np.uint64(40)).astype(np.int64) % WORD_TERMS
    named = np.bincount(w.doc * WORD_TERMS + slot, minlength=n * WORD_TERMS).reshape(n, WORD_TERMS)
    return np.concatenate([np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1)) for x in (out, named)], axis=1)


class Model:
    """Projection, the sample's unit latent vectors and their labels."""

    def __init__(self, projection: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.projection, self.vectors, self.labels = projection, vectors, labels
        self.mean = float(labels.mean()) if len(labels) else 0.0

    def latent(self, shares: np.ndarray) -> np.ndarray:
        z = shares @ self.projection
        size = np.linalg.norm(z, axis=1, keepdims=True)
        return np.divide(z, size, out=np.zeros_like(z), where=size > 1e-12)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.mean)
        if not len(self.labels):
            return out
        z = self.latent(term_shares(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(z), BLOCK_ROWS):
            block = z[a : a + BLOCK_ROWS]
            cos = np.round(block @ self.vectors.T, 12)
            edge = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
            above, level = cos > edge, cos == edge
            room = k - above.sum(axis=1, keepdims=True)
            vote = above | (level & (np.cumsum(level, axis=1) <= room))
            weight = np.where(vote, np.maximum(cos, 0) ** SHARPNESS, 0.0)
            total = weight.sum(axis=1)
            known = total > 0
            out[a : a + BLOCK_ROWS][known] = (weight @ self.labels)[known] / total[known]
        return np.clip(out, 0, 1)


def fit(shares: np.ndarray, labels: np.ndarray) -> Model:
    """shares: rows of term_shares in the order in which ties vote."""
    if not len(labels):
        return Model(np.zeros((TERMS, 1)), np.zeros((0, 1)), labels)
    weight = np.ones(TERMS, np.float32)
    weight[FORM_TERMS:] = WORDS_WEIGHT * np.log((1 + len(shares)) / (1 + (shares[:, FORM_TERMS:] > 0).sum(axis=0))) / np.log(1 + len(shares))
    weighted = shares * weight
    # leading right singular vectors by orthogonal iteration from a fixed start
    base = np.linalg.qr(weighted.T @ np.random.default_rng(1).standard_normal((len(shares), min(DIMENSIONS + 16, len(shares)))).astype(np.float32))[0]
    for _ in range(ITERATIONS):
        base = np.linalg.qr(weighted.T @ (weighted @ base))[0]
    _, sizes, turned = np.linalg.svd(weighted @ base, full_matrices=False)
    lead = np.flatnonzero(sizes[:DIMENSIONS] > 1e-5)
    projection = (weight[:, None] * (base @ turned[lead].T)).astype(np.float64)
    model = Model(projection, np.zeros((0, 1)), labels)
    model.vectors = model.latent(shares)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    sample = training_rows(docs, labels, label, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                shares = term_shares(piece.column(2)).astype(np.float32)
                row, at = np.nonzero(shares)
                ends = np.searchsorted(row, np.arange(len(shares) + 1)).astype(np.int32)
                terms, values = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (at.astype(np.int32), shares[row, at]))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), terms, values], ["doc_id", "_label", "terms", "shares"])

    found = sample.mapInArrow(run, "doc_id long, _label int, terms array<int>, shares array<float>").toArrow().sort_by("doc_id").combine_chunks()
    terms, values = (found.column(c).combine_chunks() for c in ("terms", "shares"))
    shares = np.zeros((len(found), TERMS), np.float32)
    shares[np.repeat(np.arange(len(found)), terms.value_lengths().to_numpy()), terms.flatten().to_numpy()] = values.flatten().to_numpy()
    return fit(shares, np.array(found.column("_label").to_pylist(), np.float64))


def score_documents(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    keep = [c for c in docs.columns if c not in (score, text)]
    schema = T.StructType([f for f in docs.schema if f.name in keep] + [T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.projection, model.vectors, model.labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for piece in pieces(batch, text):
                columns = {c: piece.column(piece.schema.get_field_index(c)) for c in keep}
                yield pa.RecordBatch.from_pydict(columns | {score: pa.array(own.score(piece.column(piece.schema.get_field_index(text))))})

    return docs.select(*keep, text).mapInArrow(run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
