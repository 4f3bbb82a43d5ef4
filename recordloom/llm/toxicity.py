"""Toxicity by a counterfactually regularised classifier.

Logistic regression over the words of a document and their first letters (4 to 6 bytes). Each sentence of a
labelled document that names a group of people is rewritten with other groups' names; a change of
score (before the logistic curve) between the sentence and its rewritten form is penalised with its square. So the
names of groups do not carry weight by themselves and neutral mentions are left alone. The caller may give the
groups; IDENTITY is the default.

The model is fitted on the driver on a bounded sample of labelled documents (TRAIN_ROWS) and has at
most FEATURES weights, those of the largest log odds in the sample, which go with the tasks; every document is scored
by its whole text.

Defined cases: a null text counts as empty; an empty text gets the score of the bias alone; without
labels, or with one class only, the score is the mean label, or 0 without any; equal texts get equal
scores; repeated rows and null ids are kept (a null id is not held out).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import Words, discard, held_out, mix, pieces, span_hashes, stored, table, training_rows

TRAIN_ROWS = 8000
FEATURES = 1024
#: A feature must stand in this many sample documents.
LEAST_DOCS = 3
#: ... and its log odds ratio be this many standard errors from 0.
LEAST_Z = 2.5
#: Weight of the weights' squares against the sum of the documents' losses.
RIDGE = 0.02
#: Weight of the squared change of score under a swap.
COUNTERFACTUAL = 1.0
STEPS = 30
PREFIXES = (4, 5, 6)
#: Rewritten forms of each sentence: terms are replaced by the one that follows in their group, and the one after.
SWAPS = 2

# Names of groups of people; terms of a line can stand for each other.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("girl", "boy"),
    ("female", "male"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    ("transgender", "cisgender", "trans", "nonbinary"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "mexican", "chinese", "american", "indian", "turkish", "polish"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("immigrant", "refugee", "native", "foreigner", "citizen"),
    ("blind", "deaf", "disabled", "autistic"),
    ("old", "young", "elderly"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class Swapper:
    """Rewrites sentences: terms of a group (lower case) stand for each other."""

    def __init__(self, groups: tuple[tuple[str, ...], ...] = IDENTITY):
        self.next = [{t: g[(i + k) % len(g)] for g in groups for i, t in enumerate(g) if len(g) > k or k == 1} for k in range(1, SWAPS + 1)]
        terms = sorted({t for g in groups for t in g}, key=lambda t: (-len(t), t))
        self.term = re.compile(r"(?<![^\W_])(" + "|".join(map(re.escape, terms)) + r")(?![^\W_])") if terms else re.compile(r"(?!)")

    def pairs(self, text: str) -> list[tuple[str, str]]:
        """Each sentence of the lower-case text that holds a term, with each of its rewritten forms."""
        text = text.lower()
        if not self.term.search(text):
            return []
        out = []
        for s in filter(self.term.search, _SENTENCE.findall(text)):
            forms = dict.fromkeys(self.term.sub(lambda m, n=n: n.get(m.group(), m.group()), s) for n in self.next)
            out += [(s, f) for f in forms if f != s]
        return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of lower-case texts, and the text of each; a feature may come more than once."""
    w = Words(pa.array(texts, pa.large_string()), _BETWEEN)
    size = w.end - w.start
    found, docs = [span_hashes(w.data, w.start, w.end)], [w.doc]
    for n in PREFIXES:
        long = np.flatnonzero(size > n)
        found.append(mix(span_hashes(w.data, w.start[long], w.start[long] + n) + np.uint64(n)))
        docs.append(w.doc[long])
    return np.concatenate(found), np.concatenate(docs)


def feature_sets(texts: list[str]) -> list[np.ndarray]:
    """Each text's distinct features."""
    if not texts:
        return []
    found, docs = features(texts)
    order = np.lexsort((found, docs))
    found, docs = found[order], docs[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (docs[1:] != docs[:-1])
    found, docs = found[new], docs[new]
    return np.split(found, np.searchsorted(docs, np.arange(1, len(texts))))


class Model:
    """Sorted feature hashes, their weights, and a bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def score(self, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.keys) and texts:
            found, docs = features(texts)
            some = np.flatnonzero(self.near[(found & np.uint64(0xFFFFF)).astype(np.int64)])
            found, docs = found[some], docs[some]
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            hit = self.keys[at] == found
            once = np.unique(docs[hit] * len(self.keys) + at[hit])  # a feature counts once in a text
            total += np.bincount(once // len(self.keys), self.weights[once % len(self.keys)], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def chosen(keys: np.ndarray, bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float) -> np.ndarray:
    """Of features with their numbers of documents of both classes: those that tell the classes apart, in order."""
    a, b, c, d = bad + 0.5, n_bad - bad + 0.5, good + 0.5, n_good - good + 0.5
    z = np.abs(np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    z[bad + good < LEAST_DOCS] = 0
    some = np.flatnonzero(z >= LEAST_Z)
    return np.sort(keys[some[np.lexsort((keys[some], -z[some]))][:FEATURES]])


def columns(sets: list[np.ndarray], keys: np.ndarray) -> list[np.ndarray]:
    """The places of each set's features among the sorted keys; other features are left out."""
    if not len(keys):
        return [np.empty(0, np.int32)] * len(sets)
    out = []
    for s in sets:
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        out.append(at[keys[at] == s].astype(np.int32))
    return out


def solve(keys: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The weights of keys; rows: columns() of each labelled text; pairs: columns() of a sentence and of a rewritten form of it."""
    k = len(keys)

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        """Which features each row has, and a last column of ones."""
        out = np.zeros((len(rows), k + 1))
        out[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.empty(0, np.int32)])] = 1
        out[:, k] = 1
        return out

    x = matrix(rows)
    # the penalty is quadratic in the weights: mean of (w . (x - x'))**2 over rewritten forms, times the number of documents
    pull = np.zeros((k + 1, k + 1))
    for i in range(0, len(pairs), 1024):
        gap = np.subtract(*(matrix([p[side] for p in pairs[i : i + 1024]]) for side in (0, 1)))
        pull += gap.T @ gap
    pull *= 2 * COUNTERFACTUAL * len(labels) / max(len(pairs), 1)
    pull[np.arange(k), np.arange(k)] += 2 * RIDGE
    pull[k, k] += 1e-9

    def loss(w: np.ndarray) -> float:
        s = x @ w
        return float(np.logaddexp(0, s).sum() - labels @ s + 0.5 * w @ pull @ w)

    def curvature(p: np.ndarray) -> np.ndarray:
        """x weighted by p (1 - p), times x, some rows at a time."""
        out = pull.copy()
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024]
            out += part.T @ (part * (p * (1 - p) + 1e-9)[i : i + 1024, None])
        return out

    w = np.zeros(k + 1)
    w[k] = np.log(labels.sum() / (len(labels) - labels.sum()))
    now = loss(w)
    for _ in range(STEPS):  # Newton's method with halved steps where a full one goes too far
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(curvature(p), x.T @ (p - labels) + pull @ w)
        size = 1.0
        while size > 1e-4 and (then := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - then < 1e-6 * max(1.0, now):
            break
        w, now = w - size * step, then
    return Model(keys, w[:k], float(w[k]))


def constant(mean: float) -> Model:
    """The model of a sample of one class, or of none."""
    return Model(np.empty(0, np.uint64), np.empty(0), 40.0 if mean == 1 else -40.0)


def fit(sets: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """sets: features of each labelled text; pairs: features of a sentence, and of a rewritten form of it. All in one place."""
    if not len(labels) or labels.min() == labels.max():
        return constant(float(labels.mean()) if len(labels) else 0.0)
    keys, column = np.unique(np.concatenate(sets), return_inverse=True)
    bad = np.bincount(column, np.repeat(labels, [len(s) for s in sets]), len(keys))
    keys = chosen(keys, bad, np.bincount(column, minlength=len(keys)) - bad, labels.sum(), len(labels) - labels.sum())
    return solve(keys, columns(sets, keys), labels, [tuple(columns([*p], keys)) for p in pairs])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, groups: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    """groups: names of groups of people whose sentences are swapped. Features are counted by the cluster; the driver gets
    the counts, and of each text the places of the chosen features."""
    sample = stored(training_rows(docs, labels, label, rows), "toxicity-sample")
    n = sample.agg(F.count(F.lit(1)).alias("all"), F.coalesce(F.sum("_label"), F.lit(0)).alias("bad")).first()
    if n.bad in (0, n["all"]):
        discard(sample)
        return constant(n.bad / max(n["all"], 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sets = feature_sets([(t or "").lower() for t in piece.column(2).to_pylist()])
                y = np.repeat(piece.column(1).to_numpy(zero_copy_only=False), [len(s) for s in sets])
                keys, column = np.unique(np.concatenate(sets), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(column, y, len(keys)).astype(np.int64)), pa.array(np.bincount(column, minlength=len(keys)))], ["key", "bad", "n"])

    counted = sample.mapInArrow(count, "key long, bad long, n long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= LEAST_DOCS).toArrow()
    key, bad, every = (found.column(c).to_numpy() for c in ("key", "bad", "n"))
    keys = chosen(key.view(np.uint64), bad.astype(np.float64), (every - bad).astype(np.float64), float(n.bad), float(n["all"] - n.bad))
    del found, key, bad, every

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swapper = Swapper(groups)
        for batch in batches:
            for piece in pieces(batch):
                texts = [(t or "").lower() for t in piece.column(2).to_pylist()]
                changes = [swapper.pairs(t) for t in texts]
                own = columns(feature_sets(texts), keys)
                flat = columns(feature_sets([*chain.from_iterable(chain.from_iterable(changes))]), keys) if any(changes) else []
                ends = np.cumsum([0, *(2 * len(c) for c in changes)]).tolist()
                nested = [[x.tolist() for x in flat[a:b]] for a, b in zip(ends, ends[1:], strict=False)]
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([x.tolist() for x in own], kind), pa.array(nested, pa.list_(kind))], ["doc_id", "_label", "own", "changes"])

    found = sample.mapInArrow(place, "doc_id long, _label int, own array<int>, changes array<array<int>>").toArrow().sort_by("doc_id")
    discard(sample)
    read = lambda x: np.array(x, np.int32)
    pairs = [(read(a), read(b)) for x in found.column("changes").to_pylist() for a, b in zip(x[::2], x[1::2], strict=True)]
    return solve(keys, [read(x) for x in found.column("own").to_pylist()], np.array(found.column("_label").to_pylist(), np.float64), pairs)


def score_documents(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the model's score."""
    keep = [c for c in docs.columns if c != score]
    schema = T.StructType([f for f in docs.schema if f.name in keep] + [T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for piece in pieces(batch, text):
                texts = [(t or "").lower() for t in piece.column(piece.schema.get_field_index(text)).to_pylist()]
                columns = {c: piece.column(piece.schema.get_field_index(c)) for c in keep}
                yield pa.RecordBatch.from_pydict(columns | {score: pa.array(own.score(texts))})

    return docs.select(*keep).mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
