import zlib

import numpy as np
import pyarrow as pa

from recordloom.llm import quality, toxicity
from recordloom.llm.common import training_rows


def test_words_and_prefixes_as_by_hand():
    texts = ["loser, Ünder 12", "", "losers"]
    sets = toxicity.feature_sets([t.lower() for t in texts])
    assert len(sets) == 3 and len(sets[1]) == 0
    # loser (word, 4 letters), ünder (word, prefixes of 4 and 5 bytes), 12 (word)
    assert len(sets[0]) == 2 + 3 + 1
    assert len(sets[2]) == 3 and len(np.intersect1d(sets[0], sets[2])) == 1


def test_identity_terms_are_swapped_in_their_sentences():
    swap = toxicity.Swapper()
    s = "the muslim family moved in."
    assert swap.pairs("They like tea. " + s.capitalize()) == [(" " + s, " the jewish family moved in."), (" " + s, " the hindu family moved in.")]
    assert [a for a, _ in swap.pairs("A woman. A man! No one.")] == ["a woman.", " a man!"]
    assert swap.pairs("No group here. Amuslimb.") == []
    assert toxicity.Swapper((("red", "blue"),)).pairs("A red car, a muslim.") == [("a red car, a muslim.", "a blue car, a muslim.")]
    assert toxicity.Swapper(()).pairs("a muslim") == []


def biased():
    """Labels that go with insults, in a sample where one group is named mostly in insulting texts."""
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        bad = i % 2
        t = " ".join(rng.choice(words, 30))
        if bad and rng.random() < 0.8:
            t += " you idiot"
        if rng.random() < (0.9 if bad else 0.05):
            t += ". the muslim family"
        elif rng.random() < 0.5:
            t += ". the jewish family"
        texts.append(t)
        labels.append(bad)
    return texts, np.array(labels, float)


def trained(texts, labels, monkeypatch, weight):
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", weight)
    swap = toxicity.Swapper()
    pairs = [tuple(toxicity.feature_sets([*p])) for t in texts for p in swap.pairs(t)]
    return toxicity.fit(toxicity.feature_sets(texts), labels, pairs)


def test_penalty_reduces_the_gap_between_groups(monkeypatch):
    texts, labels = biased()
    probe = ["a muslim neighbour came by", "a hindu neighbour came by"]
    plain, fair = (trained(texts, labels, monkeypatch, w).score(probe) for w in (0.0, 1.0))
    assert plain[0] - plain[1] > 0.2
    assert abs(fair[0] - fair[1]) < 0.5 * (plain[0] - plain[1])
    assert trained(texts, labels, monkeypatch, 1.0).score(["you idiot idiot"])[0] > 0.5


def test_without_labels_or_with_one_class(spark, odd, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for m in (toxicity, quality):
        model = m.train(odd.select("doc_id", "text"), no_labels)
        rows = m.score_documents(odd, model).collect()
        assert len(rows) == odd.count() and all(r.score < 0.01 for r in rows)
        assert m.score_documents(none, model).count() == 0
    one = spark.createDataFrame([(1, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.99 for r in toxicity.score_documents(odd, toxicity.train(odd, one)).collect())
    assert all(r.score > 0.99 for r in quality.score_documents(odd, quality.train(odd, one)).collect())


def test_sample_is_bounded_and_never_held_out(spark):
    ids = [*range(500)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(7, "second text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1), (9, 0), (11, None), (12, 5)], "doc_id long, toxic int")
    rows = training_rows(docs, labels, "toxic", 100).collect()
    assert len(rows) == 100 and len({r.doc_id for r in rows}) == 100
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
    assert 9 not in {r.doc_id for r in training_rows(docs, labels, "toxic", 1000).collect()}  # labelled both ways


def check(rows, labels, column, threshold, least):
    known = {r.doc_id: r[column] for r in labels.collect()}
    assert len(rows) == len({r.doc_id for r in rows})
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    good = [np.mean([r.predicted == known[r.doc_id] for r in held if known[r.doc_id] == c]) for c in (0, 1)]
    assert np.mean(good) >= least, good


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    check(toxicity.op1_toxicity(spark, d).collect(), labels, "toxic", 0.5, 0.92)
    check(quality.op8_quality(spark, d).collect(), labels, "quality", 0.3, 0.97)


def test_model_round_trip_equals_plain_sum():
    texts, labels = biased()
    model = toxicity.fit(toxicity.feature_sets(texts), labels, [])
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    want = [model.bias + sum(weight.get(int(f), 0.0) for f in s) for s in toxicity.feature_sets(texts[:50])]
    assert np.allclose(model.score(texts[:50]), 1 / (1 + np.exp(-np.array(want))))


def test_votes_equal_brute_force():
    rng = np.random.default_rng(2)
    texts = pa.array([" ".join(rng.choice(["Good", "text", "BAD!!", "x|y", "12", "aa"], rng.integers(3, 40))) for _ in range(120)] + [None, "", "aa aa aa"], pa.large_string())
    labels = rng.integers(0, 2, len(texts)).astype(float)
    model = quality.fit(quality.term_shares(texts), labels)
    got = model.score(texts)
    z = model.latent(quality.term_shares(texts))
    for i in range(len(texts)):
        cos = np.round(z[i] @ model.vectors.T, 12)
        near = sorted(range(len(labels)), key=lambda j: (-cos[j], j))[: quality.NEIGHBOURS]
        w = np.maximum(cos[near], 0) ** quality.SHARPNESS
        want = (w @ labels[near]) / w.sum() if w.sum() > 0 else labels.mean()
        assert abs(got[i] - want) < 1e-9


def test_fit_is_the_least_of_the_plain_objective():
    """Loss written again in plain Python; no small step in any of many directions makes it smaller."""
    texts, labels = biased()
    sets = toxicity.feature_sets(texts)
    swap = toxicity.Swapper()
    pairs = [tuple(toxicity.feature_sets([*p])) for t in texts for p in swap.pairs(t)]
    model = toxicity.fit(sets, labels, pairs)
    keys = model.keys.tolist()
    rows = [sorted(set(s.tolist()) & set(keys)) for s in sets]
    changes = [(set(a.tolist()) & set(keys), set(b.tolist()) & set(keys)) for a, b in pairs]

    def loss(weights, bias):
        w = dict(zip(keys, weights, strict=True))
        out = 0.0
        for r, y in zip(rows, labels, strict=True):
            s = bias + sum(w[k] for k in r)
            out += np.logaddexp(0, s) - y * s
        gap = sum((sum(w[k] for k in a) - sum(w[k] for k in b)) ** 2 for a, b in changes) / len(changes) * len(labels)
        return out + toxicity.RIDGE * sum(x * x for x in weights) + toxicity.COUNTERFACTUAL * gap

    least = loss(model.weights, model.bias)
    rng = np.random.default_rng(0)
    for size in (1e-2, 1e-1):
        for _ in range(8):
            step = rng.standard_normal(len(keys)) * size / np.sqrt(len(keys))
            assert loss(model.weights + step, model.bias) > least - 1e-3
            assert loss(model.weights - step, model.bias + size) > least - 1e-3


def test_neutral_mentions_through_the_query(spark, tmp_path, monkeypatch):
    """A table in which one group is named mostly in toxic texts: with the penalty fewer neutral mentions of it are flagged."""
    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(3000):
        bad = i % 2
        text = " ".join(rng.choice(words, 12))
        if bad and rng.random() < 0.7:
            text += " you idiot"
        if rng.random() < (0.9 if bad else 0.03):
            text += ". The muslim family."
        elif rng.random() < 0.6:
            text += ". The jewish family."
        docs.append((i, text))
        labels.append((i, 0, bad))
    neutral = [(10_000 + i, " ".join(rng.choice(words, 12)) + ". The muslim family.") for i in range(200)]
    spark.createDataFrame(docs + neutral, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    flagged, insults = {}, {}
    for weight in (0.0, 1.0):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", weight)
        rows = {r.doc_id: r for r in toxicity.op1_toxicity(spark, str(tmp_path)).collect()}
        flagged[weight] = np.mean([rows[i].predicted for i, _ in neutral])
        insults[weight] = np.mean([rows[i].predicted for i, t in docs if "idiot" in t])
    assert flagged[0.0] > 0.8 and flagged[1.0] < 0.5 * flagged[0.0]
    assert insults[1.0] > 0.95
