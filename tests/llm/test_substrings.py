import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from recordloom.llm import substrings
from tests.llm.plain import cut


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    passages = [[rng.choice(words) for _ in range(rng.randint(5, 80))] for _ in range(6)]
    out = []
    for _ in range(n):
        t = []
        for _ in range(rng.randint(0, 5)):
            t += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(0, 30))]
        out.append(rng.choice([" ", "\n", "  \t"]).join(t))
    return out


def check(rows, want):
    assert len(rows) == len(want)
    for r, (kept, n) in zip(rows, want, strict=True):
        assert (r.n_words, r.n_removed) == (n, n - len(kept))
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


@pytest.mark.parametrize(("hot", "chunk", "window"), [(4096, 2 << 20, 13), (0, 600, 13), (1, 600, 7), (2, 600, 13), (0, 600, 3)])
def test_equals_brute_force(spark, monkeypatch, hot, chunk, window):
    monkeypatch.setattr(substrings, "HOT_CHUNKS", hot)  # 0, 1, 2: prefixes are lengthened
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)  # many chunks
    texts = corpus(hot + window)
    ids = random.Random(1).sample(range(-50, 1000), len(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_words int").repartition(3)
    rows = {r.doc_id: r for r in substrings.remove_repeats(df, window=window, spans=True).collect()}
    want = cut(list(zip(ids, texts, strict=True)), window)
    check([rows[i] for i in ids], want)
    for i, t, (kept, _) in zip(ids, texts, want, strict=True):
        w = t.split()
        assert [x for k, x in enumerate(w) if not any(s.start <= k < s.end for s in rows[i].removed)] == kept
        assert rows[i].text == (t if len(kept) == len(w) else " ".join(kept))


def test_odd_rows(spark, odd, none):
    extra = spark.createDataFrame([(50, " ".join(f"p{i}" for i in range(20)), "en", "a", 1, "q"), (40, " ".join(f"p{i}" for i in range(20)), "en", "a", 1, "q"), (None, " ".join(f"p{i}" for i in range(20)), "en", "a", 1, "q")], odd.schema)
    rows = substrings.remove_repeats(odd.unionByName(extra)).collect()
    n = {(r.doc_id, r.n_chars): r.n_removed for r in rows}
    assert len(rows) == odd.count() + 3
    assert n[50, 1] == 20 and n[40, 1] == 0 and n[None, 1] == 0
    assert sum(n.values()) == 20 and {r.text for r in rows if r.doc_id == 3} == {None}
    assert substrings.remove_repeats(none).count() == 0


def test_query_and_tree(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    rows = substrings.op6_substrings(spark, small).orderBy("doc_id").collect()
    check(rows, cut([(d.doc_id, d.text) for d in docs]))


def test_subtree_has_the_nodes_of_a_plain_one():
    rng = random.Random(2)
    contexts = [[rng.randint(0, 2) for _ in range(rng.randint(3, 9))] for _ in range(200)]
    window = 3
    numbers = np.array([x for c in contexts for x in c], np.int64)
    first = np.cumsum([0, *(len(c) for c in contexts)])
    suffixes = [(int(first[i]) + k, int(first[i + 1]), tuple(c[k:])) for i, c in enumerate(contexts) for k in range(len(c) - window + 1)]
    start, end = (np.array([x[i] for x in suffixes]) for i in range(2))
    tree = substrings.Subtree(numbers, start, end, window)
    by = {}
    for i, (_, _, words) in enumerate(suffixes):
        by.setdefault(words[:window], []).append(i)
    assert sorted(map(sorted, by.values())) == sorted(sorted(np.flatnonzero(tree.node == n).tolist()) for n in range(len(tree.depth)))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for a, b, c in zip(tree.order, tree.order[1:], tree.common[1:], strict=False):
        k = common(suffixes[a][2], suffixes[b][2])
        assert c == (k if k >= window else 0)
    ids = np.array([rng.randint(0, 50) for _ in suffixes])
    assert all(o == min(ids[j] for j in by[s[2][:window]]) for o, s in zip(tree.owners(ids), suffixes, strict=True))


def test_words_are_compared_as_they_are():
    docs = pa.table({"doc_id": pa.array([1, 2, 3, 4]), "text": [" ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30)), " ".join([*(f"a{i}" for i in range(5, 25)), "x"]), " ".join(f"b{i}" for i in range(30))]})
    c = substrings.Chunk(docs, "text", "doc_id", 13)
    assert c.same(np.array([0, 0]), np.array([60, 5]), np.array([13, 13])).tolist() == [False, False]
    assert c.same(np.array([5, 30, 5]), np.array([60, 81, 60]), np.array([20, 30, 21])).tolist() == [True, True, False]


def test_removed_ranges_are_maximal(spark):
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, " ".join(["x", *passage, "y"])), (2, " ".join(["q", "r", *passage, "z"])), (3, " ".join(passage[10:40]))]
    got = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), spans=True).collect()}
    assert got == {1: [], 2: [(2, 62)], 3: [(0, 30)]}
