import random

import numpy as np
import pyarrow as pa
import pytest

from recordloom.llm import common, jaccard
from recordloom.llm.components import components
from tests.llm.plain import near, shingles


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(500, 500)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def variants(seed=0, groups=12):
    """Groups of texts with a few words changed, texts that share a long passage, and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(6, 200))]
        for _ in range(rng.randint(1, 9)):
            t = base[:]
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
        if g % 3 == 0:
            out.append(" ".join(passage + [word() for _ in range(60)]))
            out.append(out[-2])
    out += ["", "  ", "one two", "one two", "one two three", "a b c d e", "a b c d e f"]
    rng.shuffle(out)
    return out


def equals_plain(spark, texts):
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
    rows = jaccard.near_duplicates(df).orderBy("doc_id").collect()
    links, groups = near(texts)
    assert [r.doc_id for r in rows] == [*range(len(texts))]
    assert [r.n_links for r in rows] == links
    assert [r.class_id for r in rows] == groups
    assert [r.first_of_class for r in rows] == [i == g for i, g in enumerate(groups)]


@pytest.mark.parametrize(("leaf", "part", "block"), [(32, 1 << 15, 128), (2, 1 << 15, 3), (2, 4, 3)])
def test_equals_brute_force(spark, monkeypatch, leaf, part, block):
    monkeypatch.setattr(jaccard, "LEAF", leaf)  # 2: nearly all buckets are split again
    monkeypatch.setattr(jaccard, "PART", part)  # 4: in several parts
    monkeypatch.setattr(jaccard, "BLOCK", block)  # 3: most components are compared by differences
    monkeypatch.setattr(jaccard, "DIFF_BLOCK", 4)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    equals_plain(spark, variants())


def template_copies(n=400, words=120, edits=4):
    """Near copies of one template, some of them linked whatever they share and some not, and some edited alike."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        t = base[:]
        for _ in range(rng.randint(0, edits)):
            t[rng.choice([7, words // 2, words - 9]) if rng.random() < 0.3 else rng.randrange(words)] = f"x{rng.randrange(4)}"
        if i % 7 == 0:
            t = t[: rng.randint(words * 3 // 4, words)]
        out.append(" ".join(t))
    return out


def test_one_large_group_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "DIFF_BLOCK", 64)
    equals_plain(spark, template_copies())


def bucket_rows(texts):
    """Rows of a bucket whose first token all sketches have, and the sketches."""
    sketches = [np.concatenate([np.zeros(1, np.uint32), np.sort((jaccard.shingle_sets(pa.array([t]))[0] >> np.uint64(32)).astype(np.uint32))[: jaccard.SKETCH - 1]]) for t in texts]
    bucket = jaccard.path_hash(np.full(1, 1, np.uint64), np.zeros(1, np.uint64)).view(np.int64)[0]
    n = len(sketches)
    columns = {"rid": pa.array(range(n), pa.int64()), "bucket": pa.array([bucket] * n), "path": pa.nulls(n, pa.list_(pa.int64())), "loose": pa.array([True] * n), "sketch": pa.array([x.tobytes() for x in sketches])}
    return pa.table(columns), jaccard.padded(*jaccard.flat(columns["sketch"]))


@pytest.mark.parametrize("comparisons", [1 << 18, 1 << 12])
def test_links_of_a_bucket_grow_with_its_sets(monkeypatch, comparisons):
    """Sets on the edges of many groups, as copies with many edits are: a tree of links, which joins all similar sets."""
    monkeypatch.setattr(jaccard, "COMPARISONS", comparisons)
    for n in (250, 500):
        rows, sketch = bucket_rows(template_copies(n, 50, 5))
        out = [b for b in jaccard._split(jaccard.RUNS)((), rows)]
        assert sum(b.num_rows for b in out) < n
        low = np.arange(n)
        for b in out:
            low = jaccard._spread(n, np.concatenate([low, b.column("a").to_numpy()]), np.concatenate([np.arange(n), b.column("b").to_numpy()]))
        i, j = np.triu_indices(n, 1)
        near = jaccard.share(sketch[i], sketch[j])
        assert (low[i] == low[j])[near >= 0.8].all()
        whole = jaccard._spread(n, i[near >= jaccard.SKETCH_SHARE], j[near >= jaccard.SKETCH_SHARE])
        assert (whole[low] == whole).all()


def test_bins_decide_rightly():
    texts = template_copies(60, 40, 3)
    sets = [shingles(t) for t in texts]
    base, step = sets[0], 2
    up = lambda x: -(-x // step) * step
    size, lacks = np.array([up(len(s)) for s in sets]), np.array([up(len(base - s)) for s in sets])
    yes, no = jaccard.decided(len(base), step, size, lacks, size, lacks, 0.8)
    assert yes.any() and no.any()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            linked = len(x & y) / len(x | y) >= 0.8
            assert linked if yes[i, j] else not (linked and no[i, j])


def test_odd_rows(spark, odd, none):
    rows = jaccard.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and "score" in rows[0].asDict()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.class_id, r.n_links, r.n_copies) for r in by[1]] == [(1, 2, 2)] * 2 and sum(r.first_of_class for r in by[1]) == 1
    assert (by[None][0].class_id, by[None][0].first_of_class) == (1, False)
    assert all((by[i][0].class_id, by[i][0].n_links) == (i, 0) for i in (2, 3, 4, 5, 6))
    assert jaccard.near_duplicates(none).count() == 0


def test_runs_reach_the_target():
    """Pairs at the threshold that share a path of so many tokens in some run, counted on drawn sketches."""
    rng = np.random.default_rng(3)
    trials, k = 3000, jaccard.SKETCH
    common_tokens = round(k * jaccard.SIMILARITY)
    tokens = rng.integers(0, 1 << 32, (trials, common_tokens)).astype(np.uint64).ravel()
    sizes = np.full(trials, common_tokens)
    hit = np.zeros(trials, bool)
    for r in range(jaccard.RUNS):
        before = np.full(trials, r + 1, np.uint64)
        owner = np.arange(trials)
        for depth in range(jaccard.DEPTH):
            at = jaccard.segments(owner * common_tokens, sizes[owner])
            path, own = np.repeat(before, sizes[owner]), np.repeat(owner, sizes[owner])
            seed = jaccard.mix(path * jaccard._STEP) if depth == 0 else jaccard.mix(path + jaccard._STEP)
            chosen = jaccard._chosen(jaccard.mix(tokens[at] ^ seed), np.full(len(at), k))
            before, owner = jaccard.path_hash(path[chosen], tokens[at][chosen]), own[chosen]
        hit[owner] = True
    assert jaccard.RUNS == jaccard.runs_for(0.8) and hit.mean() >= 0.999


def test_query(spark, small):
    rows = jaccard.op2_jaccard(spark, small).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    links, groups = near([d.text for d in docs])
    assert [r.n_links for r in rows] == links
    assert [r.class_id for r in rows] == [docs[g].doc_id for g in groups]


def test_sql(spark, small):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = sorted(duckdb.sql(jaccard.OP2_SQL).fetchall())
    assert sorted(tuple(r) for r in jaccard.op2_jaccard(spark, small).collect()) == want


def test_names_that_clash(spark):
    names = ["links", "copies", "first_id", "rid", "_rid", "_maybe", "_word", "n", "root"]
    df = spark.createDataFrame([(1, "a b c d e f", *["x"] * len(names)), (2, "a b c d e f", *["y"] * len(names)), (3, "other words", *["z"] * len(names))], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    rows = jaccard.near_duplicates(df).orderBy("doc_id").collect()
    assert [(r.class_id, r.n_links, r.links, r.copies, r.first_id, r.root) for r in rows] == [(1, 1, *["x"] * 4), (1, 1, *["y"] * 4), (3, 0, *["z"] * 4)]
    assert "_rid" not in rows[0].asDict()
