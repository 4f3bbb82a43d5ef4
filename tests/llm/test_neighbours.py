import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import neighbours


def exact(rows, asks, k):
    sound = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            sound[i] = np.array(v, float)
    out = {}
    for q in asks:
        if q in sound:
            s = [(-float(sound[q] @ v / (np.linalg.norm(sound[q]) * np.linalg.norm(v))), i) for i, v in sound.items() if i != q]
            out[q] = sorted(s)[:k]
    return out


def test_probe_order_by_estimated_success():
    index = neighbours.Index(4, 2, 1.0)
    place = np.array([[3.1, -2.2], [0.5, 7.9]])
    names = index.probe_names(place, 9)
    for row, at in zip(names, place, strict=True):
        inside = at - np.floor(at)
        cost = {}
        for delta in index.deltas:
            cost[int(index.names(np.floor(at).astype(np.int64) + delta))] = sum(((x if d < 0 else 1 - x) ** 2) if d else 0 for x, d in zip(inside, delta, strict=True))
        assert len(set(row.tolist())) == 9 and row[0] == index.names(np.floor(at).astype(np.int64))
        assert [cost[b] for b in row.tolist()] == sorted(cost.values())
    assert len(neighbours.perturbations(5)) == 243 and len(neighbours.perturbations(12)) <= neighbours.MOST_PROBES
    assert [neighbours.functions_for(n) for n in (10, 51_282, 10**9)] == [2, 5, 12]


def test_far_queries_and_large_values(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal(16)
    near = [(i, (base + 0.01 * rng.standard_normal(16)).tolist()) for i in range(300)]
    odd = [(1000, (-base).tolist()), (1001, (base * 1e200).tolist()), (1002, (base * 1e-200).tolist()), (1003, (-base * 1e300).tolist())]
    df = spark.createDataFrame(near + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got = {}
    for r in neighbours.search(df, df.where("vec_id >= 1000"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact([(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in near + odd], [i for i, _ in odd], 5)
    assert set(got) == set(want)
    for q, best in want.items():
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert np.allclose([s for _, _, s in own], [-s for s, _ in best], atol=1e-12)


def test_several_lengths_are_an_error(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)] + [(50, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="lengths"):
        neighbours.search(df, df, 3)


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(400)] + [(1000 + i, [1.0, 1.0, 1.0, 1.0 + i * 1e-3]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), 4, target=1.0).collect()
    want = exact(rows, [i for i, _ in rows if i % 20 == 0], 4)
    hits = sum((r.vec_id in [i for _, i in want[r.query_id]]) for r in got)
    assert len(got) == 4 * len(want) and hits >= 0.9 * len(got)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    same = [float(x) for x in rng.standard_normal(8)]
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(60)]
    rows += [(100 + i, same) for i in range(40)] + [(100, same)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] + [1.0] * 7), (204, [float("inf")] + [0.0] * 7), (None, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id % 10 = 0"), 5, target=1.0).collect()
    want = exact(rows, [i for i, _ in rows if i is not None and i % 10 == 0], 5)
    assert {r.query_id for r in got} == set(want)
    found = total = 0
    for q, best in want.items():
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [o[0] for o in own] == list(range(1, len(own) + 1)) and all(-1 <= o[2] <= 1 for o in own)
        found += len({o[1] for o in own} & {i for _, i in best})
        total += len(best)
    assert found / total >= 0.9
    copies = sorted((r.rank, r.vec_id) for r in got if r.query_id == 100)
    assert [i for _, i in copies] == [101, 102, 103, 104, 105]  # ties to smaller ids


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.search(few, few.where("vec_id = 0"), 5).collect()] == [(0, 1, 1)]
    assert neighbours.search(few.where("false"), few.where("false"), 5).count() == 0


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = neighbours.op3_neighbours(spark, d).collect()
    want = exact(rows, [i for i, _ in rows if i % 50 == 0], 5)
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = sum(i in by.get(q, {}) for q, best in want.items() for _, i in best)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, best in want.items():
        for s, i in best:
            if i in by[q]:
                assert abs(by[q][i] + s) < 1e-12
