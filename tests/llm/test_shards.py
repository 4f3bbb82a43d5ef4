import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from recordloom.llm import shards

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("ids", [[], [1], [5] * 1000, [1, 2] * 500, [*range(70000)] * 2, [1, 1, 2, 1, 1, 2, 1] * 99])
def test_grammar_shards(ids):
    ids = np.array(ids, np.uint32)
    shard = shards.Shard(shards.compress(ids))
    assert (shard.ids() == ids).all() and shard.n_ids == len(ids)
    for a, b in ((0, 1), (3, 9), (len(ids) // 2, len(ids)), (5, 5), (len(ids), len(ids) + 4)):
        assert (shard.ids(a, b) == ids[a:b]).all()


def test_repeats_get_smaller():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 50000, 40)
    ids = np.concatenate([np.concatenate([phrase, rng.integers(0, 50000, 5)]) for _ in range(400)]).astype(np.uint32)
    assert len(shards.compress(ids)) < 2 * len(ids) * 0.6


def test_rules_are_made_until_no_pair_is_frequent():
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 30000, 600)
    noise = [rng.integers(0, 30000, 13_000) for _ in range(12)]
    ids = np.concatenate([x for part in noise for x in (phrase, part)] + [np.full(64, 7)]).astype(np.uint32)
    shard = shards.Shard(shards.compress(ids))
    assert (shard.ids() == ids).all()
    assert shard.lengths.max() > 500
    _, count = np.unique((shard.sequence[:-1] << 32) | shard.sequence[1:], return_counts=True)
    assert count.max() < shards.MIN_COUNT


def test_pieces_equal_the_library():
    rng = random.Random(3)
    parts = ["a", "b", "É", " ", "  ", "\t", "\n", "\x1c", "\x85", " ", " ", "\0", "中", "🙂", "12", "!", "<|endoftext|>", "'s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["", " ", "x " * 5000]
    own = shards.PieceEncoder(open(PATH, encoding="utf-8").read())
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        ids, n = own.ids(pa.array(texts, pa.large_string()))
        at = 0
        for k, w in zip(n.tolist(), want, strict=True):
            assert ids[at : at + k].tolist() == w
            at += k


def test_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(shards, "KEPT_IDS", 20)
    own = shards.PieceEncoder(open(PATH, encoding="utf-8").read())
    t = Tokenizer.from_file(PATH)
    for text in ("alpha beta gamma delta epsilon", "alpha zeta eta theta iota kappa", "beta beta alpha"):
        assert own.ids(pa.array([text]))[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_documents(spark, odd, none):
    rows = shards.read_shards(shards.write_shards(odd, PATH, shard_ids=64)).collect()
    t = Tokenizer.from_file(PATH)
    docs = sorted(((d.doc_id is not None, d.doc_id or 0, d.text is not None, d.text or "") for d in odd.collect()))
    at = 0
    assert len(rows) == len(docs)
    for r, (known, key, _, text) in zip(sorted(rows, key=lambda r: r.start), docs, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (key if known else None, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert shards.read_shards(shards.write_shards(none, PATH)).count() == 0


def test_query(spark, small):
    rows = shards.op7_shards(spark, small).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    want = [[*e.ids, 2] for e in Tokenizer.from_file(PATH).encode_batch([d.text for d in docs], add_special_tokens=False)]
    at = 0
    for r, d, ids in zip(rows, docs, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
