import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from recordloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    ids = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def test_equals_the_library_on_odd_texts():
    rng = random.Random(7)
    parts = ["a", "b", "aaaa", "É", "é", "Σ", "İ", " ", "\t", "\n", "\x1c", "\x85", " ", " ", "中", "🙂", "12", "!", "<|endoftext|>", "'s", "'ll", "ß", "ſ", "Å", "<|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", " ", "x" * 4000, "ab" * 3000]
    own = bpe.WordEncoder(open(PATH, encoding="utf-8").read())
    ids, ends = own.ids(texts)
    want, decoded = library(texts)
    at = 0
    for end, w in zip(ends.tolist(), want, strict=True):
        assert ids[at:end].tolist() == w
        at = end
    assert [str(x, "utf-8") for x in own.as_tokens.join(ids, ends)] == decoded


def test_cache_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    own = bpe.WordEncoder(open(PATH, encoding="utf-8").read())
    for text in ("alpha beta gamma", "alpha delta", "beta beta"):
        assert own.ids([text])[0].tolist() == library([text])[0][0]


def test_documents(spark, odd, none):
    rows = bpe.encode_documents(odd, PATH, lists=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids, decoded = (x[0] for x in library([r.text or ""]))
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == decoded
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert {r.score for r in rows} >= {"x", "y", None}
    assert bpe.encode_documents(none, PATH).count() == 0


def test_query(spark, small):
    rows = {r.doc_id: r for r in bpe.op9_bpe(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    ids, decoded = library([d.text for d in docs])
    for d, i, x in zip(docs, ids, decoded, strict=True):
        assert rows[d.doc_id].n_tokens == len(i)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(x.encode()).hexdigest()
