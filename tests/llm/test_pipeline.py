from collections import Counter
from hashlib import sha256

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from recordloom.llm import toxicity
from tests.llm.plain import copies, cut, near


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near", "substrings", "mixing", "bpe"]


def test_equals_a_plain_version(spark, small):
    """All stages but the classifier's scores are done again in plain Python."""
    table = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{small}/labels.parquet"))
    docs = table.orderBy("doc_id").collect()
    docs = [d for d in docs if model.score([d.text.lower()])[0] < corpus_pipeline.TOXIC]
    _, groups = near([d.text for d in docs])
    docs = [d for i, d in enumerate(docs) if groups[i] == i]
    kept = cut([(d.doc_id, d.text) for d in docs])
    texts = [d.text if len(k) == n else " ".join(k) for d, (k, n) in zip(docs, kept, strict=True)]
    times = copies([(d.doc_id, d.source) for d in docs])
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, x, n, e in zip(docs, texts, times, t.encode_batch(texts, add_special_tokens=False), strict=True):
        if n:
            want[d.doc_id, len(x), len(e.ids), sha256(" ".join(map(str, e.ids)).encode()).hexdigest()] += n
    got = Counter((r.doc_id, r.n_chars, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, small).collect())
    assert got == want


def test_stages_take_odd_rows(spark, odd, none, small):
    for rows in (odd, none):
        docs = rows.select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("n_words"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, small)
            if name == "bpe":
                assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
                out.count()
            else:
                assert out.dtypes == docs.dtypes
                assert {r.n_words for r in out.collect()} <= {1}
                assert out.count() <= 3 * max(1, docs.count())
