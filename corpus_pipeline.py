"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

toxicity    documents that the classifier rejects go
near        of each group of near duplicates the document with the smallest id stays
substrings  passages of 13 words or more that a document with a smaller id has go
mixing      documents are repeated by their source's rate and shuffled globally
bpe         each remaining row's ids, as number and digests
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import bpe, jaccard, mixing, substrings, toxicity
from recordloom.llm.common import discard, stored, table, temporary_tables

#: Documents with this score or more are rejected.
TOXIC = 0.5


#: The columns that stages read; others are carried under names that clash with nothing.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def carried(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work() on docs, whose further columns come back with their own names and values."""
    named = {c: f"_carried_{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
    out = work(docs.withColumnsRenamed(named))
    return out.select(*[F.col(named.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learned from the labels that are not held out, is below TOXIC."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return carried(docs, lambda df: toxicity.score_documents(df, model, score="_toxicity").where(F.col("_toxicity") < TOXIC))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    return carried(docs, lambda df: jaccard.near_duplicates(df).where("first_of_class"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages that one with a smaller id has; n_chars follows the text."""

    def work(df: DataFrame) -> DataFrame:
        out = substrings.remove_repeats(df)
        if "n_chars" not in df.columns:
            return out
        return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))

    return carried(docs, work)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as its source's rate and its id's hash say, in global random order."""
    return carried(docs, mixing.mix_sources)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE ids of every row's whole text, as number and digests, in place of the text."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near", drop_near), ("substrings", cut_repeats), ("mixing", mix), ("bpe", encode)]

#: A trained classifier and the tokenizer have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with temporary_tables(spark) as kept:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs)
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
