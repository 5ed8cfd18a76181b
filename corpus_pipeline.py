"""The training-data pipeline: documents in, packed sequences out.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return
the columns of documents, whatever they are. toxicity drops the documents that score 0.5 or more; line
dedup drops lines that a document with a smaller doc_id holds; near-dedup keeps one document of each
near-duplicate component; the secret scan masks live-looking credentials in the text and keeps every
document (who holds a value is counted over all documents, copies that earlier stages dropped included, so a
published example doesn't look live for having been deduplicated); packing returns each piece's place. Nulls, empty texts and empty tables are as each operator's
module says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bazaarlake.llm import line_dedup, minhash_dedup, packing, secret_scan, toxicity
from bazaarlake.llm.common import documents, prepare, stored, texts


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.keep_clean(docs, toxicity.fit(texts(docs), toxicity.labels_of(spark, sf_dir)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return line_dedup.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return minhash_dedup.clean(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return secret_scan.redact(docs, corpus=documents(spark, sf_dir))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: A learned score, min-hash components and a packing plan have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
