"""Exact dedup: a persistent digest index bucketed and sorted by hash.

New rows are digested, reduced to one row a digest (partial aggregation, so a hot digest shrinks before
the shuffle), sort-merge anti-joined with the index, and the digests that are new are appended.

Defined results: a null text counts as empty; a null doc_id never becomes a keeper unless its whole
group has none (then keep_id is null and the rows stay); rows repeated with the same doc_id and text are
one document and share its decision, each counted in group_size; other columns are ignored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import documents, lookup, prepare, stored, texts
from bazaarlake.llm.digest_store import DigestStore, buckets_for, digest_of

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text) -> F.Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, SPACE, " ")


class ExactDedup:
    """Deduplicates batches against all earlier ones; `location` keeps the index between sessions."""

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int = 64):
        self.index = DigestStore(spark, "keep_id BIGINT, batch STRING", location, buckets)

    def ingest(self, docs: DataFrame) -> DataFrame:
        """One row per row of docs: doc_id, digest, keep_id (the row that stays, of this batch or an
        earlier one), group_size (rows of this batch with the text)."""
        hashed = stored(texts(docs).select("doc_id", digest_of(normalised(F.col("text"))).alias("digest")), "exact-hashes")
        groups = stored(hashed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "exact-groups")
        fresh = self.index.missing(groups.select("digest", F.col("first_id").alias("keep_id")))
        self.index.append(fresh.withColumn("batch", F.lit(uuid.uuid4().hex)))
        total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        owners = groups.select("digest", "group_size").join(self.index.rows().groupBy("digest").agg(F.min("keep_id").alias("keep_id")), "digest")
        return lookup(hashed, owners, "digest", "group_size", total)


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: every document with its keeper, group size and digest."""
    prepare(spark)
    docs = documents(spark, sf_dir)
    found = ExactDedup(spark, buckets=buckets_for(docs)).ingest(docs)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


EXACT_DEDUP_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
