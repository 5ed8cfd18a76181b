"""Token counts with a digest cache.

The cache maps (content digest, tokenizer-version digest) to a count. A batch is digested, reduced to its
distinct contents, anti-joined with the cache; only the distinct misses are encoded and their counts
appended; then every row looks its count up. The normal form of a content is the text itself (null as
empty): byte-level BPE is sensitive to every byte, so nothing coarser keeps the counts exact.

Defined results: a null or empty text has 0 tokens; rows with a null or repeated doc_id are counted like
any other; other columns are ignored. Texts of any length are encoded whole."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import arrow_map, documents, lookup, prepare, stored, texts, utf8_list
from bazaarlake.llm.digest_store import DigestStore, buckets_for, digest_of

LIMIT = 1024
VERSION = "1"  # of the way texts are encoded here; part of the tokenizer digest
#: Above these ranges the libraries' Unicode tables might differ, so such texts go the slow way.
_RARE = re.compile("[^\\x00-ɏ‐-‧€]")


def default_files() -> tuple[str, str]:
    """The tokenizer file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer_digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.sha256(VERSION.encode() + b"\0" + f.read()).digest()


@lru_cache(maxsize=2)
def counter(path: str, ranks_path: str | None):
    """text -> number of tokens, as the tokenizers library gives for the file at path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.no_truncation()
    slow.no_padding()

    def exact(text: str) -> int:
        return len(slow.encode(text, add_special_tokens=False).ids)

    if not ranks_path:
        return exact
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def count(text: str) -> int:
        if _RARE.search(text) or any(s in text for s in special):
            return exact(text)
        try:
            return len(fast.encode_ordinary(text))
        except BaseException as e:  # the Rust side panics on some extreme runs; those are counted by the other library
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return exact(text)

    return count


class TokenCounter:
    """Counts tokens of batches through a cache that persists at `location`."""

    def __init__(self, spark: SparkSession, path: str, ranks_path: str | None = None, location: str | None = None, buckets: int = 64):
        self.path, self.ranks_path, self.version = path, ranks_path, tokenizer_digest(path)
        self.cache = DigestStore(spark, "tokenizer BINARY, n_tokens BIGINT", location, buckets)

    def count(self, docs: DataFrame) -> DataFrame:
        """One row per row of docs: doc_id, n_bytes, digest, n_tokens."""
        source, version = texts(docs), F.lit(bytearray(self.version))
        hashed = stored(source.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest_of("text").alias("digest")), "token-hashes")
        groups = stored(hashed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).withColumn("tokenizer", version), "token-groups")
        misses = self.cache.missing(groups, "tokenizer").select("digest", "rep")
        # A miss is encoded where its representative row lands.
        wanted = source.join(misses, source["doc_id"].eqNullSafe(misses["rep"])).filter(digest_of("text") == F.col("digest")).select("digest", "text")
        path, ranks_path = self.path, self.ranks_path

        def make():
            count = counter(path, ranks_path)
            return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t.decode()) for t in utf8_list(batch)], pa.int64())], ["digest", "n_tokens"])

        encoded = arrow_map(wanted, "digest binary, n_tokens long", make)
        self.cache.append(encoded.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).withColumn("tokenizer", version))
        total = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        known = groups.select("digest", "rows").join(self.cache.rows().filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "digest")
        return lookup(hashed, known, "digest", "rows", total).drop("rows")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2: token counts of all documents."""
    prepare(spark)
    docs = documents(spark, sf_dir)
    counted = TokenCounter(spark, *default_files(), buckets=buckets_for(docs)).count(docs)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
