"""A stored, maintained inverted index of products, and ranked search that skips blocks of it.

Products are cut into ranges of RANGE ids. A row of the index is a term in a field in a range: its products with
their positions, how many they are, and the most often one of them has the term. Rows are sorted by term, so a query reads
those of its terms, and by range, so that the greatest score a range could give is known from the small columns alone.

An upsert writes the changed products as a segment of its own and marks their former versions as gone; nothing else is
rewritten. When FANOUT segments of a level have come together they are merged into one of the next level, without what is gone.
One line of a log names the segments, the marks and the corpus counts after each change: readers see a change whole
or not at all. One writer at a time.

Null fields and products without words are kept as members of length 0; an id that is deleted but unknown changes
nothing; of several rows with one product_id in an upsert any one counts, so callers bring one."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.operators import bm25
from bazaarlake.sources.tables import stored

RANGE, FANOUT, SEED_RANGES = 1024, 4, 8
TASK_PRODUCTS = 8 * RANGE  # of a task that builds rows
LOG = "version long, segments array<struct<folder: string, level: int>>, gone array<string>, docs long, words long"
TEXTS = ["title", "title_raw", "brand", "model", "mpn"]  # what the substring search looks at
ROW = "version long, block long, term string, field string, postings array<struct<product_id: long, positions: array<int>>>, n int, most int"
MEMBER = "version long, block long, product_id long, len long, " + ", ".join(f"{c} string" for c in TEXTS)
AT = ["version", "block"]


class TextIndex:
    """The index at `location`, which any session may open."""

    def __init__(self, spark: SparkSession, location: str, fanout: int = FANOUT):
        self.spark, self.location, self.fanout = spark, location.rstrip("/"), fanout

    def state(self):
        """The newest line of the log; None for an index that was never written."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.location}/log").agg(F.max(F.struct("version", "segments", "gone", "docs", "words")).alias("s")).first()["s"]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _commit(self, version: int, segments: list[tuple[str, int]], gone: list[str], docs: int, words: int) -> None:
        self.spark.createDataFrame([(version, segments, gone, docs, words)], LOG).coalesce(1).write.mode("append").json(f"{self.location}/log")

    def _read(self, part: str, schema: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.location}/{f}/{part}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _live(self, rows: DataFrame, state) -> DataFrame:
        """rows (version, product_id, ...) without the versions that later ones replaced."""
        if not state.gone:
            return rows
        marks = self.spark.read.schema("product_id long, before long").parquet(*(f"{self.location}/{f}" for f in state.gone))
        newest = marks.groupBy("product_id").agg(F.max("before").alias("before"))
        return rows.join(newest, "product_id", "left").filter(F.col("before").isNull() | (F.col("version") >= F.col("before"))).drop("before")

    def _rows(self, state) -> DataFrame:
        return self._read("rows", ROW, [s.folder for s in state.segments])

    def members(self, state=None) -> DataFrame:
        """version, block, product_id, len and the texts of all products."""
        state = state or self.state()
        return self._live(self._read("members", MEMBER, [s.folder for s in state.segments] if state else []), state) if state else self.spark.createDataFrame([], MEMBER)

    def _write(self, folder: str, members: DataFrame, rows: DataFrame, tasks: int) -> None:
        """members and rows (ROW), the rows sorted by term in as many tasks."""
        members.select(*(F.col(c).cast(t) for c, t in (f.split() for f in MEMBER.split(", ")))).write.parquet(f"{self.location}/{folder}/members")
        stored(rows, "index-rows").repartitionByRange(tasks, "term", "block").sortWithinPartitions("term", "block").write.parquet(f"{self.location}/{folder}/rows")

    def upsert(self, fields: DataFrame) -> None:
        """Index products, fields as bm25.index_fields() gives them; those that the index has are replaced."""
        state = self.state()
        version, folder = (state.version + 1 if state else 0), f"segment-{uuid.uuid4().hex}"
        found = {f"_{f}": F.coalesce(F.concat_ws(" ", bm25.words(F.col(f))), F.lit("")) for f in bm25.FIELDS}  # words hold no white space
        texts = fields.select(F.col("product_id").cast("long").alias("product_id"), *TEXTS, *(w.alias(c) for c, w in found.items()))
        split = stored(_block(texts.withColumn("version", F.lit(version).cast("long"))), "index-fields")
        sizes = sum((F.when(F.col(c) == "", 0).otherwise(F.regexp_count(F.col(c), F.lit(" ")) + 1) for c in found), F.lit(0).cast("long"))
        tasks = split.count() // TASK_PRODUCTS + 1
        dealt = split.select(*AT, "product_id", *found).repartition(tasks, "block")  # the texts move once, their words stay in the task
        self._write(folder, split.withColumn("len", sizes), dealt.groupBy("block").applyInArrow(block_rows, ROW), tasks)
        docs, words = self._read("members", MEMBER, [folder]).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        segments, gone = [(folder, 0)], []
        if state:
            mark, old_docs, old_words = self._mark(split.select("product_id"), state)
            segments, gone = [*map(tuple, state.segments), *segments], [*state.gone, *mark]
            docs, words = state.docs - old_docs + docs, state.words - old_words + words
        self._commit(version, segments, gone, docs, words)
        self._merge_full_levels()

    def delete(self, ids: DataFrame) -> None:
        """Take products (product_id) out."""
        if state := self.state():
            mark, docs, words = self._mark(ids.select(F.col("product_id").cast("long").alias("product_id")), state)
            if mark:
                self._commit(state.version + 1, [*map(tuple, state.segments)], [*state.gone, *mark], state.docs - docs, state.words - words)

    def _mark(self, ids: DataFrame, state) -> tuple[list[str], int, int]:
        """Mark what the index has of ids as gone; the mark's folder (none if it has none), and the products and words that go."""
        old = stored(self.members(state).join(ids.distinct(), "product_id", "left_semi").select("product_id", "len"), "index-old")
        docs, words = old.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        if not docs:
            return [], 0, 0
        folder = f"gone-{uuid.uuid4().hex}"
        old.select("product_id", F.lit(state.version + 1).cast("long").alias("before")).write.parquet(f"{self.location}/{folder}")
        return [folder], docs, words

    def _merge_full_levels(self) -> None:
        state = self.state()
        levels = sorted({s.level for s in state.segments})
        for level in levels:
            own = [s for s in state.segments if s.level == level]
            if len(own) >= self.fanout:
                self.merge(own, level + 1)
                return self._merge_full_levels()
        return None

    def merge(self, segments: list | None = None, level: int = 1) -> None:
        """Rewrite segments (all, if none are named) as one; marks stay while an older segment is left."""
        state = self.state()
        chosen = [s.folder for s in (segments or state.segments)]
        folder = f"segment-{uuid.uuid4().hex}"
        rows = self._read("rows", ROW, chosen).select("version", "term", "field", F.explode("postings").alias("p")).select("version", "term", "field", "p.product_id", "p.positions")
        newest = F.lit(self._read("members", MEMBER, chosen).agg(F.max("version")).first()[0]).cast("long")
        members = stored(self._live(self._read("members", MEMBER, chosen), state).withColumn("version", newest), "index-members")
        tasks = members.count() // TASK_PRODUCTS + 1
        left_over = _by_block(self._live(rows, state).withColumn("version", newest), tasks)
        grouped = left_over.groupBy("version", "block", "term", "field").agg(F.array_sort(F.collect_list(F.struct("product_id", "positions"))).alias("postings"))
        self._write(folder, members, grouped.withColumns({"n": F.size("postings"), "most": F.array_max(F.transform("postings", lambda p: F.size(p["positions"])))}), tasks)
        left = [tuple(s) for s in state.segments if s.folder not in chosen]
        self._commit(state.version + 1, [*left, (folder, level)], list(state.gone) if left else [], state.docs, state.words)

    def _of_terms(self, state, concepts: list[list[str]]) -> DataFrame:
        """The rows that hold a term of the concepts: words of a phrase whole, other terms as prefixes."""
        wanted = F.lit(False)
        for term in {t for terms in concepts for t in terms}:
            for word in term.split():
                wanted |= (F.col("term") == word) if " " in term else F.col("term").startswith(word)
        return self._rows(state).filter(wanted)

    def _postings(self, rows: DataFrame, state) -> DataFrame:
        """(product_id, field, term, pos) of rows, a row a word."""
        one = rows.select("version", "field", "term", F.explode("postings").alias("p")).select("version", "field", "term", "p.product_id", F.explode("p.positions").alias("pos"))
        return self._live(one, state).select("product_id", "field", "term", "pos")

    def terms(self) -> DataFrame:
        """field, term, product_id and how often the product has it."""
        state = self.state()
        rows = self._rows(state).select("version", "field", "term", F.explode("postings").alias("p"))
        return self._live(rows.select("version", "field", "term", "p.product_id", F.size("p.positions").alias("times")), state).drop("version")

    def lengths(self, state=None) -> DataFrame:
        return self.members(state).select("product_id", "len")

    def scores(self, concepts: list[list[str]], weights: dict[str, float] | None = None) -> DataFrame:
        """product_id and score of all products with every concept."""
        state = self.state()
        if not state or not concepts:
            return self.spark.createDataFrame([], "product_id long, score double")
        return bm25.bm25(self._postings(self._of_terms(state, concepts), state), concepts, weights, self.lengths(state), (state.docs, state.words))

    def _holders(self, rows: DataFrame, state, concepts: list[list[str]]) -> DataFrame:
        """Number of products of each concept (concept, df): from ids alone, but for phrases."""
        parts = []
        for n, terms in enumerate(concepts):
            single = [t for t in terms if " " not in t]
            if single:
                own = rows.filter(_any_prefix(F.col("term"), single)).select("version", F.explode("postings.product_id").alias("product_id"))
                parts.append(self._live(own, state).select(F.lit(n).alias("concept"), "product_id"))
            if phrases := [t for t in terms if " " in t]:
                whole = bm25.hits(self._postings(self._of_terms(state, [phrases]), state), [phrases], bm25.FIELDS)
                parts.append(whole.select(F.lit(n).alias("concept"), "product_id"))
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        return both.distinct().groupBy("concept").agg(F.count("*").alias("df"))

    def top(self, concepts: list[list[str]], k: int, weights: dict[str, float] | None = None) -> DataFrame:
        """The k best of scores(), by score, then product_id. The ranges that could score most are scored first; of the others only
        those that could reach the k-th score found so far are read."""
        state, weights = self.state(), weights or bm25.FIELDS
        if not state or not concepts:
            return self.spark.createDataFrame([], "product_id long, score double")
        rows = self._of_terms(state, concepts)
        df = {r["concept"]: r["df"] for r in self._holders(rows, state, concepts).collect()}  # a row a concept of the query
        if len(df) < len(concepts):
            return self.spark.createDataFrame([], "product_id long, score double")
        bounds = stored(self._bounds(rows, state, concepts, weights, df), "index-bounds")
        order = [F.desc("bound"), "version", "block"]
        first = bounds.orderBy(*order).limit(SEED_RANGES).collect()
        chosen = F.lit(False)
        for r in first:
            chosen |= (F.col("version") == r["version"]) & (F.col("block") == r["block"])
        best = stored(self._score(rows.filter(chosen), state, concepts, weights, df).orderBy(F.desc("score"), "product_id").limit(k), "index-best")
        found, least = best.agg(F.count("*"), F.min("score")).first()
        rest = bounds.filter(~chosen)
        if found == k:
            rest = rest.filter(F.col("bound") >= least)
        others = self._score(rows.join(rest.select(*AT), AT, "left_semi"), state, concepts, weights, df)
        return best.unionByName(others).orderBy(F.desc("score"), "product_id").limit(k)

    def _score(self, rows: DataFrame, state, concepts, weights, df) -> DataFrame:
        found = bm25.hits(self._postings(rows, state), concepts, weights)
        return bm25.scored(found, _by_concept(df), self.lengths(state), F.lit(state.docs), F.lit(state.words), len(concepts))

    def _bounds(self, rows: DataFrame, state, concepts, weights, df) -> DataFrame:
        """version, block, bound: no product of the range scores more. Of a phrase, its first word bounds the times."""
        parts = None
        for n, terms in enumerate(concepts):
            lone, firsts = [t for t in terms if " " not in t], [t.split()[0] for t in terms if " " in t]
            term, weight = F.col("term"), F.lit(0)
            if lone:
                weight = weight + F.when(_any_prefix(term, lone), 1).otherwise(0)
            for word in firsts:
                weight = weight + F.when(term == word, 1).otherwise(0)
            part = rows.select(*AT, F.lit(n).alias("concept"), (weight * bm25.field_weight(weights) * F.col("most")).alias("times")).filter("times > 0")
            parts = part if parts is None else parts.unionByName(part)
        times = parts.groupBy(*AT, "concept").agg(F.sum("times").alias("tf"))
        least = self._read("members", MEMBER, [s.folder for s in state.segments]).groupBy(*AT).agg(F.min("len").alias("len"))
        part = bm25.term_score(_by_concept(df), F.col("tf"), F.col("len"), F.lit(state.docs), F.lit(state.words))
        return times.join(least, AT).groupBy(*AT).agg(F.count("*").alias("concepts"), F.sum(part + 1e-6).alias("bound")).filter(F.col("concepts") == len(concepts)).select(*AT, "bound")


def block_rows(texts: pa.Table) -> pa.Table:
    """The rows (ROW) of one block: texts (version, block, product_id and the words of each field, joined by spaces) turned from products to terms."""
    texts = texts.sort_by("product_id")
    ids = texts["product_id"].to_numpy()
    out = []
    for field in bm25.FIELDS:
        words = pc.split_pattern(texts[f"_{field}"], " ").combine_chunks()
        ends = words.offsets.to_numpy()
        product, pos = np.repeat(np.arange(len(ids)), np.diff(ends)), np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        found = words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        code, kept = found.indices.to_numpy(), np.not_equal(found.dictionary.to_numpy(zero_copy_only=False), "")[found.indices.to_numpy()]
        code, product, pos = code[kept], product[kept], pos[kept]
        order = np.argsort(code, kind="stable")  # products and positions keep their order
        code, product, pos = code[order], product[order], pos[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(product, prepend=-1))  # of a product's postings
        firsts = np.flatnonzero(np.diff(code[starts], prepend=-1))  # of a term's products
        times = np.diff(starts, append=len(code))
        positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(code)), pa.int32()), pa.array(pos, pa.int32()))
        postings = pa.StructArray.from_arrays([pa.array(ids[product[starts]], pa.int64()), positions], ["product_id", "positions"])
        n = len(firsts)
        if n:
            out.append(pa.table({
                "version": pa.repeat(texts["version"][0], n), "block": pa.repeat(texts["block"][0], n), "term": found.dictionary.take(pa.array(code[starts[firsts]])), "field": pa.repeat(field, n),
                "postings": pa.ListArray.from_arrays(pa.array(np.append(firsts, len(starts)), pa.int32()), postings), "n": pa.array(np.diff(firsts, append=len(starts)), pa.int32()), "most": pa.array(np.maximum.reduceat(times, firsts), pa.int32()),
            }))
    return pa.concat_tables(out) if out else pa.table({"version": [], "block": [], "term": [], "field": [], "postings": [], "n": [], "most": []}).cast(_ROW_TYPES)


_ROW_TYPES = pa.schema([("version", pa.int64()), ("block", pa.int64()), ("term", pa.string()), ("field", pa.string()), ("postings", pa.list_(pa.struct([("product_id", pa.int64()), ("positions", pa.list_(pa.int32()))]))), ("n", pa.int32()), ("most", pa.int32())])


def _block(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("product_id") / RANGE))


def _by_block(rows: DataFrame, tasks: int) -> DataFrame:
    """rows with their block, the rows of a block in one of the tasks."""
    return _block(rows).repartition(tasks, "block")


def _any_prefix(term: Column, prefixes: list[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found |= term.startswith(p)
    return found


def _by_concept(df: dict[int, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in sorted(df.items()) for x in pair)), F.col("concept"))


def files_key(spark: SparkSession, paths: list[str]) -> str:
    """Names the present files of tables, by path, size and time; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return f"{files.agg(F.bit_xor(F.xxhash64('path', 'modificationTime', 'length'))).first()[0] & (2**64 - 1):016x}"
