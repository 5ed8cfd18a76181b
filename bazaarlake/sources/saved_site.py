"""Saved answers of sites as a data source: listings by keyword or by category walk, page by page, as a table and as a stream.

    spark.dataSource.register(SavedSite)
    spark.read.format("saved_site").option("kind", "keyword").load(path)

Under path lie folders site=<key>/<kind>=<topic>/page=<n>, kind being keyword or category, each with files of lines, one item a
line as the site gave it (names are escaped as Spark does). A topic's pages count from 1 and end at the first number that
is missing; a page without items doesn't end them. maxPages limits the pages of a topic, 0 not at all.

Rows: site_key, topic, page, at (place of the item in its page, from 0) and item. Filters on site_key and topic are pushed into the
listing of folders, so other sites and topics aren't looked at; each partition is a run of pages of one topic. As a
stream, an offset says how many pages of each topic have been read, so a restarted stream goes on with pages that came since.

Paths are opened by pyarrow's file systems, on the driver (names only) and on executors. A missing path, site or topic has no rows."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from bazaarlake.sources.catalog import Catalog
from bazaarlake.sources.tables import shared_dir

SCHEMA = "site_key string, topic string, page int, at int, item string"
KINDS = ("keyword", "category")
PAGES_A_PARTITION = 50


@dataclass
class Pages(InputPartition):
    """Pages of a topic: their numbers and folders."""

    site: str
    topic: str
    pages: list[tuple[int, str]]

    def __post_init__(self):
        super().__init__((self.site, self.topic, self.pages[0][0]))


class Folders:
    """The tree of saved pages."""

    def __init__(self, options: dict):
        self.path, self.kind, self.most = options.get("path", ""), options.get("kind", "keyword"), int(options.get("maxpages", options.get("maxPages", 0)))
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    @staticmethod
    def children(store: fs.FileSystem, folder: str, name: str) -> list[tuple[str, str]]:
        """(value, path) of folder's subfolders name=value."""
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted((unquote(f.base_name.partition("=")[2]), f.path) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(f"{name}="))

    def topics(self, sites: set[str] | None = None, topics: set[str] | None = None) -> Iterator[tuple[str, str, list[tuple[int, str]]]]:
        """site, topic and the pages up to the first missing one."""
        store, root = self.store()
        for site, folder in self.children(store, root, "site"):
            if sites is None or site in sites:
                for topic, at in self.children(store, folder, self.kind):
                    if topics is None or topic in topics:
                        numbered = {int(n): p for n, p in self.children(store, at, "page") if n.isdigit()}
                        pages = []
                        while len(pages) + 1 in numbered and (not self.most or len(pages) < self.most):
                            pages.append((len(pages) + 1, numbered[len(pages) + 1]))
                        if pages:
                            yield site, topic, pages

    def items(self, part: Pages) -> Iterator[tuple]:
        store, _ = self.store()
        for page, folder in part.pages:
            at = 0
            files = (f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and f.base_name[0] not in "._")
            for path in sorted(files):
                with store.open_input_stream(path) as stream:
                    for line in _lines(stream):
                        yield part.site, part.topic, page, at, line
                        at += 1


def _lines(stream) -> Iterator[str]:
    """Lines with a sign, read in blocks."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x.decode() for x in whole if x.strip())
    if rest.strip():
        yield rest.decode()


def _cut(site: str, topic: str, pages: list[tuple[int, str]]) -> list[Pages]:
    return [Pages(site, topic, pages[k : k + PAGES_A_PARTITION]) for k in range(0, len(pages), PAGES_A_PARTITION)]


class SavedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folders, self.only = Folders(options), {}

    def pushFilters(self, filters):  # noqa: N802  names of the interface
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("site_key", "topic"):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = self.only[column] & wanted if column in self.only else wanted
            else:
                yield f

    def partitions(self) -> list[Pages]:
        return [p for t in self.folders.topics(self.only.get("site_key"), self.only.get("topic")) for p in _cut(*t)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.folders.items(partition) if isinstance(partition, Pages) else iter(())


class SavedStreamReader(DataSourceStreamReader):
    """Offsets are {"read": {site/topic as JSON list: pages}}."""

    def __init__(self, options: dict):
        self.folders = Folders(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"read": {}}

    def latestOffset(self, *_) -> dict:  # noqa: N802
        return {"read": {json.dumps([site, topic]): len(pages) for site, topic, pages in self.folders.topics()}}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        out = []
        for site, topic, pages in self.folders.topics():
            key = json.dumps([site, topic])
            fresh = pages[start["read"].get(key, 0) : end["read"].get(key, 0)]
            out += _cut(site, topic, fresh) if fresh else []
        return out

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.folders.items(partition) if isinstance(partition, Pages) else iter(())


class SavedSite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "saved_site"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SavedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return SavedStreamReader(dict(self.options))


def saved_site(spark: SparkSession, path: str, kind: str = "keyword", max_pages: int = 0) -> DataFrame:
    """The saved answers under path as a table, filters on site and topic pushed into the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SavedSite)
    return spark.read.format("saved_site").option("kind", kind).option("maxPages", max_pages).load(path)


ITEMS_A_PAGE, SAMPLE_SITES, SAMPLE_TOPICS = 25, 5, 4


def sample_pages(catalog: Catalog) -> DataFrame:
    """Products as items of saved keyword pages: their site and topic by key, every seventh page lost."""
    k = F.col("product_id")
    rows = catalog.products().select(F.concat(F.lit("shop "), k % SAMPLE_SITES).alias("site"), F.concat(F.lit("word/"), F.floor(k / SAMPLE_SITES) % SAMPLE_TOPICS).alias("keyword"), k.alias("id"), "title")
    place = F.row_number().over(Window.partitionBy("site", "keyword").orderBy("id")) - 1
    return rows.withColumn("page", F.floor(place / ITEMS_A_PAGE) + 1).filter("page % 7 <> 0")


def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that two keywords find on the saved pages of all sites: pages after a lost one aren't reached."""
    import uuid

    path = f"{shared_dir(spark)}/saved-site-{uuid.uuid4().hex}"
    sample_pages(Catalog(spark, sf_dir)).repartition("site", "keyword", "page").write.partitionBy("site", "keyword", "page").json(path)
    found = saved_site(spark, path).filter(F.col("topic").isin("word/1", "word/3"))
    return found.select("site_key", "topic", "page", F.get_json_object("item", "$.id").cast("long").alias("product_id"), F.get_json_object("item", "$.title").alias("title"))


QUERIES = {"saved_searches": saved_searches}
ORACLES = {
    "saved_searches": f"WITH r AS (SELECT 'shop ' || (p_partkey % {SAMPLE_SITES}) AS site_key, 'word/' || ((p_partkey // {SAMPLE_SITES}) % {SAMPLE_TOPICS}) AS topic, p_partkey AS product_id, p_name AS title FROM part), p AS (SELECT *, ((row_number() OVER (PARTITION BY site_key, topic ORDER BY product_id) - 1) // {ITEMS_A_PAGE} + 1)::INT AS page FROM r) SELECT * FROM p WHERE page < 7 AND topic IN ('word/1', 'word/3')",
}
