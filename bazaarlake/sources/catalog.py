"""Catalog tables as views of the driver's star schema, and readers and writers of files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlake.sources.tables import stored

#: Latest listing of a (product, supplier): every column takes part, as no subset is unique.
LATEST = ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

#: The same view in ANSI SQL, for the oracles.
OFFERS_SQL = f"""offers AS (
  SELECT l_partkey AS product_id, l_suppkey AS supplier_id, s_nationkey AS site_id, l_extendedprice / l_quantity AS price_usd,
         CAST(l_quantity AS INTEGER) AS moq, CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice * l_tax END AS shipping,
         l_returnflag <> 'R' AS in_stock, l_linestatus = 'O' AS is_active, l_shipdate AS last_seen
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY {', '.join(c + ' DESC' for c in LATEST)}) AS rn FROM lineitem) r
  JOIN supplier ON s_suppkey = l_suppkey WHERE rn = 1)"""


class Catalog:
    """DataFrames of the catalog over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sites(self) -> DataFrame:
        """One row a site: key, whether it needs an agent, whether it is the home baseline, whether it sells wholesale."""
        nation, region = self.table("nation"), self.table("region")
        r = F.col("r_name")
        return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
            F.col("n_nationkey").alias("site_id"), F.lower("n_name").alias("site_key"), (r == "ASIA").alias("needs_agent"), (r == "AMERICA").alias("is_baseline"), (r == "EUROPE").alias("is_wholesale")
        )

    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.concat_ws("/", F.lower("p_type"), F.lower("p_brand")).alias("path"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("list_price")
        )

    def offers(self) -> DataFrame:
        """The latest listing of each (product, supplier); undisclosed shipping is null."""
        line, supplier = self.table("lineitem"), self.table("supplier").select("s_suppkey", "s_nationkey")
        newest = line.groupBy("l_partkey", "l_suppkey").agg(F.max(F.struct(*LATEST)).alias("l"))  # partial aggregation before the shuffle
        latest = newest.select("l_partkey", "l_suppkey", "l.*")
        return latest.join(supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("s_nationkey").alias("site_id"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_usd"),
            F.col("l_quantity").cast("int").alias("moq"),
            F.when(F.col("l_tax") != 0, F.col("l_extendedprice") * F.col("l_tax")).alias("shipping"),
            (F.col("l_returnflag") != "R").alias("in_stock"),
            (F.col("l_linestatus") == "O").alias("is_active"),
            F.col("l_shipdate").alias("last_seen"),
        )

    def first_seen(self) -> DataFrame:
        """When each product was first listed."""
        return self.table("lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(F.min("l_shipdate").alias("first_seen"))

    def active_offers(self) -> DataFrame:
        return self.offers().filter("is_active")


def least_by(value: str, *order: str) -> Column:
    """The value of the row that comes first in order (a total order makes it unique)."""
    return F.min(F.struct(*order, value))[value]


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each key in order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def numbered(rows: DataFrame, key: str, first: int, name: str) -> DataFrame:
    """rows (unique in key) with a long `name`: first and up, in order of key. Ranges of keys are numbered on their own, each after the rows of
    the ranges before, so no task orders all rows."""
    ranged = stored(rows.repartitionByRange(F.asc(key)).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = sorted(tuple(r) for r in ranged.groupBy("_range").count().collect())  # a row a range
    before, total = [], first
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "_range int, _start long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return ranged.join(starts, "_range").withColumn(name, F.col("_start") + place).drop("_range", "_start")


def keep_newest_folders(names: list[str], keep: int) -> list[str]:
    """Which snapshot folders (named so that they sort by time) a rotation removes."""
    return sorted(names)[: max(0, len(names) - keep)]


class Snapshots:
    """Dated copies of tables under one folder. A log names them; rotation leaves the newest `keep` in it, so readers see those only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def names(self) -> list[str]:
        return sorted(r["name"] for r in log_rows(self.spark, f"{self.folder}/log", "name string, kept boolean", "name"))

    def take(self, tables: dict[str, DataFrame], name: str, keep: int) -> list[str]:
        """Write a snapshot of the tables under name (names sort by time) and rotate; gives the names that went."""
        for table, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/{table}")
        gone = keep_newest_folders([*self.names(), name], keep)
        entries = [(name, name not in gone), *((n, False) for n in gone if n != name)]
        self.spark.createDataFrame(entries, "name string, kept boolean").coalesce(1).write.mode("append").json(f"{self.folder}/log")
        return gone

    def read(self, name: str, table: str) -> DataFrame:
        if name not in self.names():
            raise ValueError(f"no snapshot {name}")
        return self.spark.read.parquet(f"{self.folder}/{name}/{table}")


def log_rows(spark: SparkSession, path: str, schema: str, key: str) -> list:
    """The entries of a small JSON log whose `kept` is true in all lines of their key; none without a log."""
    try:
        rows = spark.read.schema(schema).json(path)
        return rows.groupBy(key).agg(F.bool_and("kept").alias("kept")).filter("kept").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, nulls as empty fields."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def with_total(rows: DataFrame, label: str, totals: dict[str, Column]) -> DataFrame:
    """rows in order, then one row of totals under the label, the other columns null. rows: a report's lines, with `line_no`."""
    total = rows.agg(*(x.alias(c) for c, x in totals.items()))
    first = rows.columns[1]
    last = total.select(*(F.lit(2**31 - 1).alias(c) if c == "line_no" else F.lit(label).alias(c) if c == first else F.col(c) if c in totals else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    return rows.unionByName(last).orderBy("line_no")


def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    """Rewrite a table of many small files as few."""
    spark.read.parquet(source).coalesce(files).write.mode("overwrite").parquet(target)


def seeded(current: DataFrame | None, seeds: DataFrame, key: str, fixed: list[str]) -> DataFrame:
    """Reference data after seeding: what the seeds' fixed columns say, other columns as an operator left them, own rows of the table kept."""
    if current is None:
        return seeds
    old = current.select(key, *(F.col(c).alias(f"_old_{c}") for c in seeds.columns if c != key), F.lit(True).alias("_known"))
    joined = seeds.join(old, key, "left")
    merged = joined.select(key, *(F.col(c) if c in fixed else F.when(F.col("_known"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in seeds.columns if c != key))
    return merged.unionByName(current.select(*seeds.columns).join(seeds.select(key), key, "left_anti"))
