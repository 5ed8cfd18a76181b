"""A sink for alerts that delivers each once: staged by tasks, handed over by commit, remembered in a ledger.

    spark.dataSource.register(AlertOutbox)
    alerts.writeStream.format("alert_outbox").option("path", path).option("query", name).option("checkpointLocation", ...)

Tasks write a batch's alerts as files of JSON lines under staged/. Commit moves them to delivered/<query>/batch=<n>, where whoever posts them
picks them up, and closes the batch with a mark; a batch that is committed again (Spark repeats the last one after a restart) finds the
mark, and its staged files go. Abort removes what the batch staged. `query` names a stream and its checkpoint, since batches of
another one count from 0 too; the same alert from two streams is one delivery by its key in `deliveries`.

Paths are opened by pyarrow's file systems. The driver handles names of files, never alerts. An empty batch leaves its mark alone."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

MARK = "closed.mark"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    file: str | None


class OutboxWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.path, self.query = options["path"].rstrip("/"), options["query"]
        if not self.query or set(self.query) & set("/\\"):
            raise ValueError("query names the stream, without slashes")

    def write(self, iterator) -> Staged:
        store, root = _store(self.path)
        rows = [json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in iterator]  # a task's alerts of one batch
        if not rows:
            return Staged(None)
        store.create_dir(f"{root}/staged/{self.query}")
        name = f"{root}/staged/{self.query}/{uuid.uuid4().hex}.json"
        with store.open_output_stream(name) as out:
            out.write("".join(f"{r}\n" for r in rows).encode())
        return Staged(name)

    def commit(self, messages, batchId: int) -> None:  # noqa: N803  names of the interface
        store, root = _store(self.path)
        folder = f"{root}/delivered/{self.query}/batch={batchId}"
        files = [m.file for m in messages if m is not None and m.file]
        if store.get_file_info(f"{folder}/{MARK}").type != fs.FileType.NotFound:
            self._remove(store, files)
            return
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)  # a commit that broke off: its alerts are staged anew
        store.create_dir(folder)
        for file in files:
            store.move(file, f"{folder}/{file.rsplit('/', 1)[1]}")
        with store.open_output_stream(f"{folder}/{MARK}") as out:
            out.write(b"closed\n")  # Spark skips empty files

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self._remove(_store(self.path)[0], [m.file for m in messages if m is not None and m.file])

    @staticmethod
    def _remove(store: fs.FileSystem, files: list[str]) -> None:
        for file in files:
            if store.get_file_info(file).type != fs.FileType.NotFound:
                store.delete_file(file)


class AlertOutbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "alert_outbox"

    def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:  # noqa: N802
        return OutboxWriter(dict(self.options))


def deliveries(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Alerts of closed batches, with their query and batch, each key once: the first by (query, batch)."""
    marks = spark.read.format("binaryFile").option("pathGlobFilter", MARK).option("recursiveFileLookup", True).load(f"{path}/delivered").select("path")
    at = lambda c: (F.regexp_extract(c, r"/delivered/([^/]+)/batch=", 1).alias("query"), F.regexp_extract(c, r"/batch=(\d+)/", 1).cast("long").alias("batch"))
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{path}/delivered").select("*", *at(F.col("_metadata.file_path")))
    closed = rows.join(marks.select(*at(F.col("path"))), ["query", "batch"], "left_semi")
    first = Window.partitionBy(*keys).orderBy("query", "batch")
    return closed.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
