"""Reading document collections from files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition


def text_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, text): a row for each whole file."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def headers(files: DataFrame, size: int = 2000) -> DataFrame:
    """Only the start of each text, for archive indexes."""
    return files.withColumn("text", F.substring("text", 1, size))


def archive_index(files: DataFrame) -> DataFrame:
    """(path, post_id) from '#+source: …/<digits>' header lines."""
    found = F.regexp_extract(F.substring("text", 1, 2000), r"(?md)^#\+source:\s*\S+/(\d+)\s*$", 1)
    return files.select("path", F.nullif(found, F.lit("")).alias("post_id")).where("post_id IS NOT NULL")


def unwrap_json(raw: Column) -> Column:
    """The text of {"result": …}, or the raw text if it isn't that."""
    return F.coalesce(F.get_json_object(raw, "$.result"), raw)


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]))
def mime_html(content: pd.Series) -> pd.DataFrame:
    """The first text/html part of a MIME message, NFC; a row never fails, its error is told."""
    import email
    import unicodedata

    def read(raw: bytes):
        try:
            for part in email.message_from_bytes(raw).walk():
                if part.get_content_type() == "text/html":
                    text = part.get_payload(decode=True).decode(part.get_content_charset() or "utf-8", "replace")
                    return unicodedata.normalize("NFC", text), None
            return None, "no text/html part"
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    return pd.DataFrame([read(x) for x in content], columns=["value", "error"])


def mime_documents(spark: SparkSession, path: str, glob: str = "*.doc") -> DataFrame:
    """(path, html, error) of MIME documents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", mime_html("content").alias("r")).select("path", F.col("r.value").alias("html"), F.col("r.error").alias("error"))


def _store(path: str):
    """(file system, path in it) of a path or address: local, or a store that Arrow reaches, from every machine alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def names_in(path: str) -> list[str]:
    from pyarrow import fs

    store, place = _store(path)
    return [f.base_name for f in store.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File]


def read_text(path: str, name: str) -> str:
    store, place = _store(path)
    with store.open_input_stream(f"{place.rstrip('/')}/{name}") as f:
        return f.read().decode("utf-8", "replace")


class _Folder(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(0)
        self.names = names


class FolderReader(DataSourceReader):
    """Lists a folder of documents; an equality on ext is applied while listing."""

    def __init__(self, path: str, per_task: int):
        self.path, self.per_task, self.ext = path, per_task, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ext",):
                self.ext = f.value
            else:
                yield f

    def partitions(self):
        names = sorted(n for n in names_in(self.path) if not self.ext or n.endswith("." + self.ext))
        return [_Folder(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)]

    def read(self, partition) -> Iterator[tuple]:
        for name in partition.names:
            yield name, name.rpartition(".")[2] if "." in name else "", read_text(self.path, name)


class FolderSource(DataSource):
    """The plug-in contract for connectors, shown on a shared folder: format "document_folder"."""

    @classmethod
    def name(cls) -> str:
        return "document_folder"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in ("name", "ext", "text")])

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], int(self.options.get("filesPerTask", 64)))


def patient(action, tries: int, delay: float, longest: float = 30.0):
    """The action's result; after a failure of the store it is tried again, each wait twice the one before."""
    import time

    for n in range(tries):
        try:
            return action()
        except OSError:
            if n + 1 == tries:
                raise
            time.sleep(min(delay * 2**n, longest))


class FeedReader(DataSourceStreamReader):
    """Numbered pages of a feed, page-0, page-1, ...: the offset is the number of the next page.

    Pages are JSON lists of texts.  ``delay`` seconds pass between two pages of a task; a
    page that can't be read yet is tried ``tries`` times with growing waits.
    """

    def __init__(self, options: dict):
        self.path, self.delay = options["path"], float(options.get("delay", 0.1))
        self.tries, self.per_task = int(options.get("tries", 5)), int(options.get("pagesPerTask", 8))

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        import re

        found = [int(m[1]) for n in names_in(self.path) if (m := re.fullmatch(r"page-(\d+)\.json", n))]
        return {"page": max(found, default=-1) + 1}

    def partitions(self, start: dict, end: dict):
        pages = [str(k) for k in range(start["page"], end["page"])]
        return [_Folder(pages[i : i + self.per_task]) for i in range(0, len(pages), self.per_task)]

    def read(self, partition) -> Iterator[tuple]:
        import json
        import time

        for n, page in enumerate(partition.names):
            if n:
                time.sleep(self.delay)
            for k, text in enumerate(json.loads(patient(lambda: read_text(self.path, f"page-{page}.json"), self.tries, self.delay))):  # noqa: B023
                yield int(page), k, text

    def commit(self, end: dict) -> None:
        """Pages stay where they are."""


class FeedSource(DataSource):
    """A feed of pages as a stream: format "document_feed"."""

    @classmethod
    def name(cls) -> str:
        return "document_feed"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("page", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("text", T.StringType())])

    def streamReader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats "document_folder", with filters pushed to its reader, and "document_feed" known."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
    spark.dataSource.register(FeedSource)
