"""Writing rendered documents and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_category(docs: DataFrame, path: str, category: str = "category", mode: str = "overwrite") -> None:
    """A folder for each category; tasks write their own files."""
    docs.write.mode(mode).partitionBy(category).parquet(path)


def manifest(assets: DataFrame, key: str = "page") -> DataFrame:
    """(key, manifest): one JSON text with the assets of a page and their digests.

    assets: key, url, local_path, status, content (binary).
    """
    item = F.struct("url", "local_path", "status", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return assets.groupBy(key).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("assets"))).alias("manifest"))
