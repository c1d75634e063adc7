"""Ordered lines of documents as a table, and the windows over them.

Every operator takes and returns (key, pos, line) tables: order is a column.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.markup import heading_level, is_structural
from ..functions.rx import nospace, strip


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line), pos from 0."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def assemble(lines: DataFrame, key: str = "doc_id", value: str = "line", joint: str = "\n", out: str = "text") -> DataFrame:
    """Join lines in the order of pos: one row per key, as long as its document."""
    packed = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("all"))
    return packed.select(key, F.array_join(F.transform("all", lambda x: x["v"]), joint).alias(out))


def _order(key: str):
    return W.partitionBy(key).orderBy("pos")


def _upto(key: str):
    return _order(key).rowsBetween(W.unboundedPreceding, 0)


def carry(lines: DataFrame, marker: Column, out: str, key: str = "doc_id") -> DataFrame:
    """The last marker up to each line; null before the first."""
    return lines.withColumn(out, F.last(marker, ignorenulls=True).over(_upto(key)))


def islands(lines: DataFrame, breaks: Column, out: str = "island", key: str = "doc_id") -> DataFrame:
    """Number runs of lines: a new island begins at each line where ``breaks`` holds."""
    return lines.withColumn(out, F.sum(breaks.cast("long")).over(_upto(key)))


def runs(lines: DataFrame, member: Column, key: str = "doc_id") -> DataFrame:
    """(key, first, last, n) of the maximal runs of lines where ``member`` holds, such as tables or quotes."""
    flagged = lines.withColumn("_in", F.coalesce(member, F.lit(False)))
    numbered = flagged.where("_in").withColumn("_at", F.col("pos") - F.row_number().over(_order(key)))
    return numbered.groupBy(key, "_at").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).drop("_at")


def in_block(lines: DataFrame, begin: Column, end: Column, out: str = "in_block", key: str = "doc_id") -> DataFrame:
    """Whether a line stands in a block, its begin and end lines included; blocks don't nest."""
    mark = F.when(begin, F.lit(1)).when(end, F.lit(0))
    return carry(lines, mark, "_open", key).withColumn(out, (F.coalesce("_open", F.lit(0)) == 1) | F.coalesce(end, F.lit(False))).drop("_open")


def unfill(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Join the lines of each paragraph with blanks; structure and blocks stay line by line."""
    low = F.lower(strip(F.col("line")))
    held = in_block(lines, low.startswith("#+begin_"), low.startswith("#+end_"), "_held", key)
    loose = held.withColumn("_loose", ~F.col("_held") & ~is_structural(F.col("line")))
    fresh = ~F.col("_loose") | ~F.coalesce(F.lag("_loose").over(_order(key)), F.lit(False))
    parts = islands(loose.withColumn("_fresh", fresh), F.col("_fresh"), "_part", key)
    piece = F.when(F.col("_loose"), strip(F.col("line"))).otherwise(F.col("line"))
    packed = parts.groupBy(key, "_part").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", piece.alias("v")))).alias("all"))
    return packed.select(key, "pos", F.array_join(F.transform("all", lambda x: x["v"]), " ").alias("line"))


def drop_repeat_headings(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drop a Markdown heading whose next element is a heading of its level and whole text, white space and bullet aside.

    Blank lines, rules and comments are no elements; what stands in a code block is no heading.
    """
    bare = strip(F.col("line"))
    opens = F.col("line").rlike(r"^\s*<!--")
    code = lines.withColumn("_fence", F.sum(F.col("line").rlike(r"^```").cast("int")).over(_upto(key)))
    noted = in_block(code, opens & ~F.contains("line", F.lit("-->")), F.contains("line", F.lit("-->")), "_note", key)
    free = F.col("_fence") % 2 == 0
    level = F.when(free & ~F.col("_note"), F.nullif(F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)), F.lit(0)))
    text = heading_level(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1), level)["clean"]
    same = F.when(level.isNotNull(), F.struct(level.alias("level"), nospace(text).alias("text")))
    skipped = free & (F.col("_note") | (bare == "") | bare.rlike("^-{3,}$"))
    # The next element, as a struct that is there even if the element is no heading.
    element = F.when(~skipped, F.struct(same.alias("same")))
    back = W.partitionBy(key).orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    following = F.last(element, ignorenulls=True).over(back)
    known = noted.withColumn("_same", same).withColumn("_next", following["same"])
    return known.where(~F.coalesce(F.col("_next") == F.col("_same"), F.lit(False))).select(*lines.columns)


def collapse_rules(lines: DataFrame, rule: str = "---", key: str = "doc_id") -> DataFrame:
    """Drop a rule whose previous non-blank line is a rule."""
    trimmed = F.trim("line")
    before = F.last(F.when(trimmed != "", trimmed), ignorenulls=True).over(_order(key).rowsBetween(W.unboundedPreceding, -1))
    return lines.withColumn("_before", before).where(~((trimmed == rule) & F.coalesce(F.col("_before") == rule, F.lit(False)))).drop("_before")


def first_seen(lines: DataFrame, value: str, key: str = "doc_id") -> DataFrame:
    """Add nth: 1 for the first line of its value in the document."""
    return lines.withColumn("nth", F.row_number().over(W.partitionBy(key, value).orderBy("pos")))


def trim_edges(lines: DataFrame, drop: Column, key: str = "doc_id") -> DataFrame:
    """Without the lines at both ends where ``drop`` holds, such as running page numbers."""
    kept = W.partitionBy(key)
    inner = F.when(~drop, F.col("pos"))
    bounds = lines.withColumn("_lo", F.min(inner).over(kept)).withColumn("_hi", F.max(inner).over(kept))
    return bounds.where("pos BETWEEN _lo AND _hi").drop("_lo", "_hi")


def parents(lines: DataFrame, level: str = "level", key: str = "doc_id") -> DataFrame:
    """Add parent: the position of the nearest line before of a lower level, whatever the depth.

    Lines without a level have none.  Levels and positions alone are sorted by document;
    a task reads them in a stream and keeps the open levels, no more than the deepest has.
    """
    own = lines.schema[key]
    kind = T.StructType([T.StructField("_key", own.dataType), T.StructField("_pos", T.LongType()), T.StructField("parent", T.LongType())])
    known = lines.where(F.col(level).isNotNull()).select(F.col(key).alias("_key"), F.col("pos").cast("long").alias("_pos"), F.col(level).cast("long").alias("_level"))

    def run(batches):
        open_, before = [], object()
        for batch in batches:
            told = []
            for k, pos, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != before:
                    open_, before = [], k
                while open_ and open_[-1][0] >= depth:
                    open_.pop()
                told.append(open_[-1][1] if open_ else None)
                open_.append((depth, pos))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.int64())], ["_key", "_pos", "parent"])

    found = known.repartition("_key").sortWithinPartitions("_key", "_pos").mapInArrow(run, kind)
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("pos") == F.col("_pos"))
    return lines.join(found, same, "left").select(*lines.columns, F.col("parent").cast(lines.schema["pos"].dataType).alias("parent"))


def drop_blocks(lines: DataFrame, begin: Column, end: Column, key: str = "doc_id") -> DataFrame:
    """Without blocks, begin and end lines included; one that never ends goes on to the last line.

    An end line outside a block stays."""
    mark = F.when(begin, F.lit(1)).when(end, F.lit(0))
    before = F.last(mark, ignorenulls=True).over(_order(key).rowsBetween(W.unboundedPreceding, -1))
    marked = lines.withColumn("_in", (F.coalesce(before, F.lit(0)) == 1) | F.coalesce(begin, F.lit(False)))
    return marked.where(~F.col("_in")).drop("_in")


def drop_drawers(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Without property drawers and index keywords."""
    line = strip(F.col("line"))
    return drop_blocks(lines, line == ":PROPERTIES:", line == ":END:", key).where(~F.col("line").rlike(r"^#\+HWPX:"))
