"""Counts and reports over collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def tag_counts(tags: DataFrame, tag: str = "tag") -> DataFrame:
    """(tag, n)"""
    return tags.groupBy(tag).agg(F.count("*").alias("n"))


def pair_counts(tags: DataFrame, group: str, tag: str = "tag") -> DataFrame:
    """(a, b, n): groups that hold both tags, a before b.

    Pairs are made inside one group's distinct tags, so a row holds a group's tags at most.
    """
    sets = tags.groupBy(group).agg(F.array_sort(F.collect_set(tag)).alias("all"))
    pairs = F.flatten(F.transform("all", lambda a, i: F.transform(F.slice("all", i + 2, F.greatest(F.size("all") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def top(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of a total order: a top-k, never a full sort."""
    return rows.orderBy(*order).limit(k)


def top_per_group(rows: DataFrame, group: list[str], k: int, *order) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("nth") <= k)


def date_tree(rows: DataFrame, ts: Column) -> DataFrame:
    """(year, month, day, n), newest first; rows whose time can't be read are left out."""
    at = rows.select(F.try_to_timestamp(ts.cast("string")).alias("at")).where("at IS NOT NULL")
    return at.groupBy(F.year("at").alias("year"), F.month("at").alias("month"), F.dayofmonth("at").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("year"), F.desc("month"), F.desc("day"))


def corpus_totals(tags: DataFrame, group: str, tag: str, noise: Column) -> DataFrame:
    """Groups with tags, unique clean tags, raw, clean and noise counts."""
    return tags.agg(
        F.countDistinct(F.when(~noise, F.col(group))).alias("groups"),
        F.countDistinct(F.when(~noise, F.col(tag))).alias("unique_tags"),
        F.count("*").alias("raw"),
        F.count_if(~noise).alias("clean"),
        F.count_if(noise).alias("noise"),
    )


def integrity(status: DataFrame, column: str = "status") -> DataFrame:
    """One row: counts by status and OK or ISSUES."""
    counts = status.agg(*(F.count_if(F.col(column) == s).alias(s) for s in ("matched", "missing", "orphan")))
    return counts.withColumn("verdict", F.when((F.col("missing") == 0) & (F.col("orphan") == 0), F.lit("OK")).otherwise(F.lit("ISSUES")))


def first_of_best(rows: DataFrame, group: list[str], score: str, order: str) -> DataFrame:
    """The row with the highest score of each group, the first by order on ties."""
    return top_per_group(rows, group, 1, F.desc(score), F.asc(order)).drop("nth")


def fixed_counts(rows: DataFrame, value: str, order: tuple[str, ...]) -> DataFrame:
    """(place, value, n) for each of the values in their fixed order, 0 for those that no row has."""
    known = rows.sparkSession.createDataFrame(list(enumerate(order)), f"place int, `{value}` string")
    counted = rows.where(F.col(value).isin(*order)).groupBy(value).agg(F.count("*").alias("n"))
    return known.join(counted, value, "left").select("place", value, F.coalesce("n", F.lit(0)).alias("n"))


def by_number(rows: DataFrame, key: str) -> DataFrame:
    """Sorted by a key of digits as a number; keys that are none come last."""
    return rows.orderBy(F.expr(f"try_cast(`{key}` AS decimal(38, 0))").asc_nulls_last(), key)
