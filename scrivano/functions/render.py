"""Rendering records as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import bib_key, bib_text


def front_matter(fields: dict[str, Column], body: Column) -> Column:
    """--- lines with one 'key: value' a line, null values left out, then the body."""
    lines = F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items())))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), body)


def indexed_name(idx: Column, name: Column) -> Column:
    return F.format_string("%02d--%s.md", idx, name)


def org_document(title: Column, date: Column, tags: Column, source: Column, blocks: Column) -> Column:
    """An Org document: header lines, then text blocks and image links in order.

    blocks: array of struct(type, data).
    """
    tag_line = F.when(F.size(tags) > 0, F.concat(F.lit("#+filetags: :"), F.array_join(tags, ":"), F.lit(":\n"))).otherwise(F.lit(""))
    parts = F.transform(blocks, lambda b: F.when(b["type"] == "image", F.concat(F.lit("[[file:"), b["data"], F.lit("]]"))).otherwise(b["data"]))
    return F.concat(F.lit("#+title: "), title, F.lit("\n#+date: "), date, F.lit("\n"), tag_line, F.lit("#+source: "), source, F.lit("\n\n"), F.array_join(parts, "\n\n"), F.lit("\n"))


def bibtex(full_name: Column, owner: Column, url: Column, starred: Column, description: Column, topics: Column, stars: Column, language: Column) -> Column:
    """A software entry."""
    fields = [
        ("title", full_name),
        ("author", owner),
        ("url", url),
        ("urldate", F.split_part(starred, F.lit("T"), F.lit(1))),
        ("abstract", bib_text(description)),
        ("keywords", F.coalesce(F.array_join(topics, ", "), F.lit(""))),
        ("note", F.concat(F.lit("stars: "), stars.cast("string"), F.lit(", language: "), F.coalesce(language, F.lit("unknown")))),
    ]
    lines = F.array_join(F.array(*(F.concat(F.lit(f"  {k} = {{"), v, F.lit("}")) for k, v in fields)), ",\n")
    return F.concat(F.lit("@software{"), bib_key(full_name), F.lit(",\n"), lines, F.lit("\n}\n"))


def adoc_table(cells: DataFrame, table: str = "table_id") -> DataFrame:
    """AsciiDoc tables from (table, row, ord, text, colspan, rowspan): a line for each cell, a
    blank line after each row.  A table has as many columns as its widest row has spans."""
    col, row = F.col("colspan"), F.col("rowspan")
    span = F.concat(F.when(col > 1, col.cast("string")).otherwise(F.lit("")), F.when(row > 1, F.concat(F.lit("."), row.cast("string"))).otherwise(F.lit("")))
    # A newline in a cell is a hard break.
    cell = F.concat(span, F.when(span != "", F.lit("+")).otherwise(F.lit("")), F.lit("| "), F.replace(F.col("text"), F.lit("\n"), F.lit(" +\n")), F.lit("\n"))
    rows = cells.groupBy(table, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", cell.alias("c")))), lambda x: x["c"]), "").alias("lines"), F.sum(F.greatest(col, F.lit(1))).alias("wide"))
    packed = rows.groupBy(table).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "lines"))), lambda x: x["lines"]), "\n").alias("body"), F.max("wide").alias("wide"))
    head = F.concat(F.lit('[cols="'), F.array_join(F.array_repeat(F.lit("1"), F.col("wide").cast("int")), ","), F.lit('"]\n|===\n'))
    return packed.select(table, F.concat(head, F.col("body"), F.lit("\n|===")).alias("text"))


# Publishing surfaces (key, class, character limit, summary language, link rule).
PLATFORMS = (
    ("facebook", "raw", 63206, None, "post"),
    ("linkedin", "raw", 3000, None, "comment"),
    ("naver", "full", None, None, "top+bottom"),
    ("tistory", "full", None, None, "top+bottom"),
    ("threads", "summary", 500, "ko", "post"),
    ("twitter", "summary", 280, "ko", "post"),
    ("bluesky", "summary", 300, "en", "post"),
    ("instagram", "summary", 2200, "ko", "bio"),
)


def bundle(notes: DataFrame, key: str = "note_id") -> DataFrame:
    """A row for each note and surface: body, n_chars, over (characters beyond the limit, or null), comment.

    notes: key, original, commentary, ko, en, url.  The surfaces are eight rows of constants.
    """
    surfaces = F.array(*(F.struct(F.lit(k).alias("platform"), F.lit(c).alias("cls"), F.lit(n).cast("int").alias("max_chars"), F.lit(g).cast("string").alias("lang"), F.lit(r).alias("rule")) for k, c, n, g, r in PLATFORMS))
    rows = notes.select("*", F.explode(surfaces).alias("p")).select(*notes.columns, "p.*")
    link = F.when(F.coalesce("url", F.lit("")) == "", F.lit("(링크 없음)")).otherwise(F.concat(F.lit("🔗 "), F.col("url")))
    gap = F.lit("\n\n")
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("original", "commentary", "ko", "en")}
    raw = F.when(F.col("rule") == "comment", text["original"]).otherwise(F.concat(text["original"], gap, link))
    full = F.concat_ws("\n\n", F.nullif(text["commentary"], F.lit("")), F.when(text["original"] != "", F.concat(F.lit("─── 원문 ───\n\n"), text["original"])), link)
    brief = F.coalesce(F.nullif(F.when(F.col("lang") == "en", text["en"]).otherwise(text["ko"]), F.lit("")), F.nullif(text["ko"], F.lit("")), F.lit("(요약 없음)"))
    summary = F.concat(brief, gap, link, F.when(F.col("rule") == "bio", F.lit("\n(링크는 프로필 참조)")).otherwise(F.lit("")))
    body = F.when(F.col("cls") == "raw", raw).when(F.col("cls") == "full", full).otherwise(summary)
    out = rows.withColumn("body", body).withColumn("n_chars", F.length("body").cast("long"))
    over = F.when(F.col("n_chars") > F.col("max_chars"), F.col("n_chars") - F.col("max_chars"))
    return out.select(key, "platform", "body", "n_chars", over.alias("over"), F.when(F.col("rule") == "comment", link).alias("comment"))
