"""Recognised books: the heading hierarchy that a flat transcript has lost.

A transcript is a (key, pos, line) table in which every heading is '# text'.  What
must be decided line by line comes from windows over the non-blank lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rx import strip, sub

# Section numbers, covers that hold a number only, and what looks like a heading but is none.
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8", "IX": "9", "X": "10"}
NUMBER = r"^(I|II|III|IV|V|VI|VII|VIII|IX|X|\d+)\.?$"
PLAIN_CHAPTER = r"^\d+장$"
COVER = r"^(제?\s*\d+강|막간\s*\d+)$"
ITEM = r"^\(\d+\)"
FALSE = r"^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫]|^[<〈].*[>〉]$|^[A-Z]( [A-Z])+$|^[가-힣]$"
INDEX, PREFACE = "찾아보기", "책머리에"


def _looked_up(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")


def chapters(lines: DataFrame, titles: dict[str, str], variants: dict[str, str] | None = None, back: tuple[str, ...] = (INDEX,), start: str | None = None, key: str = "doc_id") -> DataFrame:
    """Two-level books: (key, pos, kind, line) with '* chapter', '** section', '*** item'.

    titles: chapter title -> number; variants: other spellings of titles.  What stands before
    the heading ``start`` goes, but for the preface.  A title's first heading is its
    chapter, later ones are sections.  A line 'N장', or a heading that is a section
    number only, takes the next non-blank line as its title.  Headings of covers go, and
    those of the index (single letters); false headings become text.  Titles of
    chapters that look like section numbers are not merged.  kind: preface, text,
    chapter, back, section, item, false.  Null lines count as blank.
    """
    line = F.coalesce(F.col("line"), F.lit(""))
    rows = lines.select(key, "pos", line.alias("line"), strip(line).alias("bare"))
    order = W.partitionBy(key).orderBy("pos")
    is_heading = F.col("line").rlike(r"^#\s+.*\S\s*$")
    rows = rows.withColumn("heading", F.when(is_heading, strip(sub(F.col("line"), r"^#\s+", ""))))
    begins = F.min(F.when(F.col("line").rlike(rf"^#\s+{re.escape(start)}\s*$"), F.col("pos"))).over(W.partitionBy(key)) if start else F.lit(None).cast("int")
    rows = rows.withColumn("begin", F.coalesce(begins, F.lit(-1)))

    # The preface: from its first heading to the next one, of what goes.
    front = rows.where("pos < begin").withColumn("opens", F.col("line").rlike(rf"^#\s+{PREFACE}"))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    front = front.withColumn("nth", F.sum(F.col("line").rlike(r"^#\s+").cast("int")).over(upto))
    first = F.min(F.when(F.col("opens"), F.col("nth"))).over(W.partitionBy(key))
    preface = front.withColumn("first", first).where("nth = first")
    preface = preface.select(key, "pos", F.lit("preface").alias("kind"), F.when(F.col("opens"), F.lit(f"* {PREFACE}")).otherwise(F.col("line")).alias("line"))

    body = rows.where("pos >= begin")
    title = F.coalesce(_looked_up(variants or {}, F.col("heading")), F.col("heading"))
    body = body.withColumn("title", F.when(_looked_up(titles, title).isNotNull(), title))
    filled = body.where("bare <> ''").withColumns({"next": F.lead("line").over(order)})
    number = F.regexp_extract("heading", NUMBER, 1)
    able = F.col("heading").rlike(NUMBER) & F.col("title").isNull() & ~F.col("heading").isin(*back)

    def taking(takes: Column) -> DataFrame:
        """Which lines take the next one: every other line of a run of those that could."""
        could = F.coalesce(takes, F.lit(False)) & F.col("next").isNotNull()
        run = filled.withColumn("could", could).withColumn("run", F.sum((~F.col("could")).cast("int")).over(upto))
        nth = F.row_number().over(W.partitionBy(key, "run", "could").orderBy("pos"))
        run = run.withColumn("takes", F.col("could") & (nth % 2 == 1))
        return run.withColumn("taken", F.coalesce(F.lag("takes").over(order), F.lit(False)))

    plain = F.col("heading").isNull() & F.col("bare").rlike(PLAIN_CHAPTER)
    # Inside the index no heading counts, so it begins where its own heading is nobody's title.
    whole = taking(plain | able)
    if INDEX in back:
        at = whole.where((F.col("heading") == INDEX) & ~F.col("taken")).groupBy(F.col(key).alias("_k")).agg(F.min("pos").alias("index_at"))
        filled = filled.join(at, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    else:
        filled = filled.withColumn("index_at", F.lit(None).cast("int"))
    listed = F.coalesce(F.col("pos") > F.col("index_at"), F.lit(False))
    told = taking(plain | (able & ~listed)).withColumn("listed", listed)
    free = ~F.col("taken") & ~F.col("listed") & ~F.coalesce(F.col("heading").rlike(COVER), F.lit(False))
    seen = F.row_number().over(W.partitionBy(key, "title", "free").orderBy("pos"))
    told = told.withColumn("free", free).withColumn("chapter", F.col("title").isNotNull() & F.col("free") & (seen == 1))

    h = F.col("heading")
    following = strip(sub(F.col("next"), r"^#\s+", ""))
    rules = [
        (F.col("taken"), "gone", F.lit("")),
        (F.col("listed") & h.isNotNull(), "gone", F.lit("")),
        (plain & F.col("takes"), "chapter", F.concat(F.lit("* "), F.col("bare"), F.lit(" "), following)),
        (h.isNull(), "text", F.col("line")),
        (h.rlike(COVER), "gone", F.lit("")),
        (F.col("chapter"), "chapter", F.concat(F.lit("* "), _looked_up(titles, F.col("title")), F.lit(" "), F.col("title"))),
        (h.isin(*back), "back", F.concat(F.lit("* "), h)),
        (F.col("takes"), "section", F.concat(F.lit("** "), F.coalesce(_looked_up(ROMAN, number), number), F.lit(". "), following)),
        (h.rlike(ITEM), "item", F.concat(F.lit("*** "), h)),
        (h.rlike(FALSE), "false", h),
    ]
    kind, out = F.lit("section"), F.concat(F.lit("** "), h)
    for test, k, value in reversed(rules):
        kind, out = F.when(test, F.lit(k)).otherwise(kind), F.when(test, value).otherwise(out)
    done = told.select(key, "pos", kind.alias("kind"), out.alias("line"), "takes")
    # Blank lines between a number and its title go with them.
    blank = body.where("bare = ''").select(key, "pos", F.lit("text").alias("kind"), "line", F.lit(None).cast("boolean").alias("takes"))
    every = done.unionByName(blank).withColumn("after", F.last("takes", ignorenulls=True).over(upto))
    kept = every.where((F.col("kind") != "gone") & (F.col("takes").isNotNull() | ~F.coalesce(F.col("after"), F.lit(False))))
    return preface.unionByName(kept.select(key, "pos", "kind", "line"))


#: Fixed value: a lecture's number, as a heading or as a plain line.
LECTURE = r"^(?:#\s+)?(\d+강)$"
# Headings that are none: items, captions, and what has no Hangul.
NO_HEADING = r"^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫]|^[<〈].*[>〉]$|^[^가-힣]*$"


def lectures(lines: DataFrame, parts: dict[str, str], table: dict[str, tuple[str, str | None]], back: tuple[str, ...] = (INDEX,), start: str | None = None, preface: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """Three-level books: (key, pos, sub, kind, line) with '* part', '** lecture', '*** item'.

    parts: number -> title.  table: lecture number -> (title, part), in the order of the book.
    A line or heading 'N강' is a lecture and takes the next non-blank line; its title is
    the table's, else that line.  A part begins with its first lecture: its heading is made
    before it, with sub 0, the lecture being sub 1.  A part's own heading, one whose next
    heading is a lecture, goes.  After the index's heading all headings go.  False headings
    become text.  What stands before the heading ``start`` goes, but for what follows the
    first heading of ``preface``.  kind: preface, part, lecture, back, item, false, text.
    Null lines count as blank.
    """
    first: dict[str, str] = {}
    begun: set[str] = set()
    for number, (_, part) in table.items():
        if part and part not in begun:
            begun.add(part)
            first[number] = f"* {part} {parts.get(part, '')}"
    line = F.coalesce(F.col("line"), F.lit(""))
    rows = lines.select(key, "pos", line.alias("line"), strip(line).alias("bare"))
    order = W.partitionBy(key).orderBy("pos")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("heading", F.when(F.col("line").rlike(r"^#\s+.*\S\s*$"), strip(sub(F.col("line"), r"^#\s+", ""))))
    begins = F.min(F.when(F.col("line").rlike(rf"^#\s+{re.escape(start)}\s*$"), F.col("pos"))).over(W.partitionBy(key)) if start else F.lit(None).cast("int")
    rows = rows.withColumn("begin", F.coalesce(begins, F.lit(-1)))
    kept_names = F.coalesce(F.col("heading").isin(*preface), F.lit(False)) if preface else F.lit(False)
    front = rows.where("pos < begin").withColumn("since", F.max(kept_names.cast("int")).over(upto)).where("since = 1")
    front_line = F.when(kept_names, F.concat(F.lit("* "), F.col("heading"))).when(F.col("heading").isNotNull(), F.concat(F.lit("** "), F.col("heading"))).otherwise(F.col("line"))
    head = front.select(key, "pos", F.lit(1).alias("sub"), F.lit("preface").alias("kind"), front_line.alias("line"))

    body = rows.where("pos >= begin")
    marked = F.when(F.col("line").rlike(r"^#\s+") | F.col("bare").rlike(r"^\d+강$"), F.col("bare"))
    filled = body.where("bare <> ''").withColumn("next", F.lead("line").over(order))
    filled = filled.withColumn("ahead", F.first(marked, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)))
    filled = filled.withColumn("number", F.nullif(F.regexp_extract("bare", LECTURE, 1), F.lit("")))
    cover = F.coalesce(F.col("heading").isin(*parts.values()) & F.col("ahead").rlike(LECTURE), F.lit(False)) if parts else F.lit(False)

    def taking(could: Column) -> DataFrame:
        """Which lines are lectures, every other one of a run of numbers, and which are taken by the one before."""
        run = filled.withColumn("could", could).withColumn("run", F.sum((~F.col("could")).cast("int")).over(upto))
        nth = F.row_number().over(W.partitionBy(key, "run", "could").orderBy("pos"))
        run = run.withColumn("takes", F.col("could") & (nth % 2 == 1))
        return run.withColumn("taken", F.coalesce(F.lag("takes").over(order), F.lit(False)))

    token = F.col("number").isNotNull()
    listed = F.lit(False)
    if INDEX in back:
        found = taking(token).where((F.col("heading") == INDEX) & ~F.col("taken") & ~cover)
        at = found.groupBy(F.col(key).alias("_k")).agg(F.min("pos").alias("index_at"))
        filled = filled.join(at, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
        listed = F.coalesce(F.col("pos") > F.col("index_at"), F.lit(False)) & F.col("line").rlike(r"^#\s+")
    told = taking(token & ~listed)
    h = F.col("heading")
    title = F.coalesce(_looked_up({k: v[0] for k, v in table.items()}, F.col("number")), strip(sub(F.col("next"), r"^#\s+", "")), F.lit(""))
    part = F.struct(F.lit(0).alias("sub"), F.lit("part").alias("kind"), _looked_up(first, F.col("number")).alias("line"))

    def one(kind: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(1).alias("sub"), F.lit(kind).alias("kind"), value.alias("line")))

    lecture = one("lecture", strip(F.concat(F.lit("** "), F.col("number"), F.lit(" "), title)))
    rules = [
        (F.col("taken") | (listed & ~F.col("taken")), F.slice(lecture, 1, 0)),
        (F.col("takes"), F.when(part["line"].isNotNull(), F.concat(F.array(part), lecture)).otherwise(lecture)),
        (h.isNull(), one("text", F.col("line"))),
        (cover, F.slice(lecture, 1, 0)),
        (h.isin(*back) if back else F.lit(False), one("back", F.concat(F.lit("* "), h))),
        (h.rlike(NO_HEADING), one("false", h)),
    ]
    out = one("item", F.concat(F.lit("*** "), h))
    for test, value in reversed(rules):
        out = F.when(test, value).otherwise(out)
    done = told.select(key, "pos", "takes", out.alias("out"))
    # Blank lines between a lecture's number and its title go with them.
    blank = body.where("bare = ''").select(key, "pos", F.lit(None).cast("boolean").alias("takes"), one("text", F.col("line")).alias("out"))
    every = done.unionByName(blank).withColumn("after", F.last("takes", ignorenulls=True).over(upto))
    every = every.withColumn("more", F.max(F.col("takes").isNotNull().cast("int")).over(order.rowsBetween(1, W.unboundedFollowing)) == 1)
    kept = every.where(F.col("takes").isNotNull() | ~F.coalesce(F.col("after"), F.lit(False)) | ~F.coalesce("more", F.lit(False)))
    return head.unionByName(kept.select(key, "pos", F.explode("out").alias("o")).select(key, "pos", "o.*"))
