"""Rewriting outlines: levels, templates, chapters, date trees, seams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.markup import org_body, seam, title_line
from ..functions.rx import strip, sub
from . import lines as L


def merged_title(parent: Column, child: Column) -> Column:
    """'Parent: child'; a repeated parent at the start goes, and 'a: b' becomes 'a — b'."""
    bare = F.when(F.startswith(child, F.concat(parent, F.lit(" "))), F.substring(child, F.length(parent) + 2, F.length(child))).otherwise(child)
    p = r"^([^:]+):\s*(.+)"
    tail = F.when(bare.rlike(p), F.concat(strip(F.regexp_extract(bare, p, 1)), F.lit(" — "), strip(F.regexp_extract(bare, p, 2)))).otherwise(bare)
    return F.concat(parent, F.lit(": "), tail)


def merge_levels(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lift level-6 items '· …' to level 5.

    A level-5 parent without own text and without a colon is merged into its
    children's titles and goes, with its drawer and blank lines; other children
    only change their level.  'H:6' in an options line becomes 'H:5'.
    """
    rows = L.explode_lines(docs, key, text)
    level = F.length(F.regexp_extract("line", r"^(\*+)\s+\S", 1))
    bare = F.trim("line")
    rows = rows.withColumn("level", level)
    order = W.partitionBy(key).orderBy("pos")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    # The nearest heading of level five or less before each line.
    top = F.struct("pos", "level", "line")
    rows = rows.withColumn("up", F.last(F.when(F.col("level").between(1, 5), top), ignorenulls=True).over(before))
    rows = rows.withColumn("drawer", F.last(F.when(bare == ":PROPERTIES:", F.lit(1)).when((bare == ":END:") | (F.col("level") > 0), F.lit(0)), ignorenulls=True).over(upto))
    own = (F.col("level") == 0) & (bare != "") & ~F.startswith(bare, F.lit("#")) & (F.coalesce("drawer", F.lit(0)) == 0) & (bare != ":END:")
    parent = W.partitionBy(key, "up.pos")
    kids = F.min(F.when((F.col("level") == 6) & (F.col("up.level") == 5), F.col("pos"))).over(parent)
    body = F.min(F.when(own, F.col("pos"))).over(parent)
    name = sub(sub(F.col("up.line"), r"^\*+\s+", ""), r"^-\s*", "")
    rows = rows.withColumn("merged", kids.isNotNull() & (body.isNull() | (body > kids)) & ~F.contains(name, F.lit(":"))).withColumn("name", strip(name))
    # A merged parent knows itself through the lines below it.
    rows = rows.withColumn("gone", (F.col("level") == 5) & F.coalesce(F.lead("merged").over(order) & (F.lead("up.pos").over(order) == F.col("pos")), F.lit(False)))
    head = F.col("merged") & (F.col("level") == 0) & ((bare == "") | F.startswith(bare, F.lit(":")))
    first_other = F.min(F.when(~head, F.col("pos"))).over(parent)
    rows = rows.withColumn("gone", F.col("gone") | (head & (F.coalesce(first_other, F.lit(1 << 30)) > F.col("pos"))))
    item = r"^\*{6}\s+·(.+)$"
    child = strip(F.regexp_extract("line", item, 1))
    lifted = F.when(F.col("line").rlike(item), F.concat(F.lit("***** - "), F.when(F.coalesce(F.col("merged"), F.lit(False)), merged_title(F.col("name"), child)).otherwise(child)))
    options = F.when(F.col("line").rlike(r"(?i)^#\+options:"), F.replace(F.col("line"), F.lit("H:6"), F.lit("H:5")))
    return rows.where("NOT gone").select(key, "pos", F.coalesce(lifted, options, F.col("line")).alias("line"))


def fill_template(slots: DataFrame, content: DataFrame, group: str = "section") -> DataFrame:
    """Placeholders by paragraphs in order: (group, nth, slot, text, status).

    slots: group, pos, slot.  content: group, pos, text.  A slot without a
    paragraph keeps its own text, status "short"; paragraphs beyond the slots follow as "extra".
    """
    a = slots.withColumn("nth", F.row_number().over(W.partitionBy(group).orderBy("pos"))).select(group, "nth", "slot")
    b = content.withColumn("nth", F.row_number().over(W.partitionBy(group).orderBy("pos"))).select(group, "nth", "text")
    status = F.when(F.col("slot").isNull(), F.lit("extra")).when(F.col("text").isNull(), F.lit("short")).otherwise(F.lit("filled"))
    return a.join(b, [group, "nth"], "full").select(group, "nth", "slot", F.coalesce("text", "slot").alias("text"), status.alias("status"))


def date_tree_lines(posts: DataFrame) -> DataFrame:
    """An outline of posts by year, month and day, newest day first, a day's posts in time order.

    posts: id, ts (ISO text), text, permalink, media_type.  Posts whose time can't be read are left out.
    Returns (ord array, line); order by ord and the lines are the document.
    """
    rows = posts.withColumn("at", F.try_to_timestamp("ts")).where("at IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("(내용 없음)")))
    y, m, d = F.year("at"), F.month("at"), F.dayofmonth("at")

    def place(month=0, day=0, kind=0, ts="", post=""):
        return F.array(F.lpad((-y + 9999).cast("string"), 4, "0"), F.lpad((F.lit(13) - month if not isinstance(month, int) else F.lit(0)).cast("string"), 2, "0"), F.lpad((F.lit(32) - day if not isinstance(day, int) else F.lit(0)).cast("string"), 2, "0"), F.lit(str(kind)), F.lit(ts) if isinstance(ts, str) else ts, F.lit(post) if isinstance(post, str) else post)

    ym = F.date_format("at", "yyyy-MM")
    years = rows.select(place().alias("ord"), F.concat(F.lit("* "), y.cast("string")).alias("line")).distinct()
    months = rows.select(place(m).alias("ord"), F.concat(F.lit("** "), ym, F.lit(" "), F.date_format("at", "MMMM")).alias("line")).distinct()
    days = rows.select(place(m, d).alias("ord"), F.concat(F.lit("*** "), F.date_format("at", "yyyy-MM-dd"), F.lit(" "), F.date_format("at", "EEEE")).alias("line")).distinct()
    entry = F.concat(
        F.lit("**** "), F.date_format("at", "HH:mm"), F.lit(" - "), title_line(strip(F.col("text"))),
        F.lit("\n:PROPERTIES:\n:POST_ID: "), F.col("id").cast("string"), F.lit("\n:TIMESTAMP: "), F.col("ts"), F.lit("\n:END:\n["), F.date_format("at", "yyyy-MM-dd EEE HH:mm"), F.lit("]\n\n"), org_body(strip(F.col("text"))),
    )
    entries = rows.select(place(m, d, 1, F.col("ts"), F.col("id").cast("string")).alias("ord"), entry.alias("line"))
    return years.unionByName(months).unionByName(days).unionByName(entries)


def apply_seams(texts: DataFrame, splits: DataFrame, key: str = "doc_id", classes: tuple[str, ...] = ("page_boundary", "samepage_break")) -> DataFrame:
    """Join split paragraphs in their order: (key, text, merged, skipped, missed).

    texts: key, text with paragraphs apart by a blank line.  splits: key, pos,
    class, tail, head.  A seam is applied where tail, blank line and head stand exactly once.
    """
    decided = splits.where(F.col("class").isin(*classes)).select(key, "pos", "tail", "head", seam(F.col("tail"), F.col("head"))["seam"].alias("seam"))
    lists = decided.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "tail", "head", "seam"))).alias("seams"))

    def run(batches):
        for pdf in batches:
            out = []
            for k, text, seams in zip(pdf[key], pdf["text"], pdf["seams"], strict=True):
                counts = {"merged": 0, "skipped": 0, "missed": 0}
                for s in seams if seams is not None else ():
                    joint = f"{s['tail']}\n\n{s['head']}"
                    if s["seam"] == "skip":
                        counts["skipped"] += 1
                    elif text.count(joint) != 1:
                        counts["missed"] += 1
                    else:
                        text = text.replace(joint, s["tail"] + (" " if s["seam"] == "space" else "") + s["head"])
                        counts["merged"] += 1
                out.append((k, text, *counts.values()))
            yield pd.DataFrame(out, columns=[key, "text", "merged", "skipped", "missed"])

    kind = dict(texts.dtypes)[key]
    return texts.join(lists, key, "left").select(key, "text", "seams").mapInPandas(run, f"{key} {kind}, text string, merged long, skipped long, missed long")


def body_bounds(blocks: DataFrame, start: str, back: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """(key, lo, hi): positions of the body, from the start mark to the back matter.

    The back matter begins at a heading of its titles, else at the first block of
    the first page that bears one of them as a plain line.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    lo = F.coalesce(F.min(F.when(F.startswith(text, F.lit(start)), F.col("pos"))), F.min("pos"))
    begun = blocks.groupBy(key).agg(lo.alias("lo"), (F.max("pos") + 1).alias("end"))
    titled = F.coalesce("text_level", F.lit(0)) > 0
    opens = F.lit(False)
    for b in back:
        opens = opens | F.startswith(text, F.lit(b))
    later = blocks.join(begun, key).where("pos > lo")
    hit = later.groupBy(key).agg(F.min(F.when(titled & opens, F.col("pos"))).alias("heading"), F.min(F.when(text.isin(*back), F.col("page"))).alias("back_page"))
    paged = later.join(hit, key).where("page = back_page").groupBy(key).agg(F.min("pos").alias("fallback"))
    return begun.join(hit, key, "left").join(paged, key, "left").select(key, "lo", F.coalesce("heading", "fallback", "end").alias("hi"))
