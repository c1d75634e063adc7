"""Parsing documents into records: tabs, blocks, tables, front matter, outlines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.functions import udtf

from ..functions.rx import SPACE, strip, sub
from . import lines as L

_TAB = r"^--- TAB:(\s*)(.+?)(?:\s*\(\s*ID:\s*([^)]+?)\s*\))?\s*---$"


def split_tabs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tabs of an exported document: key, idx, name, tab_id, depth, line_start, line_end, content.

    A tab begins at a marker line; four blanks of indent after the colon, besides
    the one that always stands there, are a level.  Text before the first marker is left out.
    """
    rows = L.explode_lines(docs, key, text).withColumn("mark", F.col("line").rlike(_TAB))
    rows = L.islands(rows, F.col("mark"), "idx", key).where("idx > 0")
    head = F.max(F.when(F.col("mark"), F.struct("line", "pos")))
    body = F.array_sort(F.collect_list(F.when(~F.col("mark"), F.struct("pos", "line"))))
    packed = rows.groupBy(key, "idx").agg(head.alias("head"), body.alias("body"), F.max("pos").alias("last"))

    def part(k):
        return F.regexp_extract("head.line", _TAB, k)

    return packed.select(
        key,
        "idx",
        strip(part(2)).alias("name"),
        F.nullif(strip(part(3)), F.lit("")).alias("tab_id"),
        F.floor(F.greatest(F.length(part(1)), F.lit(0)) / 4).cast("int").alias("depth"),
        (F.col("head.pos") + 2).alias("line_start"),
        (F.col("last") + 1).alias("line_end"),
        F.array_join(F.transform("body", lambda x: x["line"]), "\n").alias("content"),
    )


def subtree(tabs: DataFrame, title: str, key: str = "doc_id") -> DataFrame:
    """The first tab whose name contains ``title``, and the deeper ones that follow it."""
    every = W.partitionBy(key)
    root = F.min(F.when(F.contains(F.lower("name"), F.lit(title.lower())), F.struct("idx", "depth"))).over(every)
    rows = tabs.withColumn("_root", root).where("_root IS NOT NULL")
    stop = F.min(F.when((F.col("idx") > F.col("_root.idx")) & (F.col("depth") <= F.col("_root.depth")), F.col("idx"))).over(every)
    return rows.withColumn("_stop", stop).where("idx >= _root.idx AND (_stop IS NULL OR idx < _stop)").drop("_root", "_stop")


_GROUNDED = r"^(\w+)\[\[\s*(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\s*\]\]$"


def grounded_blocks(pages: DataFrame, key: str = "page", text: str = "raw") -> DataFrame:
    """Blocks of recognised pages: key, idx, label, x1..y2 (null without a box), text.

    A line ``label[[x1,y1,x2,y2]]`` begins a block; text before the first is a block of its own.
    Blocks without text are left out, but for images.
    """
    rows = L.explode_lines(pages, key, text).withColumn("mark", F.trim("line").rlike(_GROUNDED))
    rows = L.islands(rows, F.col("mark"), "idx", key)
    head = F.max(F.when(F.col("mark"), F.trim("line")))
    body = F.array_sort(F.collect_list(F.when(~F.col("mark"), F.struct("pos", "line"))))
    packed = rows.groupBy(key, "idx").agg(head.alias("head"), body.alias("body"))
    box = [F.nullif(F.regexp_extract("head", _GROUNDED, k), F.lit("")).cast("int").alias(n) for k, n in ((2, "x1"), (3, "y1"), (4, "x2"), (5, "y2"))]
    label = F.coalesce(F.regexp_extract("head", _GROUNDED, 1), F.lit("text")).alias("label")
    out = packed.select(key, "idx", label, *box, strip(F.array_join(F.transform("body", lambda x: x["line"]), "\n")).alias("text"))
    return out.where("text <> '' OR label = 'image'")


def front_matter(text: Column) -> dict[str, Column]:
    """The key: value lines between the leading --- lines, as a map, and the text behind them."""
    pattern = r"(?sd)^---\n(.*?)\n---\n?"
    block = F.regexp_extract(text, pattern, 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), sub(F.trim(sub(x, r"^[^:]*:", "")), r'^"(.*)"$', "$1").alias("v")))
    keys = F.transform(entries, lambda e: e["k"])
    last = F.filter(entries, lambda e, i: F.array_position(F.slice(keys, i + 2, F.size(keys)), e["k"]) == 0)
    return {"meta": F.map_from_entries(last), "body": sub(text, pattern, "")}


def section(text: Column, title: str, level: int = 2) -> Column:
    """The text under a heading up to the next of its level, or null."""
    marks = "#" * level
    found = F.regexp_extract(text, rf"(?smd)^{marks} {title}[ \t]*\n(.*?)(?=^{marks} |\z)", 1)
    return F.nullif(strip(found), F.lit(""))


_CELL = r"^(?:(\d+)?(?:\.(\d+))?\+)?\|"


def adoc_cells(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cells of AsciiDoc table lines: key, pos, ord, text, colspan, rowspan.

    Several cells may stand on a line; ``2+|``, ``.3+|`` and ``2.3+|`` span columns and rows, ``\\|`` is a sign.
    """
    rows = lines.where(F.trim("line").rlike(_CELL))
    safe = F.replace(F.trim("line"), F.lit("\\|"), F.lit("\u0001"))
    spans = F.regexp_extract_all(safe, F.lit(r"(?:^|\s)((?:\d+)?(?:\.\d+)?\+)?\|([^|]*?)(?=(?:\s(?:(?:\d+)?(?:\.\d+)?\+)?\|)|$)"), F.lit(1))
    texts = F.regexp_extract_all(safe, F.lit(r"(?:^|\s)((?:\d+)?(?:\.\d+)?\+)?\|([^|]*?)(?=(?:\s(?:(?:\d+)?(?:\.\d+)?\+)?\|)|$)"), F.lit(2))
    cells = rows.select(key, "pos", F.posexplode(F.arrays_zip(spans.alias("s"), texts.alias("t"))).alias("ord", "c"))
    col = F.coalesce(F.nullif(F.regexp_extract("c.s", r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    row = F.coalesce(F.nullif(F.regexp_extract("c.s", r"\.(\d+)\+", 1), F.lit("")).cast("int"), F.lit(1))
    return cells.select(key, "pos", "ord", F.replace(F.trim(F.col("c.t")), F.lit("\u0001"), F.lit("|")).alias("text"), col.alias("colspan"), row.alias("rowspan"))


# What an Org outline consists of: a block with its end, a heading with its drawer, or a line.
_BLANK = r"[^\S\n]"
ORG_BLOCK = rf"{_BLANK}*#\+BEGIN_(\S*)[^\n]*(?:\n(?s:.*?)(?:^{_BLANK}*#\+END_\1[^\n]*$|\z)|\z)"
ORG_HEADING = rf"\*+{_BLANK}+[^\n]+(?:\n{_BLANK}*:PROPERTIES:{_BLANK}*$(?s:.*?)(?:^{_BLANK}*:END:{_BLANK}*$|\z))?"
ORG_TOKEN = rf"(?md)^(?:{ORG_BLOCK}|{ORG_HEADING}|[^\n]+)"
ORG_NUMBER = r"(?md)^\s*:HWPX_IDX:\s*(\d+)"


def org_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, token, kind): the tokens of Org texts in order; blank lines are none.

    kind: block, heading, paragraph, or title, date, number, directive, which are no elements.
    A text's tokens follow one another where the text was."""
    # Spark would test the size of what is exploded first, and search each text once more for each test.
    rows = docs.select(key, F.posexplode_outer(F.regexp_extract_all(text, F.lit(ORG_TOKEN), F.lit(0))).alias("pos", "token"))
    t = F.col("token")
    kind = (
        F.when(t.rlike(r"^#\+TITLE:"), "title").when(t.rlike(r"^#\+DATE:"), "date").when(t.rlike(r"^#\+HWPX:\s*\d"), "number")
        .when(t.rlike(rf"^{_BLANK}*#\+BEGIN_"), "block").when(t.startswith("#+"), "directive").when(t.rlike(rf"^\*+{_BLANK}+[^\n]"), "heading").otherwise("paragraph")
    )
    return rows.withColumn("kind", kind).where((F.col("kind") == "block") | (strip(t) != ""))


def org_elements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Elements of Org outlines: key, pos, kind, level (0 if no heading), title, number, parent, nth, parent_nth.

    title: a heading's or paragraph's text, a block as it stands.  number: a heading's from
    its drawer, another element's from the '#+HWPX:' line between it and the element before.
    parent: the position of the nearest heading above of a lower level; for what is no
    heading the nearest heading.  nth and parent_nth number the elements from 1.  In the order
    of pos this is the tree in preorder.  Null texts have no elements.
    A text's tokens are read in a stream where the text is, with the open headings at hand."""
    # Keys may be null: a text is told by its row.
    rows = org_tokens(docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key")).alias("_at"), text), "_at", text)
    rows = rows.where("kind NOT IN ('title', 'date', 'directive')")
    told = F.when(F.col("kind") == "number", F.regexp_extract("token", r"^#\+HWPX:\s*(\d+)", 1).cast("int"))
    is_heading = F.col("kind") == "heading"
    own = F.try_element_at(F.regexp_extract_all("token", F.lit(ORG_NUMBER), F.lit(1)), F.lit(-1)).cast("int")
    title = F.when(is_heading, F.regexp_extract("token", r"^\*+\s+([^\n]+)", 1)).when(F.col("kind") == "paragraph", strip(F.col("token"))).otherwise(F.col("token"))
    level = F.when(is_heading, F.length(F.regexp_extract("token", r"^(\*+)", 1))).otherwise(F.lit(0))
    rows = rows.select(F.col("_at.key").alias(key), "pos", "kind", level.alias("level"), title.alias("title"), F.when(is_heading, own).otherwise(told).alias("number"), F.col("_at.row").alias("_row"))
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("pos int, kind string, level int, title string, number int, parent int, nth int, parent_nth int").fields])

    def run(batches):
        before, nth, number, open_ = None, 0, None, []
        for batch in batches:
            kept, numbers, parents, nths, parent_nths = [], [], [], [], []
            for row, pos, kind, depth, given in zip(*(batch.column(c).to_pylist() for c in ("_row", "pos", "kind", "level", "number")), strict=True):
                if row != before:
                    before, nth, number, open_ = row, 0, None, []
                kept.append(kind != "number")
                if kind == "number":
                    number = number if given is None else given
                    continue
                nth += 1
                while depth and open_ and open_[-1][0] >= depth:
                    open_.pop()
                _, parent, parent_nth = open_[-1] if open_ else (0, None, None)
                numbers.append(given if depth else number)
                parents.append(parent)
                nths.append(nth)
                parent_nths.append(parent_nth)
                if depth:
                    open_.append((depth, pos, nth))
                number = None
            own = batch.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(5)), *(pa.array(c, pa.int32()) for c in (numbers, parents, nths, parent_nths))], schema.names)

    return rows.mapInArrow(run, schema)


def org_meta(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, title, date of Org texts: the last lines of their kind, '' if there is none."""
    rows = org_tokens(docs, key, text)
    last = [F.coalesce(F.max_by(F.when(F.col("kind") == k, strip(sub(F.col("token"), r"^#\+[A-Z]+:", ""))), F.when(F.col("kind") == k, F.col("pos"))), F.lit("")).alias(k) for k in ("title", "date")]
    return docs.select(key).distinct().join(rows.groupBy(key).agg(*last), key, "left").select(key, *(F.coalesce(k, F.lit("")).alias(k) for k in ("title", "date")))


@udtf(returnType="idx int, kind string, level int, text string, extra string")
class MarkdownBlocks:
    """Blocks of a Markdown text in one pass; a block ends where another kind begins.

    Kinds: heading, comment, rule, code, table, quote, image, list, paragraph.  A
    table needs two lines; an image takes a '<caption>' from the next line.
    """

    def eval(self, text: str):
        import re

        if text is None:
            return
        rows = text.split("\n")
        out: list[tuple] = []
        paragraph: list[str] = []

        def end():
            if paragraph:
                out.append(("paragraph", 0, " ".join(paragraph), None))
                paragraph.clear()

        def run(at, test):
            stop = at
            while stop < len(rows) and test(rows[stop]):
                stop += 1
            return stop

        at = 0
        while at < len(rows):
            bare = rows[at].strip()
            heading = re.match(r"(#{1,6})\s+(.*)", bare)
            image = re.fullmatch(r"!\[([^\]]*)\]\(([^)]+)\)", bare)
            stop = at + 1
            if not bare:
                end()
            elif bare.startswith("<!--"):
                end()
                while "-->" not in rows[stop - 1] and stop < len(rows):
                    stop += 1
                out.append(("comment", 0, "\n".join(rows[at:stop]).strip(), None))
            elif bare.startswith("```"):
                end()
                stop = run(stop, lambda r: not r.strip().startswith("```"))
                out.append(("code", 0, "\n".join(rows[at + 1 : stop]), bare[3:].strip() or None))
                stop += 1
            elif heading:
                end()
                out.append(("heading", len(heading[1]), heading[2].strip(), None))
            elif re.fullmatch(r"-{3,}|\*{3,}|_{3,}", bare):
                end()
                out.append(("rule", 0, "", None))
            elif bare.startswith("|"):
                end()
                stop = run(at, lambda r: r.strip().startswith("|"))
                if stop - at > 1:
                    out.append(("table", stop - at, "\n".join(r.strip() for r in rows[at:stop]), None))
            elif bare.startswith(">"):
                end()
                stop = run(at, lambda r: r.strip().startswith(">"))
                out.append(("quote", 0, "\n".join(r.strip()[1:].strip() for r in rows[at:stop]), None))
            elif image:
                end()
                after = rows[stop].strip() if stop < len(rows) else ""
                caption = re.fullmatch(r"<([^>]+)>", after)
                out.append(("image", 0, image[2], caption[1] if caption else image[1] or None))
                stop += bool(caption)
            elif re.match(r"([-*+]|\d+\.)\s+", bare):
                end()
                out.append(("list", (len(rows[at]) - len(rows[at].lstrip())) // 2, re.sub(r"^([-*+]|\d+\.)\s+", "", bare), None))
            else:
                paragraph.append(bare)
            at = stop
        end()
        for k, row in enumerate(out):
            yield (k, *row)


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the blocks of each document."""
    spark = docs.sparkSession
    spark.udtf.register("markdown_blocks", MarkdownBlocks)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return spark.sql("SELECT d.k, b.* FROM {rows} d, LATERAL markdown_blocks(d.t) b", rows=rows).withColumnRenamed("k", key)


def layout_splits(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraphs that a page break or an inserted block has split: key, pos, class, tail, head.

    blocks: key, pos, type, text, text_level, page.  Open text is followed, skipping
    page furniture, figures and the like, by text that goes on.
    """
    skipped = F.col("type").isin("page_number", "header", "footer", "image", "equation", "table", "chart")
    # The kinds between two kept blocks: counted up to each, so a difference tells them.
    upto = W.partitionBy(key).orderBy("pos")
    counted = blocks.withColumns({f"n_{k}": F.count_if(F.col("type").isin(*kinds)).over(upto) for k, kinds in (("image", ("image",)), ("eq", ("equation",)), ("table", ("table", "chart")))})
    kept = counted.where(~skipped)
    following = {f"b_{c}": F.lead(c).over(upto) for c in ("type", "text", "text_level", "page", "n_image", "n_eq", "n_table")}
    pairs = kept.withColumns(following)
    tail, head = sub(F.col("text"), rf"{SPACE}+\z", ""), sub(F.col("b_text"), rf"^{SPACE}+", "")
    plain = (F.col("type") == "text") & F.coalesce(F.col("text_level"), F.lit(0)).eqNullSafe(0) & (F.col("b_type") == "text") & F.coalesce(F.col("b_text_level"), F.lit(0)).eqNullSafe(0)
    goes_on = (tail != "") & ~tail.rlike(r"""[.!?…。」』）)\]"'”’]\z""") & (head != "") & ~head.rlike(r"^[*#-]")
    kind = (
        F.when(F.col("b_n_image") > F.col("n_image"), "image_interrupt")
        .when(F.col("b_n_eq") > F.col("n_eq"), "eq_interrupt")
        .when(F.col("b_n_table") > F.col("n_table"), "table_interrupt")
        .when(F.col("page") != F.col("b_page"), "page_boundary")
        .otherwise("samepage_break")
    )
    return pairs.where(plain & goes_on).select(key, "pos", kind.alias("class"), tail.alias("tail"), head.alias("head"))
