"""Converting whole documents: Markdown to Org, structured JSON to Markdown, trees of tabs."""

from __future__ import annotations

import contextlib
import re
from json import loads

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.rx import SPACE, let, strip, sub
from ..functions.web import org_inline
from .automaton import line_states
from .lines import explode_lines
from .pieces import pieces

# States of Markdown: text, a comment over lines, a code block.
TEXT, NOTE, CODE = 0, 1, 2


def markdown_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line, state, after, kind) of each Markdown line.

    kind: blank, rule, heading, begin and end (of code), code, table, quote, text, or null
    for comments.  A fence inside code ends it only if nothing follows it.
    """
    line = F.col("line")
    bare = strip(line)
    one = line.rlike(rf"(?d)^{SPACE}*<!--.*?-->{SPACE}*\z")
    opens = line.rlike(rf"^{SPACE}*<!--") & ~F.contains(line, F.lit("-->"))
    fence, closes = line.startswith("```"), line.rlike(rf"^```{SPACE}*\z")
    step = F.array(F.when(opens, NOTE).when(fence, CODE).otherwise(TEXT), F.when(F.contains(line, F.lit("-->")), TEXT).otherwise(NOTE), F.when(closes, TEXT).otherwise(CODE))
    rows = line_states(explode_lines(docs, key, text), step, 3, key)
    heading = line.rlike(rf"(?d)^#{{1,6}}{SPACE}+.+\z")
    free = F.when(bare == "", "blank").when(one | opens, None).when(bare.rlike(rf"^-{{3,}}{SPACE}*\z"), "rule").when(heading, "heading").when(fence, "begin")
    free = free.when(bare.startswith("|"), "table").when(bare.startswith(">"), "quote").otherwise("text")
    kind = F.when(F.col("state") == CODE, F.when(closes, "end").otherwise("code")).when(F.col("state") == TEXT, free)
    return rows.withColumn("kind", kind)


def org_table_row(row: Column) -> Column:
    """A pipe row in Org: rulers with ten signs a column, marks of other rows converted."""
    ruler = row.rlike(rf"^\|(?:{SPACE}|[-:])+\|\z|^\|(?:{SPACE}*-+{SPACE}*\|)+{SPACE}*\z")
    columns = F.filter(F.split(row, r"\|", -1), lambda c: strip(c) != "")
    return F.when(ruler, F.concat(F.lit("|"), F.array_join(F.transform(columns, lambda c: F.lit("-" * 10)), "+"), F.lit("|"))).otherwise(org_inline(row))


def markdown_to_org(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, org): Markdown documents as Org.  A null text has no row; a code block that never ends is closed."""
    rows = markdown_lines(docs, key, text)
    order = W.partitionBy(key).orderBy("pos")
    kind, line = F.col("kind"), F.col("line")
    lang = F.when(kind == "begin", F.regexp_extract(line, r"^```([\p{L}\p{N}_]*)", 1))
    rows = rows.withColumn("lang", F.last(lang, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.lag("kind").over(order)).withColumn("next", F.lead("kind").over(order)).withColumn("ends", F.lead("pos").over(order).isNull())
    end = F.when(F.col("lang") != "", F.lit("#+END_SRC")).otherwise(F.lit("#+END_EXAMPLE"))
    begin = F.when(F.col("lang") != "", F.concat(F.lit("#+BEGIN_SRC "), F.col("lang"))).otherwise(F.lit("#+BEGIN_EXAMPLE"))
    empty, none = F.lit(""), F.array().cast("array<string>")
    title = strip(F.regexp_extract(line, rf"(?d)^#{{1,6}}{SPACE}+(.+)\z", 1))
    stars = F.repeat(F.lit("*"), F.length(F.regexp_extract(line, "^(#{1,6})", 1)))
    last = F.coalesce(F.col("next") != kind, F.lit(True))
    quote = F.concat(
        F.when(F.coalesce(F.col("before") != kind, F.lit(True)), F.array(F.lit("#+BEGIN_QUOTE"))).otherwise(none),
        F.array(sub(line, rf"^>{SPACE}?", "")),
        F.when(last, F.array(F.lit("#+END_QUOTE"), empty)).otherwise(none),
    )
    out = (
        F.when(kind == "blank", F.array(empty))
        .when(kind == "rule", F.array(F.lit("-----")))
        .when(kind == "heading", F.array(F.concat(stars, F.lit(" "), org_inline(title)), empty))
        .when(kind == "begin", F.array(begin))
        .when(kind == "code", F.array(line))
        .when(kind == "end", F.array(end, empty))
        .when(kind == "table", F.concat(F.array(org_table_row(strip(line))), F.when(last, F.array(empty)).otherwise(none)))
        .when(kind == "quote", quote)
        .when(kind == "text", F.array(org_inline(line)))
        .otherwise(none)
    )
    open_ = F.when(F.col("ends") & (F.col("after") == CODE), F.array(end, empty)).otherwise(none)
    packed = rows.select(key, "pos", F.concat(out, open_).alias("out")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("all"))
    return packed.select(key, F.array_join(F.flatten(F.transform("all", lambda x: x["out"])), "\n").alias("org"))


_RUNS = "elements array<struct<textRun: struct<content: string, textStyle: struct<bold: boolean, italic: boolean, weightedFontFamily: struct<fontFamily: string>, link: struct<url: string>>>>>"
_PARAGRAPH = f"paragraph struct<paragraphStyle: struct<namedStyleType: string>, bullet: struct<listId: string, nestingLevel: int>, {_RUNS}>"
#: What is read of a structured document (names are fixed values of the format).
DOCUMENT = f"body struct<content: array<struct<{_PARAGRAPH}, table: struct<tableRows: array<struct<tableCells: array<struct<content: array<struct<{_PARAGRAPH}>>>>>>>>>>, lists map<string, struct<nestingLevels: array<struct<glyphType: string>>>>"
#: Glyphs of numbered lists, and the font of code (fixed values of the format).
NUMBERED, CODE_FONT = ("DECIMAL", "ALPHA", "ROMAN"), "Courier New"


def run_text(run: Column) -> Column:
    """A run with the marks of its style: bold, italic, code and link, each around what is inside."""
    style = run["textStyle"]
    out = F.coalesce(run["content"], F.lit(""))
    for on, left, right in (
        (style["bold"], F.lit("**"), F.lit("**")),
        (style["italic"], F.lit("*"), F.lit("*")),
        (style["weightedFontFamily"]["fontFamily"] == CODE_FONT, F.lit("`"), F.lit("`")),
        (style["link"].isNotNull(), F.lit("["), F.concat(F.lit("]("), F.coalesce(style["link"]["url"], F.lit("")), F.lit(")"))),
    ):
        out = F.when(F.coalesce(on, F.lit(False)), F.concat(left, strip(out), right)).otherwise(out)
    return out


def paragraph_text(paragraph: Column) -> Column:
    runs = F.filter(F.coalesce(paragraph["elements"], F.array()), lambda e: e["textRun"].isNotNull())
    return strip(F.array_join(F.transform(runs, lambda e: run_text(e["textRun"])), ""))


def table_text(table: Column) -> Column:
    """A table's rows as pipe rows, a ruler after the first; '' without rows."""

    def cell(c):
        return F.array_join(F.transform(F.filter(F.coalesce(c["content"], F.array()), lambda x: x["paragraph"].isNotNull()), lambda x: paragraph_text(x["paragraph"])), " ")

    def row(r, i):
        cells = F.coalesce(r["tableCells"], F.array())
        told = F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))
        return F.when(i == 0, F.concat(told, F.lit("\n|"), F.repeat(F.lit("---|"), F.size(cells)))).otherwise(told)

    return F.array_join(F.transform(F.coalesce(table["tableRows"], F.array()), row), "\n")


def _parts(d: Column) -> Column:
    """The parts of a parsed document in order: kind, level, ordered, text; null kinds for what is no part."""

    def part(e):
        p, bullet = e["paragraph"], e["paragraph"]["bullet"]
        style = F.coalesce(p["paragraphStyle"]["namedStyleType"], F.lit(""))
        item = bullet.isNotNull() & (bullet["listId"].isNotNull() | bullet["nestingLevel"].isNotNull())
        depth = F.coalesce(bullet["nestingLevel"], F.lit(0))
        glyph = F.get(F.try_element_at(d["lists"], bullet["listId"])["nestingLevels"], depth)["glyphType"]
        heading = F.coalesce(F.replace(style, F.lit("HEADING_"), F.lit("")).try_cast("int"), F.lit(1))

        def told(text):
            kind = F.when(p.isNull(), F.when(e["table"].isNotNull(), "table")).when(style.startswith("HEADING"), "heading").when(item, "item").when(text != "", "paragraph")
            return let(kind, lambda k: F.struct(k.alias("kind"), F.when(k == "heading", heading).when(k == "item", depth).alias("level"), F.coalesce(glyph.isin(*NUMBERED), F.lit(False)).alias("ordered"), text.alias("text")))

        return let(F.when(p.isNotNull(), paragraph_text(p)).otherwise(table_text(e["table"])), told)

    return F.transform(d["body"]["content"], part)


def _parsed(docs: DataFrame, key: str, json: str) -> DataFrame:
    return docs.select(key, F.from_json(json, DOCUMENT).alias("d")).select(key, _parts(F.col("d")).alias("parts"))


def document_parts(docs: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """(key, pos, kind, level, ordered, text) of the parts of a structured document.

    kind: heading, item, paragraph or table; level of a heading from 1, of an item from 0.
    """
    return _parsed(docs, key, json).select(key, F.posexplode("parts").alias("pos", "p")).select(key, "pos", "p.*").where("kind IS NOT NULL")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _numbers(levels: pd.Series) -> pd.Series:
    """The numbers of the items of documents: twice the level, 1 added for ordered ones; -1 for other parts."""

    def numbers(codes):
        # Open parts, the deepest last: depth, and how many of each kind stand right below.
        open_, out = [(-2, {})], []
        for code in () if codes is None else codes:
            depth = code // 2
            while open_[-1][0] >= depth:
                open_.pop()
            below = open_[-1][1]
            below[code] = below.get(code, 0) + 1
            out.append(below[code])
            open_.append((depth, {}))
        return out

    return levels.map(numbers)


def documents_to_markdown(docs: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """(key, markdown, counted) of structured documents; what can't be read is ''.

    Numbered items of markdown all say 1, as Markdown counts them itself.  Those of counted
    have their numbers: an item counts those of its level since the last shallower item or the
    last part that is no item; the nearest part before of a lower level marks that place.
    A document is read once, and its row holds it until both are written.
    """
    empty = F.lit("")
    rows = _parsed(docs, key, json).select(key, F.filter("parts", lambda p: p["kind"].isNotNull()).alias("parts"))
    codes = F.transform("parts", lambda p: F.when(p["kind"] == "item", p["level"] * 2 + p["ordered"].cast("int")).otherwise(F.lit(-1)))
    rows = rows.withColumn("numbers", _numbers(codes))

    def text(counted):
        def lines(p, i):
            number = F.get("numbers", i).cast("string") if counted else F.lit("1")
            sign = F.when(p["ordered"], F.concat(number, F.lit(". "))).otherwise(F.lit("- "))
            return (
                F.when(p["kind"] == "heading", F.array(F.concat(F.repeat(F.lit("#"), p["level"]), F.lit(" "), p["text"]), empty))
                .when(p["kind"] == "item", F.array(F.concat(F.repeat(F.lit("   "), p["level"]), sign, p["text"])))
                .otherwise(F.array(p["text"], empty))
            )

        return F.coalesce(F.array_join(F.flatten(F.transform("parts", lines)), "\n"), empty)

    return rows.select(key, text(False).alias("markdown"), text(True).alias("counted"))


def document_to_markdown(docs: DataFrame, key: str = "doc_id", json: str = "json", counted: bool = False) -> DataFrame:
    """(key, markdown) of structured documents, plain or ``counted``."""
    return documents_to_markdown(docs, key, json).select(key, F.col("counted" if counted else "markdown").alias("markdown"))


#: Tokens of JSON: keys with their colon, other strings, and brackets.
TOKEN = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)"(\s*:)?|[{}\[\]]', re.ASCII)


def _tabs(text: str, lists: tuple[str, ...], properties: str) -> list[tuple[str, str, int]]:
    """(tab_id, title, depth) of the tabs of a JSON text, in preorder."""
    # Open brackets, the innermost last: whether it lists tabs, the tab it is, the tab whose properties it has.
    open_, tabs, depth, name, asked = [(False, None, None)], [], -1, None, None
    for token in TOKEN.finditer(text):
        sign, own, asking = token[0], token[1] if token[2] else None, None
        if sign in ("{", "["):
            listed, around, _ = open_[-1]
            tab = {"tabId": [], "title": [], "depth": depth} if listed and sign == "{" else None
            if tab:
                tabs.append(tab)
            lists_tabs = sign == "[" and name in lists
            depth += lists_tabs
            open_.append((lists_tabs, tab, around if name == properties else None))
        elif sign in ("}", "]"):
            if len(open_) > 1:
                depth -= open_.pop()[0]
        elif own is None:
            if asked is not None:
                # A string token is a JSON text of its own; halves of pairs have no UTF-8.
                with contextlib.suppress(ValueError):
                    asked.append(loads(sign).encode("utf-8", "replace").decode())
        elif own in ("tabId", "title") and open_[-1][2]:
            asking = open_[-1][2][own]
        name, asked = own, asking
    return [(max(t["tabId"], default=""), max(t["title"], default="Untitled"), t["depth"]) for t in tabs]


def json_tabs(docs: DataFrame, key: str = "doc_id", json: str = "json", lists: tuple[str, ...] = ("tabs", "childTabs"), properties: str = "tabProperties") -> DataFrame:
    """(key, idx, tab_id, title, depth) of trees of tabs in JSON, in preorder, idx from 0.

    Nesting may go to any depth: nothing is parsed recursively.  A text's tokens are read once
    where the text is, with the open brackets at hand; depth is the number of open lists of
    tabs around a tab.  A tab without properties is Untitled.
    """
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("idx int, tab_id string, title string, depth long").fields])

    def run(batches):
        for batch in pieces(batches):
            rows = [(at, idx, *tab) for at, text in enumerate(batch.column(1).to_pylist()) for idx, tab in enumerate(_tabs(text or "", lists, properties))]
            at, idx, tab_id, title, depth = zip(*rows, strict=True) if rows else [()] * 5
            told = [pa.array(idx, pa.int32()), pa.array(tab_id, pa.string()), pa.array(title, pa.string()), pa.array(depth, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *told], schema.names)

    return docs.select(key, json).mapInArrow(run, schema)
