"""Markup as tables: tags with their places, elements as intervals, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.markup import decode_named
from ..functions.rx import strip, sub

#: Elements whose content is text, whatever it looks like (fixed values of HTML).
RAW = ("script", "style")
#: Elements without an end tag (fixed values of HTML).
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements that hold formulas for renderers, dropped with all inside (fixed values).
FORMULAS = ("mathml", "mathmlword", "asciimath", "latex", "mjx-container")


def tag_pattern(raw: tuple[str, ...] = RAW) -> str:
    """Comments, raw elements as a whole, and tags."""
    return r"(?is)<!--.*?-->|" + "|".join(rf"<{n}\b[^>]*>.*?</{n}\s*>" for n in raw) + r"|</?[a-z][^>]*>"


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by key to as many tasks as the session has for a shuffle.

    Marks are small and much alike: merged by their compressed size, as is usual, they would be
    one task for many pages, which holds far more in its sorts than it reads.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def matches(docs: DataFrame, pattern: str | Column, key: str, text: str, deal: bool = False) -> DataFrame:
    """(key, ord, start, found): every match of a pattern in the order of the text, start from 0.

    The pattern may be a column, and finds one character at least.  The keys are unique.  A match's place is the length of all gaps and matches before it.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(F.col(text), pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    rows = docs.select(key, gaps.alias("gap"), found.alias("found")).where(F.size("found") > 0)
    rows = rows.select(key, F.posexplode(F.arrays_zip(F.slice("gap", 1, F.size("found")).alias("gap"), "found")).alias("ord", "m")).select(key, "ord", "m.gap", "m.found")
    rows = dealt(rows, key) if deal else rows
    before = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return rows.select(key, "ord", (F.sum(F.col("gap") + F.length("found")).over(before) - F.length("found")).alias("start"), "found")


def tags(pages: DataFrame, key: str = "page_id", html: str = "html", raw: tuple[str, ...] = RAW) -> DataFrame:
    """(key, ord, start, stop, name, sign, tag): sign 1 opens, -1 closes, 0 stands alone.

    Comments and raw elements stand alone, as ``!`` and by their names.
    """
    rows = matches(pages, tag_pattern(raw), key, html, deal=True)
    name = F.when(F.col("found").startswith("<!--"), "!").otherwise(F.lower(F.regexp_extract("found", "^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1)))
    alone = F.col("name").isin("!", *raw, *VOID) | F.col("found").rlike("/>$")
    sign = F.when(alone, 0).when(F.col("found").startswith("</"), -1).otherwise(1)
    return rows.withColumn("name", name).select(key, "ord", "start", (F.col("start") + F.length("found")).alias("stop"), "name", sign.alias("sign"), F.col("found").alias("tag"))


def elements(marks: DataFrame, key: str = "page_id") -> DataFrame:
    """Opening tags and those that stand alone, with where they end: adds depth (among
    elements of the name), closed, last (ord of the tag that ends it) and end (place).

    An element ends where the running sum of its name's tags, +1 and -1, first returns to
    what it was before: the next tag of the name on that level.  One without an end tag
    ends where the innermost closed element around it does, before that one's end tag: the
    next such tag on the level of all closed elements.  With none around it, last and end
    are null.  All windows are within a key, so that one shuffle serves them.
    """
    by_name = W.partitionBy(key, "name").orderBy("ord")
    level = F.sum("sign").over(by_name.rowsBetween(W.unboundedPreceding, 0))
    rows = marks.withColumn("depth", F.when(F.col("sign") < 0, level + 1).otherwise(level)).withColumn("paired", F.col("sign") != 0)
    on_level = W.partitionBy(key, "name", "depth", "paired").orderBy("ord")
    rows = rows.withColumn("next", F.lead(F.struct("sign", "ord", "stop")).over(on_level)).withColumn("before", F.lag("sign").over(on_level))
    closed = F.col("paired") & F.when(F.col("sign") > 0, F.col("next.sign") < 0).otherwise(F.col("before") > 0)
    rows = rows.withColumn("closed", F.coalesce(closed, F.lit(False)))
    around = F.sum(F.when(F.col("closed"), F.col("sign")).otherwise(0)).over(W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    ends = F.col("closed") & (F.col("sign") < 0)
    rows = rows.withColumn("around", F.when(ends, around + 1).otherwise(around)).withColumn("ends", ends)
    ahead = W.partitionBy(key, "around").orderBy("ord").rowsBetween(1, W.unboundedFollowing)
    rows = rows.withColumn("outer", F.first(F.when(F.col("ends"), F.struct("ord", "start")), ignorenulls=True).over(ahead))
    alone = ~F.col("paired")
    last = F.when(alone, F.col("ord")).when(F.col("closed"), F.col("next.ord")).otherwise(F.col("outer.ord"))
    end = F.when(alone, F.col("stop")).when(F.col("closed"), F.col("next.stop")).otherwise(F.col("outer.start"))
    return rows.where("sign >= 0").select(*marks.columns, F.when(alone, 0).otherwise(F.col("depth")).cast("long").alias("depth"), (alone | F.col("closed")).alias("closed"), last.alias("last"), end.alias("end"))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in double or single quotes, or bare; null without it."""
    at = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*(F.regexp_extract(tag, at, k) for k in (1, 2, 3)))
    return F.when(tag.rlike(at), value)


def root(parts: DataFrame, choices: list[Column], key: str = "page_id") -> DataFrame:
    """(key, root_ord, root_last): of the elements that fit the first choice that any fits, the first; none fits: no row."""
    rank = F.coalesce(*(F.when(c, F.lit(k)) for k, c in enumerate(choices)))
    found = parts.withColumn("_rank", rank).where("_rank IS NOT NULL")
    return found.groupBy(key).agg(F.min(F.struct("_rank", "ord", "last")).alias("r")).select(key, F.col("r.ord").alias("root_ord"), F.col("r.last").alias("root_last"))


def texts(pages: DataFrame, key: str = "page_id", html: str = "html", raw: tuple[str, ...] = RAW) -> DataFrame:
    """(key, pieces): the text after each tag, the one before the first tag first."""
    return pages.select(key, F.split(html, tag_pattern(raw), -1).alias("pieces"))


#: The end of a page, beyond all tags.
END = 2**31 - 1
#: Headings, blocks of text and figures that a cleaned page keeps.
HEADINGS, BLOCKS, FIGURE = ("h1", "h2", "h3"), ("div", "p"), "figure"


def clean_pages(pages: DataFrame, choices: list[Column], key: str = "page_id", html: str = "html", promoted: tuple[str, ...] = (), skipped: tuple[str, ...] = (), titles: dict[str, str] | None = None, longest: int = 50, shortest: int = 10, keep: Column | None = None, translated: str | None = None) -> DataFrame:
    """(key, pos, kind, text, section): headings, paragraphs and figures of each page's content, in order.

    choices: conditions on elements (name, tag) that name the content's root, the best
    first; a page without a root has no rows.  A heading whose id begins with one of
    ``skipped``, or whose text has more than ``longest`` or less than two characters, is
    left out; one whose id begins with one of ``promoted`` becomes an h1; ``titles`` maps
    ids to other texts of an h2.  Headings that stay are numbered: section-1, section-2, ...
    A block is kept if no heading or figure is inside and its text has ``shortest``
    characters and fits ``keep``, a condition on the column text.  With ``translated``, an
    element's text is that of its first font element whose class contains this word.
    A figure's text is the address of its first image; figures without one are left out.
    An element without an end tag reaches to the end of the one around it.
    """
    raw = RAW + FORMULAS
    whole = elements(tags(pages, key, html, raw), key)
    inside = (F.col("ord") > F.col("root_ord")) & (F.col("ord") < F.coalesce("root_last", F.lit(END)))
    own = whole.join(root(whole, choices, key), key).where(inside).drop("root_ord", "root_last")
    ahead = W.partitionBy(key).orderBy("ord").rowsBetween(1, W.unboundedFollowing)

    def next_of(cond: Column, *fields: str) -> Column:
        return F.min(F.when(cond, F.struct("ord", *fields))).over(ahead)

    name = F.col("name")
    own = own.withColumn("head", next_of(name.isin(*HEADINGS, FIGURE))["ord"]).withColumn("image", next_of((name == "img") & (F.length(attribute(F.col("tag"), "src")) > 0), "tag"))
    if translated:
        own = own.withColumn("inner", next_of((name == "font") & F.contains(F.coalesce(attribute(F.col("tag"), "class"), F.lit("")), F.lit(translated)), "last"))
    own = own.where(name.isin(*HEADINGS, *BLOCKS, FIGURE)).withColumn("last", F.coalesce("last", F.lit(END)))
    own = own.where(~name.isin(*BLOCKS) | F.col("head").isNull() | (F.col("head") > F.col("last")))
    own = own.where((name != FIGURE) | (F.col("image.ord") < F.col("last")))
    found = F.struct("ord", "last", "name", F.lower(F.coalesce(attribute(F.col("tag"), "id"), F.lit(""))).alias("id"), F.when(name == FIGURE, attribute(F.col("image.tag"), "src")).alias("src"), (F.when(F.col("inner.ord") < F.col("last"), F.col("inner")) if translated else F.lit(None).cast("struct<ord:int,last:int>")).alias("inner"))
    packed = own.groupBy(key).agg(F.array_sort(F.collect_list(found)).alias("parts"))
    # The pieces of a page's text are put together once for each element, where the page is.
    both = packed.join(texts(pages, key, html, raw), key)

    def text(p: Column) -> Column:
        at = F.coalesce(p["inner"], F.struct(p["ord"].alias("ord"), p["last"].alias("last")))
        inner = F.slice("pieces", at["ord"] + 2, at["last"] - at["ord"])
        # As a parser has it: every run of text stripped, entities decoded.
        return F.coalesce(p["src"], decode_named(F.array_join(F.transform(inner, strip), "")))

    rows = both.select(key, F.explode(F.transform("parts", lambda p: F.struct(p["ord"].alias("pos"), p["name"].alias("name"), p["id"].alias("id"), text(p).alias("text")))).alias("p")).select(key, "p.*")

    def begins(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.col("id").startswith(w)
        return out

    heading = F.col("name").isin(*HEADINGS)
    mapped = F.lit(None).cast("string")
    for k, v in (titles or {}).items():
        mapped = F.when(F.col("id") == k, F.lit(v)).otherwise(mapped)
    rows = rows.withColumn("mapped", mapped).withColumn("up", begins(promoted))
    off = begins(skipped) | (F.length("text") > longest) | (~F.col("up") & F.col("mapped").isNull() & (F.length("text") < 2))
    fits = (F.length("text") >= shortest) & (keep if keep is not None else F.lit(True))
    rows = rows.where(F.when(heading, ~off).when(F.col("name") == FIGURE, F.lit(True)).otherwise(fits))
    kind = F.when(F.col("up"), F.lit("h1")).when(heading & F.col("mapped").isNotNull(), F.lit("h2")).when(F.col("name").isin(*BLOCKS), F.lit("p")).otherwise(F.col("name"))
    number = F.sum(heading.cast("long")).over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    said = F.when(heading & ~F.col("up"), F.coalesce("mapped", "text")).otherwise(F.col("text"))
    return rows.select(key, "pos", kind.alias("kind"), said.alias("text"), F.when(heading, F.concat(F.lit("section-"), number)).alias("section"))


def contents(cleaned: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, title, contents, n_headings, n_paragraphs, n_figures) of ``clean_pages``.

    contents has a line for each h1 and h2, the h2 set in; the title is the first h1.
    """
    line = F.concat(F.when(F.col("kind") == "h2", F.lit("  ")).otherwise(F.lit("")), F.lit("- ["), F.col("text"), F.lit("](#"), F.col("section"), F.lit(")"))
    listed = F.array_sort(F.collect_list(F.when(F.col("kind").isin("h1", "h2"), F.struct("pos", line.alias("line")))))
    counts = [F.count_if(c).alias(n) for n, c in (("n_headings", F.col("section").isNotNull()), ("n_paragraphs", F.col("kind") == "p"), ("n_figures", F.col("kind") == FIGURE))]
    first = F.min(F.when(F.col("kind") == "h1", F.struct("pos", "text")))["text"]
    return cleaned.groupBy(key).agg(first.alias("title"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("contents"), *counts)


def content_blocks(pages: DataFrame, start: Column, key: str = "page_id", html: str = "html", container: str = "div", hosts: tuple[str, ...] | None = None, size: str = "w966") -> DataFrame:
    """(key, pos, kind, text): the paragraphs and images of a page's container, in the order of the page.

    start: a condition on a container's opening tag (name, tag); the first that fits counts.
    A container that never ends goes on to the last tag of its name.  Images inside a paragraph
    come before its text; those of other ``hosts`` and paragraphs without text are left out.
    An image's size in its address is set to ``size``.
    """
    final = F.max(F.when(F.col("sign") != 0, F.col("ord"))).over(W.partitionBy(key, "name"))
    whole = elements(tags(pages, key, html).withColumn("final", final), key)
    box = F.struct("ord", F.when(F.col("closed"), F.col("last")).otherwise(F.col("final")).alias("last"))
    at = whole.where((F.col("name") == container) & start).groupBy(key).agg(F.min(box).alias("box"))
    own = whole.join(at, key).where((F.col("ord") > F.col("box.ord")) & (F.col("ord") < F.col("box.last")))
    image = attribute(F.col("tag"), "(?:data-lazy-src|src)")
    shown = (F.col("name") == "img") & (F.length(image) > 0)
    if hosts is not None:
        fits = F.lit(False)
        for h in hosts:
            fits = fits | F.contains(image, F.lit(h))
        shown = shown & fits
    images = own.where(shown).select(key, F.col("ord").alias("pos"), F.lit("image").alias("kind"), sub(image, r"\?type=\w+", f"?type={size}").alias("text"))
    spans = own.where("name = 'p' AND closed").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "last"))).alias("spans"))
    both = spans.join(texts(pages, key, html), key)
    # A paragraph stands where it ends, after the images that are inside.
    said = F.transform("spans", lambda p: F.struct(p["last"].alias("pos"), strip(F.array_join(F.slice("pieces", p["ord"] + 2, p["last"] - p["ord"]), "")).alias("text")))
    paragraphs = both.select(key, F.explode(said).alias("p")).select(key, "p.pos", F.lit("text").alias("kind"), "p.text").where("text <> ''")
    return images.unionByName(paragraphs)


def ordered_stream(pages: DataFrame, extractors: list[tuple[str, str]], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, start, stop, kind, found): matches of several patterns in one stream by place.

    extractors: (kind, pattern), the most important first.  A match that overlaps a kept
    one of an extractor before it is left out; matches of one pattern don't overlap.
    """
    rows = None
    for rank, (kind, pattern) in enumerate(extractors):
        own = matches(pages, pattern, key, html).select(key, "start", (F.col("start") + F.length("found")).alias("stop"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "found")
        rows = own if rows is None else rows.unionByName(own)
    order = W.partitionBy(key).orderBy("start", "rank")
    # One extractor after the other is settled against what is kept by then.
    rows = rows.withColumn("kept", F.col("rank") == 0)
    for rank in range(1, len(extractors)):
        held = F.col("kept") & (F.col("rank") < rank)
        reach = F.max(F.when(held, F.col("stop"))).over(order.rowsBetween(W.unboundedPreceding, -1))
        ahead = F.min(F.when(held, F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
        free = F.coalesce(reach <= F.col("start"), F.lit(True)) & F.coalesce(ahead >= F.col("stop"), F.lit(True))
        # A match that begins with an earlier extractor's stands after it in the order.
        rows = rows.withColumn("kept", F.when(F.col("rank") == rank, free).otherwise(F.col("kept")))
    return rows.where("kept").drop("kept", "rank")
