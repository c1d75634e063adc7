"""Queries that feed the operators of exports, posts and outlines from the given tables.

Their golden rows are in tests/test_golden.py.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, rx, web
from ..operators import articles, match, outline, parse
from .fixtures import _MIXED_LINES as _LINES
from .fixtures import mixed, mixed_sql
from .registry import query, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("n", F.length("line"))


_COUNTED = f"(SELECT doc_id, pos, line, length(line) AS n FROM {_LINES})"
_STRIP = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


# -- exports, posts, notes ---------------------------------------------------------------
def _export_sql() -> str:
    x = "text"
    for step in web.EXPORT_STEPS:
        pattern = step.pattern.replace("(?md)", "(?m)").replace("[\\s\\x{85}\\p{Z}]", "[\\s\\p{Z}]")
        x = f"regexp_replace({x}, '{pattern}', '{step.replacement}', 'g')"
    return f"nfc_normalize({x})"


@query(f"SELECT id, {_export_sql()} AS text FROM {mixed_sql('exports')}")
def export_cleaning(spark, sf_dir):
    """STR-24, MSC-17: converted wiki exports."""
    return mixed(_docs(spark, sf_dir), "exports").select("id", web.clean_export(F.col("text")).alias("text"))


@query(f"""SELECT id, i.nth AS nth, i.url AS url FROM (SELECT id, unnest(CASE media_type WHEN 'CAROUSEL_ALBUM' THEN [{{'nth': '01', 'url': a}}, {{'nth': '02', 'url': b}}] WHEN 'IMAGE' THEN [{{'nth': '01', 'url': media_url}}] ELSE [] END) AS i
    FROM {mixed_sql('albums')}) WHERE i.url IS NOT NULL""")
def album_images(spark, sf_dir):
    """MSC-02, WIN-11: images of posts by kind."""
    return web.image_rows(mixed(_docs(spark, sf_dir), "albums").select("id", "media_type", "media_url", F.array("a", "b").alias("children")))


_TIME = r"(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})\.?\s*(?:(\d{1,2}):(\d{2}))?"


def _part(k: int, width: int = 2) -> str:
    return f"lpad(coalesce(nullif(regexp_extract(text, '{_TIME}', {k}), ''), '0'), {width}, '0')"


@query(
    f"""SELECT id, CASE WHEN regexp_matches(text, '{_TIME}') THEN concat({_part(1, 4)}, {_part(2)}, {_part(3)}, 'T', {_part(4)}, {_part(5)}, lpad(CAST(id % 60 AS VARCHAR), 2, '0')) END AS stamp,
    CASE WHEN d IS NULL THEN 'unknown' WHEN d < 0 THEN 'expired' WHEN d <= 7 THEN 'week' WHEN d <= 14 THEN 'fortnight' ELSE 'fine' END AS expiry
    FROM (SELECT *, date_diff('day', DATE '2025-01-14', CAST(try_strptime(expires, '%Y-%m-%d') AS DATE)) AS d FROM {mixed_sql('dates')})"""
)
def post_times(spark, sf_dir):
    """HTML-08, MSC-10: stamps of posts, expiry of tokens."""
    return mixed(_docs(spark, sf_dir), "dates").select("id", web.post_time(F.col("text"), F.col("id")).alias("stamp"), web.expiry(F.col("expires"), F.to_date(F.lit("2025-01-14"))).alias("expiry"))


@query(
    r"""SELECT id, array_to_string(list_filter(refs, lambda x: list_contains(defs, x)), ',') AS resolved, array_to_string(list_filter(refs, lambda x: NOT list_contains(defs, x)), ',') AS unresolved,
    array_to_string(list_filter(defs, lambda x: NOT list_contains(refs, x)), ',') AS unused
    FROM (SELECT id, list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '(?m)^\[fn:(\d+)\]', '', 'g'), '\[fn:(\d+)\]', 1))) AS refs, list_sort(list_distinct(regexp_extract_all(text, '(?m)^\[fn:(\d+)\]', 1))) AS defs FROM """
    + mixed_sql("notes_fn")
    + ")"
)
def footnote_check(spark, sf_dir):
    """JON-07, SET-04, STM-10: footnote references against definitions."""
    return mixed(_docs(spark, sf_dir), "notes_fn").select("id", *(c.alias(k) for k, c in web.footnotes(F.col("text")).items()))


@query(
    r"""SELECT id, regexp_replace(regexp_replace(regexp_replace(text, '\*\*([^*]+)\*\*', '*\1*', 'g'), '`([^`]+)`', '~\1~', 'g'), '\[([^\]]+)\]\(([^)]+)\)', '[[\2][\1]]', 'g') AS org,
    regexp_replace(text, '(?m)^(#{3,}\s+\*{0,2})(?:\d+(?:[.-]\d+)*[.)]?|\(\d+\)|[①-⑳])\s+(.+)$', '\1\2', 'g') AS plain FROM """
    + mixed_sql("mixed_md")
)
def markdown_inline(spark, sf_dir):
    """STR-33/35/36: inline marks and heading numbers."""
    return mixed(_docs(spark, sf_dir), "mixed_md").select("id", web.org_inline(F.col("text")).alias("org"), web.unnumbered(F.col("text")).alias("plain"))


@query(f"SELECT id, size < 1000 OR (size < 5000 AND (contains(lower(head), '<!doctype') OR contains(lower(head), '<html'))) AS broken FROM {mixed_sql('images')}")
def broken_images(spark, sf_dir):
    """VER-01: files that are no images."""
    return mixed(_docs(spark, sf_dir), "images").select("id", web.broken_image(F.col("size"), F.col("head")).alias("broken"))


# -- tabs and recognised blocks --------------------------------------------------------------
_TABBED = f"""(SELECT doc_id, pos, n, n % 5 = 0 AS mark, line, sum(CAST(n % 5 = 0 AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS idx FROM {_COUNTED})"""
_TABS = f"""SELECT doc_id, CAST(idx AS BIGINT) AS idx, concat('Tab ', max(n) FILTER (mark)) AS name, CASE WHEN max(n) FILTER (mark) % 2 = 0 THEN concat('t.', max(pos) FILTER (mark)) END AS tab_id, CAST(max(n) FILTER (mark) % 3 AS INT) AS depth,
    CAST(max(pos) FILTER (mark) + 2 AS INT) AS line_start, CAST(max(pos) + 1 AS INT) AS line_end, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT mark), '') AS content FROM {_TABBED} WHERE idx > 0 GROUP BY doc_id, idx"""


def _tabbed(spark, sf_dir):
    """Documents as exports of tabs: every line whose length divides by five begins one."""

    def dressed(x, i):
        n = F.length(x)
        own = F.when(n % 2 == 0, F.concat(F.lit(" ( ID: t."), i.cast("string"), F.lit(" )"))).otherwise(F.lit(""))
        return F.when(n % 5 == 0, F.concat(F.lit("--- TAB: "), F.repeat(F.lit("    "), (n % 3).cast("int")), F.lit("Tab "), n.cast("string"), own, F.lit(" ---"))).otherwise(x)

    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), dressed), "\n").alias("text"))


@query(_TABS)
def tab_split(spark, sf_dir):
    """STM-01, D3: tabs of exports made of every document."""
    return parse.split_tabs(_tabbed(spark, sf_dir))


@query(
    f"""WITH t AS ({_TABS}), r AS (SELECT doc_id, min(idx) AS a, arg_min(depth, idx) AS d FROM t WHERE contains(lower(name), '5') GROUP BY doc_id),
    s AS (SELECT r.doc_id, a, min(t.idx) AS z FROM r LEFT JOIN t ON t.doc_id = r.doc_id AND t.idx > a AND t.depth <= d GROUP BY r.doc_id, a)
    SELECT t.doc_id, t.idx, t.name FROM t JOIN s ON s.doc_id = t.doc_id AND t.idx >= a AND (z IS NULL OR t.idx < z)"""
)
def tab_subtree(spark, sf_dir):
    """FLT-01/02: of every document the first tab that fits and what lies below it."""
    return parse.subtree(parse.split_tabs(_tabbed(spark, sf_dir)), "5").select("doc_id", "idx", "name")


_LABELS = ("title", "text", "image", "table")


@query(
    f"""SELECT * FROM (SELECT doc_id, CAST(idx AS BIGINT) AS idx, coalesce(max(CASE n % 4 {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_LABELS))} END) FILTER (mark), 'text') AS label,
        CAST(max(n) FILTER (mark) AS INT) AS x1, CAST(max(pos) FILTER (mark) AS INT) AS y1, CAST(max(n) FILTER (mark) + 5 AS INT) AS x2, CAST(max(pos) FILTER (mark) + 9 AS INT) AS y2,
        {_STRIP.format(x="coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT mark), '')")} AS text
        FROM (SELECT *, n % 6 < 2 AS mark, sum(CAST(n % 6 < 2 AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS idx FROM {_COUNTED}) GROUP BY doc_id, idx) WHERE text <> '' OR label = 'image'"""
)
def ocr_blocks(spark, sf_dir):
    """STM-15, D9: labelled blocks of recognised pages made of every document."""
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("n") % 4 + 1).cast("int"))
    numbers = F.concat_ws(", ", *(x.cast("string") for x in (F.col("n"), F.col("pos"), F.col("n") + 5, F.col("pos") + 9)))
    rows = _lines(spark, sf_dir).select("doc_id", "pos", F.when(F.col("n") % 6 < 2, F.concat(label, F.lit("[["), numbers, F.lit("]]"))).otherwise(F.col("line")).alias("line"))
    pages = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("raw"))
    return parse.grounded_blocks(pages, "doc_id")


# -- matching and outlines -----------------------------------------------------------------------
_KEYS = "concat(n_chars % 9, '.', n_chars % 4, CASE WHEN n_chars % 5 = 0 THEN concat('.', n_chars % 3) ELSE '' END)"
_ITEMS = "concat(item_id % 11, '.', item_id % 3, CASE WHEN item_id % 4 = 0 THEN concat('.', item_id % 5) ELSE '' END)"


@query(
    f"""WITH c AS (SELECT item_id AS pos, {_ITEMS} AS k, text AS body FROM benchmark),
    x AS (SELECT k, min(pos) AS first, arg_max(body, pos) AS body FROM c GROUP BY k),
    r AS (SELECT CASE WHEN contains(k, '.') THEN substr(k, strpos(k, '.') + 1) END AS rest, arg_min(body, first) AS body FROM x WHERE contains(k, '.') GROUP BY 1)
    SELECT d.doc_id, d.k, CASE WHEN x.k IS NOT NULL THEN 'key' WHEN r.rest IS NOT NULL THEN 'suffix' ELSE 'none' END AS how, CASE WHEN x.k IS NOT NULL THEN x.body ELSE r.body END AS body
    FROM (SELECT doc_id, {_KEYS} AS k FROM documents) d LEFT JOIN x ON x.k = d.k LEFT JOIN r ON r.rest = substr(d.k, strpos(d.k, '.') + 1)"""
)
def suffix_fallback(spark, sf_dir):
    """JON-09, STR-40: equal keys first, then what follows the first dot; the first such key counts."""
    docs = _docs(spark, sf_dir).select("doc_id", F.expr(_KEYS).alias("k"))
    content = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.expr(_ITEMS).alias("k"), F.col("text").alias("body"))
    return match.suffix_join(docs, content, "k", "pos", ["body"])


_BLOCKS = f"(SELECT doc_id, pos, CASE WHEN n % 7 = 0 THEN concat(' Begin ', line) WHEN n % 13 = 0 THEN 'Index' WHEN n % 11 = 1 THEN concat('Notes ', line) ELSE line END AS text, CASE WHEN n % 3 = 0 THEN 1 END AS text_level, pos // 3 AS page FROM {_COUNTED})"


@query(
    f"""WITH b AS (SELECT *, trim(text) AS t FROM {_BLOCKS}), g AS (SELECT doc_id, coalesce(min(pos) FILTER (starts_with(t, 'Begin')), min(pos)) AS lo, max(pos) + 1 AS stop FROM b GROUP BY doc_id),
    h AS (SELECT g.doc_id, lo, stop, min(pos) FILTER (text_level > 0 AND (starts_with(t, 'Index') OR starts_with(t, 'Notes'))) AS heading, min(page) FILTER (t IN ('Index', 'Notes')) AS back_page FROM g LEFT JOIN b ON b.doc_id = g.doc_id AND pos > lo GROUP BY ALL)
    SELECT doc_id, CAST(lo AS INT) AS lo, CAST(coalesce(heading, (SELECT min(pos) FROM b WHERE b.doc_id = h.doc_id AND pos > lo AND page = back_page), stop) AS INT) AS hi FROM h"""
)
def body_bounds(spark, sf_dir):
    """STM-12: where the body of books made of every document begins and ends."""
    n, line = F.col("n"), F.col("line")
    text = F.when(n % 7 == 0, F.concat(F.lit(" Begin "), line)).when(n % 13 == 0, F.lit("Index")).when(n % 11 == 1, F.concat(F.lit("Notes "), line)).otherwise(line)
    blocks = _lines(spark, sf_dir).select("doc_id", "pos", text.alias("text"), F.when(n % 3 == 0, F.lit(1)).alias("text_level"), F.floor(F.col("pos") / 3).alias("page"))
    return outline.body_bounds(blocks, "Begin", ("Index", "Notes"))


@query(
    f"""WITH s AS (SELECT doc_id, line AS slot, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM {_COUNTED} WHERE n % 3 = 0), c AS (SELECT doc_id, line AS text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM {_COUNTED} WHERE n % 3 = 1)
    SELECT doc_id, CAST(nth AS INT) AS nth, slot, coalesce(text, slot) AS text, CASE WHEN slot IS NULL THEN 'extra' WHEN text IS NULL THEN 'short' ELSE 'filled' END AS status FROM s FULL JOIN c USING (doc_id, nth)"""
)
def template_fill(spark, sf_dir):
    """ORG-03, JON-10, AGG-12: a third of every document's lines as placeholders, another as what fills them."""
    rows = _lines(spark, sf_dir)
    slots, content = rows.where("n % 3 = 0").select("doc_id", "pos", F.col("line").alias("slot")), rows.where("n % 3 = 1").select("doc_id", "pos", F.col("line").alias("text"))
    return outline.fill_template(slots, content, "doc_id")


_POSTS = "(SELECT event_id AS id, ts AS w, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, CASE WHEN event_id % 4 = 0 THEN concat('* ', event_type, ' [x]', chr(10), ' * ', user_id) ELSE concat(event_type, ' ', props) END AS text FROM events)"
_YEAR = "lpad(CAST(9999 - year(w) AS VARCHAR), 4, '0')"
_MONTH = "lpad(CAST(13 - month(w) AS VARCHAR), 2, '0')"
_DAY = "lpad(CAST(32 - day(w) AS VARCHAR), 2, '0')"
_TITLE = "replace(replace(replace(CASE WHEN length(first) > 50 THEN concat(substr(first, 1, 50), '...') ELSE first END, '*', '\\*'), '[', '\\['), ']', '\\]')"


@query(
    f"""WITH p AS (SELECT *, trim(split_part(text, chr(10), 1)) AS first FROM {_POSTS})
    SELECT DISTINCT concat({_YEAR}, '|00|00|0||') AS place, concat('* ', year(w)) AS line FROM p UNION ALL
    SELECT DISTINCT concat({_YEAR}, '|', {_MONTH}, '|00|0||'), concat('** ', strftime(w, '%Y-%m %B')) FROM p UNION ALL
    SELECT DISTINCT concat({_YEAR}, '|', {_MONTH}, '|', {_DAY}, '|0||'), concat('*** ', strftime(w, '%Y-%m-%d %A')) FROM p UNION ALL
    SELECT concat({_YEAR}, '|', {_MONTH}, '|', {_DAY}, '|1|', t, '|', id), concat('**** ', strftime(w, '%H:%M'), ' - ', {_TITLE}, chr(10), ':PROPERTIES:', chr(10), ':POST_ID: ', id, chr(10), ':TIMESTAMP: ', t, chr(10), ':END:', chr(10),
        '[', strftime(w, '%Y-%m-%d %a %H:%M'), ']', chr(10), chr(10), regexp_replace(text, '(?m)^([ ]*\\*)', ',\\1', 'g')) FROM p"""
)
def date_tree_outline(spark, sf_dir):
    """SNK-05/06, SRT-01/02, STR-19/20: all events as posts of an outline by day, in the order of place."""
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("* "), F.col("event_type"), F.lit(" [x]\n * "), F.col("user_id").cast("string"))).otherwise(F.concat("event_type", F.lit(" "), "props"))
    posts = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), text.alias("text"))
    return outline.date_tree_lines(posts).select(F.array_join("ord", "|").alias("place"), "line")


# -- tags ----------------------------------------------------------------------------------------
@query(
    r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS tag FROM documents), d AS (SELECT doc_id, tag, replace(replace(replace(tag, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS raw FROM w WHERE regexp_matches(tag, '[\p{L}\p{N}]'))
    SELECT raw, regexp_replace(regexp_replace(raw, '[,:;.!?"'']+$', ''), '^[,:;.!?"''\[(<]+', '') AS clean, count(*) AS n FROM d WHERE NOT regexp_matches(tag, '^x[0-9A-Fa-f]+;|[(\[{<>)\]}&|]') GROUP BY ALL"""
)
def tag_cleaning(spark, sf_dir):
    """STR-14/15/16: every word of the documents as a tag, as written and for counting; those with brackets are in the tests."""
    words = _docs(spark, sf_dir).select(F.explode(F.split("text", r"\s+", -1)).alias("tag")).where(F.col("tag").rlike(r"[\p{L}\p{N}]") & ~F.col("tag").rlike(r"[(\[{<>)\]}&|]"))
    # Each distinct word is cleaned once.
    counted = words.groupBy("tag").agg(F.count("*").alias("n"))
    rows = counted.select(web.raw_tag(F.col("tag")).alias("raw"), web.clean_tag(F.col("tag")).alias("clean"), "n").where("raw IS NOT NULL")
    return rows.groupBy("raw", "clean").agg(F.sum("n").alias("n"))


# -- layouts, tables and headings made of lines ----------------------------------------------------
_W = "translate(split_part(line, ' ', {k}), '.,|<>&#*\"', '')"
W1, W2 = _W.format(k=1), _W.format(k=2)


@query(
    f"""WITH b AS (SELECT doc_id, pos, n, CASE n % 11 WHEN 0 THEN 'image' WHEN 1 THEN 'page_number' WHEN 2 THEN 'equation' WHEN 3 THEN 'table' WHEN 4 THEN 'chart' ELSE 'text' END AS type, n % 10 = 0 AS titled, pos // 4 AS page,
             CASE WHEN n % 2 = 0 THEN concat(' ', regexp_replace(line, '[.]+$', ''), ' ') ELSE line END AS text FROM {_COUNTED}),
    c AS (SELECT *, count(*) FILTER (type = 'image') OVER w AS i, count(*) FILTER (type = 'equation') OVER w AS q, count(*) FILTER (type IN ('table', 'chart')) OVER w AS t FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    k AS (SELECT *, lead(titled) OVER w AS b_titled, lead(text) OVER w AS b_text, lead(page) OVER w AS b_page, lead(i) OVER w AS b_i, lead(q) OVER w AS b_q, lead(t) OVER w AS b_t FROM c WHERE type = 'text' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    s AS (SELECT *, rtrim(text) AS tail, ltrim(b_text) AS head FROM k WHERE NOT titled AND NOT b_titled)
    SELECT doc_id, CAST(pos AS INT) AS pos, CASE WHEN b_i > i THEN 'image_interrupt' WHEN b_q > q THEN 'eq_interrupt' WHEN b_t > t THEN 'table_interrupt' WHEN page <> b_page THEN 'page_boundary' ELSE 'samepage_break' END AS class, tail, head
    FROM s WHERE tail <> '' AND head <> '' AND NOT regexp_matches(tail, '[.!?…。」』）)\\]"''”’]$') AND NOT regexp_matches(head, '^[*#-]')"""
)
def layout_splits(spark, sf_dir):
    """STM-13, WIN-04, SET-06, FLT-16: split paragraphs of layouts made of every document, by what splits them."""
    n, line = F.col("n"), F.col("line")
    kind = F.lit("text")
    for k, name in enumerate(("image", "page_number", "equation", "table", "chart")):
        kind = F.when(n % 11 == k, F.lit(name)).otherwise(kind)
    text = F.when(n % 2 == 0, F.concat(F.lit(" "), F.regexp_replace(line, "[.]+$", ""), F.lit(" "))).otherwise(line)
    blocks = _lines(spark, sf_dir).select("doc_id", "pos", kind.alias("type"), text.alias("text"), F.when(n % 10 == 0, F.lit(1)).alias("text_level"), F.floor(F.col("pos") / 4).alias("page"))
    return parse.layout_splits(blocks)


@query(
    f"""SELECT doc_id, CAST(pos AS INT) AS pos, 0 AS ord, {W1} AS text, CASE n % 3 WHEN 1 THEN 2 ELSE 1 END AS colspan, CASE n % 3 WHEN 2 THEN 3 ELSE 1 END AS rowspan FROM {_COUNTED}
    UNION ALL SELECT doc_id, CAST(pos AS INT), 1, {W2}, CASE (n // 3) % 2 WHEN 1 THEN 2 ELSE 1 END, CASE (n // 3) % 2 WHEN 1 THEN 3 ELSE 1 END FROM {_COUNTED}"""
)
def adoc_cells(spark, sf_dir):
    """TBL-02, AGG-14: AsciiDoc cells with their spans, two made of every line."""
    n = F.col("n")
    first = F.when(n % 3 == 0, "|").when(n % 3 == 1, "2+|").otherwise(".3+|")
    second = F.when(F.floor(n / 3) % 2 == 0, " |").otherwise(" 2.3+|")
    rows = _lines(spark, sf_dir).select("doc_id", "pos", F.concat(first, F.expr(W1), second, F.expr(W2)).alias("line"))
    return parse.adoc_cells(rows)


def _joined(rows, piece, sep: str = "\n"):
    """A text for each document: a piece of each line, in order."""
    packed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("v")))).alias("all"))
    return packed.select("doc_id", F.array_join(F.transform("all", lambda x: x["v"]), sep).alias("t"))


@query(f"SELECT doc_id, concat('x', chr(10), string_agg(concat('| ', {W1}, ' | ', trim(concat('< ', {W2})), ' |'), chr(10) ORDER BY pos), chr(10), 'y') AS org FROM {_COUNTED} GROUP BY doc_id")
def html_tables(spark, sf_dir):
    """STR-28: HTML tables with a row for every line, as pipe rows."""
    row = F.concat(F.lit("<tr>\n<td>"), F.expr(W1), F.lit("</td><th a='b'> &lt; "), F.expr(W2), F.lit(" </th></tr>"))
    made = _joined(_lines(spark, sf_dir), row, "")
    return made.select("doc_id", articles.tables_to_org(F.concat(F.lit("x\n<table>"), F.col("t"), F.lit("</table>\ny"))).alias("org"))


@query(
    f"""SELECT doc_id, string_agg(CASE WHEN n % 2 = 0 THEN concat('* ', {W1}, ' ', CASE n % 3 WHEN 0 THEN 'α' WHEN 1 THEN 'β' ELSE 'γ' END, '_', n, ' ≤ and ', trim(concat('∂ ', {W2})), ' end') ELSE concat(line, ' \\(\\alpha\\)') END, chr(10) ORDER BY pos) AS t
    FROM {_COUNTED} GROUP BY doc_id"""
)
def plain_headings(spark, sf_dir):
    """STR-29: maths in the headings that every second line becomes."""
    n = F.col("n")
    sign = F.when(n % 3 == 0, "\\alpha").when(n % 3 == 1, "\\beta").otherwise("\\gamma")
    heading = F.concat(F.lit("* "), F.expr(W1), F.lit(" \\("), sign, F.lit("_{"), n.cast("string"), F.lit("} \\leq \\mathrm{x}\\) and \\[\\partial "), F.expr(W2), F.lit("\\] end"))
    made = _joined(_lines(spark, sf_dir), F.when(n % 2 == 0, heading).otherwise(F.concat("line", F.lit(" \\(\\alpha\\)"))))
    return made.select("doc_id", articles.plain_headings(F.col("t")).alias("t"))


@query(
    f"""SELECT doc_id, concat(first(r ORDER BY pos), chr(10), CASE WHEN bool_or(n % 3 > 0) THEN '|---+---|' ELSE '|---|' END, coalesce(chr(10) || nullif(array_to_string(list(r ORDER BY pos)[2:], chr(10)), ''), '')) AS org
    FROM (SELECT *, CASE WHEN n % 3 > 0 THEN concat('| ', {W1}, ' | ', {W2}, ' |') WHEN bool_or(n % 3 > 0) OVER (PARTITION BY doc_id) THEN concat('| ', {W1}, ' |  |') ELSE concat('| ', {W1}, ' |') END AS r FROM {_COUNTED}) GROUP BY doc_id"""
)
def org_tables(spark, sf_dir):
    """TBL-01: AsciiDoc blocks with a row for every line, as Org tables."""
    cells = F.concat(F.lit("|"), F.expr(W1), F.when(F.col("n") % 3 > 0, F.concat(F.lit("\n|"), F.expr(W2))).otherwise(F.lit("")))
    made = _joined(_lines(spark, sf_dir), cells, "\n\n")
    return made.select("doc_id", articles.org_table(F.concat(F.lit('[cols="1,1"]\n|===\n'), F.col("t"), F.lit("\n|==="))).alias("org"))


@query(
    f"""SELECT doc_id, coalesce(string_agg(CASE n % 4 WHEN 0 THEN concat('### 3-2-', pos % 9, '. ', line) WHEN 1 THEN concat('#### 3-2-', pos % 9, '-', n, '. ', line) ELSE line END, chr(10) ORDER BY pos) FILTER (n % 4 < 2 OR n % 7 > 0), '') AS t
    FROM {_COUNTED} GROUP BY doc_id"""
)
def chapter_demotion(spark, sf_dir):
    """STR-38/39: headings made of lines, demoted and renumbered, longest numbers first."""
    steps = (rx.Step("three", r" 6\.(\d+)\.(\d+) ", " 3-2-$1-$2. "), rx.Step("two", r" 6\.(\d+) ", " 3-2-$1. "))
    n, line, pos = F.col("n"), F.col("line"), (F.col("pos") % 9).cast("string")
    made = F.when(n % 4 == 0, F.concat(F.lit("## 6."), pos, F.lit(" "), line)).when(n % 4 == 1, F.concat(F.lit("### 6."), pos, F.lit("."), n.cast("string"), F.lit(" "), line)).when(n % 7 == 0, F.concat(F.lit("# "), line)).otherwise(line)
    return _joined(_lines(spark, sf_dir), made).select("doc_id", articles.demote(F.col("t"), steps).alias("t"))


# -- payloads and requests ---------------------------------------------------------------------------
#: Range of ids whose posts share a payload.
POSTS = 1000
_TITLE_WORDS = "(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2))"
_SAFE = f"regexp_replace({_TITLE_WORDS}, '[^A-Za-z ]', '', 'g')"


@query(f"SELECT source AS page, CAST(doc_id AS VARCHAR) AS log_no, trim(regexp_replace(concat({_SAFE}, ' & é'), ' +', ' ', 'g')) AS title, CASE WHEN doc_id % 3 = 0 THEN '0' ELSE CAST(doc_id % 17 AS VARCHAR) END AS category_no, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('2025. ', doc_id % 12) END AS add_date, CAST(count(*) OVER (PARTITION BY source) AS INT) AS total FROM documents")
def post_listing(spark, sf_dir):
    """SRC-20/21: listing payloads of every source, with a post for every document."""
    words = F.regexp_replace(F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))), "[^A-Za-z ]", "")
    title = F.concat(F.replace(words, F.lit(" "), F.lit("+")), F.lit("+%26amp%3B+%C3%A9"))
    number = F.col("doc_id").cast("string")
    category = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(',"categoryNo":"'), (F.col("doc_id") % 17).cast("string"), F.lit('"')))
    date = F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(',"addDate":"2025. '), (F.col("doc_id") % 12).cast("string"), F.lit('"')))
    post = F.concat(F.lit('{"logNo":"'), number, F.lit('","title":"'), title, F.lit('"'), category, date, F.lit("}"))
    docs = _docs(spark, sf_dir)
    # As the service does, a source's posts come in payloads of so many, each with the source's count.
    nth = F.floor(F.col("doc_id") / POSTS)
    pages = docs.groupBy(F.col("source").alias("page"), nth.alias("nth")).agg(F.concat(F.lit('{"postList":['), F.array_join(F.array_sort(F.collect_list(post)), ","), F.lit("]")).alias("posts"))
    counts = docs.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n"))
    pages = pages.join(counts, F.col("page").eqNullSafe(F.col("of"))).select("page", F.concat("posts", F.lit(',"totalCount":"'), F.col("n").cast("string"), F.lit('"}')).alias("raw"))
    return articles.listing(pages).withColumn("total", F.col("total").cast("int"))


@query("SELECT CAST(doc_id AS VARCHAR) AS no, lang AS name, CASE WHEN doc_id % 2 = 1 THEN CAST(doc_id // 2 AS VARCHAR) END AS parent, CASE WHEN doc_id % 2 = 1 THEN CAST(n_chars AS INT) ELSE 0 END AS post_count, doc_id % 2 = 0 OR doc_id % 3 = 0 AS open FROM documents")
def category_schemas(spark, sf_dir):
    """MSC-01, SRC-22: flat and nested category maps, one made of every document."""
    nested = F.to_json(F.struct(F.col("lang").alias("name"), F.floor(F.col("doc_id") / 2).alias("parent"), F.col("n_chars").alias("post_count"), (F.col("doc_id") % 3 == 0).alias("open")))
    flat = F.concat(F.lit('"'), "lang", F.lit('"'))
    raw = F.concat(F.lit('{"'), F.col("doc_id").cast("string"), F.lit('": '), F.when(F.col("doc_id") % 2 == 1, nested).otherwise(flat), F.lit("}"))
    return articles.category_table(_docs(spark, sf_dir).select(raw.alias("raw"))).withColumn("post_count", F.col("post_count").cast("int"))


_LOG = """(SELECT url AS page, unnest(range(len(h))) AS nth, unnest(h) AS h, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin FROM (SELECT url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))"""


@query(
    f"""WITH r AS (SELECT page, nth, origin, CASE WHEN length(h) % 5 = 0 THEN 404 ELSE 200 END AS status, CASE length(h) % 4 WHEN 0 THEN concat(origin, '/i') WHEN 1 THEN concat('https://cdn.net', h) WHEN 2 THEN concat('data:', h) ELSE concat(origin, h, '/favicon.ico') END AS url FROM {_LOG}),
    f AS (SELECT *, row_number() OVER (PARTITION BY page, url ORDER BY nth) AS k FROM r)
    SELECT page, url, status, CASE WHEN starts_with(url, 'data:') THEN 'data' WHEN status >= 400 AND NOT ends_with(url, 'favicon.ico') THEN 'failed' WHEN starts_with(url, origin) THEN 'own' ELSE 'external' END AS kind FROM f WHERE k = 1"""
)
def capsule_requests(spark, sf_dir):
    """JON-20, VER-02, MSC-20: the requests that every page's links make, by kind, the first of each URL."""
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("page"), F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("origin"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("nth", "h"))
    size = F.length("h")
    url = F.when(size % 4 == 0, F.concat("origin", F.lit("/i"))).when(size % 4 == 1, F.concat(F.lit("https://cdn.net"), "h")).when(size % 4 == 2, F.concat(F.lit("data:"), "h")).otherwise(F.concat("origin", "h", F.lit("/favicon.ico")))
    return articles.requests(rows.select("page", url.alias("url"), F.when(size % 5 == 0, 404).otherwise(200).alias("status"), "nth"))


@query(
    f"""SELECT doc_id, CAST(pos AS INT) AS pos, concat('…', substr(line, greatest(n // 2 - 4, 1), least(n // 2, 5)), '【', substr(line, n // 2 + 1, 3), '】', substr(line, n // 2 + 4, 5), '…') AS pre,
    replace(replace(concat(line, ' A', n, ' z'), concat('A', n), 'b'), 'z', {W2}) AS pairs FROM {_COUNTED} WHERE n > 0"""
)
def contexts_and_pairs(spark, sf_dir):
    """STR-52/57, MSC-11: the context of the middle of every line, and replacement pairs made of it."""
    n = F.col("n").cast("string")
    rows = _lines(spark, sf_dir).where("n > 0")
    raw = F.concat(F.lit("A"), n, F.lit("=b ;; z = "), F.expr(W2))
    context = markup.around(F.col("line"), (F.floor(F.col("n") / 2) + 1).cast("int"), F.lit(3), 5)
    return rows.select("doc_id", "pos", context.alias("pre"), web.replace_pairs(F.concat("line", F.lit(" A"), n, F.lit(" z")), web.pairs(raw)).alias("pairs"))
