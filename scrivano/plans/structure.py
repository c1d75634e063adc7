"""Queries over nested structure: elements of pages, trees of tabs, documents of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convert, tree
from .registry import query, table


# -- pages -------------------------------------------------------------------------
def _tags_sql(raw: tuple[str, ...]) -> str:
    """Tags of every page with their places and signs, by DuckDB's own lists."""
    p = tree.tag_pattern(raw)
    alone = ", ".join(f"'{n}'" for n in ("!", *raw, *tree.VOID))
    return f"""
        c AS (SELECT page_id, string_split_regex(html, '{p}') AS g, regexp_extract_all(html, '{p}') AS f FROM pages),
        m AS (SELECT page_id, unnest(range(len(f))) AS ord, unnest(list_slice(g, 1, len(f))) AS gap, unnest(f) AS tag FROM c),
        t AS (SELECT page_id, ord, name, tag, stop - length(tag) AS start, stop,
                     CASE WHEN name IN ({alone}) OR ends_with(tag, '/>') THEN 0 WHEN starts_with(tag, '</') THEN -1 ELSE 1 END AS sign
              FROM (SELECT *, CASE WHEN starts_with(tag, '<!--') THEN '!' ELSE lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9:-]*)', 1)) END AS name,
                           sum(length(gap) + length(tag)) OVER (PARTITION BY page_id ORDER BY ord) AS stop FROM m)),
        l AS (SELECT *, sum(sign) OVER (PARTITION BY page_id, name ORDER BY ord) AS level FROM t),
        -- The end of an opening tag: the first later tag of its name where the level is below the opening one's.
        o AS (SELECT a.page_id, a.ord, min(b.ord) AS last FROM l a JOIN l b ON a.page_id = b.page_id AND a.name = b.name AND b.ord > a.ord AND b.level = a.level - 1
              WHERE a.sign = 1 GROUP BY ALL),
        -- Without one: the innermost closed element around it.
        u AS (SELECT a.page_id, a.ord, min(o.last) AS last FROM l a JOIN o ON a.page_id = o.page_id AND o.ord < a.ord AND o.last > a.ord
              WHERE a.sign = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.page_id = a.page_id AND o.ord = a.ord) GROUP BY ALL),
        e AS (SELECT l.page_id, l.ord, l.name, l.tag, l.start, CASE WHEN l.sign = 0 THEN 0 ELSE l.level END AS depth, l.sign = 0 OR o.last IS NOT NULL AS closed,
                     CASE WHEN l.sign = 0 THEN l.ord ELSE coalesce(o.last, u.last) END AS last,
                     CASE WHEN l.sign = 0 THEN l.stop WHEN o.last IS NOT NULL THEN z.stop ELSE z.start END AS "end"
              FROM l LEFT JOIN o ON o.page_id = l.page_id AND o.ord = l.ord LEFT JOIN u ON u.page_id = l.page_id AND u.ord = l.ord
              LEFT JOIN t z ON z.page_id = l.page_id AND z.ord = coalesce(o.last, u.last) WHERE l.sign >= 0)"""


@query(f"""WITH {_tags_sql(tree.RAW)} SELECT page_id, CAST(ord AS INT) AS ord, name, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", CAST(depth AS BIGINT) AS depth, closed FROM e""")
def page_elements(spark, sf_dir):
    """SRC-24: every element of every page with its balanced end, unclosed ones with that of the element around them."""
    return tree.elements(tree.tags(table(spark, sf_dir, "pages"))).select("page_id", "ord", "name", "start", "end", "depth", "closed")


_STRIPPED = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _named_sql(x: str) -> str:
    from ..functions.markup import ENTITIES

    for name, plain in sorted(ENTITIES, key=lambda e: e[0] == "&amp;"):
        x = "replace({}, '{}', '{}')".format(x, name, plain.replace("'", "''"))
    return x


_CLEAN = f"""WITH {_tags_sql(tree.RAW + tree.FORMULAS)},
    r AS (SELECT page_id, arg_min(ord, (k, ord)) AS a, coalesce(arg_min(last, (k, ord)), 2147483647) AS z
          FROM (SELECT *, CASE name WHEN 'article' THEN 0 WHEN 'body' THEN 1 END AS k FROM e) WHERE k IS NOT NULL GROUP BY page_id),
    i AS (SELECT e.page_id, ord, coalesce(last, 2147483647) AS last, name FROM e JOIN r ON e.page_id = r.page_id AND ord > a AND ord < z),
    k AS (SELECT * FROM i WHERE name IN ('h1', 'h2', 'h3') OR (name IN ('div', 'p')
          AND NOT EXISTS (SELECT 1 FROM i j WHERE j.page_id = i.page_id AND j.name IN ('h1', 'h2', 'h3', 'figure') AND j.ord > i.ord AND j.ord < i.last))),
    x AS (SELECT k.page_id, k.ord AS pos, k.name, {_named_sql("array_to_string(list_transform(list_slice(g, k.ord + 2, k.last + 1), lambda s: " + _STRIPPED.format(x="s") + "), '')")} AS text
          FROM k JOIN c ON c.page_id = k.page_id),
    f AS (SELECT *, name[1] = 'h' AS head FROM x WHERE CASE WHEN name[1] = 'h' THEN length(text) BETWEEN 2 AND 50 ELSE length(text) >= 10 END)"""


def _cleaned(spark, sf_dir):
    name = F.col("name")
    return tree.clean_pages(table(spark, sf_dir, "pages"), [name == "article", name == "body"])


@query(f"""{_CLEAN} SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN head THEN name ELSE 'p' END AS kind, text,
    CASE WHEN head THEN concat('section-', sum(CAST(head AS BIGINT)) OVER (PARTITION BY page_id ORDER BY pos)) END AS section FROM f""")
def page_cleaned(spark, sf_dir):
    """HTML-09, FLT-05/06: headings and paragraphs of every page's content, numbered, in order."""
    return _cleaned(spark, sf_dir)


@query(f"""{_CLEAN}, s AS (SELECT *, sum(CAST(head AS BIGINT)) OVER (PARTITION BY page_id ORDER BY pos) AS n FROM f)
    SELECT page_id, arg_min(text, pos) FILTER (name = 'h1') AS title,
           coalesce(string_agg(concat(CASE WHEN name = 'h2' THEN '  ' ELSE '' END, '- [', text, '](#section-', n, ')'), chr(10) ORDER BY pos) FILTER (name IN ('h1', 'h2')), '') AS contents,
           count(*) FILTER (head) AS n_headings, count(*) FILTER (NOT head) AS n_paragraphs, CAST(0 AS BIGINT) AS n_figures FROM s GROUP BY page_id""")
def page_contents(spark, sf_dir):
    """HTML-09: title, contents and counts of every cleaned page."""
    return tree.contents(_cleaned(spark, sf_dir))


@query(f"""WITH {_tags_sql(tree.RAW)},
    b AS (SELECT page_id, min(ord) AS a FROM e WHERE name = 'article' GROUP BY page_id),
    n AS (SELECT page_id, max(ord) AS final FROM t WHERE name = 'article' GROUP BY page_id),
    w AS (SELECT b.page_id, a, CASE WHEN e.closed THEN e.last ELSE final END AS z FROM b JOIN e ON e.page_id = b.page_id AND e.ord = b.a JOIN n ON n.page_id = b.page_id)
    SELECT e.page_id, CAST(e.last AS INT) AS pos, 'text' AS kind, {_STRIPPED.format(x="array_to_string(list_slice(g, e.ord + 2, e.last + 1), '')")} AS text
    FROM e JOIN w ON e.page_id = w.page_id AND e.ord > a AND e.ord < z JOIN c ON c.page_id = e.page_id
    WHERE name = 'p' AND closed AND {_STRIPPED.format(x="array_to_string(list_slice(g, e.ord + 2, e.last + 1), '')")} <> ''""")
def page_body_blocks(spark, sf_dir):
    """SRC-24: paragraphs (and images, where there are any) of every page's container, in order."""
    return tree.content_blocks(table(spark, sf_dir, "pages"), F.lit(True), container="article")


#: Parts of the pages, the most important first: what is no content hides what is inside.
_PARTS = (("skip", r"(?is)<(?:script|style|head|nav|footer)\b.*?</(?:script|style|head|nav|footer)>|<!--.*?-->"), ("heading", "(?is)<h[1-6][^>]*>.*?</h[1-6]>"), ("image", "(?is)<img[^>]*>"), ("text", "(?is)<p>[^<]*"), ("break", "(?is)<br[^>]*>"), ("mark", r"(?is)<b>[^<\s]+"))


def _stream_sql() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT page_id, {rank} AS rank, '{kind}' AS kind, unnest(f) AS found, unnest(list_transform(range(1, len(f) + 1), lambda i: list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(f, 1, i - 1), lambda x: length(x))), 0))) AS start
            FROM (SELECT page_id, string_split_regex(html, '{p}') AS g, regexp_extract_all(html, '{p}') AS f FROM pages)"""
        for rank, (kind, p) in enumerate(_PARTS)
    )
    kept, ctes = "SELECT * FROM p WHERE rank = 0", []
    for rank in range(len(_PARTS)):
        if rank:
            kept = f"SELECT * FROM k{rank - 1} UNION ALL SELECT * FROM p WHERE rank = {rank} AND NOT EXISTS (SELECT 1 FROM k{rank - 1} k WHERE k.page_id = p.page_id AND k.start < p.start + length(p.found) AND k.start + length(k.found) > p.start)"
        ctes.append(f"k{rank} AS ({kept})")
    return f"WITH p AS ({parts}), {', '.join(ctes)} SELECT page_id, CAST(start AS BIGINT) AS start, CAST(start + length(found) AS BIGINT) AS stop, kind, found FROM k{len(_PARTS) - 1}"


@query(_stream_sql())
def page_stream(spark, sf_dir):
    """HTML-07, SRC-23: headings, texts, images and marks of every page in one stream, overlaps settled by priority."""
    return tree.ordered_stream(table(spark, sf_dir, "pages"), list(_PARTS))


# -- Markdown ------------------------------------------------------------------------
#: What a line of a document becomes, by its length modulo 16: every construct of Markdown, open and closed.
_MARKS = (
    ("# ", ""), ("### ", "  "), ("```python ", ""), ("```", None), ("| ", " | **b** |"), ("|---| --- |", None), ("> ", ""), ("<!-- ", ""), ("", " -->"), ("  <!-- x -->  ", None), ("---", None), ("", None), ("**bold** `code` ", " [l](u) ![i](v)"), (">", ""), ("", ""), ("```", "```"),
)


def _markdown(spark, sf_dir):
    """Documents as Markdown: each line dressed by its length."""

    def dressed(x):
        out = x
        for k, (left, right) in enumerate(_MARKS):
            out = F.when(F.length(x) % len(_MARKS) == k, F.lit(left) if right is None else F.concat(F.lit(left), x, F.lit(right))).otherwise(out)
        return out

    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), dressed), "\n").alias("text"))


def _dressed_sql() -> str:
    return "CASE length(x) % 16 " + " ".join(f"WHEN {k} THEN " + (f"'{left}'" if right is None else f"concat('{left}', x, '{right}')") for k, (left, right) in enumerate(_MARKS)) + " END"


def _inline_sql(x: str) -> str:
    x = f"regexp_replace({x}, '\\*\\*([^*]+)\\*\\*', '*\\1*', 'g')"
    return f"regexp_replace(regexp_replace({x}, '`([^`]+)`', '~\\1~', 'g'), '\\[([^\\]]+)\\]\\(([^)]+)\\)', '[[\\2][\\1]]', 'g')"


_BARE = r"regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
#: The automaton line by line, as a recursion; then what each line gives.
_ORG = rf"""
    WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_dressed_sql()} AS line
                      FROM (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
    f AS MATERIALIZED (SELECT *, {_BARE} AS bare, regexp_matches(line, '^\s*<!--.*-->\s*$') AS one, regexp_matches(line, '^\s*<!--') AND NOT contains(line, '-->') AS opens FROM l),
    g AS MATERIALIZED (SELECT *, CASE WHEN opens THEN 1 WHEN starts_with(line, '```') THEN 2 ELSE 0 END AS n, CASE WHEN contains(line, '-->') THEN 0 ELSE 1 END AS c,
                 CASE WHEN regexp_matches(line, '^```\s*$') THEN 0 ELSE 2 END AS k FROM f),
    w(doc_id, pos, state, after) AS (
        SELECT doc_id, pos, 0, n FROM g WHERE pos = 0
        UNION ALL SELECT g.doc_id, g.pos, w.after, CASE w.after WHEN 0 THEN g.n WHEN 1 THEN g.c ELSE g.k END FROM w JOIN g ON g.doc_id = w.doc_id AND g.pos = w.pos + 1),
    s AS (SELECT g.*, w.state, w.after, CASE WHEN state = 2 THEN CASE WHEN k = 0 THEN 'end' ELSE 'code' END WHEN state = 1 OR one OR opens THEN 'gone' WHEN bare = '' THEN 'blank'
                 WHEN regexp_matches(bare, '^-{{3,}}$') THEN 'rule' WHEN regexp_matches(line, '^#{{1,6}}\s+.+$') THEN 'heading' WHEN starts_with(line, '```') THEN 'begin'
                 WHEN starts_with(bare, '|') THEN 'table' WHEN starts_with(bare, '>') THEN 'quote' ELSE 'text' END AS kind
          FROM g JOIN w USING (doc_id, pos)),
    t AS (SELECT *, lag(kind) OVER v AS before, lead(kind) OVER v AS next, last_value(CASE WHEN kind = 'begin' THEN regexp_extract(line, '^```([\p{{L}}\p{{N}}_]*)', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS lang
          FROM s WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
    o AS (SELECT doc_id, pos, concat(CASE kind
        WHEN 'blank' THEN chr(10) WHEN 'rule' THEN concat('-----', chr(10))
        WHEN 'heading' THEN concat(repeat('*', length(regexp_extract(line, '^(#{{1,6}})', 1))), ' ', {_inline_sql("regexp_replace(bare, '^#+[[:space:]]+', '')")}, chr(10), chr(10))
        WHEN 'begin' THEN concat(CASE WHEN lang <> '' THEN '#+BEGIN_SRC ' || lang ELSE '#+BEGIN_EXAMPLE' END, chr(10))
        WHEN 'code' THEN concat(line, chr(10))
        WHEN 'end' THEN concat(CASE WHEN lang <> '' THEN '#+END_SRC' ELSE '#+END_EXAMPLE' END, chr(10), chr(10))
        WHEN 'table' THEN concat(CASE WHEN regexp_matches(bare, '^\|[\s\-:]+\|$') OR regexp_matches(bare, '^\|(\s*-+\s*\|)+\s*$') THEN concat('|', array_to_string(list_transform(list_filter(string_split(bare, '|'), lambda c: trim(c) <> ''), lambda c: '----------'), '+'), '|') ELSE {_inline_sql("bare")} END, chr(10), CASE WHEN next IS DISTINCT FROM 'table' THEN chr(10) ELSE '' END)
        WHEN 'quote' THEN concat(CASE WHEN before IS DISTINCT FROM 'quote' THEN '#+BEGIN_QUOTE' || chr(10) ELSE '' END, regexp_replace(line, '^>\s?', ''), chr(10), CASE WHEN next IS DISTINCT FROM 'quote' THEN '#+END_QUOTE' || chr(10) || chr(10) ELSE '' END)
        WHEN 'text' THEN concat({_inline_sql("line")}, chr(10)) ELSE '' END,
        CASE WHEN next IS NULL AND after = 2 THEN concat(CASE WHEN lang <> '' THEN '#+END_SRC' ELSE '#+END_EXAMPLE' END, chr(10), chr(10)) ELSE '' END) AS part FROM t),
    z AS (SELECT doc_id, string_agg(part, '' ORDER BY pos) AS org FROM o GROUP BY doc_id)
    SELECT doc_id, CASE WHEN org = '' THEN '' ELSE left(org, length(org) - 1) END AS org FROM z"""


@query(_ORG)
def doc_markdown_org(spark, sf_dir):
    """STM-05: every document, its lines dressed as Markdown, in Org; the SQL walks line by line."""
    return convert.markdown_to_org(_markdown(spark, sf_dir))


# -- structured documents --------------------------------------------------------------
_DOC_LINES = "(SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


def _structured(spark, sf_dir):
    """Documents as structured JSON: headings, lists three deep, tables, and runs of four styles, by the lines' lengths."""

    def word(x, k):
        return F.coalesce(F.get(F.split(x, " ", -1), F.lit(k)), F.lit(""))

    def run(text, bold=None, italic=None, font=None, url=None):
        style = F.struct(F.lit(bold).cast("boolean").alias("bold"), F.lit(italic).cast("boolean").alias("italic"), F.when(F.lit(font is not None), F.struct(F.lit(font).alias("fontFamily"))).alias("weightedFontFamily"), F.when(F.lit(url is not None), F.struct(F.lit(url).alias("url"))).alias("link"))
        return F.struct(F.struct(text.alias("content"), style.alias("textStyle")).alias("textRun"))

    def paragraph(runs, style=None, bullet=None):
        return F.struct(F.struct(style.alias("namedStyleType")).alias("paragraphStyle") if style is not None else F.lit(None).cast("struct<namedStyleType:string>").alias("paragraphStyle"), (bullet if bullet is not None else F.lit(None).cast("struct<listId:string,nestingLevel:int>")).alias("bullet"), runs.alias("elements"))

    def part(x, i):
        blank = F.lit(" ")
        rest = F.concat(blank, F.array_join(F.slice(F.split(x, " ", -1), 5, 2**31 - 1), " "))
        runs = F.array(run(F.concat(word(x, 0), blank), bold=True), run(F.concat(word(x, 1), blank), italic=True), run(word(x, 2), font="Courier New"), run(word(x, 3), url="u"), run(rest))
        n = F.length(x)
        style = F.when(n % 8 == 0, F.concat(F.lit("HEADING_"), (i % 3 + 1).cast("string"))).otherwise(F.lit("NORMAL_TEXT"))
        bullet = F.when((n % 8).between(1, 3), F.struct(F.when(F.floor(n / 8) % 3 > 0, F.lit("a")).otherwise(F.lit("b")).alias("listId"), (n % 3).cast("int").alias("nestingLevel")))
        cell = lambda k: F.struct(F.array(F.struct(paragraph(F.array(run(word(x, k)))).alias("paragraph"))).alias("content"))
        rows = F.array(F.struct(F.array(cell(0), cell(1)).alias("tableCells")), F.struct(F.array(cell(2), cell(3)).alias("tableCells")))
        return F.struct(F.when(n % 8 != 4, paragraph(runs, style, bullet)).alias("paragraph"), F.when(n % 8 == 4, F.struct(rows.alias("tableRows"))).alias("table"))

    def glyphs(*names):
        return F.struct(F.array(*(F.struct(F.lit(g).alias("glyphType")) for g in names)).alias("nestingLevels"))

    lists = F.create_map(F.lit("a"), glyphs("DECIMAL", "ALPHA", "ROMAN"), F.lit("b"), glyphs("BULLET", "BULLET", "BULLET"))
    content = F.transform(F.split("text", "\n", -1), part)
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.struct(content.alias("content")).alias("body"), lists.alias("lists"))).alias("json"))


_STRUCTURED = r"""
    WITH l AS (SELECT doc_id, pos, x, length(x) AS n, list_transform([1, 2, 3, 4], lambda k: coalesce(string_split(x, ' ')[k], '')) AS w, array_to_string(list_slice(string_split(x, ' '), 5, NULL), ' ') AS rest FROM """ + _DOC_LINES + r"""),
    p AS (SELECT *, regexp_replace(concat('**', trim(w[1]), '***', trim(w[2]), '*`', trim(w[3]), '`[', trim(w[4]), '](u) ', rest), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS t,
                 CASE WHEN n % 8 = 4 THEN 'table' WHEN n % 8 = 0 THEN 'heading' WHEN n % 8 <= 3 THEN 'item' ELSE 'paragraph' END AS kind, n % 3 AS level, (n // 8) % 3 > 0 AS ordered FROM l),
    q AS (SELECT a.*, (SELECT count(*) FROM p b WHERE b.doc_id = a.doc_id AND b.kind = 'item' AND b.level = a.level AND b.ordered AND b.pos <= a.pos
                       AND b.pos > coalesce((SELECT max(c.pos) FROM p c WHERE c.doc_id = a.doc_id AND c.pos < a.pos AND (c.kind <> 'item' OR c.level < a.level)), -1)) AS nth FROM p a),
    r AS (SELECT doc_id, pos, unnest([false, true]) AS counted, kind, level, ordered, nth, t, w, pos % 3 + 1 AS h FROM q),
    s AS (SELECT doc_id, pos, counted, CASE kind WHEN 'heading' THEN concat(repeat('#', CAST(h AS INT)), ' ', t, chr(10), chr(10))
             WHEN 'item' THEN concat(repeat('   ', CAST(level AS INT)), CASE WHEN ordered AND counted THEN concat(nth, '. ') WHEN ordered THEN '1. ' ELSE '- ' END, t, chr(10))
             WHEN 'table' THEN concat('| ', trim(w[1]), ' | ', trim(w[2]), ' |', chr(10), '|---|---|', chr(10), '| ', trim(w[3]), ' | ', trim(w[4]), ' |', chr(10), chr(10)) ELSE concat(t, chr(10), chr(10)) END AS part FROM r)
    SELECT doc_id, left(string_agg(part, '' ORDER BY pos) FILTER (NOT counted), -1) AS markdown, left(string_agg(part, '' ORDER BY pos) FILTER (counted), -1) AS counted FROM s GROUP BY doc_id"""


@query(_STRUCTURED)
def doc_json_markdown(spark, sf_dir):
    """STM-06: structured JSON made of every document as Markdown, plain and with counted lists."""
    return convert.documents_to_markdown(_structured(spark, sf_dir))


def _nested(spark, sf_dir):
    """Documents as trees of tabs: a line's depth grows line by line and falls to the top again, up to 40 deep."""
    wide = F.col("doc_id") % 40 + 2

    def depth(i):
        return i % wide

    def part(x, i):
        own = F.struct(F.concat(F.lit("t."), i.cast("string")).alias("tabId"), x.alias("title"))
        deeper = (depth(i + 1) > depth(i)) & (i + 1 < F.size("l"))
        left = F.when((i > 0) & (depth(i) <= depth(i - 1)), F.lit(",")).otherwise(F.lit(""))
        up = F.when(i + 1 < F.size("l"), depth(i) - depth(i + 1)).otherwise(depth(i)).cast("int")
        right = F.when(deeper, F.lit(',"childTabs":[')).otherwise(F.concat(F.lit("}"), F.repeat(F.lit("]}"), up)))
        return F.concat(left, F.lit('{"tabProperties":'), F.to_json(own), right)

    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    return docs.select("doc_id", F.concat(F.lit('{"tabs":['), F.array_join(F.transform("l", part), ""), F.lit("]}")).alias("json"))


@query(f"SELECT doc_id, CAST(pos AS INT) AS idx, concat('t.', pos) AS tab_id, x AS title, CAST(pos % (doc_id % 40 + 2) AS BIGINT) AS depth FROM {_DOC_LINES}")
def doc_tab_tree(spark, sf_dir):
    """SRC-11: trees of tabs made of every document, flattened in preorder with their depths."""
    return convert.json_tabs(_nested(spark, sf_dir))
