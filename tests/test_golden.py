"""Golden rows of operators whose queries read the documents."""

from pyspark.sql import functions as F

from scrivano.functions import markup, rx, web
from scrivano.operators import articles, match, outline, parse
from scrivano.plans.fixtures import frame


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_tabs(spark):
    tabs = parse.split_tabs(frame(spark, "tabs"), "id")
    want = [(1, 1, "Main", "t.0", 0, 3, 4, "hello\nworld"), (1, 2, "Child", "t.1", 1, 6, 6, "in child"), (1, 3, "Last", None, 0, 8, 8, "end")]
    assert rows(tabs.select("id", "idx", "name", "tab_id", "depth", "line_start", "line_end", "content")) == want
    assert rows(parse.subtree(tabs, "mai", "id").select("id", "name")) == [(1, "Child"), (1, "Main")]


def test_recognised_blocks(spark):
    want = [(1, 0, "text", None, None, None, None, "lead text"), (1, 1, "title", 1, 2, 3, 4, "A title"), (1, 2, "text", 5, 6, 7, 8, "line one\nline two"), (1, 3, "image", 0, 0, 9, 9, "")]
    assert rows(parse.grounded_blocks(frame(spark, "grounded"))) == want


def test_suffix_join(spark):
    want = [(1, "1", "key", "one"), (2, "1.1", "key", "new"), (3, "4.1", "suffix", "new"), (4, "9.9", "none", None), (5, "2.3.4", "suffix", "deep")]
    assert rows(match.suffix_join(frame(spark, "template"), frame(spark, "content"), "k", "pos", ["body"])) == want


def test_exports_and_posts(spark):
    got = rows(frame(spark, "exports").select("id", web.clean_export(F.col("text"))))
    assert got == [(1, "# Head\n\nbody\n\n\nend\n\n```json\n{}\n```"), (2, "plain"), (3, "é")]
    images = web.image_rows(frame(spark, "albums").select("id", "media_type", "media_url", F.array("a", "b").alias("children")))
    assert rows(images) == [(1, "01", "u1"), (1, "02", "u2"), (2, "01", "s"), (4, "01", "w")]
    dates = frame(spark, "dates").select("id", web.post_time(F.col("text"), F.col("id")), web.expiry(F.col("expires"), F.to_date(F.lit("2025-01-14"))))
    assert sorted(map(tuple, dates.collect())) == [(1, "20250304T090501", "expired"), (3, None, "fortnight"), (4, "20240102T235904", "fine"), (5, None, "unknown"), (6, None, "unknown"), (75, "20251231T000015", "week")]
    assert [r.b for r in frame(spark, "images").orderBy("id").select(web.broken_image(F.col("size"), F.col("head")).alias("b")).collect()] == [True, True, False, False, True]


def test_notes_and_marks(spark):
    assert rows(frame(spark, "notes_fn").select("id", *web.footnotes(F.col("text")).values())) == [(1, "1", "10,2", "3"), (2, "", "", ""), (3, "", "", "1")]
    got = rows(frame(spark, "mixed_md").select("id", web.org_inline(F.col("text")), web.unnumbered(F.col("text"))))
    assert got == [
        (1, "*b* ~c~ [[u][t]] ![[i.png][a]]", "**b** `c` [t](u) ![a](i.png)"),
        (2, "### 1.2 Title\n## 3 keep\n#### *4) bold*\n### ① x", "### Title\n## 3 keep\n#### **bold**\n### x"),
        (3, "", ""),
    ]


def test_outlines(spark):
    lines = outline.date_tree_lines(frame(spark, "posts").where("text <> ''")).orderBy("ord").select(F.split_part("line", F.lit("\n"), F.lit(1)).alias("l"))
    assert [r.l for r in lines.collect()] == [
        "* 2025", "** 2025-03 March", "*** 2025-03-04 Tuesday", "**** 09:00 - short line", "**** 11:22 - #여행 오늘의 글", "* 2024", "** 2024-12 December", "*** 2024-12-31 Tuesday",
        "**** 23:00 - a line that is much longer than twenty characters",
    ]
    assert rows(outline.body_bounds(frame(spark, "blocks"), "open", ("Heading",))) == [(1, 0, 11)]
    slots = spark.createDataFrame([("a", 0, "템플릿1"), ("a", 5, "템플릿2"), ("b", 0, "템플릿3")], "section string, pos int, slot string")
    content = spark.createDataFrame([("a", 3, "one"), ("b", 1, "x"), ("b", 2, "y")], "section string, pos int, text string")
    want = [("a", 1, "템플릿1", "one", "filled"), ("a", 2, "템플릿2", "템플릿2", "short"), ("b", 1, "템플릿3", "x", "filled"), ("b", 2, None, "y", "extra")]
    assert rows(outline.fill_template(slots, content)) == want


def test_title_rules(spark):
    """The default categories on the golden titles, as they were stated with the first queries."""
    from scrivano.operators import classify

    got = {r.id: (r.category, r.score) for r in classify.classify(frame(spark, "titles"), classify.DEFAULT).collect()}
    assert got[1][0] == "development" and got[2][0] == "architecture" and got[3][0] == "operations" and got[4][0] == "products" and got[7] == ("_uncategorized", 0)
    assert [classify._sought(p) for p in (".*a.*", "^a.*", ".*a$", r"a\.*", "a.*b")] == ["a", "^a", "a$", r"a\.*", "a.*b"]


def test_layouts_and_cells(spark):
    want = [(1, 0, "page_boundary", "open sentence", "goes on"), (1, 2, "image_interrupt", "goes on", "after image."), (1, 5, "eq_interrupt", "next open", "eq end,"), (1, 7, "table_interrupt", "eq end,", "cell"), (1, 9, "samepage_break", "cell", "same page")]
    assert rows(parse.layout_splits(frame(spark, "blocks"))) == want
    cells = parse.adoc_cells(frame(spark, "adoc").where("line <> '|==='")).select("doc_id", "pos", "ord", "text", "colspan", "rowspan")
    assert rows(cells) == [(1, 1, 0, "a", 1, 1), (1, 1, 1, "b", 1, 1), (1, 1, 2, "c", 1, 1), (1, 2, 0, "wide", 2, 1), (1, 2, 1, "x", 1, 1), (1, 3, 0, "tall", 1, 3), (1, 3, 1, "y", 1, 1), (1, 4, 0, "both | sign", 2, 3)]


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_tables_and_headings(spark):
    assert one(spark, "x\n<table><tr><td>a</td><td>&gt;</td></tr><tr><th> b </th><td></td></tr></table>\ny", articles.tables_to_org) == "x\n| a | > |\n| b |  |\ny"
    assert one(spark, "* Energy \\(\\alpha_{1} \\leq \\mathrm{x}\\)\nbody \\(\\alpha\\)", articles.plain_headings) == "* Energy α_1 ≤\nbody \\(\\alpha\\)"
    assert one(spark, '[cols="1,1"]\n|===\n|h1\n|h2\n\n|a\n|b\n\n|c\n|===', articles.org_table) == "| h1 | h2 |\n|---+---|\n| a | b |\n| c |  |"
    steps = (rx.Step("three", r" 6\.(\d+)\.(\d+) ", " 3-2-$1-$2. "), rx.Step("two", r" 6\.(\d+) ", " 3-2-$1. "))
    assert one(spark, "# Title\ntext\n## 6.1 One\n### 6.1.4 Deep", lambda t: articles.demote(t, steps)) == "text\n### 3-2-1. One\n#### 3-2-1-4. Deep"


def test_payloads(spark):
    raw = '{"postList":[{"logNo":"11","title":"A+%26amp%3B+B","categoryNo":"5","addDate":"2025"},{"logNo":"12","title":"%ED%95%9C"}],"totalCount":"40"}'
    got = articles.listing(spark.createDataFrame([(1, raw)], "page int, raw string")).select("log_no", "title", "category_no", "add_date", "total").collect()
    assert sorted((r[0], r[1], r[2], r[3], int(r[4])) for r in got) == [("11", "A & B", "5", "2025", 40), ("12", "한", "0", "", 40)]
    raw = spark.createDataFrame([('{"57": "flat"}',), ('{"1": {"name": "root"}, "2": {"name": "leaf", "parent": 1, "post_count": 7, "open": false}}',)], "raw string")
    assert rows(articles.category_table(raw).select("no", "name", "parent", "post_count", "open")) == [("1", "root", None, 0, True), ("2", "leaf", "1", 7, False), ("57", "flat", None, 0, True)]
    p = "https://a/x"
    log = [(p, "https://a/i.png", 200, 1), (p, "https://a/i.png", 404, 2), (p, "https://b/j", 200, 3), (p, "data:1", 200, 4), (p, "https://a/favicon.ico", 404, 5), (p, "https://a/z", 404, 6)]
    got = articles.requests(spark.createDataFrame(log, "page string, url string, status int, nth int")).select("url", "status", "kind")
    assert rows(got) == sorted([("https://a/i.png", 200, "own"), ("https://b/j", 200, "external"), ("data:1", 200, "data"), ("https://a/favicon.ico", 404, "own"), ("https://a/z", 404, "failed")], key=str)


def test_tags_and_contexts(spark):
    got = rows(frame(spark, "raw_tags").select("id", web.raw_tag(F.col("tag")), web.clean_tag(F.col("tag"))))
    want = [(1, "철학,", "철학"), (2, "통일(종합)", "통일(종합)"), (3, "존재와_시간).", "존재와_시간"), (4, None, None), (5, None, None), (6, "λογος:", "λογος"), (7, "(a)b", "a)b"), (8, "A&B", "A&B"), (9, "[x]'", "x]")]
    assert got == want
    one_ = spark.createDataFrame([("abcdef", "x=A;;y=b ;; z = c", "x-y-z")], "t string, raw string, s string")
    assert tuple(one_.select(markup.around(F.col("t"), F.lit(3), F.lit(2), 2), web.replace_pairs(F.col("s"), web.pairs(F.col("raw")))).first()) == ("…ab【cd】ef…", "A-b-c")
