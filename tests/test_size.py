"""What a task holds or does must not grow with a group, a batch or a table."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from scrivano.functions import markup, names
from scrivano.operators import articles, classify, convert, match, parse, rules
from scrivano.operators.pieces import pieces
from scrivano.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_posts_of_a_payload_meet_by_number(spark):
    """no map of all posts for each post; of a repeated number the last category counts."""
    post = '{{"logNo":"{0}","title":"t{0}","categoryNo":"{1}","addDate":"d{0}"}}'
    raw = "[" + ",".join([post.format(k, k % 7) for k in range(3000)] + ['{"logNo":"5","categoryNo":"99"}']) + '],"totalCount":"3000"'
    rows = articles.listing(spark.createDataFrame([(None, raw)], "page int, raw string"))
    assert "map_from_arrays" not in plan(rows).lower()
    told = {r.log_no: tuple(r) for r in rows.collect()}
    assert len(told) == 3000 and told["5"] == (None, "5", "t5", "99", "d5", 3000)
    assert all(told[str(k)] == (None, str(k), f"t{k}", str(k % 7), f"d{k}", 3000) for k in range(3000) if k != 5)


def test_lines_stay_where_they_are(spark):
    """a source's lines are not dealt to one task; a table of many ranges gives the same rows."""
    lines = spark.range(600).selectExpr("id", "if(id % 3 = 0, 'a', 'b') AS source", "CAST(id AS INT) AS pos", "'x' AS line")
    ranges = spark.createDataFrame([(1, "a", 0, 299), (2, "b", 100, 199)], "out_ord int, source string, lo int, hi int")
    for f in (match.unused_lines, match.place_ranges):
        few = f(lines, ranges)
        assert "BroadcastHashJoin" in plan(few) and "BuildRight" in plan(few)
        match.RANGES, old = 1, match.RANGES
        try:
            many = f(lines, ranges)
        finally:
            match.RANGES = old
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_pieces_of_batches():
    """Python works on so many bytes of text at a time."""
    texts = ["é" * 100, None, "", "x" * 5000, "y" * 10, "z" * 990, "w", None]
    batch = pa.RecordBatch.from_pydict({"k": list(range(8)), "t": texts, "u": pa.array(["v"] * 8, pa.large_string())})
    got = list(pieces([batch, batch.slice(0, 0), batch.slice(3, 2)], 1000))
    assert [p.num_rows for p in got] == [3, 1, 1, 3, 1, 1]
    assert [x for p in got[:4] for x in p.column(1).to_pylist()] == texts and [x for p in got for x in p.column(0).to_pylist()] == [*range(8), 3, 4]
    sizes = [sum(len((x or "").encode()) + 1 for x in p.column(1).to_pylist()) for p in got]
    assert all(s <= 1000 or p.num_rows == 1 for s, p in zip(sizes, got, strict=True))


def column(spark, rows, schema, *made):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*made).collect()]


def test_seams_are_told_by_the_ends(spark):
    """the halves are trimmed once; rules on a tail's end don't search all of it."""
    made = markup.seam(F.col("t"), F.col("h"))
    rows = [("x" * 500 + " 물론 \n", "칸트"), ("물론", "칸트"), ("가물론", "칸트"), ("12 쪽", "a"), ("가으로서", "나"), ("가", "\t1"), ("", "a"), (None, "1"), ("가나다라마", None)]
    df = spark.createDataFrame(rows, "t string, h string").select(*(c.alias(k) for k, c in made.items()))
    assert "\\s+\\z" not in plan(df)
    want = [("space", "adv-tail")] * 2 + [("nospace", "mid-eojeol"), ("skip", "pageref-tail"), ("space", "josa/ending"), ("skip", "digit-head"), ("skip", "empty"), ("skip", "digit-head"), ("nospace", "mid-eojeol")]
    assert [tuple(r) for r in df.collect()] == want


def test_tags_without_lambdas(spark):
    """in a lambda's neighbourhood the text would be lowered anew for every tag."""
    df = spark.createDataFrame([("API API", None), (None, "Docker, python 데이터베이스"), (None, None)], "t string, x string")
    made = df.select(classify.auto_tags(F.col("t"), F.col("x"), ("python", "api", "db", "docker"), {"데이터베이스": "db"}).alias("tags"))
    assert "lambda" not in plan(made)
    assert [r.tags for r in made.collect()] == [["api"], ["db", "docker", "python"], []]


def test_slugs_from_words_found_once(spark):
    """the words of a title are found once for both slugs."""
    assert plan(catalog.QUERIES["title_slugs"](spark, SF)).count("[^\\p{L}\\p{N}_") == 1
    titles = [(t,) for t in ("Ab - -cD É-Éa ΑΣ", " -a_b-- ", "all low é", "", None, "Xy!!z  Q")]
    made = column(spark, titles, "t string", names.slug(F.col("t")), names.blog_slug(F.col("t"), 5))
    assert made == [("ab-cd-É-Éa-ΑΣ", "ab-cd"), ("-a_b-", "-a_b-"), ("all-low-é", "all-l"), ("", ""), (None, None), ("xyz-q", "xyz-q")]


def test_content_keys_of_all_modes(spark):
    """the three keys at once are those of each mode."""
    texts = [(t,) for t in ("a [fn:1] (b)\n [fn:1] note *c*\n#+x: y", "# no *notes* here", "[fn:2] only", "", None, ":ABC:\n　z")]
    made = column(spark, texts, "t string", markup.content_keys(F.col("t")), *(markup.content_key(F.col("t"), m) for m in ("keep", "drop", "only")))
    assert [tuple(k or [None] * 3) for k, *_ in made] == [tuple(m) for _, *m in made]


def test_documents_are_read_once(spark):
    """both forms of a structured document come from one reading, without a shuffle."""
    made = plan(catalog.QUERIES["doc_json_markdown"](spark, SF))
    assert made.count("from_json(") == 1 and "Exchange" not in made


def test_marks_are_dealt_by_a_number(spark):
    """marks of pages are not merged into few tasks by their compressed size."""
    assert plan(catalog.QUERIES["page_cleaned"](spark, SF)).count("REPARTITION_BY_NUM") >= 1


def test_tabs_are_read_where_they_are(spark):
    """F8: a text's tokens are no rows of shuffles; broken texts and odd strings give what the brackets say."""
    assert "Exchange" not in plan(catalog.QUERIES["doc_tab_tree"](spark, SF))
    own = '{"tabProperties":{"title":%s,"tabId":%s}'
    texts = [
        (1, "]}" + '{"tabs":[' + own % ('"\\ud83d\\ude00 \\ud83d"', "5") + ',"childTabs" : [{}]},' + own % ('"b"', '"2","tabId":"10"') + "]"),
        (2, '{"other":[' + own % ('"x"', '"y"') + '}],"tabs":[' + own % ('"' + "\\n" * 20000 + '"', "null")),
        (None, '{"tabs":[{"a":{"tabProperties":{"title":"deeper"}},"tabProperties":{"title":"bad \\x"}}]}'),
        (4, None),
    ]
    got = [tuple(r) for r in convert.json_tabs(spark.createDataFrame(texts, "doc_id int, json string")).collect()]
    want = [(1, 0, "", "😀 ?", 0), (1, 1, "", "Untitled", 1), (1, 2, "2", "b", 0), (2, 0, "", "\n" * 20000, 0), (None, 0, "", "Untitled", 0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rules_are_folded_once(spark):
    """the fold over a text is in a plan once; candidates are found where the text is."""
    for name in ("doc_rule_candidates", "doc_rule_audit", "doc_rules"):
        made = plan(catalog.QUERIES[name](spark, SF))
        assert len(re.findall(r"(?<![a-z_])aggregate\(", made.split("+- FileScan")[0].split("Initial Plan")[0])) == 1, name
        assert "SortMergeJoin" not in made and "hashpartitioning" not in made


def test_candidates_of_long_and_odd_texts(spark):
    """contexts by place in code points, many rows of one text, empty matches, null keys and texts."""
    table = spark.createDataFrame([(1, "literal", "b", "bb", "twice"), (2, "candidate", "[a😀]", None, "one"), (3, "candidate", "c*", None, None), (4, "candidate", "zz", None, "none")], rules.SCHEMA)
    texts = [(1, "😀b\na" * 6000), (None, "acca"), (3, None), (4, "")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    counted, plain = rules.rewritten(docs, table), rules.rewritten(docs, table, counted=False)
    assert sorted(map(str, counted.select("doc_id", "text").collect())) == sorted(map(str, plain.collect()))
    assert [tuple(r) for r in rules.audit(counted).collect()] == [(1, 1, "twice", 6000)]
    want = []
    for k, text in texts:
        text = (text or "").replace("b", "bb")
        for ord_, note, pattern in ((2, "one", "[a😀]"), (3, "", "c+")):
            want += [(k, ord_, note, m.start(), text[max(m.start() - 12, 0) : m.end() + 12].replace("\n", " ")) for m in re.finditer(pattern, text)]
    for done in (counted, plain):
        assert sorted((tuple(r) for r in rules.candidates(done, table).collect()), key=str) == sorted(want, key=str)


def test_outlines_are_read_where_they_are(spark):
    """a text is searched once, its tokens are no rows of shuffles; texts without a key stay apart."""
    made = plan(catalog.QUERIES["org_tree"](spark, SF))
    assert "Exchange" not in made and made.count("regexp_extract_all(text") == 1
    texts = [(None, "** a\n#+HWPX: 7\nx"), (None, "#+HWPX: 1\n#+HWPX: 2\n\ny\nz\n#+HWPX: 3"), (3, "u\n* b\n*** c\n** d\nv"), (4, ""), (5, None), (6, "* b\n" * 12000 + "w")]
    rows = [tuple(r) for r in parse.org_elements(spark.createDataFrame(texts, "doc_id int, text string").repartition(1)).collect()]
    got = {t: [r[2:] for r in rows if r[0] == t] for t in (3, 6)}
    assert not [r for r in rows if r[0] in (4, 5)]
    by = {r[4]: r for r in rows if r[0] is None}
    assert [by[t][5:] for t in "axyz"] == [(None, None, 1, None), (7, 0, 2, 1), (2, None, 1, None), (None, None, 2, None)]
    assert got[3] == [("paragraph", 0, "u", None, None, 1, None), ("heading", 1, "b", None, None, 2, None), ("heading", 3, "c", None, 1, 3, 2), ("heading", 2, "d", None, 1, 4, 2), ("paragraph", 0, "v", None, 3, 5, 4)]
    assert [r[5] for r in got[6]] == list(range(1, 12002)) and got[6][-1][4:] == (11999, 12001, 12000)
