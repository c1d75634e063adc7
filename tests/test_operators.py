"""Operators against independent Python, on golden rows."""

import collections
import difflib
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrivano.functions import markup, names, rx, web
from scrivano.operators import analytics, books, classify, evaluate, lines, match, parse
from scrivano.plans import catalog


def column(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_strip_is_python_strip(spark):
    texts = ["  a b\t", "　x ", "", "\n\n", "y"]
    assert column(spark, texts, rx.strip) == [t.strip() for t in texts]


def test_explode_then_assemble_is_identity(spark):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, ""), (3, "\n"), (4, "one")], "doc_id int, text string")
    back = lines.assemble(lines.explode_lines(docs))
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in docs.collect()}


def unfilled(text):
    out, held, block = [], [], False

    def flush():
        if held:
            out.append(" ".join(held))
            held.clear()

    for row in text.split("\n"):
        s = row.strip()
        low = s.lower()
        if low.startswith("#+begin_") or low.startswith("#+end_"):
            flush()
            block = low.startswith("#+begin_")
            out.append(row)
        elif block or not s or s.startswith(("* ", "#+", "- ")):
            flush()
            out.append(row)
        else:
            held.append(s)
    flush()
    return "\n".join(out)


def test_unfill_against_a_loop(spark):
    rng = random.Random(3)
    parts = ["", "text one", "  more text ", "* Head", "- item", "#+begin_src", "#+end_src", "#+title: x"]
    docs = []
    for k in range(60):
        rows, opened = [], False
        for _ in range(rng.randint(0, 12)):
            p = rng.choice(parts)
            if p == "#+begin_src":
                if opened:
                    continue
                opened = True
            if p == "#+end_src":
                if not opened:
                    continue
                opened = False
            rows.append(p)
        docs.append((k, "\n".join(rows)))
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = {r.doc_id: r.text for r in lines.assemble(lines.unfill(lines.explode_lines(df))).collect()}
    assert got == {k: unfilled(t) for k, t in docs}


def test_parents(spark):
    rows = [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 4, 4), (1, 5, 1), (1, 6, 3)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, level int")
    got = {r.pos: r.parent for r in lines.parents(df).collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 0, 4: 3, 5: None, 6: 5}


def test_block_flag(spark):
    rows = [(1, k, x) for k, x in enumerate(["a", "begin", "b", "end", "c"])]
    df = spark.createDataFrame(rows, "doc_id int, pos int, line string")
    got = lines.in_block(df, F.col("line") == "begin", F.col("line") == "end").orderBy("pos").collect()
    assert [r.in_block for r in got] == [False, True, True, True, False]


def test_classify_ties_caps_and_threshold(spark):
    rules = (classify.Category("a", ("x",)), classify.Category("b", ("x", "y"), ("^z",)), classify.Category("many", tuple(f"k{i:02d}" for i in range(20))))
    rows = [(1, "x", "x x", ""), (2, "zx y", "", ""), (3, " ".join(f"k{i:02d}" for i in range(20)), "", ""), (4, None, None, None), (5, "", "." * 500 + "x", "")]
    df = spark.createDataFrame(rows, "id int, title string, text string, name string")
    got = {r.id: r for r in classify.classify(df, rules).collect()}
    assert (got[1].score, got[1].category) == (15, "_uncategorized")
    assert (got[2].score, got[2].category, got[2].needs_review) == (35, "b", False)
    assert (got[3].score, got[3].category) == (100, "many")
    assert got[4].score == 0 and got[5].score == 0


def test_name_round_trip(spark):
    df = spark.sql("SELECT timestamp'2025-03-04 11:22:33' AS ts, 'My API 제목!' AS title")
    made = df.select(names.file_name(F.col("ts"), F.col("title"), F.array(F.lit("가이드"), F.lit("Dev"), F.lit("dev")), F.lit("org")).alias("n"))
    assert made.first().n == "20250304t112233--my-api-제목__dev_guide.org"
    part = made.select(*(c.alias(k) for k, c in names.parse_name(F.col("n")).items())).first()
    assert (part.stamp, part.title, part.tags, part.ext) == ("20250304T112233", "my-api-제목", "dev_guide", "org")


def test_chapter_numbers(spark):
    assert column(spark, ["CHAPTER IV", "제IV장", "제 3 장", "chapter 12", "none"], markup.roman) == ["제4장", "제4장", "제3장", "제12장", None]


def test_alignment_bounds_the_distance(spark):
    rng = random.Random(5)
    pairs = []
    for k in range(40):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.choice("abcd"))
        pairs.append((k, a, "".join(b)))
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    rows = evaluate.align(df, "a", "b").select("a", "b", evaluate.distance(F.col("ops"), F.col("a"), F.col("b")).alias("bound"), F.levenshtein("a", "b").alias("d")).collect()
    for r in rows:
        assert r.bound >= r.d
        assert (r.bound == 0) == (r.a == r.b)


def test_markdown_blocks(spark):
    text = "# Head\n\npara one\npara two\n\n> q1\n> q2\n- a\n  - b\n|x|\n\n|a|b|\n|-|-|\n|1|2|\n```py\ncode\n```\n![alt](i.png)\n<cap>\n---\n<!-- c\nd -->"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    got = [(r.kind, r.level, r.text, r.extra) for r in parse.markdown_blocks(df).orderBy("doc_id", "idx").collect()]
    assert got == [
        ("heading", 1, "Head", None),
        ("paragraph", 0, "para one para two", None),
        ("quote", 0, "q1\nq2", None),
        ("list", 0, "a", None),
        ("list", 1, "b", None),
        ("table", 3, "|a|b|\n|-|-|\n|1|2|", None),
        ("code", 0, "code", "py"),
        ("image", 0, "i.png", "cap"),
        ("rule", 0, "", None),
        ("comment", 0, "<!-- c\nd -->", None),
    ]


def test_front_matter_and_sections(spark):
    df = spark.createDataFrame([("---\ntitle: \"A: b\"\nx: 1\n---\n## one\nbody\n## two\nmore\n",), ("plain",)], "t string")
    parts = markup and parse.front_matter(F.col("t"))
    rows = df.select(parts["meta"].alias("m"), parts["body"].alias("b"), parse.section(parts["body"], "one").alias("one")).collect()
    assert rows[0].m == {"title": "A: b", "x": "1"} and rows[0].one == "body"
    assert rows[1].b == "plain" and rows[1].one is None


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, title string, name string")
    assert classify.classify(docs).count() == 0
    assert lines.assemble(lines.unfill(lines.explode_lines(docs))).count() == 0
    assert parse.split_tabs(docs).count() == 0
    empty = spark.createDataFrame([], "k string, pos int, body string")
    assert match.suffix_join(empty.drop("pos", "body"), empty, "k", "pos", ["body"]).count() == 0


@pytest.mark.parametrize("footnotes", ["keep", "drop", "only"])
def test_content_key_is_symmetric(spark, footnotes):
    org, md = "* Title\n[fn:1] \"note\"\n*bold* text", "# Title\n[fn:1] ‘note’\n**bold** text"
    a, b = column(spark, [org, md], lambda t: markup.content_key(t, footnotes))
    assert a == b


def test_pandas_is_there():
    assert pd.__version__


def test_documents_meet_their_passages(spark):
    """Every passage that stands in a document as a whole meets it, wherever it stands; ratios as difflib has them for equal texts, and near them else."""
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    refs = {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.probe): r for r in catalog.QUERIES["transcript_opcodes"](spark, d).collect()}
    whole = {(k, p) for k, t in docs.items() for p, w in refs.items() if w in t}
    assert whole and whole <= set(got)
    spans = {(r.doc_id, r.probe): docs[r.doc_id][r.start : r.stop] for r in catalog.QUERIES["anchored_spans"](spark, d).where("probe IS NOT NULL").collect()}
    assert set(spans) == set(got)
    for key in got:
        exact = difflib.SequenceMatcher(None, spans[key], refs[key[1]], autojunk=False).ratio()
        assert got[key].ratio == pytest.approx(exact, abs=0.02 if exact < 1 else 0)
    far = {(r.doc_id, r.probe) for r in catalog.QUERIES["doc_benchmark_distance"](spark, d).where("projection = 'body'").collect()}
    assert far == set(got)
    tags = {r.doc_id for r in catalog.QUERIES["doc_tags"](spark, d).collect()}
    assert tags == set(docs)


def test_repeated_headings(spark):
    """Whole headings of one level count; lists and code that begin alike stay."""
    text = "# 2 . Title\n\n# 2. Title\n# 2. Titles\n## 2. Titles\n- licence one\n- licence two\n### □ a b\n---\n<!-- x -->\n### ab\ntext\n### ab\n```\n# x\n# x\n```\n# x\n"
    rows = text.split("\n")
    got = lines.drop_repeat_headings(lines.explode_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))).orderBy("pos").collect()
    assert [r.line for r in got] == [x for k, x in enumerate(rows) if k not in (0, 7)]


def test_spans_have_head_tail_and_trim(spark):
    body = "".join(chr(97 + k * k % 23) + str(k) for k in range(60))
    hay = "before " + body + " after"
    docs = spark.createDataFrame([(1, hay), (2, "short"), (3, None), (4, body[:50])], "doc_id int, text string")
    probes = [
        (10, body),  # whole
        (11, body + "#" * 20),  # its end is not there: one step back
        (12, body[:30] + "~" + body[31:]),  # only windows of 30 and less begin it
        (13, "??????????" + body),  # no head
        (14, body[:17]),  # too short for a tail
        (15, body[:50]),
    ]
    got = {(r.doc_id, r.probe): (r.start, r.stop, r.trimmed) for r in evaluate.spans(docs, spark.createDataFrame(probes, "item_id int, text string")).collect()}
    end = 7 + len(body)
    assert got == {
        (1, 10): (7, end, body),
        (1, 11): (7, end, body),
        (1, 12): (7, end, probes[2][1]),
        (1, 15): (7, 57, body[:50]),
        (2, None): (None, None, None),
        (3, None): (None, None, None),
        (4, 15): (0, 50, body[:50]),
    }


def test_all_words_count(spark):
    """Short and accented words too, against Python."""
    d = "/root/testdata/sf0.001"
    texts = [r.text or "" for r in spark.read.parquet(f"{d}/conversations.parquet").collect()]
    told = collections.Counter(w for t in texts for w in re.findall(r"[^\W_]+", t.lower()))
    got = {r.tag: r.n for r in catalog.QUERIES["all_word_freq_top"](spark, d).collect()}
    assert min(map(len, got)) < 6 and len(got) == min(50, len(told))
    assert all(told[w] == n for w, n in got.items())


ORG = """#+TITLE: Old
#+TITLE:  A title
#+STARTUP: x
#+DATE: 2024-01-02
#+HWPX: 4
intro text

#+HWPX: 9
* One
:PROPERTIES:
:HWPX_IDX: 3
:HWPX_IDX: 5
:END:
  #+BEGIN_SRC py
* no heading
#+END_QUOTE
  #+END_SRC done
#+HWPX: 8
#+OTHER: y
after
** Two
*** Three
* Four
:PROPERTIES:
never closed"""


def test_org_elements(spark):
    docs = spark.createDataFrame([(1, ORG), (2, None), (3, ""), (4, "#+BEGIN_X"), (5, "*" * 12 + " deep\ntext")], "doc_id int, text string")
    got = parse.org_elements(docs).orderBy("doc_id", "pos").collect()
    block = "  #+BEGIN_SRC py\n* no heading\n#+END_QUOTE\n  #+END_SRC done"
    one = [("paragraph", 0, "intro text", 4), ("heading", 1, "One", 5), ("block", 0, block, None), ("paragraph", 0, "after", 8), ("heading", 2, "Two", None), ("heading", 3, "Three", None), ("heading", 1, "Four", None)]
    assert [(r.kind, r.level, r.title, r.number) for r in got if r.doc_id == 1] == one
    title = {(r.doc_id, r.pos): r.title for r in got}
    assert [title.get((1, r.parent)) for r in got if r.doc_id == 1] == [None, None, "One", "One", "One", "Two", None]
    assert [(r.kind, r.level, r.title) for r in got if r.doc_id == 4] == [("block", 0, "#+BEGIN_X")]
    assert [title.get((5, r.parent)) for r in got if r.doc_id == 5] == [None, "deep"]
    meta = {r.doc_id: (r.title, r.date) for r in parse.org_meta(docs).collect()}
    assert meta[1] == ("A title", "2024-01-02") and meta[2] == meta[3] == ("", "")


def book(texts, titles, variants, back, start):
    """The same hierarchy, reading on from line to line."""
    out, at = [], 0
    heads = [t[1:].strip() if t[:1] == "#" and t[1:2].isspace() and t[1:].strip() else None for t in texts]
    if start and start in heads:
        at = heads.index(start)
        fronts = [k for k in range(at) if (heads[k] or "").startswith(books.PREFACE)]
        if fronts:
            end = next((k for k in range(fronts[0] + 1, at) if heads[k]), at)
            out = ["* " + books.PREFACE, *texts[fronts[0] + 1 : end]]
    seen, listed = set(), False
    while at < len(texts):
        text, head = texts[at], heads[at]
        follow = next((k for k in range(at + 1, len(texts)) if texts[k].strip()), None)
        name = variants.get(head, head)
        number = re.match(books.NUMBER, head or "")
        step = at + 1
        if head is None and re.match(books.PLAIN_CHAPTER, text.strip()) and follow:
            out.append(f"* {text.strip()} {heads[follow] or texts[follow].strip()}")
            step = follow + 1
        elif head is None:
            out.append(text)
        elif listed or re.match(books.COVER, head):
            pass
        elif name in titles and name not in seen:
            seen.add(name)
            out.append(f"* {titles[name]} {name}")
        elif head in back:
            listed = head == books.INDEX
            out.append(f"* {head}")
        elif number and name not in titles and follow:
            out.append(f"** {books.ROMAN.get(number[1], number[1])}. {heads[follow] or texts[follow].strip()}")
            step = follow + 1
        elif re.match(books.ITEM, head):
            out.append(f"*** {head}")
        else:
            out.append(head if re.search(books.FALSE, head) else f"** {head}")
        at = step
    return out


@pytest.mark.parametrize("start", [None, "Begin"])
def test_chapters(spark, start):
    rng = random.Random(17)
    pool = ["# One", "# Un", "# Two", "3장", " 12장 ", "# II", "# 4.", "# 7강", "# 막간 2", "# (3) x", "# ① y", "# <z>", "# A B", "# 가", "# 참고문헌", "# 찾아보기", "# other", "text", "", "  ", "#no", "# Begin", "# 책머리에 x"]
    titles, variants, back = {"One": "1장", "Two": "2장"}, {"Un": "One"}, ("참고문헌", "찾아보기")
    docs = {d: [rng.choice(pool[:15] + pool[16:] if d % 3 else pool) for _ in range(rng.randint(1, 60))] for d in range(120)}
    df = spark.createDataFrame([(d, k, t) for d, texts in docs.items() for k, t in enumerate(texts)], "doc_id int, pos int, line string")
    got = collections.defaultdict(list)
    for r in books.chapters(df.repartition(3), titles, variants, back, start).orderBy("doc_id", "pos").collect():
        got[r.doc_id].append(r.line)
    for d, texts in docs.items():
        assert got[d] == book(texts, titles, variants, back, start), (d, texts)


def test_headings_left_out(spark):
    rows = [("contents", "Contents"), ("Contents-2", "x"), (None, "12쪽과 13쪽 사이"), (None, "y" * 51), (None, "y" * 50), (None, "Humor"), ("past-x", None), (None, None)]
    df = spark.createDataFrame(rows, "a string, t string")
    assert [r[0] for r in df.select(web.skip_heading(F.col("a"), F.col("t"), ("^contents$", "^past-"), ("HUMOR",))).collect()] == [True, False, True, True, False, True, True, False]


def test_drawers_and_headers(spark):
    text = ":END:\na\n :PROPERTIES:\n:x: 1\n:PROPERTIES:\n:END:\nb\n#+HWPX: 3\n#+HWPX 4\n:PROPERTIES:\nlast"
    rows = lines.drop_drawers(lines.explode_lines(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    assert [r.line for r in rows.orderBy("pos").collect()] == [":END:", "a", "b", "#+HWPX 4"]
    texts = ["#+TITLE: a\n\n \t\n  b\n#+DATE: c\nd", "#+STARTUP: x\n\n ", "#+TITLES\n", "", None]
    assert column(spark, texts, markup.strip_org_header) == ["  b\nd", "", "#+TITLES\n", "", None]
    texts = [":HWPX_IDX: 0\n#+HWPX:12 $1", ":HWPX_IDX: x"]
    assert column(spark, texts, lambda c: markup.prefix_index(c, F.lit("ch$1"))) == [":HWPX_IDX: ch$1:0\n#+HWPX: ch$1:12 $1", ":HWPX_IDX: x"]


def test_org_fixups(spark):
    texts = ["** a\n*** b\n* c\n**bold**\n\n\n\n[[png/x]] [[./png/y]]\n\n"]
    assert column(spark, texts, markup.promote_org) == ["* a\n** b\n* c\n**bold**\n\n[[file:png/x]] [[file:png/y]]\n"]
    texts = ["[[#fig8_1][x]] [[#tab_2]] [[#intro][y]]", "#+caption: Figure 8.1: one\n#+caption: Table 2.3: two\n#+caption: Figure 4: no", "[[u][a\n   b\n    c]] d\n   e ]]", "#+caption: Table 1.2: see Figure 3.4", ":END:\nx\n:END:\n\ny"]
    assert column(spark, texts, lambda c: rx.rewrite(c, markup.ANCHOR_STEPS)) == ["[[fig8_1][x]] [[tab_2]] [[#intro][y]]", "<<fig8_1>>\n#+caption: Figure 8.1: one\n<<tab2_3>>\n#+caption: Table 2.3: two\n#+caption: Figure 4: no", "[[u][a b  c]] d\n   e ]]", "<<tab1_2>>\n#+caption: Table 1.2: see Figure 3.4", ":END:\n\nx\n:END:\n\ny"]


def test_large_divergences_are_left_out(spark):
    a, b = "same " * 20 + "x" * 81 + " mid " * 20 + "cat", "same " * 20 + " mid " * 20 + "cut"
    df = evaluate.align(spark.createDataFrame([(a, b), (None, "")], "a string, b string"), "a", "b").select(evaluate.divergences(F.col("ops")).alias("d"))
    want = [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal" and max(o[2] - o[1], o[4] - o[3]) <= 80]
    assert [[tuple(o) for o in r.d] for r in df.collect()] == [want, []]


def test_assets_images_and_prefixes(spark):
    html = ['<head a="1"><script src="a.js"> </script><script>x</script><link rel="s"><link\nx><script src="b.js"></script></head><link no>', "<link one>", "", None]
    assert column(spark, html, web.head_assets) == [['<script src="a.js"> </script>', '<link rel="s">', '<script src="b.js"></script>'], ["<link one>"], [], None]
    assert column(spark, ["https://h.net/a?type=s1&x=2", "https://o.org/a?type=s1", None], lambda c: web.sized_image(c, ("h.net",))) == ["https://h.net/a?type=w966&x=2", None, None]
    assert column(spark, ["a/b", "a", "", "."], names.image_prefix) == ["../../images", "../images", "images", "images"]


def test_numeric_order_and_longest_first(spark):
    df = spark.createDataFrame([("10",), ("9",), ("x",), ("100",)], "k string")
    assert [r.k for r in analytics.by_number(df, "k").collect()] == ["9", "10", "100", "x"]
    assert column(spark, ["alphabet", "al+x", "b"], lambda c: F.regexp_extract(c, rx.any_of(("al", "alpha", "al+")), 0)) == ["alpha", "al+", ""]
