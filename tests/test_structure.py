"""Trees, automata and converters against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from scrivano.operators import automaton, convert, lines, tree

TAG = re.compile(tree.tag_pattern())


def plain_elements(html):
    """(ord, name, start, end, closed): each opening tag scanned forward on its own."""
    found = []
    for k, m in enumerate(TAG.finditer(html)):
        t = m[0]
        name = "!" if t.startswith("<!--") else re.match("</?([a-zA-Z][a-zA-Z0-9:-]*)", t)[1].lower()
        sign = 0 if name in ("!", *tree.RAW, *tree.VOID) or t.endswith("/>") else -1 if t.startswith("</") else 1
        found.append((k, name, sign, m.start(), m.end()))
    ends = {}
    for k, name, sign, *_ in found:
        depth = 0
        for j, other, s, *_ in found[k:]:
            depth += s * (other == name)
            if sign == 1 and depth == 0:
                ends[k] = j
                break
    out = []
    for k, name, sign, start, stop in found:
        if sign == 0:
            out.append((k, name, start, stop, True))
        elif sign == 1 and k in ends:
            out.append((k, name, start, found[ends[k]][4], True))
        elif sign == 1:
            around = [e for o, e in ends.items() if o < k < e]
            out.append((k, name, start, found[min(around)][3] if around else None, False))
    return out


def test_elements(spark):
    rng = random.Random(5)
    # Elements nest; some have no end, some ends no beginning.
    def nested(depth):
        name = rng.choice(["div", "p", "b", "DIV class='x'"])
        inner = "".join(nested(depth + 1) for _ in range(rng.randint(0, 3))) if depth < 4 else "é😀"
        return f"<{name}>{inner}" + (f"</{name.split()[0]}>" if rng.random() < 0.85 else "") + rng.choice(["", "text", "<br>", "<img src='a'/>", "<!-- <div> -->", "<script>x('</div>')</script>", "</i>"])

    pages = [(k, "".join(nested(0) for _ in range(4))) for k in range(40)] + [(100, None), (101, ""), (102, "no tags"), (103, "<div>" * 300 + "</div>" * 300)]
    df = spark.createDataFrame(pages, "page_id int, html string")
    got = {}
    for r in tree.elements(tree.tags(df)).collect():
        got.setdefault(r.page_id, []).append((r.ord, r.name, r.start, r.end, r.closed))
    for k, html in pages:
        mine, theirs = sorted(got.get(k, [])), plain_elements(html or "")
        assert [m for m in mine if m[4]] == [t for t in theirs if t[4]]
        # The innermost closed element around an unclosed one: exact where closed elements nest.
        closed = [t for t in theirs if t[4]]
        proper = all(not (a[2] < b[2] < a[3] < b[3]) for a in closed for b in closed)
        if proper:
            assert mine == theirs


def test_clean_pages(spark):
    html = """<body><div id=main><h1 id="foreword-x">F&amp;w</h1><style>h1{}</style><mathml><h2>gone</h2></mathml><p>A paragraph <b>long</b> enough<p>short</p>
    <h2 id='chapter-ii'>other</h2><h3>x</h3><h3 id="thinking">left out</h3><h3>A heading that stays</h3><div>a block<h3>of its own</h3></div><div>plain block text</div>
    <figure><img src="a.png"></figure><figure>none</figure><p><font class="t inner">the <i>translated</i> one</font> original text</p></div><p>outside of the root</p></body>"""
    name = F.col("name")
    df = spark.createDataFrame([(1, html), (2, "<p>no root but long enough</p>"), (3, None)], "page_id int, html string")
    got = tree.clean_pages(df, [tree.attribute(F.col("tag"), "id") == "main", name == "body"], promoted=("foreword-",), skipped=("thinking",), titles={"chapter-ii": "II. Two"}, translated="inner")
    rows = [(r.kind, r.text, r.section) for r in sorted(got.collect(), key=lambda r: r.pos)]
    # The unclosed paragraph reaches to the end of the root; it holds a heading, so it is no block.
    assert rows == [("h1", "F&w", "section-1"), ("h2", "II. Two", "section-2"), ("h3", "A heading that stays", "section-3"), ("h3", "of its own", "section-4"), ("p", "plain block text", None), ("figure", "a.png", None), ("p", "thetranslatedone", None)]
    told = tree.contents(got).collect()
    assert [(r.title, r.contents, r.n_headings, r.n_paragraphs, r.n_figures) for r in told] == [("F&w", "- [F&w](#section-1)\n  - [II. Two](#section-2)", 4, 2, 1)]


def test_content_blocks(spark):
    box = '<div>no</div><div id="post-view7"><p>one <img data-lazy-src="h.net/a?type=s1"> two</p><div><p>&nbsp;</p></div><img src="h.net/b"><img src="x.org/c"><p> </p></div><p>after</p>'
    df = spark.createDataFrame([(1, box), (2, box.replace("</div><p>after", "<p>after")), (3, "<p>x</p>")], "page_id int, html string")
    got = tree.content_blocks(df, F.col("tag").contains('id="post-view7"'), hosts=("h.net",))
    rows = {}
    for r in sorted(got.collect(), key=lambda r: (r.page_id, r.pos)):
        rows.setdefault(r.page_id, []).append((r.kind, r.text))
    assert rows[1] == [("image", "h.net/a?type=w966"), ("text", "one  two"), ("text", "&nbsp;"), ("image", "h.net/b")]
    # A container that never ends goes on to the last tag of its name.
    assert rows[2] == rows[1][:3] and 3 not in rows


def test_ordered_stream(spark):
    rng = random.Random(6)
    pages = [(k, "".join(rng.choice("abcx ") for _ in range(200))) for k in range(20)]
    rules = [("first", "ab[^ ]?"), ("second", "b[a-c]+"), ("third", "[a-c]c"), ("last", "x+")]
    got = {}
    for r in tree.ordered_stream(spark.createDataFrame(pages, "page_id int, html string"), rules).collect():
        got.setdefault(r.page_id, []).append((r.start, r.stop, r.kind, r.found))
    for k, text in pages:
        kept = []
        for kind, pattern in rules:
            kept += [(m.start(), m.end(), kind, m[0]) for m in re.finditer(pattern, text) if all(m.end() <= s or m.start() >= e for s, e, *_ in kept)]
        assert sorted(got.get(k, [])) == sorted(kept)


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_line_states(spark, chunk):
    rng = random.Random(chunk)
    maps = {c: [rng.randrange(4) for _ in range(4)] for c in "abcdef"}
    texts = [(k, "\n".join(rng.choice("abcdef") for _ in range(rng.randint(1, 60)))) for k in range(12)]
    step = F.create_map(*(x for c, m in maps.items() for x in (F.lit(c), F.array(*map(F.lit, m)))))[F.col("line")]
    rows = automaton.line_states(lines.explode_lines(spark.createDataFrame(texts, "doc_id int, text string")), step, 4, chunk=chunk).collect()
    got = {(r.doc_id, r.pos): (r.line, r.state, r.after) for r in rows}
    for k, text in texts:
        state = 0
        for pos, line in enumerate(text.split("\n")):
            assert got[k, pos] == (line, state, maps[line][state])
            state = maps[line][state]
    assert len(got) == sum(t.count("\n") + 1 for _, t in texts)


def plain_org(text):
    """Markdown to Org by one pass with a hand-held mode."""

    def inline(t):
        t = re.sub(r"\*\*([^*]+)\*\*", r"*\1*", t)
        return re.sub(r"\[([^\]]+)\]\(([^)]+)\)", r"[[\2][\1]]", re.sub(r"`([^`]+)`", r"~\1~", t))

    out, mode, lang, run = [], "text", "", None
    closing = lambda: [f"#+END_{'SRC' if lang else 'EXAMPLE'}", ""]
    for line in [*text.split("\n"), None]:
        bare = (line or "").strip()
        kind = None
        if mode == "text" and line is not None:
            kind = "table" if bare.startswith("|") else "quote" if bare.startswith(">") else None
        if run and kind != run:
            out += ["#+END_QUOTE", ""] if run == "quote" else [""]
        if kind == "quote" and run != "quote":
            out.append("#+BEGIN_QUOTE")
        run = kind
        if line is None:
            out += closing() if mode == "code" else []
        elif mode == "code":
            if re.fullmatch(r"```\s*", line):
                out += closing()
                mode = "text"
            else:
                out.append(line)
        elif mode == "note":
            mode = "text" if "-->" in line else "note"
        elif kind == "quote":
            out.append(re.sub(r"^>\s?", "", line))
        elif kind == "table":
            ruler = re.fullmatch(r"\|[\s\-:]+\||\|(\s*-+\s*\|)+\s*", bare)
            out.append("|" + "+".join(["-" * 10] * len([c for c in bare.split("|") if c.strip()])) + "|" if ruler else inline(bare))
        elif not bare:
            out.append("")
        elif re.fullmatch(r"\s*<!--.*?-->\s*", line):
            pass
        elif re.match(r"\s*<!--", line) and "-->" not in line:
            mode = "note"
        elif re.fullmatch(r"-{3,}\s*", bare):
            out.append("-----")
        elif m := re.fullmatch(r"(#{1,6})\s+(.+)", line):
            out += ["*" * len(m[1]) + " " + inline(m[2].strip()), ""]
        elif line.startswith("```"):
            mode, lang = "code", re.match(r"```(\w*)", line)[1]
            out.append(f"#+BEGIN_SRC {lang}" if lang else "#+BEGIN_EXAMPLE")
        else:
            out.append(inline(line))
    return "\n".join(out)


def test_markdown_to_org(spark):
    rng = random.Random(7)
    parts = ["# head **b**", "####### no", "```", "```py x", "``` ", "| a | `b` |", "|---|---|", "| :--: |", "> q", ">", "  > in", "<!--", "-->", "<!-- x -->", "<!-- x --> y", "---", " ----  ", "", "  ", "text [l](u) ![i](f)", "- **item**", "a | b"]
    texts = [(k, "\n".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))) for k in range(150)]
    texts += [(k + 1000, r.text) for k, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())] + [(5000, ""), (5001, None)]
    got = {r.doc_id: r.org for r in convert.markdown_to_org(spark.createDataFrame(texts, "doc_id int, text string").repartition(3)).collect()}
    assert got == {k: plain_org(t) for k, t in texts if t is not None}


def test_document_to_markdown(spark):
    item = lambda t, n, l: {"paragraph": {"bullet": {"listId": l, "nestingLevel": n}, "elements": [{"textRun": {"content": t}}]}}
    runs = [{"textRun": {"content": " b ", "textStyle": {"bold": True, "italic": True, "link": {"url": "u"}}}}, {"pageBreak": {}}, {"textRun": {}}, {"textRun": {"content": "c", "textStyle": {"weightedFontFamily": {"fontFamily": "Courier New"}}}}]
    content = [
        {"paragraph": {"paragraphStyle": {"namedStyleType": "HEADING_2"}, "elements": runs}},
        item("a", 0, "n"), item("b", 1, "n"), item("c", 1, "n"), item("d", 2, "n"), item("e", 2, "n"), item("f", 1, "n"), item("g", 0, "n"), item("h", 1, "n"), item("u", 1, "x"),
        {"paragraph": {"elements": [{"textRun": {"content": "  \n"}}]}}, item("i", 0, "n"),
        {"paragraph": {"elements": [{"textRun": {"content": "words\n"}}]}}, item("j", 0, "n"), {"sectionBreak": {}},
        {"table": {"tableRows": [{"tableCells": [{"content": [{"paragraph": {"elements": runs[3:]}}, {"paragraph": {}}]}, {}]}, {"tableCells": []}]}}, {"table": {}},
    ]
    doc = {"body": {"content": content}, "lists": {"n": {"nestingLevels": [{"glyphType": "DECIMAL"}, {"glyphType": "ALPHA"}, {"glyphType": "ROMAN"}]}, "x": {}}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, None), (3, "{}"), (4, "not json"), (5, '{"body": {"content": []}}')], "doc_id int, json string")
    plain = "## [***b***](u)`c`\n\n1. a\n   1. b\n   1. c\n      1. d\n      1. e\n   1. f\n1. g\n   1. h\n   - u\n1. i\nwords\n\n1. j\n| `c`  |  |\n|---|---|\n|  |\n\n\n"
    assert {r.doc_id: r.markdown for r in convert.document_to_markdown(df).collect()} == {1: plain, 2: "", 3: "", 4: "", 5: ""}
    counted = [re.match(r" *(\d+)\. (.)", x).groups() for x in convert.document_to_markdown(df, counted=True).where("doc_id = 1").first().markdown.split("\n") if re.match(r" *\d+\. ", x)]
    assert counted == [("1", "a"), ("1", "b"), ("2", "c"), ("1", "d"), ("2", "e"), ("3", "f"), ("2", "g"), ("1", "h"), ("3", "i"), ("1", "j")]


def plain_tabs(tabs, depth=0):
    out = []
    for t in tabs:
        p = t.get("tabProperties", {})
        out.append((p.get("tabId", ""), p.get("title", "Untitled"), depth))
        out += plain_tabs(t.get("childTabs", []), depth + 1)
    return out


def test_json_tabs(spark):
    rng = random.Random(8)

    def tab(depth):
        own = {"tabProperties": {"index": 3, "tabId": f"t{rng.random()}", "title": rng.choice(['a "b" \\ c', "é😀", "[{}]", "x: y", ""])}} if rng.random() < 0.9 else {"other": {"title": "no"}}
        inner = {"childTabs": [tab(depth + 1) for _ in range(rng.randint(0, 3))]} if depth < 4 and rng.random() < 0.7 else {}
        body = {"documentTab": {"body": {"content": [{"title": "inside", "tabProperties": {"title": "deceiving"}}]}}} if rng.random() < 0.3 else {}
        parts = [*own.items(), *inner.items(), *body.items()]
        rng.shuffle(parts)
        return dict(parts)

    said = {k: {"tabs": [tab(0) for _ in range(rng.randint(0, 4))], "title": "whole"} for k in range(30)}
    deep = '{"tabs":[' + "".join(f'{{"tabProperties":{{"tabId":"{k}","title":"d{k}"}},"childTabs":[' for k in range(1500)) + "]}" * 1500 + "]}"
    rows = [(k, json.dumps(v, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)) for k, v in said.items()] + [(100, deep), (101, None), (102, "{}")]
    got = {}
    for r in convert.json_tabs(spark.createDataFrame(rows, "doc_id int, json string")).collect():
        got.setdefault(r.doc_id, []).append((r.idx, r.tab_id, r.title, r.depth))
    for k, v in said.items():
        assert [x[1:] for x in sorted(got.get(k, []))] == plain_tabs(v["tabs"])
    assert [x[3] for x in sorted(got[100])] == list(range(1500)) and not got.keys() & {101, 102}


def test_parents_at_any_depth(spark):
    rng = random.Random(9)
    rows = [(d, p, rng.randint(1, 2000) if rng.random() < 0.8 else None) for d in (1, 2, None) for p in range(400)] + [(3, p, p + 1) for p in range(1000)]
    got = {(r.doc_id, r.pos): r.parent for r in lines.parents(spark.createDataFrame(rows, "doc_id int, pos int, level int").repartition(5)).collect()}
    for d, p, level in rows:
        want = None if level is None else max((q for e, q, lv in rows if e == d and q < p and lv is not None and lv < level), default=None) if d != 3 else (p - 1 if p else None)
        assert got[d, p] == want
