"""The named queries and the SQL that checks them.

A query is (spark, sf_dir) -> DataFrame over whole tables, or over a golden
fixture where the driver's tables hold no such input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markup, names, render, rx, web
from ..operators import analytics, articles, books, classify, evaluate, lines, match, outline, parse
from .fixtures import frame, mixed, mixed_sql, values
from .registry import ORACLES, QUERIES, query, table

# -- classification ------------------------------------------------------------
#: Rules for the driver's invented prose: two categories by common words, one by layout.
PROSE = (
    classify.Category("listing", ("|", "license"), (r"\|",), ("en",)),
    classify.Category("french", ("que", "les", "des"), ("^é",), ("fr",)),
    classify.Category("german", ("der", "und", "die"), ("^die",), ("de",)),
    classify.Category("spanish", ("que", "los", "ción"), ("^ci",), ("es",)),
)


def _score_sql(c: classify.Category, title: str, text: str, name: str) -> str:
    w = classify.Weights()
    parts = [f"CASE WHEN contains(lower({title}), '{k.lower()}') THEN {w.title_keyword} ELSE 0 END" for k in c.keywords]
    parts += [f"CASE WHEN contains(lower(substr({text}, 1, 500)), '{k.lower()}') THEN {w.content_keyword} ELSE 0 END" for k in c.keywords]
    parts.append(f"CASE WHEN {' OR '.join(f'''regexp_matches({title}, '(?i){p}')''' for p in c.patterns)} THEN {w.title_pattern} ELSE 0 END")
    parts.append(f"CASE WHEN {' OR '.join(f'''contains(lower({name}), '{h.lower()}')''' for h in c.hints)} THEN {w.file_hint} ELSE 0 END")
    return f"CAST(least(100, {' + '.join(parts)}) AS BIGINT)"


def _classify_sql(rules, source: str, keep: str, title: str, text: str, name: str) -> str:
    scores = ", ".join(f"{_score_sql(c, title, text, name)} AS score_{c.key}" for c in rules)
    best = f"greatest({', '.join(f'score_{c.key}' for c in rules)})"
    winner = "CASE " + " ".join(f"WHEN score_{c.key} = {best} THEN '{c.key}'" for c in rules) + " END"
    shown = ", ".join(f"score_{c.key}" for c in rules)
    return f"SELECT {keep}, {shown}, {best} AS score, CASE WHEN {best} < 30 THEN '_uncategorized' ELSE {winner} END AS category, {best} < 30 AS needs_review FROM (SELECT *, {scores} FROM {source})"


_PROSE_SOURCE = "(SELECT doc_id, split_part(text, chr(10), 1) AS title, text, concat(source, '.', lang) AS name FROM documents)"


def _prose(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text", F.concat("source", F.lit("."), "lang").alias("name"))
    return classify.classify(docs, PROSE).drop("title", "text", "name")


@query(_classify_sql(PROSE, _PROSE_SOURCE, "doc_id", "title", "text", "name"))
def doc_classify(spark, sf_dir):
    """CLS-01/02/04, AGG-04/05, FLT-03: scores, category and review flag of every document."""
    return _prose(spark, sf_dir)


@query(f"SELECT category, count(*) AS n, count(*) FILTER (needs_review) AS n_review, max(score) AS best FROM ({ORACLES['doc_classify']}) GROUP BY category")
def doc_category_counts(spark, sf_dir):
    """AGG-08/10/13: documents and reviews by category."""
    return _prose(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.count_if("needs_review").alias("n_review"), F.max("score").alias("best"))


@query(_classify_sql(classify.DEFAULT, f"(SELECT id, title, text, coalesce(name, '') AS name FROM {mixed_sql('titles')})", "id", "title", "text", "name").replace("\\[.*\\]", "\\[.*\\]"))
def title_classify(spark, sf_dir):
    """CLS-01/02: the default Korean categories."""
    return classify.classify(mixed(table(spark, sf_dir, "documents"), "titles"), classify.DEFAULT).drop("title", "text", "name")


_TAGS = ", ".join(f"CASE WHEN contains(t, '{k}') THEN '{classify.TAG_ALIASES.get(k, k)}' END" for k in (*classify.AUTO_TAGS, *classify.TAG_ALIASES))


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter([{_TAGS}], lambda x: x IS NOT NULL))), ',') AS tags FROM (SELECT id, lower(concat(title, ' ', substr(text, 1, 1000))) AS t FROM {mixed_sql('titles')})")
def title_tags(spark, sf_dir):
    """CLS-03, AGG-18, SRT-08: tags found in titles and texts."""
    return mixed(table(spark, sf_dir, "documents"), "titles").select("id", F.array_join(classify.auto_tags(F.col("title"), F.col("text")), ",").alias("tags"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{_TAGS}], lambda x: x IS NOT NULL))), ',') AS tags FROM (SELECT doc_id, lower(concat(split_part(text, chr(10), 1), ' ', substr(text, 1, 1000))) AS t FROM documents)")
def doc_tags(spark, sf_dir):
    """CLS-03, AGG-18: tags found in the first line and the text of every document."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(classify.auto_tags(title, F.col("text")), ",").alias("tags"))


# -- names -----------------------------------------------------------------------
_BARE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '[^\p{L}\p{N}_\s-]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g')"
_SLUG = f"array_to_string(list_transform(string_split({_BARE}, '-'), lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z]') THEN lower(w) ELSE w END), '-')"


@query(
    f"SELECT id, {_SLUG} AS slug, substr(translate({_BARE}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 1, 80) AS blog_slug, "
    r"coalesce(nullif(regexp_replace(regexp_replace(title, '[<>:\"/\\|?*]', '-', 'g'), '\s+', '-', 'g'), ''), 'untitled') AS safe "
    f"FROM {mixed_sql('titles')}"
)
def title_slugs(spark, sf_dir):
    """STR-01/02, PRJ-01: slugs and safe file names."""
    # Both slugs are made of the words, which are found once.
    rows = mixed(table(spark, sf_dir, "documents"), "titles").select("id", "title", names.hyphenated(F.col("title")).alias("words"))
    return rows.select("id", names.lowered(F.col("words")).alias("slug"), names.shortened(F.col("words")).alias("blog_slug"), names.safe_name(F.col("title")).alias("safe"))


@query("SELECT event_id, concat(strftime(ts, '%Y%m%d'), 't', strftime(ts, '%H%M%S'), '--', event_type, '__', event_type, '_x.md') AS name FROM events")
def event_names(spark, sf_dir):
    """STR-03/04, MSC-04: file names from a time, a title and tags."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", names.file_name(F.col("ts"), F.col("event_type"), F.array(F.lit("X!"), F.col("event_type")), F.lit("md")).alias("name"))


_NAME = r"^(\d{8}[tT]\d{6})--(.+?)(?:__(.+?))?\.([^.]+)$"


@query(f"SELECT id, CASE WHEN f THEN upper(regexp_extract(name, '{_NAME}', 1)) END AS stamp, CASE WHEN f THEN regexp_extract(name, '{_NAME}', 2) END AS title, nullif(CASE WHEN f THEN regexp_extract(name, '{_NAME}', 3) END, '') AS tags, CASE WHEN f THEN regexp_extract(name, '{_NAME}', 4) END AS ext FROM (SELECT *, regexp_matches(name, '{_NAME}') AS f FROM {mixed_sql('names')})")
def name_parse(spark, sf_dir):
    """STR-05: the parts of file names."""
    return mixed(table(spark, sf_dir, "documents"), "names").select("id", *(c.alias(k) for k, c in names.parse_name(F.col("name")).items()))


@query(f"SELECT id, CASE WHEN regexp_replace(trim(coalesce(title, '')), '\\s+', '-', 'g') = '' THEN 'uncategorized' ELSE regexp_replace(trim(title), '\\s+', '-', 'g') END AS folder FROM {mixed_sql('titles')}")
def folders(spark, sf_dir):
    """STR-17: category folder names."""
    return mixed(table(spark, sf_dir, "documents"), "titles").select("id", names.folder(F.col("title")).alias("folder"))


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(string_split(spec, ','), lambda p: CASE WHEN regexp_matches(trim(p), '^\\d+$') THEN [CAST(trim(p) AS INT)] WHEN regexp_matches(trim(p), '^\\d+\\s*-\\s*\\d+$') THEN range(CAST(trim(split_part(p, '-', 1)) AS INT), CAST(trim(split_part(p, '-', 2)) AS INT) + 1) ELSE [] END)), lambda n: n >= 1 AND n <= total))), ',') AS pages FROM {mixed_sql('pages_spec')} WHERE trim(spec) <> '' UNION ALL SELECT id, array_to_string(range(1, total + 1), ',') FROM {mixed_sql('pages_spec')} WHERE trim(spec) = ''")
def page_ranges(spark, sf_dir):
    """FLT-07: page range specifications."""
    return mixed(table(spark, sf_dir, "documents"), "pages_spec").select("id", F.array_join(names.page_numbers(F.col("spec"), F.col("total")), ",").alias("pages"))


# -- markup ----------------------------------------------------------------------
def _decoded(x: str) -> str:
    for _ in range(3):
        for name, plain in markup.ENTITIES:
            plain = plain.replace("'", "''")
            x = f"replace({x}, '{name}', '{plain}')"
    return f"trim(regexp_replace(replace({x}, chr(8203), ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"SELECT id, {_decoded('text')} AS decoded, {_decoded('''regexp_replace(text, '<[^>]+>', '', 'g')''')} AS clean FROM {mixed_sql('markup')}")
def markup_decode(spark, sf_dir):
    """STR-08 (named), STR-09: entities and tags."""
    return mixed(table(spark, sf_dir, "documents"), "markup").select("id", markup.decode_entities(F.col("text")).alias("decoded"), markup.strip_tags(F.col("text")).alias("clean"))


@query(f"SELECT page_id, {_decoded('''regexp_replace(html, '<[^>]+>', '', 'g')''')} AS clean FROM pages")
def page_clean_text(spark, sf_dir):
    """STR-09: text of every page."""
    return table(spark, sf_dir, "pages").select("page_id", markup.strip_tags(F.col("html")).alias("clean"))


_TITLE = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"


@query(f"SELECT page_id, {_SLUG.replace('title', _TITLE, 1)} AS slug, nullif(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '') AS h1, len(regexp_extract_all(html, 'href=\"([^\"]*)\"')) AS n_links, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages")
def page_headings(spark, sf_dir):
    """HTML-02, STR-01, AGG-15: title slug, heading, counts of links and paragraphs."""
    h = F.col("html")
    title = F.regexp_extract(h, "(?is)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", names.slug(title).alias("slug"), F.nullif(F.regexp_extract(h, "(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit("")).alias("h1"), F.regexp_count(h, F.lit('href="([^"]*)"')).cast("long").alias("n_links"), F.regexp_count(h, F.lit("<p>")).cast("long").alias("n_paragraphs"))


@query("SELECT page_id, nullif(regexp_extract(url, '^(https?://[^/]+)', 1), '') AS origin, CASE WHEN regexp_matches(url, '/$|^https?://[^/]+$') THEN 'index.html' ELSE regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) END AS local_path, coalesce(nullif(lower(regexp_extract(url, '(?i)\\.(jpe?g|png|gif|webp|bmp)(?:\\?|$)', 1)), ''), 'jpg') AS image_ext FROM pages")
def url_parts(spark, sf_dir):
    """SNK-15, JON-20, STR-12, MSC-20/28: origin, local path and image extension of URLs."""
    u = F.col("url")
    local = F.when(u.rlike(r"/$|^https?://[^/]+$"), F.lit("index.html")).otherwise(F.regexp_extract(u, r"^https?://[^/]+/([^?#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract(u, "^(https?://[^/]+)", 1), F.lit("")).alias("origin"), local.alias("local_path"), names.image_ext(u).alias("image_ext"))


@query(
    f"""SELECT id, regexp_replace(text, '\\\\([~<>+\\-.)=&_*\\[\\]])', '\\1', 'g') AS plain,
        nullif(regexp_extract(text, '(?m)^# (.+)$', 1), '') AS heading,
        array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN starts_with(ltrim(l), '*') THEN concat(',', l) ELSE l END), chr(10)) AS org_body,
        array_to_string(regexp_extract_all(regexp_replace(text, 'https?://\\S+', '', 'g'), '(?:^|\\s)#([^\\s#]+)', 1), ',') AS tags,
        replace(replace(replace(replace(text, '{{vbar}}', '|'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS adoc,
        replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml,
        regexp_replace(text, '표\\s*<sequence>\\s*\\d+\\s*</sequence>\\s*:\\s*', '<표> ', 'g') AS caption,
        regexp_matches(trim(text), '^<[^>]+>$') AND NOT regexp_matches(trim(text), '^</?[A-Za-z!]') AS is_caption,
        regexp_matches(trim(text), '^템플릿\\s*\\d+') AS is_placeholder,
        regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS has_letter FROM {mixed_sql('markup')}"""
)
def markup_rewrites(spark, sf_dir):
    """STR-06/13/20/25/42/54, FLT-04/14/15: single-pass rewrites and predicates."""
    t = F.col("text")
    return mixed(table(spark, sf_dir, "documents"), "markup").select(
        "id",
        markup.unescape_markdown(t).alias("plain"),
        markup.first_heading(t).alias("heading"),
        markup.org_body(t).alias("org_body"),
        F.array_join(names.hashtags(t), ",").alias("tags"),
        markup.unescape_adoc(t).alias("adoc"),
        markup.escape_xml(t).alias("xml"),
        markup.strip_caption_number(t).alias("caption"),
        markup.is_caption(t).alias("is_caption"),
        markup.is_placeholder(t).alias("is_placeholder"),
        names.has_letter(t).alias("has_letter"),
    )


@query(f"SELECT id, len(m) AS n, coalesce(m[1], '') AS first FROM (SELECT id, list_filter(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(text, i, 3)), lambda w: regexp_matches(w, '^[가-힣][.?!][가-힣]$')) AS w, list_transform(list_filter(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(text, i, 3)), lambda w: regexp_matches(w, '^[가-힣][.?!][가-힣]$')), lambda w: substr(w, 1, 2)) AS m FROM {mixed_sql('markup')})")
def lint_stops(spark, sf_dir):
    """STR-55: sentence ends that run into the next word."""
    return mixed(table(spark, sf_dir, "documents"), "markup").select("id", markup.hangul_after_stop(F.col("text")).alias("m")).select("id", F.size("m").cast("long").alias("n"), F.coalesce(F.get("m", F.lit(0)), F.lit("")).alias("first"))


_SIGNS = (("^□\\s*(.+)$", "'□ '", 1), ("^[oO○]\\s+(.+)$", "'o '", 1), ("^\\((\\d+|[가-힣])\\)\\s*(.+)$", "concat('(', regexp_extract(s, '^\\((\\d+|[가-힣])\\)', 1), ') ')", 2), ("^[-–—]\\s+(.+)$", "'- '", 1), ("^[⋅·•]\\s*(.+)$", "'·'", 1))


@query(
    "SELECT id, CASE WHEN cap THEN level + 1 ELSE level END AS org_level, CASE "
    + " ".join(f"WHEN regexp_matches(s, '{p}') THEN {b}" for p, b, _ in _SIGNS)
    + " WHEN cap OR regexp_matches(s, '^(\\d+[\\.-])+\\d*\\.?\\s+') THEN '' ELSE coalesce((['', '', '□ ', 'o ', '- ', '·'])[level], '') END AS bullet, CASE "
    + " ".join(f"WHEN regexp_matches(s, '{p}') THEN regexp_extract(s, '{p}', {g})" for p, _, g in _SIGNS)
    + f" ELSE s END AS clean FROM (SELECT id, level, s, regexp_matches(s, '^<([^>]+)>$') AS cap FROM (SELECT id, level, regexp_replace(trim(text), '\\*\\*([^*]+)\\*\\*', '\\1', 'g') AS s FROM {mixed_sql('headings')}))"
)
def heading_levels(spark, sf_dir):
    """STR-32: level, bullet and text of headings."""
    return mixed(table(spark, sf_dir, "documents"), "headings").select("id", *(c.alias(k) for k, c in markup.heading_level(F.col("text"), F.col("level")).items()))


_SEAM_RULES = (
    ("t = ''", "skip", "empty"),
    ("regexp_matches(h, '^\\p{Nd}')", "skip", "digit-head"),
    ("regexp_matches(h, '^(그림|사진|표)\\s*\\d[\\d.\\-]*\\s*[:：]')", "skip", "caption-head"),
    ("regexp_matches(t, '\\d\\s*쪽$')", "skip", "pageref-tail"),
    ("regexp_matches(ltrim(t), '^[①-⑳]') AND length(ltrim(t)) <= 24", "skip", "enum-circled"),
    ("ends_with(t, ',')", "space", "comma"),
    ("NOT regexp_matches(t, '[가-힣]$')", "skip", "non-hangul"),
    (f"regexp_matches(h, '^({markup.JOSA})\\s')", "nospace", "josa-head"),
    ("regexp_matches(h, '^[A-Za-z]')", "space", "latin-head"),
    (f"regexp_matches(h, '^({markup.CONJUNCTIONS})\\s')", "space", "conj-head"),
    (f"regexp_extract(t, '(\\S+)$', 1) IN ({', '.join(repr(w) for w in markup.SPACE_WORDS)})", "space", "adv-tail"),
    ("ends_with(t, '적')", "space", "jeok-tail"),
    (f"ends_with(t, '이') AND regexp_matches(h, '^[{markup.FUSED}]')", "nospace", "fusion"),
    (f"regexp_matches(t, '({'|'.join(markup.SPACE_ENDINGS)})$')", "space", "josa/ending"),
)


@query("SELECT id, " + ", ".join("CASE " + " ".join(f"WHEN {test} THEN '{r[k]}'" for test, *r in _SEAM_RULES) + f" ELSE '{other}' END AS {name}" for k, other, name in ((0, "nospace", "seam"), (1, "mid-eojeol", "reason"))) + f" FROM (SELECT id, rtrim(tail) AS t, ltrim(head) AS h FROM {mixed_sql('seams')})")
def seam_decisions(spark, sf_dir):
    """STR-31: how the halves of split paragraphs join."""
    return mixed(table(spark, sf_dir, "documents"), "seams").select("id", *(c.alias(k) for k, c in markup.seam(F.col("tail"), F.col("head")).items()))


def _content_sql(x: str, mode: str) -> str:
    label = "^\\s*\\[fn:[^\\]]*\\]\\s*"
    keep = {"keep": "", "drop": f" AND NOT regexp_matches(s, '{label}')", "only": f" AND regexp_matches(s, '{label}')"}[mode]
    body = f"array_to_string(list_transform(list_filter(string_split({x}, chr(10)), lambda s: NOT regexp_matches(s, '^\\s*#\\+') AND NOT regexp_matches(s, '^\\s*:[A-Z_]+:\\s*$'){keep}), lambda s: regexp_replace(s, '{label}', '')), chr(10))"
    for p in markup.FOOTNOTE_MARKS:
        body = f"regexp_replace({body}, '{p}', '', 'g')"
    for p, r in (("!\\[[^\\]]*\\]\\([^)]*\\)", ""), ("\\[([^\\]]*)\\]\\([^)]*\\)", "\\1"), ("</?[a-zA-Z][^>]*>", ""), ("(?m)^\\s*#{1,6}\\s+", ""), ("(?m)^\\s*\\*+\\s+", ""), ("\\*", ""), ("[\\s]+", ""), ("[\\[\\](){}「」『』〈〉《》‘’“”''\"…]", "")):
        body = f"regexp_replace({body}, '{p}', '{r}', 'g')"
    return body


def _projected_sql(source: str) -> str:
    arms = " UNION ALL ".join(f"SELECT id, '{name}' AS projection, {_content_sql('hyp', mode)} AS hyp_key, {_content_sql('ref', mode)} AS ref_key FROM {source}" for name, mode in evaluate.PROJECTIONS.items())
    return f"SELECT id, projection, hyp_key, ref_key FROM ({arms}) WHERE hyp_key <> '' AND ref_key <> ''"


@query(_projected_sql(mixed_sql("transcripts")))
def transcript_projections(spark, sf_dir):
    """EVL-01/02/07: comparable content of transcripts, in three projections."""
    return evaluate.projections(mixed(table(spark, sf_dir, "documents"), "transcripts")).select("id", "projection", "hyp_key", "ref_key")


@query(f"SELECT id, projection, levenshtein(hyp_key, ref_key) AS dist, levenshtein(hyp_key, ref_key) / greatest(length(ref_key), 1)::DOUBLE AS cer FROM ({_projected_sql(values('transcripts'))})")
def transcript_cer(spark, sf_dir):
    """EVL-04/08: edit distance and error rate of golden rows; doc_benchmark_distance has those of the tables."""
    return evaluate.error_rates(frame(spark, "transcripts")).select("id", "projection", "dist", "cer")


def _passages(spark, sf_dir):
    """(doc_id, probe, hyp, ref): the span of each benchmark passage in each document that holds it, and the passage."""
    found = evaluate.located(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    span = F.substring("text", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    return found.select("doc_id", "probe", span.alias("hyp"), F.col("words").alias("ref"))


@query()
def transcript_opcodes(spark, sf_dir):
    """EVL-03/05: alignment, ratio and distance bound of every benchmark passage in every document.

    Without SQL: DuckDB has no alignment; tests/test_evaluate.py has a brute-force version."""
    rows = evaluate.align(_passages(spark, sf_dir), "hyp", "ref")
    bound = evaluate.distance(F.col("ops"), F.col("hyp"), F.col("ref"))
    return rows.select("doc_id", "probe", bound.alias("distance"), F.size(evaluate.differing(F.col("ops"))).alias("blocks"), evaluate.ratio(F.col("ops")).alias("ratio"), F.size("ops").alias("n_ops"))


@query()
def doc_benchmark_distance(spark, sf_dir):
    """EVL-04/08: edit distance and error rate of every benchmark passage in every document.

    Without SQL: DuckDB's levenshtein counts bytes of what isn't ASCII; brute force in tests/test_evaluate.py."""
    return evaluate.error_rates(_passages(spark, sf_dir)).select("doc_id", "probe", "projection", "dist", "cer")


_SIGNS = "「x」 『y』 (z) “q” ‘r’ … "


@query(f"SELECT doc_id, translate(regexp_replace(concat('{_SIGNS}', text), '[\\s\\x{{85}}\\p{{Z}}]+', '', 'g'), '[](){{}}「」『』〈〉《》‘’“”''\"…', '') AS content FROM documents")
def doc_content_key(spark, sf_dir):
    """EVL-02, MSC-06: content of every whole document without white space, brackets and quotes, some of each added."""
    text = F.concat(F.lit(_SIGNS), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(rx.nospace(text), markup.BRACKETS, "").alias("content"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\|')) AS pipes, len(regexp_extract_all(regexp_replace(text, '\\|', ';', 'g'), ' +;')) AS spaced, length(regexp_replace(regexp_replace(text, '\\|', ';', 'g'), ' +;', ';', 'g')) AS n_after, len(regexp_extract_all(text, '\\s')) / greatest(length(text), 1)::DOUBLE AS blank_share FROM documents")
def rewrite_stats(spark, sf_dir):
    """STR-46/47/58, AGG-15/20: counted rewriting steps and the share of white space."""
    steps = (rx.Step("pipes", r"\|", ";"), rx.Step("spaced", " +;", ";"))
    text, counts = rx.rewrite_counted(F.col("text"), steps)
    share = F.regexp_count("text", F.lit(r"\s")) / F.greatest(F.length("text"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", *(c.cast("long").alias(k) for k, c in counts.items()), F.length(text).cast("long").alias("n_after"), share.alias("blank_share"))


# -- lines -----------------------------------------------------------------------
_LINES = "(SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _lines(spark, sf_dir):
    return lines.explode_lines(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, CAST(pos AS INT) AS pos, line FROM {_LINES}")
def doc_lines(spark, sf_dir):
    """D2, SRC-31: every line of every document."""
    return _lines(spark, sf_dir)


@query("SELECT doc_id, text FROM documents")
def doc_round_trip(spark, sf_dir):
    """D2, WIN-11: exploding and assembling lines gives the texts back."""
    return lines.assemble(_lines(spark, sf_dir))


@query(f"SELECT doc_id, island, count(*) AS n, sum(length(line)) AS chars FROM (SELECT *, sum(CASE WHEN contains(line, '|') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM {_LINES}) GROUP BY ALL")
def doc_islands(spark, sf_dir):
    """WIN-02, AGG-10: runs of lines between table-like ones."""
    rows = lines.islands(_lines(spark, sf_dir), F.contains("line", F.lit("|")))
    return rows.groupBy("doc_id", "island").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query(f"SELECT doc_id, CAST(min(pos) AS INT) AS first, CAST(max(pos) AS INT) AS last, count(*) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM {_LINES} WHERE contains(line, '|')) GROUP BY doc_id, g")
def doc_table_runs(spark, sf_dir):
    """WIN-10, STM-03: contiguous table-like runs."""
    return lines.runs(_lines(spark, sf_dir), F.contains("line", F.lit("|")))


@query(f"SELECT doc_id, CAST(pos AS INT) AS pos, last_value(CASE WHEN length(line) < 60 THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS head FROM {_LINES}")
def doc_carry(spark, sf_dir):
    """WIN-01/14: the last short line up to each line."""
    return lines.carry(_lines(spark, sf_dir), F.when(F.length("line") < 60, F.col("pos").cast("long")), "head").select("doc_id", "pos", "head")


@query(f"SELECT line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {_LINES} GROUP BY line HAVING count(*) > 1")
def doc_dup_lines(spark, sf_dir):
    """WIN-07, AGG-01: lines that occur more than once."""
    return _lines(spark, sf_dir).groupBy("line").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("n > 1")


@query(f"SELECT doc_id, CAST(pos AS INT) AS pos, nth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM {_LINES}) WHERE nth > 1")
def doc_repeated_lines(spark, sf_dir):
    """WIN-07: later occurrences of a line in its document."""
    return lines.first_seen(_lines(spark, sf_dir), "line").where("nth > 1").select("doc_id", "pos", F.col("nth").cast("long").alias("nth"))


@query()
def doc_drop_repeat_headings(spark, sf_dir):
    """WIN-05: of equal headings in a row the last stays; all other lines stay."""
    return lines.drop_repeat_headings(_lines(spark, sf_dir))


@query(f"SELECT doc_id, CAST(pos AS INT) AS pos, line FROM (SELECT *, min(CASE WHEN length(line) >= 30 THEN pos END) OVER (PARTITION BY doc_id) AS lo, max(CASE WHEN length(line) >= 30 THEN pos END) OVER (PARTITION BY doc_id) AS hi FROM {_LINES}) WHERE pos BETWEEN lo AND hi")
def doc_trim_edges(spark, sf_dir):
    """WIN-12: without short lines at both ends."""
    return lines.trim_edges(_lines(spark, sf_dir), F.length("line") < 30)


@query(f"SELECT doc_id, CAST(min(pos) AS INT) AS pos, string_agg(CASE WHEN loose THEN trim(line) ELSE line END, ' ' ORDER BY pos) AS line FROM (SELECT *, sum(CASE WHEN NOT loose OR NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM (SELECT *, lag(loose) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM (SELECT *, NOT (trim(line) = '' OR starts_with(trim(line), '* ') OR starts_with(trim(line), '#+') OR (starts_with(trim(line), ':') AND ends_with(trim(line), ':')) OR regexp_matches(trim(line), '^[-*]\\s') OR regexp_matches(trim(line), '^\\d+\\.\\s') OR (starts_with(trim(line), '<<') AND ends_with(trim(line), '>>')) OR starts_with(trim(line), '[[file:') OR starts_with(trim(line), '[[./')) AS loose FROM {_LINES}))) GROUP BY doc_id, part")
def doc_unfill(spark, sf_dir):
    """PAR-01, WIN-03, FLT-13: paragraphs on one line."""
    return lines.unfill(_lines(spark, sf_dir))


# -- parsing ---------------------------------------------------------------------


@query()
def markdown_block_counts(spark, sf_dir):
    """STM-02, AGG-10: blocks of every document by kind, from the sequential parser."""
    return parse.markdown_blocks(table(spark, sf_dir, "documents")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT id, coalesce(nullif(regexp_extract(coalesce(text, ''), '#([\\p{{L}}\\p{{N}}_]+)', 1), ''), CASE WHEN trim(split_part(text, chr(10), 1)) <> '' AND length(trim(split_part(text, chr(10), 1))) <= 20 THEN trim(split_part(text, chr(10), 1)) END, '(미분류)') AS topic FROM {mixed_sql('posts')}")
def post_topics(spark, sf_dir):
    """STR-18, AGG-06: topics of posts."""
    return mixed(table(spark, sf_dir, "documents"), "posts").select("id", names.topic(F.col("text")).alias("topic"))


# -- matching --------------------------------------------------------------------
@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'orphan' ELSE 'matched' END AS status FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def labels_reconcile(spark, sf_dir):
    """JON-07/08, SET-04/05: documents against labels."""
    return match.reconcile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(f"SELECT *, CASE WHEN missing = 0 AND orphan = 0 THEN 'OK' ELSE 'ISSUES' END AS verdict FROM (SELECT count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'orphan') AS orphan FROM ({ORACLES['labels_reconcile']}))")
def integrity_summary(spark, sf_dir):
    """AGG-11: counts of a reconciliation and its verdict."""
    return analytics.integrity(labels_reconcile(spark, sf_dir))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabeled_docs(spark, sf_dir):
    """JON-03, STM-S1: documents that are not yet labelled."""
    return match.not_yet(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def good_docs(spark, sf_dir):
    """JON-04: documents with a good label."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT n_name, r_name, concat(r_name, '/', n_name) AS path FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def nation_region(spark, sf_dir):
    """JON-01/02: lookups with a default."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    return out.select("n_name", "r_name", F.concat("r_name", F.lit("/"), "n_name").alias("path"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_write_wins(spark, sf_dir):
    """JON-11: the latest event of each user."""
    return match.last_write(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, nth, o_orderkey, l_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) LEFT JOIN (SELECT o_custkey, l_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) AS nth FROM lineitem JOIN orders ON l_orderkey = o_orderkey) USING (o_custkey, nth)")
def ordinal_join(spark, sf_dir):
    """JON-10: the k-th order of a customer with the k-th of its order lines."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    slots = i.join(o.select("o_orderkey", "o_custkey"), i.l_orderkey == o.o_orderkey).select("o_custkey", "l_orderkey", "l_linenumber")
    return match.ordinal_join(o.select("o_custkey", "o_orderkey"), slots, "o_custkey", ["o_orderkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey"]).select("o_custkey", F.col("nth").cast("long").alias("nth"), "o_orderkey", "l_orderkey")


@query("SELECT event_type, max(lo) AS lo, min(hi) AS hi FROM (SELECT event_type, user_id, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY ALL HAVING count(*) > 20) GROUP BY event_type HAVING min(hi) > max(lo)")
def span_intersection(spark, sf_dir):
    """JON-14: the stretch of ids that all busy users share."""
    spans = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("start"), F.max("event_id").alias("stop"), F.count("*").alias("c")).where("c > 20")
    return match.common_span(spans, "event_type")


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN strpos(text, substr(text, 101, 40)) END AS at, coalesce(length(text) > 100 AND length(text) - length(replace(text, substr(text, 101, 40), '')) = length(substr(text, 101, 40)), false) AS once FROM documents")
def anchored_once(spark, sf_dir):
    """JON-15/16: where a stretch of each document stands, null without one, and whether it occurs exactly once."""
    text = F.coalesce("text", F.lit(""))
    part = F.substring(text, 101, 40)
    return table(spark, sf_dir, "documents").select("doc_id", match.locate(text, part, (40,)).cast("long").alias("at"), match.occurs_once(text, part).alias("once"))


@query()
def anchored_spans(spark, sf_dir):
    """JON-15, EVL-06: the span of every benchmark passage in every document, short ones too, with the passage trimmed to it."""
    return evaluate.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_RANGES = ((1, "fr", 1, 1), (2, "en", 2, 3), (3, "de", 1, 2))
_RANGES_SQL = "(VALUES " + ", ".join(f"({o}, '{s}', {a}, {b})" for o, s, a, b in _RANGES) + ") AS r(out_ord, source, lo, hi)"
_LANG_LINES = "(SELECT doc_id, lang AS source, CAST(unnest(range(1, len(l) + 1)) AS INT) AS pos, unnest(l) AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))"


def _lang_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    return docs.select("doc_id", "source", (F.col("p") + 1).alias("pos"), "line")


@query(f"SELECT out_ord, l.source, l.pos, l.line FROM {_LANG_LINES} l JOIN {_RANGES_SQL} ON l.source = r.source AND l.pos BETWEEN r.lo AND r.hi")
def line_range_union(spark, sf_dir):
    """SET-01/02, MSC-07: lines placed by a table of ranges."""
    return match.place_ranges(_lang_lines(spark, sf_dir), spark.createDataFrame(list(_RANGES), "out_ord int, source string, lo int, hi int"))


@query(f"SELECT source, count(*) AS n, count(*) FILTER (trim(line) NOT IN ('', '---')) AS substantive FROM {_LANG_LINES} l WHERE NOT EXISTS (SELECT 1 FROM {_RANGES_SQL} WHERE l.source = r.source AND l.pos BETWEEN r.lo AND r.hi) GROUP BY source")
def unused_lines(spark, sf_dir):
    """SET-03, AGG-17: lines that no range takes."""
    left = match.unused_lines(_lang_lines(spark, sf_dir), spark.createDataFrame(list(_RANGES), "out_ord int, source string, lo int, hi int"))
    return left.groupBy("source").agg(F.count("*").alias("n"), F.count_if("substantive").alias("substantive"))


# -- counts ----------------------------------------------------------------------
_ALL_WORDS = r"(SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS tag FROM conversations)"


def _all_words(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("tag"))


@query(f"SELECT tag, count(*) AS n FROM {_ALL_WORDS} GROUP BY tag ORDER BY n DESC, tag LIMIT 50")
def all_word_freq_top(spark, sf_dir):
    """AGG-01, SRT-03/04: the 50 most frequent words of conversations, of any length and script, each occurrence counted."""
    return analytics.top(analytics.tag_counts(_all_words(spark, sf_dir)), 50, F.desc("n"), "tag")


@query(f"SELECT count(DISTINCT CASE WHEN length(tag) < 14 THEN conv_id END) AS groups, count(DISTINCT CASE WHEN length(tag) < 14 THEN tag END) AS unique_tags, count(*) AS raw, count(*) FILTER (length(tag) < 14) AS clean, count(*) FILTER (length(tag) >= 14) AS noise FROM {_ALL_WORDS}")
def all_word_totals(spark, sf_dir):
    """AGG-03: totals of all words of conversations."""
    return analytics.corpus_totals(_all_words(spark, sf_dir), "conv_id", "tag", F.length("tag") >= 14)


_EVENT_TAGS = "(SELECT DISTINCT user_id, event_type AS tag FROM events)"


@query(f"SELECT a.tag AS a, b.tag AS b, count(*) AS n FROM {_EVENT_TAGS} a JOIN {_EVENT_TAGS} b ON a.user_id = b.user_id AND a.tag < b.tag GROUP BY ALL ORDER BY n DESC, a, b LIMIT 100")
def event_cooccur(spark, sf_dir):
    """AGG-02, JON-06, SRT-04: kinds of events that users share."""
    tags = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("tag"))
    return analytics.top(analytics.pair_counts(tags, "user_id"), 100, F.desc("n"), "a", "b")


@query("SELECT CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, count(*) AS n FROM events GROUP BY ALL")
def event_datetree(spark, sf_dir):
    """AGG-07, SRT-02: events by year, month and day, newest first."""
    return analytics.date_tree(table(spark, sf_dir, "events"), F.col("ts"))


@query("SELECT event_type, event_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS nth FROM events) WHERE nth <= 5")
def event_top_values(spark, sf_dir):
    """SRT-05, AGG-19: the five highest of each kind."""
    e = analytics.top_per_group(table(spark, sf_dir, "events"), ["event_type"], 5, F.desc("value"), "event_id")
    return e.select("event_type", "event_id", F.col("nth").cast("long").alias("nth"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def event_props(spark, sf_dir):
    """SRC-04/06: fields of JSON texts."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT conv_id, string_agg(concat('[', role, '] ', text), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def conv_transcript(spark, sf_dir):
    """SNK-05, SRT-01: transcripts in order."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.concat(F.lit("["), "role", F.lit("] "), "text").alias("line"))
    return lines.assemble(t, "conv_id", out="transcript")


@query("SELECT conv_id, turn, length(text) AS asked, length(nx) AS answered FROM (SELECT *, lead(text) OVER w AS nx, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'")
def conv_turn_pairs(spark, sf_dir):
    """WIN-13: questions with the answers that follow."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.struct("role", "text").alias("v"), F.lit("x").alias("line"))
    nxt = F.lead("v").over(lines._order("conv_id"))
    rows = t.withColumn("next", nxt).where("v.role = 'user' AND next.role = 'assistant'")
    return rows.select("conv_id", F.col("pos").alias("turn"), F.length("v.text").cast("long").alias("asked"), F.length("next.text").cast("long").alias("answered"))


# -- rendering -------------------------------------------------------------------
@query("SELECT doc_id, concat('---', chr(10), 'id: ', doc_id, chr(10), 'lang: ', lang, chr(10), 'source: ', source, chr(10), '---', chr(10), chr(10), text) AS text FROM documents")
def doc_front_matter(spark, sf_dir):
    """SNK-02, STR-21: documents with a head of fields."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", render.front_matter({"id": F.col("doc_id"), "lang": F.col("lang"), "none": F.lit(None).cast("string"), "source": F.col("source")}, F.col("text")).alias("text"))


_DESC = "replace(replace(regexp_replace(coalesce(description, ''), '[{}]', '', 'g'), '\"', '\\\"'), chr(10), ' ')"


@query(f"SELECT id, concat('@software{{', regexp_replace(full_name, '[^A-Za-z0-9]', '', 'g'), ',', chr(10), '  title = {{', full_name, '}},', chr(10), '  author = {{', owner, '}},', chr(10), '  url = {{', url, '}},', chr(10), '  urldate = {{', split_part(starred, 'T', 1), '}},', chr(10), '  abstract = {{', {_DESC}, '}},', chr(10), '  keywords = {{a, b}},', chr(10), '  note = {{stars: ', stars, ', language: ', coalesce(language, 'unknown'), '}}', chr(10), '}}', chr(10)) AS entry FROM {mixed_sql('stars')}")
def bibtex_entries(spark, sf_dir):
    """STR-51, SNK-07, SRC-25: bibliography entries."""
    c = F.col
    return mixed(table(spark, sf_dir, "documents"), "stars").select("id", render.bibtex(c("full_name"), c("owner"), c("url"), c("starred"), c("description"), F.array(F.lit("a"), F.lit("b")), c("stars"), c("language")).alias("entry"))


_LINK = "CASE WHEN coalesce(url, '') = '' THEN '(링크 없음)' ELSE concat('🔗 ', url) END"
_P = ", ".join(f"('{k}', '{c}', {n if n is not None else 'NULL'}, {repr(g) if g else 'NULL'}, '{r}')" for k, c, n, g, r in render.PLATFORMS)
_BODY = f"""CASE cls WHEN 'raw' THEN CASE WHEN rule = 'comment' THEN coalesce(original, '') ELSE concat(coalesce(original, ''), chr(10), chr(10), {_LINK}) END
    WHEN 'full' THEN concat_ws(chr(10) || chr(10), nullif(commentary, ''), CASE WHEN coalesce(original, '') <> '' THEN concat('─── 원문 ───', chr(10), chr(10), original) END, {_LINK})
    ELSE concat(coalesce(nullif(CASE WHEN lang = 'en' THEN en ELSE ko END, ''), nullif(ko, ''), '(요약 없음)'), chr(10), chr(10), {_LINK}, CASE WHEN rule = 'bio' THEN concat(chr(10), '(링크는 프로필 참조)') ELSE '' END) END"""


@query(f"SELECT note_id, platform, body, length(body) AS n_chars, CASE WHEN length(body) > max_chars THEN length(body) - max_chars END AS over, CASE WHEN rule = 'comment' THEN {_LINK} END AS comment FROM (SELECT *, {_BODY} AS body FROM {mixed_sql('notes')} CROSS JOIN (VALUES {_P}) AS p(platform, cls, max_chars, lang, rule))")
def bundles(spark, sf_dir):
    """JON-12, STR-23, SNK-11, FLT-10, MSC-08/14: a note for every surface, with its excess."""
    return render.bundle(mixed(table(spark, sf_dir, "documents"), "notes"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def doc_digests(spark, sf_dir):
    """SNK-15, AGG-09: digests and sizes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


# -- web, exports, outlines: golden rows, stated in the oracle -----------------------
def _rows(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + r + ')' for r in rows)}) AS t({columns})"


@query(_rows("id, title, authors, date, body", "1, 'A & B', 'X Y, Z', 'May 1', '<d-article><h2 id=\"in\">Intro</h2><p>t</p></d-article>'", "2, 'Untitled', '', '', ''"))
def paper_front(spark, sf_dir):
    """HTML-01/02: head and body of article pages."""
    return frame(spark, "papers").select("id", *(c.alias(k) for k, c in web.paper_front(F.col("html")).items()), web.paper_body(F.col("html")).alias("body"))


@query(_rows("doc_id, text", "1, array_to_string(['#+options: H:5', '***** - Parent: child — detail', '***** - Parent: other', '***** - Full', 'text', '***** - kept', '***** - With: colon', '***** - plain', '**** four', '***** - orphan'], chr(10))", "2, 'no headings'"))
def level_merge(spark, sf_dir):
    """ORG-04, JON-17, WIN-08/09, STR-43: level-6 items lifted to level 5."""
    return lines.assemble(outline.merge_levels(frame(spark, "levels")))


@query(_rows("doc_id, text, merged, skipped, missed", "1, concat('사이에 전이', chr(10), chr(10), '끝.'), 1, 1, 1"))
def seam_merge(spark, sf_dir):
    """STM-11: seams applied in order, with an audit."""
    texts = spark.createDataFrame([(1, "사이\n\n에 전이\n\n끝.")], "doc_id int, text string")
    splits = spark.createDataFrame([(1, 0, "page_boundary", "사이", "에 전이"), (1, 1, "page_boundary", "없는", "말"), (1, 2, "page_boundary", "x", "y"), (1, 3, "image_interrupt", "a", "b")], "doc_id int, pos int, class string, tail string, head string")
    return outline.apply_seams(texts, splits)


@query('''SELECT n_regionkey AS table_id, concat(CASE WHEN max(n_nationkey % 3 < 2) THEN '[cols="1,1,1"]' ELSE '[cols="1,1"]' END, chr(10), '|===', chr(10), string_agg(concat('| ', n_nationkey, chr(10), CASE WHEN n_nationkey % 3 = 0 THEN '2+' WHEN n_nationkey % 3 = 1 THEN '2.3+' ELSE '.3+' END, '| ', n_name, chr(10)), chr(10) ORDER BY n_nationkey), chr(10), '|===') AS text FROM nation GROUP BY n_regionkey''')
def adoc_render(spark, sf_dir):
    """SNK-10: tables with spans, one for each region."""
    n = table(spark, sf_dir, "nation")
    place = [F.col("n_regionkey").alias("table_id"), F.col("n_nationkey").alias("row")]
    third = F.col("n_nationkey") % 3
    left = n.select(*place, F.lit(0).alias("ord"), F.col("n_nationkey").cast("string").alias("text"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"))
    right = n.select(*place, F.lit(1).alias("ord"), F.col("n_name").alias("text"), F.when(third < 2, 2).otherwise(1).alias("colspan"), F.when(third > 0, 3).otherwise(1).alias("rowspan"))
    return render.adoc_table(left.unionByName(right))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?m)^\*+ ')) AS headings, len(regexp_extract_all(html, '\\\(')) AS inline_math, len(regexp_extract_all(html, '\\\[')) AS display_math, len(regexp_extract_all(html, '\[cite:')) AS cites, len(regexp_extract_all(html, '\[fn:')) AS footnotes, len(regexp_extract_all(html, '§§[A-Z]+\d+§§')) AS leftover FROM pages")
def residue_audit(spark, sf_dir):
    """HTML-06: what conversions left on every page."""
    return table(spark, sf_dir, "pages").select("page_id", *(c.alias(k) for k, c in web.residue(F.col("html")).items()))


# -- articles, listings, office tables ------------------------------------------------
@query(_rows("id, text, back, leftover", "1, 'a §§MI0§§ §§FN0§§ §§MB0§§', 'a \\(x\\) [fn:1: see [cite:@a;@b]] \\[y\\]', 0"))
def article_protect(spark, sf_dir):
    """HTML-03/04, STR-49: elements out of a body and back."""
    docs = spark.createDataFrame([(1, 'a <d-math>x</d-math> <d-footnote>see\n<d-cite bibtex-key="" key="a, b"></d-cite></d-footnote> <d-math block> y </d-math>')], "id int, html string")
    kept = articles.with_protected(docs, "html", "p")
    back = kept.select("id", F.col("p.text").alias("text"), web.restore(F.col("p.text"), F.col("p.store")).alias("back"))
    return back.withColumn("leftover", web.residue(F.col("back"))["leftover"].cast("int"))


_ODT = """<o xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><table:table><table:table-header-rows><table:table-row><table:table-cell table:number-columns-spanned="2"><text:p>Head<text:span> er</text:span></text:p></table:table-cell><table:covered-table-cell/></table:table-row></table:table-header-rows><table:table-row><table:table-cell table:number-rows-spanned="3"><text:p>a</text:p><text:p>b</text:p></table:table-cell><table:table-cell/></table:table-row></table:table></o>"""


@query(_rows("doc_id, tbl, row, ord, text, colspan, rowspan", "1, 0, 0, 0, 'Head er', 2, 1", "1, 0, 1, 0, concat('a', chr(10), 'b'), 1, 3", "1, 0, 1, 1, '', 1, 1").replace("row,", '"row",'))
def odt_cells(spark, sf_dir):
    """SRC-08, TBL-03: cells of office tables."""
    return articles.odt_cells(spark.createDataFrame([(1, _ODT), (2, None)], "doc_id int, xml string"))


# -- outlines and books made of the documents' lines ----------------------------
_OUTLINE_SQL = """
    WITH l AS (SELECT doc_id, CAST(unnest(range(len(w))) AS BIGINT) AS i, unnest(w) AS line
               FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL)),
    k AS (SELECT doc_id, i, regexp_replace(line, '[*#:]', '', 'g') AS line, 1 + (i // 3 + doc_id) % 10 AS level FROM l),
    m AS (SELECT doc_id, i, trim(line) AS title, CASE WHEN i % 3 = 0 THEN level ELSE 0 END AS level FROM k WHERE i % 3 = 0 OR trim(line) <> ''),
    e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM m)
    SELECT a.doc_id, CAST(a.nth AS INT) AS nth, CASE WHEN a.level > 0 THEN 'heading' ELSE 'paragraph' END AS kind, CAST(a.level AS INT) AS level,
           CASE WHEN a.level > 0 THEN trim(concat('h ', a.title)) ELSE a.title END AS title,
           CAST(CASE WHEN a.level = 0 THEN a.i ELSE NULL END AS INT) AS number,
           (SELECT CAST(max(b.nth) AS INT) FROM e b WHERE b.doc_id = a.doc_id AND b.nth < a.nth AND b.level > 0 AND (a.level = 0 OR b.level < a.level)) AS parent
    FROM e a"""


@query(_OUTLINE_SQL)
def org_tree(spark, sf_dir):
    """ORG-01/02, SRC-09: Org outlines made of every document's lines, as elements with their parents."""

    def made(line, i):
        plain = F.regexp_replace(line, "[*#:]", "")
        stars = F.repeat(F.lit("*"), (1 + (F.floor(i / 3) + F.col("doc_id")) % 10).cast("int"))
        heading = F.concat(stars, F.lit(" h "), F.trim(plain), F.lit("\n:PROPERTIES:\n:ID: * x\n:END:"))
        return F.when(i % 3 == 0, heading).otherwise(F.concat(F.lit("#+HWPX: "), i.cast("string"), F.lit("\n"), plain))

    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    found = parse.org_elements(docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), made), "\n").alias("text")))
    return found.select("doc_id", "nth", "kind", "level", F.trim("title").alias("title"), "number", F.col("parent_nth").alias("parent"))


@query()
def book_chapters(spark, sf_dir):
    """STM-07, FLT-17, STR-50, WIN-13/14: the chapters of books made of every document's lines."""
    rows = lines.explode_lines(table(spark, sf_dir, "documents").where("text IS NOT NULL"))
    made = [F.lit("# 7강"), F.lit("3장"), F.lit("# IV."), F.lit("# 2"), F.lit(""), F.concat(F.lit("# "), F.substring("line", 1, 12)), F.lit("# One"), F.lit("# (2) item"), F.lit("# 〈x〉"), F.lit("# Un"), F.lit("# 찾아보기")]
    pick = F.pmod(F.xxhash64("doc_id", "pos"), F.lit(40))
    line = F.coalesce(F.get(F.array(*made), pick.cast("int")), F.col("line"))
    return books.chapters(rows.select("doc_id", "pos", line.alias("line")), {"One": "1장", "Two": "2장"}, {"Un": "One"})


# -- surfaces made of every document's columns ----------------------------------
@query('''SELECT doc_id, 'im' || doc_id AS ref, 'png' AS format, source AS data,
          concat('# ', lang, chr(10), chr(10), '![alt](images/im', doc_id, ')') AS body FROM documents''')
def inline_image_files(spark, sf_dir):
    """STR-07, JON-18: base64 images taken out of a text, references as files."""
    ref = F.concat(F.lit("im"), F.col("doc_id").cast("string"))
    text = F.concat(F.lit("# "), F.col("lang"), F.lit("\n\n\n\n![alt]["), ref, F.lit("]\n\n["), ref, F.lit("]: <data:image/PNG;base64,"), F.base64(F.encode("source", "UTF-8")), F.lit(">\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    image = F.explode(web.inline_images(F.col("t"))).alias("i")
    return docs.select("doc_id", image, web.file_images(F.col("t")).alias("body")).select("doc_id", "i.ref", "i.format", F.decode("i.data", "UTF-8").alias("data"), "body")


@query("SELECT page_id, concat('https://h/', page_id, '/a%20b/%C3%A9?q=x%20y&z=%20#k') AS url, concat('a é A ', page_id, ' ∉ b') AS plain FROM pages")
def encoded_urls(spark, sf_dir):
    """STR-10/11: addresses percent-encoded, all entities decoded."""
    page = F.col("page_id").cast("string")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://h/"), page, F.lit("/a b/é?q=x y&z=%20#k")).alias("u"), F.concat(F.lit(" a &eacute;&nbsp; &#x41;\n"), page, F.lit(" &notin;\t b")).alias("e"))
    return pages.select("page_id", web.encode_url("u").alias("url"), web.unescape_all("e").alias("plain"))


@query('''WITH l AS (SELECT doc_id, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL)),
    m AS (SELECT doc_id, pos, CASE (pos + doc_id) % 5 WHEN 0 THEN '---' WHEN 1 THEN ' ' WHEN 2 THEN ' ---' ELSE line END AS line FROM l),
    f AS (SELECT *, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM m WHERE trim(line) <> '')
    SELECT m.doc_id, m.pos, m.line FROM m LEFT JOIN f USING (doc_id, pos) WHERE NOT (trim(m.line) = '---' AND coalesce(f.before = '---', false))''')
def doc_collapse_rules(spark, sf_dir):
    """WIN-06: rules with only blanks between become one."""
    rows = lines.explode_lines(table(spark, sf_dir, "documents").where("text IS NOT NULL"))
    k = F.pmod(F.col("pos") + F.col("doc_id"), F.lit(5))
    made = F.when(k == 0, "---").when(k == 1, " ").when(k == 2, " ---").otherwise(F.col("line"))
    return lines.collapse_rules(rows.select("doc_id", "pos", made.alias("line")))


@query('''SELECT doc_id, printf('%02d--%s.md', CAST(doc_id % 120 AS INT), lang) AS name,
    concat('#+title: ', source, chr(10), '#+date: 2024-05-0', doc_id % 9 + 1, chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('#+filetags: :', lang, ':x:', chr(10)) ELSE '' END,
           '#+source: ', 'doc/', doc_id, chr(10), chr(10), string_split(coalesce(text, ''), chr(10))[1], chr(10), chr(10), '[[file:images/', doc_id, '.png]]', chr(10)) AS org FROM documents''')
def doc_org_files(spark, sf_dir):
    """SNK-03/04: names of numbered files and Org documents of blocks."""
    number = F.col("doc_id").cast("string")
    tags = F.when(F.col("doc_id") % 2 == 0, F.array(F.col("lang"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    date = F.concat(F.lit("2024-05-0"), (F.col("doc_id") % 9 + 1).cast("string"))
    first = F.get(F.split(F.coalesce("text", F.lit("")), "\n", -1), F.lit(0))
    blocks = F.array(F.struct(F.lit("text").alias("type"), first.alias("data")), F.struct(F.lit("image").alias("type"), F.concat(F.lit("images/"), number, F.lit(".png")).alias("data")))
    org = render.org_document(F.col("source"), date, tags, F.concat(F.lit("doc/"), number), blocks)
    return table(spark, sf_dir, "documents").select("doc_id", render.indexed_name((F.col("doc_id") % 120).cast("int"), F.col("lang")).alias("name"), org.alias("org"))


@query('''SELECT doc_id, concat(lang, ';', source, ';', 'x') AS cells, concat(lang, chr(92), 'vert{}', source) AS escaped, concat('표 ', doc_id) AS caption,
          concat('제', doc_id % 12 + 1, '장') AS chapter, CAST(doc_id % 7 AS VARCHAR) AS figure FROM documents''')
def doc_cells_and_marks(spark, sf_dir):
    """STR-30/34/50, MSC-05, JON-19: pipe rows, captions, chapter numbers and figure numbers."""
    number = F.col("doc_id").cast("string")
    row = F.concat(F.lit(" |  "), F.col("lang"), F.lit(" | "), F.col("source"), F.lit("|x | "))
    numerals = F.array(*map(F.lit, ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")))
    numeral = F.get(numerals, (F.col("doc_id") % 12).cast("int"))
    heading = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Chapter "), numeral)).otherwise(F.concat(F.lit("제 "), numeral, F.lit("장")))
    html = F.concat(F.lit('<figure class="a"\n id="fig-'), number, F.lit('" data-fignum="'), (F.col("doc_id") % 7).cast("string"), F.lit('"><figure id="fig-z" data-fignum="99">'))
    figure = F.try_element_at(articles.figure_numbers(html), F.concat(F.lit("fig-"), number))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(markup.table_cells(row), ";").alias("cells"), markup.escape_cell(F.concat(F.col("lang"), F.lit("|"), F.col("source"))).alias("escaped"), markup.caption_text(F.concat(F.lit(" <표 "), number, F.lit("> "))).alias("caption"), markup.roman(heading).alias("chapter"), figure.alias("figure"))


@query('''WITH l AS (SELECT doc_id, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL)),
    m AS (SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN concat('한 ', line) ELSE line END AS line FROM l)
    SELECT doc_id, pos, line FROM m WHERE length(line) >= 10 AND regexp_matches(line, '[가-힣]')''')
def doc_kept_paragraphs(spark, sf_dir):
    """FLT-05: paragraphs of ten characters or more with Hangul."""
    rows = lines.explode_lines(table(spark, sf_dir, "documents").where("text IS NOT NULL"))
    rows = rows.select("doc_id", "pos", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("한 "), F.col("line"))).otherwise(F.col("line")).alias("line"))
    return rows.where(web.paragraph_kept(F.col("line")))


@query('''SELECT doc_id, concat('*', lang, '* [[file:images/', doc_id, '.png]]', chr(10), 'end', chr(10), chr(10), chr(10), 'x') AS ebook,
          concat('[[file:', doc_id, '.png]] ', chr(92), '(', lang, chr(92), ') [fn:', doc_id, '] ', chr(92), '[y', chr(92), ']') AS ocr FROM documents''')
def doc_surface_cleanup(spark, sf_dir):
    """STR-27/44: remains of e-books and of recognised pages, in the steps' order."""
    number, lang = F.col("doc_id").cast("string"), F.col("lang")
    ebook = F.concat(F.lit("<<a.b>>\n#+begin_export html\n<p>\n#+end_export\n:PROPERTIES:\n:ID: 1\n:END:\n**"), lang, F.lit("** [[file:./images/"), number, F.lit(".png]]\\\\\nend\n\n\n\n\nx"))
    ocr = F.concat(F.lit("![a]("), number, F.lit(".png) $"), lang, F.lit("$ $^{"), number, F.lit("}$ $$y$$"))
    return table(spark, sf_dir, "documents").select("doc_id", rx.rewrite(ebook, markup.EBOOK_STEPS).alias("ebook"), rx.rewrite(ocr, markup.OCR_STEPS).alias("ocr"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id DESC, event_id) AS r FROM events) WHERE r = 1")
def event_first_of_best(spark, sf_dir):
    """AGG-19: the first of the best of each group."""
    return analytics.first_of_best(table(spark, sf_dir, "events"), ["event_type"], "user_id", "event_id").select("event_type", "event_id")


# -- lists, paths and blocks --------------------------------------------------------
_HEADS = "(SELECT page_id, unnest(regexp_extract_all(html, '<h[1-3]>([^<]*)</h[1-3]>', 1)) AS title FROM pages)"


@query(f"SELECT page_id, title, length(title) > 50 OR starts_with(lower(title), 'the') AS skipped FROM {_HEADS}")
def page_heading_skips(spark, sf_dir):
    """FLT-06: which headings contents leave out, by an anchor's beginning and by length."""
    heads = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h[1-3]>([^<]*)</h[1-3]>"), F.lit(1))).alias("title"))
    return heads.withColumn("skipped", web.skip_heading(F.lower("title"), F.col("title"), ("^the",)))


@query()
def transcript_divergences(spark, sf_dir):
    """FLT-08: differences that are shown, and those left out for their size. Without SQL: DuckDB has no alignment."""
    rows = evaluate.align(_passages(spark, sf_dir), "hyp", "ref")
    shown = F.size(evaluate.divergences(F.col("ops")))
    return rows.select("doc_id", "probe", evaluate.ratio(F.col("ops")).alias("ratio"), shown.alias("n_shown"), (F.size(evaluate.differing(F.col("ops"))) - shown).alias("n_large"))


@query("SELECT page_id, CASE WHEN contains(url, 'example.org') OR contains(url, 'example.net') THEN regexp_replace(url, '\\?utm_source=[a-z]+', '?utm_source=w966') END AS image FROM pages")
def page_image_urls(spark, sf_dir):
    """FLT-11: URLs of known hosts at another size."""
    return table(spark, sf_dir, "pages").select("page_id", web.sized_image(F.col("url"), ("example.org", "example.net"), "utm_source").alias("image"))


@query("SELECT page_id, 1 AS n, concat('<link href=\"', url, '\">') AS first FROM pages")
def page_head_assets(spark, sf_dir):
    """FLT-12: links of the head; scripts without a source and tags over several lines are left out."""
    html = F.replace("html", F.lit("</head>"), F.concat(F.lit('<link href="'), F.col("url"), F.lit('"><link\nrel="x"></head>')))
    assets = web.head_assets(html)
    return table(spark, sf_dir, "pages").select("page_id", F.size(assets).alias("n"), assets[0].alias("first"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN '../images' ELSE '../../images' END AS prefix FROM documents")
def doc_image_prefix(spark, sf_dir):
    """PRJ-02: the way from a document's folder to the images."""
    folder = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.concat("source", F.lit("/"), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", names.image_prefix(folder).alias("prefix"))


@query("SELECT CAST(o.place AS INT) AS place, o.lang, count(d.doc_id) AS n FROM (VALUES (0, 'fr'), (1, 'none'), (2, 'en')) AS o(place, lang) LEFT JOIN documents d ON d.lang = o.lang GROUP BY ALL")
def doc_lang_counts(spark, sf_dir):
    """AGG-16: counts in a fixed order, with those that are empty."""
    return analytics.fixed_counts(table(spark, sf_dir, "documents"), "lang", ("fr", "none", "en"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS number, n_name FROM nation ORDER BY n_nationkey")
def nation_by_number(spark, sf_dir):
    """SRT-07: keys of digits sorted as numbers."""
    return analytics.by_number(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("number"), "n_name"), "number")


@query("SELECT doc_id, CASE WHEN starts_with(text, 'ab') THEN 'ab' WHEN starts_with(text, 'a') THEN 'a' WHEN starts_with(text, 'The') THEN 'The' WHEN starts_with(text, 'T') THEN 'T' ELSE '' END AS head FROM documents")
def doc_longest_head(spark, sf_dir):
    """SRT-06: the longest of several beginnings."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.regexp_extract("text", f"^(?:{rx.any_of(('a', 'T', 'ab', 'The'))})", 0), F.lit("")).alias("head"))


@query(f"SELECT doc_id, CAST(pos AS INT) AS pos, line FROM (SELECT *, max(CASE WHEN contains(line, '|') THEN pos END) OVER w AS b, max(CASE WHEN length(line) < 60 AND NOT contains(line, '|') THEN pos END) OVER w AS e FROM {_LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE NOT contains(line, '|') AND coalesce(b, -1) <= coalesce(e, -1)")
def doc_drop_blocks(spark, sf_dir):
    """STR-41: without blocks from a table-like line to the next short one."""
    return lines.drop_blocks(_lines(spark, sf_dir), F.contains("line", F.lit("|")), F.length("line") < 60)


@query("SELECT doc_id, concat('* ', regexp_replace(lang, '\\s', '', 'g'), chr(10), '[[file:png/', doc_id, '.png]]', chr(10), chr(10), ':HWPX_IDX: ch', doc_id, ':7', chr(10)) AS org, concat('<<fig', doc_id, '_2>>', chr(10), '#+caption: Figure ', doc_id, '.2: x [[fig', doc_id, '_2][a b]]') AS anchored FROM documents")
def doc_org_fixups(spark, sf_dir):
    """STR-41/45/48: headers, numbered indexes, levels and anchors of Org texts."""
    number = F.col("doc_id").cast("string")
    org = F.concat(F.lit("#+TITLE: t\n#+DATE: d\n \n** "), "lang", F.lit("\n[[./png/"), number, F.lit(".png]]\n\n\n\n:HWPX_IDX:  7\n"))
    book = markup.promote_org(markup.prefix_index(markup.strip_org_header(org), F.concat(F.lit("ch"), number)))
    anchored = F.concat(F.lit("#+caption: Figure "), number, F.lit(".2: x [[#fig"), number, F.lit("_2][a\n   b]]"))
    return table(spark, sf_dir, "documents").select("doc_id", book.alias("org"), rx.rewrite(anchored, markup.ANCHOR_STEPS).alias("anchored"))


# The queries of other modules are registered with these.
from . import corpus, fed, structure  # noqa: E402, F401
