"""Queries with rules as rows, names, paths and layouts, over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import names
from ..operators import books, lines, match, rules
from .registry import query, table

# -- rules as data -----------------------------------------------------------------
_RULES = (
    (1, "regex", r"\|", ";", "pipes"),
    (2, "regex", " +;", ";", "blanks before"),
    (3, "literal", "the ", "THE ", "article"),
    (4, "regex", r"([a-z]+)ing([ .,])", "$1ed$2", "tense"),
    (5, "literal", "ed ed", "ed", "doubled"),
    (6, "candidate", "THE [a-z]+ed", None, "participle"),
    (7, "candidate", "[.] [A-Z]", None, "sentence"),
)


def _rules(spark):
    return spark.createDataFrame(_RULES, rules.SCHEMA)


def _folded_sql() -> str:
    """Each rule in a step of its own: t0, t1, ... with the matches it met."""
    ctes = ["t0 AS (SELECT doc_id, text FROM documents)"]
    counts = []
    for n, (ord_, kind, pattern, replacement, note) in enumerate((r for r in _RULES if r[1] != "candidate"), 1):
        if kind == "literal":
            new, met = f"replace(text, '{pattern}', '{replacement}')", f"(length(text) - length(replace(text, '{pattern}', ''))) // length('{pattern}')"
        else:
            new, met = "regexp_replace(text, '{}', '{}', 'g')".format(pattern, replacement.replace("$", "\\")), f"len(regexp_extract_all(text, '{pattern}'))"
        ctes.append(f"t{n} AS (SELECT doc_id, {new} AS text FROM t{n - 1})")
        counts.append(f"SELECT doc_id, {ord_} AS ord, '{note}' AS note, CAST({met} AS BIGINT) AS n FROM t{n - 1}")
    return ", ".join(ctes), " UNION ALL ".join(counts), f"t{len(counts)}"


_STEPS, _COUNTS, _LAST = _folded_sql()


@query(f"WITH {_STEPS} SELECT doc_id, text FROM {_LAST}")
def doc_rules(spark, sf_dir):
    """SRC-05, STR-47: ordered rules from a table, folded over every document."""
    return rules.rewritten(table(spark, sf_dir, "documents"), _rules(spark), counted=False)


@query(f"WITH {_STEPS} SELECT * FROM ({_COUNTS}) WHERE n > 0")
def doc_rule_audit(spark, sf_dir):
    """SNK-09: what each rule changed in each document."""
    return rules.audit(rules.rewritten(table(spark, sf_dir, "documents"), _rules(spark)))


def _places(source: str, pattern: str, literal: bool = False) -> str:
    """Lists of the matches of a pattern in a source (doc_id, text) and of their starts."""
    if literal:
        gaps, found = f"string_split(text, '{pattern}')", f"list_transform(range(len(string_split(text, '{pattern}')) - 1), lambda i: '{pattern}')"
    else:
        gaps, found = f"string_split_regex(text, '{pattern}')", f"regexp_extract_all(text, '{pattern}')"
    size = "list_sum(list_transform({}, lambda x: length(x)))"
    start = f"lambda i: {size.format('list_slice(g, 1, i)')} + coalesce({size.format('list_slice(f, 1, i - 1)')}, 0)"
    return f"(SELECT doc_id, text, unnest(f) AS found, unnest(list_transform(range(1, len(f) + 1), {start})) AS start FROM (SELECT doc_id, text, {gaps} AS g, {found} AS f FROM {source}))"


@query(
    f"WITH {_STEPS} "
    + " UNION ALL ".join(
        f"SELECT doc_id, {ord_} AS ord, '{note}' AS note, CAST(start AS BIGINT) AS start, replace(substr(text, CAST(greatest(start - 12, 0) + 1 AS BIGINT), CAST(start + length(found) + 12 - greatest(start - 12, 0) AS BIGINT)), chr(10), ' ') AS context FROM {_places(_LAST, pattern)}"
        for ord_, kind, pattern, _, note in _RULES
        if kind == "candidate"
    )
)
def doc_rule_candidates(spark, sf_dir):
    """SNK-09: what the candidate rules find in the rewritten documents, in context."""
    return rules.candidates(rules.rewritten(table(spark, sf_dir, "documents"), _rules(spark), counted=False), _rules(spark))


# -- lint ----------------------------------------------------------------------------
_WORDS = (("B", "tion", "zion", "t"), ("A", "ions", "ionz", "s"), ("A", "onth", "month", "m"), ("C", "then", "than", "c"), ("C", "hen ", "hens ", "h"), ("D", "ndre", "nder", "d"), ("D", "und das", "unddas", "u"), ("E", "ion", "yon", "y"))


def _words(spark):
    return spark.createDataFrame(_WORDS, "rule string, wrong string, fix string, message string")


_LINT = "WITH RECURSIVE " + f"""
    p AS MATERIALIZED ({" UNION ALL ".join(f"SELECT doc_id, text, start, start + length(found) AS stop, '{r}' AS rule, '{w}' AS wrong, '{x}' AS fix, '{m}' AS message FROM {_places('documents', w, True)}" for r, w, x, m in _WORDS)}),
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop DESC, rule, wrong) AS k FROM p),
    w(doc_id, k, taken, free) AS (
        SELECT doc_id, k, true, stop FROM o WHERE k = 1
        UNION ALL SELECT o.doc_id, o.k, o.start >= w.free, CASE WHEN o.start >= w.free THEN o.stop ELSE w.free END FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1)"""


@query(
    _LINT
    + """ SELECT doc_id, CAST(1 + length(left(text, CAST(start AS BIGINT))) - length(replace(left(text, CAST(start AS BIGINT)), chr(10), '')) AS INT) AS line,
        CAST(1 + length(string_split(left(text, CAST(start AS BIGINT)), chr(10))[-1]) AS INT) AS col, CAST(start AS INT) AS start, rule, message, wrong, fix, taken FROM o JOIN w USING (doc_id, k)"""
)
def doc_lint(spark, sf_dir):
    """LNT-01, STR-56: places of a lint table's words in every document, with the fixes that are taken."""
    return rules.lint(table(spark, sf_dir, "documents"), _words(spark))


@query(
    _LINT
    + """, t AS (SELECT o.*, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM o JOIN w USING (doc_id, k) WHERE taken),
    s AS (SELECT doc_id, string_agg(concat(substr(text, CAST(before + 1 AS BIGINT), CAST(start - before AS BIGINT)), fix), '' ORDER BY start) AS head, max(stop) AS stop, count(*) AS n FROM t GROUP BY doc_id)
    SELECT doc_id, CASE WHEN head IS NULL THEN text ELSE concat(head, substr(text, CAST(stop + 1 AS BIGINT))) END AS text, coalesce(n, 0) AS n FROM documents LEFT JOIN s USING (doc_id)"""
)
def doc_lint_fixed(spark, sf_dir):
    """LNT-01: every document with its fixes."""
    return rules.fixed(table(spark, sf_dir, "documents"), _words(spark))


# -- names and paths -------------------------------------------------------------------
_NODES = """(SELECT CAST(doc_id AS VARCHAR) AS id, lang AS name, CASE WHEN n_chars % 50 = 0 THEN NULL WHEN n_chars % 31 = 0 THEN CAST(doc_id AS VARCHAR) WHEN n_chars % 29 = 0 THEN CAST(doc_id + 1 AS VARCHAR) WHEN n_chars % 23 = 0 THEN 'gone'
    ELSE CAST(doc_id - 1 - n_chars % 40 AS VARCHAR) END AS parent FROM documents)"""


@query(
    f"""WITH RECURSIVE n AS MATERIALIZED {_NODES},
    w(id, top, seen, path, depth) AS (
        SELECT id, parent, [id], name, 1 FROM n
        UNION ALL SELECT w.id, n.parent, list_append(seen, n.id), concat(n.name, '/', path), depth + 1 FROM w JOIN n ON w.top = n.id WHERE NOT list_contains(seen, n.id))
    SELECT id, CAST(max(depth) AS INT) AS depth, arg_max(path, depth) AS path FROM w GROUP BY id"""
)
def category_paths(spark, sf_dir):
    """JON-05, D13: ancestor paths of the documents, some of them hundreds deep; missing parents and circles end them."""
    n, doc = F.col("n_chars"), F.col("doc_id")
    parent = F.when(n % 50 == 0, None).when(n % 31 == 0, doc.cast("string")).when(n % 29 == 0, (doc + 1).cast("string")).when(n % 23 == 0, F.lit("gone")).otherwise((doc - 1 - n % 40).cast("string"))
    nodes = table(spark, sf_dir, "documents").select(doc.cast("string").alias("id"), parent.alias("parent"), F.col("lang").alias("name"))
    return match.category_paths(nodes)


@query()
def doc_free_names(spark, sf_dir):
    """VER-04: files of all documents renamed after their first word, without collisions in a folder.

    Without SQL, as rounds go on until nothing moves: brute force in tests/test_rules.py."""
    docs = table(spark, sf_dir, "documents")
    word = F.coalesce(F.nullif(names.slug(F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1))), F.lit("")), F.lit("untitled"))
    now = F.when(F.col("doc_id") % 7 == 0, F.concat(word, F.lit(".org"))).otherwise(F.concat(F.lit("draft-"), F.col("doc_id").cast("string"), F.lit(".org")))
    return match.free_names(docs.select("doc_id", "lang", now.alias("now"), F.concat(word, F.lit(".org")).alias("wanted")), "doc_id", "lang", "now", "wanted")


# -- layout ------------------------------------------------------------------------------
_PLACED = """SELECT doc_id, pos, contains(line, '|') AS tabular, len(regexp_extract_all(line, '[.,|]')) AS n
    FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


@query(
    f"""WITH p AS ({_PLACED}), t AS (SELECT doc_id, coalesce(sum(n * 7 + 12) FILTER (NOT tabular), 0) AS told FROM p WHERE n > 0 GROUP BY doc_id)
    SELECT a.doc_id, CAST(a.pos AS INT) AS pos, least(55 + max(t.told) + coalesce(sum(b.n * 12 + 10), 0), 120) / 10.0 AS top FROM p a JOIN t USING (doc_id) LEFT JOIN p b ON b.doc_id = a.doc_id AND b.tabular AND b.n > 0 AND b.pos < a.pos
    WHERE a.tabular AND a.n > 0 GROUP BY a.doc_id, a.pos"""
)
def doc_slide_layout(spark, sf_dir):
    """MSC-13: where each table of a slide stands: below the texts and the tables before, 12 cm down at most.

    A document is a slide, a line a section: with a bar a table of so many rows, else bullets."""
    lines_ = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = lines_.select("doc_id", "pos", F.contains("line", F.lit("|")).alias("tabular"), F.regexp_count("line", F.lit("[.,|]")).alias("n")).where("n > 0")
    # Tenths of a centimetre, whole numbers.
    whole = W.partitionBy("doc_id")
    told = F.coalesce(F.sum(F.when(~F.col("tabular"), F.col("n") * 7 + 12)).over(whole), F.lit(0))
    above = F.coalesce(F.sum(F.when(F.col("tabular"), F.col("n") * 12 + 10)).over(whole.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("top", F.least(told + above + 55, F.lit(120)) / 10).where("tabular").select("doc_id", "pos", "top")


# -- three-level books -----------------------------------------------------------------
PARTS = {"1부": "처음 부분", "2부": "나중 부분"}
LECTURES = {"1강": ("하나", "1부"), "2강": ("둘", "1부"), "3강": ("셋", "2부"), "4강": ("넷", None)}


@query()
def book_lectures(spark, sf_dir):
    """STM-08: parts, lectures and items of books made of every document, parts made where their first lecture is.

    Without SQL, as lectures take the next line in turn: brute force in tests/test_rules.py."""
    n, line = F.length("line"), F.col("line")
    number = (F.floor(n / 11) % 6 + 1).cast("string")
    dressed = (
        F.when(n % 11 == 0, F.concat(F.lit("# "), number, F.lit("강"))).when(n % 11 == 1, F.concat(number, F.lit("강"))).when(n % 11 == 2, F.lit("# 처음 부분"))
        .when(n % 11 == 3, F.concat(F.lit("# 소절 "), line)).when(n % 11 == 4, F.concat(F.lit("# "), line)).when(n % 11 == 5, F.lit("")).when(n % 97 == 6, F.lit("# 찾아보기")).otherwise(line)
    )
    rows = lines.explode_lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", dressed.alias("line"))
    return books.lectures(rows, PARTS, LECTURES)
