"""Random inputs against plain Python."""

import random
import re

from pyspark.sql import functions as F

from scrivano.functions import markup, names, rx
from scrivano.operators import lines

SIGNS = " ab Ü가-_.*#|<>[](){}&;:!\n\t\u3000"


def texts(seed, n=120, longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def column(spark, rows, f):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_slug(spark):
    def plain(t):
        t = re.sub(r"[^\w\s-]", "", t)
        t = re.sub("-+", "-", re.sub(r"\s+", "-", t.strip()))
        return "-".join(w.lower() if re.match("[A-Za-z]", w) else w for w in t.split("-"))

    rows = texts(1)
    assert column(spark, rows, names.slug) == [plain(t) for t in rows]


def test_nospace(spark):
    rows = texts(2)
    assert column(spark, rows, rx.nospace) == [re.sub(r"\s+", "", t) for t in rows]


def test_content_key_has_no_brackets_or_blanks(spark):
    for got in column(spark, texts(3), markup.content_key):
        assert not set(got) & set(markup.BRACKETS) and not re.search(r"\s", got)


def test_org_body_never_starts_a_heading(spark):
    for t, got in zip(texts(4), column(spark, texts(4), markup.org_body)):
        assert not any(row.lstrip(" ").startswith("*") for row in got.split("\n"))
        assert got.replace(",*", "*").replace(", ", " ").replace(",", "") == t.replace(",*", "*").replace(", ", " ").replace(",", "")


def test_entities_reach_a_fixed_point(spark):
    rows = [t.replace("&", "&amp;amp;").replace("<", "&lt;") for t in texts(5)]
    once = column(spark, rows, markup.decode_entities)
    assert column(spark, once, markup.decode_entities) == [" ".join(re.split(r"[ \t\n]+", x)).strip(" ") if x else x for x in column(spark, once, markup.decode_entities)]


def test_runs_and_islands_cover_the_lines(spark):
    docs = [(k, t) for k, t in enumerate(texts(6, 40, 60))]
    rows = lines.explode_lines(spark.createDataFrame(docs, "doc_id int, text string"))
    hit = F.contains("line", F.lit("a"))
    got = {}
    for r in lines.runs(rows, hit).collect():
        assert r.n == r.last - r.first + 1
        got.setdefault(r.doc_id, set()).update(range(r.first, r.last + 1))
    for k, t in docs:
        assert got.get(k, set()) == {n for n, row in enumerate(t.split("\n")) if "a" in row}
    parts = lines.islands(rows, hit).groupBy("doc_id", "island").agg(F.count_if(hit).alias("breaks")).collect()
    assert all(r.breaks == (r.island > 0) for r in parts)
