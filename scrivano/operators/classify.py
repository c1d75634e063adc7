"""Weighted rule classification of documents."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Category(NamedTuple):
    """A category's rules.  Categories are tried in the order of their list."""

    key: str
    keywords: tuple[str, ...]
    patterns: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()


class Weights(NamedTuple):
    title_keyword: int = 10
    title_pattern: int = 15
    content_keyword: int = 5
    file_hint: int = 20
    min_score: int = 30
    most: int = 100
    preview: int = 500


# The default categories.
DEFAULT = (
    Category("architecture", ("설계", "아키텍처", "구조", "시스템", "인프라", "다이어그램", "플로우"), ("^시스템.*설계", ".*아키텍처.*", ".*설계.*문서"), ("architecture", "design", "system")),
    Category("development", ("개발", "코딩", "API", "구현", "프로그래밍", "코드", "함수", "클래스", "테스트"), (".*가이드$", "^개발.*", ".*코딩.*규칙", "API.*문서"), ("dev", "development", "api", "guide")),
    Category("operations", ("운영", "배포", "모니터링", "트러블슈팅", "장애", "백업", "로그", "서버", "인프라"), ("^장애.*", ".*운영.*", ".*배포.*가이드", "트러블슈팅.*"), ("ops", "operations", "deploy", "monitoring")),
    Category("products", ("제품", "서비스", "튜야", "큐브", "IoT", "플랫폼", "앱", "어플리케이션"), (r"^\[.*\]", ".*제품.*사양", ".*서비스.*가이드"), ("product", "service", "tuya", "cube", "iot")),
)
# Tags that are looked for, and other names of tags.
AUTO_TAGS = ("api", "backend", "frontend", "database", "docker", "kubernetes", "aws", "gcp", "python", "javascript", "react", "vue", "golang", "java")
TAG_ALIASES = {"node.js": "nodejs", "node": "nodejs", "k8s": "kubernetes", "db": "database", "fe": "frontend", "be": "backend"}
UNCATEGORIZED = "_uncategorized"


def _sought(pattern: str) -> str:
    """The pattern without '.*' at its ends: a search finds the same, without trying every start for it."""
    pattern = pattern.removeprefix(".*")
    return pattern.removesuffix(".*") if not pattern.endswith("\\.*") else pattern


def score(category: Category, title: Column, content: Column, name: Column, w: Weights = Weights()) -> Column:
    """Keywords count each, a title pattern and a name hint once; at most ``w.most``."""
    low_title, low_name = F.lower(title), F.lower(name)
    preview = F.lower(F.substring(content, 1, w.preview))
    zero = F.lit(0)

    def hit(test, points):
        return F.when(test, F.lit(points)).otherwise(zero)

    parts = [hit(F.contains(low_title, F.lit(k.lower())), w.title_keyword) for k in category.keywords]
    parts += [hit(F.contains(preview, F.lit(k.lower())), w.content_keyword) for k in category.keywords]
    if category.patterns:
        parts.append(hit(title.rlike("(?iu)(?:" + ")|(?:".join(map(_sought, category.patterns)) + ")"), w.title_pattern))
    if category.hints:
        parts.append(hit(low_name.rlike("|".join(h.lower() for h in category.hints)), w.file_hint))
    return F.least(F.lit(w.most), sum(parts, zero)).cast("long")


def classify(docs: DataFrame, categories: tuple[Category, ...] = DEFAULT, title: str = "title", content: str = "text", name: str = "name", w: Weights = Weights()) -> DataFrame:
    """Add category, score, needs_review and a score_<key> column for each category.

    The first category with the highest score wins; below ``w.min_score`` a
    document is uncategorized.  Nulls count as empty.
    """
    t, c, n = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (title, content, name))
    scored = docs.withColumns({f"score_{k.key}": score(k, t, c, n, w) for k in categories})
    best = F.greatest(*(F.col(f"score_{k.key}") for k in categories)) if len(categories) > 1 else F.col(f"score_{categories[0].key}")
    winner = F.lit(None).cast("string")
    for k in reversed(categories):
        winner = F.when(F.col(f"score_{k.key}") == best, F.lit(k.key)).otherwise(winner)
    return scored.withColumn("score", best).withColumn("category", F.when(F.col("score") < w.min_score, F.lit(UNCATEGORIZED)).otherwise(winner)).withColumn("needs_review", F.col("score") < w.min_score)


def auto_tags(title: Column, content: Column, wanted: tuple[str, ...] = AUTO_TAGS, aliases: dict[str, str] = TAG_ALIASES) -> Column:
    """Sorted distinct tags that occur in the title or the first 1000 characters."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(content, F.lit("")), 1, 1000)))
    words: dict[str, list[str]] = {}
    for t in (*wanted, *aliases):
        words.setdefault(aliases.get(t, t), []).append(t)
    # In their order and once each; without lambdas, so that the text is made once for all words.
    found = [F.when(reduce(or_, (F.contains(text, F.lit(t)) for t in words[tag])), F.lit(tag)) for tag in sorted(words)]
    return F.array_except(F.array(*found), F.array(F.lit(None).cast("string")))
