"""Slugs, tags and self-describing file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import SPACE, WORD, strip, sub

# Korean tags with an English form.
TAG_NAMES = {
    "백엔드": "backend",
    "프론트엔드": "frontend",
    "데이터베이스": "database",
    "개발": "dev",
    "운영": "ops",
    "설계": "design",
    "가이드": "guide",
    "문서": "doc",
}


def hyphenated(title: Column) -> Column:
    """Words joined by hyphens."""
    return sub(strip(sub(title, rf"[^\p{{L}}\p{{N}}_\s\x{{85}}\p{{Z}}-]+", "")), rf"[\s\x{{85}}\p{{Z}}-]+", "-")


def lowered(words: Column) -> Column:
    """Hyphenated words, those that start with an ASCII letter in lower case."""
    low = F.transform(F.split(words, "-", -1), lambda w: F.when(w.rlike("^[A-Za-z]"), F.lower(w)).otherwise(w))
    return F.when(F.lower(words) == words, words).otherwise(F.array_join(low, "-"))


def shortened(words: Column, limit: int = 80) -> Column:
    """Hyphenated words with only A-Z lowered, cut to ``limit`` characters."""
    return F.translate(F.substring(words, 1, limit), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slug(title: Column) -> Column:
    """Words joined by hyphens; words that start with an ASCII letter in lower case."""
    return lowered(hyphenated(title))


def blog_slug(title: Column, limit: int = 80) -> Column:
    """As slug, with only A-Z lowered, cut to ``limit`` characters."""
    return shortened(hyphenated(title), limit)


def tag_names(tags: Column) -> Column:
    """Sorted distinct tags: lower case, word characters only, known Korean tags in English."""
    known = F.create_map(*(F.lit(x) for kv in TAG_NAMES.items() for x in kv))
    bare = F.transform(tags, lambda t: sub(F.lower(t), rf"[^\p{{L}}\p{{N}}_]", ""))
    return F.array_sort(F.array_distinct(F.filter(F.transform(bare, lambda t: F.coalesce(F.try_element_at(known, t), t)), lambda t: t != "")))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd't'HHmmss")


def file_name(ts: Column, title: Column, tags: Column, ext: Column) -> Column:
    """stamp--slug[__tag_tag].ext"""
    joined = F.array_join(tag_names(tags), "_")
    return F.concat(stamp(ts), F.lit("--"), slug(title), F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.concat(F.lit("__"), joined)).otherwise(F.lit("")), F.lit("."), ext)


_NAME = r"^(\d{8}[tT]\d{6})--(.+?)(?:__(.+?))?\.([^.]+)$"


def parse_name(name: Column) -> dict[str, Column]:
    """The parts of a file name, null where it isn't one."""
    fits = name.rlike(_NAME)

    def part(k):
        return F.when(fits, F.regexp_extract(name, _NAME, k))

    return {"stamp": F.upper(part(1)), "title": part(2), "tags": F.nullif(part(3), F.lit("")), "ext": part(4)}


def safe_name(title: Column, default: str = "untitled") -> Column:
    """A title as a file name: path signs and runs of blanks become single marks."""
    clean = strip(sub(sub(title, r'[<>:"/\\|?*]', "-"), rf"{SPACE}+", "-"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(default))


def folder(category: Column) -> Column:
    """A category as a folder name."""
    clean = sub(strip(F.coalesce(category, F.lit(""))), rf"{SPACE}+", "-")
    return F.when(clean == "", F.lit("uncategorized")).otherwise(clean)


def hashtags(text: Column) -> Column:
    """#tags at the start or after white space, outside URLs."""
    return F.regexp_extract_all(sub(text, r"https?://\S+", ""), F.lit(r"(?:^|\s)#([^\s#]+)"), F.lit(1))


def has_letter(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def image_ext(url: Column) -> Column:
    """The extension of an image URL, .jpg if it has none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"(?i)\.(jpe?g|png|gif|webp|bmp)(?:\?|$)", 1)), F.lit("")), F.lit("jpg"))


def topic(text: Column, limit: int = 20, default: str = "(미분류)") -> Column:
    """The first #word, else a short first line, else the default."""
    tag = F.regexp_extract(text, rf"#({WORD}+)", 1)
    first = strip(F.split_part(text, F.lit("\n"), F.lit(1)))
    return F.when(tag != "", tag).when((first != "") & (F.length(first) <= limit), first).otherwise(F.lit(default))


def bib_key(full_name: Column) -> Column:
    return sub(full_name, "[^A-Za-z0-9]", "")


def bib_text(text: Column) -> Column:
    """A description without braces, quotes escaped, on one line."""
    return F.replace(F.replace(sub(F.coalesce(text, F.lit("")), r"[{}]", ""), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))


def page_numbers(spec: Column, total: Column) -> Column:
    """'1-3,7' as sorted distinct page numbers within 1..total; blank means all."""
    every = F.sequence(F.lit(1), total)
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$"))

    def numbers(p):
        high = F.coalesce(F.nullif(F.trim(F.split_part(p, F.lit("-"), F.lit(2))), F.lit("")).cast("int"), F.trim(F.split_part(p, F.lit("-"), F.lit(1))).cast("int"))
        low = F.trim(F.split_part(p, F.lit("-"), F.lit(1))).cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    wanted = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))
    return F.when(F.trim(F.coalesce(spec, F.lit(""))) == "", every).otherwise(F.filter(wanted, lambda n: (n >= 1) & (n <= total)))


def image_prefix(folder: Column, images: str = "images") -> Column:
    """The path from a folder, given relative to the root, to the root's image folder."""
    parts = F.filter(F.split(folder, "/"), lambda p: (p != "") & (p != "."))
    return F.concat(F.repeat(F.lit("../"), F.size(parts)), F.lit(images))
