"""Web pages, exports and feeds: entities, assets, dates, tags, footnotes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .markup import decode_entities, strip_tags
from .rx import WORD, Step, rewrite, strip, sub


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no such function."""
    return text.str.normalize("NFC")


@F.pandas_udf(T.StringType())
def unescape_all(text: pd.Series) -> pd.Series:
    """All HTML5 entities, then single blanks."""
    import html

    return text.map(lambda t: None if t is None else " ".join(html.unescape(t).replace("​", "").split()))


@F.pandas_udf(T.StringType())
def encode_url(url: pd.Series) -> pd.Series:
    """Percent-encode path and query; what is encoded already stays."""
    from urllib.parse import quote, urlsplit, urlunsplit

    def one(u):
        if u is None:
            return None
        s = urlsplit(u)
        return urlunsplit((s.scheme, s.netloc, quote(s.path, safe="/%"), quote(s.query, safe="=&%+"), s.fragment))

    return url.map(one)


@F.pandas_udf(T.StringType())
def trim_marks(tag: pd.Series) -> pd.Series:
    """Without punctuation at the end, one sign after the other; a closing bracket with its partner stays."""
    partner = {")": "(", "]": "[", "}": "{", ">": "<"}

    def one(t):
        while t:
            last = t[-1]
            if last in partner:
                if t.count(partner[last]) >= t.count(last):
                    return t
            elif last not in ",:;.!?\"'":
                return t
            t = t[:-1]
        return t

    return tag.map(one)


def raw_tag(tag: Column) -> Column:
    """A scanned tag as written: entities decoded; null for fragments of URLs and mere punctuation."""
    clean = decode_entities(tag)
    return F.when(~tag.rlike(r"^x[0-9A-Fa-f]+;") & clean.rlike(r"[\p{L}\p{N}]"), clean)


def clean_tag(tag: Column) -> Column:
    """A tag for counting: also without punctuation around it."""
    bare = strip(sub(trim_marks(raw_tag(tag)), r"""^[,:;.!?"'\[(<]+""", ""))
    return F.when(bare.rlike(r"[\p{L}\p{N}]"), bare)


# The steps that clean a converted wiki export, in order.
EXPORT_STEPS = (
    Step("section", r"(?md)^:{3,}.*Section\d+.*$"),
    Step("attributes", r"(?md)^:{3,}\s*\{[^}]*\}\s*$"),
    Step("fence", r"(?md)^:{3,}\s*$"),
    Step("named fence", rf"(?md)^:{{3,}}\s+(?:{WORD}|-)+$"),
    Step("code", r"```\s*\{\.syntaxhighlighter-pre[^}]+\}", "```json"),
    Step("heading id", r"\s+\{#[^}]+\}"),
    Step("blank lines", r"\n{4,}", "\n\n\n"),
    Step("start", r"^\s+"),
)


def clean_export(text: Column) -> Column:
    return nfc(rewrite(text, EXPORT_STEPS))


def paper_front(html: Column) -> dict[str, Column]:
    """Title, authors without note marks and date of a published article page."""
    title = F.regexp_extract(html, r"(?s)<d-title>.*?<h1[^>]*>(.*?)</h1>", 1)
    authors = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<span class='author'>(.*?)</span>"), F.lit(1)), lambda a: strip(sub(sub(strip_tags(a), r",+\s*$", ""), r"[*†‡]+$", "")))
    return {
        "title": F.coalesce(F.nullif(strip_tags(title), F.lit("")), F.lit("Untitled")),
        "authors": F.array_join(F.filter(authors, lambda a: a != ""), ", "),
        "date": strip_tags(F.regexp_extract(html, r"(?s)id='published'[^>]*>.*?</h3><div>(.*?)</div>", 1)),
    }


def paper_body(html: Column) -> Column:
    """The article element alone, without its visual contents list, heading ids on the headings."""
    body = F.regexp_extract(html, r"(?s)(<d-article>.*</d-article>)", 1)
    plain = sub(body, r'(?s)<nav class="visual-toc">.*?</nav>', "")
    return sub(plain, r"(?s)<h([2-4])><a id='([^']+)'[^>]*>(.*?)</a>\s*</h\1>", '<h$1 id="$2">$3</h$1>')


def restore(text: Column, store: Column) -> Column:
    """Put values back for tokens; store: array of struct(tok, val), in the order of replacement."""
    return F.aggregate(store, text, lambda t, s: F.replace(t, s["tok"], s["val"]))


def residue(text: Column) -> dict[str, Column]:
    """What a conversion left: counts of headings, maths, citations, footnotes and tokens."""
    patterns = {"headings": r"(?md)^\*+ ", "inline_math": r"\\\(", "display_math": r"\\\[", "cites": r"\[cite:", "footnotes": r"\[fn:", "leftover": r"§§[A-Z]+\d+§§"}
    return {k: F.regexp_count(text, F.lit(p)).cast("long") for k, p in patterns.items()}


def inline_images(text: Column) -> Column:
    """array of struct(ref, format, data) of base64 image definitions '[ref]: <data:image/…>'."""
    pattern = r"(?m)^\[([^\]]+)\]:\s*<?data:image/(\w+);base64,([A-Za-z0-9+/=\s]+?)>?\s*$"
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    zipped = F.arrays_zip(parts[0].alias("ref"), parts[1].alias("format"), parts[2].alias("body"))
    return F.transform(zipped, lambda z: F.struct(z["ref"].alias("ref"), F.lower(z["format"]).alias("format"), F.try_to_binary(sub(z["body"], r"\s+", ""), F.lit("base64")).alias("data")))


def file_images(text: Column, folder: str = "images") -> Column:
    """Definitions removed, references '![alt][ref]' as file links, at most one blank line."""
    bare = sub(text, r"(?m)^\[([^\]]+)\]:\s*<?data:image/\w+;base64,[A-Za-z0-9+/=\s]+?>?\s*$", "")
    return strip(sub(sub(bare, r"!\[([^\]]*)\]\[([^\]]+)\]", f"![$1]({folder}/$2)"), r"\n{3,}", "\n\n"))


def image_rows(posts: DataFrame, key: str = "id") -> DataFrame:
    """Images of posts: children of an album from 1, a single image as one, nothing for other kinds.

    posts: key, media_type, media_url, children array<string>.
    """
    album = F.transform("children", lambda u, i: F.struct(F.lpad((i + 1).cast("string"), 2, "0").alias("nth"), u.alias("url")))
    single = F.array(F.struct(F.lit("01").alias("nth"), F.col("media_url").alias("url")))
    images = F.when(F.col("media_type") == "CAROUSEL_ALBUM", album).when(F.col("media_type") == "IMAGE", single)
    return posts.select(key, F.explode(images).alias("i")).select(key, "i.nth", "i.url").where("url IS NOT NULL")


def post_time(text: Column, number: Column) -> Column:
    """'2025. 3. 4. 9:05' as a stamp; the seconds come from the post's number, so they are stable."""
    p = r"(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})\.?\s*(?:(\d{1,2}):(\d{2}))?"

    def part(k, width=2):
        return F.lpad(F.coalesce(F.nullif(F.regexp_extract(text, p, k), F.lit("")), F.lit("0")), width, "0")

    return F.when(text.rlike(p), F.concat(part(1, 4), part(2), part(3), F.lit("T"), part(4), part(5), F.lpad(F.pmod(number, F.lit(60)).cast("string"), 2, "0")))


def expiry(date: Column, today: Column) -> Column:
    """expired, week, fortnight, fine or unknown."""
    left = F.datediff(F.try_to_date(date, "yyyy-MM-dd"), today)
    return F.when(left.isNull(), F.lit("unknown")).when(left < 0, F.lit("expired")).when(left <= 7, F.lit("week")).when(left <= 14, F.lit("fortnight")).otherwise(F.lit("fine"))


def broken_image(size: Column, head: Column) -> Column:
    """Under 1000 bytes, or under 5000 with a page's head instead of an image."""
    return (size < 1000) | ((size < 5000) & F.lower(head).rlike(r"<!doctype|<html"))


def footnotes(text: Column) -> dict[str, Column]:
    """References, definitions, and their differences, as joined numbers."""
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all(sub(text, r"(?m)^\[fn:(\d+)\]", ""), F.lit(r"\[fn:(\d+)\]"), F.lit(1))))
    defs = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\[fn:(\d+)\]"), F.lit(1))))
    return {"resolved": F.array_join(F.array_intersect(refs, defs), ","), "unresolved": F.array_join(F.array_except(refs, defs), ","), "unused": F.array_join(F.array_except(defs, refs), ",")}


def org_inline(text: Column) -> Column:
    """Markdown inline marks as Org: bold, code, then links, which an image's mark also meets."""
    return sub(sub(sub(text, r"\*\*([^*]+)\*\*", "*$1*"), "`([^`]+)`", "~$1~"), r"\[([^\]]+)\]\(([^)]+)\)", "[[$2][$1]]")


def unnumbered(text: Column) -> Column:
    """A heading of level three or deeper without its number, plain, bold or italic."""
    return sub(text, r"(?md)^(#{3,}\s+\*{0,2})(?:\d+(?:[.-]\d+)*[.)]?|\(\d+\)|[①-⑳])\s+(.+)$", "$1$2")


def pairs(raw: Column) -> Column:
    """'a=b;;c=d' as a map."""
    entries = F.transform(F.filter(F.split(raw, ";;"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), F.trim(sub(x, "^[^=]*=", "")).alias("v")))
    return F.map_from_entries(entries)


def replace_pairs(text: Column, table: Column) -> Column:
    return F.aggregate(F.map_entries(table), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def paragraph_kept(text: Column) -> Column:
    """Translated paragraphs: ten characters or more with Hangul in them."""
    return (F.length(text) >= 10) & text.rlike("[가-힣]")


def skip_heading(anchor: Column, title: Column, anchors: tuple[str, ...], titles: tuple[str, ...] = (), most: int = 50) -> Column:
    """Whether contents leave a heading out: by its anchor, as a note between pages, by length or by its title.

    anchors: patterns; titles: in capitals.  Both are a book's own."""
    by_anchor = anchor.rlike("(?iu)" + "|".join(f"(?:{a})" for a in anchors)) if anchors else F.lit(False)
    by_title = title.rlike(r"(?U)^\d+쪽과 \d+쪽 사이$") | (F.length(title) > most) | F.upper(title).isin(*titles)
    return F.coalesce(by_anchor, F.lit(False)) | F.coalesce(by_title, F.lit(False))


def sized_image(url: Column, hosts: tuple[str, ...], parameter: str = "type", size: str = "w966") -> Column:
    """The image's URL at another size; null if it names none of the hosts."""
    known = F.lit(False)
    for host in hosts:
        known = known | F.contains(url, F.lit(host))
    return F.when(known, sub(url, rf"\?{parameter}={WORD}+", f"?{parameter}={size}"))


def head_assets(html: Column) -> Column:
    """Scripts with a source and links of the head in their order; those over several lines are left out."""
    head = F.regexp_extract(html, r"(?s)<head\b[^>]*>(.*?)</head>", 1)
    within = F.when(html.rlike(r"(?s)<head\b[^>]*>.*?</head>"), head).otherwise(html)
    tags = F.regexp_extract_all(within, F.lit(r"<script\b[^>]*\bsrc=[^>]*>\s*</script>|<link\b[^>]*>"), F.lit(0))
    return F.filter(tags, lambda t: ~F.contains(t, F.lit("\n")))
