"""Operator 9: SpotSigs document fingerprints.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import materialize

# Common words of English, French, German and Spanish; spots begin at them.
ANCHORS = (
    "the of and to in is was that it for on with as be by this are at from or an have not",
    "le la les des du un une et est que qui dans pour par sur pas en de au avec",
    "der die das und ist ein eine den dem von zu mit sich nicht auf für im es",
    "el los las del y una que es por con para se no su al lo como",
)
#: Content words of a chain; rows of a stretch of ids in which neighbours are found.
CHAIN, STRETCH = 3, 4096


def fingerprint(spots: Column) -> Column:
    """Spot names as hex, joined by commas."""
    return F.lower(F.array_join(F.transform(spots, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ","))


def with_spots(rows: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Add the sorted distinct names (32-bit hashes) of a text's spots.

    A spot is a common word and the ``chain`` content words that follow it, other
    common words skipped.  A text with words but without such spots is named by
    all chains of its words, or by all of them if they are fewer.  The steps are
    columns of their own, so no step is computed again for every word.
    """
    common = sorted({w for line in ANCHORS for w in line.split()})
    w_, c_, p_, s_ = (f"{out}_{x}" for x in ("words", "carried", "content", "named"))
    split = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")
    step = rows.withColumn(w_, F.filter(split, lambda w: w != ""))
    # "the of cat sat" -> "the|of|cat", "sat": a content word carries the common words before it.
    joined = F.array_join(F.transform(w_, lambda w: F.concat(w, F.when(w.isin(common), F.lit("|")).otherwise(F.lit(" ")))), "")
    step = step.withColumn(c_, F.filter(F.split(joined, " "), lambda w: (w != "") & ~F.endswith(w, F.lit("|"))))
    step = step.withColumn(p_, F.transform(c_, lambda w: F.substring_index(w, "|", -1)))

    def spot(w, i):
        anchor = F.substring_index(F.substring_index(w, "|", -2), "|", 1)
        return F.when(F.contains(w, F.lit("|")) & (i + chain <= F.size(p_)), F.hash(F.concat_ws(" ", anchor, F.slice(p_, i + 1, F.lit(chain)))))

    step = step.withColumn(s_, _distinct(F.transform(c_, spot)))
    runs = _distinct(F.transform(w_, lambda w, i: F.when(i + chain <= F.size(w_), F.hash(F.concat_ws(" ", F.slice(w_, i + 1, F.lit(chain)))))))
    whole = F.array(F.hash(F.concat_ws(" ", w_)))
    spots = F.when(F.size(s_) > 0, F.col(s_)).when(F.size(w_) >= chain, runs).when(F.size(w_) > 0, whole).otherwise(F.array().cast("array<int>"))
    return step.withColumn(out, spots).drop(w_, c_, p_, s_)


def _distinct(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull())))


def length_band(spots: Column, floor: float) -> Column:
    """Partition of a set by its length: sets in bands more than one apart are less alike than ``floor``."""
    return F.when(F.size(spots) == 0, F.lit(-1)).otherwise(F.floor(F.log(F.size(spots)) / F.log(F.lit(1 / floor)))).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two spot sets; two empty sets are alike (1).  Sets need not be
    intersected if they are equal or if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def spot_matches(rows: DataFrame, floor: float = 0.5) -> DataFrame:
    """All pairs of sets with a Jaccard similarity of ``floor`` or more: id, other, likeness (id < other).

    rows: id (unique) and spots (distinct names); empty sets match nobody.  Sets are
    partitioned by length (``length_band``): a set is indexed in its own band and looks there
    and in the band below.  It looks with its rarest spots only: of n spots the first
    n - ceil(floor n) + 1, since two sets that are alike share one of these; a pair whose
    lengths or whose places in the order of rarity leave too little to share is pruned before
    the sets meet.  Copies are best made one set before.  Equal names of a spot count as equal.
    """
    spots = rows.where("size(spots) > 0").select("id", "spots", F.size("spots").alias("n"), length_band(F.col("spots"), floor).alias("band"))
    each = spots.select("id", "n", "band", F.explode("spots").alias("spot"))
    rarity = each.groupBy("spot").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(rarity.hint("shuffle_merge"), "spot").groupBy("id", "n", "band").agg(F.array_sort(F.collect_list(F.struct("df", "spot"))).alias("ranked"))
    own = F.col("n") - F.size("ranked")
    first = F.greatest(F.col("n") - F.ceil(F.col("n") * F.lit(floor)) + 1 - own, F.lit(0)).cast("int")
    probes = ranked.select("id", "n", "band", own.alias("own"), F.posexplode(F.slice("ranked", F.lit(1), first)).alias("k", "s"))
    probes = probes.select("id", "n", "band", F.col("s.spot").alias("spot"), (F.col("own") + F.col("k")).alias("at"))
    x = probes.select(F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), "spot", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    y = probes.select("band", "spot", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"))
    share = 1 + F.least(F.col("nx") - 1 - F.col("ax"), F.col("ny") - 1 - F.col("ay"))
    able = (F.col("ny") >= F.col("nx") * floor) & (share * (1 + floor) >= (F.col("nx") + F.col("ny")) * floor)
    longer = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    pairs = x.hint("shuffle_merge").join(y, ["band", "spot"]).where(longer & able).select("x", "y").distinct()
    told = pairs.join(spots.select(F.col("id").alias("x"), F.col("spots").alias("sx")).hint("shuffle_merge"), "x")
    told = told.join(spots.select(F.col("id").alias("y"), F.col("spots").alias("sy")).hint("shuffle_merge"), "y")
    out = told.select(F.least("x", "y").alias("id"), F.greatest("x", "y").alias("other"), jaccard(F.col("sx"), F.col("sy")).alias("likeness"))
    return out.where(F.col("likeness") >= floor)


def neighbours(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """rows with next_id, next_mark: the following row by descending id, then mark; after the last the first.

    rows: id, mark (together unique) and any other columns.  Stretches of about
    ``stretch`` rows are cut at quantiles of the ids; neighbours are found inside
    them, and their ends are joined through one row for each stretch.
    """
    total = rows.select(F.count("*").alias("n")).first()["n"]
    pieces = min(max(total // stretch, 1), 2000)
    # At most 2000 numbers.
    cuts = rows.select(F.percentile_approx("id", [k / pieces for k in range(1, pieces)], 10 * pieces).alias("c")).first()["c"] if pieces > 1 else []
    cuts = sorted(set(cuts or []))
    place = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("id"))) if cuts else F.lit(0)
    order = W.partitionBy("part").orderBy(F.col("id").desc(), "mark")
    inner = rows.withColumn("part", place).withColumn("inner", F.lead(F.struct("id", "mark")).over(order)).withColumn("nth", F.row_number().over(order))
    # One row for each stretch.
    firsts = inner.where("nth = 1").select(F.col("part").alias("p"), F.struct("id", "mark").alias("first"))
    down = W.orderBy(F.col("p").desc())
    ends = firsts.select("p", F.coalesce(F.lead("first").over(down), F.first("first").over(down)).alias("following"))
    following = F.coalesce("inner", "following")
    return inner.join(F.broadcast(ends), F.col("part") == F.col("p")).select(*rows.columns, following["id"].alias("next_id"), following["mark"].alias("next_mark"))


def spotsigs(docs: DataFrame, chain: int = CHAIN, floor: float = 0.5) -> DataFrame:
    """Fingerprint documents, and compare each with an edited copy and with the next document.

    docs: doc_id, text and any other columns (ignored).  Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, spots
    and band (set size and its length partition), next_doc_id.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many, or all, of the next document (descending doc_id, the first
    after the last).  Fingerprints are ``with_spots`` joined by commas; the likeness of these
    two fixed pairs is the Jaccard similarity.  ``spot_matches`` finds all pairs of a
    table above ``floor`` by the length partitions that ``band`` numbers.

    Null text: empty, with the empty fingerprint.  Null doc_id: after all ids.
    Repeated ids: in the order of a hash of their texts.  Equal rows are one
    document, followed by the next different row.  A single row is its own next.
    Empty table: no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A row is known by its id and a hash of its text; null ids come last.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    slim = materialize(rows.select("id", "mark", F.length("text").cast("long").alias("n_chars")).distinct())
    pairs = materialize(neighbours(slim))
    # Each row goes to its own place with its text (one shuffle that both sides use), and to that
    # of the row before with a head and its spots.
    named = with_spots(rows, "text", "spots", chain)
    before = pairs.select(F.col("next_id").alias("id"), F.col("next_mark").alias("mark"), F.col("id").alias("prior"), F.col("mark").alias("prior_mark"), F.floor(F.col("n_chars") / 3).cast("int").alias("room"))
    heads = named.hint("shuffle_merge").join(before, ["id", "mark"]).select(F.col("prior").alias("id"), F.col("prior_mark").alias("mark"), F.struct(F.col("doc_id").alias("next_doc_id"), F.substring(F.col("text"), F.lit(1), F.col("room")).alias("head"), F.col("spots").alias("next_spots")).alias("next"))
    # Equal rows send one head.
    heads = heads.groupBy("id", "mark").agg(F.first("next").alias("next"))
    both = named.hint("shuffle_merge").join(heads, ["id", "mark"]).select("doc_id", "text", "spots", "next.*")
    n = F.length("text")
    edited = both.select("doc_id", "next_doc_id", n.cast("long").alias("n_chars"), "spots", "next_spots", F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), "head").alias("edited"))
    done = with_spots(edited, "edited", "edited_spots", chain)
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        jaccard(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        jaccard(F.col("spots"), F.col("next_spots")).alias("near_next"),
        F.size("spots").cast("long").alias("spots"),
        length_band(F.col("spots"), floor).alias("band"),
        "next_doc_id",
    )
