"""Operator 8: mixing sources to target weights by Pfair scheduling.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import materialize

#: Characters of a block, and documents (or sources) of a numbering bucket on average.
BLOCK, BUCKET = 65_536, 4_096
#: Sources whose turns are broadcast; more are joined by shuffles, with the same result.
SOURCES = 10_000


def order_key(doc_id: Column, text: Column) -> Column:
    """The order of a source's documents: by digest of the id, so any stretch is a fair sample; of the text, without an id."""
    return F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary"))


def _digits(rows: int, bucket: int) -> int:
    """Leading digits of a digest that cut rows in buckets of the wanted size."""
    digits = 0
    while bucket << (4 * digits) < rows:
        digits += 1
    return digits


def shares(docs: DataFrame, weights: dict[str, int] | None = None, period: int = 1000) -> DataFrame:
    """(source, share, period): whole blocks of each source in a period, and the period's blocks.

    weights: blocks by source; sources not named get one block.  Without weights a source's
    share follows the square root of its characters, about ``period`` in all and one at least.
    The driver gets two numbers, the sum of the roots and that of the shares.
    """
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("chars"))
    if weights is not None:
        if any(w < 1 for w in weights.values()):
            raise ValueError("a weight is a number of blocks, one at least")
        share = F.coalesce(*(F.when(F.col("source") == s, F.lit(int(w))) for s, w in weights.items()), F.lit(1))
    else:
        roots = sizes.agg(F.sum(F.sqrt("chars"))).first()[0] or 0.0
        share = F.greatest(F.lit(1), F.floor(F.sqrt("chars") * period / max(roots, 1.0)))
    table = sizes.select("source", share.cast("long").alias("share"))
    return table.withColumn("period", F.lit(table.agg(F.sum("share")).first()[0] or 0).cast("long"))


def _busy(table: DataFrame) -> DataFrame:
    """(source, share, period, turn, slot) of the sources with more than one block, by earliest deadline first.

    One row holds those sources: with the default weights at most half of ``period``,
    however many sources there are.  Each step of the fold places one turn and jumps
    over slots in which no such source has a turn to run.
    """
    packed = table.where("share > 1").groupBy("period").agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("all"))
    packed = packed.withColumn("e", F.expr("transform(all, x -> x.share)"))
    packed = packed.withColumn("many", F.expr("aggregate(e, 0L, (n, x) -> n + x)"))
    # The slot of the next turn: now, or the first release to come.
    now = "greatest(acc.t, array_min(filter(transform(acc.done, (d, i) -> if(d < e[i], cast(floor(d * period / e[i]) as bigint), null)), x -> x is not null)))"
    pick = """array_min(filter(transform(acc.done, (d, i) -> named_struct('due', cast(ceil((d + 1) * period / e[i]) as bigint), 'i', i,
        'open', d < e[i] and cast(floor(d * period / e[i]) as bigint) <= t)), x -> x.open)).i"""
    step = f"""transform(array({now}), t -> transform(array({pick}), p -> named_struct('t', t + 1,
        'done', transform(acc.done, (d, i) -> if(i = p, d + 1, d)), 'plan', concat(acc.plan, array(named_struct('i', p, 'slot', t)))))[0])[0]"""
    start = "named_struct('t', 0L, 'done', transform(all, x -> 0L), 'plan', cast(array() as array<struct<i: int, slot: bigint>>))"
    plan = F.expr(f"aggregate(sequence(1L, many), {start}, (acc, k) -> {step}, acc -> acc.plan)")
    slots = packed.select("all", "period", F.explode(plan).alias("p")).select("period", F.expr("all[p.i].source").alias("source"), F.expr("all[p.i].share").alias("share"), F.col("p.slot").alias("slot"))
    turn = (F.row_number().over(W.partitionBy("source").orderBy("slot")) - 1).cast("long")
    return slots.select("source", "share", "period", turn.alias("turn"), "slot")


def _numbered(rows: DataFrame, name: str, count: int, bucket: int = BUCKET) -> DataFrame:
    """Add k, the number of each name from 0, in two levels: buckets of digests, and names in them."""
    digits = _digits(count, bucket)
    keyed = rows.withColumn("b", F.substring(F.md5(F.col(name).cast("binary")), 1, digits) if digits else F.lit(""))
    sizes = keyed.groupBy("b").agg(F.count("*").alias("n"))
    # A row for each bucket, as many as the names over ``bucket``.
    base = sizes.select("b", (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("b").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    inside = keyed.withColumn("k", F.row_number().over(W.partitionBy("b").orderBy(name)) - 1)
    return inside.join(base, "b").withColumn("k", F.col("k") + F.col("base")).drop("b", "base")


def period_slots(table: DataFrame) -> DataFrame:
    """(source, share, period, turn, release, deadline, slot): the Pfair schedule of a period.

    Turn j of a source with share e of period P is released at floor(j P / e) and
    due at ceil((j + 1) P / e).  In each slot the released turn with the earliest
    deadline runs; of equal ones a source with several blocks goes first, then the name
    decides.  So a source with one block, released at 0 and due at P, runs only where no
    other can: such sources, of any number, take the slots that the others leave, in order.
    The shares fill the period, so all deadlines are met and every source stays within
    one block of its weight at every slot.  Longer schedules repeat the period.
    """
    busy = _busy(table)
    single = table.where("share = 1")
    count = single.count()
    if count:
        # Gaps between the busy slots: the k-th free slot is k and the busy slots before it.
        order = W.partitionBy("period").orderBy("slot")
        gaps = busy.select("period", "slot", (F.row_number().over(order)).alias("m"), F.lead("slot").over(order).alias("next"))
        gaps = gaps.select("period", F.col("m"), (F.col("slot") + 1 - F.col("m")).alias("lo"), (F.coalesce("next", "period") - F.col("m")).alias("hi"))
        first = table.select("period").limit(1).join(busy.groupBy("period").agg(F.min("slot").alias("slot")), "period", "left")
        gaps = gaps.unionByName(first.select("period", F.lit(0).alias("m"), F.lit(0).cast("long").alias("lo"), F.coalesce("slot", "period").alias("hi"))).where("hi > lo")
        free = gaps.select(F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("k"), "m").select("k", (F.col("k") + F.col("m")).alias("slot"))
        placed = _numbered(single, "source", count).join(free, "k")
        busy = busy.unionByName(placed.select("source", "share", "period", F.lit(0).cast("long").alias("turn"), "slot"))
    release = F.floor(F.col("turn") * F.col("period") / F.col("share")).cast("long")
    due = F.ceil((F.col("turn") + 1) * F.col("period") / F.col("share")).cast("long")
    return busy.select("source", "share", "period", "turn", release.alias("release"), due.alias("deadline"), F.col("slot").cast("long").alias("slot"))


def pfair_mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK, period: int = 1000, bucket: int = BUCKET) -> DataFrame:
    """Add block, release, deadline and slot to docs: their places in the mixed stream.

    docs: doc_id, text, source and any other columns, all kept.  A source's
    documents, in the order of ``order_key``, are cut in blocks of ``block``
    characters; a document belongs to the block in which it starts.  Blocks take
    the slots of the Pfair schedule (``period_slots``), one of equal size each.
    While every source lasts, any prefix of slots is within one block of the
    target weights; when a source ends, its later slots stay empty and the
    others keep their proportion.  No document is dropped or repeated.

    Numbering runs in two levels, buckets of ids and documents in them, so a
    source of any size is spread over tasks.  Null source: the source ''.  Null
    text: no characters.  Null or repeated ids: ordered by text; equal rows are
    interchangeable.  A document longer than a block takes the slot of the block in
    which it starts, so one slot may hold more than ``block`` characters, and the blocks
    that it covers whole stay empty: weights hold in slots, over characters on average.
    Columns named block, release, deadline or slot are replaced.  Empty table: no rows.
    Sources may be of any number (``period_slots``); the turns of at most ``SOURCES`` of them are
    broadcast, those of more are joined by shuffles.
    """
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    c_source, c_key, c_bucket, c_chars, c_before, c_base, c_tie, c_share, c_period, c_turn, c_release, c_deadline, c_slot, c_name = (mark + c for c in ("source", "key", "bucket", "chars", "before", "base", "tie", "share", "period", "turn", "release", "deadline", "slot", "name"))
    rows = docs.select(F.count("*").alias("n")).first()["n"]
    digits = _digits(rows, bucket)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [c for c in docs.columns if c not in ("block", "release", "deadline", "slot")]
    keyed = docs.withColumns({c_source: source, c_key: order_key(F.col("doc_id"), F.col("text")), c_chars: F.length(text).cast("long"), c_tie: F.md5(text.cast("binary"))})
    keyed = keyed.withColumn(c_bucket, F.substring(c_key, 1, digits) if digits else F.lit(""))
    sums = keyed.groupBy(c_source, c_bucket).agg(F.sum(c_chars).alias("c"))
    base = sums.select(c_source, c_bucket, (F.sum("c").over(W.partitionBy(c_source).orderBy(c_bucket).rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias(c_base))
    inside = F.sum(c_chars).over(W.partitionBy(c_source, c_bucket).orderBy(c_key, "doc_id", c_tie).rowsBetween(W.unboundedPreceding, 0)) - F.col(c_chars)
    placed = keyed.select(*keep, c_source, c_bucket, c_chars, c_key, c_tie).withColumn(c_before, inside).join(base, [c_source, c_bucket])
    placed = placed.select(*keep, c_source, F.floor((F.col(c_before) + F.col(c_base)) / F.lit(block)).cast("long").alias("block"))
    table = materialize(shares(docs, weights, period))
    slots = period_slots(table).select(F.col("source").alias(c_name), F.col("share").alias(c_share), F.col("period").alias(c_period), F.col("turn").alias(c_turn), F.col("release").alias(c_release), F.col("deadline").alias(c_deadline), F.col("slot").alias(c_slot))
    turns = slots.groupBy(c_name).agg(F.first(c_share).alias(c_share), F.first(c_period).alias(c_period), F.array_sort(F.collect_list(F.struct(c_turn, c_release, c_deadline, c_slot))).alias("turns"))
    small = table.count() <= SOURCES
    mixed = placed.join(F.broadcast(turns) if small else turns.hint("shuffle_merge"), F.col(c_source) == F.col(c_name))
    turn = F.get("turns", (F.col("block") % F.col(c_share)).cast("int"))
    lap = F.floor(F.col("block") / F.col(c_share)).cast("long") * F.col(c_period)
    return mixed.select(*keep, "block", *((lap + turn[c]).alias(n) for c, n in ((c_release, "release"), (c_deadline, "deadline"), (c_slot, "slot"))))
