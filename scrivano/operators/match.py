"""Matching rows of two documents or tables: keys, ordinals, intervals, ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .rounds import settled


def last_write(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*[o if isinstance(o, Column) else F.col(o).desc() for o in order]))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str, str] = ("matched", "missing", "orphan")) -> DataFrame:
    """(keys, status): in both tables, only in the left one, only in the right one."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both, missing, orphan = names
    status = F.when(F.col("_l").isNull(), F.lit(orphan)).when(F.col("_r").isNull(), F.lit(missing)).otherwise(F.lit(both))
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def not_yet(rows: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't archived."""
    return rows.join(archive.select(key), key, "left_anti")


def suffix_join(left: DataFrame, right: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Left join on a dotted key; without an equal key, on what follows the first dot.

    Of right rows with one key the last by ``order`` counts.  Several keys may end
    in the same suffix: the one that appears first counts.  Adds how: key, suffix or none.
    """
    rest = F.when(F.contains(key, F.lit(".")), F.expr(f"substring({key}, length(substring_index({key}, '.', 1)) + 2)"))
    first = F.min(order).over(W.partitionBy(key))
    index = last_write(right.withColumn("_first", first), [key], [order])
    by_key = index.select(F.col(key).alias("_k"), *(F.col(v).alias(f"_k_{v}") for v in values))
    by_tail = last_write(index.withColumn("_rest", rest).where("_rest IS NOT NULL"), ["_rest"], [F.col("_first").asc()])
    by_tail = by_tail.select(F.col("_rest").alias("_t"), *(F.col(v).alias(f"_t_{v}") for v in values))
    out = left.withColumn("_tail", F.coalesce(rest, F.col(key)))
    out = out.join(by_key, F.col(key) == F.col("_k"), "left").join(by_tail, F.col("_tail") == F.col("_t"), "left")
    how = F.when(F.col("_k").isNotNull(), F.lit("key")).when(F.col("_t").isNotNull(), F.lit("suffix")).otherwise(F.lit("none"))
    return out.select(*left.columns, how.alias("how"), *(F.when(F.col("_k").isNotNull(), F.col(f"_k_{v}")).otherwise(F.col(f"_t_{v}")).alias(v) for v in values))


def ordinal_join(left: DataFrame, right: DataFrame, group: str, left_order: list[str], right_order: list[str], values: list[str]) -> DataFrame:
    """Pair the k-th left row with the k-th right row of a group; what the right lacks is null."""
    a = left.withColumn("nth", F.row_number().over(W.partitionBy(group).orderBy(*left_order)))
    b = right.withColumn("nth", F.row_number().over(W.partitionBy(group).orderBy(*right_order))).select(group, "nth", *values)
    return a.join(b, [group, "nth"], "left")


def category_paths(nodes: DataFrame, node: str = "id", parent: str = "parent", name: str = "name", joint: str = "/") -> DataFrame:
    """(id, depth, path) from the root down; a parent that is missing or already on the path ends it.

    Paths of any depth, by doubling: in each round a node's path, as far as it is known,
    is joined with the path of the node where it ends, so that n steps take log2(n) rounds.
    Of nodes with one id the first by parent and name counts; a null id is left out.
    """
    text = [F.col(c).cast("string").alias(a) for c, a in ((node, "id"), (parent, "parent"), (name, "name"))]
    rows = nodes.select(*text).where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("parent", "name")).alias("r")).select("id", "r.parent", F.coalesce("r.name", F.lit("")).alias("name"))
    known = rows.select(F.col("id").alias("top"))
    # seen: the ids of the path from the node up; top: the next one, null at an end.
    walk = rows.join(known, F.col("parent") == F.col("top"), "left").select("id", F.array("id").alias("seen"), F.array("name").alias("names"), F.when(F.col("top") != F.col("id"), F.col("top")).alias("top"))
    walk = settled(walk)
    while walk.where("top IS NOT NULL").limit(1).count():
        up = walk.select(F.col("id").alias("u_id"), F.col("seen").alias("u_seen"), F.col("names").alias("u_names"), F.col("top").alias("u_top"))
        both = walk.join(up, F.col("top") == F.col("u_id"), "left")
        # The first node of the upper path that is on the lower one closes a circle.
        again = F.array_position(F.transform("u_seen", lambda x: F.array_contains("seen", x)), F.lit(True))
        stop = F.when(again > 0, again - 1).otherwise(F.size("u_seen")).cast("int")
        open_ = (again == 0) & F.col("u_top").isNotNull() & ~F.array_contains("seen", F.col("u_top"))
        both = both.select("*", stop.alias("stop"), open_.alias("open"))
        more = F.col("top").isNotNull()
        longer = [F.when(more, F.concat(c, F.slice(f"u_{c}", 1, F.col("stop")))).otherwise(F.col(c)).alias(c) for c in ("seen", "names")]
        walk = settled(both.select("id", *longer, F.when(more & F.col("open"), F.col("u_top")).alias("top")))
    return walk.select("id", F.size("seen").alias("depth"), F.array_join(F.reverse("names"), joint).alias("path"))


def free_names(files: DataFrame, key: str, folder: str, now: str, wanted: str) -> DataFrame:
    """(key, name, moves): every file under its wanted name, or that name with -2, -3, ..., unique in its folder.

    wanted may have an extension, before which the number goes.  A file that has its wanted
    name keeps it.  Of several that want one name the first by its present name, then key,
    gets it; the n-th loser asks for the name n numbers further, and so on in rounds until
    nobody moves.  moves tells the number asked for, 1 for the name itself.  Keys are
    unique; a null wanted name keeps the present one.
    """
    want = F.coalesce(F.col(wanted), F.col(now))
    rows = files.select(F.col(key).alias("key"), F.coalesce(F.col(folder), F.lit("")).alias("folder"), F.col(now).alias("now"), want.alias("want"))
    rows = settled(rows.withColumn("moves", F.lit(1)).withColumn("fixed", F.coalesce(F.col("now") == F.col("want"), F.lit(False)) & (F.row_number().over(W.partitionBy("folder", "now").orderBy("key")) == 1)))
    stem, ext = (F.regexp_extract("want", r"(?s)^(.*?)(\.[^./]*)?\z", k) for k in (1, 2))
    name = F.when(F.col("moves") == 1, F.col("want")).otherwise(F.concat(stem, F.lit("-"), F.col("moves").cast("string"), ext))
    while True:
        order = W.partitionBy("folder", "name").orderBy(F.desc("fixed"), "now", "key")
        asked = rows.withColumn("name", name).withColumn("nth", F.row_number().over(order))
        rows = settled(asked.select("key", "folder", "now", "want", (F.col("moves") + F.when(F.col("fixed"), 0).otherwise(F.col("nth") - 1)).cast("int").alias("moves"), (F.col("fixed") | (F.col("nth") == 1)).alias("fixed")))
        if not rows.where("NOT fixed").limit(1).count():
            return rows.select(F.col("key").alias(key), name.alias("name"), "moves")


def common_span(spans: DataFrame, group: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """(group, lo, hi): the stretch that all spans of a group share; none if it is empty."""
    return spans.groupBy(group).agg(F.max(start).alias("lo"), F.min(stop).alias("hi")).where("hi > lo")


def occurs_once(text: Column, part: Column) -> Column:
    """Whether ``part`` occurs exactly once in ``text``."""
    return (F.length(part) > 0) & ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) == F.length(part))


def locate(text: Column, words: Column, sizes: tuple[int, ...] = (60, 40, 30, 24, 18)) -> Column:
    """Position from 1 of the longest of the leading stretches of ``words`` that occurs in text, else null."""
    found = [F.nullif(F.instr(text, F.substring(words, 1, n)), F.lit(0)) for n in sizes]
    return F.coalesce(*(F.when(F.length(words) > 0, x) for x in found))


#: Rows of a table of ranges that go to every task; more meet the lines by a shuffle.
RANGES = 10_000


def _few(ranges: DataFrame) -> DataFrame:
    """The table of ranges, sent to the lines: a source's lines are many and would all go to one task."""
    return F.broadcast(ranges) if ranges.limit(RANGES + 1).count() <= RANGES else ranges


def place_ranges(lines: DataFrame, ranges: DataFrame, source: str = "source") -> DataFrame:
    """Lines by a table of ranges (out_ord, source, lo, hi), pos from 1: (out_ord, source, pos, line).

    The range table is small by its kind, a row for each stretch that an editor chose.
    """
    hit = (F.col("r.source") == F.col(f"l.{source}")) & F.col("l.pos").between(F.col("r.lo"), F.col("r.hi"))
    return lines.alias("l").join(_few(ranges).alias("r"), hit).select("r.out_ord", f"l.{source}", "l.pos", "l.line")


def unused_lines(lines: DataFrame, ranges: DataFrame, source: str = "source") -> DataFrame:
    """Lines that no range takes; substantive tells if they hold more than blanks and rules."""
    hit = (F.col("r.source") == F.col(f"l.{source}")) & F.col("l.pos").between(F.col("r.lo"), F.col("r.hi"))
    left = lines.alias("l").join(_few(ranges).alias("r"), hit, "left_anti")
    bare = F.trim("line")
    return left.withColumn("substantive", (bare != "") & (bare != "---"))
