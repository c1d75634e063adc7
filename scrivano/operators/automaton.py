"""States of a finite automaton over the lines of documents, by composing the lines' maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Lines that are composed in one row.
CHUNK = 512


def line_states(lines: DataFrame, step: Column, count: int, key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """Add state, the automaton's state before each line, and after, the one after it.

    step is an array: the state that follows each of the ``count`` states; state 0 is the
    first.  Maps compose associatively, so chunks of lines are folded on their own, a
    document's chunks are chained by their maps, and each chunk then runs from its start:
    one document of any length is spread over tasks.
    """
    own = F.struct("pos", step.alias("step"), *(c for c in lines.columns if c not in (key, "pos")))
    packed = lines.groupBy(key, F.floor(F.col("pos") / chunk).alias("_chunk")).agg(F.array_sort(F.collect_list(own), lambda a, b: a["pos"] - b["pos"]).alias("_all"))
    same = F.array(*(F.lit(k) for k in range(count)))
    whole = F.aggregate("_all", same, lambda m, x: F.transform(m, lambda s: F.get(x["step"], s)))
    before = W.partitionBy("_key").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    maps = packed.select(F.col(key).alias("_key"), F.col("_chunk").alias("_at"), whole.alias("_map"))
    starts = maps.select("_key", "_at", F.aggregate(F.collect_list("_map").over(before), F.lit(0), lambda s, m: F.get(m, s)).alias("_start"))
    both = packed.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_at")))
    run = F.aggregate("_all", F.array("_start"), lambda seen, x: F.concat(seen, F.array(F.get(x["step"], F.element_at(seen, -1)))))
    rows = both.select(key, F.explode(F.arrays_zip(F.col("_all").alias("x"), F.slice(run, 1, F.size("_all")).alias("state"), F.slice(run, 2, F.size("_all")).alias("after"))).alias("r"))
    return rows.select(key, *(F.col(f"r.x.{c}").alias(c) for c in lines.columns if c != key), F.col("r.state").alias("state"), F.col("r.after").alias("after"))
