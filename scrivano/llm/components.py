"""Connected components by rounds of large and small stars, on tables only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


#: Edges that one task may contract at a time (two longs each), and that are finished in one.
HELD = 1_000_000


def _contract(batches):
    """Edges of a task -> (node, least node it is joined to here): a forest of stars."""

    def forest(parts):
        a = np.concatenate([p[0] for p in parts])
        b = np.concatenate([p[1] for p in parts])
        names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = flat[: len(a)], flat[len(a) :]
        root = np.arange(len(names))
        while True:
            # Names are sorted, so the least number is the least node.
            low = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            root = root[root]
            if (root == before).all():
                break
        child = np.flatnonzero(root != np.arange(len(names)))
        return names[root[child]], names[child]

    parts, held = [], 0
    for batch in batches:
        parts.append(tuple(batch.column(c).to_numpy() for c in ("u", "v")))
        held += batch.num_rows
        if held >= HELD:
            parts = [forest(parts)]
            held = len(parts[0][0])
            if held >= HELD // 2:
                yield from _edges(parts)
                parts, held = [], 0
    if held:
        yield from _edges([forest(parts)])


def _edges(parts):
    for u, v in parts:
        for at in range(0, len(u), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[at : at + 50_000]), pa.array(v[at : at + 50_000])], ["u", "v"])


def components(edges: DataFrame, rounds: int = 60, held: int = HELD) -> DataFrame:
    """Edges (a, b) of longs -> (node, root), the least node of each component.

    Tasks first contract their own edges to stars.  If at most ``held`` edges are
    left, one task finishes; beyond, rounds on tables do: each links every node's
    larger neighbours, then its smaller ones, to its least neighbour.  Both are
    aggregations, so a star of any size costs a row per edge, and the number of
    rounds grows with the logarithm of the diameter.  Self-loops and repeated
    edges are ignored; nodes without edges don't appear.
    """
    tidy = edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    now = materialize(tidy.mapInArrow(_contract, "u long, v long"))
    if now.count() <= held:
        return _rooted(materialize(now.coalesce(1).mapInArrow(_contract, "u long, v long")))
    count = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # In ``large`` u < v: v's smaller neighbours meet at the least of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        after = materialize(small.select(F.col("m").alias("u"), "v").unionByName(small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct())
        # Stable when every larger end has one smaller neighbour that is no larger end itself.
        total = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if count == (total.n, total.h):
            break
        now, count = after, (total.n, total.h)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return _rooted(after)


def _rooted(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
