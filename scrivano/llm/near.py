"""Operator 3: near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import PrefixHash, U, byte_symbols, mix
from .components import components
from .repeats import chunks
from .scratch import materialize
from .substring import word_edges

#: Minima of a document, rows of a band, bits kept of a minimum.
MINIMA, ROWS, BITS = 128, 4, 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle names sorted within each document, document offsets)."""
    data = _LOWER[data]
    starts, stops, word_offsets = word_edges(data, offsets)
    symbols = mix(PrefixHash(byte_symbols(data)).slices(starts, stops) ^ (stops - starts).astype(U))
    counts = np.diff(word_offsets)
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    first = word_offsets[:-1][doc] + np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    length = np.minimum(counts[doc], words)
    names = mix(PrefixHash(symbols).slices(first, first + length) + length.astype(U))
    order = np.lexsort((names, doc))
    names, doc = names[order], doc[order]
    fresh = np.ones(len(names), dtype=bool)
    fresh[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    names, doc = names[fresh], doc[fresh]
    return names, np.searchsorted(doc, np.arange(len(counts) + 1))


_FACTORS = mix(np.arange(1, MINIMA + 1, dtype=U) * U(0xA24BAED4963EE407)) | U(1)


def minima(names: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MINIMA x documents: the least image of each non-empty set under each hash function."""
    out = np.empty((MINIMA, len(offsets) - 1), dtype=U)
    for k, factor in enumerate(_FACTORS):
        image = names * factor
        image ^= image >> U(29)
        out[k] = np.minimum.reduceat(image, offsets[:-1])
    return out


def _set_digests(names, edges):
    """128 bits of each set's sorted names; null for an empty set."""
    view = memoryview(np.ascontiguousarray(names)).cast("B")
    return pa.array([xxhash.xxh3_128_digest(view[8 * a : 8 * b]) if b > a else None for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())


_ROW = "rid long, doc_id long, n long, digest binary, sig array<long>, bands array<long>, body binary"


def _digests(words: int):
    """Rows with the size, digest, packed minima and bands of their set, and their packed text."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in _ROW.split(", ")])
        for batch in batches:
            ids, rids = batch.column("doc_id"), batch.column("rid")
            for i, j, data, offsets in chunks(batch.column("text")):
                names, edges = shingle_sets(data, offsets, words)
                n = np.diff(edges)
                full = np.flatnonzero(n > 0)
                size = len(full)
                packed = keys = None
                if size:
                    at = np.append(edges[:-1][full], edges[-1])
                    low = minima(names, at)
                    per = 64 // BITS
                    nibbles = (low & U((1 << BITS) - 1)).reshape(-1, per, size)
                    packed = np.zeros((MINIMA // per, size), dtype=U)
                    for k in range(per):
                        packed |= nibbles[:, k] << U(k * BITS)
                    rows = low.reshape(-1, ROWS, size)
                    keys = np.zeros((MINIMA // ROWS, size), dtype=U) + mix(np.arange(1, MINIMA // ROWS + 1, dtype=U))[:, None]
                    for k in range(ROWS):
                        keys = mix(keys * U(3) + rows[:, k])
                columns = [rids.slice(i, j - i), ids.slice(i, j - i), pa.array(n), _set_digests(names, edges)]
                for part, wide in ((packed, MINIMA * BITS // 64), (keys, MINIMA // ROWS)):
                    lengths = np.where(n > 0, wide, 0)
                    flat = part.T.reshape(-1).view(np.int64) if part is not None else np.zeros(0, dtype=np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat)))
                columns.append(pa.array([press.compress(data[x:y].tobytes()) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _confirm(words: int, percent: int):
    """Pairs with both texts -> the pairs whose full sets are alike enough."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            keep = []
            left, right = batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist()
            last, kept = None, None
            for k, (a, b) in enumerate(zip(left, right, strict=True)):
                if a is not last and a != last:
                    last, kept = a, _set(unpack, a, words)
                other = _set(unpack, b, words)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                if 100 * both >= percent * (len(kept) + len(other) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return run


def _set(unpack, body, words):
    data = np.frombuffer(unpack.decompress(body), dtype=np.uint8)
    return shingle_sets(data, np.array([0, len(data)], dtype=np.int64), words)[0]


def estimated(a, b):
    """Similarity from packed low bits: the share of equal minima, less chance agreement."""
    parts = []
    for k in range(MINIMA * BITS // 64):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        parts.append(F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    unlike = sum(parts[1:], parts[0])
    chance = 1 / (1 << BITS)
    return (1 - unlike / F.lit(MINIMA) - chance) / (1 - chance)


def minhash_near_dedup(docs: DataFrame, words: int = 5, percent: int = 75, slack: float = 0.21, stars: int = 1, row: str | None = None) -> DataFrame:
    """Group documents whose word-shingle sets have a Jaccard similarity of ``percent`` or more.

    docs: doc_id, text and any other columns (ignored).  Returns doc_id,
    n_shingles, component_id, kept and rid: the row's number, from the column ``row`` or given here.

    Documents with equal sets (128-bit digest of the sorted shingle names) are one
    node.  128 minima make 32 bands of four (a pair at 0.75 shares none with a chance
    of 5e-6); the low four bits of the minima are packed into eight longs, and the
    estimate by bit counts, less chance agreement, drops pairs more than ``slack``
    (five deviations) below the limit.  Links are confirmed on full sets of 64-bit
    shingle names.  The members of a bucket meet two centres, those not in a
    centre's component yet meet ``stars`` more, and components are drawn together after
    each; what is then still apart is paired by its rarest shingles (``prefix_pairs``),
    never all with all.

    Null or blank texts: an empty set, a component of their own.  Null doc_id:
    takes part; the component's id is its least known id, null if it has none.
    Rows that repeat an id are nodes by their text.  Empty table: no rows.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    docs = docs.select(number.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = materialize(docs.mapInArrow(_digests(words), _ROW))
    # Node numbers are given once, in the written table; a node's text is that of one of its rows.
    nodes = base.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("rid").alias("rid"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    spread = nodes.select("node", F.explode("bands").alias("band"))
    many = spread.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    postings = materialize(spread.join(many.hint("shuffle_merge"), "band", "left_semi").select("band", "node"))
    floor = percent / 100 - slack

    def held(wanted):
        """node, sig, body of the wanted nodes."""
        named = nodes.select("node", "rid", "sig").join(wanted.hint("shuffle_merge"), "node", "left_semi")
        return base.select("rid", "body").join(named.hint("shuffle_merge"), "rid").select("node", "sig", "body")

    def confirmed(pairs):
        there = materialize(held(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
        both = pairs
        for side in "ba":
            both = both.join(there.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}"), F.col("body").alias(f"body_{side}")).hint("shuffle_merge"), side)
        alike = both.where(estimated(F.col("sig_a"), F.col("sig_b")) >= floor)
        return materialize(alike.select("a", "b", "body_a", "body_b").mapInArrow(_confirm(words, percent), "a long, b long"))

    def centre(k):
        """Of least rank among all nodes, so that the buckets of a group have few centres."""
        return F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("hub"), F.col("root").alias("hub_root")))

    seen = links = roots = None
    for r in range(stars + 2):
        # The members of each bucket, by component.
        labelled = postings.withColumn("root", F.col("node")) if roots is None else postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = labelled.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), centre(r).alias("c"), centre(-1).alias("d")).where("x <> y")
        if r <= stars:
            hubs = F.explode(F.array("c", "d") if r == 0 else F.array("c")).alias("c")
            pairs = labelled.join(split.select("band", hubs).select("band", "c.hub", "c.hub_root"), "band").where("root <> hub_root").select("node", F.col("hub").alias("other"))
        else:
            # What the centres left apart.
            apart = materialize(labelled.join(split.select("band"), "band", "left_semi").select("node", "root").distinct())
            if apart.isEmpty():
                break
            pairs = prefix_pairs(apart, held(apart.select("node")), words, percent)
        fresh = _pairs(pairs, "node", "other")
        fresh = materialize(fresh if seen is None else fresh.join(seen, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            continue
        seen = fresh if seen is None else seen.unionByName(fresh)
        found = confirmed(fresh)
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        roots = materialize(components(links))
    if roots is None:
        return _finish(base, nodes.select("digest", F.col("least").alias("component_id")))
    least = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = least.select("digest", "root").join(named, "root").select("digest", "component_id")
    return _finish(base, of_node)


def _tokens(words: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sets = [_set(unpack, body, words) for body in batch.column("body").to_pylist()]
            edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], ["node", "root", "tokens"])

    return run


def prefix_pairs(apart: DataFrame, bodies: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, other) of different components that may be alike enough, by their rarest shingles.

    apart: node, root; bodies: node, body.  Two sets of the wanted similarity share a
    shingle among the first of each in the order of rarity; what they share there, and what
    is left behind the last of these in the shorter rest, must reach the limit (prefix and
    position bounds).  Copies with many edits of their own have only shingles of their own
    in front, so they meet nobody: a large group of copies that are not alike enough costs
    few pairs.  Bounds are exact; nothing is lost.
    """
    sets = materialize(bodies.join(apart.hint("shuffle_merge"), "node").select("node", "root", "body").mapInArrow(_tokens(words), "node long, root long, tokens array<long>"))
    exploded = sets.select("node", F.explode("tokens").alias("token"))
    common = materialize(exploded.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    # A set's own shingles come first; they need no names.
    shared = exploded.join(common.hint("shuffle_merge"), "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    n, own = F.size("tokens"), F.size("tokens") - F.size("ranked")
    ordered = sets.join(shared, "node").select("node", "root", n.alias("n"), own.alias("own"), "ranked")
    probe = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    index = F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1

    def part(limit, tag):
        taken = F.slice("ranked", F.lit(1), F.greatest(limit - F.col("own"), F.lit(0)).cast("int"))
        rows = ordered.select("node", "root", "n", "own", F.posexplode(taken).alias("k", "t"))
        return rows.select(F.col("t.token").alias("token"), F.col("node").alias(f"node{tag}"), F.col("root").alias(f"root{tag}"), F.col("n").alias(f"n{tag}"), (F.col("own") + F.col("k")).alias(f"at{tag}"))

    both = part(probe, "x").hint("shuffle_merge").join(part(index, "y"), "token")
    smaller = F.expr("rootx <> rooty AND (ny < nx OR (ny = nx AND nodey < nodex))")
    alike = F.expr(f"ny * 100 >= nx * {percent} AND (1 + least(nx - 1 - atx, ny - 1 - aty)) * {100 + percent} >= (nx + ny) * {percent}")
    met = both.where(smaller & alike).groupBy("nodex", "nodey").agg(F.count("*").alias("met"), F.max("atx").alias("atx"), F.max("aty").alias("aty"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
    # The bound falls along the order, so the tokens that it leaves out stand behind those it lets through.
    enough = F.expr(f"(met + least(nx - 1 - atx, ny - 1 - aty)) * {100 + percent} >= (nx + ny) * {percent}")
    return met.where(enough).select(F.col("nodex").alias("node"), F.col("nodey").alias("other"))


def _pairs(rows: DataFrame, one: str, other: str) -> DataFrame:
    return rows.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _finish(base: DataFrame, of_node: DataFrame) -> DataFrame:
    out = base.select("rid", "doc_id", "n", "digest").join(of_node, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "rid")
