"""Windows of units (bytes or words) that occur more than once, over a whole corpus.

Shared plan of the substring operators.  No text is compared with all others and
no group of equal passages is gathered in one task:

1. rows are numbered once, in a written table of packed texts; everything later
   goes by that number, whatever ids the rows have;
2. every window elects one anchor inside it from its own content, so equal
   windows have anchors of equal name; names that occur once cannot belong to a
   repeat and are dropped by a counted semi-join (combined before the shuffle, so
   a hot name costs a row per task);
3. an anchor's *context* is the text under neighbouring windows that elected it.
   Contexts that are equal as a whole (128-bit digest) are repeated in full: only
   their digest moves;
4. one representative of each remaining distinct context is cut from its text, and
   a resolver finds and verifies the windows that two contexts of a name share.
   A name with more than ``hot`` contexts is split first: its windows go by the
   anchor's offset in halves, and each half has a longer common part, whose content
   extends the name.  This repeats, to whole windows at most, where contexts of a
   name are all equal; so every group is resolved the same way, a bounded one at a time;
5. the windows that were told apart return to their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import PrefixHash, U, mix
from .scratch import discard, materialize

#: Bytes of text worked on at a time.
CHUNK = 1 << 20
#: Contexts that are resolved at a time (a few hundred bytes each); larger groups are split.
HOT = 8192


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of pieces of a text column; a null is empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    raw, blob = column.buffers()[1:3]
    offsets = np.frombuffer(raw, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(blob, dtype=np.uint8) if blob is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def unpacked(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As ``chunks``, for packed texts."""
    press = zstandard.ZstdDecompressor()
    i, parts, size = 0, [], 0
    for k, blob in enumerate(column):
        parts.append(press.decompress(blob.as_py()))
        size += len(parts[-1])
        if size >= CHUNK or k + 1 == len(column):
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            yield i, k + 1, np.frombuffer(b"".join(parts), dtype=np.uint8), offsets
            i, parts, size = k + 1, [], 0


class Layout(NamedTuple):
    """Units of some texts: unit k is data[starts[k]:stops[k]]; text t has units offsets[t]..offsets[t + 1]."""

    data: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    offsets: np.ndarray


def flat_ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, step: int = 4096) -> np.ndarray:
    """Whether data[a:a + size] == data[b:b + size], elementwise, on the bytes themselves."""
    out = np.ones(len(a), dtype=bool)
    for i in range(0, len(a), step):
        part = slice(i, i + step)
        n = size[part]
        unlike = data[flat_ranges(a[part], n)] != data[flat_ranges(b[part], n)]
        owner = np.repeat(np.arange(len(n)), n)
        out[i + owner[unlike]] = False
    return out


class Units:
    """What the plan needs to know of a unit; see ``substring.Words`` and ``substring.Bytes``."""

    width: int

    def layout(self, data, offsets) -> Layout: ...

    def symbols(self, layout: Layout) -> np.ndarray:
        """A 64-bit name for each unit."""

    def anchors(self, layout: Layout):
        """(name, anchor, first, last): the windows first..last elected the symbol at unit anchor."""

    def resolve(self, key, layout: Layout, lead, m) -> np.ndarray:
        """For all windows of all contexts in a row, whether another context of its key has it.

        Context c has windows 0..m[c] - 1, its anchor is unit lead[c]; keys are sorted."""

    def finish(self, layout: Layout, covered: np.ndarray) -> list:
        """Columns of the result, a row for each text."""


_CONTEXT = "key long, ctx binary, rid long, place long, off int, lead int, m int, lo int, hi int, n long, body binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in text.split(", ")])


class Plan:
    def __init__(self, units: Units, hot: int = HOT):
        if not 0 < units.width <= 256:
            raise ValueError("a window has 1 to 256 units")
        self.units, self.width, self.hot = units, units.width, hot

    # -- names ----------------------------------------------------------------
    def _digests(self, layout, first, last, lead):
        """128-bit digests of contexts: their bytes, and where their anchor is."""
        view = memoryview(np.ascontiguousarray(layout.data))
        seeds = (lead << 8 | (last - first)).tolist()
        spans = zip(layout.starts[first].tolist(), layout.stops[last + self.width - 1].tolist(), seeds, strict=True)
        return [xxhash.xxh3_128_digest(view[a:b], s) for a, b, s in spans]

    def names(self, batches):
        schema = _schema("key long, ctx binary, rid long, place long")
        for batch in batches:
            rids = batch.column("rid").to_numpy()
            for i, j, data, offsets in unpacked(batch.column("packed")):
                layout = self.units.layout(data, offsets)
                name, anchor, first, last = self.units.anchors(layout)
                row = np.searchsorted(layout.offsets, first, side="right") - 1
                place = (first - layout.offsets[row]) << 16 | (last - first) << 8 | (anchor - first)
                ctx = pa.array(self._digests(layout, first, last, anchor - first), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), ctx, pa.array(rids[i:j][row]), pa.array(place)], schema=schema)

    # -- contexts -------------------------------------------------------------
    def cut(self, batches):
        """Packed texts with the places of contexts -> contexts with their text."""
        schema = _schema(_CONTEXT + ", many long")
        for batch in batches:
            rids, reps = batch.column("rid").to_numpy(), batch.column("reps")
            for i, j, data, offsets in unpacked(batch.column("packed")):
                layout = self.units.layout(data, offsets)
                part = reps.slice(i, j - i)
                rep, count = part.flatten(), np.diff(part.offsets.to_numpy())
                place = rep.field("place").to_numpy()
                first = np.repeat(layout.offsets[:-1], count) + (place >> 16)
                m, lead = (place >> 8 & 0xFF) + 1, place & 0xFF
                body = self._bodies(layout, first, m)
                zero = np.zeros(len(place), dtype=np.int32)
                columns = [rep.field("key"), rep.field("ctx"), pa.array(np.repeat(rids[i:j], count)), pa.array(place), zero, lead, m, zero, zero + self.width - 1, rep.field("n"), body, rep.field("many")]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int32)) for c in columns], schema=schema)

    def _bodies(self, layout, first, m):
        view = memoryview(np.ascontiguousarray(layout.data))
        spans = zip(layout.starts[first].tolist(), layout.stops[first + m + self.width - 2].tolist(), strict=True)
        return pa.array([bytes(view[a:b]) for a, b in spans], pa.binary())

    def split(self, batches):
        """Contexts of hot names -> for each half of the anchor's offsets, the part under its windows.

        The windows whose anchor is lo..hi units from their start all hold the units from
        anchor - lo to anchor + width - hi, so equal windows agree on these: they extend the name.
        """
        schema = _schema(_CONTEXT)
        for batch in batches:
            get = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "rid", "place", "off", "lead", "m", "lo", "hi", "n")}
            for i, j, data, offsets in chunks(batch.column("body")):
                layout = self.units.layout(data, offsets)
                ph = PrefixHash(self.units.symbols(layout))
                x = {c: v[i:j] for c, v in get.items()}
                middle = (x["lo"] + x["hi"]) // 2
                for lo, hi in ((x["lo"], middle), (middle + 1, x["hi"])):
                    far, near = np.minimum(hi, x["lead"]), np.maximum(lo, x["lead"] - x["m"] + 1)
                    k = np.flatnonzero((far >= near) & (lo <= hi))
                    lo_, hi_, lead, m = lo[k], hi[k], far[k], (far - near + 1)[k]
                    skip = x["lead"][k] - lead
                    first = layout.offsets[:-1][k] + skip
                    anchor = first + lead
                    common = ph.slices(anchor - lo_, anchor + self.width - hi_)
                    name = mix(x["key"][k].view(U) ^ mix(common ^ (lo_ << 16 | hi_).astype(U)))
                    ctx = pa.array(self._digests(layout, first, first + m - 1, lead), pa.binary())
                    columns = [name.view(np.int64), ctx, x["rid"][k], x["place"][k], x["off"][k] + skip, lead, m, lo_, hi_, x["n"][k], self._bodies(layout, first, m)]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c).cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def shared(self, batches):
        """Contexts sorted by key -> bitmaps of the repeated windows of the contexts of one row."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            key = rest.column("key").to_numpy()
            if not len(key) or key[0] == key[-1] or rest.nbytes < CHUNK:
                continue
            at = int(np.searchsorted(key, key[-1], side="left"))
            yield from self._resolved(rest.slice(0, at))
            rest = rest.slice(at)
        if rest is not None and rest.num_rows:
            yield from self._resolved(rest)

    def _resolved(self, table):
        key, lead, m = (table.column(c).to_numpy() for c in ("key", "lead", "m"))
        lead, m = lead.astype(np.int64), m.astype(np.int64)
        for _, _, data, offsets in chunks_whole(table.column("body")):
            hits = self.units.resolve(key, self.units.layout(data, offsets), lead, m)
            stop = np.cumsum(m)
            keep = np.flatnonzero(table.column("n").to_numpy() == 1)
            if len(keep):
                bits = [np.packbits(hits[stop[k] - m[k] : stop[k]], bitorder="little").tobytes() for k in keep.tolist()]
                told = [table.column(c).combine_chunks().take(pa.array(keep)) for c in ("rid", "place", "off", "m")]
                yield pa.RecordBatch.from_arrays([*told, pa.array(bits, pa.binary())], ["rid", "place", "off", "m", "bits"])

    # -- the plan -------------------------------------------------------------
    def marks(self, packed: DataFrame) -> DataFrame:
        """(rid, place, off, m, bits): candidate places, null off; and of some of their windows
        (m from off on) which are repeated.  Windows of a place that nothing more is said of are repeated."""
        spark = packed.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        told_schema = "rid long, place long, off int, m int, bits binary"
        named = materialize(packed.select("rid", "packed").mapInArrow(self.names, "key long, ctx binary, rid long, place long"))
        # Read again from a table, the join's own shuffle can split a hot name between tasks.
        twice = materialize(named.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
        found = materialize(named.join(twice.hint("shuffle_merge"), "key", "left_semi"))
        discard(named, twice)
        contexts = found.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.first("rid").alias("rid"), F.first("place").alias("place"))
        # many: the name's distinct contexts.
        several = contexts.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
        reps = contexts.join(several.hint("shuffle_merge"), "key")
        # A row's own list, as long as its text at most.
        lists = materialize(reps.groupBy("rid").agg(F.collect_list(F.struct("key", "ctx", "n", "place", "many")).alias("reps")))
        bodies = materialize(packed.join(lists.hint("shuffle_merge"), "rid").select("rid", "packed", "reps").mapInArrow(self.cut, _CONTEXT + ", many long"))
        told = []
        while True:
            cool = bodies.where((F.col("many") <= self.hot) | (F.col("lo") >= F.col("hi"))).drop("many")
            told.append(cool.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(self.shared, told_schema))
            warm = bodies.where((F.col("many") > self.hot) & (F.col("lo") < F.col("hi"))).drop("many")
            if warm.isEmpty():
                break
            # Halves of the windows under longer names; a halving each time, so eight times at most.
            halves = materialize(warm.mapInArrow(self.split, _CONTEXT))
            rest = [f.split()[0] for f in _CONTEXT.split(", ") if f.split()[0] not in ("key", "ctx", "n")]
            one = halves.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.first(F.struct(*rest)).alias("one")).select("key", "ctx", "n", "one.*")
            many = halves.select("key", "ctx").distinct().groupBy("key").agg(F.count("*").alias("many"))
            bodies = materialize(one.join(many.hint("shuffle_merge"), "key").select(*[f.split()[0] for f in _CONTEXT.split(", ")], "many"))
        out = found.select("rid", "place", F.lit(None).cast("int").alias("off"), F.lit(None).cast("int").alias("m"), F.lit(None).cast("binary").alias("bits"))
        for part in told:
            out = out.unionByName(part)
        return out

    def apply(self, docs: DataFrame, schema: str) -> DataFrame:
        """``Units.finish`` of every row of docs; schema: doc_id and its columns."""
        docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        packed = materialize(docs.mapInArrow(_pack, "rid long, doc_id long, packed binary"))
        # A row's own list, as long as its text at most.
        marks = self.marks(packed).groupBy("rid").agg(F.collect_list(F.struct("place", "off", "m", "bits")).alias("marks"))
        out = _schema(schema)

        def run(batches):
            for batch in batches:
                marks = batch.column("marks")
                for i, j, data, offsets in unpacked(batch.column("packed")):
                    layout = self.units.layout(data, offsets)
                    covered = self._covered(layout, marks.slice(i, j - i))
                    columns = [batch.column("doc_id").slice(i, j - i), *self.units.finish(layout, covered)]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, out.types, strict=True)], schema=out)

        return packed.join(marks.hint("shuffle_merge"), "rid", "left").select("doc_id", "packed", "marks").mapInArrow(run, schema)

    def _covered(self, layout, marks):
        """Which units some repeated window covers."""
        n = len(layout.starts)
        found = marks.flatten()
        count = np.where(marks.is_valid().to_numpy(zero_copy_only=False), np.nan_to_num(marks.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
        base = np.repeat(layout.offsets[:-1], count)
        place = found.field("place").to_numpy()
        whole = found.field("off").is_null().to_numpy(zero_copy_only=False)
        first = base + (place >> 16)
        edges = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edges, first[whole], 1)
        np.add.at(edges, first[whole] + (place[whole] >> 8 & 0xFF) + 1, -1)
        hit = np.cumsum(edges[:-1]) > 0
        some = np.flatnonzero(~whole)
        if len(some):
            part = found.take(pa.array(some))
            at = (first[some] + part.field("off").to_numpy()).tolist()
            for a, m, bits in zip(at, part.field("m").to_pylist(), part.field("bits").to_pylist(), strict=True):
                hit[a : a + m] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=m, bitorder="little")
        at = np.flatnonzero(hit)
        edges = np.zeros(n + 1, dtype=np.int64)
        edges[at] += 1
        edges[at + self.width] -= 1
        return np.cumsum(edges[:-1]) > 0


def chunks_whole(column: pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The one chunk of a bounded column of bytes."""
    body = column.combine_chunks().cast(pa.large_binary())
    n = len(body)
    offsets = np.frombuffer(body.buffers()[1], dtype=np.int64)[body.offset : body.offset + n + 1]
    data = np.frombuffer(body.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    yield 0, n, data, offsets - offsets[0]


def _pack(batches):
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blobs = pa.array([press.compress(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), blobs], ["rid", "doc_id", "packed"])
