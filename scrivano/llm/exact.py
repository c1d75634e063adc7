"""Operator 5: exact duplicates through a cuckoo-filter index of live digests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Digests that a map task holds before it passes its groups on.
HELD = 200_000


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints over buckets that store the keys.

    A digest has two candidate buckets of four slots.  A fingerprint hit is
    verified against the key in its slot, so answers are exact; each key carries
    a value.  Keys can be deleted, which frees their slot.  When an insertion
    finds no place after ``kicks`` moves, the table doubles and is rebuilt from
    the stored keys.
    """

    SLOTS = 4

    def __init__(self, buckets: int = 1024, kicks: int = 200):
        if buckets < 1 or buckets & (buckets - 1):
            raise ValueError("buckets must be a power of two")
        self.kicks = kicks
        self.resizes = 0
        self.live = 0
        self.stash: dict[bytes, object] = {}
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * self.SLOTS)
        self.keys: list[bytes | None] = [None] * (buckets * self.SLOTS)
        self.values: list = [None] * (buckets * self.SLOTS)

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = (key[0] << 8 | key[1]) or 1
        first = int.from_bytes(key[2:10], "big") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 3)) & self.mask

    def _slot(self, key: bytes) -> int:
        mark, first, second = self._place(key)
        prints, keys = self.prints, self.keys
        for bucket in (first, second):
            at = bucket * self.SLOTS
            for slot in range(at, at + self.SLOTS):
                if prints[slot] == mark and keys[slot] == key:
                    return slot
        return -1

    def get(self, key: bytes):
        slot = self._slot(key)
        return self.values[slot] if slot >= 0 else self.stash.get(key) if self.stash else None

    def put(self, key: bytes, value) -> None:
        """Insert a key or replace its value."""
        slot = self._slot(key)
        if slot >= 0:
            self.values[slot] = value
            return
        if key in self.stash:
            self.stash[key] = value
            return
        self.live += 1
        left = self._insert(key, value)
        if left is not None:
            self._grow(left)

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            self.live -= key in self.stash
            return self.stash.pop(key, self) is not self
        self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.live -= 1
        return True

    def items(self):
        yield from ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)
        yield from self.stash.items()

    def _insert(self, key: bytes, value):
        """None, or the (key, value) that found no place."""
        mark, bucket, second = self._place(key)
        for b in (bucket, second):
            for slot in range(b * self.SLOTS, (b + 1) * self.SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.keys[slot], self.values[slot] = mark, key, value
                    return None
        for kick in range(self.kicks):
            slot = bucket * self.SLOTS + kick % self.SLOTS
            out = self.prints[slot], self.keys[slot], self.values[slot]
            self.prints[slot], self.keys[slot], self.values[slot] = mark, key, value
            mark, key, value = out
            bucket = self._other(bucket, mark)
            for free in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if not self.prints[free]:
                    self.prints[free], self.keys[free], self.values[free] = mark, key, value
                    return None
        return key, value

    def _grow(self, left) -> None:
        """Double the table, again if need be, and reinsert the stored keys."""
        stored = [*self.items(), left]
        self.stash = {}
        buckets = self.mask + 1
        for _ in range(8):
            buckets *= 2
            self.resizes += 1
            self._clear(buckets)
            if all(self._insert(key, value) is None for key, value in stored):
                return
        # More keys share both buckets than these hold at any size: the last one waits outside.
        self.stash[left[0]] = left[1]
        stored.pop()
        for key, value in stored:
            if (out := self._insert(key, value)) is not None:
                self.stash[out[0]] = out[1]


_FIELDS = "sha binary, n long, chars long, id long, rid long"


_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
_TYPES = [pa.binary(), *[pa.int64()] * 4]


def _add(index: CuckooIndex, sha, n, chars, doc_id, rid) -> None:
    """Put a group into the index, or merge it with its digest's."""
    had = index.get(sha)
    if had is not None:
        # The longest text, then the least id (null last), then the first row.
        if (-chars, doc_id is None, doc_id or 0, rid) > (-had[1], had[2] is None, had[2] or 0, had[3]):
            chars, doc_id, rid = had[1:]
        n += had[0]
    index.put(sha, (n, chars, doc_id, rid))


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True)


def _taken(index: CuckooIndex, keys: list[bytes]):
    """Delete digests from the index and pass their groups on."""
    for at in range(0, len(keys), 10_000):
        rows = [(k, *index.get(k)) for k in keys[at : at + 10_000]]
        for k in keys[at : at + 10_000]:
            index.delete(k)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _merge(batches):
    """Groups (sha, n, best row) -> the groups of this task, merged by an index.

    A full index lets half of its groups go; what comes later of these is merged after the shuffle."""
    index = CuckooIndex()
    for row in _rows(batches):
        _add(index, *row)
        if index.live >= HELD:
            yield from _taken(index, [k for k, _ in index.items()][: HELD // 2])
    yield from _taken(index, [k for k, _ in index.items()])


def _sorted(batches):
    """As _merge, for rows sorted by digest: a digest is deleted as soon as the next one is seen."""
    index, done, last = CuckooIndex(), [], None
    for row in _rows(batches):
        if row[0] != last and last is not None:
            done.append(last)
            if len(done) == 10_000:
                yield from _taken(index, done)
                done = []
        _add(index, *row)
        last = row[0]
    yield from _taken(index, [k for k, _ in index.items()])


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """rid, doc_id, chars and the digest of the text without blanks, for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("chars"), F.unhex(F.sha2(F.translate(text, " \t\n\x0b\x0c\r", ""), 256)).alias("sha"))


def exact_dedup(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Group documents whose texts are equal without blanks and tab..carriage return.

    docs: doc_id, text and any other columns (ignored).  Returns rid (the row's number,
    from the column ``row`` or given here), doc_id, keep_id, group_size, kept, text_sha256.

    Map tasks merge their groups in a ``CuckooIndex`` before the shuffle, so a
    group of any size sends one row per task; reduce tasks merge the rest, in the order
    of digests, and delete from the index what is complete.
    Digests are SHA-256 of the whole normalised text.

    Null text counts as empty.  The longest original stays, then the least
    doc_id (null last), then the first row; one row of each group is kept even if
    rows repeat.  Empty table: no rows.
    """
    rows = materialize(digests(docs, row))
    single = rows.select("sha", F.lit(1).cast("long").alias("n"), "chars", F.col("doc_id").alias("id"), "rid")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = single.mapInArrow(_merge, _FIELDS).repartition(parts, "sha").sortWithinPartitions("sha").mapInArrow(_sorted, _FIELDS)
    groups = materialize(groups)
    best = groups.select("sha", F.col("n").alias("group_size"), F.col("id").alias("keep_id"), F.col("rid").alias("best"))
    out = rows.join(best.hint("shuffle_merge"), "sha")
    return out.select("rid", "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("best")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
