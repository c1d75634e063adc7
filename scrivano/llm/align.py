"""Operator 11: token alignment between a byte-level BPE and a SentencePiece model."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import BYTE, MARK, build
from .scratch import materialize

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of text in a block, or one text.
BLOCK = 2 << 20
#: Shares of a pair in the first stage of its count.
SALTS = 16
#: Words of SentencePiece that a worker remembers before it starts afresh.
ROOM = 300_000
#: Links that are laid out at a time, or those of one document.
LINKS = 1 << 20
#: Characters beyond which the tokenizers library encodes a text.
LONG = 1 << 20
#: Tokens whose bytes are laid out at a time.
STEP = 1 << 16
#: The word cut of byte-level BPE files (fixed value).
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ragged(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of pool that begin at starts, one after another."""
    ends = np.cumsum(sizes)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring edges, exact for integers."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[edges[1:]] - total[edges[:-1]]


class Tokens:
    """Bytes of a vocabulary's tokens, by id."""

    def __init__(self, table: list[bytes]):
        self.sizes = np.array([len(t) for t in table], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(table), dtype=np.uint8)

    def text(self, ids: np.ndarray) -> np.ndarray:
        parts = (ids[k : k + STEP] for k in range(0, len(ids), STEP))
        return np.concatenate([self.pool[:0], *(ragged(self.pool, self.starts[x], self.sizes[x]) for x in parts)])


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the rest for 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Ids of texts by a byte-level BPE file.

    Where the file's merges come in the order of their results' ids and nothing else is
    set, tiktoken's ranks say the same and it is several times faster; else, and for the
    texts that its word cut can't take, the tokenizers library encodes.
    """

    def __init__(self, data: bytes):
        import tiktoken

        self.data, self.library = data, None
        told = json.loads(data)
        core, alphabet = told["model"], byte_alphabet()
        special = {t["content"] for t in told.get("added_tokens", [])}
        known = core["vocab"] | {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        table = [b""] * (max(known.values()) + 1)
        for token, k in known.items():
            table[k] = token.encode("utf-8") if token in special else bytes(alphabet[c] for c in token)
        self.tokens = Tokens(table)
        merges = [m if isinstance(m, list) else m.split(" ") for m in core["merges"]]
        results = [core["vocab"][a + b] for a, b in merges]
        before = told.get("pre_tokenizer") or {}
        plain = told.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        plain &= not any(core.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.fast = None
        if plain and results == sorted(set(results)):
            ranks = {table[k]: k for token, k in core["vocab"].items() if token not in special}
            self.fast = tiktoken.Encoding("own", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})

    def slow(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.data.decode("utf-8"))
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        fast = self.fast and self.fast.encode_ordinary
        return [np.array(fast(t) if fast and len(t) <= LONG else self.slow(t), dtype=np.int64) for t in texts]


class _Index(dict):
    """Numbers of words; a new word gets the next one and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        return k


class Pieces:
    """Ids of texts by a SentencePiece file, each distinct word encoded once."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tokenizer, model = build(data)
        self.bare, self.prefix = Tokenizer(self.tokenizer.model), " " if model.dummy_prefix else ""
        by_word = not any(MARK in p.lstrip(MARK) for p, _, _ in model.pieces)
        self.cut = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+" if by_word else "(?s).+")
        self.tokens = Tokens([bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode("utf-8") for p, _, kind in model.pieces])
        self.forget()

    def forget(self):
        self.index = _Index()
        self.pool, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        if len(self.index) > ROOM:
            self.forget()
        words: list[str] = []
        counts = []
        for t in texts:
            if self.tokenizer.normalizer is not None:
                t = self.tokenizer.normalizer.normalize_str(t)
            found = self.cut.findall(self.prefix + t) if t else []
            counts.append(len(found))
            words += found
        flat = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            rows = [e.ids for e in self.bare.encode_batch_fast([w.replace(" ", MARK) for w in self.index.new], add_special_tokens=False)]
            self.index.new.clear()
            self.sizes = np.concatenate([self.sizes, np.array([len(r) for r in rows], dtype=np.int64)])
            self.pool = np.concatenate([self.pool, np.array([i for r in rows for i in r], dtype=np.int64)])
        starts = np.cumsum(self.sizes) - self.sizes
        edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return ragged(self.pool, starts[flat], self.sizes[flat]), _sums(self.sizes[flat], edges)


_BUILT: dict = {}


def _pair(left: bytes, right: bytes) -> tuple[ByteLevel, Pieces]:
    """Both encoders are kept in a Python worker."""
    key = (hash(left), hash(right))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = (ByteLevel(left), Pieces(right))
    return _BUILT[key]


def _agree(tokens: Tokens, ids: np.ndarray, counts: np.ndarray, said: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document whether its tokens' bytes are those that it says."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    ok = _sums(tokens.sizes[ids], ends) == lengths
    picked = np.repeat(ok, counts)
    same = tokens.text(ids[picked]) == said[np.repeat(ok, lengths)]
    if not same.all():
        at = np.searchsorted(np.cumsum(lengths[ok]), np.flatnonzero(~same), side="right")
        ok[np.flatnonzero(ok)[at]] = False
    return ok


def _decimal(sizes: tuple[int, int]) -> Tokens:
    """'id,' and 'id|' of the first vocabulary, then 'id,' and 'id;' of the second."""
    return Tokens([f"{i}{end}".encode() for n, ends in zip(sizes, (",|", ",;"), strict=True) for i in range(n) for end in ends])


def cut_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group labels of both sides' tokens, cut where tokens of both end, and their number."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), len(cuts)


def _named(ids: np.ndarray, label: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit name of each group's sequence of ids; names only bring candidates together."""
    place = (np.arange(len(ids)) - first[label]).astype(np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return np.add.reduceat(x, first) if len(first) else x[:0]


def distinct_groups(a, b, in_a, in_b, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(a group of each kind, the kind of each group).  Equal names are compared id by id;
    a group that differs from its name's first one is a kind of its own."""
    size_a, size_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    name = _named(a, in_a, first_a, 1) * np.uint64(0x100000001B3) + _named(b, in_b, first_b, 2)
    _, kept, kind = np.unique(name, return_index=True, return_inverse=True)
    head = kept[kind]
    odd = (size_a != size_a[head]) | (size_b != size_b[head])
    for ids, label, first in ((a, in_a, first_a), (b, in_b, first_b)):
        fine = ~odd[label]
        at = np.flatnonzero(fine)
        wrong = ids[at] != ids[first[head[label[at]]] + at - first[label[at]]]
        odd[label[at[wrong]]] = True
    odd = np.flatnonzero(odd)
    kind[odd] = len(kept) + np.arange(len(odd))
    return np.concatenate([kept, odd]), kind


def _kind_links(a, b, size_a, size_b):
    """Of kinds of groups: (kind, a << 32 | b, how often), a row for each kind and pair of ids."""
    sides = []
    for ids, sizes in ((a, size_a), (b, size_b)):
        key, often = np.unique(np.repeat(np.arange(len(sizes)), sizes) << 32 | ids, return_counts=True)
        sides.append((key >> 32, key & 0xFFFFFFFF, often))
    (ka, xa, ma), (kb, xb, mb) = sides
    many_b = np.bincount(kb, minlength=len(size_b))
    start_b = np.cumsum(many_b) - many_b
    reach = many_b[ka]
    at_b = ragged(np.arange(len(kb)), start_b[ka], reach)
    return np.repeat(ka, reach), np.repeat(xa, reach) << 32 | xb[at_b], np.repeat(ma, reach) * mb[at_b]


def _packed(*arrays: np.ndarray) -> bytes:
    out = []
    for x in arrays:
        x = x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32 if x.max() < 1 << 32 else np.uint64)
        out += [len(x).to_bytes(8, "little"), bytes([x.itemsize]), x.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpacked(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        n, width = int.from_bytes(data[at : at + 8], "little"), data[at + 8]
        out.append(np.frombuffer(data, f"u{width}", n, at + 9).astype(np.int64))
        at += 9 + n * width
    return out


def align_block(byte_level: ByteLevel, pieces: Pieces, decimal: Tokens, texts: list[str | None]):
    """One block: counts and digests of its documents, its pairs with the number of documents
    that link them, and what is needed to sum over the links when the counts are known."""
    rows = len(texts)
    out = {c: np.zeros(rows, dtype=np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    digests = [""] * rows
    which = np.array([k for k, t in enumerate(texts) if t], dtype=np.int64)
    some = [texts[k] for k in which]
    said = [(" " + t).encode("utf-8") for t in some]
    lengths = np.array([len(t) for t in said], dtype=np.int64)
    said = np.frombuffer(b"".join(said), dtype=np.uint8)
    lists = byte_level.encode([" " + t for t in some])
    count_a = np.array([len(x) for x in lists], dtype=np.int64)
    a = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
    b, count_b = pieces.encode(some)
    ok = _agree(byte_level.tokens, a, count_a, said, lengths) & _agree(pieces.tokens, b, count_b, said, lengths)
    a, b = a[np.repeat(ok, count_a)], b[np.repeat(ok, count_b)]
    which, count_a, count_b = which[ok], count_a[ok], count_b[ok]
    if not len(which):
        return out, digests, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), _packed(*[np.zeros(0, dtype=np.int64)] * 7)
    # Each document ends a token on both sides, so that one pass over the block cuts them all.
    in_a, in_b, n = cut_groups(np.cumsum(byte_level.tokens.sizes[a]), np.cumsum(pieces.tokens.sizes[b]))
    size_a, size_b = np.bincount(in_a, minlength=n), np.bincount(in_b, minlength=n)
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    of = in_a[np.cumsum(count_a) - 1] + 1
    edges = np.concatenate([[0], of])
    out["n_a"][which], out["n_b"][which], out["n_groups"][which], out["n_links"][which] = count_a, count_b, np.diff(edges), _sums(size_a * size_b, edges)
    # Text of the groups: the decimal tokens of both sides in their order.
    order = np.empty(len(a) + len(b), dtype=np.int64)
    last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    last_a[first_a + size_a - 1], last_b[first_b + size_b - 1] = 1, 1
    order[np.arange(len(a)) + first_b[in_a]] = 2 * a + last_a
    order[np.arange(len(b)) + (first_a + size_a)[in_b]] = 2 * (b + len(byte_level.tokens.sizes)) + last_b
    told = memoryview(decimal.text(order))
    ends = np.concatenate([[0], _sums(decimal.sizes[order], np.concatenate([[0], np.cumsum(count_a + count_b)])).cumsum()])
    for k, begin, end in zip(which, ends[:-1], ends[1:], strict=True):
        digests[k] = hashlib.sha256(told[begin : end - 1]).hexdigest()
    # Kinds of groups, their links, and the distinct kinds of each document.
    kept, kind = distinct_groups(a, b, in_a, in_b, n)
    ka, kb = ragged(a, first_a[kept], size_a[kept]), ragged(b, first_b[kept], size_b[kept])
    owner, pair, _ = _kind_links(ka, kb, size_a[kept], size_b[kept])
    pairs, index = np.unique(pair, return_inverse=True)
    many = np.bincount(owner, minlength=len(kept))
    starts = np.cumsum(many) - many
    key, often = np.unique(np.repeat(np.arange(len(which)), np.diff(edges)) * len(kept) + kind, return_counts=True)
    doc, kinds = key // len(kept), key % len(kept)
    per_doc = np.bincount(doc, minlength=len(which))
    bounds, weight = np.concatenate([[0], np.cumsum(per_doc)]), np.concatenate([[0], np.cumsum(many[kinds])])
    holding, at = np.zeros(len(pairs), dtype=np.int64), 0
    while at < len(which):
        to = max(at + 1, int(np.searchsorted(weight[bounds], weight[bounds[at]] + LINKS, side="right")) - 1)
        rows_ = slice(bounds[at], bounds[to])
        reach = many[kinds[rows_]]
        linked = np.unique(np.repeat(doc[rows_], reach) * len(pairs) + ragged(index, starts[kinds[rows_]], reach))
        holding += np.bincount(linked % len(pairs), minlength=len(pairs))
        at = to
    step = np.diff(kinds, prepend=0)
    step[bounds[:-1]] = kinds[bounds[:-1]]
    return out, digests, pairs, holding, _packed(which, per_doc, step, often, size_a[kept], size_b[kept], np.concatenate([ka, kb]))


def block_sums(state: bytes, rows: int, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n_best, count_sum) of the documents of a block; pairs are sorted."""
    n_best, total = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    which, per_doc, step, often, size_a, size_b, ids = _unpacked(state)
    if not len(which):
        return n_best, total
    many = int(size_a.sum())
    owner, pair, times = _kind_links(ids[:many], ids[many:], size_a, size_b)
    at = np.searchsorted(pairs, pair)
    if len(pairs) == 0 or not np.array_equal(pairs[np.minimum(at, len(pairs) - 1)], pair):
        raise ValueError("a pair of ids has no count")
    edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size_a)))])
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    # Kinds are stored as steps that start anew with each document.
    run = np.cumsum(step)
    kinds = run - np.repeat(np.concatenate([[0], run])[bounds[:-1]], per_doc)
    n_best[which] = _sums(often * _sums(times * best[at], edges)[kinds], bounds)
    total[which] = _sums(often * _sums(times * counts[at], edges)[kinds], bounds)
    return n_best, total


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(left: bytes, right: bytes, kind: pa.DataType):
    names = ["block", "doc_id", *COUNTS, "groups_sha256", "pair", "n", "state"]

    def lists(values, type_):
        return pa.array([values], pa.list_(type_))

    def run(batches):
        from pyspark import TaskContext

        byte_level, pieces = _pair(left, right)
        decimal = _decimal((len(byte_level.tokens.sizes), len(pieces.tokens.sizes)))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < BLOCK):
                    size += len(texts[stop] or "")
                    stop += 1
                out, digests, pairs, holding, state = align_block(byte_level, pieces, decimal, texts[at:stop])
                ids = pa.ListArray.from_arrays(pa.array([0, stop - at], pa.int32()), batch.column("doc_id").slice(at, stop - at).cast(kind))
                row = [pa.array([block], pa.int64()), ids, *(lists(out[c], pa.int64()) for c in COUNTS), lists(digests, pa.string()), lists(pairs, pa.int64()), lists(holding, pa.int64()), pa.array([state], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names)
                block += 1
                at = stop

    return run


def _told(kind: pa.DataType):
    def run(key, block: pa.Table, counts: pa.Table) -> pa.Table:
        row = block.slice(0, 1).combine_chunks()
        n = len(row["doc_id"][0])
        pairs = counts["pair"].to_numpy()
        order = np.argsort(pairs)
        best, total = block_sums(row["state"][0].as_py(), n, pairs[order], counts["n"].to_numpy()[order], counts["best"].to_numpy().astype(np.int64)[order])
        one = {c: row[c].combine_chunks().flatten() for c in ("doc_id", *COUNTS, "groups_sha256")}
        return pa.table({"doc_id": one["doc_id"].cast(kind), **{c: one[c] for c in COUNTS}, "n_best": pa.array(best), "count_sum": pa.array(total), "groups_sha256": one["groups_sha256"]})

    return run


def align_tokens(docs: DataFrame, left: bytes, right: bytes) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    left: a byte-level BPE file, which encodes blank + text; right: a SentencePiece file,
    which encodes text.  Cumulated token bytes of both sides are intersected, the common
    ends cut groups, and all pairs of a group's tokens are links.  Tasks take the documents
    in blocks of ``BLOCK`` characters, expand the links of distinct groups only, and count
    for each pair the documents of the block that link it.  The counts of the blocks meet
    in two stages, by pair and salt and then by pair.  They go back by block; a vocabulary's
    best counts are broadcast (a row for each id of the left file).

    Null or empty texts, and texts that either side doesn't give back byte by byte, have
    zeros and ''.  Repeated rows, null and repeated ids are documents of their own.  Only
    doc_id and text are read.  Empty table: no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema["doc_id"]
    kind = to_arrow_type(field.dataType)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("doc_id", T.ArrayType(field.dataType)), *(T.StructField(c, longs) for c in COUNTS), T.StructField("groups_sha256", T.ArrayType(T.StringType()))]
        + [T.StructField("pair", longs), T.StructField("n", longs), T.StructField("state", T.BinaryType())]
    )
    blocks = materialize(docs.select("doc_id", "text").mapInArrow(_blocks(left, right, kind), schema))
    parts = blocks.select(F.col("block").alias("within"), F.explode(F.arrays_zip("pair", "n")).alias("x")).select("within", "x.pair", "x.n")
    shares = parts.groupBy("pair", F.pmod("within", F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    totals = materialize(shares.groupBy("pair").agg(F.sum("n").alias("n")))
    first = F.shiftright("pair", 32)
    best = totals.groupBy(first.alias("a")).agg(F.max("n").alias("top"))
    ranked = totals.join(F.broadcast(best), first == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    known = parts.select("within", "pair").join(ranked.hint("shuffle_merge"), "pair")
    out = T.StructType([field, *(T.StructField(c, T.LongType()) for c in (*COUNTS, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])
    return blocks.drop("pair", "n").groupBy("block").cogroup(known.groupBy("within")).applyInArrow(_told(kind), out)


def alignment_table(docs: DataFrame, left: str = BYTE_LEVEL, right: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    """``align_tokens`` with the files at two paths."""
    with open(left, "rb") as f, open(right, "rb") as g:
        return align_tokens(docs, f.read(), g.read())
