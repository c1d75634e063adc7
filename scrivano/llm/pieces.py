"""Operator 7: SentencePiece encoding and decoding on the tokenizers library."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The word marker of SentencePiece models.
MARK = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters of text encoded at a time, or one text.
PART = 1 << 20
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} in a model file")
        yield tag >> 3, value


class Model:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode("utf-8"), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        #: 1 unigram, 2 BPE.
        self.kind = trainer.get(3, 1)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.escape = bool(normalizer.get(5, 1))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        if self.kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        if not self.escape:
            raise ValueError("models that keep blanks unmarked are not supported")


def _merges(model: Model) -> list[tuple[str, str]]:
    """Merges of a BPE model: every split of a piece in two pieces, best score first.

    Among equal scores (the runs of markers) the library must grow the leftmost
    run first, as the model's own merging does: longer left parts go first.
    """
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
    found = []
    for piece, s in score.items():
        for k in range(1, len(piece)):
            left, right = piece[:k], piece[k:]
            if left in score and right in score:
                found.append((-s, -len(left), len(right), left, right))
    found.sort()
    return [(left, right) for *_, left, right in found]


def build(data: bytes):
    """(tokenizers.Tokenizer with the model's results on normalised words, model)."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    model = Model(data)
    if model.kind == 1:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, _merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps: list = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    undo: list = [decoders.Replace(MARK, " ")]
    if model.byte_fallback:
        undo.append(decoders.ByteFallback())
    undo.append(decoders.Fuse())
    tokenizer.decoder = decoders.Sequence(undo)
    return tokenizer, model


class Encoder:
    """Encodes batches of texts, each distinct word once.

    If no piece reaches across the start of a word marker, a text's tokens are
    those of its marked words in a row, so words are cut first and the new ones
    of a batch go to the library's threads together.  At most ``room`` words are
    remembered; then the memory starts afresh.
    """

    def __init__(self, data: bytes, room: int = 300_000):
        self.tokenizer, self.model = build(data)
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _, _ in self.model.pieces)
        self.room = room
        self.forget()

    def forget(self):
        self.index: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.begin, self.size, self.intact = [], [], []
        self.filled = 0

    def words(self, text: str) -> list[str]:
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if not text:
            return []
        text = text.replace(" ", MARK)
        if self.model.dummy_prefix:
            text = MARK + text
        return _WORD.findall(text) if self.by_word else [text]

    def learn(self, words: list[str]):
        found = self._plain.encode_batch_fast(words, add_special_tokens=False)
        rows = [e.ids for e in found]
        back = self.tokenizer.decode_batch(rows, skip_special_tokens=False)
        total = sum(map(len, rows))
        if self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), total), dtype=np.int32)])
        for word, ids, text in zip(words, rows, back, strict=True):
            self.index[word] = len(self.begin)
            self.pool[self.filled : self.filled + len(ids)] = ids
            self.begin.append(self.filled)
            self.size.append(len(ids))
            # Whether decoding gives back what was cut from the text.
            self.intact.append(text == word.replace(MARK, " "))
            self.filled += len(ids)

    @property
    def _plain(self):
        # Words are normalised already.
        if not hasattr(self, "_bare"):
            from tokenizers import Tokenizer

            self._bare = Tokenizer(self.tokenizer.model)
        return self._bare

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets by text, whether decoding restores the text)."""
        rows = [self.words(t) for t in texts]
        fresh = {w for row in rows for w in row if w not in self.index}
        if len(self.index) + len(fresh) > self.room:
            self.forget()
            fresh = {w for row in rows for w in row}
        if fresh:
            self.learn(list(fresh))
        index = self.index
        flat = np.fromiter((index[w] for row in rows for w in row), dtype=np.int64)
        edges = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        begin, size = np.asarray(self.begin, dtype=np.int64)[flat], np.asarray(self.size, dtype=np.int64)[flat]
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, size)
        bad = np.concatenate([[0], np.cumsum(~np.asarray(self.intact, dtype=bool)[flat])])
        whole = bad[edges[1:]] == bad[edges[:-1]]
        lossy = self.tokenizer.normalizer is not None
        for k, t in enumerate(texts):
            if lossy or MARK in t:
                whole[k] = self.decode([self.pool[at[ends[edges[k]] : ends[edges[k + 1]]]].tolist()])[0] == t
        return self.pool[at], ends[edges], whole

    def decode(self, rows: list[list[int]]) -> list[str]:
        """Texts of token ids."""
        out = self.tokenizer.decode_batch(rows, skip_special_tokens=False)
        return [t[1:] if t[:1] == " " else t for t in out] if self.model.dummy_prefix else out


_BUILT: dict = {}


def encoder(data: bytes) -> Encoder:
    """One encoder is kept in a Python worker."""
    key = hash(data)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Encoder(data)
    return _BUILT[key]


#: Threads of a Python worker that encode the new words of a batch.
THREADS = 2


def sentencepiece_tokens(docs: DataFrame, model: bytes, columns: list[str] | None = None, threads: int = THREADS) -> DataFrame:
    """Add token_ids, n_tokens and round_trip (decoding gives the text back) to ``columns`` of docs.

    The model's protobuf is parsed here and rebuilt for the tokenizers library:
    normaliser, word marker, unigram scores or BPE merges, byte fallback.
    New words of a batch are encoded on ``threads`` threads of each Python worker.

    Null text: null ids, count and round_trip.  Empty text: no ids, true.  A
    literal word marker in a text decodes to a blank, so round_trip is false.
    Repeated rows are encoded alike.  Empty table: no rows.
    Columns of docs with the added names are replaced.
    """
    names = [c for c in columns or docs.columns if c not in ("token_ids", "n_tokens", "round_trip")]
    picked = docs.select(*dict.fromkeys([*names, "text"]))
    keep = [f for f in picked.schema if f.name in names]
    schema = T.StructType([*keep, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        encode = encoder(model).encode
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < PART):
                    size += len(texts[stop] or "")
                    stop += 1
                some = texts[at:stop]
                known = np.array([t is not None for t in some])
                ids, offsets, whole = encode([t or "" for t in some])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=pa.array(~known))
                counts = pa.array(np.diff(offsets), pa.int64(), mask=~known)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(at, stop - at) for f in keep), lists, counts, pa.array(whole, pa.bool_(), mask=~known)], [*(f.name for f in keep), "token_ids", "n_tokens", "round_trip"])
                at = stop

    return picked.mapInArrow(run, schema)


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_table(docs: DataFrame, path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_tokens, round_trip and token_ids of every document."""
    return sentencepiece_tokens(docs, read_model(path), ["doc_id"]).select("doc_id", "n_tokens", "round_trip", "token_ids")
