"""Operator 11 against brute force: plain loops over the tokens of the libraries themselves."""

import collections
import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scrivano.llm import align

SF = "/root/testdata/sf0.001"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    left = Tokenizer.from_file(align.BYTE_LEVEL)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    alphabet = align.byte_alphabet()
    size_a = [len(left.id_to_token(k)) if k != 50256 else len("<|endoftext|>") for k in range(left.get_vocab_size())]
    bytes_a = [bytes(alphabet[c] for c in left.id_to_token(k)) if k != 50256 else b"<|endoftext|>" for k in range(left.get_vocab_size())]
    assert size_a == [len(x) for x in bytes_a]
    bytes_b = [bytes([int(right.id_to_piece(k)[3:5], 16)]) if right.is_byte(k) else right.id_to_piece(k).replace("▁", " ").encode() for k in range(right.get_piece_size())]
    return left, right, bytes_a, bytes_b


def groups(libraries, text):
    left, right, bytes_a, bytes_b = libraries
    if not text:
        return []
    a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
    said = (" " + text).encode()
    if b"".join(bytes_a[k] for k in a) != said or b"".join(bytes_b[k] for k in b) != said:
        return []
    ends = [set(np.cumsum([len(x[k]) for k in ids]).tolist()) for ids, x in ((a, bytes_a), (b, bytes_b))]
    cuts = sorted(ends[0] & ends[1])
    out = [([], []) for _ in cuts]
    for side, (ids, x) in enumerate(((a, bytes_a), (b, bytes_b))):
        at = g = 0
        for k in ids:
            at += len(x[k])
            out[g][side].append(k)
            g += at == cuts[g]
    return out


def expected(libraries, rows):
    said = [groups(libraries, t) for _, t in rows]
    count = collections.Counter()
    for g in said:
        count.update({(x, y) for a, b in g for x in a for y in b})
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), g in zip(rows, said, strict=True):
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return collections.Counter(out)


ODD = [
    (1, None),
    (2, ""),
    (3, "▁ a literal marker"),
    (4, "<|endoftext|> <s> </s> <unk> <0x41> plain"),
    (5, "日本語のテキスト　é😀 é ﬁ \x00\x01"),
    (6, "  two  blanks   and\n\n\tlines  "),
    (7, "a" * 3000),
    (8, " " * 1000),
    (8, "don't we'll I'm '' 12345678 x2y3"),
    (None, "no id"),
    (9, "no id"),
    (9, "no id"),
    (10, "    ²½Ⅷ ١٢"),
]


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, state string, pair int")


def test_brute_force(spark, libraries, monkeypatch):
    rows = ODD + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = expected(libraries, rows)
    assert rows_of(align.alignment_table(make(spark, rows).repartition(3))) == want


def test_small_blocks(spark, libraries, monkeypatch):
    """Documents are cut in many blocks, links laid out a few at a time, words forgotten."""
    rows = ODD + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()]
    want = expected(libraries, rows)
    left, right = (open(p, "rb").read() for p in (align.BYTE_LEVEL, PIECES))
    byte_level, pieces, total = align.ByteLevel(left), align.Pieces(right), collections.Counter()
    decimal = align._decimal((len(byte_level.tokens.sizes), len(pieces.tokens.sizes)))
    monkeypatch.setattr(align, "LINKS", 7)
    monkeypatch.setattr(align, "ROOM", 5)
    done = [align.align_block(byte_level, pieces, decimal, [t for _, t in rows[k : k + 4]]) for k in range(0, len(rows), 4)]
    for _, _, pairs, holding, _ in done:
        total.update(dict(zip(pairs.tolist(), holding.tolist(), strict=True)))
    best = collections.defaultdict(int)
    for p, n in total.items():
        best[p >> 32] = max(best[p >> 32], n)
    got = collections.Counter()
    for k, (counts, digests, pairs, _, state) in enumerate(done):
        some = rows[4 * k : 4 * k + 4]
        sums = align.block_sums(state, len(some), pairs, np.array([total[p] for p in pairs.tolist()], dtype=np.int64), np.array([total[p] == best[p >> 32] for p in pairs.tolist()], dtype=np.int64))
        for j, (i, _) in enumerate(some):
            got[(i, *(int(counts[c][j]) for c in align.COUNTS), int(sums[0][j]), int(sums[1][j]), digests[j])] += 1
    assert got == want


def test_very_long(spark, libraries):
    """A text of a megabyte and more, by the library's own path, and runs without a cut."""
    word = "thnterti é12 the, "
    rows = [(1, word * 80_000), (2, " " * 1_500_000), (3, "x" * 1_200_000)]
    assert rows_of(align.alignment_table(make(spark, rows))) == expected(libraries, rows)


def test_empty_table(spark):
    assert align.alignment_table(make(spark, [(1, "x")]).where("doc_id > 1")).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=4))
def test_encoders(texts):
    """The fast encoders give the ids of the libraries."""
    global _FAST
    if "_FAST" not in globals():
        left = Tokenizer.from_file(align.BYTE_LEVEL)
        left.encode_special_tokens = True
        _FAST = align.ByteLevel(open(align.BYTE_LEVEL, "rb").read()), align.Pieces(open(PIECES, "rb").read()), left, sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_level, pieces, left, right = _FAST
    assert byte_level.fast is not None
    assert [x.tolist() for x in byte_level.encode(texts)] == [e.ids for e in left.encode_batch(texts, add_special_tokens=False)]
    ids, counts = pieces.encode(texts)
    cut = np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in cut] == [right.encode(t) for t in texts]


def test_equal_names_are_compared(monkeypatch):
    """Groups of one name that differ are kinds of their own."""
    monkeypatch.setattr(align, "_named", lambda ids, label, first, seed: np.zeros(len(first), dtype=np.uint64))
    a, b = np.array([1, 2, 1, 2, 3]), np.array([5, 5, 6])
    kept, kind = align.distinct_groups(a, b, np.array([0, 0, 1, 1, 2]), np.array([0, 1, 2]), 3)
    assert kind[0] == kind[1] != kind[2] and kept[kind[2]] == 2
