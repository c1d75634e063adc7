"""Operators 1, 3, 5 and 10 against brute force, on the smallest table and awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from scrivano.llm import anchors, near
from scrivano.llm.components import components
from scrivano.llm.exact import CuckooIndex, exact_dedup
from scrivano.llm.near import minhash_near_dedup
from scrivano.llm.substring import Suffixes, Words, recompress, sorted_suffixes, substring_dedup, suffix_array_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward():
    rng = random.Random(7)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90)))) for k in range(30)]
    rows += [(100 + k, f"{rows[k][1]} {passage} {rows[k + 9][1]}") for k in range(8)]
    rows += [(200, passage), (201, passage), (202, passage + " x"), (203, "a " * 120), (204, "a " * 36), (205, "z" * 450), (206, "ab" * 150)]
    rows += [(207, None), (208, ""), (209, " \t\n"), (None, passage), (None, None), (200, passage), (200, rows[3][1]), (210, "éß " * 100)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, key string, ctx int")


def covered(units, width):
    def window(u, i):
        part = u[i : i + width]
        return hash(part) if isinstance(part, bytes) else "\n".join(part)

    seen = collections.Counter(window(u, i) for u in units for i in range(len(u) - width + 1))
    out = []
    for u in units:
        marks = [False] * len(u)
        for i in range(len(u) - width + 1):
            if seen[window(u, i)] > 1:
                marks[i : i + width] = [True] * width
        out.append(marks)
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def expected_words(rows, width=35):
    units = [WORD.findall(t or "") for _, t in rows]
    return collections.Counter((i, len(u), sum(m), sha(" ".join(w for w, k in zip(u, m) if not k).encode())) for (i, _), u, m in zip(rows, units, covered(units, width)))


def expected_bytes(rows, width=200):
    units = [(t or "").encode() for _, t in rows]
    out = collections.Counter()
    for (i, _), u, m in zip(rows, units, covered(units, width)):
        spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out[(i, len(u), sum(m), spans, sha(bytes(b for b, k in zip(u, m) if not k)))] += 1
    return out


def table(spark, which):
    if which == "awkward":
        return awkward()
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("which,hot", [("table", 1024), ("awkward", 1024), ("awkward", 1)])
def test_substring_dedup(spark, which, hot):
    rows = table(spark, which)
    got = substring_dedup(frame(spark, rows).repartition(3), hot=hot)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == expected_words(rows)


@pytest.mark.parametrize("which,hot", [("table", 1024), ("awkward", 1024), ("awkward", 1)])
def test_suffix_array_dedup(spark, which, hot):
    rows = table(spark, which)
    got = suffix_array_dedup(frame(spark, rows).repartition(3), hot=hot)
    assert collections.Counter(map(tuple, got.collect())) == expected_bytes(rows)


def test_empty(spark):
    none = frame(spark, [(1, "x")]).where("doc_id < 0")
    assert substring_dedup(none).count() == suffix_array_dedup(none).count() == minhash_near_dedup(none).count() == exact_dedup(none).count() == 0


def test_symbols_depend_on_their_region_only():
    """Wherever the words of a symbol's region stand, the symbol is there with its name."""
    rng = random.Random(2)
    unit = Words(35, 3)
    seen = {}
    for _ in range(400):
        texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60))).encode() for _ in range(3)]
        layout = unit.layout(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *(len(t) for t in texts)]))
        words = [w for t in texts for w in t.decode().split()]
        told = recompress(unit.symbols(layout), layout.offsets)
        here = collections.defaultdict(set)
        for name, a, b, low, high in zip(*(x.tolist() for x in (told.name, told.start, told.stop, told.low, told.high))):
            if low >= 0 and high <= len(words):
                assert low <= a < b <= high
                here[low, high].add((name, a - low, b - low))
        for (low, high), names in here.items():
            region = tuple(words[low:high])
            assert seen.setdefault(region, names) == names


def test_widest_symbol_of_each_window():
    rng = np.random.default_rng(5)
    offsets = np.array([0, 50, 60, 60, 140])
    low = rng.integers(0, 140, 300)
    high = np.minimum(low + rng.integers(1, 12, 300), 140)
    rank = rng.integers(0, 9, 300).astype(np.uint64)
    chosen, first, last = anchors.widest(rank, low, high, offsets, 20)
    told = {w: int(c) for c, f, l in zip(chosen, first, last) for w in range(f, l + 1)}
    for a, b in zip(offsets, offsets[1:]):
        for w in range(a, b - 19):
            inside = [(int(rank[k]), -k) for k in range(300) if low[k] >= w and high[k] <= w + 20]
            assert told.pop(w, None) == (-max(inside)[1] if inside else None)
    assert not told


def test_every_window_has_one_anchor():
    rng = np.random.default_rng(1)
    order = anchors.mix(rng.integers(0, 9, 500).astype(np.uint64))
    offsets = np.array([0, 120, 130, 500])
    anchor, first, last = anchors.elect(order, offsets, 35, 18)
    told = {w: a for a, f, l in zip(anchor, first, last) for w in range(f, l + 1)}
    wanted = [w for a, b in zip(offsets, offsets[1:]) for w in range(a, b - 34)]
    assert sorted(told) == wanted
    high = order >> np.uint64(32)
    for w, a in told.items():
        span = high[w : w + 18]
        assert a == w + int(np.argmin(span))


def test_suffix_sort():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))).encode() for _ in range(200)]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    group = np.sort(np.array([rng.randint(0, 5) for _ in texts]))
    order = Suffixes(data).sort(group, starts, ends)
    assert [(group[i], texts[i]) for i in order] == sorted((g, t) for g, t in zip(group, texts))


def weak_hashes(monkeypatch, bits):
    """All names and comparisons by a few bits: everything collides."""
    full = anchors.PrefixHash.slices
    monkeypatch.setattr(anchors.PrefixHash, "slices", lambda self, a, b: full(self, a, b) & np.uint64(bits))
    monkeypatch.setattr(anchors.PrefixHash, "windows", lambda self, w: self.slices(np.arange(max(len(self.sums) - w, 0)), np.arange(max(len(self.sums) - w, 0)) + w))


def test_collisions_are_told(monkeypatch):
    """Equal names of different windows: the bytes decide."""
    rng = random.Random(8)
    parts = [" ".join(rng.choice("pqrs") * 3 for _ in range(9)) for _ in range(12)]
    bodies = [rng.choice(parts) for _ in range(60)]
    data = np.frombuffer("".join(bodies).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *(len(b) for b in bodies)])
    key, zero = np.zeros(60, dtype=np.int64), np.zeros(60, dtype=np.int64)
    wanted = [bodies.count(b) > 1 for b in bodies]
    weak_hashes(monkeypatch, 3)
    unit = Words(9, 3)
    assert unit.resolve(key, unit.layout(data, offsets), zero, zero + 1).tolist() == wanted


def test_suffix_sort_is_checked(monkeypatch):
    """The first family of hashes collides; the next one sorts."""
    rng = random.Random(9)
    texts = sorted("".join(rng.choice("ab") for _ in range(30)) for _ in range(100))
    shuffled = rng.sample(texts, len(texts))
    data = np.frombuffer("".join(shuffled).encode(), dtype=np.uint8)
    start = np.arange(100) * 30
    plain = Suffixes.__init__

    def weak(self, data, salt=0):
        plain(self, data, salt)
        if not salt:
            self.hash.sums[:] = 0

    monkeypatch.setattr(Suffixes, "__init__", weak)
    order = sorted_suffixes(data, np.zeros(100, dtype=np.int64), start, start + 30)
    assert [shuffled[k] for k in order] == texts


def null_rows():
    """Hundreds of rows without an id: some share a passage, most share nothing."""
    rng = random.Random(13)
    passage = " ".join("p%d" % rng.randint(0, 999) for _ in range(80))
    rows = []
    for k in range(320):
        words = ["n%d" % rng.randint(0, 10**6) for _ in range(rng.randint(0, 120))]
        if k % 40 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        rows.append((None if k % 5 else 7, " ".join(words)))
    return rows


def passages():
    """One passage in many settings: few names with many contexts, halved to whole windows."""
    rng = random.Random(14)
    passage = ["p%d" % rng.randint(0, 30) for _ in range(70)]
    rows = []
    for k in range(150):
        words = list(passage)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "e%d" % rng.randint(0, 40)
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("rows,hot", [(null_rows, 8192), (passages, 8192), (passages, 20), (passages, 1)])
def test_repeats_whatever_the_ids(spark, rows, hot):
    rows = rows()
    df = frame(spark, rows).repartition(5)
    assert collections.Counter(map(tuple, substring_dedup(df, hot=hot).collect())) == expected_words(rows)
    assert collections.Counter(map(tuple, suffix_array_dedup(df, hot=hot).collect())) == expected_bytes(rows)


def test_a_text_longer_than_a_chunk(spark):
    rng = random.Random(15)
    long = " ".join("v%d" % rng.randint(0, 50_000) for _ in range(250_000))
    assert len(long) > 1.4e6
    rows = [(1, long), (2, long[400_000:400_900]), (3, "x" * 300), (4, None)]
    got = collections.Counter(map(tuple, suffix_array_dedup(frame(spark, rows)).collect()))
    assert got == expected_bytes(rows)
    assert collections.Counter(map(tuple, substring_dedup(frame(spark, rows)).collect())) == expected_words(rows)


def shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def expected_near(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return collections.Counter((d, len(s), c := least.get(find(i)), d == c) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_rows():
    rng = random.Random(11)
    base = ["t%d" % rng.randint(0, 5000) for _ in range(160)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = "e%d" % rng.randint(0, 10**6)
        rows.append((k, " ".join(words)))
    return [*rows, (70, "A b C"), (71, "a B c"), (72, "a b"), (73, None), (74, " "), (75, ""), (None, "a b c"), (76, "one"), (76, "one"), (77, "x " * 50), (78, "x " * 80)]


@pytest.mark.parametrize("which", ["table", "near"])
def test_minhash_near_dedup(spark, which):
    rows = table(spark, which) if which == "table" else near_rows()
    got = minhash_near_dedup(frame(spark, rows).repartition(3)).drop("rid")
    assert collections.Counter(map(tuple, got.collect())) == expected_near(rows)


def test_packed_estimate(spark):
    """The estimate from packed low bits is near the true similarity."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 300, dtype=np.uint64)])
    offsets = np.array([0, 900])
    low = [near.minima(np.unique(x), np.array([0, len(np.unique(x))]))[:, 0] & np.uint64(15) for x in (a, b)]
    del offsets
    packed = [[int(sum(int(v) << (4 * k) for k, v in enumerate(x[i : i + 16]))) for i in range(0, 128, 16)] for x in low]
    signed = [[v - (1 << 64) if v >= 1 << 63 else v for v in p] for p in packed]
    df = spark.createDataFrame([tuple(signed)], "a array<long>, b array<long>")
    got = df.select(near.estimated(F.col("a"), F.col("b")).alias("e")).first().e
    assert abs(got - 0.5) < 0.2


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_components(spark, held):
    rng = random.Random(6)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3), held=held).collect()}
    assert got == {n: find(n) for n in list(parent)}


def test_exact_dedup(spark):
    rows = [(5, "a b"), (2, "ab"), (9, " a  b "), (1, None), (3, ""), (4, "\t"), (None, "q"), (None, "q"), (7, "q"), (8, "é"), (8, "é"), (6, "a b")]
    got = exact_dedup(frame(spark, rows).repartition(4)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    assert len(got) == len(rows)
    by_sha = {sha(k.encode()): (len(v), min(v)[3]) for k, v in groups.items()}
    kept = collections.Counter()
    for r in got:
        assert (r.group_size, r.keep_id) == by_sha[r.text_sha256]
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_cuckoo_index():
    index = CuckooIndex(buckets=4)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for n, k in enumerate(keys):
        index.put(k, n)
    assert index.live == 3000 and index.resizes > 0
    assert all(index.get(k) == n for n, k in enumerate(keys))
    assert index.get(hashlib.sha256(b"other").digest()) is None
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert index.live == 1500 and index.get(keys[0]) is None and index.get(keys[1]) == 1
    index.put(keys[0], "again")
    assert index.get(keys[0]) == "again" and dict(index.items())[keys[0]] == "again"
