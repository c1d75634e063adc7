"""Operators 4, 6, 7, 8 and 9 against brute force, and operator 2 on held-out labels."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from scrivano.llm import chat, mixing, pieces, quality, secrets, spots

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 3) for i, t in rows], "doc_id long, text string, spans string, rid int")


ODD = [
    (1, "token = 'abcdef' TOKEN:abcde secret:token = abcdefgh"),
    (2, "é😀 AKIA" + "Z" * 16 + " AKIA" + "Z" * 15 + " AKIA AKIA" + "0" * 40),
    (3, "deadbeef" * 3 + "g" + "0" * 23 + " api_key=\"x.y-z_1\" APIKEY : ======"),
    (4, "ghp_" + "a" * 36 + " eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF -----BEGIN RSA PRIVATE KEY-----"),
    (5, None),
    (5, ""),
    (None, "password=" + "b" * 5 + " passwd=" + "c" * 6),
    (6, "token=" * 40),
]


def expected_secrets(text):
    kinds = (("assign", r"""((?a:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    counts, spans = [], []
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        found = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
        counts.append(len(found))
        spans += found
    return (*counts, sha(",".join(s for _, _, s in sorted(spans))))


def test_secret_scan(spark):
    rows = ODD + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = secrets.secret_digest(docs(spark, rows).repartition(3)).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter((i, *expected_secrets(t)) for i, t in rows)
    # The table has a row of that id too.
    more = max((r.spans for r in got if r.doc_id == 4), key=len)
    assert {s.split(":")[0] for s in more.split(",")} == {"github", "hex", "jwt", "private"}


def test_trigram_queries_are_necessary():
    """No text with a match lacks what the query of its rule demands."""

    def holds(query, text):
        if query is None:
            return True
        if isinstance(query, str):
            return query in text
        return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])

    samples = {"assign": ["API_KEY: abcdef", "apikey=abcdef", "PassWd = 'x'", "secret=1"], "access": ["AKIA0"], "github": ["ghs_" + "a" * 36], "slack": ["xoxr-" + "1" * 10], "private": ["-----BEGIN PRIVATE KEY-----"], "google": ["AIza" + "0" * 35], "jwt": ["eyJaaaaaaaa.eyJbbbbbbbb.cccccccc"]}
    for rule in (*secrets.BASE, *secrets.MORE):
        query = secrets.trigram_query(rule.pattern)
        assert (query is None) == (rule.kind == "hex")
        for text in samples.get(rule.kind, []):
            assert re.search(rule.pattern, text) and holds(query, text.lower())


def test_the_index_is_kept_and_asked(spark, monkeypatch):
    """One index answers several questions; what it says is what the texts hold; both joins agree."""
    rows = ODD + [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    index = secrets.build_index(docs(spark, rows).repartition(3), {"tok", "oke", "ken", "the", "aki", "ghp", "zzz"})
    texts = {r.rid: r.text.lower() for r in index.rows.collect()}
    assert len(texts) == len(rows)
    said = {"all": ("and", frozenset(["tok", "ken", "the"])), "some": ("or", frozenset(["aki", ("and", frozenset(["ghp", "tok"]))])), "none": "zzz", "open": None}
    got = {r.rid: r.rules for r in secrets.ask(index, said).collect()}
    want = {}
    for rid, t in texts.items():
        bits = (all(x in t for x in ("tok", "ken", "the"))) + 2 * ("aki" in t or ("ghp" in t and "tok" in t)) + 4 * ("zzz" in t)
        if bits:
            want[rid] = bits
    assert got == want and got
    with pytest.raises(ValueError):
        secrets.ask(index, {"x": "abc"})
    told = sorted(map(str, secrets.secret_digest(docs(spark, rows)).collect()))
    monkeypatch.setattr(secrets, "CANDIDATES", 0)
    assert sorted(map(str, secrets.secret_digest(docs(spark, rows)).collect())) == told


def test_very_many_matches(spark):
    """Matches of one text by the tens of thousands take seconds, not the square of their number."""
    import time

    rows = [(1, "token=abcdef " * 60_000), (2, None)]
    began = time.time()
    got = secrets.secret_digest(docs(spark, rows)).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter((i, *expected_secrets(t)) for i, t in rows)
    assert time.time() - began < 60


@pytest.mark.parametrize("n", [0, 1, 2, 3, 15, 16, 17, 1000])
def test_running_sums(spark, n):
    sizes = [(k * 7919) % 13 for k in range(n)]
    got = spark.createDataFrame([(sizes,)], "x array<long>").select(secrets.running(F.col("x")).alias("y")).first().y
    assert got == np.cumsum(sizes).tolist()


def turns(spark):
    rng = random.Random(8)
    tricky = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky), (None, None, None, None), (3, 1, "a\nb", "\\l\\b\\h"), (3, 1, "a\nb", "\\l\\b\\h"), (4, 0, "system", None), (4, 5000, "assistant", "")]
    rows += [(9, k, "system" if k == 0 else ("user", "assistant")[k % 2], "".join(rng.choice("ab<#\\ \n") for _ in range(rng.randint(0, 300)))) for k in range(120)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")


def expected_windows(conv, said, budget, history):
    """The spans of one conversation, turn by turn."""
    sizes = [-(-len(x) // 4) + 4 for _, _, x in said]
    system = sizes[0] if said[0][1] == "system" else 0
    stride = max(budget - history - system, 1)
    at, spans = 0, []
    for size in sizes[1:] if system else sizes:
        key = (at // stride, (at + size - 1) // stride)
        if not spans or spans[-1][0] != key:
            spans.append((key, []))
        spans[-1][1].append((at, size))
        at += size
    placed = [t for _, turns in spans for t in turns]
    out = collections.Counter()
    for k, (_, turns) in enumerate(spans):
        new, begin = sum(s for _, s in turns), turns[0][0]
        room = min(history, stride, budget - system - new)
        again = [s for a, s in placed if a < begin and begin - a <= room] if k else []
        out[(conv, system + new + sum(again), len(turns) + (system > 0 and k == 0), len(again) + (system > 0 and k > 0))] += 1
    if not spans:
        out[(conv, system, 1, 0)] += 1
    return out


@pytest.mark.parametrize("budget,history", [(120, 50), (10_000, 0), (40, 30)])
def test_chat(spark, budget, history):
    rows, df = turns(spark)
    groups = collections.defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    got = {r.conv_id: r for r in chat.chat_digest(df, budget, history).collect()}
    assert set(got) == set(groups)
    for c, said in groups.items():
        said.sort()
        learnt = "".join(x for _, r, x in said if r == "assistant")
        assert got[c].n_turns == len(said)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in said))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), sha(learnt))
    windows = chat.chat_windows(df, budget, history).collect()
    assert sum(len(w.text) for w in windows if w.conv_id == 9) == got[9].formatted_chars
    long = sorted((w for w in windows if w.conv_id == 9), key=lambda w: w.window)
    assert [w.window for w in long] == list(range(len(long)))
    expected = collections.Counter()
    for c, said in groups.items():
        expected += expected_windows(c, said, budget, history)
    assert collections.Counter((w.conv_id, w.n_tokens, w.n_new, w.n_repeated) for w in windows) == expected
    assert all(w.n_tokens <= budget or w.n_new - (w.window == 0 and w.text.startswith("<turn>system\n")) <= 1 for w in windows)
    if len(long) > 1:
        assert all(w.text.startswith(chat.NEW if w.window == 0 else chat.AGAIN) and "system\n" in w.text[:30] for w in long)
        assert any(w.n_repeated > 1 for w in long) == (history > 0) or budget < 100


def test_chat_empty(spark):
    _, df = turns(spark)
    assert chat.chat_digest(df.where("false")).count() == 0


def test_pieces_parity():
    data = pieces.read_model()
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(1)
    signs = " ▁ abethingé☃\n\t<s>日本\x00😀  "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["<s> a", "a" * 1000, " " * 50, "", "▁▁"]
    encoder = pieces.Encoder(data, room=500)
    for at in range(0, len(texts), 97):
        some = texts[at : at + 97]
        ids, offsets, whole = encoder.encode(some)
        rows = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        assert rows == other.encode(some)
        back = encoder.decode(rows)
        assert back == other.decode(rows)
        assert whole.tolist() == [a == b for a, b in zip(back, some)]


def test_unigram_model():
    """A unigram model with byte fallback, written by hand."""
    import struct

    def field(n, wire, body):
        return bytes([n << 3 | wire]) + (bytes([len(body)]) + body if wire == 2 else body)

    def piece(text, score, kind=1):
        body = field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, body)

    normal = [("▁", -3.0), ("▁ab", -1.0), ("a", -4.0), ("b", -4.0), ("ab", -2.5), ("abc", -2.0), ("c", -5.0)]
    data = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3) + b"".join(piece(f"<0x{k:02X}>", 0, 6) for k in range(256)) + b"".join(piece(p, s) for p, s in normal)
    trainer = field(3, 0, b"\x01") + b"\x98\x02\x01"
    data += field(2, 2, trainer) + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    other = sentencepiece.SentencePieceProcessor(model_proto=data)
    encoder = pieces.Encoder(data)
    texts = ["ab abc", "cab ba", "é ab", "abcabc", ""]
    ids, offsets, _ = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == other.encode(texts)


def test_token_table(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x▁y"), (1, "a b")]
    got = [tuple(r) for r in pieces.sentencepiece_tokens(docs(spark, rows), pieces.read_model(), ["doc_id"]).select("doc_id", "n_tokens", "round_trip").collect()]
    assert got == [(1, 2, True), (2, None, None), (3, 0, True), (None, 2, False), (1, 2, True)]


def test_pfair(spark):
    rng = random.Random(9)
    rows = [(k, "x" * rng.randint(0, 200), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(400)] + [(None, None, "a"), (7, "dup", "b"), (7, "dup", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, slot int")
    weights = {"a": 5, "b": 3, "c": 2}
    got = mixing.pfair_mix(df.repartition(3), weights, block=100, bucket=16).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.source) for r in got) == collections.Counter((r[0], r[2]) for r in rows)
    slot = {}
    for r in got:
        assert r.release <= r.slot < r.deadline
        assert slot.setdefault((r.source, r.block), r.slot) == r.slot
    assert len(set(slot.values())) == len(slot)
    # While all sources last, every prefix is within one block of the weights.
    share = {"a": 5 / 11, "b": 3 / 11, "c": 2 / 11, None: 1 / 11}
    plan = mixing.period_slots(mixing.shares(df, weights)).collect()
    assert sorted(p.slot for p in plan) == list(range(11))
    done = collections.Counter()
    for p in sorted(plan, key=lambda p: p.slot):
        done[p.source or None] += 1
        assert all(abs(done[s] - share[s] * (p.slot + 1)) < 1 for s in share)
    assert mixing.pfair_mix(df.where("false")).count() == 0


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 1, "c": 1}, {"a": 13, "b": 7, "c": 1}])
def test_pfair_by_brute_force(spark, weights):
    """Earliest deadline first among the released turns, slot by slot."""
    import heapq

    df = spark.createDataFrame([(k, "x", s) for k, s in enumerate("abcd")], "doc_id long, text string, source string")
    share = {**weights, "d": 1}
    period = sum(share.values())
    waiting = sorted((j * period // e, -(-(j + 1) * period // e), s, j) for s, e in share.items() for j in range(e))
    ready, slots = [], {}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            release, due, s, j = waiting.pop(0)
            heapq.heappush(ready, (due, s, j, release))
        due, s, j, release = heapq.heappop(ready)
        assert release <= t < due
        slots[s, j] = (release, due, t)
    got = {(r.source, r.turn): (r.release, r.deadline, r.slot) for r in mixing.period_slots(mixing.shares(df, weights)).collect()}
    assert got == slots


@pytest.mark.parametrize("heavy", [{}, {"b3": 40, "s7": 25, "zz": 300, "a": 2}])
def test_pfair_of_many_sources(spark, heavy):
    """20,000 sources: all slots once, windows kept, every prefix within one block of each weight."""
    names = [f"s{k}" for k in range(20_000)] + ["b3", "zz", "a"]
    df = spark.createDataFrame([(k, "x", s) for k, s in enumerate(names)], "doc_id long, text string, source string")
    period = sum(heavy.get(s, 1) for s in names)
    plan = mixing.period_slots(mixing.shares(df, heavy or {"none": 1})).collect()
    assert sorted(p.slot for p in plan) == list(range(period))
    assert all(p.release <= p.slot < p.deadline and p.period == period for p in plan)
    turns = collections.defaultdict(list)
    for p in plan:
        turns[p.source].append(p.slot)
    assert {s: len(x) for s, x in turns.items()} == {s: heavy.get(s, 1) for s in names}
    for s, x in turns.items():
        share = len(x) / period
        # Just before and just after each of its slots a source is farthest from its weight.
        assert all(abs(j - share * t) < 1 and abs(j + 1 - share * (t + 1)) < 1 for j, t in enumerate(sorted(x)))


def test_pfair_joins_agree(spark, monkeypatch):
    """The turns joined by shuffles, null ids and a hot source give what the broadcast gives."""
    rows = [(None if k % 3 else k, "x" * (k % 50) + str(k), f"s{k % 40}" if k % 2 else "hot") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = sorted(map(str, mixing.pfair_mix(df, block=60, bucket=32).collect()))
    monkeypatch.setattr(mixing, "SOURCES", 3)
    assert sorted(map(str, mixing.pfair_mix(df, block=60, bucket=32).collect())) == told


def test_pfair_order_of_a_source(spark):
    df = spark.createDataFrame([(k, "x" * 10, "s") for k in range(50)], "doc_id long, text string, source string")
    got = mixing.pfair_mix(df, block=35, bucket=4).collect()
    order = sorted(range(50), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    assert {r.doc_id: r.block for r in got} == {k: n * 10 // 35 for n, k in enumerate(order)}


def test_spots(spark):
    rows = [(1, "the cat sat on a mat and the dog ran off home"), (2, "the cat sat on a mat and the dog ran off home"), (3, None), (4, ""), (5, "zq xw vy"), (6, "zq"), (7, "the the the"), (None, "le chat noir dort bien"), (8, "é😀" * 30), (8, "other words here now then")]
    got = spots.spotsigs(docs(spark, rows).coalesce(1)).collect()
    assert len(got) == len(rows)
    # One id holds two texts; their order is the operator's own.
    twins = [[r for r in rows if r[0] == 8], [r for r in rows if r[0] == 8][::-1]]
    options = []
    for pair in twins:
        order = sorted((r for r in rows if r[0] not in (8, None)), key=lambda r: -r[0])
        order = pair + order + [r for r in rows if r[0] is None]
        expected = collections.Counter()
        for n, (i, t) in enumerate(order):
            t, after = t or "", order[(n + 1) % len(order)][1] or ""
            m = len(t) // 3
            expected[(i, len(t), sha(t[: len(t) - m] + after[:m]))] += 1
        options.append(expected)
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) in options
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[1] == prints[2] and prints[3] == prints[4] == "" and prints[5] and prints[6] and prints[7]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert [r.near_next for r in got if r.doc_id == 2] == [1.0]
    assert spots.spotsigs(docs(spark, rows).where("false")).count() == 0


COMMON = {w for line in spots.ANCHORS for w in line.split()}


def murmur(data, seed=42):
    """Spark's hash of a string."""

    def mixed(h, k):
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        return (h * 5 + 0xE6546B64) & 0xFFFFFFFF

    h, n = seed, len(data) // 4 * 4
    for i in range(0, n, 4):
        h = mixed(h, int.from_bytes(data[i : i + 4], "little"))
    for b in data[n:]:
        h = mixed(h, (b - 256 if b > 127 else b) & 0xFFFFFFFF)
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def expected_spots(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    content = [(k, w) for k, w in enumerate(words) if w not in COMMON]
    chains = set()
    for c, (k, _) in enumerate(content):
        if k and words[k - 1] in COMMON and c + 3 <= len(content):
            chains.add(" ".join([words[k - 1], *(w for _, w in content[c : c + 3])]))
    if not chains and len(words) >= 3:
        chains = {" ".join(words[k : k + 3]) for k in range(len(words) - 2)}
    elif not chains and words:
        chains = {" ".join(words)}
    return sorted(h - (1 << 32) if h >= 1 << 31 else h for h in {murmur(c.encode()) for c in chains})


def likeness(a, b):
    a, b = set(a), set(b)
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_spots_by_brute_force(spark):
    """Fingerprints, edited fingerprints and likenesses of the whole smallest table."""
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    order = sorted(table, key=lambda r: -r[0])
    got = {r.doc_id: r for r in spots.spotsigs(docs(spark, table).repartition(3)).collect()}
    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1] or ""
        t = t or ""
        m = len(t) // 3
        own, edited, following = expected_spots(t), expected_spots(t[: len(t) - m] + after[:m]), expected_spots(after)
        assert got[i].fingerprint == ",".join(f"{x & 0xFFFFFFFF:08x}" for x in own), i
        assert got[i].edited_fingerprint == ",".join(f"{x & 0xFFFFFFFF:08x}" for x in edited)
        assert abs(got[i].near_edited - likeness(own, edited)) < 1e-12 and abs(got[i].near_next - likeness(own, following)) < 1e-12


def test_likeness_of_very_different_lengths(spark):
    df = spark.createDataFrame([(list(range(2)), list(range(60)))], "a array<int>, b array<int>")
    assert abs(df.select(spots.jaccard(F.col("a"), F.col("b")).alias("j")).first().j - 2 / 60) < 1e-12


@pytest.mark.parametrize("floor", [0.3, 0.5, 0.8])
def test_spot_matches(spark, floor):
    rng = random.Random(3)
    bases = [rng.sample(range(60), rng.randint(1, 25)) for _ in range(20)]
    sets = [sorted({x for x in rng.choice(bases) if rng.random() < 0.85} | set(rng.sample(range(60, 90), rng.randint(0, 3)))) for _ in range(150)] + [[], []]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, spots array<int>")
    got = {(r.id, r.other): r.likeness for r in spots.spot_matches(df, floor).collect()}
    wanted = {(i, j): likeness(sets[i], sets[j]) for i in range(150) for j in range(i + 1, 150) if sets[i] and sets[j] and likeness(sets[i], sets[j]) >= floor}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-12 for k in got)


def test_equal_rows_are_one_document(spark):
    rows = [(3, "aaa bbb ccc"), (3, "aaa bbb ccc"), (2, "ddd eee fff ggg")]
    got = spots.spotsigs(docs(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == {(3, sha("aaa bbb ddd")): 2, (2, sha("ddd eee ffaaa b")): 1}


def test_neighbours_over_stretches(spark):
    rows = spark.createDataFrame([((k * 7919) % 1009 // 3, k, k) for k in range(500)], "id long, mark long, n_chars long")
    got = {(r.id, r.mark): (r.next_id, r.next_mark) for r in spots.neighbours(rows, stretch=20).collect()}
    order = [(r.id, r.mark) for r in sorted(rows.collect(), key=lambda r: (-r.id, r.mark))]
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_quality_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(table, labels.where("pmod(hash(doc_id), 4) <> 0"))
    scores = quality.quality_scores(table, model, ["doc_id"]).join(labels.where("pmod(hash(doc_id), 4) = 0"), "doc_id").collect()
    good = [r for r in scores if r.quality == 1 and r.toxic == 0]
    poor = [r for r in scores if r.quality == 0]
    assert sum(r.keep for r in good) >= 0.95 * len(good)
    assert sum(r.quality_posterior < 0.5 for r in poor) >= 0.4 * len(poor)


def test_recall_of_each_label(spark):
    """Held-out good, poor and toxic documents."""
    d = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(table, labels.where("pmod(hash(doc_id), 4) <> 0"))
    scores = quality.quality_scores(table, model, ["doc_id"]).join(labels.where("pmod(hash(doc_id), 4) = 0"), "doc_id").collect()
    good = [r for r in scores if r.quality == 1 and r.toxic == 0]
    poor = [r for r in scores if r.quality == 0]
    toxic = [r for r in scores if r.toxic == 1]
    assert sum(r.keep for r in good) >= 0.99 * len(good)
    assert sum(r.quality_posterior < 0.5 for r in poor) >= 0.98 * len(poor)
    assert sum(r.clean_posterior < 0.5 for r in toxic) >= 0.85 * len(toxic)


def test_close_styles_are_told_apart():
    """Shares of upper case of 27 and 30 %: one bin of twelve, two of twenty-four."""
    texts = [b"A" * k + b"a" * (100 - k) for k in (27, 30)]
    ids = []
    for t in texts:
        found, edges = quality.features(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))
        ids.append({i for i in found[edges[0] : edges[1]] if quality.WORDS <= i < quality.WORDS + quality.STEPS})
    assert ids[0] != ids[1]


def test_fit_is_near_its_limit():
    """The usual rounds end within 0.0015 of the loss of 3000 rounds."""
    rng = np.random.default_rng(5)
    has = rng.random((400, 60)) < 0.2
    target = (has @ rng.normal(size=60) + rng.normal(size=400) > 0).astype(float)
    row, ids = np.nonzero(has)

    def loss(**given):
        w, bias, _ = quality.fit(ids, row, target, **given)
        score = bias + np.bincount(row, weights=w[ids], minlength=400)
        return np.mean(np.log1p(np.exp(-np.where(target > 0, score, -score)))) + 0.5e-4 * (w.astype(float) ** 2).sum()

    assert loss() - loss(rounds=3000) < 0.0015


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, None, None, None, True), (2, "some text", "s", "en", True), (2, "some text", "s", "en", True), (None, "", "s", None, True)], "doc_id long, text string, source string, lang string, keep boolean")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_classifier(df, none).collect()
    assert len(got) == 4 and all(r.keep for r in got)
    assert quality.quality_classifier(df.where("false"), none).count() == 0


def test_posteriors_by_brute_force(spark, monkeypatch):
    """Site counts, pseudo-counts and posteriors from the documents' evidence, in plain Python."""
    rng = random.Random(21)
    rows = [(k, rng.choice(["bad word", "fine word", "bad", "fine", None]), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["x", "x", "y", None])) for k in range(300)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, lang string, n int, hq double")
    labels = spark.createDataFrame([(k, int("bad" not in (t or "")), 0) for k, t, _, _ in rows[:150]], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    (w, bias, base), _ = model
    score = {}
    for k, t, _, _ in rows:
        data = np.frombuffer((t or "").encode(), dtype=np.uint8)
        ids, _ = quality.features(data, np.array([0, len(data)]))
        score[k] = float(w[ids].astype(np.float32).sum(dtype=np.float64)) + bias
    soft = {k: 1 / (1 + np.exp(-s)) for k, s in score.items()}
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for k, _, h, p in rows:
        hosts[h or ""].append(soft[k])
        paths[h or "", p or ""].append(soft[k])
    n, rate = len(rows), np.mean(list(soft.values()))
    sums = {name: sum(sum(v) ** 2 / len(v) for v in groups.values()) / n for name, groups in (("h", hosts), ("p", paths))}
    noise = rate * (1 - rate) / n
    many_h = np.clip(rate * (1 - rate) / max(sums["h"] - rate * rate - noise * (len(hosts) - 1), 1e-6) - 1, 1, 1e4)
    many_p = np.clip(rate * (1 - rate) / max(sums["p"] - sums["h"] - noise * (len(paths) - len(hosts)), 1e-6) - 1, 1, 1e4)
    for sites in (quality.SITES, 0):
        monkeypatch.setattr(quality, "SITES", sites)
        got = {r.doc_id: r for r in quality.quality_scores(df, model).collect()}
        assert len(got) == n and got[0].hq == 2.0
        for k, _, h, p in rows:
            host, site = hosts[h or ""], paths[h or "", p or ""]
            of_host = (sum(host) - soft[k] + many_h * rate) / (len(host) - 1 + many_h)
            of_path = min(max((sum(site) - soft[k] + many_p * of_host) / (len(site) - 1 + many_p), 1e-4), 1 - 1e-4)
            odds = score[k] + 0.25 * (np.log(of_path / (1 - of_path)) - np.log(rate / (1 - rate)))
            assert abs(got[k].quality_posterior - 1 / (1 + np.exp(-odds))) < 1e-5


def test_sites_shrink_to_the_prior(spark):
    """A sparse site moves its documents less than a large one with the same rate."""
    rows = [(k, "bad" if k % 2 else "fine", "big", "en") for k in range(200)] + [(900 + k, "bad", "bigbad", "en") for k in range(200)] + [(2000, "bad", "tiny", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, 0 if k % 2 else 1, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.quality_posterior for r in quality.quality_classifier(df, labels).collect()}
    assert got[900] < got[2000] < 0.5 < got[0]


def test_sample_is_bounded_in_rows(spark):
    """Thousands of rows of one id and conflicting labels: the sample has a row for each picked id."""
    from scrivano.llm import scratch

    texts = spark.createDataFrame([(1, f"text {k}") for k in range(3000)] + [(2, "b"), (3, "c"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (4, 1, None), (4, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    with scratch.temporary() as tables:
        first = quality.train(texts, labels, max_labels=3)
        sample = tables[0]
        assert sample.count() <= 3
    with scratch.temporary() as tables:
        quality.train(texts, labels, max_labels=100)
        assert sorted((r.good, r.clean) for r in tables[0].collect()) == [(False, False), (False, True), (True, True), (True, True)]
    again = quality.train(texts.repartition(7), labels.repartition(5), max_labels=3)
    assert all(np.array_equal(a[0], b[0]) and a[1:] == b[1:] for a, b in zip(first, again, strict=True))
