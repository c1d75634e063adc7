"""Operator 2: a quality and toxicity classifier with host and path posteriors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import PrefixHash, U, byte_symbols, mix
from .repeats import chunks
from .scratch import materialize
from .substring import word_edges

#: Hashed word features; each style measure has STEPS more.
WORDS, STEPS = 1 << 18, 24
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SIGN = ~_LETTER & ~_DIGIT
_SIGN[[9, 10, 11, 12, 13, 32, 44, 46]] = False
STYLE = 6
#: Bytes of the word beginnings that are features of their own.
PREFIXES = (4, 5)
FEATURES = WORDS + STYLE * STEPS


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and two-byte Latin letters of UTF-8."""
    out = data.copy()
    out[_UPPER[data]] += 32
    latin = np.zeros(len(data), dtype=bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[latin] += 32
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct feature numbers, offsets) by document: words and binned style measures."""
    lower = _lower(data)
    starts, stops, edges = word_edges(lower, offsets, ~_LETTER)
    names = mix(PrefixHash(byte_symbols(lower)).slices(starts, stops))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(edges))
    count = len(offsets) - 1
    ids = (names & U(WORDS - 1)).astype(np.int64)
    distinct = np.bincount(np.unique(doc * WORDS + ids) // WORDS, minlength=count)
    parts = [doc * WORDS + ids]
    for k in PREFIXES:
        longer = np.flatnonzero(stops - starts > k)
        head = mix(PrefixHash(byte_symbols(lower)).slices(starts[longer], starts[longer] + k) + U(k))
        parts.append(doc[longer] * WORDS + (head & U(WORDS - 1)).astype(np.int64))
    key = np.unique(np.concatenate(parts))
    row, ids = key // WORDS, key % WORDS

    def per_doc(mask):
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    size = np.maximum(np.diff(offsets), 1)
    words = np.diff(edges)
    letters = np.maximum(per_doc(_LETTER[data]), 1)
    measures = [
        per_doc(_UPPER[data]) / letters,
        4 * per_doc(_SIGN[data]) / size,
        4 * per_doc(_DIGIT[data]) / size,
        # Distinct words against what a text of this length usually has.
        distinct / np.maximum(words, 1) ** 0.75,
        letters / np.maximum(words, 1) / 20,
        np.log2(words + 1) / 20,
    ]
    # Every step that a measure has passed is a feature.
    steps = np.stack([np.clip((np.sqrt(np.clip(x, 0, 4)) * STEPS).astype(np.int64), 0, STEPS - 1) for x in measures], axis=1)
    style_row, kind, step = np.nonzero(np.arange(STEPS) <= steps[:, :, None])
    n = len(words)
    all_rows = np.concatenate([row, style_row])
    all_ids = np.concatenate([ids, WORDS + kind * STEPS + step])
    order = np.argsort(all_rows, kind="stable")
    return all_ids[order], np.searchsorted(all_rows[order], np.arange(n + 1))


def _featured(batches):
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column("text")):
            ids, edges = features(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, *(batch.column(c).slice(i, j - i) for c in HEADS)], ["ids", *HEADS])


def fit(ids: np.ndarray, row: np.ndarray, target: np.ndarray, rounds: int = 200, decay: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """Logistic regression on (feature, row) pairs: (weights, bias, log odds of the sample)."""
    weights = np.zeros(FEATURES, dtype=np.float32)
    n, ones = len(target), float(target.sum())
    base = float(np.log((ones + 1) / (n - ones + 1)))
    if not n or ones in (0.0, float(n)):
        return weights, base, base
    names, ids = np.unique(ids, return_inverse=True)
    w, bias = np.zeros(len(names)), base
    first, second = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights=w[ids], minlength=n), -30, 30)))
        lack = (p - target) / n
        step = np.append(np.bincount(ids, weights=lack[row], minlength=len(names)) + decay * w, lack.sum())
        first = 0.9 * first + 0.1 * step
        second = 0.99 * second + 0.01 * step * step
        move = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        w -= move[:-1]
        bias -= move[-1]
    weights[names] = w
    return weights, bias, base


def _fitted(use: dict[str, np.ndarray]):
    """The sample -> (head, feature, weight) of both heads; feature -1 is the bias, -2 the sample's log odds."""

    def run(batches):
        parts = {h: ([], [], []) for h in use}
        n = 0
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy()
            row = n + np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
            n += batch.num_rows
            for head, kept in use.items():
                told = kept[flat]
                parts[head][0].append(flat[told])
                parts[head][1].append(row[told].astype(np.int32))
                parts[head][2].append(batch.column(head).to_numpy(zero_copy_only=False).astype(float))
        if not n:
            return
        for head, (ids, row, target) in parts.items():
            weights, bias, base = fit(np.concatenate(ids), np.concatenate(row), np.concatenate(target))
            told = np.flatnonzero(weights)
            numbers = np.concatenate([[-1, -2], told]).astype(np.int32)
            values = np.concatenate([[bias, base], weights[told]]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([head] * len(numbers)), pa.array(numbers), pa.array(values)], ["head", "feature", "weight"])

    return run


HEADS = ("good", "clean")


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, sure: float = 4.0):
    """Fit both heads on at most ``max_labels`` labelled documents, those of least hashed id.

    Features are counted by class; those whose rates in the two classes differ by
    ``sure`` deviations take part.  One task fits the bounded sample; the driver
    gets the weights, FEATURES numbers a head at most.
    """
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).alias("good"), (F.coalesce("toxic", F.lit(0)) <= 0).alias("clean"))
    # At most max_labels rows of an id and two flags, each by the majority of its labels; a tie is against the document.
    voted = known.groupBy("doc_id").agg(*((2 * F.count_if(h) > F.count("*")).alias(h) for h in HEADS))
    picked = voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    # One text an id, that of least hash, so that max_labels bounds the sample's rows too.
    text = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", *HEADS).agg(text)
    sample = found.select("text", *HEADS).mapInArrow(_featured, "ids array<int>, good boolean, clean boolean")
    sample = materialize(sample)
    total = sample.agg(F.count("*").alias("n"), *(F.count_if(h).alias(h) for h in HEADS)).first()
    counts = sample.select(F.explode("ids").alias("id"), *HEADS).groupBy("id").agg(F.count("*").alias("n"), *(F.count_if(h).alias(h) for h in HEADS)).where("n >= 3")
    use = {}
    for h in HEADS:
        n, ones = total["n"], total[h]
        use[h] = np.zeros(FEATURES, dtype=bool)
        if 0 < ones < n:
            share = F.col("n") / n
            spread = F.sqrt(share * (1 - share) * (1 / ones + 1 / (n - ones)))
            z = F.col(h) / ones - (F.col("n") - F.col(h)) / (n - ones)
            use[h][[r.id for r in counts.where(F.abs(z) >= sure * spread).select("id").collect()]] = True
    model = {h: [np.zeros(FEATURES, dtype=np.float32), 0.0, 0.0] for h in HEADS}
    for r in sample.coalesce(1).mapInArrow(_fitted(use), "head string, feature int, weight double").collect():
        if r.feature >= 0:
            model[r.head][0][r.feature] = r.weight
        else:
            model[r.head][-r.feature] = r.weight
    return tuple(tuple(model[h]) for h in HEADS)


def _scored(model, names):
    heads = [(w.astype(np.float32), bias - base) for w, bias, base in model]

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                ids, edges = features(data, offsets)
                out = [pa.array(np.add.reduceat(w[ids], edges[:-1]).astype(np.float64) + rest) for w, rest in heads]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in names), *out], [*names, "quality_evidence", "clean_evidence"])

    return run


def _sigmoid(x):
    return 1 / (1 + F.exp(-x))


def _logit(p):
    return F.log(p / (1 - p))


#: Rows of the site table that are broadcast; a larger one is joined by shuffles.
SITES = 100_000


def _spread(total, x: str, level: str, below: str | None) -> float:
    """Variance of the rates between the groups of a level, inside those of the level below
    (None: the whole corpus), beyond what sampling explains: the method of moments."""
    n = total["n"]
    rate = total[x] / n
    inner = total[f"{level}{x}2"] / n
    outer, free = (rate * rate, 1) if below is None else (total[f"{below}{x}2"] / n, total[f"{below}k"])
    return max(inner - outer - rate * (1 - rate) * (total[f"{level}k"] - free) / n, 1e-6)


def quality_scores(docs: DataFrame, model, columns: list[str] | None = None, host: str = "source", path: str = "lang", strength: float = 0.25, limit: float = 0.5) -> DataFrame:
    """Add quality and clean posteriors and ``keep`` to ``columns`` of docs (all by default).

    The document's evidence is a log likelihood ratio of a linear classifier; every text
    is scored once, in a written table.  A path is (host, path column).  Soft counts of
    all documents give the global rate; hosts shrink towards it and paths towards their
    host, each level by a pseudo-count from its own spread (method of moments), so a sparse
    site stays near the global prior.  A document is left out of its own site's counts.  A
    site moves a document's log odds by ``strength`` times its difference from the
    global rate: the counts are soft and come from the same evidence, so in full they would
    count it twice.  Documents are kept if both posteriors are at least ``limit``.  Columns
    of docs with the names that are added here are replaced.
    """
    added = ("quality_evidence", "clean_evidence", "quality_posterior", "clean_posterior", "keep")
    names = [c for c in columns or docs.columns if c not in added]
    sources = list(dict.fromkeys([*names, "text", host, path]))
    mark = "_"
    while any(c.startswith(mark) for c in sources):
        mark += "_"
    picked = docs.select(*sources)
    passed = [c for c in sources if c in names or c in (host, path)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name in passed]
    scored = materialize(picked.mapInArrow(_scored(model, passed), ", ".join([*fields, "quality_evidence double", "clean_evidence double"])))
    bases = {"q": model[0][2], "c": model[1][2]}
    evidence = {"q": F.col("quality_evidence") + bases["q"], "c": F.col("clean_evidence") + bases["c"]}
    h_, p_ = mark + "host", mark + "path"
    site = {h_: F.coalesce(F.col(host).cast("string"), F.lit("")), p_: F.coalesce(F.col(path).cast("string"), F.lit(""))}
    soft = scored.select(*(c.alias(k) for k, c in site.items()), *(_sigmoid(evidence[x]).alias(x) for x in "qc"))
    paths = soft.groupBy(h_, p_).agg(F.count("*").alias("n"), F.sum("q").alias("q"), F.sum("c").alias("c"))
    hosts = paths.groupBy(h_).agg(F.sum("n").alias("hn"), F.sum("q").alias("hq"), F.sum("c").alias("hc"))
    sites = materialize(paths.join(hosts, h_))

    def squares(n, x):
        return F.sum(F.col(x) * F.col(x) / F.col(n))

    total = sites.agg(F.count("*").alias("pk"), F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in "qc"), *(squares("n", x).alias(f"p{x}2") for x in "qc")).first().asDict()
    total |= sites.select(h_, "hn", "hq", "hc").distinct().agg(F.count("*").alias("hk"), *(squares("hn", f"h{x}").alias(f"h{x}2") for x in "qc")).first().asDict()
    posterior = {}
    for x in "qc":
        rate, many = 0.5, {"h": 1.0, "p": 1.0}
        if total["n"]:
            rate = min(max(total[x] / total["n"], 1e-4), 1 - 1e-4)
            for level, below in (("h", None), ("p", "h")):
                many[level] = min(max(rate * (1 - rate) / _spread(total, x, level, below) - 1, 1.0), 1e4)
        own = _sigmoid(evidence[x])
        of_host = (F.col(f"{mark}h{x}") - own + many["h"] * rate) / (F.col(f"{mark}hn") - 1 + many["h"])
        of_path = (F.col(f"{mark}{x}") - own + many["p"] * of_host) / (F.col(f"{mark}n") - 1 + many["p"])
        moved = F.lit(strength) * (_logit(F.greatest(F.least(of_path, F.lit(1 - 1e-4)), F.lit(1e-4))) - float(np.log(rate / (1 - rate))))
        posterior[x] = _sigmoid(evidence[x] + moved)
    keys = [F.col(f"{mark}{c}").alias(f"{mark}s_{c}") for c in ("host", "path")]
    sites = sites.select(*keys, *(F.col(c).alias(mark + c) for c in ("n", "q", "c", "hn", "hq", "hc")))
    same = (F.col(h_) == F.col(f"{mark}s_host")) & (F.col(p_) == F.col(f"{mark}s_path"))
    # A site's documents may be a third of all: read from a table, the join's own shuffle can be split.
    small = total["pk"] <= SITES
    both = scored.withColumns(site).join(F.broadcast(sites) if small else sites.hint("shuffle_merge"), same)
    out = both.select(*names, posterior["q"].alias("quality_posterior"), posterior["c"].alias("clean_posterior"))
    return out.withColumn("keep", (F.col("quality_posterior") >= limit) & (F.col("clean_posterior") >= limit))


def quality_classifier(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, columns: list[str] | None = None) -> DataFrame:
    """Classify every document; see ``train`` and ``quality_scores``.

    docs: doc_id, text, source (host), lang (path).  labels: doc_id, quality, toxic.
    Null text: empty, judged by its style and site.  Null source or lang: a site
    of its own.  Null or repeated label rows: nulls are left out, the majority of an id's
    rows counts, a tie as low or toxic.  Repeated ids: the text of least hash is learned from.  No labels: no evidence, every document is kept at the even prior.
    Repeated rows are judged alike; empty table: no rows.
    """
    return quality_scores(docs, train(docs, labels, max_labels), columns)
