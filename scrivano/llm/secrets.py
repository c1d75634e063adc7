"""Operator 4: secret scans with a trigram index.  DataFrame functions only."""

from __future__ import annotations

import re._parser as sre
from re._constants import BRANCH, IN, LITERAL, MAX_REPEAT, MIN_REPEAT, SUBPATTERN
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


class Rule(NamedTuple):
    """A kind of secret.  A match counts if its group has ``least`` characters or more.

    ``scan`` finds the same counted matches with less work: where a match is a
    maximal run, short runs need no match of their own.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    scan: str = ""


# The base rules, in the order in which their spans are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)
# Published token shapes that the index adds.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


# -- Boolean trigram queries ---------------------------------------------------
# A query is None (nothing is mandatory), a trigram, or ("and" | "or", frozenset of queries).
_MOST = 16


def _all(parts) -> object:
    kept = frozenset(p for p in parts if p is not None)
    return None if not kept else next(iter(kept)) if len(kept) == 1 else ("and", kept)


def _any(parts) -> object:
    parts = list(parts)
    if any(p is None for p in parts):
        return None
    kept = frozenset(parts)
    return next(iter(kept)) if len(kept) == 1 else ("or", kept)


def _texts(items) -> list[list[str] | object]:
    """A pattern as a row of sets of exact strings and, where it is open, queries."""
    row: list = []
    for op, arg in items:
        if op is LITERAL:
            row.append([chr(arg)])
        elif op is IN and all(o is LITERAL for o, _ in arg) and len(arg) <= _MOST:
            row.append([chr(a) for _, a in arg])
        elif op is SUBPATTERN:
            row += _texts(arg[3])
        elif op is BRANCH:
            ways = [_texts(branch) for branch in arg[1]]
            exact = [_exact(way) for way in ways]
            row.append([s for e in exact for s in e] if all(e is not None for e in exact) and sum(map(len, exact)) <= _MOST else ("query", _any(_query(way) for way in ways)))
        elif op in (MAX_REPEAT, MIN_REPEAT):
            low, high, inner = arg
            inside = _texts(inner)
            exact = _exact(inside)
            if exact is not None and high <= 1 and len(exact) < _MOST:
                row.append(["", *exact] if low == 0 else exact)
            elif low == 0:
                row.append(("query", None))
            else:
                row += inside
                if high > 1:
                    row.append(("query", None))
        else:
            row.append(("query", None))
    return row


def _exact(row) -> list[str] | None:
    """The finite set of strings of a row, if it is one."""
    out = [""]
    for part in row:
        if isinstance(part, tuple) or len(out) * len(part) > _MOST:
            return None
        out = [a + b for a in out for b in part]
    return out


def _spread(n: int) -> list[int]:
    """Places of the trigrams that are asked for in a string that has n: its ends and its middle."""
    return sorted({0, n // 2, n - 1}) if n > 0 else []


def _query(row) -> object:
    """The mandatory trigrams of a row of parts."""
    needs, run = [], [""]

    def close():
        needs.append(_any(_all(s[i : i + 3].lower() for i in _spread(len(s) - 2)) for s in run))

    for part in row:
        if isinstance(part, tuple):
            close()
            needs.append(part[1])
            run = [""]
        elif len(run) * len(part) <= _MOST:
            run = [a + b for a in run for b in part]
        else:
            close()
            run = list(part) if len(part) <= _MOST else [""]
    close()
    return _all(needs)


def trigram_query(pattern: str) -> object:
    """The Boolean query on lower-case trigrams that every text with a match satisfies."""
    return _query(_texts(sre.parse(pattern)))


def trigrams(query) -> set[str]:
    if query is None:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*(trigrams(q) for q in query[1]))


def _holds(query, bit: dict[str, Column]) -> Column:
    if isinstance(query, str):
        return bit[query]
    parts = [_holds(q, bit) for q in sorted(query[1], key=str)]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


# -- the index -----------------------------------------------------------------
class Index(NamedTuple):
    """A kept inverted index: the texts by number, and the postings of the trigrams it knows.

    rows: rid, doc_id, text.  postings: trigram, rid, sorted by trigram in each file, so that
    a question reads the row groups of its trigrams.
    """

    rows: DataFrame
    postings: DataFrame
    wanted: tuple[str, ...]


def build_index(docs: DataFrame, wanted) -> Index:
    """Number the rows of docs and write them and the postings of the wanted trigrams, lower-cased.

    Postings stay in the tasks that read their texts: a trigram that most texts hold is
    spread like them.  Null text: empty, without postings.
    """
    wanted = tuple(sorted(wanted))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")))
    low = F.lower("text")
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted))) if wanted else F.array().cast("array<string>")
    found = rows.select("rid", low.alias("low")).select("rid", F.explode(held).alias("trigram"))
    return Index(rows, materialize(found.select("trigram", "rid").sortWithinPartitions("trigram", "rid")), wanted)


#: Trigrams to a word of bits.
_BITS = 62


def ask(index: Index, queries: dict[str, object]) -> DataFrame:
    """(rid, rules): for each text that satisfies a query or more, their bits in the order of queries.

    The postings of the queries' trigrams are read, and only those; they meet by text, each as
    a bit, and the Boolean queries are decided on the bits.  A query of None fits no posting and
    has to be asked of all texts otherwise.
    """
    asked = sorted(set().union(*(trigrams(q) for q in queries.values())))
    if not set(asked) <= set(index.wanted):
        raise ValueError("the index doesn't know all trigrams of the queries")
    if not asked:
        return index.rows.where("false").select("rid", F.lit(0).cast("long").alias("rules"))
    numbers = F.create_map(*(F.lit(x) for n, t in enumerate(asked) for x in (t, n)))
    some = index.postings.where(F.col("trigram").isin(*asked)).select("rid", numbers[F.col("trigram")].alias("n"))
    words = [F.bit_or(F.when(F.floor(F.col("n") / _BITS) == w, F.pow(F.lit(2.0), F.col("n") % _BITS).cast("long")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(-(-len(asked) // _BITS))]
    met = some.groupBy("rid").agg(*words)
    bit = {t: F.col(f"w{n // _BITS}").bitwiseAND(F.lit(1 << n % _BITS).cast("long")) != 0 for n, t in enumerate(asked)}
    rules = sum((F.when(_holds(q, bit), F.lit(1 << k)).otherwise(F.lit(0)) for k, q in enumerate(queries.values()) if q is not None), F.lit(0))
    return met.select("rid", rules.cast("long").alias("rules")).where("rules <> 0")


#: Candidates whose numbers are broadcast; more are joined by shuffles, with the same result.
CANDIDATES = 1_000_000


# -- verification --------------------------------------------------------------
def running(sizes: Column) -> Column:
    """Inclusive prefix sums of an array of longs, in blocks of about the root of its length."""
    zero, side = F.lit(0).cast("long"), F.greatest(F.ceil(F.sqrt(F.size(sizes))), F.lit(1)).cast("int")

    def total(part):
        return F.aggregate(part, zero, lambda a, v: a + v)

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / side).cast("int")), lambda k: F.slice(sizes, k * side + 1, side))
    inner = F.transform(blocks, lambda b: F.transform(b, lambda v, i: total(F.slice(b, F.lit(1), i + 1))))

    def based(rows):
        def one(row, k):
            base = total(F.transform(F.slice(rows, F.lit(1), k), lambda r: F.coalesce(F.get(r, F.size(r) - 1), zero)))
            # Arrays of one, so that inner and base are computed once.
            return F.get(F.transform(F.array(base), lambda x: F.transform(row, lambda v: v + x)), F.lit(0))

        return F.flatten(F.transform(rows, one))

    return F.get(F.transform(F.array(inner), based), F.lit(0))


def with_matches(rows: DataFrame, rule: Rule, out: str, wanted: Column | None) -> DataFrame:
    """Add a rule's matches to rows with a text: array<struct<start, stop>>, leftmost and not
    overlapping, in code points.  Texts that are not wanted have none.

    The steps are columns of their own, so none is computed again for every match.
    """
    pattern = rule.scan or rule.pattern
    w_, g_, s_, e_ = (f"{out}_{x}" for x in ("whole", "group", "gaps", "ends"))
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    step = rows.withColumn(w_, whole if wanted is None else F.when(wanted, whole).otherwise(F.array().cast("array<string>")))
    some = F.size(w_) > 0
    # Lengths of the pieces before each match; the pieces and matches in a row are the text.
    step = step.withColumn(s_, F.when(some, F.zip_with(F.slice(F.split("text", pattern, -1), F.lit(1), F.size(w_)), w_, lambda p, m: (F.length(p) + F.length(m)).cast("long"))).otherwise(F.array().cast("array<long>")))
    step = step.withColumn(e_, running(F.col(s_)))
    step = step.withColumn(g_, F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.group))).otherwise(F.col(w_)) if rule.group else F.col(w_))
    long = F.transform(w_, lambda m, i: F.when(F.length(F.get(F.col(g_), i)) >= rule.least, F.struct((F.get(F.col(e_), i) - F.length(m)).cast("int").alias("start"), F.get(F.col(e_), i).cast("int").alias("stop"))))
    return step.withColumn(out, F.filter(long, lambda m: m.isNotNull())).drop(w_, g_, s_, e_)


def _ranked(found: Column, rank: int, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))


def secret_scan(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Find secrets in whole texts.

    docs: doc_id, text and any other columns (ignored).  Returns doc_id, spans
    (array of rank, kind, start, stop; by start, then rule), n_assign, n_access,
    n_hex.  Positions are code points, the end exclusive; each rule's matches are
    the leftmost ones that don't overlap, and those too short are dropped.

    A Boolean query on trigrams is derived from each pattern (``trigram_query``) and asked
    of the inverted index (``build_index``, ``ask``).  Only candidates meet the pattern; a rule
    without mandatory trigrams (hex) scans every text.  Lower-cased trigrams only widen the set.

    Null text: empty, no spans.  Null or repeated doc_id: each row has its own
    result.  Empty table: no rows.  The spans of one document are kept in one array; a
    text with m matches takes time in proportion to its length and m ** 1.5.
    """
    known = {r.kind: (rank, r, trigram_query(r.pattern)) for rank, r in enumerate((*BASE, *more))}
    queries = {k: q for k, (_, _, q) in known.items() if q is not None}
    index = build_index(docs, set().union(*(trigrams(q) for q in queries.values())))
    asked = materialize(ask(index, queries))
    few = asked.count() <= CANDIDATES
    picked = index.rows.join(F.broadcast(asked) if few else asked.hint("shuffle_merge"), "rid").select("rid", "text", "rules")

    def spans_of(rows: DataFrame, kinds: list[str]) -> DataFrame:
        for kind in kinds:
            rank, rule, query = known[kind]
            wanted = None if query is None else F.col("rules").bitwiseAND(F.lit(1 << list(queries).index(kind)).cast("long")) != 0
            rows = with_matches(rows, rule, f"m{rank}", wanted)
        found = F.concat(*(_ranked(F.col(f"m{known[k][0]}"), known[k][0], k) for k in kinds))
        # Texts without matches stay: a filter would be pushed down, and all steps be computed again in it.
        return rows.select("rid", found.alias("found"))

    parts = [spans_of(picked, list(queries)), spans_of(index.rows.select("rid", "text"), [k for k in known if k not in queries])] if len(queries) < len(known) else [spans_of(picked, list(queries))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # One row a text and way of search: their spans, in order.
    joined = every.groupBy("rid").agg(F.flatten(F.collect_list("found")).alias("found"))
    spans = F.array_sort("found", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    out = index.rows.select("rid", "doc_id").join(joined.select("rid", spans.alias("spans")), "rid", "left")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<rank: int, kind: string, start: int, stop: int>>")))
    return out.select("doc_id", *(F.size(F.filter("spans", _is(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)), "spans")


def _is(rank: int):
    return lambda s: s["rank"] == rank


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text, for each document."""
    table = secret_scan(docs)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return table.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
