"""Rules as rows: ordered rewriting with counts and candidates, and linting by many words at once."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rx import let, sub
from .pieces import pieces

#: The table of rules: what is done in the order of ord; candidates are only reported.
SCHEMA = "ord int, kind string, pattern string, replacement string, note string"
_FILE = "safe_regex array<struct<pattern: string, replace: string, desc: string>>, literal array<struct<`from`: string, `to`: string, desc: string>>, candidate_regex array<struct<pattern: string, desc: string>>"
#: Words of a lint table that go to the tasks.
MOST_WORDS = 1_000_000
#: Rows of candidates that a task's Python gathers; a text's places by one rule stay together.
ROWS = 10_000


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a JSON file, patterns first, then literals, then candidates; a missing file has none.

    Group numbers of replacements are written with a backslash in the file.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], SCHEMA)
    told = spark.read.text(path, wholetext=True).select(F.from_json("value", _FILE).alias("r"))
    plain = sub(sub(F.col("x.replace"), r"\$", r"\\\$"), r"\\(\d)", r"\$$1")
    kinds = {
        "safe_regex": ("regex", F.col("x.pattern"), plain),
        "literal": ("literal", F.col("x.from"), F.col("x.to")),
        "candidate_regex": ("candidate", F.col("x.pattern"), F.lit(None).cast("string")),
    }
    rows = None
    for k, (name, (kind, pattern, replacement)) in enumerate(kinds.items()):
        own = told.select(F.posexplode(f"r.{name}").alias("pos", "x")).select((F.col("pos") + k * 1_000_000).alias("ord"), F.lit(kind).alias("kind"), pattern.alias("pattern"), replacement.alias("replacement"), F.coalesce(F.col("x.desc"), F.lit("")).alias("note"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def _packed(rules: DataFrame) -> Column:
    """All rules in their order as one value; a rule without a pattern does nothing."""
    some = rules.where("pattern IS NOT NULL AND pattern <> ''").select(F.struct("ord", "kind", "pattern", F.coalesce("replacement", F.lit("")).alias("replacement"), F.coalesce("note", F.lit("")).alias("note")).alias("r"))
    return some.agg(F.array_sort(F.collect_list("r"))).scalar()


def rewritten(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text", counted: bool = True) -> DataFrame:
    """(key, text, log): the rules folded over each text; log has ord, note and n, the matches each rule met.

    The rules are data, read with the query: another table gives other results by the same plan.
    A null text stays null.  Without ``counted`` matches are not counted and there is no log.
    """
    start = F.struct(F.col("_text").alias("t"), F.array().cast("array<struct<ord: int, note: string, n: bigint>>").alias("log"))

    def changed(t, r):
        literal = r["kind"] == "literal"
        return F.when(literal, F.replace(t, r["pattern"], r["replacement"])).otherwise(F.regexp_replace(t, F.when(literal, F.lit("x")).otherwise(r["pattern"]), F.when(literal, F.lit("x")).otherwise(r["replacement"])))

    def step(acc, r):
        literal = r["kind"] == "literal"
        many = F.floor((F.length(acc["t"]) - F.length(F.replace(acc["t"], r["pattern"], F.lit("")))) / F.length(r["pattern"])).cast("long")
        count = F.when(literal, many).otherwise(F.regexp_count(acc["t"], F.when(literal, F.lit("x")).otherwise(r["pattern"])).cast("long"))

        def told(n):
            # A text without matches is not searched again.
            new = F.when(n > 0, changed(acc["t"], r)).otherwise(acc["t"])
            return F.struct(new.alias("t"), F.concat(acc["log"], F.array(F.struct(r["ord"].alias("ord"), r["note"].alias("note"), n.alias("n")))).alias("log"))

        return let(count, told)

    own = docs.select(F.col(key), F.col(text).alias("_text"), _packed(rules).alias("_rules"))
    done = F.filter(F.coalesce("_rules", F.array()), lambda r: r["kind"] != "candidate")
    if not counted:
        return own.select(key, F.aggregate(done, F.col("_text"), changed).alias("text"))
    return own.select(key, F.aggregate(done, start, step).alias("d")).select(key, F.col("d.t").alias("text"), F.col("d.log").alias("log"))


def audit(done: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, note, n): the rules of ``rewritten`` that changed a text."""
    # Spark would test the size of what is exploded first, and fold the rules over each text once more for each test.
    return done.select(key, F.explode_outer("log").alias("x")).select(key, "x.ord", "x.note", "x.n").where("n > 0")


def candidates(done: DataFrame, rules: DataFrame, key: str = "doc_id", width: int = 12) -> DataFrame:
    """(key, ord, note, start, context): what the candidate rules find in the rewritten texts, with ``width`` characters around, on one line.

    A match's place is the length of all gaps and matches before it.  A text is searched where
    it is; contexts are cut from the whole text by place.
    """
    schema = T.StructType([done.schema[key], *T.StructType.fromDDL("ord int, note string, start long, context string").fields])

    def found(r):
        gaps, sizes = (F.transform(x, lambda y: F.length(y)) for x in (F.split("text", r["pattern"], -1), F.regexp_extract_all("text", r["pattern"], F.lit(0))))
        return F.struct(r["ord"].alias("ord"), r["note"].alias("note"), gaps.alias("gaps"), sizes.alias("sizes"))

    def run(batches):
        for batch in pieces(batches):

            def packed(rows, keys=batch.column(0)):
                at, *told = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.string())
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(told, kinds, strict=True))], schema.names)

            rows = []
            for at, text in enumerate(batch.column(1).to_pylist()):
                for r in batch.column(2)[at].as_py() if text is not None else ():
                    start = 0
                    for gap, size in zip(r["gaps"], r["sizes"], strict=False):
                        start += gap + size
                        if size:
                            rows.append((at, r["ord"], r["note"], start - size, text[max(start - size - width, 0) : start + width].replace("\n", " ")))
                    if len(rows) >= ROWS:
                        yield packed(rows)
                        rows = []
            if rows:
                yield packed(rows)

    asked = done.select(key, "text", F.coalesce(_packed(rules.where("kind = 'candidate'")), F.array()).alias("_rules"))
    return asked.select(key, "text", F.transform("_rules", found).alias("_found")).mapInArrow(run, schema)


def _words(rules: DataFrame) -> list[tuple[str, str, str, str]]:
    rows = rules.where("wrong IS NOT NULL AND wrong <> ''").select("rule", "wrong", "fix", "message").distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a lint table has at most {MOST_WORDS} words")
    return sorted((r.rule or "", r.wrong, r.fix or "", r.message or "") for r in rows)


def _finder(words):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    by_word: dict[str, list[int]] = {}
    for n, (_, wrong, _, _) in enumerate(words):
        by_word.setdefault(wrong, []).append(n)
    for wrong, numbers in by_word.items():
        automaton.add_word(wrong, (len(wrong), numbers))
    if by_word:
        automaton.make_automaton()

    def find(text: str) -> list[tuple[int, int, int, bool]]:
        """(start, end, number of the rule, whether its fix is taken), by start, longest first."""
        reach: dict[int, int] = {}
        found = []
        for last, (size, numbers) in automaton.iter(text) if by_word else ():
            start = last + 1 - size
            for n in numbers:
                # Places of one word don't overlap.
                if start >= reach.get(n, 0):
                    reach[n] = last + 1
                    found.append((start, last + 1, n))
        out, free = [], 0
        for start, end, n in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
            taken = start >= free
            free = end if taken else free
            out.append((start, end, n, taken))
        return out

    return find


_FOUND = "line int, col int, start int, rule string, message string, wrong string, fix string, taken boolean"


def lint(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, col, start, rule, message, wrong, fix, taken) of each place where a rule's word stands.

    rules: rule, wrong, fix, message.  All words are looked for in one pass by an automaton
    that each worker builds once.  Places of one word don't overlap; of overlapping places
    the leftmost, then the longest, then the first rule by name is taken for fixing.  line and
    col count from 1, start from 0, in code points.  A null text has no places.
    """
    words = _words(rules)
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(_FOUND).fields])

    def run(batches):
        find = _finder(words)
        for batch in pieces(batches):
            rows = []
            for at, t in enumerate(batch.column(1).to_pylist()):
                breaks = [k for k, c in enumerate(t or "") if c == "\n"]
                for start, _, n, taken in find(t or ""):
                    line = bisect.bisect_left(breaks, start)
                    rule, wrong, fix, message = words[n]
                    rows.append((at, line + 1, start - (breaks[line - 1] if line else -1), start, rule, message, wrong, fix, taken))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            told = [pa.array(c, pa.int32() if k < 3 else pa.bool_() if k == 7 else pa.string()) for k, c in enumerate(columns[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *told], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def fixed(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n): each text with the fixes that ``lint`` takes, and their number; a null text stays null."""
    words = _words(rules)
    schema = T.StructType([docs.schema[key], T.StructField("text", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        find = _finder(words)
        for batch in pieces(batches):
            texts, counts = [], []
            for t in batch.column(1).to_pylist():
                parts, at, n = [], 0, 0
                for start, end, k, taken in find(t or ""):
                    if taken:
                        parts += [t[at:start], words[k][2]]
                        at, n = end, n + 1
                texts.append(None if t is None else "".join([*parts, t[at:]]))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)
