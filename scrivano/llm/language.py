"""Operator 13: language identification by string kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize

#: Lengths of the n-grams of the blended spectrum.
ORDERS = (1, 2, 3, 4)
#: Buckets that n-grams are hashed to.
BUCKETS = 1 << 18
#: Labelled documents that the regression is fitted on, at most, and those of one language.
MAX_LABELS, PER_LANGUAGE = 8192, 512
#: Landmarks at most, and those of one language.
MAX_LANDMARKS, LANDMARKS = 1024, 96
#: Ridge, as a share of the mean diagonal.
RIDGE = 1e-3
#: Documents scored in one product, and characters of text taken at a time, or one text.
ROWS, PART = 64, 1 << 20
UNDETERMINED = "und"
#: Blanks that keep the n-grams of neighbouring texts apart.
PAD = np.full(max(ORDERS) - 1, 32, dtype=np.uint32)


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank for all that isn't a letter."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


_TABLE: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Lower-case letters and blanks of a text, with blanks before."""
    if not _TABLE:
        _TABLE.append(_letters())
    return np.concatenate([PAD, _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]])


def buckets(letters: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram of this order at each place."""
    n = max(len(letters) - order + 1, 0)
    h = np.full(n, order, dtype=np.uint64)
    for k in range(order):
        h = h * np.uint64(0x100000001B3) + letters[k : k + n]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


class Presence:
    """Which buckets the texts of a chunk hold, a row for each text."""

    def __init__(self):
        self.rows = np.zeros((ROWS, BUCKETS), dtype=bool)

    def of(self, texts: list[np.ndarray]) -> np.ndarray:
        """Rows for the letters of at most ROWS texts; valid until the next call."""
        used = self.rows[: len(texts)]
        used[:] = False
        flat = used.reshape(-1)
        letters = np.concatenate([*texts, PAD])
        row = np.repeat(np.arange(len(texts)) * BUCKETS, [len(t) for t in texts])
        for order in ORDERS:
            at = buckets(letters, order)
            flat[at[: len(row)] + row] = True
        return used


def _chunks(texts: list[np.ndarray]):
    """Slices of at most ROWS texts and PART letters, or one text."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and stop - at < ROWS and (stop == at or size + len(texts[stop]) <= PART):
            size += len(texts[stop])
            stop += 1
        yield slice(at, stop)
        at = stop


def _spectra(batches):
    """hash, lang and the buckets of each text."""
    presence = Presence()
    for batch in batches:
        said = [codes(t) for t in batch.column("text").to_pylist()]
        for part in _chunks(said):
            found = [np.flatnonzero(r).astype(np.int32) for r in presence.of(said[part])]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)), pa.array(np.concatenate(found)))
            n = part.stop - part.start
            yield pa.RecordBatch.from_arrays([batch.column("hash").slice(part.start, n), batch.column("lang").slice(part.start, n), lists], ["hash", "lang", "buckets"])


def _matrix(spectra: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Presence in the columns, each row divided by the root of its number of n-grams."""
    out = np.zeros((len(spectra), len(columns)), dtype=np.float32)
    for k, s in enumerate(spectra):
        at = np.searchsorted(columns, s)
        at[at == len(columns)] = 0
        out[k, at[columns[at] == s]] = 1 / np.sqrt(max(len(s), 1))
    return out


def fit(spectra: list[np.ndarray], classes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights: a row a bucket, a column a class) of the one-versus-rest regressions.

    The kernel of two texts is the number of n-grams that both hold over the root of the
    product of their numbers.  Landmarks are the first texts of each class; Nystroem features
    are a text's kernels with them times K ** -1/2 of their own kernels.  A text's kernels
    are themselves products with the landmarks' rows, so that the rows and all that follows
    them fold into one matrix of weights.
    """
    each = max(1, min(LANDMARKS, MAX_LANDMARKS // n))
    marks = np.concatenate([np.flatnonzero(classes == c)[:each] for c in range(n)])
    columns = np.unique(np.concatenate([spectra[k] for k in marks]))
    rows = _matrix([spectra[k] for k in marks], columns)
    values, vectors = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    real = values > max(values.max(), 0) * 1e-7
    root = vectors[:, real] / np.sqrt(values[real])
    gram, right = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], n))
    share = np.bincount(classes, minlength=n)
    for at in range(0, len(spectra), ROWS):
        features = (_matrix(spectra[at : at + ROWS], columns) @ rows.T).astype(np.float64) @ root
        own = classes[at : at + ROWS]
        target = np.where(own[:, None] == np.arange(n), 1.0, -1.0)
        # Classes count alike, however many texts of each there are.
        weight = 1 / share[own]
        gram += features.T @ (features * weight[:, None])
        right += features.T @ (target * weight[:, None])
    gram += np.eye(len(gram)) * RIDGE * np.trace(gram) / len(gram)
    return columns, (rows.T.astype(np.float64) @ (root @ np.linalg.solve(gram, right))).astype(np.float32)


def _fitted(languages: list[str]):
    def run(batches):
        spectra, classes, order = [], [], []
        number = {name: k for k, name in enumerate(languages)}
        for batch in batches:
            spectra += [np.array(x, dtype=np.int32) for x in batch.column("buckets").to_numpy(zero_copy_only=False)]
            classes += [number[x] for x in batch.column("lang").to_pylist()]
            order += batch.column("hash").to_pylist()
        if not spectra:
            return
        # The order of the rows doesn't move the result.
        ranked = sorted(range(len(order)), key=lambda k: (order[k], classes[k], len(spectra[k]), spectra[k].tobytes()))
        columns, weights = fit([spectra[k] for k in ranked], np.array(classes)[ranked], len(languages))
        yield pa.RecordBatch.from_arrays([pa.array([columns.astype(np.int32).tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary())], ["buckets", "weights"])

    return run


def learn(docs: DataFrame, fold, max_labels: int = MAX_LABELS):
    """(languages, buckets, weights) learned from the rows of docs where ``fold`` holds.

    At most ``max_labels`` labelled rows take part, ``PER_LANGUAGE`` of one language on
    average, those of least hash; one task fits them.  The driver gets the languages and a
    number for each of at most BUCKETS buckets and language.
    """
    known = docs.where(fold & F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).select(F.col("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("hash"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros(0, dtype=np.int32), np.zeros((0, 0), dtype=np.float32)
    each = max(1, min(PER_LANGUAGE, max_labels // len(languages)))
    # A language's rows below its limit are about ``each``, twice as many for a safe margin; one row of least hash is always below.
    limits = docs.sparkSession.createDataFrame([(name, min(1.0, 2 * each / counts[name])) for name in languages], "name string, share double")
    place = F.shiftrightunsigned("hash", 1) / float(1 << 63)
    firsts = known.groupBy("lang").agg(F.min("hash").alias("first"))
    some = known.join(F.broadcast(limits), F.col("lang") == F.col("name")).join(F.broadcast(firsts.withColumnRenamed("lang", "of")), F.col("lang") == F.col("of"))
    some = some.where((place < F.col("share")) | (F.col("hash") == F.col("first")))
    # Copies of a row are one candidate, merged before the shuffle.
    some = some.dropDuplicates(["lang", "hash"]).select("hash", "lang", "text")
    spectra = materialize(some.mapInArrow(_spectra, "hash long, lang string, buckets array<int>"))
    # Of the candidates the first of each language, by a bounded sort.
    picked = spectra.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("hash", F.xxhash64("buckets")))).where(F.col("nth") <= each).drop("nth")
    model = picked.coalesce(1).mapInArrow(_fitted(languages), "buckets binary, weights binary").first()
    weights = np.frombuffer(model.weights, dtype=np.float32).reshape(-1, len(languages))
    return languages, np.frombuffer(model.buckets, dtype=np.int32), weights


def _scored(model, names):
    languages, columns, weights = model

    def run(batches):
        presence = Presence()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            said = [codes(t or "") for t in texts]
            told, score = np.full(len(said), -1), np.zeros(len(said))
            for part in _chunks(said):
                held = presence.of(said[part])
                size = np.sqrt(np.maximum(np.count_nonzero(held, axis=1), 1))
                if len(languages):
                    value = (held[:, columns].astype(np.float32) @ weights) / size[:, None]
                    told[part] = value.argmax(axis=1)
                    score[part] = np.clip((value.max(axis=1) + 1) / 2, 0, 1)
            silent = np.array([not (s != 32).any() for s in said], dtype=bool)
            told[silent], score[silent] = -1, 0
            names_ = np.array([*languages, UNDETERMINED], dtype=object)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(names_[told].tolist(), pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return run


def held_out_fold(key: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id is as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def language_id(docs: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Presence kernels of the letters' n-grams (lower case, what isn't a letter is a blank),
    hashed to BUCKETS buckets; Nystroem landmarks and one-versus-rest kernel ridge
    regression, learned from rows that aren't held out and have a lang; every whole text is
    scored by products of presence rows with the weights.  lang, source and ids aren't
    looked at when a text is scored.  score is the regression's value, mapped from -1..1 to 0..1.

    Null texts and texts without a letter are ``und`` with score 0, and so is all when
    nothing can be learned.  Ties go to the first language by name.  Repeated rows are
    scored alike; a null id isn't held out.  Empty table: no rows.  Other columns aren't read.
    """
    model = learn(docs, ~held_out_fold(), max_labels)
    field = docs.schema["doc_id"]
    schema = T.StructType([field, T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", held_out_fold().alias("held_out"), "text").mapInArrow(_scored(model, ["doc_id", "held_out"]), schema)
