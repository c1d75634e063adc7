"""Operator 13: kernels against plain sets, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from scrivano.llm import language

SF = "/root/testdata/sf0.01"


def grams(text):
    out = set()
    letters = " " * 3 + "".join(c.lower() if c.isalpha() else " " for c in text) + " " * 3
    for n in language.ORDERS:
        out |= {letters[k : k + n] for k in range(len(letters) - n + 1)}
    return out


def spectra(texts):
    presence = language.Presence()
    said = [language.codes(t) for t in texts]
    return [np.flatnonzero(r).astype(np.int32) for part in language._chunks(said) for r in presence.of(said[part])]


def test_spectra():
    """Buckets are the hashed n-grams of each whole text alone, apart from collisions."""
    texts = ["Über allen Gipfeln", "", "x", "ist Ruh', in allen", "a b c " * 400, "été ça 12"] * 13
    for text, found in zip(texts, spectra(texts), strict=True):
        own = spectra([text])[0]
        assert found.tolist() == own.tolist()
        assert abs(len(grams(text)) - len(own)) <= 0.01 * len(grams(text)) + 1


def test_kernel_ridge():
    """The folded weights give the values of the plain kernel ridge regression on the landmarks."""
    words = {0: "der die und ist nicht", 1: "the and that with this", 2: "les des que pour dans"}
    rng = np.random.default_rng(5)
    texts, classes = [], []
    for k in range(60):
        texts.append(" ".join(rng.choice(words[k % 3].split(), 12)))
        classes.append(k % 3)
    found = spectra(texts)
    columns, weights = language.fit(found, np.array(classes), 3)
    sets = [set(s.tolist()) for s in found]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    # All texts are landmarks here: Nystroem features span the whole kernel.
    values, vectors = np.linalg.eigh(kernel)
    real = values > values.max() * 1e-7
    features = vectors[:, real] * np.sqrt(values[real])
    weight = np.full(60, 1 / 20)
    gram = features.T @ (features * weight[:, None])
    target = np.where(np.array(classes)[:, None] == np.arange(3), 1.0, -1.0)
    plain = features @ np.linalg.solve(gram + np.eye(len(gram)) * language.RIDGE * np.trace(gram) / len(gram), features.T @ (target * weight[:, None]))
    got = language._matrix(found, columns) @ weights
    np.testing.assert_allclose(got, plain, atol=2e-3)
    assert (got.argmax(axis=1) == classes).all()


@pytest.fixture(scope="module")
def told(spark):
    return language.language_id(spark.read.parquet(f"{SF}/documents.parquet")).collect()


def test_held_out(spark, told):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(told) == len(lang)
    for r in told:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    out = [r for r in told if r.held_out]
    for name in set(lang.values()):
        some = [r.lang_pred == name for r in out if lang[r.doc_id] == name]
        assert sum(some) >= 0.97 * len(some), name


def test_not_learned_from(spark, told):
    """Wrong languages, sources and ids of what is held out change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "CASE WHEN pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 4) = 2 THEN 'zz' ELSE lang END AS lang", "'s' AS source", "n_chars")
    got = language.language_id(other).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, told))


def make(spark, rows):
    return spark.createDataFrame([(i, t, x, "a", 1) for i, t, x in rows], "doc_id long, text string, lang string, hash string, score int")


def test_odd_rows(spark):
    base = [(k, w, x) for k in range(40) for w, x in (("der die und nicht ein", "de"), ("the and that with not", "en"))]
    odd = [(1, None, "de"), (2, "", "en"), (3, "123 !? \n", "fr"), (None, "the and that", None), (5, "und nicht " * 200_000, "de"), (5, "und nicht", "de"), (6, "the", None), (7, "日本", None)]
    got = language.language_id(make(spark, base + odd).repartition(3)).collect()
    assert len(got) == 88
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.lang_pred, r.score) for r in by[1] if r.lang_pred == "und"] == [("und", 0.0)]
    assert any(r.lang_pred == "und" for r in by[2]) and any(r.lang_pred == "und" for r in by[3])
    assert by[None][0].lang_pred == "en" and not by[None][0].held_out
    assert {r.lang_pred for r in got} == {"de", "en", "und"}
    assert sum(r.lang_pred == "de" for r in by[5]) == 3


def test_nothing_to_learn(spark):
    got = language.language_id(make(spark, [(1, "the", None), (2, None, "de")])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    assert language.language_id(make(spark, [(1, "x", "de")]).where("doc_id > 1")).collect() == []


def test_bounded_sample(spark):
    """Repeated ids and a language of nearly all rows don't lift the bound; each language is learned."""
    rows = [(3, f"the and {k}", "en") for k in range(3000)] + [(k, "der die und", "de") for k in range(3)]
    languages, columns, weights = language.learn(make(spark, rows), language.F.lit(True), max_labels=10)
    assert languages == ["de", "en"] and weights.shape == (len(columns), 2)
