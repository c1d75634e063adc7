"""The pipeline, stage by stage, each against brute force on its own input."""

import collections
import hashlib
import re

import pytest
import sentencepiece

import corpus_pipeline
from scrivano.llm import mixing, pieces, quality
from tests.llm.test_dedup import expected_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """The input of each stage and the result, as collected rows and as DataFrames."""
    from scrivano.llm.scratch import materialize

    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def test_columns(tables):
    for df in tables[1:5]:
        assert df.columns == tables[0].columns
    assert {"doc_id", "token_ids", "n_tokens", "round_trip"} <= set(tables[5].columns)


def test_quality(spark, tables):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.quality_classifier(tables[0], labels, columns=["doc_id"]).where("keep").collect()}
    assert rows(tables[1]) == collections.Counter({r: n for r, n in rows(tables[0]).items() if r[0] in kept})
    good = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    assert len(good & kept) >= 0.95 * len(good)


def test_exact(tables):
    best = {}
    for r in tables[1].collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        rank = (-len(r.text), r.doc_id)
        best[key] = min(best.get(key, rank), rank)
    assert {r.doc_id for r in tables[2].collect()} == {i for _, i in best.values()}


def test_near(tables):
    before = [(r.doc_id, r.text) for r in tables[2].collect()]
    kept = {d for (d, _, _, k) in expected_near(before) if k}
    assert {r.doc_id for r in tables[3].collect()} == kept


def test_mix(tables):
    assert rows(tables[4]) == rows(tables[3])
    slot = {r.doc_id: r.slot for r in mixing.pfair_mix(tables[3]).collect()}
    files = tables[4].selectExpr("doc_id", "_metadata.file_path AS f", "_metadata.row_index AS k").collect()
    order = [slot[r.doc_id] for r in sorted(files, key=lambda r: (r.f, r.k))]
    assert order == sorted(order)


def test_tokens(tables):
    model = sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())
    text = {r.doc_id: r.text for r in tables[4].collect()}
    got = tables[5].collect()
    assert len(got) == len(text)
    assert all(list(r.token_ids) == model.encode(text[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.round_trip for r in got)


def test_run(spark, tables):
    def digest(df):
        return sorted(hashlib.sha256(repr(tuple(r)).encode()).hexdigest() for r in df.collect())

    assert digest(corpus_pipeline.run(spark, SF)) == digest(tables[5])


#: Nulls in every column, empty and blank texts, repeated rows and ids, a text above a megabyte.
ODD = [
    (1, None, "en", "src1", None), (2, "", "de", None, 0), (None, "some words that no other text has at all", None, "src1", 5), (3, " \n\t ", "fr", "src2", 4), (4, "a b c d e f g h", "en", "src1", 15), (4, "a b c d e f g h", "en", "src1", 15),
    (4, "another text under one id and source", "en", "src1", 30), (5, "long words in a row " * 60_000, "en", "hot", None), (6, "é😀 ünïcödé text 日本", "xx", "hot", 9), (None, None, None, None, None), (None, None, None, None, None),
]


def odd_docs(spark):
    """The columns of documents and some that clash with the operators' own."""
    rows = [(*r, k, f"x{k}", 0.5) for k, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _rid int, slot string, keep double")


def test_stages_on_odd_rows(spark):
    """Each stage on nulls, empty texts, repeated rows and clashing columns: whole rows in, whole rows out."""
    docs = odd_docs(spark)
    said = collections.Counter(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        rows_ = collections.Counter(map(tuple, got.collect()))
        assert not rows_ - said, name
        if name == "mixing sources":
            assert rows_ == said
        if name == "exact dedup":
            # Null, empty and blank texts are one group; of it the longest text stays, then the least id.
            assert len([r for r in rows_ if not (r[1] or "").strip()]) == 1 and sum(rows_.values()) == 6
        if name == "MinHash near-dedup":
            assert {r[0] for r in rows_} >= {1, 2, 3, 5, 6} and sum(v for r, v in rows_.items() if r[0] == 4) >= 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == len(ODD) and all((r.token_ids is None) == (r.n_tokens is None) for r in last)
    assert max(r.n_tokens or 0 for r in last) > 200_000


def test_stages_on_an_empty_table(spark):
    docs = odd_docs(spark).where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_very_long_texts(spark):
    """A text above a megabyte for the operators that take whole texts: 2, 3, 6, 7 and 9."""
    from scrivano.llm import chat, near, spots

    text = " ".join(f"word{k % 5000} the {k}" for k in range(70_000))
    assert len(text) > 1 << 20
    df = spark.createDataFrame([(1, text, "en", "s"), (2, text + " more", "en", "s"), (3, "short", "en", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_classifier(df, labels, columns=["doc_id"]).count() == 3
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.minhash_near_dedup(df).collect()}
    words = text.lower().split()
    assert got[1] == (len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}), 1) and got[2][1] == 1 and got[3][1] == 3
    model = sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())
    told = {r.doc_id: r for r in pieces.token_table(df).collect()}
    assert list(told[1].token_ids) == model.encode(text) and told[1].round_trip
    prints = {r.doc_id: r for r in spots.spotsigs(df.select("doc_id", "text")).collect()}
    assert prints[1].n_chars == len(text) and prints[2].near_next > 0.99
    turns = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    answer = chat.chat_digest(turns).first()
    assert answer.loss_chars == len(text) and answer.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
