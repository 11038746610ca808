import zlib

import pandas as pd
import pytest

from riskweave.llm import toxicity as T

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return T.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_rows(spark, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/labels.parquet")
    scored = T.scores(docs.join(spark.createDataFrame(labels), "doc_id"), model).toPandas().merge(labels, on="doc_id")
    held = scored[[zlib.crc32(str(i).encode()) % 3 == 1 for i in scored.doc_id]]
    hit = held.score >= 0.7
    assert len(held) > 1000 and ((held.toxic == 1) == hit).mean() > 0.98
    assert hit[held.toxic == 0].mean() < 0.005


def test_disguises(spark, model):
    texts = ["you id10t", "you 1d1ot!", "you іdіоt", "you ｉｄｉｏｔ", "you ídiot", "you i​diot", "$tupid you", "the c1own"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, "in 1984 or 10 of 100"), (91, "a clown fish"), (92, None), (93, ""), (None, "calm")]
    got = {r.doc_id: r for r in T.scores(spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double"), model).collect()}
    assert all(got[i].n_hits == 1 and got[i].score >= 0.7 for i in range(len(texts)))
    assert all(got[i].n_hits == 0 and got[i].score < 0.1 for i in (90, 91, 92, 93, None))


def test_hits_equal_plain_search(model):
    """Every place where a lexicon entry starts a word, found by str.find."""
    text = T.folded_text("An idiot, a stupid idiotic scum and trash can; clown trash", T.Cache(T.fold))
    plain = sorted((at, at + len(e), w) for e, w in model.weights.items() for at in range(len(text)) if text.startswith(e, at))
    spared = [(text.find(p), text.find(p) + len(p)) for p in model.exceptions if p in text]
    assert sorted(T.hits(model.automaton(), text)) == [h for h in plain if not any(a <= h[0] and h[1] <= b for a, b in spared)]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(0, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = T.scores(docs, T.learn(docs, some)).collect()
        assert len(got) == 2 and all(0 <= r.score < 0.7 for r in got)
    assert T.scores(docs.limit(0), T.Model()).collect() == []


def test_clean_keeps_columns(spark, model):
    df = spark.createDataFrame([(1, "x", "idiot scum idiot"), (2, "y", "calm"), (2, "y", "calm"), (3, None, None)], "doc_id long, score string, text string")
    assert sorted((tuple(r) for r in T.clean(df, model).collect()), key=str) == [(2, "y", "calm"), (2, "y", "calm"), (3, None, None)]
