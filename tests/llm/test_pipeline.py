import numpy as np

import corpus_pipeline as P
from riskweave.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality_rules", "minhash", "packing"]
    clean = P.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.scores(docs, model).where("score >= 0.7").collect()}
    assert bad and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad
    lines = P.clean_lines(spark, docs, SF)
    assert lines.columns == docs.columns and 0 < lines.count() < docs.count()
    once = P.drop_near_copies(spark, docs, SF)
    assert once.columns == docs.columns
    texts = [r.text.encode().lower().split() for r in once.collect()]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in texts]
    assert all(5 * len(a & b) < 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if 0.8 * len(a) <= len(b) <= len(a) / 0.8)


def test_whole_run(spark):
    rows = P.run(spark, SF).collect()
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in spans) <= 1024 for spans in fill.values())
    total = sum(r.length for r in rows)
    assert len(fill) <= -(-total // 1024) + 3
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.length for r in rows)
