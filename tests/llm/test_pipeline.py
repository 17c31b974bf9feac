"""The pipeline's stages, each against a plain version of what it does."""

import math

import corpus_pipeline
from compare import DATA
from edge import no_documents, odd_documents
from plain import plain_scores, plain_shape, plain_toxic
from test_similar_texts import brute

from kelpwood.llm import quality, toxicity


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept[name] <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()] if name != "packing" else []
        if name == "quality":
            weights, odds = quality.fit(before, labels)
            all_rows = before.collect()
            evidence = [max(-20, min(20, sum(w * x for w, x in zip(weights, plain_shape(r.text))))) for r in all_rows]
            scores = plain_scores([(r.source or "", r.lang or "", e) for r, e in zip(all_rows, evidence)], odds)
            assert kept[name] == {r.doc_id for r, (_, s) in zip(all_rows, scores) if s >= 0.5}
        elif name == "toxicity":
            weight = dict(zip(*toxicity.fit(before, labels)))
            assert kept[name] == {i for i, t in rows if not weight or 1 / (1 + math.exp(-sum(weight.get(c, 0.0) for c in plain_toxic(t or "")))) < 0.3}
        elif name == "exact_dedup":
            assert kept[name] == set({t: i for i, t in sorted(rows)}.values())
        elif name == "near_dedup":
            rows.sort()
            assert kept[name] == set(brute(rows))
    assert kept["packing"] == kept["near_dedup"]
    assert len(corpus_pipeline.STAGES) == 5


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_odd_and_empty_tables(spark, tmp_path):
    for k, table in enumerate((odd_documents(spark), no_documents(spark))):
        docs, columns = table, table.columns
        for name, stage in corpus_pipeline.STAGES:
            before = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else set()
            stage(spark, docs, DATA).write.parquet(str(tmp_path / f"{k}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
            if name != "packing":
                assert docs.columns == columns
                assert {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()} <= before
        assert (docs.count() == 0) == (k == 1 or not before)
