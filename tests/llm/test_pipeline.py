"""The pipeline against plain versions of its stages."""

import corpus_pipeline
from volframe.llm import compression_classifier
from volframe.llm.ngram_join import keep_first

from .test_join import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "quality_classifier", "ngram_join", "packing"]
    ruled = stages["quality_rules"](spark, docs, SMALL).cache()
    model = compression_classifier.fitted(spark, SMALL)
    scored = {r.doc_id for r in compression_classifier.score(ruled, model).collect() if r.score >= 0.3}
    kept = stages["quality_classifier"](spark, ruled, SMALL).cache()
    assert {r.doc_id for r in kept.collect()} == scored
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    alone = {i for i, _, low, _ in brute(rows, 5, 80) if i == low}
    last = stages["ngram_join"](spark, kept, SMALL).cache()
    assert {r.doc_id for r in last.collect()} == alone == {r.doc_id for r in keep_first(kept).collect()}
    assert ruled.columns == kept.columns == last.columns == want
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == alone
    assert packed.where("start = 0").count() == len(alone)


def test_odd_rows(spark, tables, odd, odd_rows):
    """Null ids and texts, repeated rows, ties, a very long text and extra columns with names that stages use."""
    stages = dict(corpus_pipeline.STAGES)
    ruled = stages["quality_rules"](spark, odd, tables).cache()
    assert ruled.columns == odd.columns
    good = {(r.doc_id, r.text) for r in ruled.collect()}
    from volframe.llm import quality_rules

    kept = {r.doc_id for r in quality_rules.judge(odd).where("kept").collect()}
    assert {i for i, _ in good} == kept and (9, dict(odd_rows)[9]) in good
    likely = stages["quality_classifier"](spark, ruled, tables).cache()
    model = compression_classifier.fitted(spark, tables)
    want = sorted(((r.doc_id, r.text) for r in compression_classifier.score(ruled, model).where("score >= 0.3").collect()), key=str)
    assert likely.columns == odd.columns and sorted(((r.doc_id, r.text) for r in likely.collect()), key=str) == want
    alone = stages["ngram_join"](spark, likely, tables).cache()
    assert alone.columns == odd.columns
    least = {(i, low) for i, _, low, _ in brute([(r.doc_id, r.text) for r in likely.collect()], 5, 80)}
    assert {r.doc_id for r in alone.collect()} == {i for i, low in least if i is None or i == low}
    pieces = stages["packing"](spark, alone, tables).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in alone.collect()} and all(0 < p.length <= 4096 for p in pieces)


def test_no_rows(spark, tables, none):
    """Every stage of an empty table is empty, with the same columns."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, tables)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def test_whole_run_on_odd_tables(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        assert all(a["offset"] + a["length"] == b["offset"] for a, b in zip(own, own[1:], strict=False)) and own[0]["offset"] == 0 and own[-1]["offset"] + own[-1]["length"] <= 4096
