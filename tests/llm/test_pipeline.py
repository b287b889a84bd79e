"""The pipeline's stages against plain restatements, on the given documents."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerloom.llm import secrets
from ledgerloom.llm.common import table

from .test_corpus_ops import brute_classes, brute_lines, brute_quality, odd_docs, sha


def test_stages_in_turn(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    out = cp.drop_low_quality(spark, docs, sf)
    assert out.columns == list(cp.COLUMNS)
    good = {r["doc_id"]: r["text"] for r in out.collect()}
    assert good == {d: r["text"] for d, r in rows.items() if not brute_quality(r["text"])[-1]}
    out = cp.drop_repeated_lines(spark, out, sf).cache()
    lines = {r["doc_id"]: r for r in out.collect()}
    assert {d: sha(r["text"]) for d, r in lines.items()} == {d: v[2] for d, v in brute_lines(list(good.items())).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())
    classes = brute_classes([(d, r["text"]) for d, r in lines.items()])
    out = cp.drop_near_duplicates(spark, out, sf).cache()
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept == {d: lines[d]["text"] for d, c in classes.items() if d == c}
    out = cp.redact_secrets(spark, out, sf)
    clean = {r["doc_id"]: r["text"] for r in out.collect()}
    assert clean.keys() == kept.keys() and not any(secrets.find_spans(t)[1] for t in clean.values())
    assert all(re.sub(r"\[[A-Z]+\]", "", clean[d])[:20] == re.sub(r"\[[A-Z]+\]", "", t)[:20] for d, t in kept.items() if not secrets.find_spans(t)[1])
    assert {r["doc_id"] for r in cp.pack_batches(spark, out, sf).collect()} == kept.keys()


def test_run_and_edges(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
    docs = odd_docs(spark).withColumn("source", F.col("doc_id").cast("string"))
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() >= 1


def test_near_duplicates_by_id_and_text(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(3, a), (5, a), (5, b), (5, b), (6, None), (6, ""), (None, b)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __k string")
    out = cp.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in out) == [(3, a), (5, b), (6, "")]


def test_stages_take_empty_tables(spark):
    docs = odd_docs(spark).withColumn("source", F.lit("s")).limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
