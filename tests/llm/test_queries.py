"""The registered queries beside their SQL, and the pipeline's stages on their own inputs."""

import random

import pytest

import corpus_pipeline
from ledgerlens.llm import queries
from ledgerlens.llm.common import stage
from tests.oracle import compare, duck


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in queries.ORACLE:
        assert compare(df, duck(sf_dir), queries.ORACLE[name]) == ""
    else:
        table, each = ("embeddings", 32) if "vec_id" in df.columns else ("documents", 1)
        assert df.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count() * each


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for number, (name, step) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(step(spark, docs, sf_dir), "test")
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids and set(columns) <= set(docs.columns)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "quality rules":
            kept = queries.op4_quality_rules(spark, sf_dir).filter("kept").count()
            assert docs.count() == kept
        elif name == "near-duplicates":
            judged = corpus_pipeline.near_duplicates.near_duplicates(before).filter("kept")
            assert docs.count() == judged.count()
        elif name == "repeated strings":
            assert docs.count() == before.count() and docs.filter("n_chars != char_length(text)").count() == 0
        elif name == "benchmark decontamination":
            items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert docs.count() == corpus_pipeline.decontamination.decontaminate(before, items).filter("NOT contaminated").count()


def test_stages_of_two_inputs_do_not_meet(spark, sf_dir):
    """A stage called on a second input before the first result was written; and one result read twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    halves = [docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")]
    for _, step in corpus_pipeline.STAGES:
        first, second = (step(spark, half, sf_dir) for half in halves)
        assert first.count() == first.count() > 0 and second.count() > 0
        halves = [stage(first, "test"), stage(second, "test")]


def test_passages_of_fifty_words_go(spark, sf_dir):
    """A passage of 54 short words, far below 400 bytes, shared by two documents; one of 49 stays."""
    rng = random.Random(8)
    make = lambda n: " ".join(f"{rng.randrange(16**4):04x}" for _ in range(n))
    long, short = make(54), make(49)
    texts = [f"{make(30)} {long}\n{make(30)}", f"{make(20)} {long.replace(' ', '  ')} {make(40)}", f"{make(70)} {short}", f"{short} {make(70)}", make(200)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    got = {r.doc_id: r for r in corpus_pipeline.without_repeats(spark, docs, sf_dir).collect()}
    assert len(got) == 5 and got[0].text.split() == texts[0].replace(long, "").split() and len(got[1].text.split()) == 60
    assert [got[i].text for i in (2, 3, 4)] == texts[2:] and all(r.n_chars == len(r.text) for r in got.values())


def test_pipeline_takes_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "w " * 30_000, "en", "a", 60_000), (2, "w " * 30_000, "en", "a", 60_000)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
        for _, step in corpus_pipeline.STAGES:
            assert step(spark, docs, sf_dir).count() <= len(table)
