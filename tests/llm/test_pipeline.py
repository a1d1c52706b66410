"""The pipeline and its stages against plain versions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairwise.llm import byte_bpe, quality_classifier
from tests.llm import brute
from tests.llm.conftest import make_items


def read(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    return docs, [(r["doc_id"], r["text"]) for r in docs.collect()]


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["tables", "empty_tables"])
def test_stages_keep_the_columns(spark, request, name):
    folder = request.getfixturevalue(name)
    docs, _ = read(spark, folder)
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, folder).columns == docs.columns
    extra = ["n_tokens", "round_trip", "token_ids"]
    assert sorted(corpus_pipeline.tokenize(spark, docs, folder).columns) == sorted({*docs.columns, *extra})


def test_classifier_stage(spark, tables):
    docs, _ = read(spark, tables)
    model = quality_classifier.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    scored = quality_classifier.score(docs, model)
    assert kept(corpus_pipeline.classify(spark, docs, tables)) == kept(scored.filter("score >= 0.7"))


def test_line_stage(spark, tables):
    docs, rows = read(spark, tables)
    found = corpus_pipeline.drop_shared_lines(spark, docs, tables).collect()
    expected = sorted(((d, h) for d, _, _, h in brute.lines(rows)), key=repr)
    assert sorted(((r["doc_id"], brute.sha(r["text"])) for r in found), key=repr) == expected


def near_duplicates(rows):
    best = {}
    for (doc, _), (_, group) in zip(rows, brute.groups(rows), strict=True):
        rank = (doc is None, doc or 0)
        if group not in best or rank < best[group][0]:
            best[group] = (rank, doc)
    return sorted((d for _, d in best.values()), key=repr)


def test_near_duplicate_stage(spark, tables):
    docs, rows = read(spark, tables)
    found = corpus_pipeline.drop_near_duplicates(spark, docs, tables).collect()
    assert sorted((r["doc_id"] for r in found), key=repr) == near_duplicates(rows)


def test_decontamination_stage(spark, tables):
    docs, rows = read(spark, tables)
    clean = [row for row, r in zip(rows, brute.contamination(rows, make_items()), strict=True) if not r[-1]]
    assert kept(corpus_pipeline.decontaminate(spark, docs, tables)) == sorted(clean, key=repr)


def test_token_stage(spark, tables):
    docs, rows = read(spark, tables)
    own = byte_bpe.codec()
    for r in corpus_pipeline.tokenize(spark, docs, tables).collect():
        assert r["round_trip"] and r["n_tokens"] == len(own.encoding.encode_ordinary(r["text"] or ""))


def test_whole_run(spark, data):
    """On the small table every stage takes effect, and the result is what the plain versions leave."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    step = corpus_pipeline.classify(spark, docs, data)
    rows = [(r["doc_id"], r["text"]) for r in step.collect()]
    assert 0 < len(rows) < docs.count()
    found = corpus_pipeline.run(spark, data).withColumn("ids", F.sha2("token_ids", 256)).collect()
    texts = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_shared_lines(spark, step, data).collect()}
    assert [r[3] for r in brute.lines(rows)] == [brute.sha(texts[d]) for d, _ in rows]
    rows = [(d, texts[d]) for d, _ in rows]
    single = set(near_duplicates(rows))
    rows = [row for row in rows if row[0] in single]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = [row for row, r in zip(rows, brute.contamination(rows, items), strict=True) if not r[-1]]
    assert 0 < len(clean) < len(rows)
    assert sorted((r["doc_id"], r["text"]) for r in found) == sorted(clean)
