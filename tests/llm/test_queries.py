"""Registered queries against their SQL, and the pipeline against its stages by brute force."""

import pytest
from compare import differences, duck

from equiloom.llm import queries

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    found = queries.QUERIES[name](spark, DIRECTORY).toPandas()
    assert differences(found, duck(DIRECTORY).sql(queries.ORACLES[name]).df()) is None


def test_all_are_registered():
    import __spark_entry__ as entry

    assert queries.QUERIES.keys() <= entry.queries().keys()
    assert [n for n in range(1, 14) if not any(k.startswith(f"op{n}_") for k in queries.QUERIES)] == []


def test_pipeline_stages(spark):
    import corpus_pipeline
    from test_leaks import brute as leaks
    from test_jaccard_copies import brute_kept
    from test_secrets import brute as spans

    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()))
    first = {i for (_, i), _ in brute_kept(rows)[1]}
    unique = stages["near_duplicates"](spark, docs, DIRECTORY)
    assert unique.columns == docs.columns and {r["doc_id"] for r in unique.collect()} == first
    clean = stages["decontamination"](spark, unique, DIRECTORY)
    expected = {i for i, t in rows if i in first and not leaks(t, items)[1]}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == expected
    blank = stages["secrets"](spark, clean, DIRECTORY)
    assert blank.columns == docs.columns
    texts = dict(rows)
    for r in blank.collect():
        found = spans(texts[r["doc_id"]])
        assert (r["text"] == texts[r["doc_id"]]) == (not found) and r["n_chars"] == len(r["text"])
    packed = stages["packing"](spark, blank, DIRECTORY).collect()
    assert sorted(r["doc_id"] for r in packed) == sorted(expected)


def test_toxic_stage_keeps_columns_and_clean_rows(spark):
    import corpus_pipeline

    directory = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{directory}/labels.parquet").collect()}
    kept = corpus_pipeline.STAGES[0][1](spark, docs, directory)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    clean = [i for i, y in labels.items() if y == 0]
    toxic = [i for i, y in labels.items() if y == 1]
    assert sum(i in ids for i in clean) / len(clean) > 0.97
    assert sum(i in ids for i in toxic) / len(toxic) < 0.2


def test_run_is_its_stages(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, DIRECTORY)
    assert found.columns == ["doc_id", "n_tokens", "bucket", "boundary", "batch", "slot", "padding"]
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIRECTORY)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, found.collect()))


def test_odd_documents_pass_every_stage(spark):
    import corpus_pipeline

    rows = [(None, None, None, 1, None), (1, "", "en", None, "x"), (1, "", "en", None, "x"), (2, "plain words " * 3000, None, 3, "y"), (2, "plain words " * 3000, None, 3, "y")]
    schema = "doc_id long, text string, score__ string, n_chars long, spans string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DIRECTORY)
            out.collect()
            assert name == "packing" or out.columns == docs.columns
            docs = out

