import fixtures
import pyarrow.parquet as pq
import pytest
import test_dedup

import corpus_pipeline
from lakeweft.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_stages_on_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = corpus_pipeline.keep_quality(spark, docs, FOLDER)
    assert good.columns == docs.columns and 0 < good.count() <= docs.count()
    lines = corpus_pipeline.drop_repeated_lines(spark, good, FOLDER)
    assert lines.count() == good.count()
    for r in lines.collect():
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split("\n")) <= set(before[r["doc_id"]].split("\n")) | {""}
    kept = corpus_pipeline.drop_near_duplicates(spark, lines, FOLDER)
    comps = test_dedup.brute_components([(r["doc_id"], r["text"]) for r in lines.collect()])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in comps if i == c)
    masked = corpus_pipeline.mask_secrets(spark, kept, FOLDER)
    assert masked.count() == kept.count() and masked.columns == docs.columns
    packed = corpus_pipeline.pack_sequences(spark, masked, FOLDER)
    assert packed.select("doc_id").distinct().count() == masked.count()


@pytest.mark.parametrize("make", [fixtures.odd, fixtures.empty])
def test_stages_bear_odd_rows(spark, make):
    docs = make(spark)
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == names
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() >= docs.count()


def test_registration():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 10
    assert set(queries.queries()) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5
    assert pq.read_schema(f"{FOLDER}/documents.parquet").names == ["doc_id", "text", "lang", "source", "n_chars"]
