import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwell.llm import queries
from tests.llm.conftest import prose
from tests.llm.test_toxicity import corpus

ITEM = " ".join(f"item{i}" for i in range(15))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with planted copies, shared passages, leaks and toxic documents."""
    d = tmp_path_factory.mktemp("tables")
    texts, labels = corpus(100)
    rows = [(i, t, "en", "s") for i, t in texts]
    passage = prose(900, 60)
    rows += [(200, prose(800, 120), "en", "s"), (201, prose(800, 120), "fr", "t"), (202, prose(801, 30) + "\n" + passage, "en", "s")]
    rows += [(203, passage + "\n" + prose(802, 30), "en", "s"), (204, prose(803, 40) + " " + ITEM + " " + prose(804, 40), "en", "s"), (205, None, None, None), (206, "", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    start = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == start
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {i for i in range(0, 100, 5)}
    assert set(seen["toxicity"]) == set(range(207)) - set(range(100, 200)) - toxic
    lines = seen["line_dedup"]
    assert 201 not in lines and "\n" not in lines[203] and "\n" in lines[202] and lines[205] is None and lines[206] == ""
    assert set(seen["near_dedup"]) == set(lines)
    assert "item3" not in seen["decontamination"][204] and len(seen["decontamination"]) == len(lines)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == set(lines)
    assert corpus_pipeline.run(spark, folder).count() == packed.count()


def test_awkward_tables(spark, folder, tmp_path):
    """No documents give no rows; nulls, repeated rows and empty texts pass through all stages."""
    empty = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    rows = [(1, None, None, None), (1, None, None, None), (2, "", "en", "s"), (None, prose(1, 40), "en", None), (3, prose(2, 50), "en", "s"), (3, prose(2, 50), "en", "s")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    for name, docs, found in (("empty", empty, []), ("odd", odd, [None, 1, 1, 2, 3])):
        d = tmp_path / name
        docs.write.parquet(f"{d}/documents.parquet")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{folder}/{table}.parquet").filter(F.lit(name == "odd")).write.parquet(f"{d}/{table}.parquet")
        got = corpus_pipeline.run(spark, str(d)).collect()
        assert sorted((r["doc_id"] for r in got), key=lambda x: (x is not None, x)) == found


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
