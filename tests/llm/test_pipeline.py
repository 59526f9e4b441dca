import pytest

from tests.llm.common import documents, mixed, text


def test_registered():
    import __spark_entry__ as E

    names = E.queries()
    assert "pipeline" in names and all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 11))
    assert {"op1_winnowing_decontamination", "op3_sharded_warc"} <= E.oracle_sql().keys()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    r = random.Random(11)
    d = str(tmp_path_factory.mktemp("sf"))
    item = text(r, 20)
    rows = mixed(12, 40) + [(500, f"{text(r, 5)} {item} {text(r, 5)}", "en"), (501, f"write to a.b@c.example.com {text(r, 30)}", "en")]
    documents(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "decontamination", "personal_data", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda d: {r.doc_id for r in d.collect()}
    seen = [ids(docs)]
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(ids(docs))
    assert seen[0] - seen[1] >= {1000, 1001, 1002, 1006} and 500 in seen[2] and 500 not in seen[3] and seen[4] == seen[3]
    assert "[EMAIL]" in docs.where("doc_id = 501").first().text
    last = C.STAGES[-1][1](spark, docs, folder)
    assert ids(last) == seen[4]


@pytest.mark.parametrize("stage", range(4))
def test_stages_take_columns_of_any_name(spark, folder, stage):
    import corpus_pipeline as C

    hidden = ["__lang", "__score", "__words", "__hit", "__items", "__gone", "__set", "__again", "__fp", "__rn", "__GONE_0", "spans", "count"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, c in enumerate(hidden):
        docs = docs.withColumn(c, (docs.doc_id + i).cast("string"))
    out = C.STAGES[stage][1](spark, docs, folder)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    rows = out.where("doc_id = 500 OR doc_id = 1").collect()
    assert rows and all(r[c] == str(r.doc_id + i) for r in rows for i, c in enumerate(hidden))


def test_language_stage_drops_what_is_in_no_language(spark, tmp_path):
    import random

    import corpus_pipeline as C

    r = random.Random(5)
    rows = mixed(14, 60) + [(7000 + i, " ".join("".join(r.choice("qxzjvwk") for _ in range(9)) for _ in range(30)), None) for i in range(5)]
    out = {x.doc_id for x in C.language_id(spark, documents(spark, rows), str(tmp_path)).collect()}
    assert not out & {7000, 7001, 7002, 7003, 7004} and {i for i, _, lang in rows if i is not None and i < 60 and lang} <= out


def test_run(spark, folder):
    import corpus_pipeline as C

    out = C.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_empty_documents(spark, folder, tmp_path):
    import corpus_pipeline as C

    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
