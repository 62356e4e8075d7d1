import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from cartweave.llm import decontaminate, langid, minhash, pii


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, prose, odd_rows):
    """documents and benchmark with odd rows, copies, passages and personal data."""
    to = tmp_path_factory.mktemp("sf")
    item = prose(77, 30)
    rows = [*odd_rows, *((100 + i, prose(i, 80)) for i in range(40)), *((200 + i, prose(i, 80) + " end") for i in range(10)), (300, item), (301, prose(9, 700) + " " + item + " after it"), *((400 + i, f"{prose(50 + i, 30)} mail me at a{i}@b.example today") for i in range(5))]
    docs = spark.createDataFrame([(i, t, "xx" if k % 3 else None, "web", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return str(to)


def stages(spark, folder, docs):
    out = []
    for _, stage in C.STAGES:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_stages_of_the_contract(spark, folder):
    assert [f.__name__ for _, f in C.STAGES] == ["identify_language", "drop_near_duplicates", "remove_benchmark", "redact_personal_data", "encode_tokens"] and C.ORACLE_SQL is None


def test_each_stage_decides(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lang, near, bench, pii_, tokens = stages(spark, folder, docs)
    key = lambda f: sorted(((r["doc_id"], r["text"]) for r in f.collect()), key=str)

    assert all(f.columns == docs.columns for f in (lang, near, bench, pii_))
    assert key(lang) == [x for x in key(docs) if x[1] and re.search(r"[^\W\d_]", x[1])]
    assert lang.where("lang is null").count() == 0

    kept = {r["doc_id"] for r in minhash.near_duplicates(lang).where("kept").collect()}
    assert {r["doc_id"] for r in near.collect()} == kept and near.count() < lang.count()
    assert not kept & {200 + i for i in range(10)} and {100 + i for i in range(40)} <= kept and near.where("doc_id = 5").count() == 1

    found = {r["doc_id"]: r["contaminated"] for r in decontaminate.report(near, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in bench.collect()} == {i for i, bad in found.items() if not bad} and found[300] and not found[301]
    assert bench.where("doc_id = 301").first()["text"].endswith("  after it")
    assert bench.where("n_chars <> length(text)").count() == 0

    assert pii_.count() == bench.count() and key(pii_) == key(pii.redacted(bench))
    assert pii_.where("doc_id = 400").first()["text"].endswith("mail me at [EMAIL] today") and pii_.where("n_chars <> length(text)").count() == 0

    assert tokens.count() == pii_.count()
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in tokens.where("doc_id is not null").collect()) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in key(pii_) if i is not None)


def test_near_copies_of_four_fifths(spark, folder, prose):
    """A page of 500 words with ten scattered words changed has a Jaccard index of 0.82."""
    words = prose(91, 500).split()
    changed = [f"changed{i}" if i % 50 == 25 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, prose(92, 500))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in C.drop_near_duplicates(spark, docs, folder).collect()) == [1, 3]


def test_run(spark, folder):
    out = C.run(spark, folder)
    last = stages(spark, folder, spark.read.parquet(f"{folder}/documents.parquet"))[-1]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, last.collect()), key=str)


def test_clean_documents_stay(spark, folder):
    rows = C.run(spark, folder).collect()
    assert {100 + i for i in range(40)} | {301} | {400 + i for i in range(5)} <= {r["doc_id"] for r in rows}


def test_further_columns(spark, folder, clashing):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in clashing))
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, more, folder)
        assert out.columns == more.columns
        rows = [r.asDict() for r in out.collect()]
        assert rows and all(r[c] == f"own {c}" for r in rows for c in clashing)
    assert C.encode_tokens(spark, more, folder).count() == docs.count()


def test_few_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == ["doc_id", "text", "lang"]


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert [f.count() for f in stages(spark, folder, docs)] == [0] * 5


def test_documents_stay_where_no_language_is_learnt(spark, folder):
    rows = [(1, "clean prose", None), (2, "123 !", None), (3, None, None), (4, "文字", None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted((r["doc_id"], r["lang"]) for r in C.identify_language(spark, docs, folder).collect()) == [(1, "und"), (4, "und")]


def test_no_language_is_learnt_from_the_fold(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert list(langid.learn(docs)) == [{}]
