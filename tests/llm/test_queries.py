"""The registered queries on the small test data: against their SQL, and what the contracts say of them."""

import hashlib
import os
import re
import zlib

import pytest

from cartweave.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(Q.oracle_sql()[name]).to_arrow_table()
    got = Q.queries()[name](spark, DATA).toArrow()
    assert sorted(want.column_names) == sorted(got.column_names)
    rows = lambda t: sorted(zip(*(t.column(c).to_pylist() for c in sorted(t.column_names)), strict=True), key=str)
    assert rows(got) == rows(want)


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", x)[1]) for x in Q.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_rows(spark, name):
    table = "pages" if name.startswith("op6") else "documents"
    out = Q.queries()[name](spark, DATA)
    assert out.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_language(spark, documents):
    rows = Q.op5_langid(spark, DATA).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.9 * len(held)


def test_edited_texts(spark, documents):
    ids = sorted(documents, reverse=True)
    rows = {r["doc_id"]: r for r in Q.op8_fingerprint(spark, DATA).collect()}
    for k, i in enumerate(ids):
        t, after = documents[i] or "", documents[ids[(k + 1) % len(ids)]] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (rows[i]["n_chars"], rows[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
