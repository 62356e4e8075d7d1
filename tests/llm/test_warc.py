import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cartweave.llm import warc
from cartweave.llm.shared import fresh_dir


@pytest.fixture(scope="module")
def pages():
    r = random.Random(1)
    bodies = ["<p>%d</p>" % i * r.choice([1, 5, 3000]) for i in range(30)]
    rows = [(i, f"http://h{i % 7}.example/{i}", r.choice(bodies)) for i in range(200, 0, -1)]
    return [*rows, (300, None, None), (301, "http://x\r\nInjected: y", ""), (302, "u", ""), (303, "ü", "é文😀\r\n\r\nbody"), (None, "u", bodies[0]), (304, "u", bodies[0]), (304, "u", bodies[0])]


@pytest.fixture
def table(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)


def brute(pages, least=0):
    smallest = {}
    for i, _, html in pages:
        if i is not None and len((html or "").encode()) >= least:
            smallest[html or ""] = min(i, smallest.get(html or "", i))
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        other = smallest.get(html or "") if i is not None else None
        other = None if other == i else other
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other is not None else "response", other))
    return sorted(out, key=str)


def result(out):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect()), key=str)


def test_as_brute_force(table, pages, with_clashes):
    assert result(warc.report(with_clashes(table.withColumnRenamed("html", "html")))) == brute(pages)


def test_least_size(spark, table, pages):
    index = warc.write(table, fresh_dir(spark, "warc"), least=50)
    assert result(warc.read(index)) == brute(pages, 50)


def test_payloads_come_back(spark, table, pages):
    index = warc.write(table, fresh_dir(spark, "warc"))
    back = {r["page_id"]: r["payload"].decode() for r in warc.read(index.where("record_type = 'response' and page_id is not null")).collect()}
    have = {i: html or "" for i, _, html in pages}
    assert back and all(have[i] == x for i, x in back.items())
    some = warc.read(index.where("page_id in (7, 150, 303)"))
    assert sorted(r["page_id"] for r in some.collect()) == [7, 150, 303]


def test_archives_are_whole_files(spark, table, pages):
    """Any reader of compressed records in a row can read a file without the index."""
    index = warc.write(table, fresh_dir(spark, "warc"))
    files = [r["file"] for r in index.select("file").distinct().collect()]
    raw = b"".join(gzip.open(f.removeprefix("file://")).read() for f in files)
    assert raw.count(b"WARC/1.1\r\n") == len(pages) and b"\r\nInjected" not in raw
    ends = index.groupBy("file").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] for r in ends)


def test_reads_are_joined(spark, table, monkeypatch):
    monkeypatch.setattr(warc, "GAP_BYTES", 0)
    index = warc.write(table, fresh_dir(spark, "warc"))
    assert warc.ranges(index).count() == index.select("file").distinct().count()
    every_other = index.where(F.pmod("page_id", F.lit(2)) == 0)
    assert sorted(r["page_id"] for r in warc.read(every_other).collect()) == sorted(r["page_id"] for r in every_other.collect())
    monkeypatch.setattr(warc, "READ_BYTES", 500)
    assert warc.ranges(index).count() > 10
    assert warc.read(index).count() == index.count()


def test_empty_table(spark, table):
    assert warc.report(table.limit(0)).collect() == []
