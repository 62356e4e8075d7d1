"""Queries against SQL, the command line, streams, o5m, and the driver's entry module."""

import io
import json
import os
import subprocess
import sys
import types

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cartweave import __main__ as cli
from cartweave import queries as engine
from cartweave import streaming
from cartweave.functions import o5m
from cartweave.functions import tags as G
from cartweave.operators import sinks
from cartweave.schema import ELEMENT

DATA = "/root/testdata/sf0.001"
with_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@with_data
@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(engine.oracle_sql()[name]).to_arrow_table()
    got = engine.queries()[name](spark, DATA).toArrow()
    assert sorted(want.column_names) == sorted(got.column_names)
    rows = lambda t: sorted(zip(*(t.column(c).to_pylist() for c in sorted(t.column_names)), strict=True), key=str)
    assert rows(got) == rows(want)


@with_data
def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["type", "id", "tag_event_type", "tag_severity", "tag_reason", "n_tags"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for x in os.listdir(root):
        if x in ("cartweave", "__spark_entry__.py"):
            subprocess.run(["cp", "-r", f"{root}/{x}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/cartweave/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), [x for x in q if x.startswith('op') and x[2:3].isdigit() or x == 'pipeline'])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout
    assert out.split()[0] == str(len(engine.queries())) and out.endswith("[]\n")


ROWS = [("node", i, 1, 2, 3, "u", "2020-01-01T00:00:00Z", True, {"name": f"n{i}"} if i % 2 else {}, 1.0 * i, 2.0, None, None) for i in range(1, 21)]


@pytest.fixture(scope="module")
def elements(spark):
    return spark.createDataFrame(ROWS, ELEMENT)


@pytest.fixture
def kept_session(spark, monkeypatch):
    """The command line finds the session of the tests."""
    monkeypatch.setattr(type(spark), "stop", lambda self: None)


def test_command_line(spark, elements, tmp_path, kept_session, capfd):
    sinks.write(elements, f"{tmp_path}/in.opl", "opl")
    (tmp_path / "one").write_text('OSMFilter v0.2.0\n\nHAS "name"\n\tRENAME "name" "title"\n\tCOMMIT\nDROP\n')
    (tmp_path / "two").write_text("id < 10")
    assert cli.main(["--input", f"{tmp_path}/in.opl", "--filter", f"{tmp_path}/one", "--filter", f"{tmp_path}/two", "--output", f"{tmp_path}/out.json"]) == 0
    doc = json.loads((tmp_path / "out.json").read_text())
    assert sorted((e["id"], e["tags"]) for e in doc["elements"]) == [(i, {"title": f"n{i}"}) for i in (1, 3, 5, 7, 9)]
    assert cli.main(["--from", "json", "--input", f"{tmp_path}/out.json", "--to", "overpass", "--output", f"{tmp_path}/out"]) == 0
    assert "osm3s" in json.loads((tmp_path / "out").read_text())


def test_standard_input_and_output(elements, tmp_path, kept_session, monkeypatch, capfdbinary):
    monkeypatch.setattr(sys, "stdin", types.SimpleNamespace(buffer=io.BytesIO(b"n1 v1 Ta=b x1 y2\nw2 T Nn1,n3\n")))
    assert cli.main(["--from", "opl", "--to", "xml"]) == 0
    sys.stdout.flush()
    out = capfdbinary.readouterr().out.decode()
    assert '<tag k="a" v="b"/>' in out and '<nd ref="1"/><nd ref="3"/>' in out


def test_command_line_mistakes(elements, tmp_path, kept_session, capfd):
    assert cli.main(["--input", "x", "--output", "y.opl"]) == 2
    assert "UnknownInputFormat" in capfd.readouterr().err
    assert cli.main(["--input", "x.opl", "--output", "y.pbf"]) == 2
    assert "UnknownOutputFormat" in capfd.readouterr().err
    (tmp_path / "bad").write_text("DROP DROP")
    assert cli.main(["--input", "missing.opl", "--output", f"{tmp_path}/y.opl", "--filter", f"{tmp_path}/bad"]) == 2
    assert "FilterSyntaxError" in capfd.readouterr().err and not (tmp_path / "y.opl").exists()


def test_streams(spark, elements, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.opl").write_text("n1 v1 Tname=x x1 y2\nbad line\nn2 v1 T x1 y2\n")
    filters = ['OSMFilter v0.2.0\n\nHAS "name"\n\tSET "seen" "yes"\n\tCOMMIT\nDROP\n', "id > 0"]
    for _ in range(2):
        q = streaming.write_opl(streaming.read_opl(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", filters)
        assert q.awaitTermination(120)
        (tmp_path / "in" / "b.opl").write_text("n3 v1 Tname=y x1 y2\n")
    lines = sorted(x["value"] for x in spark.read.text(f"{tmp_path}/out").collect())
    assert lines == ["n1 v1 Tname=x,seen=yes x1.0 y2.0", "n3 v1 Tname=y,seen=yes x1.0 y2.0"]


# o5m


def one(spark, c):
    return bytes(spark.range(1).select(c).first()[0]).hex()


@pytest.mark.parametrize(("n", "want"), [(5, "05"), (127, "7f"), (323, "c302"), (16384, "808001"), (0, "00"), (128, "8001"), (-1, "ff" * 9 + "01"), (2**62, "80" * 8 + "40"), (2**31, "8080808008")])
def test_varint(spark, n, want):
    assert one(spark, o5m.varint(F.lit(n))) == want


def test_o5m_strings(spark):
    assert one(spark, o5m.string(F.lit("1inner"))) == "0031696e6e657200"
    assert one(spark, o5m.tag(F.lit("oneway"), F.lit("yes"))) == "006f6e65776179007965730" + "0"
    assert one(spark, o5m.tag(F.lit("atm"), F.lit("no"))) == "0061746d006e6f00"
    assert one(spark, o5m.user(F.lit(1020), F.lit("John"))) == "00fc07004a6f686e00"


def test_string_table():
    t = o5m.StringTable()
    assert [t.place(x) for x in (b"A", b"B", b"A", b"C", b"B", b"A", b"C")] == [None, None, 2, None, 2, 3, 1]
    small = o5m.StringTable(2)
    assert [small.place(x) for x in (b"A", b"B", b"C", b"A")] == [None, None, None, None]


def test_o5m_order(spark):
    frame = spark.createDataFrame([("way", 1), ("node", 5), ("relation", 0), ("node", -2), ("way", 0)], "type string, id long")
    assert [tuple(r) for r in o5m.ordered(frame).collect()] == [("node", -2), ("node", 5), ("way", 0), ("way", 1), ("relation", 0)]
    assert [bytes(r["bytes"]).hex() for r in o5m.header(frame.where("id = 5 or id = 1")).orderBy("id").collect()] == ["110100", "100500"]


# Tags


def test_tag_functions(spark):
    tags = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    get = lambda c: spark.range(1).select(c).first()[0]
    assert get(G.set_tag(tags, "a", "x")) == {"a": "x", "b": "2"} and get(G.set_tag(tags, "c", "x")) == {"a": "1", "b": "2", "c": "x"}
    assert get(G.rename_tag(tags, "a", "b")) == {"b": "1"} and get(G.rename_tag(tags, "x", "b")) == {"a": "1", "b": "2"} and get(G.rename_tag(tags, "a", "a")) == {"a": "1", "b": "2"}
    assert get(G.keep_tags(tags, ["b", "x"])) == {"b": "2"} and get(G.delete_tags(tags, ["b", "x"])) == {"a": "1"}
    entries = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", "1"), ("b", "2"), ("a", "3"), ("c", None))))
    assert get(G.last_wins(entries)) == {"a": "3", "b": "2"}
