import json
import os
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from cartweave.errors import UnknownInputFormat, UnknownOutputFormat
from cartweave.functions import opl as opl_text
from cartweave.operators import sinks
from cartweave.schema import ELEMENT, Metadata, conform
from cartweave.sources import json as json_source
from cartweave.sources import opl, pbf, pbf_encode, registry, xml

ROWS = [
    ("node", 1, 3, 7, 5, "ann b", "2020-01-02T03:04:05Z", True, {"name": 'x, y=z@1% "q" <&>\n😀', "k": "", " lead": " v "}, 1.5, -0.0000123, None, None),
    ("node", -2, None, None, None, None, None, None, {}, 12345.6789, 179.9999999, None, None),
    ("way", 3, 1, 8, 6, "bob", "2021-01-02T03:04:05Z", False, {"highway": "residential"}, None, None, [1, -2, 1], None),
    ("way", 4, 1, 8, 6, "bob", "2021-01-02T03:04:05Z", True, {}, None, None, [], None),
    ("relation", 5, 1, 9, 6, "bob", "2021-01-02T03:04:05Z", True, {"type": "route"}, None, None, None, [("node", 1, "stop"), ("way", 3, "")]),
    ("relation", 6, 1, 9, 6, "bob", "2021-01-02T03:04:05Z", True, {}, None, None, None, []),
]
META = Metadata("0.6", 'gen "x"', "© us", "ODbL", "2022-02-02T00:00:00Z")


@pytest.fixture(scope="module")
def elements(spark):
    return spark.createDataFrame(ROWS, ELEMENT)


def rows(frame, **change):
    out = [r.asDict(recursive=True) | change for r in frame.collect()]
    return sorted(out, key=lambda r: (r["type"], r["id"]))


@pytest.mark.parametrize(
    ("text", "plain"), [("%20%", " "), ("%2c%", ","), ("%2c%%2c%", ",,"), ("%1f631%", "😱"), ("%12108%", "𒄈"), ("a%zz%b", "ab"), ("a%2c", "a,"), ("a%", "a"), ("", ""), ("%d800%", ""), ("%110000%", ""), ("%10ffff%", "\U0010ffff")]
)
def test_unescape(spark, text, plain):
    assert spark.range(1).select(opl_text.unescape(F.lit(text))).first()[0] == plain


@pytest.mark.parametrize(("plain", "text"), [(" ", "%20%"), (",", "%2c%"), ("😱", "%1f631%"), ("𒄈", "%12108%"), ("A,B", "A%2c%B"), ("ohmy😱goodness", "ohmy%1f631%goodness"), ("\n", "%a%"), ("", ""), ("é׿؀­", "é׿%600%%ad%"), ("=@%", "%3d%%40%%25%")])
def test_escape(spark, plain, text):
    assert spark.range(1).select(opl_text.escape(F.lit(plain))).first()[0] == text


def test_opl_round_trip(spark, elements, tmp_path):
    sinks.write(elements, f"{tmp_path}/x.opl", "OPL")
    assert rows(opl.read(spark, f"{tmp_path}/x.opl")) == rows(elements)
    assert "w3 v1 dD c8 t2021-01-02T03:04:05Z i6 ubob Thighway=residential Nn1,n-2,n1" in (tmp_path / "x.opl").read_text().split("\n")


def test_opl_lines(spark):
    lines = ["n1 v1 x1.5 y2 Tb=1,b=2,noequals", "w2 Nn1x1.5y2,n3", "r3 Mn1@a%20%b,w2@,x9@z,r4@q@r T", "n4 dD x y T", "", "# comment", "w5 T N", "n6 Nn1", "n7 q1 x1 y1", "z1", "n8 vx x1 y1", "é1"]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r["id"]: r for r in opl.elements(frame, errors="drop").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[1]["tags"] == {"b": "2"} and got[1]["lon"] == 1.5 and got[1]["lat"] == 2.0
    assert got[2]["nodes"] == [1, 3] and got[5]["nodes"] == []
    assert [tuple(m) for m in got[3]["members"]] == [("node", 1, "a b"), ("way", 2, ""), ("relation", 4, "q@r")]
    assert got[4]["visible"] is False and got[4]["lat"] is None
    kept = opl.elements(frame, errors="keep").where("error is not null").collect()
    assert len(kept) == 5
    with pytest.raises(Exception, match="OPL"):
        opl.elements(frame).collect()


def test_json_round_trip(spark, elements, tmp_path):
    many = elements.repartition(4)  # commas between parts too
    sinks.write(many, f"{tmp_path}/x.json", "json", META)
    doc = json.loads((tmp_path / "x.json").read_text())
    assert doc["version"] == "0.6" and doc["license"] == "ODbL" and len(doc["elements"]) == 6
    one = next(e for e in doc["elements"] if e["id"] == 3)
    assert one == {"type": "way", "nodes": [1, -2, 1], "id": 3, "changeset": 8, "timestamp": "2021-01-02T03:04:05Z", "uid": 6, "user": "bob", "version": 1, "visible": False, "tags": {"highway": "residential"}}
    assert rows(json_source.read(spark, f"{tmp_path}/x.json"), visible=0) == rows(elements, visible=0)
    assert json_source.metadata(spark, f"{tmp_path}/x.json") == Metadata("0.6", META.generator, META.copyright, META.license, None)
    sinks.write(elements, f"{tmp_path}/o.json", "overpass", META, compat=True)
    doc = json.loads((tmp_path / "o.json").read_text())
    assert doc["version"] == 0.6 and doc["osm3s"] == {"timestamp_osm_base": META.timestamp, "copyright": META.copyright} and not any("version" in e for e in doc["elements"])
    assert json_source.metadata(spark, f"{tmp_path}/o.json") == Metadata("0.6", META.generator, META.copyright, None, META.timestamp)


def test_json_chunks_and_errors(spark, tmp_path):
    nodes = spark.range(2500).selectExpr("'node' as type", "id", "cast(map() as map<string,string>) as tags", "1.0D as lat", "2.0D as lon", *(f"cast(null as {t}) as {c}" for c, t in (("version", "int"), ("changeset", "long"), ("uid", "int"), ("user", "string"), ("timestamp", "string"), ("visible", "boolean"), ("nodes", "array<bigint>"), ("members", "array<struct<type:string,ref:bigint,role:string>>")))).repartition(7)
    sinks.write(nodes, f"{tmp_path}/n.json", "json")
    assert len(json.loads((tmp_path / "n.json").read_text())["elements"]) == 2500
    sinks.write(nodes.limit(0), f"{tmp_path}/none.json", "json")
    assert json.loads((tmp_path / "none.json").read_text()) == {"version": "0.6", "elements": []}
    sinks.write(nodes, f"{tmp_path}/parts", "json", single=False)
    assert sum(len(json.loads(p.read_text())["elements"]) for p in (tmp_path / "parts").glob("part-*")) == 2500
    (tmp_path / "bad.json").write_text('{"version": 0.6, "elements": [{"type": "node", "id": 1, "lat": 1.0}]}')
    with pytest.raises(Exception, match="bad element"):
        json_source.read(spark, f"{tmp_path}/bad.json").collect()


def test_xml_round_trip(spark, elements, tmp_path):
    sinks.write(elements, f"{tmp_path}/x.osm", "osm", META)
    root = ET.parse(tmp_path / "x.osm").getroot()
    assert [e.tag for e in root] == ["node", "node", "way", "way", "relation", "relation"] and root.attrib == {"version": "0.6", "generator": META.generator, "copyright": META.copyright, "license": META.license}
    assert next(t for t in root[0].iter("tag") if t.get("k") == "name").get("v") == ROWS[0][8]["name"]
    want = rows(elements)
    for r in want:
        r["visible"] = r["visible"] is not False
    assert rows(xml.read(spark, f"{tmp_path}/x.osm")) == want
    assert xml.metadata(spark, f"{tmp_path}/x.osm") == Metadata("0.6", META.generator, META.copyright, META.license, None)


def test_xml_gaps(spark, tmp_path):
    (tmp_path / "y.xml").write_text('<osm version="0.6"><bounds minlat="1"/><relation id="9"/><node id="1" lat="1" lon="2" uid=""><tag k="a" v="1"/><tag k="a" v="null"/></node><way id="2"><tag k="x" v=" y "/></way></osm>')
    got = {r["id"]: r for r in xml.read(spark, f"{tmp_path}/y.xml").collect()}
    assert got[1]["tags"] == {"a": "null"} and got[1]["uid"] is None and got[2]["nodes"] == [] and got[2]["tags"] == {"x": " y "} and got[9]["members"] == []


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("compress", [True, False])
def test_pbf(spark, elements, tmp_path, dense, compress):
    want = rows(elements)
    for r in want:
        if r["lat"] is not None:
            r["lat"], r["lon"] = round(r["lat"] % 90, 7), round(r["lon"], 7)
        if r["version"] is not None and r["visible"] is None:
            r["visible"] = True
    with_info = [r for r in want if r["version"] is not None]
    bare = [r for r in want if r["version"] is None]
    (tmp_path / "x.pbf").write_bytes(pbf_encode.header() + b"".join(pbf_encode.block(x, dense, compress) for x in (with_info, bare)))
    got = rows(pbf.read(spark, f"{tmp_path}/x.pbf"))
    for a, b in zip(got, want, strict=True):
        assert a["lat"] == pytest.approx(b["lat"]) if b["lat"] is not None else a["lat"] is None
        assert {k: v for k, v in a.items() if k not in ("lat", "lon")} == {k: v for k, v in b.items() if k not in ("lat", "lon")}


@pytest.mark.parametrize("dense", [True, False])
def test_pbf_by_columns(monkeypatch, dense):
    """Elements without metadata are encoded and decoded by whole columns, not one by one, and are the same; a key that comes twice is left to rows."""
    import pyarrow as pa

    rows = [{"type": t, "id": i, "tags": tags, "lat": i / 7 if t == "node" else None, "lon": -i / 3 if t == "node" else None, "nodes": [i << 40, -1, i][: i % 4] if t == "way" else None,
             "members": [{"type": "way", "ref": -i, "role": "r"}, {"type": "node", "ref": 1 << 50, "role": ""}][: i % 3] if t == "relation" else None}
            for i, (t, tags) in enumerate((t, tags) for t in ("node", "way", "relation") for tags in ([], [("a", "é"), ("", "")], [("k", "x" * 300)], []))]
    types = dict(zip(ELEMENT.names, pbf._ARROW, strict=True))
    batch = lambda rows: pa.RecordBatch.from_pylist(rows, pa.schema([(c, types[c]) for c in rows[0]]))
    blob = lambda data: data[4 + int.from_bytes(data[:4], "big") :]
    read = lambda data: [{c: r[c] for c in rows[0]} for b in pbf.decode(blob(data)) for r in b.to_pylist()]
    by_rows = pbf_encode.block([r | {"tags": dict(r["tags"])} for r in rows], dense=False)
    near = [r | ({"lat": pytest.approx(r["lat"], abs=1e-7), "lon": pytest.approx(r["lon"], abs=1e-7)} if r["type"] == "node" else {}) for r in rows]
    assert read(by_rows) == near and read(pbf_encode.blocks(batch(rows), dense)) == near and read(pbf_encode.blocks(batch(rows).slice(3), dense)) == near[3:]
    twice = [rows[5] | {"tags": [("a", "1"), ("b", "2"), ("a", "3")]}]
    assert read(pbf_encode.blocks(batch(twice), dense)) == [twice[0] | {"tags": [("a", "3"), ("b", "2")]}]
    for f in ("node", "dense", "way"):
        monkeypatch.setattr(pbf._Block, f, None)
    monkeypatch.setattr(pbf_encode, "block", None)
    assert read(pbf_encode.blocks(batch(rows), dense)) == near


def test_formats_by_name():
    assert registry.resolve(None, "a/b.osm.PBF") == "pbf" and registry.resolve("OSM", "x.json") == "xml" and registry.resolve("Overpass", None, output=True) == "overpass"
    for bad in (("overpass", None), (None, "x"), ("o5m", None), (None, None), (None, "a.b/c")):
        with pytest.raises(UnknownInputFormat):
            registry.resolve(*bad)
    for bad in ("pbf", "o5m"):
        with pytest.raises(UnknownOutputFormat):
            registry.resolve(bad, None, output=True)


def test_all_sources_agree(spark, elements, tmp_path):
    some = elements.where("version is not null")
    for fmt in ("opl", "json", "xml"):
        sinks.write(some, f"{tmp_path}/a.{fmt}", fmt, ordered=True)
    got = [rows(registry.read_osm(spark, f"{tmp_path}/a.{fmt}")[0], visible=0) for fmt in ("opl", "json", "xml")]
    assert got[0] == got[1] == got[2]


def test_xml_mistakes(spark, tmp_path):
    """Numbers that are none, and members of no known type, are errors; or are left out."""
    good = '<node id="1" lat="1" lon="2" uid="" version="3"/><way id="5"><nd ref="1"/></way><relation id="6"><member type="way" ref="5" role=""/></relation>'
    bad = ['<node id="x" lat="1" lon="2"/>', '<node id="2" lat="1" lon="2" uid="y"/>', '<node id="2" lat="a" lon="2"/>', '<way id="7"><nd ref="z"/></way>', '<relation id="8"><member type="area" ref="5" role=""/></relation>', '<relation id="8"><member type="way" ref="" role=""/></relation>']
    for i, line in enumerate(bad):
        path = f"{tmp_path}/{i}.xml"
        with open(path, "w") as f:
            f.write(f'<osm version="0.6">{good}{line}</osm>')
        with pytest.raises(Exception, match="XML: a "):
            xml.read(spark, path).collect()
        assert sorted(r["id"] for r in xml.read(spark, path, errors="drop").collect()) == [1, 5, 6]


def test_xml_control_characters(spark, tmp_path):
    rows = spark.createDataFrame([("node", 1, {"k": "a\x01b\x0b￾\tc"}, 1.0, 2.0)], "type string, id long, tags map<string,string>, lat double, lon double")
    sinks.write(conform(rows), f"{tmp_path}/c.xml", "xml")
    (r,) = xml.read(spark, f"{tmp_path}/c.xml").collect()
    assert r["tags"] == {"k": "a�b��\tc"}


def test_failed_write_leaves_what_was_there(spark, tmp_path):
    rows = conform(spark.createDataFrame([("node", 1, {"k": "v"}, 1.0, 2.0)], "type string, id long, tags map<string,string>, lat double, lon double"))
    path = f"{tmp_path}/d.json"
    sinks.write(rows, path, "json")
    before = open(path).read()
    with pytest.raises(Exception, match="on purpose"):
        sinks.write(rows.withColumn("type", F.raise_error(F.lit("on purpose")).cast("string")), path, "json")
    assert open(path).read() == before and [x for x in os.listdir(tmp_path) if "whole" in x or "parts" in x] == []


def spread(frame):
    """How many tasks read text of the frame."""
    return frame.rdd.getNumPartitions()


LAYOUTS = {
    "lines": '{"version":"0.6","generator":"]g[","elements":[\n%s\n%s\n]}\n',
    "pretty": '{\n "version": "0.6",\n "elements": [\n%s\n%s\n ],\n "generator": "]g["\n}',
    "one line": '{"other":[{"elements":[1]},[]],"version":"0.6","elements":[%s%s],"generator":"]g["}',
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_json_layouts(spark, tmp_path, layout):
    """Whatever lines a document has, its elements are the same; only those on lines of their own are read by lines."""
    one, two = {"type": "node", "id": 1, "lat": 1.5, "lon": 2.0, "tags": {"a": 'x"},{"\\', "é}": "{["}}, {"type": "way", "id": 2, "nodes": [1, 1], "tags": {}}
    indent = 1 if layout == "pretty" else None
    path = tmp_path / "x.json"
    path.write_text(LAYOUTS[layout] % (json.dumps(one, indent=indent), "," + json.dumps(two, indent=indent)))
    assert (json_source.by_lines(spark, str(path)) is not None) == (layout == "lines")
    elements, meta = registry.read_osm(spark, str(path))
    got = rows(elements)
    assert [(r["id"], r["tags"], r["nodes"]) for r in got] == [(1, one["tags"], None), (2, {}, [1, 1])]
    assert meta.version == "0.6" and meta.generator == "]g["


def test_json_document_splits(spark, elements, tmp_path):
    """A document of the sink is read by several tasks, not as one row of all its elements."""
    nodes = spark.range(3000).selectExpr("'node' as type", "id", "map('k', repeat('x', 400)) as tags", "1.0D as lat", "2.0D as lon")
    sinks.write(conform(nodes.repartition(3)), f"{tmp_path}/n.json", "json", META)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        back = json_source.read(spark, f"{tmp_path}/n.json")
        assert spread(back) > 3 and sorted(r[0] for r in back.select("id").collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("fmt", ["json", "overpass", "xml"])
def test_conditions_on_elements_by_lines(spark, elements, tmp_path, fmt):
    """Conditions that Spark moves down to the lines are not tested on lines that are no elements."""
    path = f"{tmp_path}/x.{'xml' if fmt == 'xml' else 'json'}"
    sinks.write(elements.where("type = 'relation'").coalesce(1), path, fmt, META)
    back, _ = registry.read_osm(spark, path)
    assert back.select("id", F.posexplode("members").alias("i", "m")).count() == 2
    assert back.where("type = 'node' or size(members) > 1 and version = 1").count() == 1


def test_json_broken_documents(spark, tmp_path):
    node = '{"type":"node","id":%d,"lat":1,"lon":2}'
    two = (node % 1, node % 2)
    for i, text in enumerate(('{"elements":[\n%s\n%s\n]}' % two, '{"elements":[%s,%s]' % two, '{"elements":[\n%s\n,%s\n' % two, '{"elements":[%s,,%s]}' % two, '{"elements":[%s,5,%s]}' % two, '{"elements":[%s,%s,]}' % two, '{"elements":[%s,{"type":"node}]}' % two[0], '{"elements":[\n%s\n,null\n,%s\n]}' % two)):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(Exception, match="JSON|MALFORMED"):
            json_source.read(spark, f"{tmp_path}/{i}.json").collect()
    (tmp_path / "e.json").write_text('{"elements":[]}')
    (tmp_path / "n.json").write_text('{"version":1}')
    (tmp_path / "z.json").write_text("")
    assert [json_source.read(spark, f"{tmp_path}/{x}.json").count() for x in "enz"] == [0, 0, 0]
    assert [r["id"] for r in json_source.read(spark, f"{tmp_path}/7.json", "drop").orderBy("id").collect()] == [1, 2]


def test_xml_document_splits(spark, tmp_path):
    """A document of the sink is read by several tasks."""
    nodes = spark.range(3000).selectExpr("'node' as type", "id", "map('k', concat(repeat('x', 400), '</node> <!-- >')) as tags", "1.0D as lat", "2.0D as lon")
    sinks.write(conform(nodes.repartition(3)), f"{tmp_path}/n.xml", "xml", META)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        back, meta = registry.read_osm(spark, f"{tmp_path}/n.xml")
        assert spread(back) > 9 and sorted(tuple(r) for r in back.selectExpr("id", "right(tags['k'], 14)").collect()) == [(i, "</node> <!-- >") for i in range(3000)]
        assert meta == Metadata("0.6", META.generator, META.copyright, META.license, None)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_xml_comments(spark, tmp_path):
    """Lines within comments are no elements, in documents that are otherwise read by lines."""
    node = '<node id="%d" lat="1" lon="2"><tag k="a" v="b > c"/></node>'
    head, end = '<?xml version="1.0"?>\n<osm version="0.6">\n <bounds minlat="1"/>', "</osm>\n"
    for name, body, splits in (("plain", [node % 1, node % 2, '<node id="3" lat="1" lon="2"/>'], True), ("comment", ["<!--", node % 9, "-->", node % 1, node % 2, node % 3], False), ("within", [node % 1, "<!--", node % 9, "-->", node % 2, node % 3], False)):
        (tmp_path / f"{name}.xml").write_text("\n".join([head, *body, end]))
        assert (xml.by_lines(spark, f"{tmp_path}/{name}.xml") is not None) == splits
        assert sorted(r["id"] for r in xml.read(spark, f"{tmp_path}/{name}.xml").collect()) == [1, 2, 3]


def test_escape_by_runs(spark):
    """Plain text is taken in runs: as many steps as there are runs and other characters, not one for each character."""
    frame = spark.createDataFrame([("ab cd,é=@%\n😱文x" * 50,)], "t string").select(opl_text.escape(F.col("t")).alias("e"), "t")
    assert "regexp_extract_all" in frame._jdf.queryExecution().toString()
    (r,) = frame.select("e", "t", opl_text.unescape(F.col("e")).alias("back")).collect()
    assert r["e"] == "ab%20%cd%2c%é%3d%%40%%25%%a%%1f631%%6587%x" * 50 and r["back"] == r["t"]
