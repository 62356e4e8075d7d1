"""OSM XML. Attributes are read as text, as empty ones are no numbers.

A document that has each element on a line of its own is read by lines, which split, in a scan for each type; of any other layout, rows of nodes, ways
and relations are read by their tags, in such scans of one task for each document.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from xml.parsers import expat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartweave.functions.tags import last_wins
from cartweave.schema import TYPES, Metadata, conform
from cartweave.sources.lines import Commas, Layout, layout

_SHARED = ", ".join(f"_{x} string" for x in ("id", "user", "uid", "visible", "version", "changeset", "timestamp"))
_TAGS = "tag array<struct<_k:string,_v:string>>"
_ROWS = {
    "node": f"{_SHARED}, _lat string, _lon string, {_TAGS}",
    "way": f"{_SHARED}, nd array<struct<_ref:string>>, {_TAGS}",
    "relation": f"{_SHARED}, member array<struct<_type:string,_ref:string,_role:string>>, {_TAGS}",
}


_OPTIONS = {"ignoreSurroundingSpaces": "false", "nullValue": "\x00", "mode": "FAILFAST"}


def _scan(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").options(rowTag=tag, **_OPTIONS).schema(schema).load(path)


def _number(c: str | Column, sql: str) -> Column:
    return F.nullif(F.trim(c), F.lit("")).try_cast(sql)


def _bad(c: str | Column, sql: str) -> Column:
    """There is something that is no number."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("")).rlike(".") & _number(c, sql).isNull()


# Elements on lines of their own

def _kind(line: Column) -> Column:
    return F.regexp_extract(line, r"\A<(node|way|relation)[\s/>]", 1)


def _whole(line: Column) -> Column:
    """One element and nothing else. ``<`` stands only before tags, as values can't hold it, and where nothing is a comment."""
    kind, markup = _kind(line), F.contains(line, F.lit("<!")) | F.contains(line, F.lit("<?"))
    times = lambda x: F.size(F.split(line, x)) - 1
    empty = (times("<") == 1) & line.endswith("/>")
    ended = (times("</(node|way|relation)") == 1) & (times("<(node|way|relation)") == 1) & line.endswith(F.concat(F.lit("</"), kind, F.lit(">")))
    return ~markup & (empty | ended)


def _ends(before: str, after: str, n: int, commas: Commas) -> tuple[str, list[str], str] | None:
    start, stop, open_, inside = 0, 0, [], []
    data = before.encode()
    parser = expat.ParserCreate()

    def opened(name, attributes):
        nonlocal start, stop
        if not open_:
            start = parser.CurrentByteIndex
        elif len(open_) == 1 and not stop:
            stop = parser.CurrentByteIndex
        if len(open_) == 1 and name in TYPES:
            inside.append([parser.CurrentByteIndex, None])
        open_.append(name)

    def closed(name):
        open_.pop()
        if len(open_) == 1 and name in TYPES:
            at = parser.CurrentByteIndex
            inside[-1][1] = data.index(b">", at) + 1 if data[at : at + 2] == b"</" else None

    parser.StartElementHandler, parser.EndElementHandler = opened, closed
    try:
        parser.Parse(data + b"</osm>", True)
        if not re.search(r"<osm\b", before) or re.search(r"encoding\s*=\s*[\"'](?!utf-8)", before, re.I) or any(e[1] is None for e in inside):
            return None
        if any(e.tag in TYPES for e in ET.fromstring(f"<osm>{after}").iter()):
            return None
    except (expat.ExpatError, ET.ParseError):
        return None
    return data[start : stop or len(data)].decode(), [data[a:b].decode() for a, b in inside], after


def by_lines(spark: SparkSession, path: str) -> Layout | None:
    return layout(spark, path, lambda line: _kind(line) != "", _whole, lambda line: line, _ends)


def _elements(spark: SparkSession, path: str, kind: str, errors: str, lines: Layout | None) -> DataFrame:
    if lines:
        some = lines.elements.select(F.when(_kind(F.col("value")) == kind, F.col("value")).alias("value")).where("value is not null")
        rows = some.select(F.col("value").isNull().alias("_other"), F.from_xml("value", _ROWS[kind], _OPTIONS).alias("e")).select("_other", "e.*")
    else:
        rows = _scan(spark, path, kind, _ROWS[kind]).withColumn("_other", F.lit(False))
    entries = F.transform(F.coalesce("tag", F.expr("cast(array() as array<struct<_k:string,_v:string>>)")), lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value")))
    numbers = {"id": "bigint", "version": "int", "changeset": "bigint", "uid": "int", "visible": "boolean"} | ({"lat": "double", "lon": "double"} if kind == "node" else {})
    out = {"type": F.lit(kind), "user": F.col("_user"), "timestamp": F.nullif("_timestamp", F.lit("")), "tags": last_wins(entries)} | {c: _number(f"_{c}", sql) for c, sql in numbers.items()}
    wrong = [F.when(_bad(f"_{c}", sql), F.lit(f"a bad {c}")) for c, sql in numbers.items()]
    some = lambda c, f: F.coalesce(F.exists(c, f), F.lit(False))
    if kind == "way":
        out["nodes"] = F.coalesce(F.transform("nd", lambda n: _number(n["_ref"], "bigint")), F.expr("cast(array() as array<bigint>)"))
        wrong.append(F.when(some("nd", lambda n: _number(n["_ref"], "bigint").isNull()), F.lit("a bad node reference")))
    elif kind == "relation":
        member = lambda m: F.struct(F.nullif(m["_type"], F.lit("")).alias("type"), _number(m["_ref"], "bigint").alias("ref"), m["_role"].alias("role"))
        out["members"] = F.coalesce(F.transform("member", member), F.expr("cast(array() as array<struct<type:string,ref:bigint,role:string>>)"))
        wrong.append(F.when(some("member", lambda m: _number(m["_ref"], "bigint").isNull() | ~F.coalesce(F.nullif(m["_type"], F.lit("")), F.lit("node")).isin(*TYPES)), F.lit("a bad member")))
    missing = out["id"].isNull() | (out["lat"].isNull() | out["lon"].isNull() if kind == "node" else F.lit(False))
    error = F.when(~F.col("_other"), F.coalesce(*wrong, F.when(missing, F.lit("no id or coordinates"))))
    rows = rows.select(*(c.alias(n) for n, c in out.items()), error.alias("_error"))
    if errors == "drop":
        return rows.where("_error is null").drop("_error")
    failed = F.raise_error(F.concat(F.lit(f"XML: a {kind} with "), F.col("_error"), F.lit(": id "), F.coalesce(F.col("id").cast("string"), F.lit("none")))).cast("string")
    return rows.withColumn("type", F.when(F.col("_error").isNull(), F.col("type")).otherwise(failed)).drop("_error")


def read(spark: SparkSession, path: str, errors: str = "raise", lines: Layout | None = None) -> DataFrame:
    """Nodes, then ways, then relations. Missing attributes are null, a missing list is empty; of equal tag keys the last counts.

    An element without id or coordinates, with a number that is none, or with a member of no known type is an error, or with ``drop`` left out.
    """
    if errors not in ("raise", "drop"):
        raise ValueError("errors is raise or drop")
    lines = lines or by_lines(spark, path)
    node, way, relation = (conform(_elements(spark, path, k, errors, lines)) for k in _ROWS)
    return node.unionByName(way).unionByName(relation)


def metadata(spark: SparkSession, path: str, lines: Layout | None = None) -> Metadata:
    names = list(Metadata().as_dict())
    if lines:
        top = ET.fromstring("".join(lines.ends[0]))
        return Metadata(**{x: top.get(x) for x in names})
    rows = _scan(spark, path, "osm", ", ".join(f"_{x} string" for x in names)).limit(1).collect()
    return Metadata(**{x: rows[0][f"_{x}"] for x in names}) if rows else Metadata()
