"""Sinks: elements as OPL, OSM JSON, Overpass JSON and OSM XML.

Elements become lines by expressions alone and are written in parallel as text. A document in one file is then put together by the
driver's file system client, which streams header, parts and end without holding them; ``single=False`` leaves parts, of which
each is a whole document. Elements are in no order unless ``ordered``; XML has nodes, then ways, then relations.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartweave.errors import UnknownOutputFormat
from cartweave.functions import opl as opl_text
from cartweave.schema import TYPES, Metadata

OUTPUT_FORMATS = {"json": "json", "opl": "opl", "osm": "xml", "xml": "xml", "overpass": "overpass"}


def output_format(name: str) -> str:
    if name.lower() not in OUTPUT_FORMATS:
        raise UnknownOutputFormat(f"{name!r} is none of {', '.join(sorted(OUTPUT_FORMATS))}")
    return OUTPUT_FORMATS[name.lower()]


# Elements


def json_element(compat: bool = False) -> Column:
    """An object; null parts are left out, ``visible`` is there only if false, ``tags`` only if there are some. ``compat`` omits version."""
    member = lambda m: F.struct(m["ref"].alias("ref"), m["type"].alias("type"), F.coalesce(m["role"], F.lit("")).alias("role"))
    own = lambda kind, c: F.when(F.col("type") == kind, c)
    parts = [
        F.col("type"), own("node", F.col("lat")).alias("lat"), own("node", F.col("lon")).alias("lon"), own("way", F.coalesce("nodes", F.expr("cast(array() as array<bigint>)"))).alias("nodes"),
        own("relation", F.transform("members", member)).alias("members"), F.col("id"), F.col("changeset"), F.col("timestamp"), F.col("uid"), F.col("user"), F.col("version"),
        F.when(~F.col("visible"), False).alias("visible"), F.when(F.size("tags") > 0, F.col("tags")).alias("tags"),
    ]
    if compat:
        del parts[10]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "true"})


def json_header(meta: Metadata, overpass: bool) -> str:
    quoted = lambda x: json.dumps(x, ensure_ascii=False)
    out = [f'"generator":{quoted(meta.generator)}'] if meta.generator is not None else []
    if overpass:
        base = [("timestamp_osm_base", meta.timestamp), ("copyright", meta.copyright)]
        out += ['"osm3s":{' + ",".join(f'"{k}":{quoted(v)}' for k, v in base if v is not None) + "}", '"version":0.6']
    else:
        out += [f'"{k}":{quoted(v)}' for k, v in (("copyright", meta.copyright), ("license", meta.license)) if v is not None] + ['"version":"0.6"']
    return "{" + ",".join(out) + ',"elements":['


#: Characters that no XML document may hold, not even as entities.
_NOT_XML = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"


def _xml_text(c: Column) -> Column:
    """As an attribute's value, white space included; characters that XML has no way to write become U+FFFD."""
    c = F.regexp_replace(c, _NOT_XML, "\ufffd")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def xml_element() -> Column:
    """A node, way or relation element; null attributes are left out, missing ``visible`` is true."""
    attribute = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), c, F.lit('"')), F.lit(""))
    text = lambda name: F.col(name).cast("string")
    number = opl_text._plain_number
    head = F.concat(
        attribute("lat", number(F.col("lat"))), attribute("lon", number(F.col("lon"))), attribute("id", text("id")), attribute("user", _xml_text(F.col("user"))), attribute("uid", text("uid")),
        attribute("visible", F.coalesce(F.col("visible"), F.lit(True)).cast("string")), attribute("version", text("version")), attribute("changeset", text("changeset")), attribute("timestamp", _xml_text(F.col("timestamp"))),
    )
    all_of = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ""), F.lit(""))
    nodes = all_of("nodes", lambda n: F.concat(F.lit('<nd ref="'), n.cast("string"), F.lit('"/>')))
    members = all_of("members", lambda m: F.concat(F.lit("<member"), attribute("type", m["type"]), attribute("ref", m["ref"].cast("string")), attribute("role", _xml_text(m["role"])), F.lit("/>")))
    tags = all_of(F.map_entries("tags"), lambda e: F.concat(F.lit('<tag k="'), _xml_text(e["key"]), F.lit('" v="'), _xml_text(e["value"]), F.lit('"/>')))
    return F.concat(F.lit("<"), F.col("type"), head, F.lit(">"), nodes, members, tags, F.lit("</"), F.col("type"), F.lit(">"))


def xml_header(meta: Metadata) -> str:
    """Declaration and root; the metadata's timestamp has no place here."""
    from xml.sax.saxutils import quoteattr

    parts = [f" {k}={quoteattr(v)}" for k, v in (("version", meta.version), ("generator", meta.generator), ("copyright", meta.copyright), ("license", meta.license)) if v is not None]
    return '<?xml version="1.0" encoding="UTF-8"?>' + f"<osm{''.join(parts)}>"


# Documents


def _layout(fmt: str, meta: Metadata, compat: bool) -> tuple[str, Column, str]:
    """(start, an element's line, end). A JSON line begins with a comma, which the first loses."""
    if fmt == "opl":
        return "", opl_text.line(), ""
    if fmt == "xml":
        return xml_header(meta), xml_element(), "</osm>\n"
    return json_header(meta, fmt == "overpass"), F.concat(F.lit(","), json_element(compat)), "]}\n"


def ordered_elements(elements: DataFrame) -> DataFrame:
    return elements.orderBy(F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")), "id")


def write(elements: DataFrame, path: str, fmt: str, meta: Metadata | None = None, *, single: bool = True, ordered: bool = False, compat: bool = False) -> None:
    """Writes a document, or with ``single=False`` a folder of documents. What is at the path is replaced."""
    fmt, meta = output_format(fmt), meta or Metadata()
    start, line, end = _layout(fmt, meta, compat)
    if ordered:
        elements = ordered_elements(elements)
    if not single:
        documents(elements.select("type", line.alias("value")), start, end, fmt).write.mode("overwrite").text(path)
        return
    spark = elements.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    try:
        if fmt == "xml":  # three groups in the order of the format, from one pass
            elements.select("type", line.alias("value")).write.partitionBy("type").option("lineSep", "\n").text(parts)
            folders = [f"{parts}/type={kind}" for kind in TYPES]
        else:
            elements.select(line.alias("value")).write.option("lineSep", "\n").text(parts)
            folders = [parts]
        _assembled(spark, folders, path, start, end, skip=1 if fmt in ("json", "overpass") else 0)
    finally:
        _delete(spark, parts)


def documents(lines: DataFrame, start: str, end: str, fmt: str) -> DataFrame:
    """Each partition's lines with a start and an end. OPL needs neither."""
    if fmt == "opl":
        return lines.select("value")
    if fmt == "xml":
        lines = lines.sortWithinPartitions(F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        first = True
        yield pa.RecordBatch.from_arrays([pa.array([start])], ["value"])
        for b in batches:
            values = b.column("value")
            if first and b.num_rows and fmt != "xml":
                values = pa.concat_arrays([pc.utf8_slice_codeunits(values.slice(0, 1), 1), values.slice(1)])
            first = first and not b.num_rows
            yield pa.RecordBatch.from_arrays([values], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([end.rstrip("\n")])], ["value"])

    return lines.mapInArrow(run, "value string") if fmt == "xml" else lines.select("value").mapInArrow(run, "value string")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _delete(spark: SparkSession, path: str) -> None:
    fs, p, _ = _hadoop(spark, path)
    fs.delete(p, True)


def _assembled(spark: SparkSession, folders: list[str], path: str, start: str, end: str, skip: int) -> None:
    """start, all part files in order, and end as one file; the first ``skip`` bytes of the parts are left out.

    It is put together beside the path, and takes its place when it is whole.
    """
    fs, target, jvm = _hadoop(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.whole-{uuid.uuid4().hex}")
    try:
        _streamed(fs, jvm, folders, beside, start, end, skip)
        fs.delete(target, True)
        if not fs.rename(beside, target):
            raise OSError(f"can't put the document at {path}")
    finally:
        fs.delete(beside, True)


def _streamed(fs, jvm, folders: list[str], to, start: str, end: str, skip: int) -> None:
    out = fs.create(to, True)
    try:
        out.write(start.encode())
        for folder in folders:
            if not fs.exists(jvm.org.apache.hadoop.fs.Path(folder)):
                continue
            files = sorted((s for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())
            for s in files:
                part = fs.open(s.getPath())
                try:
                    if skip:
                        part.seek(skip)
                        skip = 0
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
        out.write(end.encode())
    finally:
        out.close()


def written_lines(fmt: str, compat: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A transformation to the lines of a format, for sinks of other kinds and for streams."""
    line = _layout(output_format(fmt), Metadata(), compat)[1]
    return lambda elements: elements.select(F.col("type"), F.col("id"), line.alias("value"))
