"""Input formats by name, and reading by format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartweave.errors import UnknownInputFormat, UnknownOutputFormat
from cartweave.operators.sinks import output_format
from cartweave.schema import Metadata
from cartweave.sources import json, opl, pbf, xml

INPUT_FORMATS = {"json": "json", "opl": "opl", "osm": "xml", "xml": "xml", "pbf": "pbf"}


def input_format(name: str) -> str:
    if name.lower() not in INPUT_FORMATS:
        raise UnknownInputFormat(f"{name!r} is none of {', '.join(sorted(INPUT_FORMATS))}")
    return INPUT_FORMATS[name.lower()]


def resolve(flag: str | None, path: str | None, output: bool = False) -> str:
    """The format that the flag names, else the last extension of the path: ``x.osm.pbf`` is PBF."""
    error, of = (UnknownOutputFormat, output_format) if output else (UnknownInputFormat, input_format)
    if flag is not None:
        return of(flag)
    name = (path or "").rstrip("/").rpartition("/")[2]
    if "." not in name:
        raise error("no format given, and none in the name of the path")
    return of(name.rpartition(".")[2])


def read_osm(spark: SparkSession, path: str, fmt: str | None = None, errors: str = "raise") -> tuple[DataFrame, Metadata]:
    """Elements and what the document says of itself. OPL and PBF say nothing. Bad elements are an error, or with ``errors="drop"`` left out, but in PBF."""
    fmt = resolve(fmt, path)
    if fmt == "opl":
        return opl.read(spark, path, errors), Metadata()
    if fmt == "json":
        lines = json.by_lines(spark, path)
        return json.read(spark, path, errors, lines), json.metadata(spark, path, lines)
    if fmt == "xml":
        lines = xml.by_lines(spark, path)
        return xml.read(spark, path, errors, lines), xml.metadata(spark, path, lines)
    if errors != "raise":
        raise ValueError("a damaged PBF block is always an error")
    return pbf.read(spark, path), Metadata()
