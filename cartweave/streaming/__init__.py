"""Streams of OPL lines. Filters work on a row at a time, so they run unchanged on streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from cartweave.operators.filters import apply_filters
from cartweave.operators.sinks import written_lines
from cartweave.sources import opl


def read_opl(spark: SparkSession, folder: str, errors: str = "drop", **options: str) -> DataFrame:
    """A stream of elements from the OPL files that come into a folder. Bad lines are dropped, or kept with their error."""
    return opl.elements(spark.readStream.options(**options).text(folder), errors=errors)


def write_opl(elements: DataFrame, folder: str, checkpoint: str, filters: Iterable[str] = (), **trigger):
    """Starts a query that writes what the filters keep as OPL files."""
    lines = written_lines("opl")(apply_filters(elements, filters)).select("value")
    return lines.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
