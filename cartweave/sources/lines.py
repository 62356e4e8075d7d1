"""Documents that have each element on a line of its own, as the sinks write them: these split, where a document as such doesn't.

One pass over the lines finds out whether a path is of that kind, and proves it: it counts what isn't a whole element, and those few
lines, before the first element and after the last, are parsed by the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A longer line is no element of such a document. Lines of head and tail in one file, and their bytes in all files.
MAX_LINE, MAX_ODD, MAX_ODD_BYTES = 256 << 20, 64, 16 << 20
_SPACE = " \t\r"


@dataclass(frozen=True)
class Commas:
    """How many of a file's element lines lack a comma in front or behind, and whether that is only the first or the last."""

    no_lead: int
    no_trail: int
    only_first: bool
    only_last: bool


@dataclass(frozen=True)
class Layout:
    """elements: a text column ``value``, one element in each row. ends: what stands before and after the elements of each file.

    Spark may test conditions on what is parsed before the one that a line is an element: other lines are null till then, and no mistakes.
    """

    elements: DataFrame
    ends: list[tuple[str, str]]


def raw_lines(spark: SparkSession, path: str, separator: str = "\n", longest: int = MAX_LINE) -> DataFrame:
    """(value, file, size, block, row): in a file, lines are in the order of (block, row)."""
    lines = spark.read.option("lineSep", separator).option("mapreduce.input.linerecordreader.line.maxlength", longest).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACE))


def layout(
    spark: SparkSession, path: str, looks: Callable[[Column], Column], whole: Callable[[Column], Column], body: Callable[[Column], Column], ends: Callable[[str, str, int, Commas], tuple[str, list[str], str] | None]
) -> Layout | None:
    """None unless every file is of that kind.

    looks: that a trimmed line is one element, if the document is of that kind; whole proves it. body: its text. ends: of the lines before and after the
    elements, the number of elements between and their commas: (text before, elements in it, text after), or None if they aren't the ends of such a document.
    """
    # Columns of their own, so that no aggregate works them out again.
    lines = raw_lines(spark, path).withColumn("text", trimmed(F.col("value"))).withColumn("element", F.coalesce(looks(F.col("text")), F.lit(False)))
    text, element = F.col("text"), F.col("element")
    bytes_ = (F.octet_length("value") + 1).cast("bigint")
    lines = lines.withColumn("is_odd", ~element & (text != ""))
    odd = F.col("is_odd")
    counts = lines.select("file", "size", "element", "is_odd", bytes_.alias("bytes"), (element & ~F.coalesce(whole(text), F.lit(False))).alias("wrong")).groupBy("file", "size").agg(
        F.sum("bytes").alias("bytes"), F.count_if(odd).alias("odd"), F.sum(F.when(odd, F.col("bytes")).otherwise(0)).alias("odd_bytes"), F.count_if("wrong").alias("wrong"),
    )
    files = counts.collect()
    if not files or sum(r["odd_bytes"] for r in files) > MAX_ODD_BYTES or any(r["wrong"] or not 0 <= r["bytes"] - r["size"] <= 1 or not 2 <= r["odd"] <= MAX_ODD for r in files):
        return None
    # Places are those of this one job: another may cut files in other blocks.
    at = lambda c: F.when(c, F.col("row"))
    no_lead, no_trail = F.col("no_lead"), F.col("no_trail")
    marked = lines.select("file", "block", "row", "element", "is_odd", (element & ~text.startswith(",")).alias("no_lead"), (element & ~text.endswith(",")).alias("no_trail"), F.when(odd, F.col("value")).alias("value"))
    blocks = marked.groupBy("file", "block").agg(
        F.count_if(element).alias("n"), F.min(at(element)).alias("first"), F.max(at(element)).alias("last"), F.count_if(no_lead).alias("no_lead"), F.count_if(no_trail).alias("no_trail"),
        F.min(at(no_lead)).alias("bare_first"), F.max(at(no_trail)).alias("bare_last"), F.collect_list(F.when(odd, F.struct("row", "value"))).alias("odd"),
    )
    of = defaultdict(list)
    for r in blocks.collect():
        of[r["file"]].append(r)
    found, inside = [], []
    for rows in of.values():
        some = [r for r in rows if r["n"]]
        n = sum(r["n"] for r in some)
        odd_lines = sorted(((r["block"], x["row"]), x["value"]) for r in rows for x in r["odd"])
        first, last = (min((r["block"], r["first"]) for r in some), max((r["block"], r["last"]) for r in some)) if n else (odd_lines[-1][0], odd_lines[-2][0])
        before, after = [v for p, v in odd_lines if p < first], [v for p, v in odd_lines if p > last]
        if len(before) + len(after) != len(odd_lines):
            return None
        commas = Commas(
            sum(r["no_lead"] for r in some), sum(r["no_trail"] for r in some),
            [(r["block"], r["bare_first"]) for r in some if r["no_lead"]] == [first], [(r["block"], r["bare_last"]) for r in some if r["no_trail"]] == [last],
        )
        parsed = ends("\n".join(before), "\n".join(after), n, commas)
        if parsed is None:
            return None
        found.append((parsed[0], parsed[2]))
        inside += parsed[1]
    elements = lines.select(F.when(element, body(text)).alias("value")).where("value is not null")
    if inside:
        elements = elements.unionByName(spark.createDataFrame([(x,) for x in inside], "value string").coalesce(1))
    return Layout(elements, found)
