"""OPL: a line for each element. Lines are parsed by expressions alone, so files split, and streams work too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartweave.functions.opl import unescape
from cartweave.functions.tags import last_wins
from cartweave.schema import COLUMNS, conform

_MEMBERS = "cast(array() as array<struct<type:string,ref:bigint,role:string>>)"


def _number(text: Column, sql: str) -> Column:
    return F.nullif(text, F.lit("")).try_cast(sql)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Elements of a text column, and ``error``: null, or what is wrong with the line. Blank lines and comments are left out.

    Fields may come in any order. The first letter says what the element is; a payload of another kind is an error.
    """
    text = F.trim(F.regexp_replace(F.col(column), r"[\r\n]+\z", ""))
    fields = F.split(text, r"\s+")
    # Of a repeated field the last counts.
    flag = lambda x: F.try_element_at(F.filter("_f", lambda f: F.left(f, F.lit(1)) == x), F.lit(-1))
    rest = lambda x: F.substring(flag(x), 2, 1 << 30)
    frame = lines.where(text != "").where(~text.startswith("#")).select(text.alias("_line"), fields.alias("_f"))
    letter = F.left(F.col("_f")[0], F.lit(1))
    kind = F.when(letter == "n", "node").when(letter == "w", "way").when(letter == "r", "relation")
    list_of = lambda x: F.filter(F.split(rest(x), ","), lambda e: e != "")

    def entry(e: Column) -> Column:
        at = F.call_function("locate", F.lit("="), e)
        return F.struct(unescape(F.call_function("substring", e, F.lit(1), at - 1)).alias("key"), unescape(F.call_function("substring", e, at + 1)).alias("value"))

    def member(e: Column) -> Column:
        head, letter = F.regexp_extract(e, "^([^@]*)@?", 1), F.left(e, F.lit(1))
        role = F.when(F.contains(e, F.lit("@")), unescape(F.regexp_extract(e, "(?s)^[^@]*@(.*)$", 1))).otherwise("")
        return F.struct(F.when(letter == "n", "node").when(letter == "w", "way").when(letter == "r", "relation").alias("type"), F.substring(head, 2, 30).try_cast("bigint").alias("ref"), role.alias("role"))

    tags = F.transform(F.filter(list_of("T"), lambda e: F.contains(e, F.lit("="))), entry)
    nodes = F.transform(list_of("N"), lambda e: F.regexp_extract(e, r"^.([^xy]*)", 1).try_cast("bigint"))
    members = F.filter(F.transform(list_of("M"), member), lambda m: m["type"].isNotNull())
    frame = frame.select(
        "_line", "_f", kind.alias("type"), F.substring(F.col("_f")[0], 2, 30).try_cast("bigint").alias("id"), _number(rest("v"), "int").alias("version"), _number(rest("c"), "bigint").alias("changeset"),
        _number(rest("i"), "int").alias("uid"), unescape(rest("u")).alias("user"), F.nullif(rest("t"), F.lit("")).alias("timestamp"), F.when(rest("d") == "V", True).when(rest("d") == "D", False).alias("visible"),
        last_wins(F.coalesce(tags, F.expr("cast(array() as array<struct<key:string,value:string>>)"))).alias("tags"),
        _number(rest("y"), "double").alias("lat"), _number(rest("x"), "double").alias("lon"), nodes.alias("nodes"), members.alias("members"),
        *(flag(x).isNotNull().alias(f"_{x}") for x in "xyNM"),
    )
    bad_number = F.lit(False)
    for x, c in (("v", "version"), ("c", "changeset"), ("i", "uid")):
        bad_number = bad_number | (F.coalesce(rest(x), F.lit("")) != "") & F.col(c).isNull()
    for x, c in (("x", "lon"), ("y", "lat")):
        bad_number = bad_number | (F.coalesce(rest(x), F.lit("")) != "") & F.col(c).isNull()
    unknown = F.exists("_f", lambda f: ~F.left(f, F.lit(1)).isin(*"nwrvdctiuTxyNM"))
    refs = F.coalesce(F.exists("nodes", lambda n: n.isNull()), F.lit(False)) | F.coalesce(F.exists("members", lambda m: m["ref"].isNull()), F.lit(False))
    wrong = (
        F.when(F.col("type").isNull() | F.col("id").isNull(), "no element id at the start")
        .when(unknown, "unknown field").when((F.coalesce(rest("d"), F.lit("V")) != "V") & (rest("d") != "D"), "visible is neither V nor D").when(bad_number | refs, "bad number")
        .when((F.col("type") == "node") & (F.col("_N") | F.col("_M")) | (F.col("type") == "way") & (F.col("_x") | F.col("_y") | F.col("_M")) | (F.col("type") == "relation") & (F.col("_x") | F.col("_y") | F.col("_N")), "fields of another type of element")
    )
    empty_nodes, empty_members = F.expr("cast(array() as array<bigint>)"), F.expr(_MEMBERS)
    out = frame.select(
        *(c for c in COLUMNS if c not in ("nodes", "members")), F.when(F.col("type") == "way", F.coalesce("nodes", empty_nodes)).alias("nodes"), F.when(F.col("type") == "relation", F.coalesce("members", empty_members)).alias("members"),
        wrong.alias("error"), F.col("_line").alias("line"),
    )
    return out


def elements(lines: DataFrame, column: str = "value", errors: str = "raise") -> DataFrame:
    """Elements of a text column. errors: ``raise`` at the first bad line, ``drop`` bad lines, or ``keep`` columns error and line."""
    parsed = parse(lines, column)
    if errors == "keep":
        return parsed
    if errors == "drop":
        return conform(parsed.where("error is null"))
    if errors != "raise":
        raise ValueError("errors is raise, drop or keep")
    checked = F.when(F.col("error").isNull(), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("OPL: "), F.col("error"), F.lit(": "), F.left("line", F.lit(200)))).cast("string"))
    return conform(parsed.withColumn("type", checked))


def read(spark: SparkSession, path: str, errors: str = "raise") -> DataFrame:
    return elements(spark.read.text(path), errors=errors)
