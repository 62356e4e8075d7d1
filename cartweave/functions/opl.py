"""Text of the OPL format as expressions: escapes, coordinates, whole lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What needs no escape: printable ASCII but space % , = @, and two ranges beyond it.
PLAIN = r"\x21-\x24\x26-\x2B\x2D-\x3C\x3E-\x3F\x41-\x7E\xA1-\xAC\xAE-\x{5FF}"
_ALL_PLAIN, _PIECES = rf"\A[{PLAIN}]*\z", rf"[{PLAIN}]+|[^{PLAIN}]"


def escape(text: Column) -> Column:
    """In runs of PLAIN and single other characters: each of these as ``%`` its code point in lower-case hexadecimal ``%``."""
    piece = lambda c: F.when(c == " ", "%20%").when(c.rlike(_ALL_PLAIN), c).otherwise(F.concat(F.lit("%"), F.lower(F.hex(F.ascii(c))), F.lit("%")))
    return F.when(text.rlike(_ALL_PLAIN), text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), piece), ""))


def unescape(text: Column) -> Column:
    """The reverse. What isn't the hexadecimal number of a character gives nothing; a last ``%`` takes the rest of the text as its number."""
    common = lambda p: F.when(p == "20", " ").when(p == "2c", ",").when(p == "a", "\n").when(p == "25", "%").when(p == "3d", "=").when(p == "40", "@")
    part = lambda p: common(p).when(p.rlike(r"\A\+?0*([0-9a-fA-F]{1,5}|10[0-9a-fA-F]{4})\z") & ~p.rlike(r"(?i)\A\+?0*d[89a-f][0-9a-f]{2}\z"), _character(p)).otherwise(F.lit(""))
    pieces = F.split(text, "%", -1)
    return F.when(~F.contains(text, F.lit("%")), text).otherwise(F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(part(p))), ""))


def _character(number: Column) -> Column:
    digits = F.right(F.concat(F.lit("00000000"), F.replace(number, F.lit("+"), F.lit(""))), F.lit(8))
    return F.decode(F.unhex(digits), "UTF-32")


def coordinate(value: Column) -> Column:
    """A number with up to seven decimals, as the format has it, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.7f", value), r"0+\z", ""), r"\.\z", ".0")


def line(precise: bool = True) -> Column:
    """The OPL line of the element columns. A member without type is an error.

    ``precise`` writes coordinates so that they read back as the same double, otherwise with seven decimals.
    """
    number = _plain_number if precise else coordinate
    optional = lambda flag, c: F.coalesce(F.concat(F.lit(f" {flag}"), c), F.lit(""))
    letter = lambda t: F.when(t == "node", "n").when(t == "way", "w").when(t == "relation", "r")
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(escape(e["key"]), F.lit("="), escape(e["value"]))), ",")
    nodes = F.array_join(F.transform("nodes", lambda n: F.concat(F.lit("n"), n.cast("string"))), ",")

    def member(m: Column) -> Column:
        kind = F.coalesce(letter(m["type"]), F.raise_error(F.lit("OPL has no relation members without type")).cast("string"))
        return F.concat(kind, m["ref"].cast("string"), F.lit("@"), F.coalesce(escape(m["role"]), F.lit("")))

    members = F.array_join(F.transform("members", member), ",")
    payload = (
        F.when(F.col("type") == "node", F.concat(F.lit(" x"), F.coalesce(number(F.col("lon")), F.lit("")), F.lit(" y"), F.coalesce(number(F.col("lat")), F.lit(""))))
        .when(F.col("type") == "way", F.concat(F.lit(" N"), F.coalesce(nodes, F.lit(""))))
        .otherwise(F.concat(F.lit(" M"), F.coalesce(members, F.lit(""))))
    )
    return F.concat(
        letter(F.col("type")), F.col("id").cast("string"), optional("v", F.col("version").cast("string")), optional("d", F.when(F.col("visible"), "V").when(~F.col("visible"), "D")),
        optional("c", F.col("changeset").cast("string")), optional("t", F.col("timestamp")), optional("i", F.col("uid").cast("string")), optional("u", escape(F.col("user"))), F.lit(" T"), tags, payload,
    )


def _plain_number(c: Column) -> Column:
    """The shortest text of a double, without an exponent for the sizes that coordinates have."""
    text = c.cast("string")
    return F.when(text.contains("E"), F.coalesce(F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"(?<=\.[0-9])0+\z|(?<=[1-9])0+\z", ""), text)).otherwise(text)
