"""Byte sequences of the o5m format: strings, tags, numbers, users, and the table of strings already sent."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = "unhex('00')"
TABLE_SIZE = 15_000


def string(text: Column) -> Column:
    return F.concat(F.expr(ZERO), F.encode(text, "UTF-8"), F.expr(ZERO))


def tag(key: Column, value: Column) -> Column:
    return F.concat(F.expr(ZERO), F.encode(key, "UTF-8"), F.expr(ZERO), F.encode(value, "UTF-8"), F.expr(ZERO))


def varint(number: Column) -> Column:
    """Seven bits a byte, the lowest first, all but the last with the high bit; the 64 bits are taken as unsigned."""
    n = number.cast("bigint")
    groups = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.call_function("shiftrightunsigned", n, (i * 7).cast("int")).bitwiseAND(F.lit(127).cast("bigint")))
    last = F.greatest(F.lit(1), F.size(F.filter(F.sequence(F.lit(1), F.lit(10)), lambda i: F.call_function("shiftrightunsigned", n, F.least((i - 1) * 7, F.lit(63)).cast("int")) != 0)))
    bytes_ = F.transform(F.slice(groups, 1, last), lambda g, i: F.lpad(F.hex(F.when(i < last - 1, g.bitwiseOR(F.lit(128).cast("bigint"))).otherwise(g)), 2, "0"))
    return F.unhex(F.array_join(bytes_, ""))


def user(uid: Column, name: Column) -> Column:
    return F.concat(F.expr(ZERO), varint(uid), F.expr(ZERO), F.encode(name, "UTF-8"), F.expr(ZERO))


class StringTable:
    """Newest first. A string that is in the table is sent as its place, counted from 1; another is added in front.

    Each answer depends on all strings before it, so this is for one writer's sequence.
    """

    def __init__(self, size: int = TABLE_SIZE):
        self.strings: deque[bytes] = deque(maxlen=size)

    def place(self, encoded: bytes) -> int | None:
        try:
            return self.strings.index(encoded) + 1
        except ValueError:
            self.strings.appendleft(encoded)
            return None


def ordered(elements: DataFrame) -> DataFrame:
    """Nodes, ways, relations, each by id: the order that the format wants."""
    rank = F.when(F.col("type") == "node", 0).when(F.col("type") == "way", 1).otherwise(2)
    return elements.orderBy(rank, "id")


def header(elements: DataFrame) -> DataFrame:
    """(type, id, bytes): of each element its type byte, its id as a number, and the byte that says there is no version."""
    kind = F.when(F.col("type") == "node", "10").when(F.col("type") == "way", "11").otherwise("12")
    return elements.select("type", "id", F.concat(F.unhex(kind), varint(F.col("id")), F.expr(ZERO)).alias("bytes"))
