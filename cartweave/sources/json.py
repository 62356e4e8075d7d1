"""OSM JSON and Overpass JSON: documents whose schema is known.

Elements are cut out as texts and parsed one by one, so no task holds a document: those on lines of their own by lines, which split; of
any other layout by one task for each document, which takes its text in order.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartweave.errors import BadElement
from cartweave.schema import TYPES, Metadata, conform
from cartweave.sources.lines import Commas, Layout, layout, raw_lines

_ELEMENT = (
    "type string, id bigint, lat double, lon double, nodes array<bigint>, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>, "
    "changeset bigint, user string, uid int, version int, timestamp string, visible boolean"
)
_HEAD = "version string, generator string, copyright string, license string, osm3s struct<timestamp_osm_base:string,copyright:string>"
_FAIL = {"mode": "FAILFAST"}


# Elements on lines of their own


def _body(line: Column) -> Column:
    """Without a comma in front or behind."""
    line = F.when(line.startswith(","), F.substring(line, 2, 1 << 30)).otherwise(line)
    return F.trim(F.when(line.endswith(","), F.left(line, F.length(line) - 1)).otherwise(line))


def _looks(line: Column) -> Column:
    """An object, but not the start of a document with its first element, in which quotes stand that no string has."""
    starts = line.startswith("{") | line.startswith(",{") | line.startswith(",") & line.rlike(r"\A,\s*\{")
    ends = line.endswith("}") | line.endswith("},") | line.endswith(",") & line.rlike(r"\}\s*,\z")
    return starts & ends & ~(F.contains(line, F.lit('"elements"')) & line.rlike(r'"elements"\s*:\s*\['))


def _whole(line: Column) -> Column:
    """One object and nothing else: put into another, the key behind it is that one's."""
    end = f"end-{uuid.uuid4().hex}"
    return F.from_json(F.concat(F.lit('{"e":'), _body(line), F.lit(f',"{end}":1}}')), f"`{end}` int")[end] == 1


def _ends(before: str, after: str, n: int, commas: Commas) -> tuple[str, list[str], str] | None:
    start = _array_start(before)
    try:
        if start is None or not after.startswith("]") or any(k == "elements" for k, _ in json.loads("{" + '"x":[' + after, object_pairs_hook=list)):
            return None
        inside = _items(before[start:])
    except ValueError:
        return None
    leading = commas.no_trail == n and (commas.no_lead == 0 if inside else commas.no_lead == min(n, 1) and (not n or commas.only_first))
    trailing = not inside and commas.no_lead == n and commas.no_trail == min(n, 1) and (not n or commas.only_last)
    return (before[:start], inside, after) if leading or trailing else None


def _array_start(text: str) -> int | None:
    """Where the elements begin, if the text is the start of a document up to these."""
    for m in list(re.finditer(r"\[", text))[:100]:
        try:
            top = json.loads(text[: m.end()] + "]}", object_pairs_hook=list)
        except ValueError:
            continue
        if top and [k for k, _ in top].count("elements") == 1 and top[-1] == ("elements", []):
            return m.end()
    return None


def _items(text: str) -> list[str]:
    """The objects of a list's start, as they are written."""
    out, at, decoder = [], 0, json.JSONDecoder()
    while at < len(text) and text[at:].strip():
        gap = re.compile(r"\s*,\s*" if out else r"\s*").match(text, at)
        if not gap or text[gap.end() : gap.end() + 1] != "{":
            raise ValueError("not a list of objects")
        _, end = decoder.raw_decode(text, gap.end())
        out.append(text[gap.end() : end])
        at = end
    return out


def by_lines(spark: SparkSession, path: str) -> Layout | None:
    return layout(spark, path, _looks, _whole, _body, _ends)


# Documents of any layout


class _Cutter:
    """Cuts the texts of elements out of a document that comes in pieces; holds one element."""

    _OUTSIDE, _INSIDE = re.compile(r'["{}\[\]]'), re.compile(r'["\\]')

    def __init__(self):
        self.text, self.at, self.string_from = "", 0, None
        self.open: list[str] = []
        self.key, self.listed, self.start, self.n = None, False, None, 0
        self.done = False

    def feed(self, piece: str) -> Iterator[str]:
        self.text += piece
        while True:
            m = (self._OUTSIDE if self.string_from is None else self._INSIDE).search(self.text, self.at)
            if m is None:
                self.at = len(self.text)
                break
            c = m.group()
            if self.string_from is not None:
                if c == "\\":
                    if m.end() == len(self.text):
                        self.at = m.start()
                        break
                    self.at = m.end() + 1
                    continue
                if len(self.open) == 1:
                    self.key = json.loads(self.text[self.string_from : m.end()], strict=False)
                self.string_from, self.at = None, m.end()
                continue
            if self.done:
                raise BadElement("JSON: text after the document")
            self.at = m.end()
            if c == '"':
                self.string_from = m.start()
            elif c in "{[":
                if not self.open and c == "[":
                    raise BadElement("JSON: the document is no object")
                if self.listed and len(self.open) == 2 and c == "{":
                    yield from self._between(m.start(), last=False)
                    self.start = m.start()
                elif len(self.open) == 1 and c == "[" and self.key == "elements":
                    self.listed, self.start, self.n = True, None, 0
                    self.text, self.at = self.text[m.end() :], 0
                self.open.append(c)
            else:
                if not self.open or self.open.pop() + c not in ("{}", "[]"):
                    raise BadElement("JSON: brackets don't match")
                if self.listed and len(self.open) == 2 and self.start is not None:
                    yield self.text[self.start : m.end()]
                    self.n, self.start = self.n + 1, None
                    self.text, self.at = self.text[m.end() :], 0
                elif self.listed and len(self.open) == 1:
                    yield from self._between(m.start(), last=True)
                    self.listed = False
                self.done = not self.open
        if not self.listed and self.string_from is None:
            self.text, self.at = self.text[self.at :], 0

    def _between(self, end: int, last: bool) -> Iterator[str]:
        """What stands between elements: commas, and nulls, which are bad elements."""
        items = [x.strip() for x in self.text[:end].split(",")]
        if self.n and not last and len(items) < 2 or self.n and items.pop(0) or not last and items.pop():
            raise BadElement(f"JSON: no comma between elements: {self.text[:end].strip()[:200]}")
        if last and not self.n and items == [""]:
            return
        for x in items:
            if x != "null":
                raise BadElement(f"JSON: bad element {x[:200]}")
            self.n += 1
            yield "{}"

    def end(self) -> None:
        if self.open or self.string_from is not None:
            raise BadElement("JSON: the document ends too early")


def _in_order(spark: SparkSession, path: str) -> DataFrame:
    """Texts of elements; a task for each document."""
    pieces = raw_lines(spark, path, "}", (1 << 31) - 1).select("file", "size", "block", "row", "value", F.octet_length("value").alias("bytes"))
    pieces = pieces.repartition("file").sortWithinPartitions("file", "block", "row").select("file", "size", "value", "bytes")

    def run(batches):
        import pyarrow as pa

        file, cutter, held, left = None, None, None, 0

        def ended() -> list[str]:
            # The last piece has a brace behind it if all bytes are then accounted for (a byte order mark has 3); of compressed files that isn't known.
            brace = left in (0, 3) or left not in (-1, 2) and bool(cutter.open)
            out = list(cutter.feed(held + "}" if brace else held))
            cutter.end()
            return out

        for b in batches:
            out = []
            for name, size, value, n in zip(*(b.column(c).to_pylist() for c in ("file", "size", "value", "bytes")), strict=True):
                if name != file:
                    if cutter:
                        out += ended()
                    file, cutter, held, left = name, _Cutter(), None, size
                if held is not None:
                    out += cutter.feed(held + "}")
                held, left = value, left - n - 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        if cutter:
            yield pa.RecordBatch.from_arrays([pa.array(ended(), pa.string())], ["value"])

    return pieces.mapInArrow(run, "value string")


def read(spark: SparkSession, path: str, errors: str = "raise", lines: Layout | None = None) -> DataFrame:
    """Elements. What lacks its type, id, coordinates, nodes or members, or has a member of no known type, is an error.

    lines: what ``by_lines`` has found, if it was asked before.
    """
    lines = lines or by_lines(spark, path)
    texts = lines.elements if lines else _in_order(spark, path)
    rows = texts.select("value", F.from_json("value", _ELEMENT, _FAIL).alias("e")).select("value", "e.*")
    bad_member = F.coalesce(F.exists("members", lambda m: m["type"].isNotNull() & ~m["type"].isin(*TYPES) | m["ref"].isNull()), F.lit(False))
    missing = (F.col("type") == "node") & (F.col("lat").isNull() | F.col("lon").isNull()) | (F.col("type") == "way") & F.col("nodes").isNull() | (F.col("type") == "relation") & F.col("members").isNull()
    good = F.coalesce(F.col("type").isin(*TYPES) & F.col("id").isNotNull() & ~missing & ~bad_member, F.lit(False))
    if errors == "drop":
        return conform(rows.where(good))
    checked = F.when(good | F.col("value").isNull(), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("JSON: bad element "), F.left(F.to_json(F.struct(*rows.columns[1:])), F.lit(200)))).cast("string"))
    return conform(rows.withColumn("type", checked))


def metadata(spark: SparkSession, path: str, lines: Layout | None = None) -> Metadata:
    """Of the part ``osm3s`` if there is one, which Overpass writes, else of the top."""
    if lines:
        row = spark.createDataFrame(["".join(lines.ends[0])], "string").select(F.from_json("value", _HEAD, _FAIL).alias("h")).select("h.*").collect()
    else:
        row = spark.read.schema(_HEAD).option("multiLine", True).options(**_FAIL).json(path).limit(1).collect()
    if not row:
        return Metadata()
    r, over = row[0], row[0]["osm3s"]
    return Metadata(r["version"], r["generator"], over["copyright"] if over else r["copyright"], r["license"], over["timestamp_osm_base"] if over else None)
