"""PBF as a Python data source: a partition for each run of blobs, each group of elements decoded to an Arrow batch.

Planning reads only the headers of blobs. Nodes and ways without metadata are decoded by columns, others one by one, packed fields by numpy. What has no metadata has nulls; users and timestamps are
decoded, and so are the tags of dense nodes.
"""

from __future__ import annotations

import datetime
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cartweave.errors import BadElement
from cartweave.schema import ELEMENT, TYPES

RANGE_BYTES = 16_000_000
MAX_HEADER, MAX_BLOB = 64 << 10, 64 << 20
FEATURES = {b"OsmSchema-V0.6", b"DenseNodes", b"HistoricalInformation"}


def _open(path: str):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = system.get_file_info(where)
    if info.type == fs.FileType.Directory:
        files = [f.path for f in system.get_file_info(fs.FileSelector(where)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    elif info.type == fs.FileType.File:
        files = [where]
    else:
        raise FileNotFoundError(path)
    return system, sorted(files)


# Wire format


def varint(data: memoryview | bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, integer or bytes) of a message."""
    at, n = 0, len(data)
    while at < n:
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > n:
                raise BadElement("PBF: a field is longer than its message")
            value = data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value = data[at : at + size]
            at += size
        else:
            raise BadElement(f"PBF: wire type {kind}")
        yield key >> 3, value


def packed(data: memoryview) -> np.ndarray:
    """Unsigned 64-bit numbers of a packed field."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(raw < 0x80)
    start = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(last[-1] + 1) - np.repeat(start, last - start + 1)
    return np.add.reduceat((raw[: last[-1] + 1] & 0x7F).astype(np.uint64) << (place * 7).astype(np.uint64), start)


def zigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def deltas(data: memoryview) -> np.ndarray:
    return np.cumsum(zigzag(packed(data)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _zig(x: int) -> int:
    return x >> 1 ^ -(x & 1)


def _all(data: memoryview) -> dict[int, list]:
    out: dict[int, list] = {}
    for k, v in fields(data):
        out.setdefault(k, []).append(v)
    return out


def _joined(parts: list) -> memoryview:
    return parts[0] if len(parts) == 1 else memoryview(b"".join(parts))


def _numbers(message: dict, key: int) -> list[int]:
    """A repeated field, packed or not."""
    out: list[int] = []
    for v in message.get(key, ()):
        out += [v] if isinstance(v, int) else packed(v).view(np.int64).tolist()
    return out


def blobs(f) -> Iterator[tuple[str, int, int]]:
    """(type, offset, size) of the blobs of an open file."""
    f.seek(0)
    while head := f.read(4):
        if len(head) < 4:
            raise BadElement("PBF: the file ends within a header")
        size = struct.unpack(">I", head)[0]
        if size > MAX_HEADER:
            raise BadElement("PBF: not a PBF file, or a header of more than 64 KiB")
        h = _all(memoryview(f.read(size)))
        kind, length = bytes(h[1][0]).decode(), h[3][0]
        if length > MAX_BLOB:
            raise BadElement("PBF: a blob of more than 64 MiB")
        at = f.tell()
        yield kind, at, length
        f.seek(at + length)


def unpacked(blob: bytes) -> memoryview:
    b = _all(memoryview(blob))
    if 1 in b:
        return memoryview(b[1][0])
    if 3 in b:
        return memoryview(zlib.decompress(b[3][0]))
    if 4 in b:
        import lzma

        return memoryview(lzma.decompress(b[4][0]))
    for key, codec in ((6, "lz4_raw"), (7, "zstd")):
        if key in b:
            return memoryview(pa.Codec(codec).decompress(bytes(b[key][0]), b[2][0], asbytes=True))
    raise BadElement("PBF: a blob of an unknown compression")


def _stamp(ms: int) -> str:
    t = datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)
    return t.strftime("%Y-%m-%dT%H:%M:%S") + (f".{ms % 1000:03d}" if ms % 1000 else "") + "Z"


# Many messages at once


class _Uneven(Exception):
    """Messages are not of the kind that is decoded by columns; they are row by row."""


def _varints(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers at these places, and the places behind them."""
    out, end, more = np.zeros(len(at), np.uint64), at.copy(), np.ones(len(at), bool)
    for k in range(10):
        b = data[at + k]
        out |= np.where(more, (b & 0x7F).astype(np.uint64) << np.uint64(7 * k), np.uint64(0))
        end += more
        more &= b >= 0x80
        if not more.any():
            return out, end
    raise _Uneven


def _columns(data: np.ndarray, at: np.ndarray, end: np.ndarray, numbers: set[int], strings: set[int]) -> dict[int, tuple]:
    """Fields of messages, taken in step: of ``numbers`` (rows there, values), of ``strings`` (rows there, starts, sizes), each once in a message at most."""
    out: dict[int, tuple] = {}
    seen: dict[int, np.ndarray] = {}
    found: dict[int, list[tuple]] = {}
    rows = np.flatnonzero(at < end)
    at = at[rows]
    while len(rows):
        key, at = _varints(data, at)
        value, at = _varints(data, at)
        for k in np.unique(key).tolist():
            own = key == k
            if not (k & 7 == 0 and k >> 3 in numbers or k & 7 == 2 and k >> 3 in strings):
                raise _Uneven
            before = seen.setdefault(k >> 3, np.zeros(len(end), bool))
            if before[rows[own]].any():
                raise _Uneven
            before[rows[own]] = True
            if k & 7 == 0:
                found.setdefault(k >> 3, []).append((rows[own], value[own]))
            else:
                if (value[own] > np.uint64(len(data))).any():
                    raise _Uneven
                size = value[own].astype(np.int64)
                found.setdefault(k >> 3, []).append((rows[own], at[own], size))
                at[own] += size
        if (at > end[rows]).any():
            raise _Uneven
        left = at < end[rows]
        rows, at = rows[left], at[left]
    for k, parts in found.items():
        out[k] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return out


def _packed_rows(data: np.ndarray, n: int, found: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows, how many each has) of a packed field."""
    start, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if found is not None:
        start[found[0]], size[found[0]] = found[1], found[2]
    ends = np.cumsum(size)
    raw = data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if n else 0)]
    if (raw[ends[size > 0] - 1] >= 0x80).any():
        raise _Uneven
    upto = np.concatenate([[0], np.cumsum(raw < 0x80)])
    return packed(raw), np.diff(upto[np.concatenate([[0], ends])])


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


class _Block:
    """Decodes a primitive block to rows in the order of ELEMENT, and to batches where all elements of a group are alike and without metadata."""

    def __init__(self, data: memoryview):
        b = _all(data)
        self.strings = [bytes(s).decode() for s in _all(b[1][0]).get(1, ())] if 1 in b else []
        self.groups = b.get(2, [])
        self.granularity, self.date = (b.get(k, [d])[0] for k, d in ((17, 100), (18, 1000)))
        self.lat0, self.lon0 = (_signed(b.get(k, [0])[0]) for k in (19, 20))
        self.rows: list[tuple] = []
        self.same: np.ndarray | None = None

    def degrees(self, offset: int, x):
        return (offset + self.granularity * x) / 1e9

    def batches(self) -> Iterator[pa.RecordBatch]:
        for g in self.groups:
            try:
                yield self.by_columns(g)
            except _Uneven:
                self.by_rows(g)
                yield _batch(self.rows)
                self.rows = []

    def by_rows(self, g: memoryview) -> None:
        for kind, data in fields(g):
            if kind == 1:
                self.node(data)
            elif kind == 2:
                self.dense(data)
            elif kind == 3:
                self.way(data)
            elif kind == 4:
                self.relation(data)

    def by_columns(self, g: memoryview) -> pa.RecordBatch:
        data = np.concatenate([np.frombuffer(g, np.uint8), np.zeros(32, np.uint8)])
        places, at, n = [], 0, len(g)
        kind = g[0] >> 3 if n else 0
        if kind not in (1, 2, 3) or g[0] & 7 != 2:
            raise _Uneven
        first = g[0]
        while at < n:
            if g[at] != first:
                raise _Uneven
            size, at = varint(g, at + 1)
            places.append((at, at + size))
            at += size
        if at > n:
            raise _Uneven
        start, end = np.array(places, np.int64).T
        if kind == 2:
            return self.dense_columns(data, start, end)
        m = _columns(data, start, end, {1, 8, 9} if kind == 1 else {1}, {2, 3} if kind == 1 else {2, 3, 8})
        n = len(start)
        keys, counts = _packed_rows(data, n, m.get(2))
        values, others = _packed_rows(data, n, m.get(3))
        if not np.array_equal(counts, others):
            raise _Uneven
        tags = self.tag_maps(keys, values, counts)

        def number(k: int) -> np.ndarray:
            if k not in m or len(m[k][0]) != n:
                raise _Uneven
            out = np.empty(n, np.uint64)
            out[m[k][0]] = m[k][1]
            return out

        if kind == 1:
            return _bare("node", zigzag(number(1)), tags, self.degrees(self.lat0, zigzag(number(8))), self.degrees(self.lon0, zigzag(number(9))))
        refs, sizes = _packed_rows(data, n, m.get(8))
        sums = np.concatenate([[0], np.cumsum(zigzag(refs))])
        nodes = sums[1:] - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)
        return _bare("way", number(1).view(np.int64), tags, nodes=pa.ListArray.from_arrays(_offsets(sizes), pa.array(nodes, pa.int64())))

    def dense_columns(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        if len(start) != 1:
            raise _Uneven
        m = _columns(data, start, end, set(), {1, 8, 9, 10})
        if not {1, 8, 9} <= m.keys():
            raise _Uneven
        part = lambda k: _packed_rows(data, 1, m[k])[0]
        ids, lat, lon = (np.cumsum(zigzag(part(k))) for k in (1, 8, 9))
        n = len(ids)
        pairs = part(10) if 10 in m else np.zeros(n, np.uint64)
        stops = np.flatnonzero(pairs == 0)
        counts = np.diff(stops, prepend=-1) - 1
        if len(lat) != n or len(lon) != n or len(stops) != n or n and stops[-1] != len(pairs) - 1 or (counts % 2).any():
            raise _Uneven
        pairs = pairs[pairs != 0]
        return _bare("node", ids, self.tag_maps(pairs[::2], pairs[1::2], counts // 2), self.degrees(self.lat0, lat), self.degrees(self.lon0, lon))

    def tag_maps(self, keys: np.ndarray, values: np.ndarray, counts: np.ndarray) -> pa.Array:
        if len(keys) and max(keys.max(), values.max()) >= len(self.strings):
            raise _Uneven
        if self.same is None:
            first: dict[str, int] = {}
            self.same = np.array([first.setdefault(x, i) for i, x in enumerate(self.strings)] or [0], np.int64)
        of = np.repeat(np.arange(len(counts)), counts) * len(self.same) + self.same[keys.astype(np.int64)]
        if len(np.unique(of)) < len(of):  # of equal keys the last counts
            raise _Uneven
        texts = pa.array(self.strings, pa.string())
        return pa.MapArray.from_arrays(_offsets(counts), texts.take(pa.array(keys)), texts.take(pa.array(values)))

    def info(self, m: dict) -> tuple:
        if 4 not in m:
            return None, None, None, None, None, None
        i = _all(m[4][0])
        version = np.int64(_signed(i[1][0])).astype(np.int32).item() if 1 in i else -1
        visible = bool(i[6][0]) if 6 in i else True
        return (
            None if version < 0 else version, _signed(i[3][0]) if 3 in i else None, _signed(i[4][0]) if 4 in i else None, self.strings[i[5][0]] or None if 5 in i else None,
            _stamp(_signed(i[2][0]) * self.date) if 2 in i else None, visible,
        )

    def tags(self, m: dict) -> list[tuple[str, str]]:
        s = self.strings
        return list({s[k]: s[v] for k, v in zip(_numbers(m, 2), _numbers(m, 3), strict=True)}.items())

    def node(self, data: memoryview) -> None:
        m = _all(data)
        self.rows.append(("node", _zig(m[1][0]), *self.info(m), self.tags(m), self.degrees(self.lat0, _zig(m[8][0])), self.degrees(self.lon0, _zig(m[9][0])), None, None))

    def dense(self, data: memoryview) -> None:
        m = _all(data)
        if 1 not in m:
            return
        ids = deltas(_joined(m[1])).tolist()
        lat, lon = (self.degrees(o, deltas(_joined(m[k]))).tolist() for o, k in ((self.lat0, 8), (self.lon0, 9)))
        n, s = len(ids), self.strings
        none = [None] * n
        version = changeset = uid = user = stamp = visible = none
        if 5 in m:
            i = _all(m[5][0])
            some = lambda k, f: f(_joined(i[k])) if k in i else None
            if (x := some(1, packed)) is not None:
                version = [v if v >= 0 else None for v in x.view(np.int64).astype(np.int32).tolist()]
            if (x := some(2, deltas)) is not None:
                stamp = [_stamp(v * self.date) for v in x.tolist()]
            if (x := some(3, deltas)) is not None:
                changeset = x.tolist()
            if (x := some(4, deltas)) is not None:
                uid = x.tolist()
            if (x := some(5, deltas)) is not None:
                user = [s[v] or None for v in x.tolist()]
            visible = [bool(v) for v in packed(_joined(i[6])).tolist()] if 6 in i else [True] * n
        tags: list[list] = [[] for _ in range(n)]
        if 10 in m:
            kv = packed(_joined(m[10])).view(np.int64).tolist()
            at, row = 0, 0
            while at < len(kv):
                if kv[at] == 0:
                    row, at = row + 1, at + 1
                else:
                    tags[row].append((s[kv[at]], s[kv[at + 1]]))
                    at += 2
            tags = [list(dict(t).items()) for t in tags]
        self.rows += zip(["node"] * n, ids, version, changeset, uid, user, stamp, visible, tags, lat, lon, none, none, strict=True)

    def way(self, data: memoryview) -> None:
        m = _all(data)
        refs = deltas(_joined(m[8])).tolist() if 8 in m else []
        self.rows.append(("way", _signed(m[1][0]), *self.info(m), self.tags(m), None, None, refs, None))

    def relation(self, data: memoryview) -> None:
        m = _all(data)
        refs = deltas(_joined(m[9])).tolist() if 9 in m else []
        members = [{"type": TYPES[t], "ref": r, "role": self.strings[o]} for o, r, t in zip(_numbers(m, 8), refs, _numbers(m, 10), strict=True)]
        self.rows.append(("relation", _signed(m[1][0]), *self.info(m), self.tags(m), None, None, None, members))


_MEMBER = pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
_ARROW = [
    pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(_MEMBER),
]


def _bare(kind: str, ids: np.ndarray, tags: pa.Array, lat: np.ndarray | None = None, lon: np.ndarray | None = None, nodes: pa.Array | None = None) -> pa.RecordBatch:
    """Elements without metadata."""
    n = len(ids)
    own = {0: pa.repeat(kind, n), 1: pa.array(ids, pa.int64()), 8: tags} | ({9: pa.array(lat), 10: pa.array(lon)} if lat is not None else {}) | ({11: nodes} if nodes is not None else {})
    return pa.RecordBatch.from_arrays([own[i] if i in own else pa.nulls(n, t) for i, t in enumerate(_ARROW)], ELEMENT.names)


def decode(blob: bytes) -> Iterator[pa.RecordBatch]:
    """A batch for each group of elements."""
    return _Block(unpacked(blob)).batches()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _ARROW, strict=True)], ELEMENT.names)


class _Range(InputPartition):
    def __init__(self, file: str, places: list[tuple[int, int]]):
        self.file, self.places = file, places


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, files = _open(self.path)
        out: list[InputPartition] = []
        for file in files:
            places, size = [], 0
            with system.open_input_file(file) as f:
                for kind, at, length in blobs(f):
                    if kind == "OSMHeader":
                        f.seek(at)
                        need = {bytes(x) for x in _all(unpacked(f.read(length))).get(4, ())}
                        if need - FEATURES:
                            raise BadElement(f"PBF: the file needs {', '.join(sorted(x.decode() for x in need - FEATURES))}")
                    if kind != "OSMData":
                        continue
                    places.append((at, length))
                    size += length
                    if size >= RANGE_BYTES:
                        out.append(_Range(file, places))
                        places, size = [], 0
            if places:
                out.append(_Range(file, places))
        return out or [_Range("", [])]

    def read(self, partition: InputPartition):
        if not partition.places:
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.file) as f:
            for at, length in partition.places:
                f.seek(at)
                yield from decode(f.read(length))


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self):
        return ELEMENT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PbfSource)
    return spark.read.format("osm_pbf").load(path)
