"""A small PBF encoder: fixtures for the reader, and queries that read PBF from tables. Not one of the output formats."""

from __future__ import annotations

import datetime
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TYPES = {"node": 0, "way": 1, "relation": 2}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zig(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def _number(key: int, n: int) -> bytes:
    return _varint(key << 3) + _varint(n)


def _bytes(key: int, b: bytes) -> bytes:
    return _varint(key << 3 | 2) + _varint(len(b)) + b


def _packed(key: int, numbers: Iterable[int]) -> bytes:
    return _bytes(key, b"".join(map(_varint, numbers)))


def _deltas(key: int, numbers: list[int]) -> bytes:
    return _packed(key, (_zig(b - a) for a, b in zip([0, *numbers], numbers, strict=False)))


def _seconds(stamp: str | None) -> int:
    return int((datetime.datetime.fromisoformat(stamp.replace("Z", "+00:00")) - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)).total_seconds()) if stamp else 0


def _blob(kind: bytes, data: bytes, compress: bool = True) -> bytes:
    blob = _number(2, len(data)) + _bytes(3, zlib.compress(data)) if compress else _bytes(1, data)
    head = _bytes(1, kind) + _number(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


class _Strings:
    def __init__(self):
        self.at = {b"": 0}

    def __call__(self, s: str | None) -> int:
        return self.at.setdefault((s or "").encode(), len(self.at))

    def message(self) -> bytes:
        return b"".join(_bytes(1, s) for s in self.at)


def _info(e: dict, s: _Strings) -> bytes:
    if all(e.get(k) is None for k in ("version", "timestamp", "changeset", "uid", "user", "visible")):
        return b""
    out = _number(1, -1 if e.get("version") is None else e["version"])
    if e.get("timestamp"):
        out += _number(2, _seconds(e["timestamp"]))
    for key, name in ((3, "changeset"), (4, "uid")):
        if e.get(name) is not None:
            out += _number(key, e[name])
    if e.get("user"):
        out += _number(5, s(e["user"]))
    if e.get("visible") is not None:
        out += _number(6, int(e["visible"]))
    return _bytes(4, out)


def block(elements: Iterable[dict], dense: bool = True, compress: bool = True) -> bytes:
    """A data blob of elements, dicts with the names of the element columns. Dense nodes have metadata if all of them have."""
    s, groups = _Strings(), []
    elements = list(elements)
    nodes = [e for e in elements if e["type"] == "node"]
    scaled = lambda x: round(x * 1e7)
    tags = lambda e: (_packed(2, (s(k) for k in e["tags"])) + _packed(3, (s(v) for v in e["tags"].values()))) if e.get("tags") else b""
    if nodes and dense:
        out = _deltas(1, [e["id"] for e in nodes])
        if all(e.get("version") is not None for e in nodes):
            info = _packed(1, (e["version"] for e in nodes)) + _deltas(2, [_seconds(e.get("timestamp")) for e in nodes])
            info += _deltas(3, [e.get("changeset") or 0 for e in nodes]) + _deltas(4, [e.get("uid") or 0 for e in nodes]) + _deltas(5, [s(e.get("user")) for e in nodes])
            out += _bytes(5, info + _packed(6, (int(e.get("visible") is not False) for e in nodes)))
        out += _deltas(8, [scaled(e["lat"]) for e in nodes]) + _deltas(9, [scaled(e["lon"]) for e in nodes])
        if any(e.get("tags") for e in nodes):
            out += _packed(10, (x for e in nodes for x in [*(y for k, v in (e.get("tags") or {}).items() for y in (s(k), s(v))), 0]))
        groups.append(_bytes(2, out))
    elif nodes:
        groups.append(b"".join(_bytes(1, _number(1, _zig(e["id"])) + tags(e) + _info(e, s) + _number(8, _zig(scaled(e["lat"]))) + _number(9, _zig(scaled(e["lon"])))) for e in nodes))
    ways = [_bytes(3, _number(1, e["id"]) + tags(e) + _info(e, s) + _deltas(8, list(e["nodes"]))) for e in elements if e["type"] == "way"]
    relations = [
        _bytes(4, _number(1, e["id"]) + tags(e) + _info(e, s) + _packed(8, (s(m["role"]) for m in e["members"])) + _deltas(9, [m["ref"] for m in e["members"]]) + _packed(10, (TYPES[m["type"]] for m in e["members"])))
        for e in elements if e["type"] == "relation"
    ]
    groups += [b"".join(x) for x in (ways, relations) if x]
    return _blob(b"OSMData", _bytes(1, s.message()) + b"".join(_bytes(2, g) for g in groups), compress)


# The same from Arrow batches, by whole columns


class _Ragged:
    """A string of bytes for each row."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data, self.sizes = data, sizes

    @classmethod
    def of(cls, numbers: np.ndarray) -> _Ragged:
        """Varints."""
        left, n = numbers.astype(np.uint64, copy=False), len(numbers)
        sizes = np.ones(n, np.int64)
        for k in range(1, 10):
            more = left >> np.uint64(7 * k) != 0
            if not more.any():
                break
            sizes += more
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = (np.repeat(left, sizes) >> (7 * place).astype(np.uint64) & np.uint64(0x7F)).astype(np.uint8)
        out[place < np.repeat(sizes - 1, sizes)] |= 0x80
        return cls(out, sizes)

    def grouped(self, counts: np.ndarray) -> _Ragged:
        """The next ``counts`` rows as one."""
        ends = np.concatenate([[0], np.cumsum(self.sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return _Ragged(self.data, np.diff(ends))

    def field(self, key: int, some: np.ndarray | None = None) -> _Ragged:
        """With key and length in front; nothing in rows that aren't ``some``, which are empty."""
        sizes = _Ragged.of(self.sizes)
        front = _beside([_Ragged(np.full(len(self.sizes), key << 3 | 2, np.uint8), np.ones(len(self.sizes), np.int64)), sizes])
        if some is not None:
            front = _Ragged(front.data[np.repeat(some, front.sizes)], front.sizes * some)
        return _beside([front, self])


def _beside(parts: list[_Ragged]) -> _Ragged:
    sizes = sum(p.sizes for p in parts)
    out, at = np.empty(sizes.sum(), np.uint8), np.cumsum(sizes) - sizes
    for p in parts:
        out[np.repeat(at - (np.cumsum(p.sizes) - p.sizes), p.sizes) + np.arange(len(p.data))] = p.data
        at = at + p.sizes
    return _Ragged(out, sizes)


def _numbers(key: int, numbers: np.ndarray) -> _Ragged:
    n = len(numbers)
    return _beside([_Ragged(np.full(n, key << 3, np.uint8), np.ones(n, np.int64)), _Ragged.of(numbers)])


def _zigs(n: np.ndarray) -> np.ndarray:
    return ((n << 1) ^ (n >> 63)).view(np.uint64)


def _differences(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.diff(n, prepend=0)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out[starts] = n[starts]
    return out


def _plain(c: pa.Array) -> np.ndarray:
    if c.null_count:
        raise ValueError("PBF: a null where an element needs a number, nodes or members")
    return c.to_numpy()


def _scaled(c: pa.Array) -> np.ndarray:
    return np.rint(_plain(c) * 1e7).astype(np.int64)


def _lists(c: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All items, and how many each row has."""
    return c.flatten(), pc.fill_null(pc.list_value_length(c), 0).to_numpy().astype(np.int64)


def blocks(batch: pa.RecordBatch, dense: bool = True, compress: bool = True) -> bytes:
    """A data blob of a batch of elements, columns as ``block`` has names. What has metadata goes row by row."""
    bare = not any(batch.column(c).null_count < batch.num_rows for c in ("version", "timestamp", "changeset", "uid", "user", "visible") if c in batch.schema.names)
    if not bare:
        return block([r | {"tags": dict(r["tags"] or ())} for r in batch.to_pylist()], dense, compress)
    of = {t: batch.filter(pc.equal(batch.column("type"), t)) for t in TYPES}
    keys, values, counts = {}, {}, {}
    for t, b in of.items():
        if len(m := b.column("tags")):
            first, last = m.offsets[0].as_py(), m.offsets[len(m)].as_py()
            keys[t], values[t], counts[t] = m.keys[first:last], m.items[first:last], np.diff(m.offsets.to_numpy()).astype(np.int64)
    roles = [m["role"] or "" for x in of["relation"].column("members").to_pylist() for m in x] if "members" in batch.schema.names else []
    if not keys:
        return _blob(b"OSMData", _bytes(1, _bytes(1, b"")), compress)
    table = pa.concat_arrays([*keys.values(), *values.values(), pa.array(roles, pa.string())]).dictionary_encode()
    if table.null_count:
        raise ValueError("PBF: a tag without a value")
    number, at, k, v = table.indices.to_numpy().astype(np.uint64) + np.uint64(1), 0, {}, {}  # 0 is the empty string
    for where, texts in ((k, keys), (v, values)):
        for t, x in texts.items():
            where[t], at = number[at : at + len(x)], at + len(x)
    role = number[at:]

    def tags(t: str) -> list[_Ragged]:
        return [_Ragged.of(x[t]).grouped(counts[t]).field(key, counts[t] > 0) for key, x in ((2, k), (3, v))]

    groups = []
    if of["node"].num_rows:
        b, n = of["node"], of["node"].num_rows
        ids, lat, lon = _plain(b.column("id")), _scaled(b.column("lat")), _scaled(b.column("lon"))
        if dense:
            whole = lambda x: _Ragged.of(_zigs(np.diff(x, prepend=0))).data.tobytes()
            out = _bytes(1, whole(ids)) + _bytes(8, whole(lat)) + _bytes(9, whole(lon))
            if counts["node"].any():
                pairs = np.zeros(2 * len(k["node"]) + n, np.uint64)
                place = 2 * np.arange(len(k["node"])) + np.repeat(np.arange(n), counts["node"])
                pairs[place], pairs[place + 1] = k["node"], v["node"]
                out += _bytes(10, _Ragged.of(pairs).data.tobytes())
            groups.append(_bytes(2, out))
        else:
            groups.append(_beside([_numbers(1, _zigs(ids)), *tags("node"), _numbers(8, _zigs(lat)), _numbers(9, _zigs(lon))]).field(1).data.tobytes())
    if of["way"].num_rows:
        b = of["way"]
        if b.column("nodes").null_count:
            raise ValueError("PBF: a way without nodes")
        refs, sizes = _lists(b.column("nodes"))
        nodes = _Ragged.of(_zigs(_differences(_plain(refs), sizes))).grouped(sizes).field(8)
        groups.append(_beside([_numbers(1, _plain(b.column("id"))), *tags("way"), nodes]).field(3).data.tobytes())
    if of["relation"].num_rows:
        b = of["relation"]
        if b.column("members").null_count:
            raise ValueError("PBF: a relation without members")
        members, sizes = _lists(b.column("members"))
        refs, kinds = _plain(members.field("ref")), np.array([TYPES[x] for x in members.field("type").to_pylist()], np.uint64)
        parts = [_Ragged.of(x).grouped(sizes).field(key) for key, x in ((8, role), (9, _zigs(_differences(refs, sizes))), (10, kinds))]
        groups.append(_beside([_numbers(1, _plain(b.column("id"))), *tags("relation"), *parts]).field(4).data.tobytes())
    strings = _bytes(1, b"") + b"".join(_bytes(1, x.encode()) for x in table.dictionary.to_pylist())
    return _blob(b"OSMData", _bytes(1, strings) + b"".join(_bytes(2, g) for g in groups), compress)


def header() -> bytes:
    return _blob(b"OSMHeader", _bytes(4, b"OsmSchema-V0.6") + _bytes(4, b"DenseNodes"))
