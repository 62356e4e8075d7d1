"""Byte-level BPE over a global shuffle of distinct words.

``encode`` cuts texts into pre-tokens. Each task gathers documents into blocks and keeps, for a block, its distinct words and the
sequence of pre-tokens as numbers of these words: that is every pre-token with its position. The words are dealt by their hash,
so that equal words of all blocks meet in one task, which encodes each distinct word once; the ids go back to the blocks, and
the blocks put them together by position. A row of the shuffle holds the words that one block sends to one bucket, so a word
that is in every text is one entry for each block. Blocks have a bounded size, and there is a bucket for each ``BUCKET_BYTES`` of text,
so that tasks don't grow with the data. A block that doesn't get all its words back is an error.

``decode`` joins the token-byte table, a file of bounded size that each task reads once: ids are probed in it by whole arrays.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
import heapq
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from .shared import cut, returning, set_apart, text_bytes

BLOCK_BYTES, BUCKET_BYTES = 8_000_000, 64_000_000
MAX_TABLE_BYTES = 64_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A file of lines ``base64(token) rank``."""
    if os.path.getsize(path) > MAX_TABLE_BYTES:
        raise ValueError(f"{path} has more than {MAX_TABLE_BYTES} bytes; a token table is sent to every task")
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: again and again the adjacent pair of the lowest rank (the leftmost of equals) becomes one part."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of the two parts has changed since
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


@functools.cache
def _tools(table: str, pattern: str):
    return regex.compile(pattern, regex.V0), read_ranks(table)


def _packed(*parts: bytes) -> bytes:
    """Byte strings, compressed together."""
    raw = b"".join([struct.pack("<q", len(x)) + x for x in parts])
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(x: bytes) -> list[bytes]:
    raw = pa.Codec("zstd").decompress(x[8:], struct.unpack_from("<q", x)[0], asbytes=True)
    out, at = [], 0
    while at < len(raw):
        size = struct.unpack_from("<q", raw, at)[0]
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers with their lowest bytes first, then the next, as these compress better apart."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _joined(words: list[bytes]) -> tuple[bytes, bytes]:
    return _planes(np.array([len(w) for w in words], np.uint32)), b"".join(words)


def _apart(sizes: bytes, flat: bytes) -> list[bytes]:
    ends = np.cumsum(_from_planes(sizes), dtype=np.int64).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_ROW = "bucket int, block string, words binary, places binary, body binary"
_NAMES = ["bucket", "block", "words", "places", "body"]


def _rows(rows: list[tuple], types=(pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], _NAMES)


def gathered(flat: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, elements one after another) of these rows of a ragged array: row i is flat[first[i] : first[i + 1]]."""
    size = first[rows + 1] - first[rows]
    at = np.repeat(first[rows] - np.cumsum(size) + size, size)
    return size, flat[at + np.arange(len(at))]


def put_together(name: str, main: bytes, parts, kind: str) -> tuple[pa.Array, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of a block's sequence and the (places, ids) of its words: doc_ids, numbers of the words of each document, and the words' ids as a ragged array.

    It is an error if not all words of the block are there, each once.
    """
    ids, null, counts, n, stream = _unpacked(main)
    ids, counts, stream = pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(null, bool)), _from_planes(counts), _from_planes(stream)
    n = struct.unpack("<q", n)[0]
    places, sizes, pool = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, kind)]
    for own, body in parts:
        size, tokens = _unpacked(body)
        places.append(np.cumsum(_from_planes(_unpacked(own)[0]), dtype=np.int64))
        sizes.append(_from_planes(size).astype(np.int64))
        pool.append(np.frombuffer(tokens, kind))
    place, size, pool = np.concatenate(places), np.concatenate(sizes), np.concatenate(pool)
    order = np.argsort(place, kind="stable")
    if len(size) != len(place) or size.sum() != len(pool) or not np.array_equal(place[order], np.arange(n)):
        raise ValueError(f"block {name} got {len(place)} of its {n} words back")
    first = np.cumsum(size) - size
    _, pool = gathered(pool, np.append(first, len(pool)), order)
    edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).tolist()
    return ids, [stream[a:b] for a, b in zip(edges, edges[1:], strict=False)], pool, np.concatenate([[0], np.cumsum(size[order])])


class TokenBytes:
    """The token-byte table by id."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        words: list[bytes] = [b""] * size
        self.known = np.zeros(size, bool)
        for word, i in ranks.items():
            words[i] = word
            self.known[i] = True
        self.flat, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words], dtype=np.int64)
        self.first = np.concatenate([[0], ends]).astype(np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, in order. An id that the table lacks is an error."""
        if len(ids) and not (ids.max() < len(self.known) and self.known[ids].all()):
            raise ValueError("an id is not in the token table")
        return gathered(self.flat, self.first, ids.astype(np.int64))[1].tobytes()


@functools.cache
def _token_bytes(table: str) -> TokenBytes:
    return TokenBytes(read_ranks(table))


def encode(docs: DataFrame, table: str, pattern: str, buckets: int | None = None, stable: bool = False) -> DataFrame:
    """(doc_id, ids): for each row of docs (doc_id, text) its token ids as little-endian unsigned 32-bit integers.

    As a library that splits by ``pattern`` and merges by the ranks in ``table`` would give, without special tokens. Null texts
    count as empty; the empty text has no ids. Rows with the same doc_id, or without one, each get their own result.

    The texts are read twice, and must come in the same order each time: ``stable`` says that docs is a table as it is stored.
    Any other frame is checkpointed first.
    """
    return _encoded(docs, table, pattern, buckets, stable, "doc_id long, ids binary", lambda ids, tokens: pa.table({"doc_id": ids, "ids": pa.array([x.tobytes() for x in tokens], pa.binary())}))


def _encoded(docs: DataFrame, table: str, pattern: str, buckets: int | None, stable: bool, schema: str, finished) -> DataFrame:
    """What ``finished`` makes of some doc_ids and the arrays of their ids, for all rows of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs if stable else cut(docs)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // BUCKET_BYTES))
    buckets = buckets or tasks

    def split(batches, words_only):
        """Rows of the words of each block, or of its sequence. A block is named by what it holds, so that both passes name it alike."""
        find, _ = _tools(table, pattern)
        number: dict[str, int] = {}
        ids, counts, stream, size = [], [], [], 0

        def block():
            words = list(number)
            raw = [w.encode() for w in words]
            flat = np.concatenate(stream)
            often = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # small numbers for frequent words
            rank = np.empty(len(words), np.uint32)
            rank[often] = np.arange(len(words), dtype=np.uint32)
            raw = [raw[x] for x in often.tolist()]
            null = np.array([x is None for x in ids])
            head = np.array([x or 0 for x in ids], np.int64).tobytes(), null.tobytes(), _planes(np.array(counts, np.uint32)), struct.pack("<q", len(words))
            body = _planes(rank[flat] if len(words) else flat)
            name = hashlib.sha256(b"".join([*head, body, *_joined(raw)])).hexdigest()[:40]
            if not words_only:
                yield _rows([(-1, name, None, None, _packed(*head, body))])
                return
            del flat, body
            to = np.array([zlib.crc32(w) for w in raw], np.uint32) % np.uint32(buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            send = [(k, order[cuts[k] : cuts[k + 1]]) for k in range(buckets) if cuts[k] < cuts[k + 1]]
            for i in range(0, len(send), 64):
                yield _rows([(k, name, _packed(*_joined([raw[x] for x in own.tolist()])), _packed(_planes(np.diff(own, prepend=0))), None) for k, own in send[i : i + 64]])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = find.findall(text or "")
                stream.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.uint32, len(found)))
                ids.append(doc_id)
                counts.append(len(found))
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield from block()
                    number.clear()
                    ids, counts, stream, size = [], [], [], 0
        if ids:
            yield from block()

    def lookup(batches):
        """Equal words are in one task here, so each distinct word is encoded once."""
        _, ranks = _tools(table, pattern)
        number: dict[bytes, int] = {}
        pool, first = array.array("I"), array.array("q", [0])  # ids of all words so far, and where each word's begin
        for b in batches:
            out = []
            for bucket, block, words, places, body in zip(*(b.column(c).to_pylist() for c in _NAMES), strict=True):
                if body is None:
                    got = np.empty(len(own := _apart(*_unpacked(words))), np.int64)
                    for i, w in enumerate(own):
                        if (x := number.get(w)) is None:
                            x = number[w] = len(number)
                            pool.extend(merged(w, ranks))
                            first.append(len(pool))
                        got[i] = x
                    size, ids = gathered(np.frombuffer(pool, np.uint32), np.frombuffer(first, np.int64), got)
                    body, words = _packed(_planes(size), ids.astype(kind).tobytes()), None
                out.append((bucket, block, words, places, body))
            yield _rows(out)

    def assemble(batches):
        """Rows come sorted by block, and in each the sequence first."""
        name, mains, parts = None, [], {}
        for b in batches:
            for bucket, block, places, body in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "places", "body")), strict=True):
                if block != name:
                    yield from blocks(name, mains, parts)
                    name, mains, parts = block, [], {}
                if bucket < 0:
                    mains.append(body)
                else:
                    parts[bucket] = places, body  # equal blocks have one name: several sequences, and the same words as often
        yield from blocks(name, mains, parts)

    def blocks(name, mains, parts):
        if parts and not mains:
            raise ValueError(f"block {name} has words, but no sequence")
        for main in mains:
            ids, sequences, pool, first = put_together(name, main, parts.values(), kind)
            for i in range(0, len(ids), 256):
                tokens = (gathered(pool, first, x)[1].astype("<u4") for x in sequences[i : i + 256])
                yield from finished(ids[i : i + 256], tokens).to_batches()

    kind = "<u2" if max(read_ranks(table).values(), default=0) < 65536 else "<u4"
    # Two passes over the texts: the words go to their buckets and come back, the sequences only go to their blocks.
    words = docs.mapInArrow(returning(lambda b: split(b, True)), _ROW).repartition(tasks, "bucket").mapInArrow(returning(lookup), _ROW)
    sequences = docs.mapInArrow(returning(lambda b: split(b, False)), _ROW)
    return words.union(sequences).repartition(tasks, "block").sortWithinPartitions("block", "bucket").mapInArrow(returning(assemble), schema)


def decode(tokens: DataFrame, table: str, into: str = "bytes") -> DataFrame:
    """tokens (ids and any other columns) with the bytes that the ids stand for, null for null ids. A column of that name is replaced."""
    tokens, back = set_apart(tokens.drop(into), "ids")
    schema = Y.StructType([*tokens.schema.fields, Y.StructField(into, Y.BinaryType())])

    def run(batches):
        for b in (big.slice(i, 500) for big in batches for i in range(0, big.num_rows, 500)):
            out = [None if x is None else _token_bytes(table).joined(np.frombuffer(x, "<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, into])

    return back(tokens.mapInArrow(returning(run), schema), into)


def report(docs: DataFrame, table: str, pattern: str, stable: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs, from real ids and real decoded bytes.

    Null texts count as empty, which has no tokens; repeated rows each have their own result. Ids are decoded in the tasks that put them together,
    so that neither they nor the bytes leave these.
    """

    def digests(ids: pa.Array, tokens) -> pa.Table:
        rows = [(len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(_token_bytes(table).joined(x)).hexdigest()) for x in tokens]
        n, encoded, decoded = zip(*rows, strict=True)
        return pa.table({"doc_id": ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(encoded), "decoded_sha256": pa.array(decoded)})

    return _encoded(docs, table, pattern, None, stable, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
