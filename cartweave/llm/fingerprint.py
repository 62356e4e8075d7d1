"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; where it meets a mask, a chunk ends. The chunking is normalised: up to ``NORMAL`` bytes a
mask with more bits holds, after that one with fewer, between ``LEAST`` and ``MOST`` bytes. A boundary depends on the bytes just
before it, so after an edit chunking falls into step again. The fingerprint is the set of chunk digests with their lengths;
containment weighs the common chunks by length against the shorter of two texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from . import text as T
from .shared import returning, set_apart, text_bytes

LEAST, NORMAL, MOST = 12, 40, 160
RANGE_BYTES = 64_000_000
HARD, EASY = np.uint32(0xFC000000), np.uint32(0xF0000000)
_GEAR = (T.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_POWER = np.multiply.accumulate(np.full(MOST, 0x9E3779B97F4A7C15, np.uint64))


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + G[data[i]], in 32 bits: the sum over the last 32 bytes, by doubling."""
    h, k = _GEAR[data], 1
    while k < 32:
        add = h[:-k] << np.uint32(k)
        h[k:] += add
        k *= 2
    return h


def boundaries(h: np.ndarray) -> list[int]:
    """Ends of the chunks of one text, by the gear hashes of its bytes."""
    n, easy = len(h), np.flatnonzero(h & EASY == 0)
    hard = easy[h[easy] & HARD == 0].tolist()
    easy = easy.tolist()
    easy.append(n + MOST)
    hard.append(n + MOST)
    out, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        low, mid, top = at + LEAST - 1, at + NORMAL - 1, at + MOST
        while hard[j] < low:
            j += 1
        end = hard[j] + 1
        if end > mid:
            while easy[i] < mid:
                i += 1
            end = min(easy[i] + 1, top)
        if end >= n:
            break
        out.append(end)
        at = end
    out.append(n)
    return out


def chunk_sets(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the digests of its distinct chunks, sorted, and their lengths in bytes."""
    ends, counts = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = boundaries(gear(data[a:b])) if b > a else []
        ends.extend(x + a for x in own)
        counts.append(len(own))
    if not ends:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return [none] * len(counts)
    ends = np.array(ends)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    at = np.arange(len(data)) - np.repeat(starts, sizes)
    digest = T.mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _POWER[at], starts)) >> np.uint64(16)
    out, i = [], 0
    for c in counts:
        d, first = np.unique(digest[i : i + c], return_index=True)
        out.append((d, sizes[i : i + c][first]))
        i += c
    return out


def written(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    """48-bit digests in hexadecimal with lengths: ``digest:length`` by digest, joined by commas."""
    return ",".join([f"{d:012x}:{n}" for d, n in zip(fingerprint[0].tolist(), fingerprint[1].tolist(), strict=True)])


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [x.split(":") for x in fingerprint.split(",") if x]
    return np.array([int(d, 16) for d, _ in parts], np.uint64), np.array([int(n) for _, n in parts], np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Length of common chunks over the length of the smaller set's; two empty sets are alike, an empty and another are not."""
    small = min(int(a[1].sum()), int(b[1].sum()))
    if not small:
        return 1.0 if len(a[0]) == len(b[0]) else 0.0
    _, i, _ = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return min(1.0, float(a[1][i].sum()) / small)


def fingerprints(docs: DataFrame, column: str = "fingerprint") -> DataFrame:
    """docs (text and any other columns) with the fingerprint of each text; null counts as empty, of which it is ''.

    A column of that name is replaced.
    """
    docs, back = set_apart(docs.drop(column), "text")
    schema = Y.StructType([*docs.schema.fields, Y.StructField(column, Y.StringType())])

    def run(batches):
        for b in batches:
            out = [written(x) for _, _, data, offsets in T.chunks(b.column("text")) for x in chunk_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, column])

    return back(docs.mapInArrow(returning(run), schema), column)


class Ranges:
    """Ranges of rows by descending key, then ascending hash, that keys of many rows are split into as well."""

    def __init__(self, quantiles: np.ndarray):
        """quantiles: keys at equal distances in rank; one that comes m times is cut m times by hash."""
        key, many = np.unique(quantiles, return_counts=True)
        key, many = key[::-1], many[::-1]
        self.key, self.first = ~key, np.concatenate([[0], np.cumsum(many)])
        self.hash = np.concatenate([np.zeros(0, np.int64), *((np.arange(m, dtype=np.float64) / m * 2.0**64 - 2.0**63).astype(np.int64) for m in many)])

    def of(self, key: np.ndarray, hash_: np.ndarray) -> np.ndarray:
        """The range of each row, that is how many cuts come before it or stand at it."""
        at = np.searchsorted(self.key, ~key)  # ~ turns the order of whole numbers round
        out = self.first[at]
        if len(self.key):
            on = np.flatnonzero(self.key[np.minimum(at, len(self.key) - 1)] == ~key)
            for k in np.unique(at[on]).tolist():
                own = on[at[on] == k]
                out[own] += np.searchsorted(self.hash[self.first[k] : self.first[k + 1]], hash_[own], "right")
        return out


def report(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """For each row of docs (doc_id, text) its fingerprint, that of its edited text, and likenesses.

    The edited text has the last floor(n_chars/2) code points replaced by the first as many (or all) of the next document, by
    descending doc_id, after the last the first. Rows without doc_id come last; of rows with the same doc_id, or none, the order is by a hash of the text,
    then by text. Texts are dealt once, by ranges of this order, of equal numbers of rows whatever doc_ids they have; a range also gets the first row of the
    next one. Null texts count as empty, repeated rows each have their own result.
    """
    spark, lowest = docs.sparkSession, -(2**63)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("key", F.xxhash64("text").alias("hash"), "doc_id", "text")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // RANGE_BYTES))
    buckets = buckets or 4 * tasks
    cuts = docs.approxQuantile("key", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    ranges = Ranges(np.array(cuts, np.int64))

    def firsts_of(batches):
        for b in batches:
            key, hash_ = b.column("key").to_numpy(), b.column("hash").to_numpy()
            of = ranges.of(key, hash_)
            order = np.lexsort((hash_, ~key, of))
            got = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
            yield pa.RecordBatch.from_arrays([pa.array(of[got], pa.int32()), pa.array(~key[got]), pa.array(hash_[got])], ["range", "turned", "hash"])

    # One row for each range.
    first = docs.select("key", "hash").mapInArrow(firsts_of, "range int, turned long, hash long").groupBy("range").agg(F.min(F.struct("turned", "hash")).alias("first"))
    tops = sorted((r["range"], ~r["first"]["turned"], r["first"]["hash"]) for r in first.collect())
    #: The first documents of a range also go to the range before it, those of the first to the last one.
    extra = {(key, hash_): tops[i - 1][0] for i, (_, key, hash_) in enumerate(tops)}
    firsts = pa.array(sorted({h for _, h in extra}), pa.int64())

    def deal(batches):
        import pyarrow.compute as pc

        names = ["range", "guest", "key", "hash", "doc_id", "text"]
        for b in batches:
            own = pa.array(ranges.of(b.column("key").to_numpy(), b.column("hash").to_numpy()), pa.int32())
            yield pa.RecordBatch.from_arrays([own, pa.array(np.zeros(b.num_rows, bool)), *b.columns], names)
            guests = b.filter(pc.is_in(b.column("hash"), firsts))
            to = [extra.get(x) for x in zip(guests.column("key").to_pylist(), guests.column("hash").to_pylist(), strict=True)]
            there = pa.array([x is not None for x in to], pa.bool_())
            guests, to = guests.filter(there), pa.array([x for x in to if x is not None], pa.int32())
            if guests.num_rows:
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(guests.num_rows, bool)), *guests.columns], names)

    def judge(batches):
        held = None  # the row before, which waits for the next one
        for b in batches:
            for t in range(0, b.num_rows, 512):
                part = b.slice(t, 512)
                prints = [x for _, _, data, offsets in T.chunks(part.column("text")) for x in chunk_sets(data, offsets)]
                rows, out = zip(*(part.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text")), strict=True), []
                for (where, guest, doc_id, text), own in zip(rows, prints, strict=True):
                    if held and held[0] == where:
                        out.append((held[1], held[2], held[3], text, own))
                        held = None
                    if not guest:
                        held = (where, doc_id, text, own)
                yield from finished(out)

    def finished(rows):
        if not rows:
            return
        ids, texts, own, after, after_print = zip(*rows, strict=True)
        edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for x, y in zip(texts, after, strict=True)]
        prints = [x for _, _, data, offsets in T.chunks(pa.array(edited, pa.string())) for x in chunk_sets(data, offsets)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array(list(map(written, own))), pa.array(list(map(written, prints))),
                pa.array(list(map(likeness, own, prints)), pa.float64()), pa.array(list(map(likeness, own, after_print)), pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    dealt = docs.mapInArrow(returning(deal), "range int, guest boolean, key long, hash long, doc_id long, text string").repartition(tasks, "range")
    dealt = dealt.sortWithinPartitions("range", "guest", F.desc("key"), "hash", "text").select("range", "guest", "doc_id", "text")
    return dealt.mapInArrow(returning(judge), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
