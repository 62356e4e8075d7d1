"""Near-duplicate documents by HyperMinHash.

A document is its set of distinct word shingles. The hash range is cut into ``REGISTERS`` buckets; of each, the register holds
the smallest hash of the set as its count of leading zeros and ``MANTISSA`` bits after them, in 16 bits. Runs of registers form
bands, and documents that share a band are candidates; registers then estimate the Jaccard index, less the collisions that
compressed registers have by chance, and what may reach the threshold is confirmed on full sets.

Small sets: an element in one set only disturbs one band, so with more bands than such elements can be, some band is left alike.
Documents whose sets are small are banded by size class with 1.5 times as many bands as that needs. Where that would be more than
fit, bands are of as many registers as miss a pair at the threshold with a probability of ``MISS`` at most: 8 at 0.85 (3e-6, and a
pair at 0.9 2e-10), 6 at 0.80 (1e-7).

Large groups: equal sets are one node. In each band the most central document is compared with all others first, which joins most
of a group; only pairs of members that are in different components after that are looked at again, in blocks inside a task, and of
these only what may reach the threshold becomes a row. Nothing is capped.

What moves: a node has a body, which is its whole set if that has at most ``SMALL`` elements, else its registers. Pairs of small sets
are confirmed where bodies meet; of larger sets only those are made, in a second pass over the texts, that have a plausible pair.
Sets are kept as 48 bits of each hash, as differences, which are exact enough: two sets of 20,000 have one false common element
with a probability of one in 700,000.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import components, cut, few, returning

REGISTERS, MANTISSA, MISS = 320, 10, 4e-6
BLOCK = 1024
SMALL = 256  #: sets of up to so many elements are the bodies of their nodes; registers would hardly be shorter and say less
MASK = np.uint64(2**64 - 2**16)
_EDGES = (np.arange(REGISTERS, dtype=np.uint64) * np.uint64(2**64 // REGISTERS)).astype(np.uint64)
_EMPTY = np.uint16(0)


def shingle_sets(column: pa.Array, k: int):
    """For each text in turn its sorted distinct shingle hashes."""
    for i, j, data, offsets in T.chunks(column):
        w = T.words(data, offsets, T.FOLDED)
        s = T.rolled(w.hash, k)
        for d in range(j - i):
            a, e = w.first[d], w.first[d + 1]
            if e - a >= k:
                yield np.unique(s[a : e - k + 1])
            elif e > a:  # fewer words: all of them are the one shingle
                yield T.rolled(w.hash[a:e], e - a) ^ np.uint64(e - a)
            else:
                yield np.zeros(0, np.uint64)


def registers(u: np.ndarray) -> np.ndarray:
    """Of sorted distinct hashes: for each bucket 0 if it is empty, else (leading zeros + 1) << MANTISSA | mantissa bits."""
    out = np.zeros(REGISTERS, np.uint16)
    u = u & MASK
    if len(u):
        at = np.searchsorted(u, _EDGES)
        got = np.flatnonzero(np.diff(at, append=len(u)))
        share = (u[at[got]] - _EDGES[got]).astype(np.float64) * (REGISTERS / 2.0**64)
        m, e = np.frexp(np.maximum(share, 2.0**-52))
        zeros = np.clip(-e, 0, 61).astype(np.uint16)
        bits = ((m - 0.5) * 2 ** (MANTISSA + 1)).astype(np.uint16)
        out[got] = (zeros + np.uint16(1)) << np.uint16(MANTISSA) | np.minimum(bits, np.uint16(2**MANTISSA - 1))
    return out


@functools.cache
def band_counts(threshold: float) -> tuple[int, int]:
    """The least and the greatest number of bands.

    The least keeps the chance that all common elements of a pair are in one band with an element of one set only, which is highest
    for the smallest sets that can reach the threshold, at that of 6 bands at 0.85.
    """
    common = -(-100 // (100 - round(100 * threshold))) - 1
    per_band = max((r for r in range(1, REGISTERS) if (1 - threshold**r) ** (REGISTERS // r) <= MISS), default=1)
    return max(6, math.ceil(6 ** (6 / common))), REGISTERS // per_band


def size_classes(n: int, threshold: float) -> list[tuple[int, int]]:
    """(class, bands) under which a set of n elements is banded: any two sizes that can reach the threshold share a class."""
    least, most = band_counts(threshold)
    c, out = int(math.log(n) / -math.log(threshold)), []
    for label in (c, c + 1):
        apart = int((1 - threshold) * threshold ** -(label + 2))
        bands = max(least, int(1.5 * (apart + 1)) + 1)
        out.append((label, bands) if bands < most else (9999, most))
    return list(dict.fromkeys(out))


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that the registers of two unrelated sets of n and m elements are alike and not empty."""
    z = np.arange(0, 40)
    hi, lo = 2.0 ** -(z + 1), 2.0**-z
    inside = lambda k: np.exp(-np.outer(k / REGISTERS, hi)) - np.exp(-np.outer(k / REGISTERS, lo))
    return (inside(n) * inside(m)).sum(1) / 2**MANTISSA


def plausible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of register rows may reach the threshold: collision-corrected estimate with 5.5 standard errors."""
    filled = np.maximum(((x != 0) | (y != 0)).sum(1), 1)
    alike = ((x == y) & (x != 0)).sum(1)
    chance = collisions(n, m) * REGISTERS
    jaccard = (alike - chance * (1 - alike / filled)) / filled
    sizes = np.minimum(n, m) >= threshold * np.maximum(n, m)
    return sizes & (jaccard >= threshold - 5.5 * np.sqrt(threshold * (1 - threshold) / filled) - 1 / filled)


def packed(u: np.ndarray) -> bytes:
    """Sorted hashes as 48-bit differences, in planes of bytes: those of the high bytes are nearly all zeros."""
    d = np.diff(u >> np.uint64(16), prepend=np.uint64(0)).astype("<u8")
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes(), asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """The n hashes, of which the low 16 bits are zeros."""
    d = np.zeros((n, 8), np.uint8)
    d[:, :6] = np.frombuffer(pa.Codec("zstd").decompress(raw, 6 * n), np.uint8).reshape(6, n).T
    return np.cumsum(d.view("<u8").reshape(-1).astype(np.uint64)) << np.uint64(16)


def body_registers(body: bytes, n: int) -> np.ndarray:
    return registers(unpacked(body, n)) if n <= SMALL else np.frombuffer(body, np.uint16)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, d1, d2, body): size, 128-bit digest and body of each document's set."""

    def run(batches):
        for b in batches:
            n, d1, d2, body = [], [], [], []
            for u in shingle_sets(b.column("text"), k):
                n.append(len(u))
                d1.append(int(u.sum().view(np.int64)))
                d2.append(int(T.mix(u ^ np.uint64(0x5BD1E9955BD1E995)).sum().view(np.int64)))
                body.append(packed(u) if len(u) <= SMALL else registers(u).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(body, pa.binary())], ["doc_id", "n", "d1", "d2", "body"])

    return docs.select("doc_id", "text").mapInArrow(returning(run), "doc_id long, n long, d1 long, d2 long, body binary")


def band_keys(n: int, r: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of the bands that hold anything, for each size class of a set of n elements with registers r."""
    out, r = [], r.astype(np.uint64)
    for label, bands in size_classes(n, threshold):
        cuts = np.arange(bands) * REGISTERS // bands
        word = T.mix(r + (np.arange(REGISTERS, dtype=np.uint64) << np.uint64(20)) + np.uint64(label << 40))
        out.append(T.mix(np.add.reduceat(word, cuts) + np.arange(bands, dtype=np.uint64))[np.add.reduceat(r != 0, cuts) > 0])
    return np.concatenate(out).view(np.int64)


def _bands(nodes: DataFrame, threshold: float) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = [band_keys(n, body_registers(raw, n), threshold) for n, raw in zip(b.column("n").to_pylist(), b.column("body").to_pylist(), strict=True)]
                of = np.repeat(b.column("id").to_numpy(), [len(x) for x in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(of)], ["key", "id"])

    return nodes.select("id", "n", "body").mapInArrow(returning(run), "key long, id long")


def alike(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union"""
    both = np.concatenate([u, v])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(u) + len(v) - common)


def _judged(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, sure): pairs of small sets that reach the threshold (sure), and others whose registers may."""
    threshold = percent / 100

    def run(batches):
        for t in batches:
            na, nb, xs, ys = (t.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))
            sure, ok, rest = np.zeros(len(na), bool), np.zeros(len(na), bool), []
            for i, (n, m, x, y) in enumerate(zip(na, nb, xs, ys, strict=True)):
                if 100 * min(n, m) < percent * max(n, m):
                    continue
                if max(n, m) <= SMALL:
                    ok[i] = sure[i] = alike(unpacked(x, n), unpacked(y, m), percent)
                else:
                    rest.append(i)
            if rest:
                a, b = (np.stack([body_registers(v[i], k[i]) for i in rest]) for v, k in ((xs, na), (ys, nb)))
                ok[rest] = plausible(a, b, np.array(na)[rest], np.array(nb)[rest], threshold)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(sure)], ["a", "b", "sure"]).filter(pa.array(ok))

    a, b = (nodes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("body").alias(f"x{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(returning(run), "a long, b long, sure boolean")


def _confirmed(judged: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``_judged`` that reach the threshold on full sets."""

    def run(batches):
        for t in batches:
            columns = (t.column(c).to_pylist() for c in ("na", "nb", "sa", "sb"))
            ok = [alike(unpacked(x, n), unpacked(y, m), percent) for n, m, x, y in zip(*columns, strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    judged = cut(few(judged))
    pairs = judged.where("not sure").select("a", "b")
    sets = _sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), k)
    a, b = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}")) for c in "ab")
    large = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(returning(run), "a long, b long")
    return cut(few(judged.where("sure").select("a", "b").union(large)))


def alike_small(minis: list[np.ndarray], n: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of which small sets may reach the threshold: counts of common 32-bit hashes, with one element to spare."""
    flat, of = np.concatenate(minis), np.repeat(np.arange(len(minis)), [len(m) for m in minis])
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(at[keep := count[at] > 1], kind="stable")
    at, of = at[keep][order], of[keep][order]
    at = np.cumsum(np.diff(at, prepend=-1) != 0) - 1
    common = np.zeros((len(minis), len(minis)), np.float32)
    for c in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
        a, b = np.searchsorted(at, [c, c + 4096])
        has = np.zeros((len(minis), 4096), np.float32)
        has[of[a:b], at[a:b] - c] = 1
        common += has @ has.T
    common += 1
    return 100 * common >= percent * (n[:, None] + n[None, :] - common)


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (key, i, j, id, root, n, body, own) of one cell in different components that may reach the threshold."""
    threshold = percent / 100

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("id").to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        ids, root, n, own = (group.column(c).to_numpy() for c in ("id", "root", "n", "own"))
        bodies, small = group.column("body").to_pylist(), n <= SMALL
        r = np.stack([body_registers(x, k) for x, k in zip(bodies, n.tolist(), strict=True)])
        within = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        where = np.cumsum(small) - 1
        minis = [(unpacked(bodies[x], int(n[x])) >> np.uint64(32)).astype(np.uint32) for x in np.flatnonzero(small)]
        known = alike_small(minis, n[small], percent) if minis else None
        a, b, keys, here = [], [], {}, group.column("key")[0].as_py()
        of = lambda x: keys.get(x) or keys.setdefault(x, frozenset(band_keys(n[x], r[x], threshold).tolist()))
        for x in range(len(ids)):
            y = np.arange(x + 1, len(ids))
            y = y[(root[y] != root[x]) & (ids[y] != ids[x]) & (within | (own[y] != own[x]))]
            both = small[y] & small[x]
            z, y = y[both], y[~both]
            if len(z):
                z = z[known[where[x], where[z]]]
            if len(y):
                y = y[plausible(r[x : x + 1], r[y], n[x : x + 1], n[y], threshold)]
                y = y[[min(of(x) & of(k), default=here) == here for k in y.tolist()]] if len(y) else y  # once, not in each common band
            a.append(np.full(len(z) + len(y), ids[x]))
            b += [ids[z], ids[y]]
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return members.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _hubs(links: DataFrame) -> DataFrame:
    """(id, root): for each linked document one that it is connected with, the same for most of a large group.

    The best linked of a document and its neighbours, and the best linked of that one's. Other than for whole components, two passes do.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    degree = both.groupBy("u").agg(F.count("*").alias("degree")).withColumnRenamed("u", "v")
    own = F.struct(F.count("*").alias("degree"), (-F.col("u")).alias("v"))
    best = both.join(degree, "v").groupBy("u").agg(F.greatest(F.max(F.struct("degree", (-F.col("v")).alias("v"))), own).alias("best")).select("u", (-F.col("best.v")).alias("hub"))
    return best.join(best.select(F.col("u").alias("hub"), F.col("hub").alias("root")), "hub").select(F.col("u").alias("id"), "root")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Null, empty and blank texts have an empty set and are linked with
    nothing. Rows with the same doc_id are one node. A row without doc_id is linked with nothing; its component is null and
    it is kept. Other columns are ignored.
    """
    threshold = percent / 100
    docs = docs.select("doc_id", "text")
    sig = cut(few(signatures(docs, k)))
    # One body for each distinct set, summed on the map side.
    known = sig.where(F.col("doc_id").isNotNull() & (F.col("n") * (100 - percent) >= percent))
    nodes = cut(few(known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id"), F.first("body").alias("body")).select("id", "n", "body")))
    sig = cut(sig.select("doc_id", "n", "d1", "d2"))  # without the bodies
    live = sig.where("n > 0 and doc_id is not null")
    copies = live.join(live.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id")), ["n", "d1", "d2"]).select("doc_id", "id")

    bands = _bands(nodes, threshold)
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    bands = cut(few(bands.join(shared, "key")))
    central = bands.groupBy("id").agg(F.sum("size").alias("weight"))
    lead = bands.join(central, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("lead")).select("key", (-F.col("lead.id")).alias("lead"))
    star = bands.join(lead, "key").where("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    links = _confirmed(_judged(star, nodes, percent), docs, k, percent)

    roots = _hubs(links)
    at = bands.where("size > 2").join(roots, "id", "left").select("key", "size", "id", F.coalesce("root", "id").alias("root"))
    open_ = at.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    cells = (
        at.join(open_, "key").join(nodes, "id")
        .withColumns({"blocks": n, "own": F.pmod(F.xxhash64("id"), n).cast("int")})
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("own", "o"), "j": F.greatest("own", "o")})
        .select("key", "i", "j", "own", "id", "root", "n", "body")
    )
    rest = _across(cells, percent).distinct()
    links = links.union(_confirmed(_judged(rest, nodes, percent), docs, k, percent))

    several = copies.groupBy("doc_id").agg(F.collect_set("id").alias("ids")).where("size(ids) > 1").select(F.col("doc_id").alias("a"), F.explode("ids").alias("b"))
    roots = components(links.union(several)).groupBy("id").agg(F.min("root").alias("root"))
    found = copies.join(roots, "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "id")).alias("root"))
    out = sig.select("doc_id", "n").join(found, "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


MARKS, SLICE = 1 << 27, 1 << 19  #: bits of the marks, and of each part of them


def _marks(ids: DataFrame) -> list[tuple[int, bytes]]:
    """A bit of ``MARKS`` for each id: 16 MB at most, however many ids there are, and compressed."""

    def run(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            bit = b.column("bit").to_numpy()
            for s in np.unique(bit // SLICE).tolist():
                parts.setdefault(s, np.zeros(SLICE, bool))[bit[bit // SLICE == s] % SLICE] = True
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([pa.Codec("zstd").compress(np.packbits(x).tobytes(), asbytes=True) for x in parts.values()], pa.binary())], ["slice", "bits"])

    bits = ids.select(F.pmod(F.xxhash64("id"), F.lit(MARKS)).alias("bit")).distinct()
    rows = bits.withColumn("slice", F.floor(F.col("bit") / SLICE)).repartition("slice").select("bit").mapInArrow(run, "slice long, bits binary").toArrow()
    return list(zip(rows.column("slice").to_pylist(), rows.column("bits").to_pylist(), strict=True))


def _sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, n, s): the full set of each listed document, packed.

    Texts stay where they are: sets are made of those documents that have a mark, which are the listed and some few that share a
    mark with one, and only sets are shuffled. Where ids are so many that most marks are set, sets of other documents move too.
    """
    marks = _marks(ids)

    def run(batches):
        marked = np.zeros(MARKS // 8, np.uint8)
        for s, raw in marks:
            marked[s * SLICE // 8 : (s + 1) * SLICE // 8] = np.frombuffer(pa.Codec("zstd").decompress(raw, SLICE // 8), np.uint8)
        for b in batches:
            bit = b.column("bit").to_numpy()
            b = b.filter(pa.array(marked[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1 == 1))
            sets = list(shingle_sets(b.column("text"), k))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([len(u) for u in sets], pa.int64()), pa.array([packed(u) for u in sets], pa.binary())], ["id", "n", "s"])

    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(MARKS)).alias("bit")
    sets = docs.where("doc_id is not null").select("doc_id", "text", bit).mapInArrow(returning(run), "id long, n long, s binary")
    return cut(few(sets.join(ids, "id", "left_semi")))
