"""Toxicity by logistic regression on hashed word n-grams and skip-grams, learnt by FTRL-proximal.

Features of a text are its distinct words, pairs of neighbours, and pairs with one word between, hashed to ``2 ** BITS`` places.
FTRL keeps a learning rate for each coordinate and sets to zero what its L1 term doesn't let through, so that the weights that
scoring tasks get are few. Their size is bounded by the number of places.

Learning reads at most ``MAX_ROWS`` labelled rows of each label, those of the least hash of doc_id, and of these as many as have
``MAX_BYTES`` of features in all: a bounded sample, chosen alike at every size. Scoring covers every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from . import text as T
from .shared import cut, returning, set_apart

BITS = 18
MAX_ROWS, MAX_BYTES = 6_000, 256_000_000
#: L1 is for the square root of the number of rows, as what noise adds up to grows like that.
EPOCHS, ALPHA, BETA, L1, L2 = 5, 1.0, 1.0, 0.2, 0.5
_PUNCTUATION = T.table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, text number) of every feature of a chunk's texts, as often as it occurs."""
    w = T.words(data, offsets, _PUNCTUATION)
    doc, shift = w.doc(), np.uint64(64 - BITS)
    places, owners = [w.hash >> shift], [doc]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(doc) > gap:
            same = doc[:-gap] == doc[gap:]
            both = T.mix(w.hash[:-gap] * np.uint64(salt) + w.hash[gap:])[same]
            places.append(both >> shift)
            owners.append(doc[:-gap][same])
    return np.concatenate(places).astype(np.int64), np.concatenate(owners)


def _rows(column: pa.Array):
    for i, j, data, offsets in T.chunks(column):
        place, of = features(data, offsets)
        both = np.unique(of << BITS | place)
        first = np.searchsorted(both, np.arange(j - i + 1) << BITS)
        both &= (1 << BITS) - 1
        yield from (both[first[d] : first[d + 1]] for d in range(j - i))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by place, and the bias. Rows of either label count as much as those of the other in all."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    share = labels.mean() if len(labels) else 0.0
    l1 = L1 * len(rows) ** 0.5
    if share in (0.0, 1.0):
        return np.zeros(1 << BITS), 6.0 * (2 * share - 1) if len(labels) else -6.0
    importance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    random = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for r in random.permutation(len(rows)):
            x = rows[r]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((BETA + np.sqrt(nx)) / ALPHA + L2))
            b = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA + L2)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30)))
            g = (p - labels[r]) * importance[r]
            s = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x], n[x] = zx + g - s * w, nx + g * g
            s = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA
            bias_z, bias_n = bias_z + g - s * b, bias_n + g * g
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)), -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA + L2)


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_rows: int = MAX_ROWS) -> dict:
    """The model: places with weights, weights, bias. docs (doc_id, text) and labels (doc_id, label 0 or 1).

    Rows without text or label teach nothing. Of a doc_id with several labels the greatest counts, of several texts the one whose features come
    first. The sample is fitted in one task.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * max_rows rows of two numbers: broadcast, so that texts aren't shuffled.
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(cut(chosen)), "doc_id")

    def read(batches):
        for b in batches:
            x = pa.array([r.astype(np.uint32).tobytes() for r in _rows(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y"), x], ["doc_id", "y", "x"])

    def run(batches):
        ys, rows, size = [], [], 0
        for b in batches:
            for y, x in zip(b.column("y").to_pylist(), b.column("x").to_pylist(), strict=True):
                size += len(x)
                if size <= MAX_BYTES:
                    ys.append(y)
                    rows.append(np.frombuffer(x, np.uint32))
        w, bias = fit(rows, np.array(ys, np.float64))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))], ["place", "weight"])

    # One row for each chosen doc_id, whatever number of texts it has; summed before the shuffle.
    sample = texts.mapInArrow(returning(read), "doc_id long, y int, x binary").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x"))
    sample = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("y", "x")
    got = sample.mapInArrow(run, "place long, weight double").toArrow()
    if not got.num_rows:
        return {"place": np.zeros(0, np.int64), "weight": np.zeros(0), "bias": -6.0}
    place, weight = got.column("place").to_numpy(), got.column("weight").to_numpy()
    return {"place": place[place >= 0], "weight": weight[place >= 0], "bias": float(weight[place < 0][0])}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs (text and any other columns) with ``toxicity`` from 0 to 1; null texts count as empty and get what the bias says.

    A column of that name is replaced.
    """
    docs, back = set_apart(docs.drop("toxicity"), "text")
    schema = Y.StructType([*docs.schema.fields, Y.StructField("toxicity", Y.DoubleType())])

    def run(batches):
        w = np.zeros(1 << BITS)
        w[model["place"]] = model["weight"]
        for b in batches:
            out = [np.zeros(0)]
            for i, j, data, offsets in T.chunks(b.column("text")):
                place, of = features(data, offsets)
                some = w[place] != 0
                both = np.unique(of[some] << BITS | place[some])
                total = np.bincount(both >> BITS, w[both & ((1 << BITS) - 1)], j - i) + model["bias"]
                out.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out))], [*b.schema.names, "toxicity"])

    return back(docs.mapInArrow(returning(run), schema), "toxicity")


def held_out() -> Column:
    """Rows whose labels are not learnt: crc32 of doc_id as text leaves 1 when divided by 3; so are rows without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts have the score of the bias. Rows without doc_id are held out; repeated rows each have their own result.
    """
    model = learn(docs, labels.where(~held_out()))
    out = score(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
