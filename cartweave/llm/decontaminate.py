"""Benchmark decontamination: an FM-index per training shard, searched for all windows of the benchmark items.

A task gathers the words of its documents into shards, indexes each shard and searches every window of every item backwards
through the ranks of the wavelet tree; located occurrences are merged into spans. Words that no item has can't be part of an
occurrence: they, the borders of documents, and stretches between them that are shorter than the shortest window are replaced
by one separator, which makes the index as small as the text it can match. There is no shuffle and no join.

Items are read in blocks of ``BLOCK_BYTES`` of text; only one block is sent to the tasks at a time, and with several blocks the
spans of each document are merged afterwards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from . import text as T
from .fmindex import FMIndex
from .shared import cut, returning, set_apart

WINDOW = 13
BLOCK_BYTES = 32_000_000
SHARD_BYTES, SHARD_WORDS = 16_000_000, 2_000_000
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
FOUND = "struct<n_words:long,items:array<string>,spans:array<struct<start:int,end:int>>>"
_FOUND = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])


class Windows:
    """The distinct windows of some items, over the vocabulary of these items."""

    def __init__(self, ids: list[str], texts: pa.Array, n: int):
        data, offsets = T.buffers(texts)
        w = T.words(data, offsets, T.ALNUM)
        self.vocabulary, of = np.unique(w.hash, return_inverse=True)
        self.size = len(self.vocabulary) + 2
        at: dict[tuple, set[int]] = {}
        for i in range(len(ids)):
            seq = tuple((of[w.first[i] : w.first[i + 1]] + 2).tolist())
            for k in range(max(len(seq) - n, 0) + 1 if seq else 0):
                at.setdefault(seq[k : k + n], set()).add(i)
        self.ids = np.array(ids, object)
        self.lengths = np.array([len(k) for k in at], np.int64)
        self.patterns = np.zeros((len(at), n), np.int64)
        for row, k in enumerate(at):
            self.patterns[row, : len(k)] = k
        sizes = np.array([len(v) for v in at.values()], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.items = np.array([x for v in at.values() for x in sorted(v)], np.int64)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """2 and up for words of the vocabulary, else 0."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 0)


class Shard:
    """What is gathered of some texts, until ``search``."""

    def __init__(self, windows: Windows):
        self.windows, self.bytes, self.docs = windows, 0, 0
        self.symbols, self.doc, self.word, self.n_words, self.kept = [], [], [], [], 0

    def add(self, column: pa.Array) -> None:
        least = int(self.windows.lengths.min(initial=1 << 30))
        for i, j, data, offsets in T.chunks(column):
            w = T.words(data, offsets, T.ALNUM)
            symbol, doc = self.windows.symbols(w.hash), w.doc()
            known = np.flatnonzero(symbol)
            if len(known):
                new = np.flatnonzero((np.diff(known, prepend=-2) != 1) | (np.diff(doc[known], prepend=-1) != 0))
                sizes = np.diff(new, append=len(known))
                keep = np.repeat(sizes >= least, sizes)
                known, run = known[keep], np.repeat(np.arange(len(sizes)), sizes)[keep]
                gap = np.flatnonzero(np.diff(run, append=-1))  # a separator after each run
                self.symbols.append(np.insert(symbol[known], gap + 1, 1))
                self.doc.append(np.insert(doc[known] + self.docs, gap + 1, -1))
                self.word.append(np.insert(known - w.first[doc[known]], gap + 1, -1))
                self.kept += len(known)
            self.n_words.append(np.diff(w.first))
            self.docs += j - i
            self.bytes += len(data)

    def search(self) -> pa.StructArray:
        """For each text its words, the items that occur in it, and the merged spans of words that occurrences cover."""
        w, none = self.windows, np.zeros(0, np.int64)
        n_words = np.concatenate([none, *self.n_words])
        symbols, doc, word = (np.concatenate([none, *x]) for x in (self.symbols, self.doc, self.word))
        start, end, owner, pairs = none, none, none, none
        if len(symbols) and len(w.lengths):
            index = FMIndex(symbols, w.size)
            low, high = index.search(w.patterns, w.lengths)
            found = np.flatnonzero(high > low)
            count = (high - low)[found]
            rows = np.repeat(low[found] - np.cumsum(count) + count, count) + np.arange(count.sum())
            at, pattern = index.locate(rows), np.repeat(found, count)
            change = np.zeros(len(symbols) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + w.lengths[pattern], -1)
            covered = np.cumsum(change[:-1]) > 0
            edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
            a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            owner, start, end = doc[a], word[a], word[b - 1] + 1
            # A window counts once for a document before it stands for all its items.
            once = np.unique(doc[at] * len(w.lengths) + pattern)
            per_doc, pattern = np.divmod(once, len(w.lengths))
            per = w.first[pattern + 1] - w.first[pattern]
            item = w.items[np.repeat(w.first[pattern] - np.cumsum(per) + per, per) + np.arange(per.sum())]
            pairs = np.unique(np.repeat(per_doc, per) * len(w.ids) + item)
        span_first = np.searchsorted(owner, np.arange(self.docs + 1)).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(span_first), pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], fields=list(_SPAN)))
        pair_first = np.searchsorted(pairs, np.arange(self.docs + 1) * len(w.ids)).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(pair_first), pa.array(w.ids[pairs % max(1, len(w.ids))], pa.string()))
        return pa.StructArray.from_arrays([pa.array(n_words), items, spans], fields=list(_FOUND))


def _searched(docs: DataFrame, windows: Windows) -> DataFrame:
    """docs with a column ``found``; tasks get the windows with the function, which is at most a block of items."""
    docs, back = set_apart(docs, "text")
    schema = Y.StructType([*docs.schema.fields, Y.StructField("found", Y._parse_datatype_string(FOUND))])

    def run(batches):
        held, shard, others = [], Shard(windows), 0
        for b in batches:
            held.append(b)
            others += b.nbytes
            shard.add(b.column("text"))
            if others >= 2 * SHARD_BYTES or shard.bytes >= SHARD_BYTES or shard.kept >= SHARD_WORDS:
                yield from flushed(held, shard)
                held, shard, others = [], Shard(windows), 0
        yield from flushed(held, shard)

    def flushed(held, shard):
        found, at = shard.search(), 0
        for b in held:
            yield pa.RecordBatch.from_arrays([*b.columns, found.slice(at, b.num_rows)], [*b.schema.names, "found"])
            at += b.num_rows

    return back(docs.mapInArrow(returning(run), schema), "found")


def find(docs: DataFrame, items: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs (text and any other columns) with ``found``: n_words, items (ids as strings, in no order), spans. A column of that name is replaced.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is n consecutive words of an item; an item
    of fewer, but not none, is one window. Spans are in words, end exclusive, merged and in order. Null, empty and wordless
    texts have no words and no spans; such items, and items without id, have no windows. Without items nothing is found.
    Repeated rows stay.
    """
    docs = docs.drop("found")
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(total / BLOCK_BYTES) or 1

    def block(k: int) -> Windows:
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()
        text = pa.concat_arrays(part.column("text").chunks) if part.num_rows else pa.array([], pa.string())
        return Windows(part.column("item_id").to_pylist(), text, n)

    if blocks == 1:
        return _searched(docs, block(0))
    # Every row gets a number that holds, then its spans of all blocks are merged. The driver holds one block at a time.
    docs, back = set_apart(docs, "text")
    docs = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    every = None
    for k in range(blocks):
        one = cut(_searched(docs.select("_row", "text"), block(k)).select("_row", "found"))
        every = one if every is None else every.union(one)
    merged = every.groupBy("_row").agg(F.max("found.n_words").alias("n"), F.flatten(F.collect_list("found.items")).alias("items"), F.sort_array(F.flatten(F.collect_list("found.spans"))).alias("spans"))
    struct = F.struct("n", F.array_distinct("items"), merged_spans(F.col("spans"))).cast(FOUND)
    joined = docs.join(merged.select("_row", struct.alias("found")), "_row")
    return back(joined, "found")


def merged_spans(sorted_spans: Column) -> Column:
    """Overlapping or touching spans as one."""
    return F.aggregate(
        sorted_spans,
        F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)).end >= s.start), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1)).start.alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1)).end, s.end).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))),
    )


def n_hit() -> Column:
    return F.aggregate("found.spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)


def is_contaminated() -> Column:
    """Words are hit, and one in twenty or more of all."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("found.n_words"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    ids = F.array_join(F.array_sort("found.items"), ",")
    return find(docs.select("doc_id", "text"), items).select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), is_contaminated().alias("contaminated")
    )


def without_spans(docs: DataFrame) -> DataFrame:
    """Result of ``find`` with the words of each span, and what stands between them, taken out of ``text``; others as they are.

    The column ``found`` goes. Null texts stay null.
    """
    own, _ = set_apart(docs, "text", "found")
    rest, back = set_apart(docs.drop("found"), "text")
    schema = rest.schema

    def run(batches):
        for b in batches:
            spans, text = b.column("found").field("spans"), b.column("text").to_pylist()
            for i in np.flatnonzero(pc.greater(pc.fill_null(pc.list_value_length(spans), 0), 0).to_numpy(zero_copy_only=False)):
                raw = np.frombuffer(text[i].encode(), np.uint8)
                w = T.words(raw, np.array([0, len(raw)]), T.ALNUM, hashed=False)
                keep = np.ones(len(raw), bool)
                for s in spans[int(i)].as_py():
                    keep[w.start[s["start"]] : w.end[s["end"] - 1]] = False
                text[i] = raw[keep].tobytes().decode()
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if c == "text" else b.column(c) for c in schema.names], schema.names)

    return back(own.mapInArrow(returning(run), schema))
