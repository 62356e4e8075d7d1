"""Removal of repeated passages by prefix-partitioned sparse suffix trees.

A sparse suffix tree holds those suffixes that start at an anchor. Anchors are chosen by the text alone: of the ``PREFIX``-word runs within a
window of ``WINDOW`` words, the one with the least hash. The same window has the same anchor wherever it stands, so every repeated window
shows in the tree of its anchor's prefix, while of most text no more than one suffix in twenty words is sent. A prefix
that only one document has needs no tree at all.

The groups of a task are taken together in pieces that fit in memory. Each piece becomes a tree, kept as the sorted suffixes and the lengths of
their longest common prefixes: an internal node is a run of neighbours that have at least its depth in common. Those as deep as a window are the
repeats; the least doc_id below a node keeps it, and covered words merge to the longest spans.

A prefix in more than ``HOT`` documents gets longer, up to the whole window: these nodes are groups of equal windows (by 128 bits), which are
summed on the map side, so no task gets all documents that share a passage. Documents with equal word sequences are settled first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from . import text as T
from .shared import cut, returning, set_apart

WINDOW, PREFIX, HOT, SALTS = 50, 10, 1000, 16
PIECE = 1_500_000  #: words of the groups that are ordered at once
TASK_BYTES = 64_000_000  #: of words of groups, in a task


def prefixes(h: np.ndarray, first: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows' starts, where each one's prefix starts, hash at each word of the run that starts there)."""
    g = T.rolled(h, prefix)
    span = window - prefix + 1
    if len(h) < window:
        none = np.zeros(0, np.int64)
        return none, none, g
    at, width = np.arange(len(g), dtype=np.int32), 1
    while width < span:  # the leftmost least of [i, i + width)
        step = min(width, span - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(g[a] <= g[b], a, b)
        width += step
    sizes = np.maximum(np.diff(first) - window + 1, 0)
    start = np.repeat(first[:-1] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return start, at[start].astype(np.int64), g


def _sequence(h: np.ndarray) -> tuple[int, int]:
    """Two hashes of a word sequence."""
    with np.errstate(over="ignore"):
        at = T.mix(np.arange(len(h), dtype=np.uint64))
        return int(T.mix(h + at).sum().view(np.int64)), int(T.mix(h ^ (at * np.uint64(0xD6E8FEB86659FD93))).sum().view(np.int64)) or 1


def _keys(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(h, h2, doc): prefixes of each document (h2 is 0), and the hashes of its word sequence."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for i, j, data, offsets in T.chunks(b.column("text")):
                w = T.words(data, offsets, T.EXACT)
                start, at, g = prefixes(w.hash, w.first, window, prefix)
                doc = np.searchsorted(w.first, at, "right") - 1
                new = np.flatnonzero(np.diff(at, prepend=-1))
                at, doc = at[new], doc[new]
                long = [d for d in range(j - i) if w.first[d + 1] - w.first[d] >= window]
                whole = [_sequence(w.hash[w.first[d] : w.first[d + 1]]) for d in long]
                h, of = g[at].view(np.int64), doc
                order = np.lexsort((h, of))  # once for each document
                h, of = h[order], of[order]
                once = np.flatnonzero((np.diff(h, prepend=0) != 0) | (np.diff(of, prepend=-1) != 0))
                h, of = h[once], of[once]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([h, np.array([x for x, _ in whole], np.int64)])), pa.array(np.concatenate([np.zeros(len(h), np.int64), np.array([x for _, x in whole], np.int64)])),
                        pa.array(ids[i + np.concatenate([of, np.array(long, np.int64)]).astype(np.int64)]),
                    ],
                    ["h", "h2", "doc"],
                )

    return docs.mapInArrow(returning(run), "h long, h2 long, doc long")


def _segments(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(h, hot, doc, sig, at, words): for each shared prefix in docs (doc_id, text, shared, hot) the words of its windows."""

    def run(batches):
        for b in batches:
            ids, shared, hot = b.column("doc_id").to_numpy(), b.column("shared").to_pylist(), b.column("hot").to_pylist()
            for i, j, data, offsets in T.chunks(b.column("text")):
                w = T.words(data, offsets, T.EXACT)
                start, at, g = prefixes(w.hash, w.first, window, prefix)
                small, rows = (w.hash >> np.uint64(32)).astype(np.uint32), []
                edge = np.searchsorted(start, w.first)
                for d in range(j - i):
                    p, q = start[edge[d] : edge[d + 1]], at[edge[d] : edge[d + 1]]
                    if not len(p):
                        continue
                    new = np.flatnonzero(np.diff(q, prepend=-1))
                    own = g[q[new]].view(np.int64)
                    keep = np.isin(own, shared[i + d])
                    if not keep.any():
                        continue
                    many, end = np.isin(own, hot[i + d] or []), np.append(new[1:], len(p))
                    sig = _sequence(w.hash[w.first[d] : w.first[d + 1]])[0]
                    for k in np.flatnonzero(keep).tolist():
                        a, e = int(p[new[k]]), int(p[end[k] - 1]) + window
                        rows.append((int(own[k]), bool(many[k]), ids[i + d], sig, a - int(w.first[d]), small[a:e].tobytes()))
                if rows:
                    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "hot", "doc", "sig", "at", "words"])

    return docs.mapInArrow(returning(run), "h long, hot boolean, doc long, sig long, at int, words binary")


def tree(words: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common words with the one before): the tree of the suffixes that start at these words, down to a depth.

    Each must have as many words. Ranks by the first 1, 2, 4 ... words are made by doubling; two neighbours have their longest common
    prefix by going through these from the longest.
    """
    _, rank = np.unique(words, return_inverse=True)
    n, levels = len(words), [(1, rank.astype(np.int64))]
    while levels[-1][0] < depth:
        at, rank = levels[-1]
        step = min(at, depth - at)
        _, rank = np.unique(rank[: len(rank) - step] * n + rank[step:], return_inverse=True)
        levels.append((at + step, rank))
    order = start[np.argsort(levels[-1][1][start], kind="stable")]
    common = np.zeros(len(order), np.int64)
    if len(order):
        a, b = order[:-1], order[1:]
        same = np.zeros(len(a), np.int64)
        for at, rank in reversed(levels):
            open_ = np.flatnonzero(same + at <= depth)
            more = open_[rank[a[open_] + same[open_]] == rank[b[open_] + same[open_]]]
            same[more] += at
        common[1:] = same
    return order, common


def deep_nodes(common: np.ndarray, depth: int) -> np.ndarray:
    """For each sorted suffix the number of the node of at least this depth that it is below; neighbours with less in common begin another one."""
    return np.cumsum(common < depth) - 1


def _removed(segments: DataFrame, window: int) -> DataFrame:
    """(doc, sig, start, end): words of windows that a smaller doc_id has too. Segments come sorted by h within a partition."""

    def solve(h, doc, sig, at, words):
        flat = np.frombuffer(b"".join(words), np.uint32)
        first = np.concatenate([[0], np.cumsum([len(x) // 4 for x in words])])
        sizes = np.maximum(np.diff(first) - window + 1, 0)
        start, common = tree(flat, np.repeat(first[:-1] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), window)
        node = deep_nodes(common, window)
        row = np.searchsorted(first, start, "right") - 1
        order = np.lexsort((doc[row], node))
        node, row, start = node[order], row[order], start[order]
        new = np.diff(node, prepend=-1) != 0
        least = doc[row][np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = np.flatnonzero(doc[row] > least)
        order = np.sort(start[gone])
        if not len(order):
            return None
        row = np.searchsorted(first, order, "right") - 1
        new = np.flatnonzero((np.diff(order, prepend=-9) != 1) | (np.diff(row, prepend=-1) != 0))
        last, row = np.append(new[1:], len(order)) - 1, row[new]
        begin, end = order[new] - first[row] + at[row], order[last] - first[row] + at[row] + window
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(sig[row]), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["doc", "sig", "start", "end"])

    def run(batches):
        held, size = [], 0

        def out(rows):
            h, doc, sig, at, words = zip(*rows, strict=True)
            return solve(np.array(h), np.array(doc), np.array(sig), np.array(at, np.int64), words)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("h", "doc", "sig", "at", "words")), strict=True):
                if size >= PIECE and held[-1][0] != row[0]:  # groups stay whole
                    if (x := out(held)) is not None:
                        yield x
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) // 4
        if held and (x := out(held)) is not None:
            yield x

    return segments.mapInArrow(returning(run), "doc long, sig long, start int, end int")


def _hot_removed(segments: DataFrame, window: int) -> DataFrame:
    """The same for prefixes of many documents: the prefix is the whole window."""

    def run(batches):
        for b in batches:
            out = []
            for doc, sig, at, words in zip(*(b.column(c).to_pylist() for c in ("doc", "sig", "at", "words")), strict=True):
                h = np.frombuffer(words, np.uint32).astype(np.uint64)
                one, two = T.rolled(T.mix(h), window), T.rolled(T.mix(~h), window)
                out.append((one.view(np.int64), two.view(np.int64), np.full(len(one), doc), np.full(len(one), sig), np.arange(at, at + len(one), dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["w", "w2", "doc", "sig", "at"])

    rows = segments.mapInArrow(returning(run), "w long, w2 long, doc long, sig long, at int")
    least = rows.groupBy("w", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("w", "w2", "least")
    # Windows of very many documents come back to these in parts; of the windows themselves there are few.
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS)).cast("int"))
    return rows.join(least, ["w", "w2", "salt"]).where("doc > least").select("doc", "sig", F.col("at").alias("start"), (F.col("at") + window).alias("end"))


def marked(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """docs (doc_id, text and any other columns) with ``gone``: all (every word is repeated) and spans, in words, some overlapping.

    A column of that name is replaced.
    """
    docs, back = set_apart(docs.drop("gone"), "doc_id", "text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    keys = _keys(own, window, prefix)
    groups = keys.groupBy("h", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
    known = keys.join(groups, ["h", "h2"])
    per_doc = known.groupBy("doc").agg(
        F.max((F.col("h2") != 0) & (F.col("doc") > F.col("least"))).alias("copy"),
        F.collect_list(F.when(F.col("h2") == 0, F.col("h"))).alias("shared"), F.collect_list(F.when((F.col("h2") == 0) & (F.col("n") > HOT), F.col("h"))).alias("hot"),
    )
    per_doc = cut(per_doc)
    some = own.join(per_doc.where("not copy and size(shared) > 0").withColumnRenamed("doc", "doc_id").drop("copy"), "doc_id")
    segments = cut(_segments(some, window, prefix))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(segments.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // TASK_BYTES))
    sorted_ = segments.where("not hot").select("h", "doc", "sig", "at", "words").repartition(tasks, "h").sortWithinPartitions("h")
    spans = _removed(sorted_, window).union(_hot_removed(segments.where("hot"), window))
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("sig", "start", "end")).alias("spans"))
    found = spans.join(per_doc.where("copy").select("doc", "copy"), "doc", "full").withColumnRenamed("doc", "_doc")
    gone = F.struct(F.coalesce("copy", F.lit(False)).alias("all"), F.col("spans")).alias("gone")
    return back(docs.join(found, F.col("doc_id") == F.col("_doc"), "left"), gone)


def without_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """docs (doc_id, text and any other columns) with ``n_words``, ``n_removed`` and ``kept_text``, the kept words joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window is ``window`` consecutive words; removed is each word covered by one
    whose words also start in a document with a smaller doc_id, as the input has it. Null texts have no words. Rows without
    doc_id lose nothing and take nothing from others. Rows with the same doc_id don't count as smaller than each other. Columns of
    the names of the result are replaced.
    """
    docs, back = set_apart(docs.drop("n_words", "n_removed", "kept_text"), "doc_id", "text")
    names = docs.columns
    schema = Y.StructType([*docs.schema.fields, Y.StructField("n_words", Y.LongType()), Y.StructField("n_removed", Y.LongType()), Y.StructField("kept_text", Y.StringType())])

    def run(batches):
        for b in batches:
            total, removed, kept = [], [], []
            gone = b.column("gone").to_pylist()
            for i, j, data, offsets in T.chunks(b.column("text")):
                w = None
                for d in range(i, j):
                    words = data[offsets[d - i] : offsets[d - i + 1]].tobytes().split()
                    keep = np.ones(len(words), bool)
                    if gone[d]["spans"]:
                        w = w or T.words(data, offsets, T.EXACT)
                        sig = _sequence(w.hash[w.first[d - i] : w.first[d - i + 1]])[0]
                        for s in gone[d]["spans"]:
                            if s["sig"] == sig:
                                keep[s["start"] : s["end"]] = False
                    if gone[d]["all"] and len(words) >= window:
                        keep[:] = False
                    total.append(len(words))
                    removed.append(len(words) - int(keep.sum()))
                    kept.append(b" ".join(words if keep.all() else [words[k] for k in np.flatnonzero(keep)]).decode())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema.names)

    return back(marked(docs, window, prefix).mapInArrow(returning(run), schema), "n_words", "n_removed", "kept_text")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    return without_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
