"""Documents scored by masked pseudo-likelihood.

A window network predicts every token from the ``SIDE`` tokens before and as many after it, never from itself. Each place of the
window has its own table of embeddings; their sum is the hidden state. A token's number has two halves: the first is predicted
from the hidden state, the second from the hidden state and the first half, so that a distribution over all numbers costs two
small softmaxes. The score of a document is the sum of the logarithms of its tokens' conditional probabilities.

Vocabulary: all words of all documents, with their counts, in a table that grows with the corpus and stays distributed. The most
frequent words have numbers of their own, all others share ``SHARED`` numbers by hash; which word of a shared number it is has the
word's share of the number's tokens as its probability, joined at scoring. So the probabilities of all words of the corpus sum to one
in any window. In windows, words that share a number are alike.

Texts are read twice: for the counts, and to be coded as numbers in blocks of ``BLOCK_BYTES``, each with the other words that it has, once;
all that follows works on these codes. Training sees every token of every document once, in ``ROUNDS`` rounds. Documents are dealt to
rounds and to shards of about ``SHARD_TOKENS`` by hash, so that neither how the table is sorted or clustered nor how many partitions
it has matters. In a round each shard fits its own copy in numpy, from the average of the last round, with the step sizes
reached there. Each row of the embeddings, and each parameter of the rest, is averaged by the number of tokens that have changed it
in each copy; copies that never saw a word don't pull it back to the start. What reaches the driver is one network a round.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from . import text as T
from .shared import cut, returning, set_apart, swept

HALF = 64
SIZE = HALF * HALF
SHARED = 1024
SIDE, WIDTH = 2, 12
BATCH, RATE, L2 = 2048, 0.25, 1e-5
BLOCK = 1024  #: rows of parameters that are averaged together
ROUNDS = 4
SHARD_TOKENS, BLOCK_BYTES = 2_000_000, 8_000_000
EDGE = SIZE  #: number of what lies outside the text
_CONTEXT = [*range(-SIDE, 0), *range(1, SIDE + 1)]
_TABLES = np.arange(len(_CONTEXT)) * (SIZE + 1)  #: where the embeddings of each place of the window begin


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): hash and count of each word of all documents; tasks count before the shuffle."""

    def run(batches):
        held, size = [], 0

        def out():
            w = np.concatenate([h for h, _ in held])
            c = np.concatenate([c for _, c in held])
            u, at = np.unique(w, return_inverse=True)
            n = np.bincount(at, c).astype(np.int64)
            for i in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], ["word", "n"])

        for b in batches:
            for _, _, data, offsets in T.chunks(b.column("text")):
                u, c = np.unique(T.words(data, offsets, T.FOLDED).hash, return_counts=True)
                held.append((u, c))
                size += len(u)
                if size > 2_000_000:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return docs.select("text").mapInArrow(returning(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent words, most frequent first; of equals by hash. As many as have numbers of their own."""
    return most_frequent(count_words(docs))


def most_frequent(counts: DataFrame) -> np.ndarray:
    top = counts.orderBy(F.desc("n"), "word").limit(SIZE - SHARED).select("word").toArrow()
    return top.column("word").to_numpy().astype(np.int64)


def log_shares(counts: DataFrame, own: np.ndarray) -> DataFrame:
    """(word, log_share) of each word without a number of its own: logarithm of its share of the tokens with its number."""
    frequent = counts.sparkSession.createDataFrame([(w,) for w in own.tolist()], "word long")
    others = counts.join(F.broadcast(frequent), "word", "left_anti").withColumn("number", F.shiftrightunsigned("word", 54) % SHARED)
    total = others.groupBy("number").agg(F.sum("n").alias("total"))
    return others.join(F.broadcast(total), "number").select("word", F.log(F.col("n") / F.col("total")).alias("log_share"))


def numbers(words: T.Words, own: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The number of each word; own: sorted hashes of frequent words, place: their numbers."""
    h = words.hash.view(np.int64)
    shared = SIZE - SHARED + (words.hash >> np.uint64(54)).astype(np.int64) % SHARED
    if not len(own):
        return shared
    at = np.minimum(np.searchsorted(own, h), len(own) - 1)
    return np.where(own[at] == h, place[at], shared)


def windows(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token the numbers of those around it."""
    padded = np.concatenate([np.full(SIDE, EDGE), token, np.full(SIDE, EDGE)])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    of = np.concatenate([np.full(SIDE, -1), doc, np.full(SIDE, -1)])
    n = len(token)
    return np.stack([np.where(of[SIDE + d : SIDE + d + n] == doc, padded[SIDE + d : SIDE + d + n], EDGE) for d in _CONTEXT], 1)


def start(seed: int = 7) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    shapes = {"e": (len(_CONTEXT), SIZE + 1, WIDTH), "a": (WIDTH, HALF), "a0": (HALF,), "c": (HALF, WIDTH), "b": (WIDTH, HALF), "b0": (HALF, HALF)}
    return {k: (random.standard_normal(s) * (0.0 if k in ("a0", "b0") else 0.1)).astype(np.float32) for k, s in shapes.items()}


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the first axis."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each column the logarithm of the softmax at one place; all others need not be divided."""
    x -= x.max(0)
    own = x[at, np.arange(len(at))]
    np.exp(x, out=x)
    return own - np.log(x.sum(0))


def _logits(m: dict[str, np.ndarray], x: np.ndarray, high: np.ndarray):
    """Hidden states of both halves (a row for each token), and their logits (a column for each)."""
    table = m["e"].reshape(-1, WIDTH)
    h = table.take(x[:, 0], 0)
    for k in range(1, x.shape[1]):
        h += table.take(x[:, k] + _TABLES[k], 0)
    np.tanh(h, out=h)
    p = m["a"].T @ h.T
    p += m["a0"][:, None]
    g = h + m["c"].take(high, 0)
    q = m["b"].T @ g.T
    q += m["b0"].T[:, high]
    return h, p, g, q


def forward(m: dict[str, np.ndarray], x: np.ndarray, high: np.ndarray):
    """Hidden states of both halves (a row for each token), and their distributions (a column for each)."""
    h, p, g, q = _logits(m, x, high)
    return h, _softmax(p), g, _softmax(q)


def log_probabilities(m: dict[str, np.ndarray], token: np.ndarray, x: np.ndarray) -> np.ndarray:
    out, least = np.empty(len(token)), np.float32(math.log(1e-30))
    for i in range(0, len(token), BATCH):
        high, low = np.divmod(token[i : i + BATCH], HALF)
        _, p, _, q = _logits(m, x[i : i + BATCH], high)
        out[i : i + BATCH] = np.maximum(_log_softmax_at(p, high), least) + np.maximum(_log_softmax_at(q, low), least)
    return out


class Trainer:
    """Minibatch gradient steps with a rate for each parameter (AdaGrad)."""

    def __init__(self, m: dict[str, np.ndarray] | None = None, s: dict[str, np.ndarray] | None = None):
        self.m = m or start()
        self.s = s or {k: np.full(v.shape[:2] if k == "e" else v.shape, 1e-2, np.float32) for k, v in self.m.items()}
        self.seen = np.zeros((len(_CONTEXT), SIZE + 1), np.int64)  #: tokens that have changed each embedding
        self.high = np.zeros(HALF, np.int64)  #: tokens of each first half
        self.tokens = 0

    def step(self, token: np.ndarray, x: np.ndarray) -> None:
        m, s, n = self.m, self.s, len(token)
        order = np.argsort(token.astype(np.int16), kind="stable")  # equal first halves stand together; of 16 bits: sorted by radix
        token, x = token[order], x[order]
        high, low = np.divmod(token, HALF)
        rows = np.arange(n)
        h, p, g, q = forward(m, x, high)
        p[high, rows] -= 1
        q[low, rows] -= 1
        dg = m["b"] @ q
        dh = (m["a"] @ p + dg).T * (1 - h * h)
        new = np.flatnonzero(np.diff(high, prepend=-1))
        halves, count = high[new], np.diff(new, append=n)
        dc, db0 = np.zeros_like(m["c"]), np.zeros_like(m["b0"])
        dc[halves], db0[halves] = np.add.reduceat(dg, new, 1).T, np.add.reduceat(q, new, 1).T
        for k, d in (("a", (p @ h).T), ("a0", p.sum(1)), ("b", (q @ g).T), ("c", dc), ("b0", db0)):
            d = d / n + L2 * m[k]
            s[k] += d * d
            m[k] -= RATE * d / np.sqrt(s[k])
        at = (x + _TABLES).ravel()
        order = np.argsort(at.astype(np.int16 if _TABLES[-1] + SIZE < 2**15 else np.int32), kind="stable")  # of 16 bits: sorted by radix
        at = at[order]
        new = np.flatnonzero(np.diff(at, prepend=-1))
        d, v = np.add.reduceat(dh.take(order // x.shape[1], 0), new) / n, at[new]
        table, sizes, seen = m["e"].reshape(-1, WIDTH), s["e"].reshape(-1), self.seen.reshape(-1)
        seen[v] += np.diff(new, append=len(at))
        if s["e"].ndim == 2:
            sizes[v] += (d * d).mean(1)
            table[v] -= RATE * d / np.sqrt(sizes[v])[:, None]
        else:
            table[v] -= RATE * d / np.sqrt(s["e"].reshape(-1, WIDTH)[v])
        self.high[halves] += count
        self.tokens += n

    def weights(self) -> np.ndarray:
        """For each row of the embeddings and each parameter of the rest how many tokens have changed it, in the order of ``flat(self.s)``."""
        of = {"e": self.seen, "c": self.high[:, None], "b0": self.high[:, None]}
        return flat({k: np.broadcast_to(of.get(k, np.int64(self.tokens)), v.shape) for k, v in self.s.items()}).astype(np.float64)


def flat(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in m.values()])


def shaped(x: np.ndarray, like: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in (like or start()).items():
        out[k] = x[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def blocks() -> list[tuple[slice, slice]]:
    """Blocks of rows: where they are in ``flat`` of step sizes or weights, and in ``flat`` of parameters."""
    rows, all_ = len(_CONTEXT) * (SIZE + 1), len(flat(Trainer().s))
    out = [(slice(i, min(i + BLOCK, rows)), slice(i * WIDTH, min(i + BLOCK, rows) * WIDTH)) for i in range(0, rows, BLOCK)]
    more = rows * (WIDTH - 1)
    return out + [(slice(i, min(i + BLOCK, all_)), slice(i + more, min(i + BLOCK, all_) + more)) for i in range(rows, all_, BLOCK)]


def averaged(w: np.ndarray, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of weights, and weighted means of parameters and step sizes, over copies (first axis). What no copy has changed is as it was."""
    whole = w.sum(0)
    share = np.where(whole > 0, w / np.maximum(whole, 1), 1 / len(w))
    return whole, (np.repeat(share, x.shape[1] // w.shape[1], 1) * x).sum(0), (share * s).sum(0)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers with their lowest bytes first, then the next, compressed."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    x = np.frombuffer(pa.Codec("zstd").decompress(raw[8:], n * size), np.uint8).reshape(size, n)
    return np.ascontiguousarray(x.T).view(kind).reshape(-1)


def coded(docs: DataFrame, own: np.ndarray) -> DataFrame:
    """docs (text and any other columns) as numbers, in blocks. A block has a row -1 with its distinct words without numbers of their own, sorted.

    Its rows from 0 on are documents, with other columns, the numbers of their tokens and, for words without own numbers, places in the block's list;
    deal is a hash of the text and of how many copies of it came before in the block.
    Not the same if computed again, as blocks are named by partition: to be checkpointed before use.
    """
    others = [Y.StructField(f.name, f.dataType) for f in docs.schema.fields if f.name != "text"]
    schema = Y.StructType([Y.StructField("block", Y.StringType()), Y.StructField("row", Y.IntegerType()), *others, Y.StructField("deal", Y.LongType()), Y.StructField("numbers", Y.BinaryType()), Y.StructField("places", Y.BinaryType()), Y.StructField("words", Y.ArrayType(Y.LongType()))])
    keep = [f.name for f in others]
    order = np.argsort(own)

    def run(batches):
        from pyspark import TaskContext

        name, held, size, k, copies = TaskContext.get().partitionId(), [], 0, 0, Counter()

        def deal(text: np.ndarray) -> int:
            h = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
            copies[h] += 1
            return h if copies[h] == 1 else hash((h, copies[h]))

        def out():
            rare = [h for *_, h in held]
            words, at = np.unique(np.concatenate(rare), return_inverse=True)
            block, row, edge = f"{name}-{k}", 0, 0
            kinds = [pa.nulls(1, held[0][0].column(c).type) for c in keep]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int32()), *kinds, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))], schema.names)
            for rest, deals, token, first, h in held:
                n, own_at = len(first) - 1, at[edge : edge + len(h)].astype(np.uint32)
                edge += len(h)
                cuts = np.concatenate([[0], np.cumsum(token >= SIZE - SHARED)])[first]
                numbers_ = pa.array([_pack(token[first[d] : first[d + 1]]) for d in range(n)], pa.binary())
                places = pa.array([_pack(own_at[cuts[d] : cuts[d + 1]]) for d in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([block] * n), pa.array(range(row, row + n), pa.int32()), *rest.columns, pa.array(deals, pa.int64()), numbers_, places, pa.nulls(n, pa.list_(pa.int64()))], schema.names)
                row += n

        for b in batches:
            for i, j, data, offsets in T.chunks(b.column("text")):
                w = T.words(data, offsets, T.FOLDED)
                token = numbers(w, own[order], order).astype(np.uint16)
                deals = [deal(data[x:y]) for x, y in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                held.append((b.select(keep).slice(i, j - i), deals, token, w.first, w.hash.view(np.int64)[token >= SIZE - SHARED]))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield from out()
                    held, size, k = [], 0, k + 1
                    copies.clear()
        if held:
            yield from out()

    return docs.select(*keep, "text").mapInArrow(returning(run), schema)


def train(docs: DataFrame, own: np.ndarray) -> np.ndarray:
    """Parameters after all rounds over docs (text). Without any token the network is the untrained one."""
    docs = docs.select("text")
    return train_coded(cut(coded(docs, own)), count_words(docs).agg(F.sum("n")).first()[0] or 0)


def train_coded(code: DataFrame, tokens: int) -> np.ndarray:
    """The same from what ``coded`` gives, with so many tokens in all."""
    x, s, shards = flat(start()), flat(Trainer().s), max(1, round(tokens / ROUNDS / SHARD_TOKENS))
    dealt = code.where("row >= 0").select("deal", "numbers")
    for r in range(ROUNDS):
        own = dealt.where(F.pmod("deal", F.lit(ROUNDS)) == r).withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)))
        x, s = _round(own, shards, x, s)
        swept(code.sparkSession)  # what the round has shuffled need not lie there while texts are scored
    return x


def _round(dealt: DataFrame, shards: int, before: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and step sizes, averaged over the shards, which each start from those before."""

    def fitted(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("deal").to_numpy(), kind="stable")))
        t, random, shard = Trainer(shaped(before), shaped(sizes, Trainer().s)), np.random.default_rng(3), rows.column("shard")[0].as_py()
        held, size, last = [], 0, rows.num_rows - 1
        for i, raw in enumerate(rows.column("numbers")):
            held.append(_unpack(raw.as_py(), "<u2"))
            size += len(held[-1])
            if size >= 200_000 or i == last:
                token, first = np.concatenate(held).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in held])])
                x, mixed = windows(token, first), random.permutation(len(token))
                for k in range(0, len(token), BATCH):
                    part = mixed[k : k + BATCH]
                    t.step(token[part], x[part])
                held, size = [], 0
        w, x, s, at = t.weights(), flat(t.m), flat(t.s), blocks()
        columns = [pa.array([v[b[k]] for b in at], pa.list_(kind)) for v, k, kind in ((w, 0, pa.float64()), (x, 1, pa.float32()), (s, 0, pa.float32()))]
        out = pa.Table.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array([shard] * len(at), pa.int64()), *columns], ["block", "shard", "w", "x", "s"])
        return out if t.tokens else out.slice(0, 0)

    def mean(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("shard").to_numpy(), kind="stable")))
        w, x, s = (np.stack([np.asarray(v.values) for v in rows.column(c)]).astype(np.float64) for c in "wxs")
        out = [pa.array([v], pa.list_(kind)) for v, kind in zip(averaged(w, x, s), (pa.float64(), pa.float32(), pa.float32()), strict=True)]
        return pa.table([rows.column("block")[:1], rows.column("shard")[:1], *out], ["block", "shard", "w", "x", "s"])

    # Networks meet in groups first, then all: as many groups as each has shards, so that none grows with the corpus but by a square root.
    schema = "block int, shard long, w array<double>, x array<float>, s array<float>"
    copies = dealt.groupBy("shard").applyInArrow(fitted, schema)
    if shards > 4:
        copies = copies.groupBy("block", F.pmod("shard", F.lit(math.isqrt(shards)))).applyInArrow(mean, schema)
    got = copies.groupBy("block").applyInArrow(mean, schema).select("block", "x", "s").orderBy("block").toArrow()
    if not got.num_rows:
        return before, sizes
    return tuple(np.concatenate([np.asarray(v.values) for v in got.column(c)]).astype(np.float32) for c in "xs")


def _scored(docs: list[np.ndarray], m: dict[str, np.ndarray]) -> np.ndarray:
    """Log-likelihood of the numbers of each document; many are taken together, of bounded size."""
    total, i = np.zeros(len(docs)), 0
    while i < len(docs):
        j, size = i, 0
        while j < len(docs) and (j == i or size + len(docs[j]) <= 200_000):
            size += len(docs[j])
            j += 1
        token = np.concatenate(docs[i:j]).astype(np.int64)
        if len(token):
            n = [len(x) for x in docs[i:j]]
            x = windows(token, np.concatenate([[0], np.cumsum(n)]))
            total[i:j] = np.bincount(np.repeat(np.arange(j - i), n), log_probabilities(m, token, x), j - i)
        i = j
    return total


def score(docs: DataFrame, own: np.ndarray, parameters: np.ndarray, counts: DataFrame | None = None) -> DataFrame:
    """docs (text and any other columns) with n_tokens and log_likelihood, in place of columns of these names; a text without words has 0 of both.

    Without ``counts`` (word, n), words that share a number have the probability of the number; with it, their own.
    """
    docs, back = set_apart(docs.drop("n_tokens", "log_likelihood"), "text")
    code = cut(coded(docs.withColumn("_text", F.col("text")), own))
    return back(score_coded(code, own, parameters, counts).withColumnRenamed("_text", "text"), "n_tokens", "log_likelihood")


def score_coded(code: DataFrame, own: np.ndarray, parameters: np.ndarray, counts: DataFrame | None, tasks: int | None = None) -> DataFrame:
    """The same from what ``coded`` gives: its other columns, n_tokens and log_likelihood."""
    keep = [f for f in code.schema.fields if f.name not in ("block", "row", "deal", "numbers", "places", "words")]
    names = [f.name for f in keep]
    own_shares = counts is not None
    results = [Y.StructField("n_tokens", Y.LongType()), Y.StructField("log_likelihood", Y.DoubleType())]
    places = [code.schema[c] for c in ("block", "row", "places")] if own_shares else []
    judged, schema = Y.StructType([*places, *keep, *results]), Y.StructType([*keep, *results])

    def by_network(batches):
        m = shaped(parameters)
        for b in batches:
            docs = [_unpack(x, "<u2") for x in b.column("numbers").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in judged.names[:-2]), pa.array([len(x) for x in docs], pa.int64()), pa.array(_scored(docs, m))], judged.names)

    def with_shares(batches):
        block, shares = None, np.zeros(0, np.float32)
        for b in batches:
            within, rows = [], []
            parts = (b.column(c).to_pylist() for c in ("block", "row", "places"))
            for i, (name, row, places) in enumerate(zip(*parts, strict=True)):
                if row < 0:
                    block, shares = name, b.column("shares")[i].values.to_numpy()
                    continue
                rows.append(i)
                at = _unpack(places, "<u4")
                if len(at) and (name != block or at.max() >= len(shares)):
                    raise ValueError(f"block {name} lacks shares of its words")
                within.append(float(shares[at].sum(dtype=np.float64)) if len(at) else 0.0)
            out = b.select(schema.names).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array(out.column("log_likelihood").to_numpy() + np.array(within))], schema.names)

    # The network needs no shares, so the numbers of the texts stay where they are; only places of other words go to their blocks' shares.
    docs = code.where("row >= 0").select(*(f.name for f in places), *names, "numbers").mapInArrow(returning(by_network), judged)
    if not own_shares:
        return docs
    words = code.where("row < 0").select("block", F.explode("words").alias("word"))
    shares = words.join(log_shares(counts, own), "word").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("word", F.col("log_share").cast("float").alias("log_share")))).alias("s"))
    shares = shares.select("block", F.lit(-1).alias("row"), F.col("s.log_share").alias("shares"))
    tasks = tasks or int(code.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = docs.unionByName(shares, allowMissingColumns=True).repartition(tasks, "block").sortWithinPartitions("block", "row")
    return both.mapInArrow(returning(with_shares), schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood (null without tokens) for every row of docs.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Null texts count as empty. Rows with the same doc_id, or none, stay.
    """
    docs = docs.select("doc_id", "text")
    counts = cut(count_words(docs))
    own, tokens = most_frequent(counts), counts.agg(F.sum("n")).first()[0] or 0
    code = cut(coded(docs, own))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens // (8 * SHARD_TOKENS))
    out = score_coded(code, own, train_coded(code, tokens), counts, tasks)
    return out.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))
