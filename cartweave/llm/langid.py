"""Language identification by rank-order profiles of character n-grams.

A language's profile is its ``PROFILE`` most frequent n-grams of one to three characters in rank order, counted over all training
texts. A document's own most frequent n-grams are compared with each profile: the out-of-place distance adds up how far the
ranks are apart, and ``PROFILE`` for each n-gram that the profile lacks. The least distance wins; of equal ones the first language.

Only letters count: all else is one gap between words, a word is framed by gaps, letters are in lower case.

Profiles are sent to tasks in blocks of at most ``LANGUAGES``; with more values of lang the texts are compared with one block after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from .shared import cut, returning, set_apart

PROFILE = 400
LANGUAGES = 2_000
UNKNOWN = "und"
CHUNK = 400_000
_GAP, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of some texts: codes of all n-grams with letters (three characters of 21 bits, the first in the highest), and their texts' numbers."""
    clean = [f" {_GAP.sub(' ', t.lower()).strip(' ')} " if t and _LETTER.search(t) else "" for t in texts]
    chars = np.frombuffer("".join(clean).encode("utf-32-le"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), [len(c) for c in clean])
    n, codes, owners = len(chars), [], []
    space = chars == 32
    for k in (1, 2, 3):
        if n < k:
            break
        code, keep = np.zeros(n - k + 1, np.int64), of[: n - k + 1] == of[k - 1 :]
        for i in range(k):
            code = code << 21 | chars[i : n - k + 1 + i]
            if 0 < i < k - 1:  # a gap within is no n-gram
                keep &= ~space[i : n - k + 1 + i]
        if k < 3:
            keep &= ~space[: n - k + 1] if k == 1 else ~(space[:-1] & space[1:])
        else:
            keep &= ~(space[:-2] & space[2:] & space[1:-1])
        codes.append(code[keep])
        owners.append(of[: n - k + 1][keep])
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(owners)


def _parts(texts: list[str | None], limit: int = CHUNK):
    """Ranges of texts of about so many characters."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each n-gram is in the texts of each language; tasks count before the shuffle."""

    def run(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for lang, (g, n) in total.items():
                for i in range(0, len(g), 50_000):
                    part = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g[part])), pa.array(g[part]), pa.array(n[part])], ["lang", "gram", "n"])

        for b in batches:
            langs, texts = np.array(b.column("lang").to_pylist(), object), b.column("text").to_pylist()
            for i, j in _parts(texts, 2 * CHUNK):
                for lang in sorted(set(langs[i:j].tolist())):
                    g, n = np.unique(grams([texts[x] for x in range(i, j) if langs[x] == lang])[0], return_counts=True)
                    if lang in total:
                        g0, n0 = total[lang]
                        g, at = np.unique(np.concatenate([g0, g]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([n0, n])).astype(np.int64)
                    total[lang] = g, n.astype(np.int64)
                if sum(len(g) for g, _ in total.values()) > 2_000_000:
                    yield from out()
                    total.clear()
        yield from out()

    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(returning(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Profiles:
    """The profiles of any number of languages, of which one block at a time is in the driver."""

    def __init__(self, top: DataFrame, languages: int):
        self.top, self.blocks = top, max(1, -(-languages // LANGUAGES))

    def __iter__(self) -> Iterator[dict[str, np.ndarray]]:
        """For each language its most frequent n-grams, most frequent first; languages in order."""
        for k in range(self.blocks):
            rows = self.top.where(F.pmod(F.xxhash64("lang"), F.lit(self.blocks)) == k).orderBy("lang", "rank").toArrow()
            langs, grams_ = np.array(rows.column("lang").to_pylist(), object), rows.column("gram").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], langs[1:] != langs[:-1]])) if len(langs) else np.zeros(0, np.int64)
            edges = [*first.tolist(), len(langs)]
            yield {langs[a]: grams_[a:b] for a, b in zip(edges, edges[1:], strict=False)}


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """For each language of docs (text, lang) its most frequent n-grams; of equals the one of the least code.

    Rows without text or language teach nothing.
    """
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")  # tasks keep the best of each language before the shuffle
    top = cut(counted(docs).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= size).select("lang", "gram", "rank"))
    return Profiles(top, top.where("rank = 1").count())


def predict(docs: DataFrame, profiles: Profiles, size: int = PROFILE) -> DataFrame:
    """docs (text and any other columns) with ``lang_pred`` and ``lang_score``.

    Columns of these names are replaced. Null texts, texts without letters, and all texts if nothing has been learnt, are ``und`` with score 0. The score is 1 less the
    least distance as a share of the next language's, or of the greatest possible distance if there is one language.
    """
    docs, back = set_apart(docs.drop("lang_pred", "lang_score"), "text")
    names = docs.columns
    best, blocks = None, profiles.blocks
    for k, block in enumerate(profiles):
        docs = _compared(docs, names, block, size, best is not None)
        best = docs if k == blocks - 1 else cut(docs)
        docs = best
    score = F.when(F.col("_lang").isNotNull() & (F.col("_grams") > 0) & (F.col("_next") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_least") / F.col("_next")))).otherwise(0.0)
    return back(docs.select(*names, F.when(F.col("_grams") > 0, F.coalesce("_lang", F.lit(UNKNOWN))).otherwise(UNKNOWN).alias("lang_pred"), score.alias("lang_score")), "lang_pred", "lang_score")


_STATE = "_lang string, _least double, _next double, _grams long"


def _compared(docs: DataFrame, names: list[str], block: dict[str, np.ndarray], size: int, more: bool) -> DataFrame:
    """docs with the best language, its distance, the next one's and the number of n-grams; more: it has these from other blocks."""
    langs = np.array(list(block), object)
    sizes = np.array([len(p) for p in block.values()], np.int64)
    gram, lang, place = np.concatenate([np.zeros(0, np.int64), *block.values()]), np.repeat(np.arange(len(langs)), sizes), np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in sizes)])
    order = np.argsort(gram, kind="stable")
    gram, lang, place = gram[order], lang[order], place[order]
    known, first = np.unique(gram, return_index=True)
    first = np.append(first, len(gram))
    schema = Y.StructType([*(docs.schema[c] for c in names), *Y._parse_datatype_string(_STATE).fields])

    def ranked(texts):
        """Of some texts: (text's number, code, rank) of their most frequent n-grams."""
        code, of = grams(texts)
        order = np.lexsort((code, of))
        code, of = code[order], of[order]
        new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        code, of, count = code[new], of[new], np.diff(new, append=len(of))
        order = np.lexsort((code, -count, of))
        code, of = code[order], of[order]
        rank = np.arange(len(of)) - np.searchsorted(of, np.arange(len(texts) + 1))[of]
        return of[rank < size], code[rank < size], rank[rank < size]

    def distances(of, code, rank, n):
        """A row for each text, a column for each language: what profiles lack counts in full, what they have makes it less."""
        at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
        hit = known[at] == code if len(known) else np.zeros(len(code), bool)
        of_hit, at, rank = of[hit], at[hit], rank[hit]
        width = first[at + 1] - first[at]
        to = np.repeat(first[at] - np.cumsum(width) + width, width) + np.arange(width.sum())
        less = size - np.abs(place[to] - np.repeat(rank, width))
        whole = np.bincount(of, minlength=n) * float(size)
        return whole[:, None] - np.bincount(np.repeat(of_hit, width) * len(langs) + lang[to], less, n * len(langs)).reshape(n, len(langs))

    def judged(texts):
        of, code, rank = ranked(texts)
        n, count = len(texts), np.bincount(of, minlength=len(texts))
        if not len(langs):
            return np.full(n, None, object), np.full(n, np.inf), np.full(n, np.inf), count
        best, least, after = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        step = max(1, 4_000_000 // len(langs))
        for i in range(0, n, step):
            a, b = np.searchsorted(of, [i, i + step])
            d = distances(of[a:b] - i, code[a:b], rank[a:b], min(step, n - i))
            own = d.argmin(1)
            rows = np.arange(len(d))
            best[i : i + step], least[i : i + step] = own, d[rows, own]
            d[rows, own] = np.inf
            after[i : i + step] = np.minimum(d.min(1), np.bincount(of[a:b] - i, minlength=len(d)) * float(size)) if len(langs) == 1 else d.min(1)
        return langs[best], least, after, count

    def run(batches):
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            for i, j in _parts(texts):
                out.append(judged(texts[i:j]))
            name, least, after, count = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, object), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
            if more:
                name0, least0, after0 = np.array(b.column("_lang").to_pylist(), object), b.column("_least").to_numpy(), b.column("_next").to_numpy()
                swap = (least0 < least) | (least0 == least) & np.array([x is None or (y is not None and y < x) for x, y in zip(name, name0, strict=True)], bool)
                after = np.minimum(np.minimum(after, after0), np.maximum(least, least0))
                name, least = np.where(swap, name0, name), np.where(swap, least0, least)
            columns = [pa.array(name.tolist(), pa.string()), pa.array(least), pa.array(after), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *columns], schema.names)

    return docs.mapInArrow(returning(run), schema)


def held_out() -> Column:
    """Rows that teach nothing: crc32 of doc_id as text leaves 2 when divided by 4; so do rows without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, learnt from those that are not held out.

    Null texts and texts without letters are ``und`` with score 0; rows without doc_id are held out; repeated rows each have their own result.
    """
    profiles = learn(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text", held_out().alias("held_out")), profiles)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
