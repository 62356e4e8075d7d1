import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cartweave.llm import langid

SYLLABLES = {"aa": "ka ki ko ta te no ru mi".split(), "bb": "sch en ung der lich gen ß".split(), "cc": "ция ста про ени ого".split(), "dd": "ción que los ent ar é".split()}


@pytest.fixture(scope="module")
def corpus(odd_rows):
    r, rows = random.Random(2), [(i, t, "aa") for i, t in odd_rows if t is None or len(t) < 1000]
    for i in range(300):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(r.choice([2, 20, 200]))]
        rows.append((100 + i, r.choice([" ", ", ", " 12 "]).join(words).title(), lang if r.random() < 0.9 else None))
    return rows


@pytest.fixture
def table(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string").repartition(4)


def grams(text):
    out = Counter()
    clean = re.sub(r"[^\w]|[\d_]", " ", (text or "").lower())
    for word in clean.split():
        framed = f" {word} "
        for k in (1, 2, 3):
            for i in range(len(framed) - k + 1):
                if (g := framed[i : i + k]).strip():
                    out[g] += 1
    return out


def key(g):
    code = 0
    for c in g:
        code = code << 21 | ord(c)
    return code


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))[:size]]


def brute(rows, size):
    total = defaultdict(Counter)
    for i, t, lang in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and t is not None:
            total[lang].update(grams(t))
    profiles = {x: {g: n for n, g in enumerate(ranked(total[x], size))} for x in sorted(total) if total[x]}
    out = []
    for i, t, _ in rows:
        own = ranked(grams(t), size)
        held = i is None or zlib.crc32(str(i).encode()) % 4 == 2
        if not own:
            out.append((i, held, "und", 0.0))
            continue
        far = sorted((sum(abs(p[g] - n) if g in p else size for n, g in enumerate(own)), x) for x, p in profiles.items())
        out.append((i, held, far[0][1], min(max(1 - far[0][0] / far[1][0], 0), 1) if far[1][0] else 0.0))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [400_000, 50])
def test_as_brute_force(table, corpus, with_clashes, monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    got = sorted((tuple(r) for r in langid.report(with_clashes(table)).collect()), key=str)
    want = brute(corpus, langid.PROFILE)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_held_out_accuracy(table):
    out = langid.report(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und' and lang is not null")
    right, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 40 and right / n > 0.97


def test_labels_and_ids_are_no_inputs(spark, table, corpus):
    before = {r["doc_id"]: tuple(r)[2:] for r in langid.report(table).collect()}
    changed = table.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert {r["doc_id"]: tuple(r)[2:] for r in langid.report(changed).collect()} == before


def test_small_tables(spark, table):
    assert langid.report(table.limit(0)).collect() == []
    unlabelled = langid.report(table.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    single = langid.report(table.withColumn("lang", F.lit("q")))
    assert {r["lang_pred"] for r in single.collect()} == {"q", "und"} and all(0 <= r["score"] <= 1 for r in single.collect())


def test_columns_pass(table, with_clashes, own_columns):
    own_columns(langid.predict(with_clashes(table), langid.learn(table.limit(0))), but={"lang_pred", "lang_score"})


@pytest.mark.parametrize("block", [1, 3])
def test_languages_in_blocks(table, corpus, monkeypatch, block):
    """With more languages than are sent to tasks at once the result is the same."""
    monkeypatch.setattr(langid, "LANGUAGES", block)
    got = sorted((tuple(r) for r in langid.report(table).collect()), key=str)
    want = brute(corpus, langid.PROFILE)
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_any_number_of_languages(spark, table, monkeypatch):
    """A column of languages that is as good as an id."""
    monkeypatch.setattr(langid, "LANGUAGES", 50)
    rows = langid.report(table.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id")))).collect()
    assert len(rows) == table.count() and all(0 <= r["score"] <= 1 for r in rows)
