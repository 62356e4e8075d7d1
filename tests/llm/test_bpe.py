import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cartweave.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def corpus(odd_rows, prose):
    r = random.Random(8)
    odd = ["<|endoftext|>", "a" * 5000, "…—“” 12345 ０１２ don't I'LL\r\n\r\n  x", "🏳️‍🌈 👩‍👩‍👧", "́é", "{}()[];\n\tif (x) { y(); }"]
    return [*odd_rows, *((100 + i, t) for i, t in enumerate(odd)), *((200 + i, prose(i, r.choice([1, 40, 800]))) for i in range(150)), *((400 + i, odd[2] * 7) for i in range(40))]


def want(rows, library):
    out = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def result(out):
    return sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()), key=str)


@pytest.mark.parametrize("block", [12_000_000, 3000])
def test_as_the_library(frame, corpus, library, with_clashes, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    docs = with_clashes(frame(corpus)).sortWithinPartitions("doc_id", "text")
    assert result(bpe.report(docs, PATH, PATTERN)) == want(corpus, library)


def test_stored_table(spark, frame, corpus, library, tmp_path):
    frame(corpus).write.parquet(f"{tmp_path}/docs")
    assert result(bpe.report(spark.read.parquet(f"{tmp_path}/docs"), PATH, PATTERN, stable=True)) == want(corpus, library)


def test_lost_words_are_an_error():
    main = bpe._packed(np.array([7, 8]).tobytes(), np.array([False, False]).tobytes(), bpe._planes(np.array([3, 1], np.uint32)), (3).to_bytes(8, "little"), bpe._planes(np.array([0, 2, 1, 0], np.uint32)))
    part = lambda places, words: (bpe._packed(bpe._planes(np.diff(places, prepend=0))), bpe._packed(bpe._planes(np.array([len(w) for w in words], np.uint32)), np.concatenate(words).astype("<u2").tobytes()))
    both = [part([1], [[5]]), part([0, 2], [[1, 2], [3]])]
    ids, sequences, pool, first = bpe.put_together("b", main, both, "<u2")
    assert ids.to_pylist() == [7, 8] and [bpe.gathered(pool, first, x)[1].tolist() for x in sequences] == [[1, 2, 3, 5], [1, 2]]
    for lost in (both[:1], both[1:], [*both, both[0]], []):
        with pytest.raises(ValueError, match="of its 3 words"):
            bpe.put_together("b", main, lost, "<u2")


def test_unknown_ids_are_an_error():
    with pytest.raises(ValueError, match="not in the token table"):
        bpe._token_bytes(PATH).joined(np.array([10**6]))


def test_empty_tables(frame):
    assert bpe.report(frame([]), PATH, PATTERN).collect() == []
    assert [tuple(r) for r in bpe.encode(frame([(1, None), (2, "")]), PATH, PATTERN).orderBy("doc_id").collect()] == [(1, b""), (2, b"")]


def test_decoding_keeps_columns(spark, with_clashes, own_columns, library):
    ids = np.array(library.encode_ordinary("some text 😀"), "<u4").tobytes()
    tokens = with_clashes(spark.createDataFrame([(1, bytearray(ids)), (2, None)], "doc_id long, ids binary"))
    got = {r["doc_id"]: r["bytes"] for r in own_columns(bpe.decode(tokens, PATH), but={"ids", "bytes"})}
    assert got == {1: "some text 😀".encode(), 2: None}


@settings(max_examples=200, deadline=None)
@given(word=st.one_of(st.binary(min_size=1, max_size=60), st.text(min_size=1, max_size=40).map(str.encode), st.sampled_from([b"aaaaaaaaaaaaaaa", b"abababababab", b" thethethe", b"\xff" * 9])))
def test_merges(word):
    _, ranks = bpe._tools(PATH, "")
    parts = [bytes([b]) for b in word]
    while word not in ranks:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            break
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert bpe.merged(word, ranks) == ([ranks[word]] if word in ranks else [ranks[p] for p in parts])


def test_large_table_is_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_TABLE_BYTES", 10)
    with pytest.raises(ValueError, match="more than 10"):
        bpe.read_ranks(PATH)
