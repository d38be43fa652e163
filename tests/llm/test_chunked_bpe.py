"""Chunked BPE against direct encoding and decoding by the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from clickcast.llm import chunked_bpe
from clickcast.llm.word_ids import default_vocabulary, load_tokenizer, word_ids


@pytest.fixture(scope="module")
def direct():
    return load_tokenizer(default_vocabulary())


def prose(rnd, words):
    parts = ["the", "ünd", "don't", "x1", "12", "résumé", "日本", "...", "́", "<|endoftext|>", "Straße,", "a\x01b"]
    return "".join(rnd.choice(parts) + rnd.choice([" ", " ", "\n", " ", "  ", ""]) for _ in range(words))


def texts():
    rnd = random.Random(5)
    passage, other = prose(rnd, 900), prose(rnd, 700)
    mixed = [prose(rnd, rnd.randrange(300)) + passage + prose(rnd, rnd.randrange(300)) for _ in range(12)]
    unspaced = "".join(rnd.choice("abcdefgh日本語テキスト") for _ in range(30_000))
    return [*mixed, passage, passage, other + passage + other, unspaced, "x" + unspaced, "a" * 20_000, " " * 9_000,
            "ab " * 9_000, "", None, " ", "<|startoftext|>a<|endoftext|>", *[prose(rnd, rnd.randrange(40)) for _ in range(40)]]


def test_ids_and_digests_equal_the_library(spark, direct):
    rows = [(i if i % 9 else None, t, "x", "y", 1) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ids string, n long").repartition(4)
    got = chunked_bpe.encode_documents(spark, df, default_vocabulary()).collect()
    want = sorted((d or -1, direct.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in rows)
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == want
    cols = chunked_bpe.digests(default_vocabulary())
    ids = [direct.encode(t or "", add_special_tokens=False).ids for t in texts()]
    out = cols([np.array(i, dtype="<u4") for i in ids])
    assert out["n_tokens"] == [len(i) for i in ids]
    assert out["ids_sha256"] == [hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest() for i in ids]
    assert out["decoded_sha256"] == [
        hashlib.sha256(direct.decode(i, skip_special_tokens=False).encode()).hexdigest() for i in ids]


def test_shared_chunks_are_encoded_once_and_wrong_neighbours_are_repaired(spark, direct):
    rnd = random.Random(6)
    passage = prose(rnd, 3000)
    cut = chunked_bpe.Cutter([passage, "some words before " + passage, "日本" * 50 + passage + " and after"])
    keys = [{key for _, key in cut.keys(d)} for d in range(3)]
    assert len(keys[0] & keys[1] & keys[2]) >= len(keys[0]) - 3  # cuts follow the content
    # Known ids that end in a wrong token do not agree with any window: the whole text is encoded instead.
    encoder, text = word_ids(default_vocabulary()), passage
    (a, b), *_ = chunked_bpe.Cutter([text]).chunks[0]
    right = encoder([text.encode()[a:b].decode()])[0]
    for known in (right, np.append(right[:-1], np.uint32(7))):
        got = chunked_bpe.encode_batch([text], encoder, [{0: known}])[0]
        assert got.tolist() == direct.encode(text, add_special_tokens=False).ids


def test_rolling_hash_sees_the_last_bytes_only():
    data = np.frombuffer(random.Random(1).randbytes(500), dtype=np.uint8)
    h = chunked_bpe.rolling_hash(data)
    for i in (31, 200, 499):
        last = data[i - 31:i + 1][::-1]
        assert int(h[i]) == sum(int(chunked_bpe.GEAR[b]) << j for j, b in enumerate(last)) % (1 << 32)


def test_no_documents(spark, no_docs):
    assert chunked_bpe.encode_documents(spark, no_docs, default_vocabulary()).count() == 0
