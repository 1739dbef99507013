import hashlib
import random

import numpy as np
import pytest
from helpers import empty, odd, prose
from lodestone.llm import byte_pairs as B
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = B.vocabulary_path()


@pytest.fixture(scope="module")
def coder():
    return B.BytePairs(B.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(PATH)


def same(coder, public, text):
    ids = public.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids
    assert coder.decode(coder.encode(text)) == public.decode(ids, skip_special_tokens=False) == text


def test_texts_equal_the_library(coder, public):
    for text in ("", " ", "a", prose(1, 400), "<|endoftext|>x<|endoftext|>", "it's we'll  \n\n x\t", "日本語" * 300, "x" * 3000, "!?" * 900, "a\x1cb\x85c d", "😀👩‍👩‍👧"):
        same(coder, public, text)


def test_random_texts_equal_the_library(coder, public):
    r = random.Random(2)
    for _ in range(400):
        same(coder, public, "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x500), r.randrange(0x1F600, 0x1F650), 32, 10])) for _ in range(r.randrange(60))))


def test_heap_equals_scan(coder):
    r = random.Random(3)
    for _ in range(500):
        word = bytes(r.choice(b"theanins qx") for _ in range(r.randrange(1, 120)))
        assert B.merged_by_scan(word, coder.words.ranks) == B.merged_by_heap(word, coder.words.ranks)


def test_cache_is_bounded(coder, monkeypatch):
    monkeypatch.setattr(B, "CACHED_BYTES", 600)
    small = B.BytePairs(B.read_vocabulary(PATH))
    small.encode("one two three four five six seven")
    assert len(small.words) <= 3


def test_odd_rows_and_empty_tables(spark, public):
    docs = odd(spark).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    vocabulary = B.share_vocabulary(spark, PATH)
    got = B.encode_texts(docs, vocabulary, decoded="back").collect()
    assert len(got) == 11
    for r in got:
        assert r["back"] == (r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == public.encode(r["text"] or "", add_special_tokens=False).ids
    digests = B.encode_texts(docs, vocabulary, keep=["doc_id"], digest=True).collect()
    assert sorted(r["ids_sha256"] for r in digests) == sorted(hashlib.sha256(r["ids"]).hexdigest() for r in got)
    assert B.encode_texts(empty(spark), vocabulary).count() == 0
