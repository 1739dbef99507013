import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import empty, odd, prose
from lodestone.llm import byte_pairs as B
from lodestone.llm import packing as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = B.vocabulary_path()


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def shared(spark):
    return P.share_ids(spark, PATH)


def whole(rows, texts, public, size, key="doc_id"):
    """Every document's ids lie in its pieces once, in order; sequences have no gaps; gives the lengths of sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r[key]].append(r)
        sequences[r["sequence_id"]].append(r)
    for k, t in texts.items():
        want = [*public.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[k], key=lambda r: r["start"])
        assert [i for r in own for i in np.frombuffer(r["ids"], "<u4").tolist()] == want
        at = 0
        for r in own:
            assert (r["start"], r["doc_tokens"], r["length"], r["ids_crc32"]) == (at, len(want), len(r["ids"]) // 4, zlib.crc32(r["ids"]))
            at += r["length"]
    assert set(pieces) == set(texts)
    out = {}
    for s, own in sequences.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        out[s] = at
    return out


def padding(lengths, size):
    return sum(size - n for n in lengths.values() if n & (n - 1))


@pytest.mark.parametrize(("size", "windows", "parts", "fan"), [(1024, 16, 4, 64), (32, 3, 7, 2), (50, 1, 9, 3)])
def test_pieces_are_whole_and_nothing_is_padded(spark, public, shared, monkeypatch, size, windows, parts, fan):
    monkeypatch.setattr(P, "FAN_IN", fan)
    r = random.Random(size)
    texts = {i: prose(i, r.choice([1, 3, 9, 60, 400])) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts)
    rows = P.pack(docs, shared, size=size, open_windows=windows).collect()
    lengths = whole(rows, texts, public, size)
    total = sum(lengths.values())
    assert sum(n == size for n in lengths.values()) == total // size
    assert padding({s: n for s, n in lengths.items() if n != size}, size) == 0


def test_best_fit_keeps_pieces_whole(spark, shared):
    packer = P.Packer(10, 2, 0)
    for row, n in enumerate((6, 7, 3, 4)):
        packer.add((row,), 0, np.arange(n, dtype=np.uint32))
    assert [(p[0][0], len(p[2]), p[3], p[4]) for p in packer.done] == [(1, 7, 1, 0), (2, 3, 1, 7), (0, 6, 0, 0), (3, 4, 0, 6)]
    packer = P.Packer(10, 2, 0)
    for row, n in enumerate((6, 7, 5)):  # none fits: the fullest is filled up and emitted
        packer.add((row,), 0, np.arange(n, dtype=np.uint32))
    assert [(p[0][0], p[1], len(p[2])) for p in packer.done] == [(1, 0, 7), (2, 0, 3)]
    assert [[(p[0][0], p[1], len(p[2])) for p in w.pieces] for w in packer.open] == [[(0, 0, 6), (2, 3, 2)]]


def test_windows_and_spare_room_save_cuts(spark, public, shared):
    texts = {i: prose(i, 20 + i * 37 % 90) for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    cuts = {}
    for windows, spare in ((1, 0), (16, 0), (16, 16)):
        rows = P.pack(docs, shared, size=512, open_windows=windows, spare=spare).collect()
        lengths = whole(rows, texts, public, 512)
        assert sum(512 - n for n in lengths.values() if n >= 512 - spare) <= spare * len(lengths)
        cuts[windows, spare] = len(rows) - 400
    assert cuts[16, 0] < cuts[1, 0] and cuts[16, 16] < cuts[1, 0] / 2


def test_open_windows_bound_what_a_task_holds():
    packer, r = P.Packer(64, 5, 0), random.Random(1)
    for row in range(500):
        packer.add((row,), 0, np.arange(r.randrange(1, 200), dtype=np.uint32))
        assert len(packer.open) <= 5 and all(w.fill < 64 for w in packer.open)


def test_odd_rows_special_tokens_and_clashes(spark, public, shared):
    docs = odd(spark).where("doc_id is null or doc_id <> 9").withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {10: "a<|endoftext|>b<|endoftext|>"}
    more = spark.createDataFrame([(10, texts[10])], "doc_id long, text string")
    got = P.pack(docs.unionByName(more, allowMissingColumns=True), shared)
    assert set(got.columns) == {"doc_id", "lang", "source", "n_chars", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    lengths = whole(got.collect(), texts, public, 1024)
    assert padding(lengths, 1024) == 0
    twice = odd(spark).where("doc_id = 9")
    assert P.pack(twice, shared, digest=True).agg(F.sum("length")).first()[0] == 2 * (len(public.encode(twice.first()["text"]).ids) + 1)
    assert P.pack(empty(spark), shared).count() == 0


def test_query_equals_brute_force(spark, public):
    from lodestone.llm.catalogue import queries

    rows = queries()["op11_packing"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    encoded = {k: np.array([*public.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
    filled, covered = defaultdict(list), defaultdict(int)
    for r in rows:
        piece = encoded[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and len(piece) == r["length"] and r["doc_tokens"] == len(encoded[r["doc_id"]])
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]] += r["length"]
    assert covered == {k: len(v) for k, v in encoded.items()}
    for own in filled.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0] + [n for _, n in sorted(own)])[:-1].tolist()
    total, sizes = sum(covered.values()), [sum(n for _, n in own) for own in filled.values()]
    assert sum(n == 1024 for n in sizes) >= total // 1024 and all(n & (n - 1) == 0 for n in sizes)
