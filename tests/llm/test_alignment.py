import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from helpers import empty, odd, prose
from lodestone.llm import alignment as A
from lodestone.llm.byte_pairs import byte_symbols, vocabulary_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def public():
    a = Tokenizer.from_file(vocabulary_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(A.PIECES))


def tokens(text, public):
    """[(id, bytes)] of A and of B, or nothing."""
    if not text:
        return [], []
    a, b = public
    symbols = byte_symbols()
    ta = [(i, bytes(symbols[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tb = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        tb.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (ta, tb) if b"".join(x for _, x in ta) == raw == b"".join(x for _, x in tb) else ([], [])


def spans(t):
    at, out = 0, []
    for i, raw in t:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(texts, public):
    """Each row's figures, by comparing neighbours' byte ranges one by one."""
    each, holding = [], Counter()
    for text in texts:
        a, b = map(spans, tokens(text, public))
        links, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            k = j
            while k < len(b) and b[k][1] < e:
                if b[k][2] > s:
                    links.append((i, b[k][0]))
                k += 1
            j = k
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, s = [], 0
        ga, gb = defaultdict(list), defaultdict(list)
        place = {e: n for n, e in enumerate(ends)}
        for own, g in ((a, ga), (b, gb)):
            n = 0
            for i, _, e in own:
                g[n].append(str(i))
                n = place[e] + 1 if e in place else n
        text_of = ";".join(",".join(ga[n]) + "|" + ",".join(gb[n]) for n in range(len(ends)))
        each.append((len(a), len(b), len(ends), links, text_of))
        holding.update(set(links))
    best = defaultdict(int)
    for (i, _), n in holding.items():
        best[i] = max(best[i], n)
    return [(na, nb, ng, len(links), sum(holding[x] == best[x[0]] for x in links), sum(holding[x] for x in links), g) for na, nb, ng, links, g in each], holding


def test_rows_equal_brute_force(spark, public, monkeypatch):
    r = random.Random(4)
    texts = [prose(i, r.randrange(1, 80)) for i in range(60)] + ["日本𠮷 é́ ﬁ", "a  b\n\tc", "▁x", "<s>q</s><|endoftext|>", "<0x41>", "", None, "x" * 999, " lead", "a\x00b"]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x3000), 0x1F600 + r.randrange(50), 32])) for _ in range(r.randrange(1, 40))) for _ in range(150)]
    texts += texts[:9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want, holding = brute(texts, public)
    got = {x["doc_id"]: x for x in A.aligned(docs, keep=["doc_id"]).collect()}
    assert {i: tuple(x[n] for n in [*NAMES, "groups"]) for i, x in got.items()} == dict(enumerate(want))
    digests = {x["doc_id"]: x["groups_sha256"] for x in A.aligned(docs, keep=["doc_id"], digest=True).collect()}
    assert digests == {i: w[-1] and hashlib.sha256(w[-1].encode()).hexdigest() for i, w in enumerate(want)}
    # the same with tiny runs, early hand-over of counts, and shards of few keys
    monkeypatch.setattr(A, "RUN_TOKENS", 50)
    monkeypatch.setattr(A, "HELD_PAIRS", 40)
    monkeypatch.setattr(A, "SHARD_KEYS", 16)
    small = {x["doc_id"]: tuple(x[n] for n in [*NAMES, "groups"]) for x in A.aligned(docs, keep=["doc_id"]).collect()}
    assert small == dict(enumerate(want))


def test_pair_table_holds_all_counts(spark, public):
    texts = [prose(i, 30) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shared, model = A.share_ids(spark, vocabulary_path()), A.share_pieces(spark, vocabulary_path(A.PIECES))
    sizes = A.Lengths(shared.value["ids"], A.piece_bytes(sentencepiece.SentencePieceProcessor(model_proto=model.value)))
    lengths = spark.sparkContext.broadcast(sizes)
    counts = A.count_shards(A.partial_counts(A.encoded(docs, shared, model, "text", []), lengths), lengths)
    got = {(r["a"], r["b"]): r["n"] for r in A.pair_table(counts, spark, sizes).collect()}
    assert got == dict(brute(texts, public)[1])


def test_runs_are_summed_over_batches():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"]) for k, n in (([1, 1, 2], [1, 2, 3]), ([2, 2], [4, 5]), ([2, 7], [1, 1]))]
    out = list(A.summed_runs(iter(batches)))
    assert np.concatenate([k for k, _ in out]).tolist() == [1, 2, 7] and np.concatenate([n for _, n in out]).tolist() == [3, 13, 1]


def test_odd_rows_and_empty_tables(spark, public):
    docs = odd(spark).withColumn("n_a", F.lit("clash")).withColumn("groups", F.lit("clash"))
    got = A.aligned(docs)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", *NAMES, "groups"]
    rows = odd(spark).collect()
    want = brute([r["text"] for r in rows], public)[0]
    key = lambda x: repr(x)
    assert sorted(((r["doc_id"], *(r[n] for n in [*NAMES, "groups"])) for r in got.collect()), key=key) == sorted(((r["doc_id"], *w) for r, w in zip(rows, want)), key=key)
    assert A.aligned(empty(spark)).count() == 0


def test_query_equals_brute_force(spark, public):
    from lodestone.llm.catalogue import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = brute([r["text"] for r in rows], public)[0]
    got = {r["doc_id"]: r for r in queries()["op12_alignment"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r, w in zip(rows, want):
        x = got[r["doc_id"]]
        assert tuple(x[n] for n in NAMES) == w[:-1] and x["groups_sha256"] == (w[-1] and hashlib.sha256(w[-1].encode()).hexdigest())
