import hashlib
import math
import random
import re

import numpy as np

from helpers import empty, odd, prose
from lodestone.llm import disclosure as D
from lodestone.llm.textblocks import WordHasher
from pyspark.sql import functions as F

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(digits(m.group())) <= 19 and D.luhn(digits(m.group()))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m.group())) <= 15]


def test_base_spans_equal_plain_patterns():
    r = random.Random(5)
    for _ in range(30_000):
        t = "".join(r.choice("ab1.@-+ ()é%") for _ in range(r.randrange(32)))
        assert D.base_spans(t) == brute(t), t
    t = "pay 4111 1111 1111 1111 to a.b@c.org from 010.001.255.3, call +1 (319) 555-5132, not 4111111111111112 or 1.2.3.256"
    assert D.base_spans(t) == brute(t) and [k for k, _, _ in D.base_spans(t)] == ["email", "ip", "card", "phone"]


def test_patterns_are_linear():
    for t in ("a" * 400_000, "1" * 400_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000, "@." * 100_000):
        D.base_spans(t)


def revealing(spark):
    """'nightjar' only occurs beside one address, in texts that are otherwise unlike; common words also occur elsewhere."""
    rows = [(i, f"{prose(i, 40)} the nightjar wrote to agent7@mail.org {prose(100 + i, 20)}") for i in range(4)]
    rows += [(10 + i, f"the {prose(200 + i, 60)}") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_reveal_an_entity(spark):
    docs = revealing(spark)
    marked = {r["id"]: r for r in D.all_spans(docs).collect()}
    for i in range(4):
        text = docs.where(f"doc_id = {i}").first()["text"]
        terms = {text[s["start"] : s["end"]] for s in marked[i]["spans"] if s["kind"] == "term"}
        assert "nightjar" in terms and "wrote" in terms and "the" not in terms
    clean = {r["doc_id"]: r["text"] for r in D.sanitise(docs).collect()}
    assert "nightjar" not in clean[0] and "<EMAIL>" in clean[0] and "agent7" not in clean[0]
    assert clean[10] == docs.where("doc_id = 10").first()["text"]


def test_copies_are_no_evidence(spark):
    text = f"{prose(1, 50)} a1@b.org"
    docs = spark.createDataFrame([(i, text) for i in range(5)] + [(9 + i, prose(50 + i, 50)) for i in range(50)], "doc_id long, text string")
    assert D.span_digests(docs).where("n_term > 0").count() == 0


def test_copies_change_no_term_span(spark):
    docs = revealing(spark)
    spans = lambda d: {(r["doc_id"], r["spans"]) for r in D.span_digests(d).where("doc_id < 10").collect()}
    copies = docs.where("doc_id = 0").crossJoin(spark.range(100)).select((F.col("id") + 1000).alias("doc_id"), "text")
    others = docs.where("doc_id = 10").crossJoin(spark.range(100)).select((F.col("id") + 2000).alias("doc_id"), "text")
    once = spans(docs)
    assert sum("term" in s for _, s in once) == 4
    assert spans(docs.unionByName(copies).unionByName(others)) == once


def test_null_and_repeated_keys(spark):
    plain = "nothing here but the basin"
    texts = [f"{r['text']} own{r['doc_id']}" for r in revealing(spark).where("doc_id < 4").orderBy("doc_id").collect()]
    rows = [(None, texts[0]), (None, texts[0]), (None, "ip 1.2.3.4"), (None, plain), (7, texts[1]), (7, texts[2]), (7, plain), (7, "mail b@c.org"), (8, texts[3]), (None, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(revealing(spark).where("doc_id >= 10"))
    clean = [(r["doc_id"], r["text"]) for r in D.sanitise(docs).collect() if r["doc_id"] is None or r["doc_id"] < 10]
    long = sorted((k or 0, t.split()[-1]) for k, t in clean if t and " own" in t)
    assert long == [(0, "own0"), (0, "own0"), (7, "own1"), (7, "own2"), (8, "own3")]
    assert not any("agent7" in t or "nightjar" in t for _, t in clean if t) and all("<EMAIL>" in t for _, t in clean if t and " own" in t)
    assert sorted((k or 0, t or "") for k, t in clean if not t or " own" not in t) == [(0, ""), (0, "ip <IP>"), (0, plain), (7, ""), (7, "mail <EMAIL>"), (7, plain)]


def test_alike_documents_are_contexts_of_their_own(spark):
    """Letters from one template: each pair has nine of ten words in common, and only the pair has its address and name."""
    form = " ".join(f"form{k}" for k in range(38))
    letters = [(2 * i + j, f"{form} name{i} w{i}@b.org x{i}y{j} z{i}y{j}") for i in range(30) for j in range(2)]
    others = [(1000 + i, prose(300 + i, 30)) for i in range(300)]
    got = D.span_digests(spark.createDataFrame(letters + others, "doc_id long, text string")).where("doc_id < 1000").collect()
    assert all(r["n_term"] >= 1 for r in got)


def secret(i):
    return hashlib.sha1(str(i).encode()).hexdigest()


def hashed(word):
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(WordHasher().words(raw, np.array([0, len(raw)])).hashes.view(np.int64)[0])


def test_disclosures_equal_brute_force(spark):
    """Every pair of an entity (a value, or a kind as such) and a term, counted over sets of words in plain Python."""
    r = random.Random(8)
    texts = [f"{prose(i, 30)} token = {secret(i % 9)} {prose(70 + i, 9)}" for i in range(14)]
    texts += [f"{prose(i, 30)} {r.choice(['heron', 'plover', 'the'])} w{i % 3}@b.org 10.0.0.{i % 4} {r.choice(['heron', 'the'])}" for i in range(14, 40)]
    texts += [f"the {prose(200 + i, 40)} {'token' if i < 2 else ''}" for i in range(150)]
    texts += texts[:20] + [" ".join(reversed(t.split())) for t in texts[14:20]] + [None, ""]
    contexts = {}
    for t in texts:
        spans = D.base_spans(t or "") + D.secrets(t or "", [])
        contexts.setdefault(frozenset((t or "").lower().split()), set()).update({f"{k}:{t[a:b].lower()}" for k, a, b in spans} | {k for k, _, _ in spans})
    want = {}
    for e in set().union(*contexts.values()):
        least, having = (D.MIN_JOINT if ":" in e else D.MIN_KIND), [w for w, es in contexts.items() if e in es]
        for t in set().union(*having):
            joint, n_term = sum(t in w for w in having), sum(t in w for w in contexts)
            d = math.log(joint * len(contexts) / (n_term * len(having))) / math.log(len(contexts) / len(having))
            if joint >= least and d >= D.THRESHOLD:
                want[hashed(t), e] = d
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = D.staged(D.find_base(docs).withColumn("row", F.monotonically_increasing_id()), "found")
    met = D.staged(D._terms(found.where("entities is not null").select("row", "text")), "met")
    names = spark.createDataFrame([(e,) for e in set().union(*contexts.values())], "name string").withColumn("entity", F.xxhash64("name"))
    _, strong = D.disclosures(docs, found, met)
    got = {(x["term"], x["name"]): x["disclosure"] for x in strong.join(names, "entity").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert (hashed("="), "secret") in got and (hashed("heron"), "ip") in got and (hashed("token"), "secret") in got


def test_terms_reach_entities_by_one_join(spark, monkeypatch):
    """A context's terms are moved once, to one of its rows that have the entity: others of the same words may not have it.
    Keys are null and repeated, texts null, empty and repeated."""
    card, other = "4111 1111 1111 1111", "1111 4111"
    assert D.base_spans(card) and not D.base_spans(other)
    texts = [f"{prose(i, 20)} payee{i % 2} {x}" for i in range(8) for x in ((other, card), (card, card, other), (card,), (other, other))[i % 4]]
    texts += [f"{prose(50 + i, 20)} w{i % 3}@b.org scribe{i % 3}" for i in range(9)] + [prose(100 + i, 20) for i in range(60)] + [None, "", prose(100, 20), None]
    contexts = {}
    for t in texts:
        contexts.setdefault(frozenset((t or "").lower().split()), set()).update(x for k, a, b in D.base_spans(t or "") for x in (k, f"{k}:{t[a:b].lower()}"))
    want = set()
    for e in set().union(*contexts.values()):
        least, having = (D.MIN_JOINT if ":" in e else D.MIN_KIND), [w for w, es in contexts.items() if e in es]
        for t in set().union(*having):
            joint, n_term = sum(t in w for w in having), sum(t in w for w in contexts)
            d = math.log(joint * len(contexts) / (n_term * len(having))) / math.log(len(contexts) / len(having))
            want |= {(hashed(t), e, round(d, 9))} if joint >= least and d >= D.THRESHOLD else set()
    docs = spark.createDataFrame([(None if i % 5 == 0 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = D.staged(D.find_base(docs).withColumn("row", F.monotonically_increasing_id()), "found")
    met = D.staged(D._terms(found.where("entities is not null").select("row", "text")), "met")
    plans, staged = {}, D.staged
    monkeypatch.setattr(D, "staged", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or staged(df, name))
    names = spark.createDataFrame([(e,) for e in set().union(*contexts.values())], "name string").withColumn("entity", F.xxhash64("name"))
    got = {(x["term"], x["name"], round(x["disclosure"], 9)) for x in D.disclosures(docs, found, met)[1].join(names, "entity").collect()}
    assert got == want and {e.split(":")[0] for _, e, _ in got} >= {"card", "email"}
    assert len(re.findall(r"Join Inner, \(context", plans["strong"])) == 1  # of the copies' texts, in the counts of terms


def test_words_that_introduce_secrets_are_marked(spark):
    docs = spark.createDataFrame([(i, f'{prose(i, 30)} token = "{secret(i)}" {prose(90 + i, 5)}') for i in range(8)] + [(100 + i, prose(300 + i, 40)) for i in range(100)], "doc_id long, text string")
    for r in D.span_digests(docs).collect():
        assert (r["n_secret"], r["n_term"]) == ((1, 2) if r["doc_id"] < 100 else (0, 0))
    for r in D.sanitise(docs).where("doc_id < 100").collect():
        assert '"<SECRET>"' in r["text"] and "token" not in r["text"] and "=" not in r["text"]


def test_the_sanitised_text_has_its_digest(spark):
    docs = revealing(spark).unionByName(spark.createDataFrame([(900, None), (901, "")], "doc_id long, text string"))
    clean = {r["doc_id"]: r["text"] for r in D.sanitise(docs).collect()}
    for r in D.span_digests(docs).collect():
        assert r["sanitised_sha256"] == hashlib.sha256((clean[r["doc_id"]] or "").encode()).hexdigest()


def test_digests(spark):
    docs = revealing(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in D.span_digests(docs).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"].startswith(base)


def test_generalised_and_removed():
    span = lambda k, a, b, d=None: {"kind": k, "start": a, "end": b, "disclosure": d}
    assert D.sanitised_text("Anna lives at x@y.z in 1984", [span("term", 0, 4, 0.9), span("email", 14, 19), span("term", 23, 27, 0.85), span("term", 5, 10, 1.0)]) == "<NAME>  at <EMAIL> in <NUMBER>"
    assert D.sanitised_text("1.2.3.4 5", [span("ip", 0, 7), span("card", 2, 9)]) == "<IP>"


def test_odd_rows_and_empty_tables(spark):
    docs = odd(spark).withColumn("id", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("entity", F.lit("y"))
    got = D.span_digests(docs).collect()
    assert len(got) == 11 and all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)
    assert D.span_digests(empty(spark)).count() == 0
    assert D.sanitise(docs).columns == docs.columns
    one = spark.createDataFrame([(None, "a@b.c and a@b.c"), (1, "a@b.c"), (1, "a@b.c")], "doc_id long, text string")
    assert sorted(r["n_email"] for r in D.span_digests(one).collect()) == [1, 1, 2]
