"""Personal data in texts, and terms that reveal it.

Base detectors find e-mail addresses, IPv4 addresses, card and phone numbers. Beside these four kinds, runs of characters
that carry too much information for words (keys, tokens) are secrets. Every distinct value found is a protected entity,
and so is each kind as such: that a text holds an address at all. The corpus then tells how strongly a term reveals an
entity: their pointwise mutual information over contexts, as a share of the information content of the entity,

    disclosure(t, e) = log(n(t, e) N / (n(t) n(e))) / log(N / n(e)),

is 1 where the term occurs only with the entity. Copies of one document are no evidence that its words belong together,
so all counts, N too, are of contexts: documents with one and the same set of words are one context. Documents that
differ in a word are two. Terms at or above a threshold, seen with the entity in at least ``MIN_JOINT`` contexts
(``MIN_KIND`` for a kind: many terms meet one of many values by chance), get spans of their own in the documents of that
entity. Sanitised texts have values replaced by their kind, revealing terms generalised to a class, and terms that reveal
(almost) all removed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textblocks import WordHasher, blocks, distinct, distinct_places, mix, slices
from lodestone.session import staged

KINDS = ("email", "ip", "card", "phone", "secret", "term")
N_BASE = 4
THRESHOLD = 0.8
#: From here on a term is removed, not generalised.
REMOVED = 0.98
MIN_JOINT, MIN_KIND = 2, 5
#: Bits a character, and digits and letters at least, of a secret.
SECRET_BITS, SECRET_MIXED = 3.0, 4
GATHERED = 1 << 21
#: Contexts that a task remembers to drop copies before a shuffle.
REMEMBERED = 1 << 19

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No digit before: a run of digits that fails from its first digit fails from each, so this only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,128}(?![A-Za-z0-9+/_-])")
_WORD = re.compile("[^\x20\x09-\x0d]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From one @ to the next: the local part reaches back as far as it can, the domain on. Linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by kind and start. Matches of a kind do not overlap; those that
    fail their test are dropped without another try."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGITS.sub("", m.group())) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]
    return out


def secrets(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of 24 to 128 letters, digits and ``+/_-`` that mix digits and letters and whose characters have an entropy of
    SECRET_BITS; those that overlap a span of ``taken`` are part of it."""
    out = []
    for m in _KEY.finditer(text):
        run = m.group()
        digits, letters = sum(c.isdigit() for c in run), sum(c.isalpha() for c in run)
        if min(digits, letters) >= SECRET_MIXED and -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values()) >= SECRET_BITS and not any(a < m.end() and m.start() < b for _, a, b in taken):
            out.append(("secret", m.start(), m.end()))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_CONTEXT = np.uint64(0x2545F4914F6CDD1D)
_SPAN = "array<struct<kind:string,start:long,end:long>>"


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def find_base(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans, text, entities, digest) per row. text and entities (kind and value, distinct) are null where nothing
    was found, digest (of the text) where something was."""
    kind = dict(docs.dtypes)[key]
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, texts in slices(part, "text"):
                spans = [base + secrets(t, base) for t in texts for base in (base_spans(t),)]
                entities = [sorted({f"{k}:{t[a:b].lower()}" for k, a, b in s}) if s else None for s, t in zip(spans, texts)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], shape), pa.array([t if s else None for s, t in zip(spans, texts)], pa.string()), pa.array(entities, pa.list_(pa.string())), pa.array([None if s else _sha256(t) for s, t in zip(spans, texts)], pa.string())],
                    names=["id", "spans", "text", "entities", "digest"],
                )

    return docs.select(docs[key].alias("id"), docs[text].alias("text")).mapInArrow(find, f"id {kind}, spans {_SPAN}, text string, entities array<string>, digest string")


def _context(terms: np.ndarray) -> np.uint64:
    """A hash of a whole set of words, given as the distinct hashes of its words."""
    return mix(terms ^ _CONTEXT).sum(dtype=np.uint64)


def _contexts(docs: DataFrame, text: str, texts: bool) -> DataFrame:
    """(context, copies), and with ``texts`` (context, text): each context once a task, or more where a task meets more
    than REMEMBERED."""

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), {}

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], names=["context", "copies"])
            seen.clear()
            return out

        for part in parts:
            contexts, rows = [], []
            for a, b, data, offsets in blocks(part, "text"):
                words = hasher.words(data, offsets)
                for row, x, y in zip(range(a, b), words.first[:-1].tolist(), words.first[1:].tolist()):
                    context = int(_context(distinct(words.hashes[x:y])).view(np.int64))
                    if context not in seen:
                        contexts.append(context)
                        rows.append(row)
                    seen[context] = seen.get(context, 0) + 1
            if texts and rows:
                yield pa.RecordBatch.from_arrays([pa.array(contexts, pa.int64()), part.column("text").take(pa.array(rows))], names=["context", "text"])
            if len(seen) > REMEMBERED:
                told = give()
                if not texts:
                    yield told
        if seen and not texts:
            yield give()

    return docs.select(F.col(text).alias("text")).mapInArrow(meet, f"context long, {'text string' if texts else 'copies long'}")


def _tally(texts: DataFrame) -> DataFrame:
    """texts: (text, n). (term, n) with the sum of n over the texts that have the term, several rows a term."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, times, size = WordHasher(), [], [], 0

        def give() -> pa.RecordBatch:
            terms, at = distinct_places(np.concatenate(held))
            n = np.bincount(at, np.repeat(times, [len(h) for h in held])).astype(np.int64)
            held.clear()
            times.clear()
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

        for part in parts:
            each = part.column("n").to_numpy(zero_copy_only=False)
            for row, _, data, offsets in blocks(part, "text"):
                words = hasher.words(data, offsets)
                for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                    held.append(distinct(words.hashes[a:b]))
                    times.append(each[row + k])
                    size += len(held[-1])
                if size >= GATHERED:
                    yield give()
                    size = 0
        if held:
            yield give()

    return texts.mapInArrow(count, "term long, n long")


def _context_counts(docs: DataFrame, text: str, contexts: DataFrame) -> DataFrame:
    """(term, n_term): contexts that have each term, by the hash of the term: all documents that have it, less the copies.
    The copies of a context have the same words, so only one text of each repeated context is shuffled."""
    again = _contexts(docs, text, True).join(staged(contexts.where("copies > 1"), "repeated"), "context").groupBy("context").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))
    less = _tally(again.select("text", (1 - F.col("copies")).alias("n")))
    return _tally(docs.select(F.col(text).alias("text"), F.lit(1).cast("long").alias("n"))).unionByName(less).groupBy("term").agg(F.sum("n").alias("n_term"))


def _terms(found: DataFrame) -> DataFrame:
    """(row, context, terms) for the rows of found, each text read once; terms: hashes of its distinct words."""

    def terms(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for part in parts:
            for a, b, data, offsets in blocks(part, "text"):
                words = hasher.words(data, offsets)
                each = [distinct(words.hashes[x:y]) for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
                contexts = np.array([_context(e) for e in each], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("row").slice(a, b - a), pa.array(contexts.view(np.int64)), pa.array([e.view(np.int64) for e in each], pa.list_(pa.int64()))], names=["row", "context", "terms"])

    return found.mapInArrow(terms, "row long, context long, terms array<long>")


def disclosures(docs: DataFrame, found: DataFrame, met: DataFrame, text: str = "text", threshold: float = THRESHOLD, min_joint: int = MIN_JOINT, min_kind: int = MIN_KIND) -> tuple[DataFrame, DataFrame]:
    """(row, entity) of all rows of found, and (entity, term, disclosure) of the terms that reveal an entity. Entities are
    hashes of 'kind:value', and of 'kind' for the kind as such. Counts are over the contexts of all documents."""
    values = F.transform("entities", lambda e: F.struct(F.xxhash64(e).alias("entity"), F.lit(min_joint).alias("least")))
    kinds = F.transform(F.array_distinct(F.transform("entities", lambda e: F.substring_index(e, ":", 1))), lambda k: F.struct(F.xxhash64(k).alias("entity"), F.lit(min_kind).alias("least")))
    held = found.where("entities is not null").select("row", F.explode(F.concat(values, kinds)).alias("e")).select("row", "e.*")
    # the rows of a context have the same terms, so one of those with the entity stands for it
    seen = held.join(met.select("row", "context"), "row").groupBy("entity", "least", "context").agg(F.min("row").alias("row"))
    entities = staged(seen.groupBy("entity", "least").agg(F.count("*").alias("n_entity")).where("n_entity >= least"), "entities")
    pairs = seen.join(entities.select("entity"), "entity").join(met.select("row", "terms"), "row").select("entity", "least", F.explode("terms").alias("term"))
    joint = pairs.groupBy("entity", "least", "term").agg(F.count("*").alias("n_joint")).where("n_joint >= least").drop("least")
    contexts = staged(_contexts(docs, text, False).groupBy("context").agg(F.sum("copies").alias("copies")), "contexts")
    n = contexts.count()
    known = joint.join(entities.drop("least"), "entity").join(_context_counts(docs, text, contexts), "term")
    total = F.lit(float(n))
    shown = F.when(F.col("n_entity") < n, F.log(F.col("n_joint") * total / (F.col("n_term") * F.col("n_entity"))) / F.log(total / F.col("n_entity"))).otherwise(0.0)
    strong = known.select("entity", "term", shown.alias("disclosure")).where(F.col("disclosure") >= threshold)
    return held.select("row", "entity"), staged(strong, "strong")


def revealing_terms(docs: DataFrame, found: DataFrame, text: str = "text", **settings) -> DataFrame:
    """(row, terms): for each row of found with a protected entity, the terms of its text that reveal it or its kind, as a
    map from the term's hash to its highest disclosure. found: rows of find_base, numbered by ``row`` and staged."""
    met = staged(_terms(found.where("entities is not null").select("row", "text")), "met")
    held, strong = disclosures(docs, found, met, text, **settings)
    marks = met.select("row", F.explode("terms").alias("term")).join(strong, "term").join(held, ["row", "entity"])
    best = marks.groupBy("row", "term").agg(F.max("disclosure").alias("disclosure"))
    return best.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("terms"))


def all_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per row of docs: id, n_base, spans (base ones, secrets, then terms that overlap none of them, with their
    disclosure), and text, which is null where nothing was found; digest is that of the text there.

    Null and empty texts have no spans. Repeated rows count, and are reported, as often as they occur. Keys may
    be null or repeated: each row is marked by its own text. Other columns are not read."""
    found = staged(find_base(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "found")
    kind = dict(found.dtypes)["id"]
    marked = found.join(revealing_terms(docs, found, text, **settings), "row", "left")

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for part in parts:
            out, n_base = [], []
            for spans, t, terms in zip(part["spans"], part["text"], part["terms"]):
                base = [(s["kind"], int(s["start"]), int(s["end"]), None) for s in spans]
                extra = []
                if terms is not None and len(terms):
                    shown = dict(terms)
                    at = [(m.start(), m.end()) for m in _WORD.finditer(t)]
                    raw = np.frombuffer(t.encode(), dtype=np.uint8)
                    hashes = hasher.words(raw, np.array([0, len(raw)])).hashes.view(np.int64).tolist()
                    taken, k, reach = sorted((a, b) for _, a, b, _ in base), 0, 0
                    for (a, b), h in zip(at, hashes):
                        while k < len(taken) and taken[k][0] < b:  # reach: the furthest end of spans that begin before b
                            reach = max(reach, taken[k][1])
                            k += 1
                        if h in shown and reach <= a:
                            extra.append(("term", a, b, shown[h]))
                out.append([{"kind": k_, "start": a, "end": b, "disclosure": d} for k_, a, b, d in base + extra])
                n_base.append(sum(k_ in KINDS[:N_BASE] for k_, _, _, _ in base))
            yield pd.DataFrame({"id": part["id"], "n_base": n_base, "spans": out, "text": part["text"], "digest": part["digest"]})

    return marked.select("id", "spans", "text", "terms", "digest").mapInPandas(place, f"id {kind}, n_base long, spans array<struct<kind:string,start:long,end:long,disclosure:double>>, text string, digest string")


def sanitised_text(text: str, spans: list) -> str:
    """Base values become their kind in angle brackets. Terms are generalised to a class (a number, a capitalised or
    another word) or, from REMOVED on, taken out."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        a, b = int(s["start"]), int(s["end"])
        if a < at:  # two kinds overlap: the first covers the start of the second
            at = max(at, b)
            continue
        out.append(text[at:a])
        if s["kind"] != "term":
            out.append(f"<{s['kind'].upper()}>")
        elif s["disclosure"] < REMOVED:
            word = text[a:b]
            out.append("<NUMBER>" if any(c.isdigit() for c in word) else "<NAME>" if word[:1].isupper() else "<TERM>")
        at = b
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """docs with ``text`` sanitised; other columns stay. Rows without findings are unchanged. Keys may be null or repeated:
    the sanitised text depends on a row's text alone, so texts are put back by key and the text itself (by a hash of it)."""
    kind = dict(docs.dtypes)[key]

    def rewrite(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"_key": part["id"], "_mark": part["mark"], "_clean": [sanitised_text(t, s) for t, s in zip(part["text"], part["spans"])]})

    spans = all_spans(docs, key, text, **settings).where("size(spans) > 0")
    changed = spans.select("id", "spans", "text", F.md5("text").alias("mark")).mapInPandas(rewrite, f"_key {kind}, _mark string, _clean string").groupBy("_key", "_mark").agg(F.min("_clean").alias("_clean"))
    same = docs[key].eqNullSafe(changed["_key"]) & (F.md5(docs[text]) == changed["_mark"])
    return docs.join(changed, same, "left").select(*[F.coalesce("_clean", docs[c]).alias(c) if c == text else docs[c] for c in docs.columns])


def span_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per row: counts of each kind, of terms and of all spans, a digest of base spans, all spans as one string, and the
    digest of the sanitised text (null: empty)."""
    marked = all_spans(docs, key, text, **settings)
    kind = dict(docs.dtypes)[key]
    names = ["id", *(f"n_{k}" for k in KINDS), "n_spans", "base_sha256", "spans", "sanitised_sha256"]

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, spans, t, plain in zip(part["id"], part["spans"], part["text"], part["digest"]):
                each = sorted(((s["kind"], int(s["start"]), int(s["end"])) for s in spans), key=lambda s: (KINDS.index(s[0]), s[1]))
                base = [s for s in each if s[0] in KINDS[:N_BASE]]
                rows.append((k, *[sum(s[0] == x for s in each) for x in KINDS], len(each), _sha256(_joined(base)), _joined(each), plain or _sha256(sanitised_text(t, spans))))
            yield pd.DataFrame(rows, columns=names)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return marked.select("id", "spans", "text", "digest").mapInPandas(digest, f"id {kind}, {counts}, n_spans long, base_sha256 string, spans string, sanitised_sha256 string").withColumnRenamed("id", key)
