"""Spelling variants: words one inserted, deleted or replaced character apart, grouped under their most frequent form.

The vocabulary is joined with itself in tries. A node's active nodes are those whose strings are at most one edit away;
they follow from the active nodes of its parent: the parent itself (deletion), its siblings (replacement), its children
(insertion), and children by the same character of the parent's other active nodes. Two words that are ends of a node and
of one of its active nodes are a pair.

The trie is partitioned by prefixes that follow from a simple fact: two words one edit apart, the longer of m characters,
have their first or their last floor(m / 2) characters in common. So every word goes to the partitions of its half prefixes
and of its half suffixes (at most four), and a partition's trie holds what is left of its words. A partition of more than
``MOST_WORDS`` words is cut in the same way by what is left, until all are small: a prefix that a third of all words share
meets in no single task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textblocks import distinct, slices
from lodestone.session import staged

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One occurrence in so many, by a checksum, loses a character.
NOISE = 97
#: A form is at least so many times as frequent as its variant.
TIMES = 2
#: Distinct words that a task counts before it hands on their counts.
HELD_WORDS = 200_000
#: Words of a partition of the trie, and of the partitions that a task joins at once.
MOST_WORDS, JOINED_WORDS = 20_000, 20_000
_CHAR = 21  # bits of a code point


def word_counts(docs: DataFrame, text: str = "text", ident: str = "doc_id", noise: int | None = NOISE, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) over all documents: maximal runs of letters, A-Z lower-cased, of at least ``least_length`` characters.
    With ``noise``, an occurrence whose checksum that number divides loses one character first. Counts are combined in
    each task and by Spark before the shuffle. Null texts have no words; a null id stands as empty in the checksum."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}").findall
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for part in parts:
            for rows, texts in slices(part, text):
                for key, t in zip(rows.column(ident).to_pylist(), texts):
                    seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for word, n in Counter(find(t.encode().lower().decode())).items():  # of bytes, lower() changes A-Z only
                        if noise:
                            mark = zlib.crc32(word.encode(), seed)
                            if mark % noise == 0:
                                at = mark % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_length:
                                    continue
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield handed()
                    held.clear()
        if held:
            yield handed()

    found = docs.select(*[docs[c] for c in dict.fromkeys([ident, text])]).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def halved(rows: DataFrame) -> DataFrame:
    """rows: (key, rest, ...). Each row under the keys of its half prefixes and half suffixes, with what is left."""
    length = F.length("rest")
    half = F.explode(F.array_distinct(F.array(F.floor(length / 2).cast("int"), F.floor((length + 1) / 2).cast("int"))))
    more = [c for c in rows.columns if c not in ("key", "rest")]
    cut = rows.withColumn("_half", half).withColumn("_side", F.explode(F.array(F.lit("p"), F.lit("s"))))
    left, first = length - F.col("_half"), F.col("_side") == "p"
    part = F.when(first, F.substring("rest", F.lit(1), F.col("_half"))).otherwise(F.substring("rest", left + 1, F.col("_half")))
    rest = F.when(first, F.substring("rest", F.col("_half") + 1, left)).otherwise(F.substring("rest", F.lit(1), left))
    return cut.select(F.concat("key", F.lit("/"), "_side", F.col("_half").cast("string"), F.lit(":"), part).alias("key"), rest.alias("rest"), *more)


def partitions(words: DataFrame, most: int) -> DataFrame:
    """(key, rest, word, n): the words, dealt out to partitions of the trie of at most ``most`` words each, unless nothing
    but single characters is left of them. Each round halves what is left, so rounds grow with the logarithm of the
    longest word."""
    rows, out = staged(halved(words.select(F.lit("").alias("key"), F.col("word").alias("rest"), "word", "n")), "trie"), None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.length("rest")).alias("longest"))
        hot = staged(sizes.where((F.col("size") > most) & (F.col("longest") > 1)).select("key"), "trie-hot")
        if hot.isEmpty():
            return rows if out is None else out.unionByName(rows)
        cool = rows.join(hot, "key", "left_anti").select(*rows.columns)
        out = cool if out is None else out.unionByName(cool)
        rows = staged(halved(rows.join(hot, "key", "left_semi").select(*rows.columns)), "trie")


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, member) of all members of the ranges low..high."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)


class Trie:
    """Tries over strings that are sorted within their groups, one root a group. Nodes are numbered level by level, so that
    the edges (parent, character) are in order and a child is found by binary search."""

    def __init__(self, groups: np.ndarray, strings: list[str]):
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.cumsum(lengths) - lengths
        self.roots = int(groups[-1]) + 1 if len(groups) else 0
        node, alive, edges, levels = groups.astype(np.int64), np.arange(len(strings)), [], [0, self.roots]
        ends = [(node[lengths == 0], np.flatnonzero(lengths == 0))]
        depth = 0
        while len(alive := alive[lengths[alive] > depth]):
            keys = (node[alive] << _CHAR) | codes[first[alive] + depth]
            fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
            edges.append(keys[fresh])
            node[alive] = levels[-1] + np.cumsum(fresh) - 1
            levels.append(levels[-1] + len(edges[-1]))
            depth += 1
            over = alive[lengths[alive] == depth]
            ends.append((node[over], over))
        self.levels = levels
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.word = np.full(levels[-1], -1, np.int64)
        for at, words in ends:
            self.word[at] = words
        every = np.arange(levels[-1], dtype=np.int64) << _CHAR
        self.low = np.searchsorted(self.edges, every) + self.roots
        self.high = np.searchsorted(self.edges, every + (1 << _CHAR)) + self.roots

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, word) at distance one, in both orders, level by level."""
        if not len(self.edges):
            return
        parent, char = self.edges >> _CHAR, self.edges & ((1 << _CHAR) - 1)
        nodes = np.arange(self.roots)
        which, near = _ranges(self.low[nodes], self.high[nodes])
        nodes = nodes[which]
        yield self._ends(nodes, near)
        for start, end in zip(self.levels[1:], self.levels[2:]):
            own = np.arange(start, end)
            up = parent[own - self.roots]
            a, brother = _ranges(self.low[up], self.high[up])
            b, child = _ranges(self.low[own], self.high[own])
            c, target = _ranges(self.low[nodes], self.high[nodes])  # children of the nodes above, with those's active nodes
            sought = (near[c] << _CHAR) | char[target - self.roots]
            at = np.minimum(np.searchsorted(self.edges, sought), len(self.edges) - 1)
            met = self.edges[at] == sought
            packed = np.concatenate([(own << 32) | up, (own[a] << 32) | brother, (own[b] << 32) | child, (target[met] << 32) | (at[met] + self.roots)])
            packed = distinct(packed)
            nodes, near = packed >> 32, packed & 0xFFFFFFFF
            other = nodes != near
            nodes, near = nodes[other], near[other]
            yield self._ends(nodes, near)

    def _ends(self, nodes: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.word[nodes], self.word[near]
        both = (a >= 0) & (b >= 0)
        return a[both], b[both]


def near_pairs(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """words: (word, n), distinct. (word, n, near, near_n) for every ordered pair of words that differ by exactly one
    inserted, deleted or replaced code point; each once."""
    dealt = partitions(words, most).repartition("key").sortWithinPartitions("key", "rest")

    def joined(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = rows.column("key").combine_chunks()
        fresh = np.concatenate([[False], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])
        word, n = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
        for a, b in Trie(np.cumsum(fresh), rows.column("rest").to_pylist()).pairs():
            if len(a):
                a, b = pa.array(a), pa.array(b)
                yield pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], names=["word", "n", "near", "near_n"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            if not part.num_rows:
                continue
            held.append(part)
            size += part.num_rows
            if size >= JOINED_WORDS:
                rows = pa.Table.from_batches(held)
                keys = rows.column("key").combine_chunks()
                last = int(pc.index(keys, keys[len(keys) - 1]).as_py())  # the last partition may go on in the next batch
                if last:
                    yield from joined(rows.slice(0, last).combine_chunks())
                held, size = rows.slice(last).combine_chunks().to_batches(), rows.num_rows - last
        if held:
            yield from joined(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, "word string, n long, near string, near_n long").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """forms: (word, form). (word, root), the last of the chain of forms. Links are doubled, so rounds grow with the
    logarithm of the longest chain; as counts at least double along a chain, it has at most 63 links."""
    up = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        up = staged(up.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if up.where("_moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def variants(docs: DataFrame, text: str = "text", ident: str = "doc_id", noise: int | None = NOISE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row a word: word, form (its near word of the largest count, the first in code-point order among equals, if that
    count is at least TIMES the word's; else null), root (the last of the chain of forms; the word itself without one), n,
    n_near, form_n.

    Null and empty texts have no words. A run of letters of any length is one word. Repeated rows count each time. An
    empty table, or one whose words are all too rare, gives no rows. Other columns of docs are not read.
    """
    words = staged(word_counts(docs, text, ident, noise, least_length).where(F.col("n") >= least_count), "words")
    found = staged(near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best")), "near")
    held = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.rank")).alias("near_n"))
    form = F.when(F.col("near_n") >= TIMES * F.col("n"), F.col("near"))
    held = staged(held.select("word", "n", "n_near", form.alias("form"), F.when(form.isNotNull(), F.col("near_n")).alias("form_n")), "forms")
    last = roots(held.where("form is not null"))
    return held.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
