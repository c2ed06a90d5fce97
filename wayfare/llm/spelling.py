"""Spelling variants by PartEnum signatures.

A word is the set of its letters, each with the number of its occurrence (aab: a1 a2 b1): a binary vector.  One inserted or
deleted letter changes one element, one replaced letter two, so near words are at most two apart.  The elements are dealt
to ``parts``; two vectors at distance k differ in at most k parts and are equal in all others.  Every word is indexed under
each choice of parts to leave out, by the hash of what the others hold; words meet by equality and are verified.

Words of equal length can only be two apart and words of neighbouring lengths one, so the length belongs to the signature and
each case leaves out no more parts than it needs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.session import settle

LEAST_LENGTH = 6
LEAST_COUNT = 5
# A form is at least so many times as frequent.
RATIO = 5
SLIP = 199
# Parts for words at distance two and one.
PARTS_TWO, PARTS_ONE = 7, 4
# Words that a worker counts before it passes them on.
COUNTED = 500_000

_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(run: str) -> str:
    """A-Z lower-cased, nothing else."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


class _Runs(dict):
    """Number of each run's lower-cased word; ``words`` has the words, ``sums`` their checksums, ``sizes`` their bytes."""

    def __init__(self):
        super().__init__()
        self.numbers: dict[str, int] = {}
        self.words: list[str] = []
        self.sums, self.sizes = np.zeros(1024, np.uint32), np.zeros(1024, np.int64)

    def __missing__(self, run: str) -> int:
        word = lowered(run)
        n = self[run] = self.numbers.setdefault(word, len(self.words))
        if n == len(self.words):
            if n == len(self.sums):
                self.sums, self.sizes = np.resize(self.sums, 2 * n), np.resize(self.sizes, 2 * n)
            self.words.append(word)
            data = word.encode()
            self.sums[n], self.sizes[n] = zlib.crc32(data), len(data)
        return n


def checksums(prefix: bytes, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of ``prefix`` followed by each of many strings, from the strings' own checksums and byte counts.

    A checksum is linear in its start: the prefix adds what it leaves after as many zero bytes as the string has.
    """
    start, most = zlib.crc32(prefix), int(sizes.max(initial=0))
    added, zero, past = np.empty(most + 1, np.uint32), 0, start
    for n in range(most + 1):
        added[n] = past ^ zero
        past, zero = zlib.crc32(b"\0", past), zlib.crc32(b"\0", zero)
    return sums ^ added[sizes]


def word_counts(docs: DataFrame, *, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: how often each word of at least ``least_length`` code points occurs in the whole texts, from ``least_count`` on.

    A null text has no words; a null doc_id counts as the text ``null``; repeated rows count each.  Other columns are not read.
    """

    # A shorter run can't make a word.
    pattern = re.compile(f"[A-Za-z\u00c0-\u00ff]{{{least_length},}}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs, counts, slips = _Runs(), np.zeros(0, np.int64), Counter()

        def out() -> pd.DataFrame:
            for word, n in zip(runs.words, counts.tolist(), strict=False):
                slips[word] += n
            return pd.DataFrame([(w, n) for w, n in slips.items() if n and len(w) >= least_length], columns=["word", "n"]).astype({"n": "int64"})

        for frame in frames:
            for key, text in zip(frame["key"], frame["text"], strict=True):
                own, times = np.unique(np.fromiter(map(runs.__getitem__, pattern.findall(text)), np.int64), return_counts=True)
                if not len(own):
                    continue
                if len(runs.words) > len(counts):
                    counts = np.concatenate([counts, np.zeros(2 * len(runs.words) - len(counts), np.int64)])
                sums = checksums(f"{key}:".encode(), runs.sums[own], runs.sizes[own])
                slip = sums % SLIP == 0
                counts[own[~slip]] += times[~slip]
                for i, n, h in zip(own[slip].tolist(), times[slip].tolist(), sums[slip].tolist(), strict=True):
                    word = runs.words[i]
                    slips[word[: (at := h % len(word))] + word[at + 1 :]] += n
                if len(runs) + len(slips) > COUNTED:
                    yield out()
                    runs, counts, slips = _Runs(), np.zeros(0, np.int64), Counter()
        yield out()

    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")).alias("key"), docs["text"].cast("string").alias("text"))
    counted = rows.where("text is not null").mapInPandas(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_enum(words: list[str], distance: int, parts: int) -> np.ndarray:
    """A row of signatures per word: one for every choice of ``distance`` parts to leave out.

    Vectors that differ in at most ``distance`` elements share at least one signature.
    """
    where, elements = [], []
    for i, word in enumerate(words):
        seen: dict[str, int] = {}
        for c in word:
            seen[c] = k = seen.get(c, 0) + 1
            where.append(i)
            elements.append(ord(c) << 24 | k)
    hashes = _mixed(np.array(elements, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    held = np.zeros((len(words), parts), np.uint64)
    # A set's hash is the sum of its elements' hashes.
    np.add.at(held, (np.array(where, np.int64), (hashes >> np.uint64(40)).astype(np.int64) % parts), hashes)
    whole = held.sum(axis=1, dtype=np.uint64)
    out = [_mixed(whole - held[:, left].sum(axis=1, dtype=np.uint64) + np.uint64(1 + k)) for k, left in enumerate(map(list, combinations(range(parts), distance)))]
    return np.stack(out, axis=1)


def signatures(word: Column, length: Column, distance: int, parts: int) -> Column:
    """Signatures of a word, each salted with the length under which it is indexed."""

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for words, lengths in batches:
            found = part_enum(words.tolist(), distance, parts) ^ _mixed(lengths.to_numpy(np.uint64) + np.uint64(977))[:, None]
            yield pd.Series(list(found.view(np.int64)))

    return keys(word, length)


def near_pairs(words: DataFrame, *, parts_two: int = PARTS_TWO, parts_one: int = PARTS_ONE) -> DataFrame:
    """a, a_n, b, b_n: every pair of distinct words (word, n) that differ by one inserted, deleted or replaced code point, once.

    Only verified pairs leave the joins.
    """

    length = F.char_length("word")

    def index(short: Column, distance: int, parts: int, indexed: Column) -> DataFrame:
        # One change leaves the first or the last half of the shorter word as it is.
        half = F.floor(short / 2).cast("int")
        ends = [F.xxhash64(F.left("word", half)).alias("first"), F.xxhash64(F.right("word", short - half)).alias("last")]
        keyed = words.select("word", "n", *ends, signatures(F.col("word"), indexed, distance, parts).alias("keys"))
        return keyed.select(F.explode_outer("keys").alias("key"), "word", "n", "first", "last")

    def met(a: DataFrame, b: DataFrame, also: Column) -> DataFrame:
        alike = (F.col("a.first") == F.col("b.first")) | (F.col("a.last") == F.col("b.last"))
        # The size of the words' files says nothing of the index, so it must not be broadcast for it.
        on = (F.col("a.key") == F.col("b.key")) & also & alike & (F.levenshtein("a.word", "b.word", 1) == 1)
        found = a.alias("a").join(b.alias("b").hint("merge"), on)
        return found.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))

    same = index(length, 2, parts_two, length)
    replaced = met(same, same, F.col("a.word") < F.col("b.word"))
    # The shorter word is indexed under the longer one's length.
    inserted = met(index(length, 1, parts_one, length + 1), index(length - 1, 1, parts_one, length), F.lit(True))
    # Two changed elements in one part leave several signatures alike.
    return replaced.unionByName(inserted).distinct()


def roots(hops: DataFrame) -> DataFrame:
    """word, root: the end of the chain word -> form of ``hops`` (word, form).

    Chains are doubled until none gets longer; each round is written to the shared folder.
    """
    now = settle(hops.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while now.where("open").limit(1).count():
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        # What has no hop of its own ends the chain.
        moved = now.join(ahead, F.col("root") == F.col("at"), "left")
        now = settle(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")))
    return now.select("word", "root")


def variants(docs: DataFrame, *, ratio: int = RATIO, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words of the texts (see ``word_counts``).

    The form is the near word that occurs most (ties: the first in code-point order) if it occurs at least ``ratio`` times as often as the
    word, else null; the root is the last form along the chain, or the word itself.  An empty table has no words.
    """
    counted = word_counts(docs, least_length=least_length, least_count=least_count)
    # The index is many times the words: they stay spread.
    words = settle(counted.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word"))
    pairs = settle(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"))
    joined = words.join(best, F.col("word") == F.col("a"), "left").withColumn("much", -F.col("best.less") >= ratio * F.col("n"))
    formed = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("much"), F.col("best.b")).alias("form"),
        F.when(F.col("much"), -F.col("best.less")).alias("form_n"),
    )
    formed = settle(formed)
    ends = roots(formed.where("form is not null").select("word", "form")).withColumnRenamed("word", "of")
    return formed.join(ends, F.col("word") == F.col("of"), "left").drop("of").withColumn("root", F.coalesce("root", "word"))
