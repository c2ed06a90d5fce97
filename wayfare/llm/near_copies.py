"""Near-dedup by similarity: long SimHash fingerprints find candidates, exact Jaccard decides.

A text is the set of its word shingles.  Its fingerprint has two 64-bit words that check a pair, and further ones that are cut
into segments; every segment is indexed with one bit wildcarded, like those of ``simhash``, and texts meet by
equality.  Segments are so long that a bucket holds a few unrelated texts whatever their number, and so many that
``1 - MISSED`` of the pairs right at the limit share one.  A pair in a bucket is a candidate if its check words differ in
no more bits than they do for sets at the limit; nothing after that drops it.  Candidates make clusters, within a cluster
all shingle sets are compared, and what is ``similarity`` alike is linked.

Texts with equal sets meet first, and those with equal check words are candidates at once.  The index is moved once, with nothing
but the check words.  Buckets and clusters above a block are cut into pairs of blocks; of both only links
that join two parts are emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm import simhash
from wayfare.llm.graph import components
from wayfare.session import settle

WIDTH = 5
SIMILARITY = 0.8
# Share of the pairs at the limit that meet in no segment.
MISSED = 0.02
# Words of a fingerprint that check a pair.
CHECKS = 2
# Check words in a block of a bucket, and the share of them (1 in SEEN) from which large buckets are known beforehand.
BLOCK = 4096
SEEN = 64
# Buckets up to this size are compared side by side.
SIDE = 32
# Texts whose sets are compared in one group.
SETS = 256
# Nodes whose joins a task remembers.
JOINED = 1_000_000


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's shingles (see ``simhash.simhash``); empty without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.array([], np.uint64)
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(width, len(found)) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(found) - span].tolist(), ends[span:].tolist(), strict=True)
    return np.unique(np.fromiter((digest(whole[a:b], 42) for a, b in pairs), np.uint64))


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Other hashes of the same shingles, one function per word."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * word) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` longs: a bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros((words, 64), np.int64)
    for i in range(0, len(hashes), simhash.CHUNK):
        part = hashes[i : i + simhash.CHUNK]
        for word in range(words):
            bits = np.unpackbits(_mixed(part, word).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            # Bits of up to 255 rows fit in a byte.
            for k in range(0, len(bits), 255):
                counts[word] += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view("<i8").ravel()


def _differing(similarity: float) -> float:
    """Share of bits in which the fingerprints of two sets of one size differ that are ``similarity`` alike."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def layout(n: int, similarity: float = SIMILARITY) -> tuple[int, int, int]:
    """Bits of a segment, segments, words of a fingerprint for ``n`` texts.

    A wildcarded segment has about a fourth as many values as there are texts at most, so unrelated texts in a bucket stay few.
    """
    bits = min(max(14, int(np.ceil(np.log2(max(n, 2)))) - 1), 32)
    p = _differing(similarity)
    share = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    segments = int(np.ceil(np.log(MISSED) / np.log(1 - share)))
    return bits, segments, CHECKS + -(-segments // (64 // bits))


def kin(checks: np.ndarray) -> np.ndarray:
    """One long for a row of check words."""
    out = np.zeros(len(checks), np.uint64)
    for k in range(CHECKS):
        out = _mixed(out ^ checks[:, k].view(np.uint64), k + 1)
    return out.view(np.int64)


def prints(docs: DataFrame, *, width: int = WIDTH, words: int) -> DataFrame:
    """doc_id, row_key (tells rows of one id apart by content), node (digest of the shingle set), fingerprint, kin; written once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            nodes, found = [], []
            for text in frame["text"]:
                own = shingle_set(text, width)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                found.append(fingerprint(own, words))
            frame["node"] = np.array(nodes, np.uint64).view(np.int64)
            frame["fingerprint"] = found
            frame["kin"] = kin(np.array(found, np.int64).reshape(-1, words)[:, :CHECKS])
            yield frame.drop(columns="text")

    rows = docs.select("doc_id", _row_key(docs).alias("row_key"), docs["text"].cast("string").alias("text"))
    return settle(rows.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, row_key long, node long, fingerprint array<long>, kin long"))


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))


def _cut(rows: DataFrame, blocks: Column, own: Column, key: str, *order: str) -> DataFrame:
    """``rows`` sorted by key, pair of blocks (i, j) and ``order``, each row once for every block its own one is paired with."""
    placed = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(own, F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    placed = placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other")
    return placed.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", *order)


def _dealt(rows: DataFrame, key: str, block: int) -> DataFrame:
    """``rows`` (key, node, ...) cut by the exact sizes of their keys; keys with a single row are left out."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = settle(sizes.select(F.col(key).alias("k__"), F.ceil(F.col("n") / block).cast("int").alias("blocks__")))
    cut = rows.join(sizes, F.col(key) == F.col("k__")).drop("k__")
    return _cut(cut, F.col("blocks__"), F.xxhash64("node"), key).drop("blocks__")


def _by_group(key: str, find: Callable[[pd.DataFrame], list]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Groups arrive sorted; the last one of a batch waits for the next batch, for it may go on there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, parts = None, _Parts()

        def new(frame: pd.DataFrame) -> pd.DataFrame:
            nonlocal parts
            # Links between what this task has joined before tell nothing new.
            links = [(a, b) for a, b in find(frame) if parts.join(a, b)]
            if len(parts.over) > JOINED:
                parts = _Parts()
            return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame])
            last = rest.iloc[-1]
            open_ = ((rest[key] == last[key]) & (rest["i"] == last["i"]) & (rest["j"] == last["j"])).to_numpy()
            yield new(rest[~open_])
            rest = rest[open_]
        if rest is not None:
            yield new(rest)

    return run


class _Parts:
    """Disjoint sets."""

    def __init__(self):
        self.over: dict[int, int] = {}

    def root(self, x: int) -> int:
        over = self.over
        while (up := over.get(x, x)) != x:
            over[x] = x = over.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        ra, rb = self.root(a), self.root(b)
        self.over[max(ra, rb)] = min(ra, rb)
        return ra != rb


def most_bits(similarity: float, bits: int) -> int:
    """Bits of ``bits`` in which two sets that are ``similarity`` alike differ at most: the mean and four deviations."""
    p = _differing(similarity)
    return int(bits * p + 4 * np.sqrt(bits * p * (1 - p)) + 1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _bucket_links(frame: pd.DataFrame, most: int) -> list[tuple[int, int]]:
    """Candidates in sorted buckets (key, i, j), at least as many as connect what they connect."""
    if not len(frame):
        return []
    key, i, j = (frame[c].to_numpy() for c in ("key", "i", "j"))
    checks = np.stack([frame[f"f{k}"].to_numpy(np.int64) for k in range(CHECKS)], axis=1)
    of = kin(checks)
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    sizes = np.diff(np.append(first, len(key)))
    found = []
    # Small buckets all at once: every row with the one d places after it.
    bucket, checks = np.repeat(np.arange(len(first)), sizes), checks.view(np.uint64)
    small = sizes[bucket] <= SIDE
    b, c, o = bucket[small], checks[small], of[small]
    for d in range(1, SIDE):
        same = np.flatnonzero(b[d:] == b[:-d]) if d < len(b) else np.zeros(0, np.int64)
        if not len(same):
            break
        near = same[_apart(c[same], c[same + d]) <= most]
        found.append(np.stack([o[near], o[near + d]], axis=1))
    # In a large one, everything near a row that was reached is reached; what is reached is not looked for again.
    # Rows are in order, so a group starts at the same few of its rows in most of its buckets and makes few different links.
    for at, size in zip(first[sizes > SIDE].tolist(), sizes[sizes > SIDE].tolist(), strict=True):
        left = np.arange(at, at + size)
        while len(left):
            front, left = [int(left[0])], left[1:]
            while front and len(left):
                x = front.pop()
                near = _apart(checks[left], checks[x]) <= most
                reached, left = left[near], left[~near]
                found.append(np.stack([np.full(len(reached), of[x]), of[reached]], axis=1))
                front += reached.tolist()
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
    return pairs.tolist()


def _set_links(frame: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Links between sets that are ``similarity`` alike, enough of them to connect what is linked."""
    out = []
    for _, group in frame.groupby(["cluster", "i", "j"], sort=False):
        nodes, sets = group["node"].tolist(), list(group["hashes"])
        parts = _Parts()
        for y in range(1, len(nodes)):
            for x in range(y):
                if parts.root(nodes[x]) == parts.root(nodes[y]):
                    continue
                n, m = len(sets[x]), len(sets[y])
                if min(n, m) < similarity * max(n, m):
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both >= similarity * (n + m - both) and parts.join(nodes[x], nodes[y]):
                    out.append((nodes[x], nodes[y]))
    return out


def variants(word: Column, place: Column, bits: int) -> Column:
    """Keys of one index word: each of its segments without each of its bits, told apart by place, segment and bit."""
    keys = []
    for first in range(0, 64 - bits + 1, bits):
        segment = F.shiftrightunsigned(word, first).bitwiseAND((1 << bits) - 1)
        for bit in range(bits):
            rest = F.shiftleft(segment.bitwiseAND(((1 << bits) - 1) & ~(1 << bit)), 16)
            keys.append(rest.bitwiseOR(F.shiftleft(place.cast("long"), 6)).bitwiseOR(F.lit(first + bit).cast("long")))
    return F.array(*keys)


def candidates(nodes: DataFrame, bits: int, *, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the kins of ``nodes`` (kin, fingerprint) that share a variant of a segment and have near check words."""
    checks = [F.get("fingerprint", k).alias(f"f{k}") for k in range(CHECKS)]
    each = nodes.select(*checks, F.posexplode(F.slice("fingerprint", CHECKS + 1, 1 << 20)).alias("w", "own"))
    index = each.select(F.explode(variants(F.col("own"), F.col("w"), bits)).alias("key"), *(f"f{k}" for k in range(CHECKS)))
    own = F.xxhash64(*(f"f{k}" for k in range(CHECKS)))
    # Large buckets are known from a share of the rows; one that is missed is looked at in one piece.
    seen = index.where(F.pmod(own, F.lit(SEEN)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block // SEEN)
    large = settle(seen.select(F.col("key").alias("large"), F.ceil(F.col("n") * SEEN / block).cast("int").alias("n_blocks")))
    joined = index.join(large, F.col("key") == F.col("large"), "left").drop("large")
    dealt = _cut(joined, F.coalesce("n_blocks", F.lit(1)), F.shiftrightunsigned(own, 8), "key", "f0").drop("n_blocks")
    most = most_bits(similarity, 64 * CHECKS)
    return dealt.mapInPandas(_by_group("key", lambda f: _bucket_links(f, most)), "a long, b long").distinct()


def grouped(docs: DataFrame, *, width: int = WIDTH, similarity: float = SIMILARITY, block: int = BLOCK, sets: int = SETS) -> DataFrame:
    """doc_id, row_key, group: rows whose shingle sets are linked by pairs that are ``similarity`` alike share a group.

    Texts without words (null ones too) are alike, and unlike all others.  At the limit about ``1 - MISSED`` of the pairs meet as candidates
    (more above it, and where others link them).  Repeated rows share a group; ids may be null; an empty table has no rows.
    """
    bits, _, words = layout(docs.count(), similarity)
    rows = prints(docs, width=width, words=words)
    nodes = settle(
        rows.groupBy("node").agg(
            F.first("fingerprint").alias("fingerprint"), F.first("kin").alias("kin"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("of")
        )
    )
    kins = settle(nodes.groupBy("kin").agg(F.first("fingerprint").alias("fingerprint"), F.count(F.lit(1)).alias("n")))
    roots = settle(components(settle(candidates(kins, bits, similarity=similarity, block=block))))
    clusters = kins.join(roots, F.col("kin") == F.col("node"), "left").where("root is not null or n > 1").select(F.col("kin").alias("of_kin"), F.coalesce("root", "kin").alias("cluster"))
    named = nodes.join(settle(clusters), F.col("kin") == F.col("of_kin"))
    members = settle(named.select("node", "cluster", F.col("of.doc_id").alias("m_id"), F.col("of.row_key").alias("m_key")))
    keyed = docs.select(F.col("doc_id").alias("id__"), _row_key(docs).alias("key__"), docs["text"].cast("string").alias("text"))
    # The members grow with the corpus: texts move by key, at any size.
    texts = keyed.join(members.hint("merge"), (F.col("key__") == F.col("m_key")) & F.col("id__").eqNullSafe(F.col("m_id"))).select("node", "cluster", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["hashes"] = [shingle_set(t, width).view(np.int64) for t in frame["text"]]
            yield frame.drop(columns="text")

    compared = settle(texts.dropDuplicates(["node"]).mapInPandas(run, "node long, cluster long, hashes array<long>"))
    found = _dealt(compared, "cluster", sets).mapInPandas(_by_group("cluster", lambda f: _set_links(f, similarity)), "a long, b long")
    roots = settle(components(settle(found))).withColumnRenamed("node", "r_node")
    return settle(rows.join(roots, F.col("node") == F.col("r_node"), "left").select("doc_id", "row_key", F.coalesce("root", "node").alias("group")))


def deduplicated(docs: DataFrame, *, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` per group, with all its columns: the smallest doc_id, ties by content."""
    return simhash.first_rows(docs, grouped(docs, width=width, similarity=similarity), ["group"])
