"""SimHash near-dedup with deletion-variant signatures.

Fingerprints of 64 bits that differ in at most four bits are linked.  They are cut into three segments, so
one segment differs by at most one bit.  Each distinct fingerprint is indexed under every segment with one bit
wildcarded (64 variants); fingerprints that share a variant meet by equality and are verified in full.

Documents with equal fingerprints meet first, so a group of copies is one fingerprint.  Within a variant's bucket only
links that join two parts of the bucket are emitted, never all pairs; large buckets are cut into
blocks, and every pair of blocks is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wayfare.llm.graph import components
from wayfare.session import settle

BITS = 4
WIDTH = 4
# First bit and length of the segments, low bits first: three of them, so that one differs by one bit at most.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Fingerprints in a block of a bucket.
BLOCK = 1024
# Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def simhash(text: str | None, width: int = WIDTH) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half of the shingle hashes; 0 without words.

    A-Z are lower-cased; words are parted by the six blanks of ASCII; a shingle is ``width`` words joined by a blank (all
    words when there are fewer), repeats included; its hash is XXH64 of the UTF-8 bytes with seed 42.
    """
    # bytes.lower and bytes.split know ASCII only, which is what is asked for.
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    whole = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(width, len(found)) - 1
    n = len(found) - span
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        j = min(n, i + CHUNK)
        hashes = [digest(whole[a:b], 42) for a, b in zip(starts[i:j].tolist(), ends[i + span : j + span].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def simhash_column(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(t) for t in texts], np.uint64).view(np.int64))


def written(fingerprint: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def variants(fingerprint: Column) -> Column:
    """64 keys of a fingerprint: for each segment and each of its bits, the segment without that bit, and which one it was."""
    keys = []
    for first, length in SEGMENTS:
        segment = F.shiftrightunsigned(fingerprint, first).bitwiseAND((1 << length) - 1)
        for bit in range(length):
            keys.append(F.shiftleft(segment.bitwiseAND(((1 << length) - 1) & ~(1 << bit)), 8).bitwiseOR(F.lit(first + bit)))
    return F.array(*keys)


def _first_variant(differing: np.ndarray) -> np.ndarray:
    """The one variant in which a pair is looked at: the first segment that differs by at most one bit, at that bit (or its first)."""
    out = np.full(differing.shape, -1, np.int64)
    for first, length in reversed(SEGMENTS):
        part = (differing >> np.uint64(first)) & np.uint64((1 << length) - 1)
        single = (part & np.where(part == 0, np.uint64(0), part - np.uint64(1))) == 0
        bit = np.where(part == 0, 0, np.log2(np.maximum(part, 1).astype(np.float64)).astype(np.int64))
        out = np.where(single, first + bit, out)
    return out


def links_in_buckets(key: np.ndarray, left: np.ndarray, right: np.ndarray, fingerprint: np.ndarray) -> list[tuple[int, int]]:
    """Links inside sorted buckets (key, left block, right block) that join two parts of what the buckets hold.

    A linked pair counts in its first variant only.
    """
    found_a, found_b = [], []
    for d in range(1, len(key)):
        same = (key[d:] == key[:-d]) & (left[d:] == left[:-d]) & (right[d:] == right[:-d])
        if not same.any():
            break
        x, y = fingerprint[:-d][same], fingerprint[d:][same]
        differing = x ^ y
        near = (np.bitwise_count(differing) <= BITS) & (_first_variant(differing) == (key[d:][same] & 255))
        found_a.append(x[near])
        found_b.append(y[near])
    pairs = zip(np.concatenate(found_a).tolist(), np.concatenate(found_b).tolist(), strict=True) if found_a else ()
    over: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := over.get(x, x)) != x:
            over[x] = x = over.get(up, up)
        return x

    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            over[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _link_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Buckets arrive sorted; the last one of a batch waits for the next batch, for it may go on there."""
    rest = None
    for frame in frames:
        rest = frame if rest is None else pd.concat([rest, frame])
        last = rest.iloc[-1]
        open_ = (rest["key"] == last["key"]) & (rest["i"] == last["i"]) & (rest["j"] == last["j"])
        yield _links(rest[~open_])
        rest = rest[open_]
    if rest is not None:
        yield _links(rest)


def _links(frame: pd.DataFrame) -> pd.DataFrame:
    fingerprints = frame["fingerprint"].to_numpy(np.int64).view(np.uint64)
    found = links_in_buckets(frame["key"].to_numpy(), frame["i"].to_numpy(), frame["j"].to_numpy(), fingerprints)
    return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])


def links(fingerprints: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct ``fingerprint`` values that differ in at most four bits: enough of them to connect what is linked.

    Every linked pair is looked at in one variant of the index.  A bucket above ``block`` fingerprints is cut into blocks by hash, and
    each pair of blocks is looked at on its own.
    """
    index = fingerprints.select(F.explode(variants(F.col("fingerprint"))).alias("key"), "fingerprint")
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    sizes = settle(sizes.select(F.col("key").alias("large"), F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    cut = index.join(sizes, F.col("key") == F.col("large"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    placed = cut.select("key", "fingerprint", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fingerprint")
    dealt = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fingerprint")
    return dealt.mapInPandas(_link_batches, "a long, b long")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (tells rows of one id apart by content), fingerprint; written once.

    A null text has no words and the fingerprint 0, like a blank one.
    """
    row_key = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    return settle(docs.select("doc_id", row_key.alias("row_key"), simhash_column(docs["text"].cast("string")).alias("fingerprint")))


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` of ``fingerprinted`` with ``component_id``: the smallest doc_id reachable over links.

    Repeated rows and rows without an id belong to the group of their fingerprint; an id is null only if all of a group's are.
    """
    once = settle(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")))
    roots = settle(components(links(once)))
    named = once.join(roots, F.col("fingerprint") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = settle(named.groupBy("root").agg(F.min("least_id").alias("component_id")))
    classes = settle(named.join(least, "root").select(F.col("fingerprint").alias("f"), "component_id"))
    return rows.join(classes, F.col("fingerprint") == F.col("f")).drop("f")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per group, with all its columns: the smallest doc_id, ties by content.

    Rows equal in every column are one candidate and leave one row.
    """
    rows = grouped(fingerprinted(docs))
    # Groups without any id are told apart by their fingerprint.
    none = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    return first_rows(docs, rows.withColumn("none", none), ["component_id", "none"])


def first_rows(docs: DataFrame, rows: DataFrame, group: list[str]) -> DataFrame:
    """One row of ``docs`` for each group of ``rows`` (doc_id, row_key and the columns ``group``)."""
    equal = rows.groupBy(*group, "doc_id", "row_key").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "n")
    best = equal.groupBy(*group).agg(F.min(order).alias("best"))
    kept = settle(best.select(F.col("best.doc_id").alias("k_id"), F.col("best.row_key").alias("k_key"), F.col("best.n").alias("k_n")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("id__"), F.xxhash64(*names).alias("key__"))
    stays = keyed.join(kept, (F.col("key__") == F.col("k_key")) & F.col("id__").eqNullSafe(F.col("k_id")))
    single = stays.where("k_n = 1").select("row")
    several = stays.where("k_n > 1").groupBy("id__", "key__").agg(F.first("row").alias("row")).select("row")
    return single.unionAll(several).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
