"""Suffix-array dedup: byte strings of a given length that start at two places or more are removed.

Every window of ``length`` bytes has one anchor, the leftmost q-gram in it with the least hash, so equal windows have equal
anchors at equal offsets.  Neighbouring windows with the same anchor form a stretch.  Stretches are told apart by a digest, so
copies are counted, not compared.  Stretches that share an anchor but differ are aligned at it and sorted twice, by the suffix from
the anchor on and by the reversed prefix before it: comparisons use prefix polynomial hashes and a binary search for the common
extension, inside a mergesort, and neighbours in the order are verified byte by byte.  Classes of equal
prefixes then follow from the common extensions of neighbours, and two windows are equal when both their classes are.

Texts are read as UTF-8 bytes, a null text as empty; matches never cross documents.  Rows that repeat in full are documents
of their own and match each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfare.session import settle

LENGTH = 400
GRAM = 32
# Window starts worked on at a time, and the bits their positions take in a packed minimum.
CHUNK, PLACE_BITS = 1 << 19, 20
# Odd multiplier of the polynomial hash modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
# Stretches of one anchor that are sorted together, and bytes in a task's group of anchors.
BLOCK = 4096
GROUP_BYTES = 2_000_000


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for factor in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n, factor, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class PrefixHashes:
    """Polynomial hashes of all substrings of a byte array, modulo 2^64 (so a claim needs verification)."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(10, int(len(data)).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, windows, anchor place, anchor hash) of all stretches of texts that lie behind each other in ``data``.

    ``bounds`` holds the texts' limits.  Long texts are cut into chunks of window starts, which splits a stretch but no window.
    """
    for low in range(int(bounds[0]), int(bounds[-1]), CHUNK):
        high = min(low + CHUNK, int(bounds[-1]))
        part = data[low : min(high + length - 1, int(bounds[-1]))]
        if len(part) < length:
            continue
        valid = np.zeros(len(part) - length + 1, bool)
        first = np.searchsorted(bounds, low, "right") - 1
        for left, right in zip(bounds[first:-1].tolist(), bounds[first + 1 :].tolist(), strict=True):
            if left >= high:
                break
            valid[max(0, left - low) : max(0, right - low - length + 1)] = True
        hashes = _mixed(PrefixHashes(part).of(np.arange(len(part) - gram + 1), gram))
        places = np.uint64((1 << PLACE_BITS) - 1)
        packed = (hashes & ~places) | np.arange(len(hashes), dtype=np.uint64)
        anchors = (_window_minima(packed, length - gram + 1) & places).astype(np.int64)
        starts = np.flatnonzero(valid)
        if not len(starts):
            continue
        at = anchors[starts]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(at) != 0)]))
        windows = np.diff(np.concatenate([heads, [len(starts)]]))
        yield low + starts[heads], windows, low + at[heads], hashes[at[heads]].view(np.int64)


def _column(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and limits of a binary column."""
    column = batch.column(i).cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, bounds


STRETCH = "key_text long, at long, windows int, anchor long, offset int, content binary"


def _found_stretches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds = _column(batch, 2)
            raw = memoryview(data)
            for start, windows, place, anchor in stretches(data, bounds, length, gram):
                doc = np.searchsorted(bounds, start, "right") - 1
                ends = (start + windows + length - 1).tolist()
                digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), ends, strict=True)]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start - bounds[doc]), pa.array(windows.astype(np.int32)),
                        pa.array(anchor), pa.array((place - start).astype(np.int32)), pa.array(digests, pa.binary()),
                    ],
                    names=["doc_id", "key_text", "at", "windows", "anchor", "offset", "content"],
                )

    return run


def _common(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common extensions of pairs of places, at most ``most``: binary search over hash comparisons."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := low < high).any():
        middle = (low + high + 1) >> 1
        equal = hashes.of(a, middle) == hashes.of(b, middle)
        low = np.where(open_ & equal, middle, low)
        high = np.where(open_ & ~equal, middle - 1, high)
    return low


def suffix_sort(data: np.ndarray, group: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (group first, then bytes) and what each has in common with the one before it.

    A mergesort from runs of one: each element's place in the other run comes from a binary search whose
    comparisons cost a logarithm of the length.  What neighbours have in common is verified on the bytes.
    """
    hashes, n = PrefixHashes(data), len(start)
    padded = np.concatenate([data, np.zeros(1, np.uint8)])

    def before(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a stands before suffix b."""
        most = np.minimum(length[a], length[b])
        same = _common(hashes, start[a], start[b], np.where(group[a] == group[b], most, 0))
        x, y = padded[start[a] + same], padded[start[b] + same]
        by_bytes = np.where(same < most, x < y, np.where(length[a] == length[b], or_equal, length[a] < length[b]))
        return np.where(group[a] == group[b], by_bytes, group[a] < group[b])

    order = np.arange(n)
    run = 1
    places = np.arange(n)
    while run < n:
        own = places // run
        other = own ^ 1
        low, high = np.minimum(other * run, n), np.minimum((other + 1) * run, n)
        first = low.copy()
        second = own % 2 == 1
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            ask = np.flatnonzero(open_)
            # Elements of the first run come before equal ones of the second.
            ahead = before(order[middle[ask]], order[ask], second[ask])
            low[ask] = np.where(ahead, middle[ask] + 1, low[ask])
            high[ask] = np.where(ahead, high[ask], middle[ask])
        target = (places // (2 * run)) * (2 * run) + places % run + (low - first)
        merged = np.empty_like(order)
        merged[target] = order
        order, run = merged, 2 * run
    shared = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    alike = group[a] == group[b]
    shared[1:] = _common(hashes, start[a], start[b], np.where(alike, np.minimum(length[a], length[b]), 0))
    for i in np.flatnonzero(shared):
        x, y, k = start[order[i - 1]], start[order[i]], shared[i]
        if data[x : x + k].tobytes() != data[y : y + k].tobytes():
            # Two different strings with one hash: the true common length.
            shared[i] = int(np.argmax(data[x : x + k] != data[y : y + k]))
    return order, shared


def repeated_windows(contents: list[bytes], anchor: np.ndarray, offset: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each stretch, which of its windows are also in another stretch of the same anchor.

    ``offset`` is the anchor's place in the stretch; its window w starts offset - w bytes before the anchor.
    """
    n = len(contents)
    sizes = np.array([len(c) for c in contents], np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contents), np.uint8)
    group = np.unique(anchor, return_inverse=True)[1]
    by_right, right = suffix_sort(data, group, begins + offset, sizes - offset)
    # Reversed, the bytes before an anchor are a suffix that starts where the anchor starts.
    total = len(data)
    by_left, left = suffix_sort(np.ascontiguousarray(data[::-1]), group, total - (begins + offset), offset)
    new_right = np.concatenate([[True], np.diff(group[by_right]) != 0])
    new_left = np.concatenate([[True], np.diff(group[by_left]) != 0])
    out = [np.zeros(w, bool) for w in windows]
    class_right, class_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(int((offset - windows).min()) + 1, int(offset.max()) + 1):
        active = np.flatnonzero((offset >= back) & (offset - back < windows))
        if len(active) < 2:
            continue
        class_right[by_right] = np.cumsum(new_right | (right < length - back))
        class_left[by_left] = np.cumsum(new_left | (left < back))
        keys = class_right[active] * (n + 1) + class_left[active]
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        for i in active[counts[inverse] > 1].tolist():
            out[i][offset[i] - back] = True
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


def _compared(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        flags = repeated_windows(
            frame["bytes"].tolist(), frame["anchor"].to_numpy(), frame["offset"].to_numpy(np.int64), frame["windows"].to_numpy(np.int64), length
        )
        rows = [
            (a, c, int(s), int(n))
            for a, c, f in zip(frame["anchor"], frame["content"], flags, strict=True)
            for s, n in zip(*_runs(f), strict=True)
        ]
        return pd.DataFrame(rows, columns=["anchor", "content", "skip", "n"])

    return run


def _cut_out(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, wanted in zip(frame["text"], frame["wanted"], strict=True):
                for w in wanted:
                    a = w["at"]
                    rows.append((w["anchor"], w["content"], w["windows"], w["offset"], w["contents"], bytes(text[a : a + w["windows"] + length - 1])))
            yield pd.DataFrame(rows, columns=["anchor", "content", "windows", "offset", "contents", "bytes"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key_text, text as bytes.  Rows equal in id and text share a key."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("key_text"), text.cast("binary").alias("text"))


def _on_key(left: DataFrame, right: DataFrame) -> Column:
    return (left["key_text"] == right["r_key"]) & left["doc_id"].eqNullSafe(right["r_id"])


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """r_id, r_key, spans (array of start and number of repeated window starts), a row for each id and text with any."""
    rows = _keyed(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = settle(rows.mapInArrow(_found_stretches(length, gram), f"doc_id {kind}, {STRETCH}"))
    # Counts are written before they are joined: the join then reads two tables, and a hot anchor's stretches can be split.
    shared = settle(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("anchor").alias("s_anchor")))
    # From here on only stretches whose anchor is not alone.
    several = settle(found.join(shared, F.col("anchor") == F.col("s_anchor"), "left_semi"))
    place = F.struct("doc_id", "key_text", "at", "windows", "offset")
    contents = settle(several.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one")))
    per_anchor = settle(contents.groupBy(F.col("anchor").alias("c_anchor")).agg(F.count(F.lit(1)).alias("contents")))
    counted = settle(contents.join(per_anchor, F.col("anchor") == F.col("c_anchor")).drop("c_anchor"))
    whole = counted.where("n > 1").select("anchor", "content", F.lit(0).alias("skip"), F.col("one.windows").alias("n"))

    # One place of every content that has to be compared, fetched by document.
    unequal = counted.where("contents > 1")
    size = unequal.agg(F.sum(F.col("one.windows") + length - 1)).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    wanted = unequal.groupBy(F.col("one.doc_id").alias("r_id"), F.col("one.key_text").alias("r_key")).agg(
        F.collect_list(F.struct("anchor", "content", "one.at", "one.windows", "one.offset", "contents")).alias("wanted")
    )
    # Rows that repeat in full hold the same bytes: a content may come twice, and counts once.
    texts = rows.join(wanted, _on_key(rows, wanted)).select("text", "wanted")
    cut = texts.mapInPandas(_cut_out(length), "anchor long, content binary, windows int, offset int, contents long, bytes binary")
    blocks = F.ceil(F.col("contents") / block).cast("int")
    own = F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")
    placed = cut.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    placed = placed.withColumn("bin", F.when(F.col("blocks") > 1, F.xxhash64("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(groups))))
    placed = placed.dropDuplicates(["bin", "i", "j", "anchor", "content"])
    compared = placed.groupBy("bin", "i", "j").applyInPandas(_compared(length), "anchor long, content binary, skip int, n int")

    verdicts = settle(whole.unionByName(compared)).select(F.col("anchor").alias("v_anchor"), F.col("content").alias("v_content"), "skip", "n")
    hits = several.join(verdicts, (F.col("anchor") == F.col("v_anchor")) & (F.col("content") == F.col("v_content")))
    spans = hits.select(F.col("doc_id").alias("r_id"), F.col("key_text").alias("r_key"), F.struct((F.col("at") + F.col("skip")).alias("at"), "n").alias("span"))
    return spans.groupBy("r_id", "r_key").agg(F.collect_list("span").alias("spans"))


def merged_spans(spans: list, length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes from (first window start, number of starts)."""
    out: list[tuple[int, int]] = []
    for at, n in sorted((s["at"], s["n"]) for s in spans):
        end = at + n - 1 + length
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((at, end))
    return out


def deduplicated(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, ``removed`` (array of start and end in bytes) and ``kept`` (the bytes that stay)."""
    rows, found = _keyed(docs), repeated_spans(docs, length=length, gram=gram, block=block)

    @F.pandas_udf(StructType.fromDDL("removed array<struct<start: bigint, end: bigint>>, kept binary"))
    def cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        removed, kept = [], []
        for t, s in zip(text, spans, strict=True):
            runs = [] if s is None else merged_spans(s, length)
            removed.append([{"start": a, "end": b} for a, b in runs])
            edges = [0, *(x for r in runs for x in r), len(t or b"")]
            kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else None)
        return pd.DataFrame({"removed": removed, "kept": kept})

    joined = rows.join(found, _on_key(rows, found), "left")
    # Only texts that lose something go to Python.
    done = joined.select("doc_id", "text", cut(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans")).alias("c"))
    return done.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "c.removed", F.coalesce("c.kept", "text").alias("kept"))
