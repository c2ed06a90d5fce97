"""Byte-level BPE by monoid tree reduction.

The encodings of byte strings form a monoid: two of them join into the encoding of the strings put together.  A piece is
encoded by halves, and the halves are joined by encoding a window around the seam anew.  A row of
tokens is the encoding of its bytes exactly if every two neighbours are the encoding of theirs, so a window is wide enough
as soon as its outer tokens and the tokens beside them stay as they are when they are encoded together; until then it grows.
Decoding is concatenation, up the same kind of tree.

Runs of millions of characters without a break cost n log n instead of the square that merging pair by pair takes.
No shuffle; what a worker remembers (pieces, pairs of tokens) is bounded.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.words import kept_row

# Bytes that are merged pair by pair; longer strings are halved.
LEAF = 24
# What a worker remembers: pieces (in each of two generations) of up to so many characters, pairs of tokens.
PIECES, PIECE_CHARS = 150_000, 32
PAIRS = 1 << 17
# Pieces of a text that are looked up at a time.
RUN = 1 << 16


def _latin(pattern: str) -> str:
    """``pattern`` with its classes written out for code points below 256."""
    out, inside = [], False
    for part in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, regex.DOTALL):
        if len(part) > 1 and part[1] in "psS":
            one = regex.compile(part.lower() if part[1] == "S" else part)
            members = "".join(f"\\x{c:02x}" for c in range(256) if one.fullmatch(chr(c)))
            part = members if inside else f"[{'^' if part[1] == 'S' else ''}{members}]"
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return "".join(out)


class Coder:
    """Ids of texts by a file of ranks (base64 of a token's bytes, its rank), pieces parted by ``pattern``."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(i) for token, i in (line.split() for line in lines if line.strip())}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, i in self.rank.items():
            self.token[i] = token
        self.any_pieces, self.latin_pieces = regex.compile(pattern), re.compile(_latin(pattern))
        self.known = _Known(self.piece)
        self.stable = lru_cache(PAIRS)(self._stable)

    def merged(self, data: bytes) -> list[int]:
        """Encoding of a byte string without halving it."""
        return self._pairs(data) if len(data) <= LEAF else self._long(data)

    def _pairs(self, data: bytes) -> list[int]:
        """Ids by merging the adjacent pair of least rank (the leftmost of equals) until none can be merged."""
        rank, n = self.rank, len(data)
        # Where parts start, and the rank of each part with the next one.
        get, none, starts = rank.get, 1 << 40, list(range(n + 1))
        pairs = [get(data[i : i + 2], none) for i in range(n - 1)]
        while pairs and (least := min(pairs)) < none:
            at = pairs.index(least)
            del pairs[at], starts[at + 1]
            if at < len(pairs):
                pairs[at] = get(data[starts[at] : starts[at + 2]], none)
            if at:
                pairs[at - 1] = get(data[starts[at - 1] : starts[at + 1]], none)
        return [rank[data[a:b]] for a, b in zip(starts, starts[1:], strict=False)]

    def _long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs over a linked row of parts."""
        rank, n = self.rank, len(data)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            right = after[i] if end[i] else n
            # Parts that have grown or gone since are looked at under their new pair.
            if right >= n or end[right] != stop:
                continue
            end[i], end[right] = stop, 0
            after[i] = after[right]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank.get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := rank.get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(rank[data[i : end[i]]])
            i = after[i]
        return out

    def _stable(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are when they are encoded together."""
        return self._pairs(self.token[a] + self.token[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of both, by windows around the seam that grow until what is outside is stable."""
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        back, ahead = 1, 1
        while True:
            window = self.merged(self.decode(left[len(left) - back :] + right[:ahead]))
            grow_left = back < len(left) and not self.stable(left[len(left) - back - 1], window[0])
            grow_right = ahead < len(right) and not self.stable(window[-1], right[ahead])
            if not grow_left and not grow_right:
                return left[: len(left) - back] + window + right[ahead:]
            back = min(len(left), 2 * back) if grow_left else back
            ahead = min(len(right), 2 * ahead) if grow_right else ahead

    def reduced(self, data: bytes) -> list[int]:
        """Encoding of a byte string by halves."""
        if len(data) <= LEAF:
            return self._pairs(data)
        middle = len(data) // 2
        return self.join(self.reduced(data[:middle]), self.reduced(data[middle:]))

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece: its own token where it is one, or else its encoding."""
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.rank.get(data)
        return (whole,) if whole is not None else tuple(self.reduced(data))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text: the encodings of its pieces in order, a bounded run of pieces at a time."""
        pattern = self.pattern(text)
        if len(text) <= RUN:
            return self._run(pattern.findall(text))
        pieces = (m.group() for m in pattern.finditer(text))
        parts = []
        while run := list(islice(pieces, RUN)):
            parts.append(self._run(run))
        return np.concatenate(parts)

    def pattern(self, text: str) -> re.Pattern | regex.Pattern:
        """The pattern of pieces; one without classes, about twice as fast, where the text has code points below 256 only."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_pieces
        return self.latin_pieces

    def _run(self, pieces: list[str]) -> np.ndarray:
        ids = np.fromiter(chain.from_iterable(map(self.known.__getitem__, pieces)), np.int32)
        if len(self.known) > PIECES:
            self.known = _Known(self.piece, dict(self.known))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids: halves are decoded and concatenated."""
        if len(ids) <= RUN:
            return b"".join(map(self.token.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class _Known(dict):
    """Ids of the pieces seen lately; what was not looked up for a generation goes, and long pieces are not kept."""

    def __init__(self, find: Callable[[str], tuple[int, ...]], older: dict | None = None):
        super().__init__()
        self.find, self.older = find, older or {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            found = self.find(piece)
        if len(piece) <= PIECE_CHARS:
            self[piece] = found
        return found


@lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    """One per worker and vocabulary."""
    return Coder(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """row (all columns of ``docs``), ids (array of int) of the whole ``text``, and back (binary): those ids decoded again.

    A null or empty text has no ids; repeated rows are encoded each; texts of any length are read in bounded runs of pieces.
    """

    @F.arrow_udf("ids array<int>, back binary")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = coder(path, pattern)
        for texts in batches:
            found, back = [], []
            for text in texts:
                found.append(read.encode(text.as_py()))
                back.append(read.decode(found[-1].tolist()))
            ends = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(back, pa.binary())], ["ids", "back"])

    rows = kept_row(docs, coded=coded(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    return rows.select("row", "coded.ids", "coded.back")


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of an array of ids; none for a null or empty one."""

    @F.arrow_udf("binary")
    def data(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = coder(path, pattern)
        for batch in batches:
            yield pa.array([read.decode(x.as_py() or []) for x in batch], pa.binary())

    return data(ids)
