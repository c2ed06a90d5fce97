"""Packing: order-preserving dynamic programming over token windows.

Documents are tokenised and laid out in reading order.  Windows may end at document ends, after sentences, and, inside
long stretches without either, at evenly spaced places.  The cuts minimise padding plus a penalty per cut that
truncates a document.  With f(j) the least cost up to cut place j,

    f(j) = penalty(j) + limit - place(j) + min over i with place(j) - place(i) <= limit of (f(i) + place(i)),

and the minimum over the sliding window comes from a monotone queue, so the search is linear in the number of cut places.

Everything runs inside one pass over the input partitions: no shuffle, memory bounded by a block of
``BLOCK_CHARS`` characters (or one longer document).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
END_ID = 1
BLOCK_CHARS = 2_000_000
# Penalties in tokens of padding: cutting after a sentence, and anywhere.
SENTENCE_COST = 4
ANYWHERE_COST = 12
# Stretches without a sentence end get a cut place every so many tokens.
STEP = 32
# Pieces that a worker remembers for good.
PIECES = 500_000


class Encoder:
    """Ids of whole texts by a public byte-level tokenizer, remembering pieces between blanks.

    The vocabulary splits before a single blank or line feed between two other characters, so such pieces are
    encoded once and looked up afterwards.  A text with any other white space goes to the tokenizer as a whole.
    The first ``PIECES`` pieces stay for good (common words come early), later ones until the block ends.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte = {c: b for b, c in _byte_letters().items()}
        ranks, special = {}, {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            if token not in special:
                raw = bytes(byte[c] for c in token)
                ranks[raw] = i
                self.ends[i] = raw[-1:] in (b".", b"!", b"?") or b"\n" in raw
        # The same vocabulary read as ranks: pieces get the ids that the tokenizer gives them, several times faster.
        self.ranked = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.new: list[str] = []
        self.number = _Numbers(self.new)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths, self.odd = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int] | None:
        """Ids of one piece; none if white space makes it depend on its neighbours."""
        if len(piece) == 1 or piece[1:].split() != [piece[1:]]:
            return None
        return self.ranked.encode_ordinary(piece)

    def _learn(self) -> None:
        found = [self._piece(p) for p in self.new]
        lengths = np.array([len(x) if x is not None else 0 for x in found], np.int64)
        new = np.fromiter((i for x in found if x for i in x), np.uint32, int(lengths.sum()))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.odd = np.concatenate([self.odd, np.array([x is None for x in found], bool)])
        self.used += len(new)
        self.new.clear()

    def _forget(self) -> None:
        """Drop the pieces that came after the first ``PIECES``."""
        while len(self.number) > PIECES:
            self.number.popitem()
        self.used = int(self.starts[PIECES])
        self.starts, self.lengths, self.odd = self.starts[:PIECES], self.lengths[:PIECES], self.odd[:PIECES]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        look, numbers = self.number.__getitem__, []
        for text in texts:
            # Pieces start with a line feed, or stand for a blank and themselves.  The text gets a line feed in front.
            numbers.append(np.array(list(map(look, ("\n" + text).replace("\n", " \n").split(" ")[1:])) if text else [], np.int64))
        if self.new:
            self._learn()
        out = []
        for text, at in zip(texts, numbers, strict=True):
            if not len(at):
                out.append(np.zeros(0, np.uint32))
            elif self.odd[at].any():
                out.append(np.array(self.plain(text), np.uint32))
            else:
                lengths = self.lengths[at]
                ends = np.cumsum(lengths)
                places = np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1])
                # Without the line feed that was put in front.
                out.append(self.flat[places][1:])
        if len(self.number) > PIECES:
            self._forget()
        return out


class _Numbers(dict):
    """Numbers pieces as they appear and notes the new ones."""

    def __init__(self, new: list[str]):
        super().__init__()
        self.new = new

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece if piece[:1] == "\n" else " " + piece)
        return n


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_places(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, *, limit: int = LIMIT, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end and their penalties; ``ends`` are the document ends, the last one is the total."""
    at = np.flatnonzero(sentence[ids]) + 1
    cost = np.full(len(ids) + 1, -1, np.int64)
    cost[at] = SENTENCE_COST
    cost[0] = 0
    cost[ends] = 0
    known = np.flatnonzero(cost >= 0)
    step = min(step, limit)
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > step)
    for left, gap in zip(known[wide], gaps[wide], strict=True):
        cost[left + step : left + gap : step] = ANYWHERE_COST
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def best_cuts(places: list[int], costs: list[int], limit: int = LIMIT) -> list[int]:
    """Cheapest cut places from the first to the last one; neighbours in ``places`` are at most ``limit`` apart."""
    n = len(places)
    came, key = [0] * n, [0] * n
    key[0] = places[0]  # f + place
    queue, head = [0], 0
    for j in range(1, n):
        here = places[j]
        low = here - limit
        while places[queue[head]] < low:
            head += 1
        i = queue[head]
        came[j] = i
        # f(j) + place(j); limit - place(j) of padding cancels the place.
        k = key[j] = key[i] + limit + costs[j]
        while len(queue) > head and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(places[j])
        j = came[j]
    return [places[0], *reversed(cuts)]


def pieces(ids: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> dict[str, np.ndarray]:
    """Pieces of documents in windows: edges are the cuts and the document ends (documents are not empty)."""
    edges = np.union1d(cuts, ends)
    left, right = edges[:-1], edges[1:]
    doc = np.searchsorted(ends, left, "right")
    window = np.searchsorted(cuts, left, "right") - 1
    starts = np.concatenate([[0], ends[:-1]])
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)), np.int64, len(left))
    return {
        "doc": doc, "start": left - starts[doc], "length": right - left, "ids_crc32": crc,
        "doc_tokens": (ends - starts)[doc], "window": window, "offset": left - cuts[window],
    }


def pack_block(texts: list[str], coder: Encoder, limit: int = LIMIT) -> dict[str, np.ndarray]:
    coded = coder.encode(texts)
    last = np.array([END_ID], np.uint32)
    ids = np.concatenate([x for one in coded for x in (one, last)])
    ends = np.cumsum([len(x) + 1 for x in coded])
    places, costs = cut_places(ids, ends, coder.ends, limit=limit)
    return pieces(ids, ends, np.array(best_cuts(places.tolist(), costs.tolist(), limit)))


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def packed(docs: DataFrame, path: str, *, id_column: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """Pieces of all rows of ``docs`` in their order: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` names the tokenizer's file, which every worker has.  A null text is empty and has the end id only; ids may be null
    or repeated (each row is a document of its own); an empty table gives no rows; other columns are not read.
    A sequence is named by its input partition and number, so a task that runs again gives the same names.
    """
    # Positions inside Arrow batches never leave the task.
    kind = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        sequence = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in _blocks(texts):
                found = pack_block(texts[begin:end], coder, limit)
                columns = [batch.column(0).slice(begin, end - begin).take(pa.array(found["doc"]))]
                columns += [pa.array(found[c].astype(np.int64)) for c in ("start", "length", "ids_crc32", "doc_tokens")]
                columns += [pa.array(found["window"].astype(np.int64) + sequence), pa.array(found["offset"].astype(np.int64))]
                sequence += int(found["window"][-1]) + 1
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    rows = docs.select(F.col(id_column), F.col("text").cast("string"))
    schema = f"`{id_column}` {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema)
