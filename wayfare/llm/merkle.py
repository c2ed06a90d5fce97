"""Merkle manifest of a dataset as a postorder append log.

Leaves of a tree stand in order.  A builder takes an aligned run of ``FAN ** LEVELS`` leaves and writes nodes as they complete:
a leaf, and after the last one of a run its parent, and so on up.  Where a node stands in the log follows from the sizes of the
complete subtrees before it alone (``position``), so no index is needed to find a leaf's siblings.  The roots of
the aligned runs are the leaves of the next tier of the tree, and so on until one node is left; the trees' roots are the leaves of
a tree of their own.

A builder's run is bounded whatever the size of a tree, trees of any size share tasks, and there are as many
rounds as the largest tree has tiers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.numbering import numbered
from wayfare.session import settle

FAN = 16
# Levels that one builder completes: its run has FAN ** LEVELS leaves.
LEVELS = 3
# Rows that a task passes on at once.
BATCH = 8192
# Number of the tree over the trees' roots.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def height(n: int) -> int:
    """Levels above the ``n`` leaves of a tree."""
    levels = 0
    while n > 1:
        n = -(-n // FAN)
        levels += 1
    return levels


def position(n: int, level: int, index: int) -> int:
    """Place in the log, from 0, of the node ``index`` of ``level`` in a tree of ``n`` leaves."""
    span = FAN**level
    if (index + 1) * span <= n:
        # All complete subtrees before its last leaf, that leaf, and what that leaf completes.
        last, above = (index + 1) * span - 1, level
    else:
        # The ragged nodes come after all others, the lowest first.
        last, above = n, sum(n % FAN**k != 0 for k in range(1, level + 1)) - 1
    before, k = last, last // FAN
    while k:
        before, k = before + k, k // FAN
    return before + above


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """Digest of a row's values, each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _in_runs(rows: DataFrame, order: str) -> DataFrame:
    return rows.repartition("tree", "run").sortWithinPartitions("tree", "run", order)


@dataclass
class _Builder:
    """Completes the nodes of one aligned run."""

    tree: int
    run: int
    n: int
    levels: int

    def __post_init__(self):
        self.top = min(self.levels, height(self.n))
        self.open: list[list[str]] = [[] for _ in range(self.top + 1)]
        self.at = position(self.n, 0, self.run * FAN**self.levels)
        self.log: list[tuple] = []

    def add(self, level: int, digest: str, doc_id=None, changed=None) -> None:
        self.log.append((self.tree, self.run, self.at, level == self.top, bytes.fromhex(digest), doc_id, changed))
        self.at += 1
        if level < self.top:
            self.open[level].append(digest)
            if len(self.open[level]) == FAN:
                self.close(level)

    def close(self, level: int) -> None:
        together = "".join(self.open[level])
        self.open[level] = []
        self.add(level + 1, _h(together))

    def end(self) -> None:
        """The last run of a tree may be ragged: what is open completes from below."""
        for level in range(self.top):
            if self.open[level]:
                self.close(level)

    def taken(self) -> list[tuple]:
        found, self.log = self.log, []
        return found


def _log(nodes: DataFrame, levels: int) -> DataFrame:
    """One tier's log of ``nodes`` (tree, i, n, digest, doc_id, changed): tree, run, at (the place), is_root (of the run), digest,
    and of leaves doc_id and changed; written once."""
    names = ["tree", "run", "at", "is_root", "digest", "doc_id", "changed"]

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Builder | None = None
        for frame in frames:
            out: list[tuple] = []
            for tree, run, n, digest, doc_id, changed in zip(*(frame[c].tolist() for c in ("tree", "run", "n", "digest", "doc_id", "changed")), strict=True):
                if now is None or (now.tree, now.run) != (tree, run):
                    if now is not None:
                        now.end()
                        out += now.taken()
                    now = _Builder(tree, run, n, levels)
                now.add(0, digest.hex(), doc_id, changed)
            out += now.taken() if now else []
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            now.end()
            yield pd.DataFrame(now.taken(), columns=names)

    rows = nodes.withColumn("run", F.floor(F.col("i") / FAN**levels).cast("long"))
    schema = "tree long, run long, at long, is_root boolean, digest binary, doc_id string, changed binary"
    return settle(_in_runs(rows, "i").mapInPandas(build, schema))


class _Run:
    """A run's part of the log with the way from its root up."""

    def __init__(self, tree: int, run: int, n: int, path: tuple, levels: int):
        self.tree, self.run, self.n = tree, run, n
        self.top, self.leaf = min(levels, height(n)), run * FAN**levels
        self.before, self.after, self.subroot, self.root = path
        self.first = position(n, 0, self.leaf)
        self.log: list[str] = []

    def together(self, level: int, start: int) -> list[str]:
        """Digests of the nodes of ``level`` under one parent, the first of which is ``start``; closed-form places tell where they stand."""
        stop = min(start + FAN, -(-self.n // FAN**level))
        return [self.log[position(self.n, level, k) - self.first] for k in range(start, stop)]

    def ways(self) -> Iterator[tuple[int, list[str], list[str]]]:
        """Of each of the run's leaves: number, and of every level up to the root the digests before and after the node on its way."""
        above: list[tuple[list[str], list[str]]] = [([], [])]
        for level in range(self.top - 1, -1, -1):
            first, own = self.leaf // FAN**level, []
            for parent, (up_before, up_after) in enumerate(above):
                digests = self.together(level, first + parent * FAN)
                for k in range(len(digests)):
                    own.append((["".join(digests[:k]), *up_before], ["".join(digests[k + 1 :]), *up_after]))
            above = own
        for k, (b, a) in enumerate(above):
            yield self.leaf + k, [*b, *self.before], [*a, *self.after]


def _fold(digest: str, before: list[str], after: list[str], known: dict) -> str:
    """Root recomputed from a node and its siblings; nodes folded before are remembered."""
    if not before:
        return digest
    key = (digest, before[0], after[0], len(before))
    if key not in known:
        known[key] = _fold(_h(before[0] + digest + after[0]), before[1:], after[1:], known)
    return known[key]


def _walked(log: DataFrame, paths: DataFrame, leaves: bool, whole: bool, levels: int) -> DataFrame:
    """The ways of all leaves of a tier, from its ``log`` and the ``paths`` (tree, run, n, before, after, subroot, root) of its runs.

    With ``leaves`` the documents' rows, otherwise the paths of the runs below.
    """

    def rows(run: _Run, entries: list[tuple]) -> Iterator[tuple]:
        run.log = [x[0].hex() for x in entries]
        known: dict = {}
        for i, before, after in run.ways():
            at = position(run.n, 0, i) - run.first
            digest, doc_id, changed = entries[at]
            if not leaves:
                # The tree of roots starts each tree's path; its leaf is that tree's root.
                subroot = digest if run.tree == TOP else run.subroot
                yield run.tree, i, before, after, subroot, run.root
                continue
            known.clear() if i % FAN == 0 else None
            proof = "".join(b + a for b, a in zip(before, after, strict=True))
            start = changed if changed is not None else digest
            folded = _fold(start.hex(), before, after, known)
            yield doc_id, digest.hex(), run.subroot.hex(), run.root.hex(), _h(proof), folded, proof if whole else None

    below = ["tree", "run", "before", "after", "subroot", "root"]
    results = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "proof"]
    names = results if leaves else below

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, entries = None, []
        for frame in frames:
            out: list[tuple] = []
            columns = ("tree", "run", "at", "n", "before", "after", "subroot", "root", "digest", "changed", "doc_id")
            for tree, run, at, n, before, after, subroot, root, digest, changed, doc_id in zip(*(frame[c].tolist() for c in columns), strict=True):
                if at < 0:
                    if now is not None:
                        out += rows(now, entries)
                    now, entries = _Run(tree, run, n, (list(before), list(after), subroot, root), levels), []
                else:
                    entries.append((digest, doc_id, changed))
                if len(out) >= BATCH:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame(list(rows(now, entries)), columns=names)

    heads = paths.withColumns({"at": F.lit(-1).cast("long"), "digest": F.lit(None).cast("binary"), "changed": F.lit(None).cast("binary"), "doc_id": F.lit(None).cast("string")})
    empty = F.lit(None).cast("array<string>")
    nodes = log.drop("is_root").withColumns({"n": F.lit(0).cast("long"), "before": empty, "after": empty, "subroot": F.lit(None).cast("binary"), "root": F.lit(None).cast("binary")})
    schema = (
        "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, proof string"
        if leaves
        else "tree long, run long, before array<string>, after array<string>, subroot binary, root binary"
    )
    return _in_runs(nodes.unionByName(heads), "at").mapInPandas(walk, schema)


def _tiers(n: int, levels: int) -> int:
    """Tiers of logs of a tree of ``n`` leaves."""
    return max(1, -(-height(n) // levels))


def _built(nodes: DataFrame, most: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Logs of all tiers over ``nodes``, whose largest tree has ``most`` leaves, and the trees' roots (tree, digest)."""
    logs, ends, span = [], [], FAN**levels
    for _ in range(_tiers(most, levels)):
        logs.append(log := _log(nodes, levels))
        counts = nodes.select("tree", F.ceil(F.col("n") / span).cast("long").alias("runs")).where("i = 0")
        heads = log.where("is_root").select("tree", F.col("run").alias("i"), "digest").join(counts, "tree")
        ends.append(heads.where("runs = 1").select("tree", "digest"))
        none = {"doc_id": F.lit(None).cast("string"), "changed": F.lit(None).cast("binary")}
        nodes = settle(heads.where("runs > 1").select("tree", "i", F.col("runs").alias("n"), "digest").withColumns(none))
    found = ends[0]
    for end in ends[1:]:
        found = found.unionByName(end)
    return logs, settle(found)


def _paths(logs: list[DataFrame], starts: DataFrame, whole: bool, leaves: bool, levels: int) -> DataFrame:
    """Ways of all leaves under the ``starts`` (tree, n, before, after, subroot, root) of whole trees, from the last tier down."""
    sizes, found, span = starts.select("tree", "n"), None, FAN**levels
    for tier in range(len(logs) - 1, -1, -1):
        n = _leaves(tier, span)
        # A tree comes in where it has a single run.
        single = (n <= span) & ((_leaves(tier - 1, span) > span) if tier else F.lit(True))
        own = starts.where(single).select("tree", F.lit(0).cast("long").alias("run"), n.alias("n"), "before", "after", "subroot", "root")
        if found is not None:
            own = own.unionByName(found.join(sizes, "tree").withColumn("n", n).select(*own.columns))
        last = tier == 0
        found = _walked(logs[tier], own, leaves and last, whole, levels)
        if not last:
            found = settle(found)
    return found


def _leaves(tier: int, span: int) -> Column:
    """Leaves that a tree of n leaves has in a tier."""
    n = F.col("n")
    for _ in range(tier):
        n = F.ceil(n / span).cast("long")
    return n


def manifest(docs: DataFrame, values: list[str], *, tree: str, key: str, changed: dict[str, Column] | None = None, if_changed: Column | None = None, whole: bool = False, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (and the whole ``proof`` if asked for) of every row of ``docs``.

    Rows are leaves: the digest of their ``values``.  Each value of the column ``tree`` has a tree, null too, with its leaves by
    ``key`` (nulls first, ties by digest); the trees' roots, null first, make the root.  The proof is the siblings from the leaf up to
    the root.  ``folded_root`` starts at the leaf of the row as it would be with the columns ``changed`` where ``if_changed`` holds, and
    climbs by the original siblings.  An empty table has no rows; repeated rows are leaves each; other columns are not read.
    """
    id_type = dict(docs.dtypes)[key]
    columns = [F.col(f"`{c}`") for c in values]
    other = leaf([(changed or {}).get(c, F.col(f"`{c}`")) for c in values])
    flag = F.coalesce(if_changed, F.lit(False)) if if_changed is not None else F.lit(False)
    rows = docs.select(
        F.col(f"`{tree}`").cast("string").alias("name"),
        F.col(f"`{key}`").alias("doc_id"),
        F.unhex(leaf(columns)).alias("digest"),
        F.unhex(F.when(flag, other)).alias("changed"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # Rows equal in all are told apart by their place, so that they can be cut anywhere; which is which makes no difference.
    place = [F.col("name").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("tie")]
    ranked = settle(numbered(settle(rows), place, "g").drop("tie"))
    trees = settle(ranked.groupBy("name").agg(F.min("g").alias("start"), F.count(F.lit(1)).alias("n")))
    trees = settle(numbered(trees, [F.col("name").asc_nulls_first()], "tree"))
    of = trees.select(F.col("name").alias("of"), "start", "n", "tree")
    nodes = ranked.join(of, F.col("name").eqNullSafe(F.col("of"))).select(
        "tree", (F.col("g") - F.col("start")).alias("i"), "n", "digest", F.col("doc_id").cast("string").alias("doc_id"), "changed"
    )
    size = trees.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("trees")).first()
    logs, roots = _built(settle(nodes), size["most"] or 0, levels)
    none = {"doc_id": F.lit(None).cast("string"), "changed": F.lit(None).cast("binary")}
    subroots = settle(roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(size["trees"]).cast("long").alias("n"), "digest").withColumns(none))
    top_logs, root = _built(subroots, size["trees"], levels)
    empty = F.array().cast("array<string>")
    start = root.select("tree", F.lit(size["trees"]).cast("long").alias("n"), empty.alias("before"), empty.alias("after"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    tops = settle(_paths(top_logs, start, whole, False, levels))
    starts = settle(tops.select(F.col("run").alias("tree"), "before", "after", "subroot", "root").join(trees.select("tree", "n"), "tree"))
    found = _paths(logs, starts, whole, True, levels)
    out = found.withColumns({"doc_id": F.col("doc_id").cast(id_type), "verified": F.col("folded_root") == F.col("root")})
    return out if whole else out.drop("proof")
