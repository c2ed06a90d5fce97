"""Quality rules: cross-document line frequency.

Normalised lines are hashed, distinct documents are counted per (host, line), lines above the limits
are removed, and a document that loses most of its words is rejected.

Copies of one text must not make its lines look like boilerplate, so documents with equal texts count once.  A line is
boilerplate if at least ``min_contexts`` different texts of its host carry it, however many other documents do.

Only DataFrame functions; no row of text is shuffled for the verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.words import BLANKS, GAP, kept_row, let, n_words, words
from wayfare.session import settle


@dataclass(frozen=True)
class LineLimits:
    """A line is removed when ``min_contexts`` different texts carry it; a document is depleted when fewer than
    ``min_left`` words stay or more than ``max_removed`` of its words went."""

    min_contexts: int = 20
    min_left: int = 20
    max_removed: float = 0.7


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, one blank between words."""
    return F.regexp_replace(F.lower(F.btrim(F.regexp_replace(line, GAP, " "), F.lit(" "))), "[0-9]", "0")


def _lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def repeat_words(w: Column) -> Column:
    """Words inside three-word windows that are found twice or more.

    Windows are sorted as numbers: a hash above, the position in the low bits (as many as the
    word count needs).  Neighbours with equal hashes are compared word by word.
    """

    def covered(s: Column) -> Column:
        bits = F.length(F.bin(F.size(w)))
        at = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")

        def same(x: Column, y: Column) -> Column:
            hashes = F.call_function("shiftrightunsigned", x.bitwiseXOR(y), bits) == 0
            equal = [F.get(w, at(x) + k) == F.get(w, at(y) + k) for k in range(3)]
            return F.coalesce(hashes & equal[0] & equal[1] & equal[2], F.lit(False))

        twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        places = F.array_sort(F.transform(twice, at))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def packed(i: Column) -> Column:
        bits = F.length(F.bin(F.size(w)))
        window = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return F.coalesce(F.call_function("shiftleft", window, bits).bitwiseOR(i.cast("long")), F.lit(0).cast("long"))

    ordered = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), packed))
    return F.when(F.size(w) >= 3, let(ordered, covered)).otherwise(F.lit(0)).cast("long")


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text (null: all 0)."""
    text = F.coalesce(text, F.lit(""))
    lines = let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            lines.alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def document_key(docs: DataFrame) -> list[Column]:
    """Tells rows apart by content: rows equal in it have the same verdict, so repeated rows are safe."""
    return [docs["doc_id"].alias("key_id"), F.xxhash64(docs["source"], docs["text"]).alias("key_text")]


def _document_lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: its hash, its words and its place."""
    entry = lambda x: F.struct(normal_line(x).alias("line"))
    hashed = lambda e: F.struct(
        F.xxhash64(e["line"]).alias("line"), F.size(F.split(e["line"], " ")).cast("long").alias("words")
    )
    lines = F.transform(F.transform(_lines(docs["text"]), entry), hashed)
    rows = docs.select(*document_key(docs), docs["source"].alias("host"), F.posexplode(lines).alias("place", "e"))
    return rows.select("key_id", "key_text", "host", "place", F.col("e.line").alias("line"), F.col("e.words").alias("words"))


def frequent_lines(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """host, line (hash), n_contexts (different texts that carry it) of the lines above the limit.

    Counts start with the texts of a line, so a line that a third of all documents carry is spread over
    many tasks and arrives in the last one as one number per task.  A null host is a host.
    """
    once = _document_lines(docs).groupBy("host", "line", "key_text").agg(F.count(F.lit(1)).alias("n"))
    counted = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_contexts"))
    return counted.where(F.col("n_contexts") >= limits.min_contexts)


def line_losses(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """key_id, key_text, removed_words, removed_lines (hashes) of the documents that carry frequent lines."""
    frequent = settle(frequent_lines(docs, limits)).select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    found = _document_lines(docs).join(frequent, (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host")))
    # Rows repeated in full carry the same lines at the same places: each place counts once.
    found = found.groupBy("key_id", "key_text", "place", "line", "words").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("key_id", "key_text").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))


def _joined(rows: DataFrame, losses: DataFrame) -> DataFrame:
    losses = losses.withColumnRenamed("key_id", "l_id").withColumnRenamed("key_text", "l_text")
    return rows.join(losses, (F.col("key_text") == F.col("l_text")) & F.col("key_id").eqNullSafe(F.col("l_id")), "left")


def quality_verdicts(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """Per row of ``docs``: ``row`` (all its columns), the base counts, ``base_failed``, ``removed_words``,
    ``removed_lines`` and ``kept``.

    Null and blank texts have no words, fail the base rules and are not kept.  Repeated rows get the
    same verdict each; an empty table gives no rows; other columns stay inside ``row``.
    Repeated rows (same id, source and text) count once as carriers of a line.
    """
    key = document_key(docs)
    counts = base_counts(docs["text"])
    # One generated row each: a later filter on the counts then cannot repeat them below the join.
    rows = kept_row(docs, key_id=key[0], key_text=key[1], c=F.explode(F.array(counts)))
    found = _joined(rows, line_losses(docs, limits))
    n, repeated = F.col("c.n_words"), F.col("c.n_repeat_words")
    removed = F.least(F.coalesce("removed_words", F.lit(0)), n)
    failed = (n < 50) | (100 * repeated > 50 * n)
    depleted = (removed > 0) & ((n - removed < limits.min_left) | (removed > limits.max_removed * n))
    return found.select(
        "row",
        "c.*",
        failed.alias("base_failed"),
        removed.alias("removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
        (~failed & ~depleted).alias("kept"),
    )


def without_frequent_lines(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; frequent lines are cut out of ``text`` and ``n_chars`` follows.

    The text of a row that carries no frequent line stays as it is, character by character.
    """
    kept = quality_verdicts(docs, limits).where("kept")
    stays = lambda x: ~F.array_contains("removed_lines", F.xxhash64(normal_line(x)))
    cut = F.array_join(F.filter(F.split(F.col("row.text"), "\n"), stays), "\n")
    text = F.when(F.size("removed_lines") > 0, cut).otherwise(F.col("row.text"))
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return kept.select("row", text.alias("new_text")).select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
