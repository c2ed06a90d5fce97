"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least 16 token characters.  Its features are length, character transitions, how much of it the corpus'
own short words cover, the path of the record, and the words around it.  The forest learns from labelled findings; where none are
given, findings of which the form says enough are labelled by rule (``rule_label``) and the forest decides the others too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.words import kept_row, words
from wayfare.session import settle

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}={0,2}(?![A-Za-z0-9])")
BEFORE = re.compile(r"([A-Za-z_\-]+)[\"']?\s*([:=]?)\s*[\"']?\Z")
NAMES = re.compile(r"token|secret|passw|pwd|credential|api_?key|access_?key|private|auth|bearer", re.I)
KNOWN = re.compile(r"(AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9\-]{10,}|[rs]k_(live|test)_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_\-]{20,}")
VOWELS = frozenset("aeiouAEIOU")
# Words of these lengths make the dictionary; each is at least this share of all of them, which bounds its size.
SHORT, LONG, LEAST_SHARE = 2, 5, 2e-5
TRAIN_ROWS = 20_000
TREES, DEPTH = 20, 6
THRESHOLD = 0.5
MASK = "<SECRET>"

FEATURES = (
    "length", "upper", "lower", "digit", "other", "changes", "vowel_changes", "entropy", "hexadecimal", "coverage",
    "path_depth", "path_test", "name_before", "assigned", "quoted", "upper_around",
)
FINDING = (
    "start long, end long, " + ", ".join(f"{f} double" for f in FEATURES) + ", rule int, digest string"
)


def dictionary(docs: DataFrame) -> DataFrame:
    """word: short letter words of all texts, at least ``LEAST_SHARE`` of them each, so at most 1 / LEAST_SHARE rows."""
    short = F.filter(words(F.lower(docs["text"])), lambda w: F.length(w).between(SHORT, LONG))
    counts = docs.select(F.explode(short).alias("word")).where(F.col("word").rlike("^[a-z]+$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = settle(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= LEAST_SHARE * total).select("word")


def coverage(text: str, known: frozenset[str]) -> float:
    """Share of the characters that lie in a longest-first chain of dictionary words."""
    low, i, covered = text.lower(), 0, 0
    while i < len(low):
        for n in range(LONG, SHORT - 1, -1):
            if low[i : i + n] in known and len(low) - i >= n:
                covered += n
                i += n
                break
        else:
            i += 1
    return covered / max(1, len(low))


def rule_label(found: str, named: bool, assigned: bool) -> int:
    """1 and 0 where the form of a finding says enough, else -1: known formats and assigned credentials with letters and digits; plain words and numbers."""
    digits, letters = any(map(str.isdigit, found)), any(map(str.isalpha, found))
    if KNOWN.fullmatch(found) or (named and assigned and digits and letters):
        return 1
    if not (digits and letters) and not (named and assigned):
        return 0
    return -1


def describe(found: str, before: str, after: str, path: str, known: frozenset[str]) -> list[float]:
    kinds = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" for c in found]
    n = len(found)
    count = Counter(kinds)
    pairs = n - 1
    chars = Counter(found)
    m = BEFORE.search(before)
    path = path or ""
    return [
        float(n), *(count[k] / n for k in "uldo"),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / pairs,
        sum((a in VOWELS) != (b in VOWELS) for a, b in zip(found, found[1:], strict=False)) / pairs,
        -sum(c / n * math.log2(c / n) for c in chars.values()),
        sum(c in "0123456789abcdefABCDEF" for c in found) / n,
        coverage(found, known),
        float(path.count("/")), float(bool(re.search(r"test|example|sample|mock", path, re.I))),
        float(bool(m and NAMES.search(m[1]))), float(bool(m and m[2])), float(before[-1:] in ("'", '"') and before[-1:] != ""),
        sum(c.isupper() for c in before[-20:] + after[:20]) / 40,
    ]


def findings_in(text: str, path: str, known: frozenset[str]) -> Iterator[tuple[int, int, list[float], int, str]]:
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        before, after = text[max(0, start - 40) : start], text[end : end + 20]
        row = describe(m[0], before, after, path, known)
        yield start, end, row, rule_label(m[0], row[12] > 0, row[13] > 0), m[0]


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["source"], docs["text"])


def findings(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, key (tells rows of one id apart by content) and every candidate with its features, rule label and sha256."""
    import hashlib

    # At most 1 / LEAST_SHARE short words.
    short = docs.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in known.collect()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, key, path, text in zip(frame["doc_id"], frame["key"], frame["source"], frame["text"], strict=True):
                for start, end, row, rule, found in findings_in(text or "", path, short.value):
                    rows.append((doc_id, key, start, end, *row, rule, hashlib.sha256(found.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "key", "start", "end", *FEATURES, "rule", "digest"])

    kind = dict(docs.dtypes)["doc_id"]
    text = docs.select("doc_id", row_key(docs).alias("key"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return text.mapInPandas(run, f"doc_id {kind}, key long, {FINDING}")


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(found)


def forest(labelled: DataFrame, *, rows: int = TRAIN_ROWS, label: str = "rule") -> RandomForestClassificationModel | None:
    """Random forest from labelled findings (features and a 0/1 label); about ``rows`` of each label at most, chosen by hash.

    None unless both labels are there.
    """
    sizes = {r[label]: r["n"] for r in labelled.where(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return None
    mark = F.pmod(F.xxhash64("digest", "doc_id", "start"), F.lit(1_000_000)) / 1_000_000
    chance = F.when(F.col(label) == 1, rows / sizes[1]).otherwise(rows / sizes[0])
    sample = settle(labelled.where((F.col(label) >= 0) & (mark < chance)).withColumn("label", F.col(label).cast("double")))
    return RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=42).fit(_vectors(sample))


def scanned(docs: DataFrame, labelled: DataFrame | None = None, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate of ``docs``: doc_id, key, start and end (code points), digest, probability, secret.

    Null and empty texts have no candidates; repeated rows repeat their findings; a table without both kinds of labelled findings
    falls back to the rule (known formats and assigned credentials are secrets, anything else is not).
    """
    found = settle(findings(docs, dictionary(docs)))
    model = forest(found if labelled is None else labelled)
    if model is None:
        scores = found.withColumn("probability", (F.col("rule") == 1).cast("double"))
    else:
        scores = model.transform(_vectors(found)).withColumn("probability", vector_to_array("probability")[1])
    return scores.select("doc_id", "key", "start", "end", "digest", "rule", "probability", (F.col("probability") >= threshold).alias("secret"))


def redacted(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret replaced by a mask, all columns kept; ``n_chars`` follows the text."""
    secrets = scanned(docs, labelled).where("secret").groupBy(F.col("doc_id").alias("s_id"), F.col("key").alias("s_key"))
    spans = secrets.agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    rows = kept_row(docs, id__=docs["doc_id"], key__=row_key(docs))
    # The findings grow with the corpus: texts move by key, at any size.
    joined = rows.join(spans.hint("merge"), (F.col("key__") == F.col("s_key")) & F.col("id__").eqNullSafe(F.col("s_id")), "left")
    text = F.col("row.text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        kept = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.struct(s["end"].alias("at"), F.concat(a["out"], kept, F.lit(MASK)).alias("out"))

    cut = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    done = joined.select("row", F.when(F.col("spans").isNull(), text).otherwise(cut).alias("new"))
    new = {"text": F.col("new"), "n_chars": F.length("new").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
