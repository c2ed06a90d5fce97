"""Registered queries of the operators: the result columns asked for, derived from each operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import (
    byte_pairs,
    fingerprints,
    merkle,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    secrets,
    sharding,
    simhash,
    spelling,
    suffix_dedup,
    wrappers,
)
from wayfare.llm.oracles import MERKLE, MIXING, QUALITY_RULES, SPELLING
from wayfare.session import ship_package

Plan = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    """Place of a public tokenizer's file; the package that tells it is installed on every worker."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), tokenizer_path())


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.grouped(simhash.fingerprinted(table(spark, folder, "documents").select("doc_id", "text")))
    return rows.select("doc_id", simhash.written(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    groups = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = fingerprints.with_next(docs, groups).withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
    pairs = pairs.select("doc_id", "text", "sketch", "next_sketch", F.struct("edited", fingerprints.sketch(F.col("edited")).alias("sketch")).alias("e"))
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("e.edited", "utf-8"), 256).alias("edited_sha256"),
        fingerprints.written(F.col("sketch")).alias("fingerprint"),
        fingerprints.written(F.col("e.sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("e.sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprints.distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )


def op4_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    rows = wrappers.extracted(table(spark, folder, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_classifier.learned(docs, table(spark, folder, "labels"))
    rows = quality_classifier.scored(docs, model)
    doc_id = F.col("row.doc_id")
    return rows.select(
        doc_id.alias("doc_id"), quality_classifier.held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.deduplicated(table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return rows.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # What stays, to be read; a character that was cut through is replaced.
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.sharded(table(spark, folder, "documents"), 16)
    return rows.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scanned(table(spark, folder, "documents")).select("doc_id", "start", "end", "digest", "probability", "secret")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_rules.quality_verdicts(table(spark, folder, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(F.col("row.doc_id").alias("doc_id"), *counts, "base_failed", "kept", "removed_words")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mixed(table(spark, folder, "documents"))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken")
    )


def op11_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path, pattern = tokenizer_path(BYTE_RANKS), public_tokenizers.PATTERN
    rows = byte_pairs.encoded(table(spark, folder, "documents").select("doc_id", "text"), path, pattern)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("back", 256).alias("decoded_sha256"),
    )


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tampered = F.translate("text", merkle.UPPER, merkle.LOWER)
    fifth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(
        docs, ["doc_id", "source", "lang", "n_chars", "text"], tree="source", key="doc_id", changed={"text": tampered}, if_changed=fifth
    )


QUERIES: dict[str, Plan] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_simhash,
        op3_fingerprints,
        op4_wrappers,
        op5_quality_classifier,
        op6_suffix_dedup,
        op7_sharding,
        op8_secrets,
        op9_quality_rules,
        op10_mixing,
        op11_byte_pairs,
        op12_spelling,
        op13_merkle,
    )
}

ORACLES: dict[str, str] = {"op9_quality_rules": QUALITY_RULES, "op10_mixing": MIXING, "op12_spelling": SPELLING, "op13_merkle": MERKLE}
