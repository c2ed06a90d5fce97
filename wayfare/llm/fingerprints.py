"""Document fingerprints: a bottom-k sketch of shingle hashes.

The sketch of a text is the sorted array of its ``k`` smallest distinct shingle hashes.  Sketches merge across parts
(the k smallest of their union) and estimate resemblance, containment and the number of distinct
shingles.  Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.words import let, shingles, words

K = 128
WIDTH = 5


def sketch(text: Column, *, k: int = K, width: int = WIDTH) -> Column:
    """Bottom-k sketch of one text; empty for a null or blank text, one hash when it has at most ``width`` words."""
    hashes = lambda w: F.transform(shingles(w, width, lambda *x: F.xxhash64(*x)), lambda h: F.coalesce(h, F.lit(0).cast("long")))
    return F.slice(F.sort_array(F.array_distinct(let(words(text), hashes))), 1, k)


def merge(a: Column, b: Column, *, k: int = K) -> Column:
    """Sketch of the union of what two sketches cover."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_sketches(parts: DataFrame, keys: list[str], column: str, *, k: int = K) -> DataFrame:
    """One sketch per key from many parts: the k smallest distinct hashes.

    Equal hashes meet first, so what a key gathers is distinct; ranks run per (key, salt) before the key's
    own, and no task holds more than the k smallest of each salt.  Null and empty parts add nothing; a key with
    only such parts is absent.
    """
    rows = parts.select(*keys, F.explode(column).alias("h__")).groupBy(*keys, "h__").agg(F.count(F.lit(1)).alias("n__"))
    salted = rows.withColumn("salt__", F.pmod(F.xxhash64("h__"), F.lit(64)))
    first = salted.withColumn("r__", F.row_number().over(Window.partitionBy(*keys, "salt__").orderBy("h__"))).where(F.col("r__") <= k)
    return first.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("h__")), 1, k).alias(column))


def resemblance(a: Column, b: Column, *, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the merged sketch found in both; 1 for two empty sketches."""

    def share(u: Column) -> Column:
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))

    return F.when(a == b, F.lit(1.0)).otherwise(let(merge(a, b, k=k), share))


def distinct_shingles(a: Column, *, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the place of the k-th hash."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, *, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: the intersection over the size of a; 1 for an empty a."""
    both = resemblance(a, b, k=k) * distinct_shingles(merge(a, b, k=k), k=k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k=k)))


def written(a: Column) -> Column:
    """A sketch as text: base64 of its hashes, eight bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def _groups(docs: DataFrame, groups: int) -> Column:
    """Group number of a doc_id in descending order, from approximate quantiles: 0 has the largest ids.

    The bounds are searched in two steps (coarse, then fine), so a row costs about the square root of their number.
    """
    cut = docs.agg(F.percentile_approx("doc_id", [i / groups for i in range(1, groups)], 10 * groups)).first()[0] if groups > 1 else None
    bounds = sorted(set(cut or ()), reverse=True)
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    above = lambda x: x >= F.col("doc_id")
    coarse = F.size(F.filter(F.lit([b[-1] for b in blocks]), above))
    fine = F.coalesce(F.size(F.filter(F.get(F.lit(blocks), coarse), above)), F.lit(0))
    return F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(
        F.when(coarse >= len(blocks), F.lit(len(bounds))).otherwise(coarse * step + fine)
    )


def with_next(docs: DataFrame, groups: int) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: the neighbour in descending doc_id (after the last: the first).

    Texts are shuffled once, to groups of neighbouring ids; the head of each group also goes to the group
    before it, as a row that is dropped afterwards.  Null texts are empty; null ids come last; rows
    that share an id follow each other by text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("g", _groups(docs, groups))
    tie = F.xxhash64("text")
    # The head's place in the order, one row per group: (id or null last, tie).
    place = F.struct(F.col("doc_id").isNull().alias("a"), (-F.col("doc_id")).alias("b"), tie.alias("c"))
    heads = rows.groupBy("g").agg(F.min(place).alias("head"))
    order = heads.select("g", "head").orderBy("g").collect()  # one row per group
    if not order:
        return rows.select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("sketch"), F.col("text").alias("next_text"), F.lit(None).cast("array<bigint>").alias("next_sketch"))
    before = {order[i]["g"]: order[i - 1]["g"] for i in range(len(order))}
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r["g"], r["head"]["b"], r["head"]["c"], before[r["g"]]) for r in order], "hg int, hb long, hc long, to int")
    same = (F.col("g") == F.col("hg")) & (-F.col("doc_id")).eqNullSafe(F.col("hb")) & (F.xxhash64("text") == F.col("hc"))
    # One head per group is enough when rows repeat.
    ghosts = rows.join(F.broadcast(wanted), same).groupBy("to").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    both = rows.select("doc_id", "text", "g", F.lit(False).alias("ghost")).unionByName(
        ghosts.select("doc_id", "text", F.col("to").alias("g"), F.lit(True).alias("ghost"))
    )
    dealt = both.repartition(len(order), "g").withColumn("sketch", sketch(F.col("text")))
    w = Window.partitionBy("g").orderBy("ghost", F.col("doc_id").desc_nulls_last(), tie, "text")
    found = dealt.select("doc_id", "text", "sketch", "ghost", F.lead("text").over(w).alias("next_text"), F.lead("sketch").over(w).alias("next_sketch"))
    return found.where("NOT ghost").drop("ghost")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n / 3) code points replaced by the first as many (or all) of ``following``."""
    n = F.length(text)
    take = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - take), F.substring(following, F.lit(1), take))


def fingerprinted(docs: DataFrame, *, k: int = K, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: doc_id, ``sketch``, its estimated ``n_shingles``.  Null text: the empty sketch."""
    return docs.select("doc_id", sketch(docs["text"], k=k, width=width).alias("sketch")).withColumn("n_shingles", distinct_shingles(F.col("sketch"), k=k))
