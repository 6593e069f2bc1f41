"""Benchmark decontamination by a broadcast hash set of n-grams, in DataFrame functions only.

Texts and benchmark items become words; every window of N consecutive item
words (a shorter item is one window) goes into a hash set that is broadcast.
One scan over the texts hashes each window of words, probes the set, and
verifies each hit word by word. Hits, few against the input, are gathered for
each document.

The set is broadcast in blocks of at most GRAMS windows, one scan of the texts
for each block, so that what is broadcast has a fixed bound.

Defined results: null and empty texts have no words and no hits; items without
words have no windows; rows that repeat each give a row; an empty benchmark
hits nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, stored, table, texts, work

#: Words in a window; windows broadcast at a time.
N, GRAMS = 10, 500_000
# What stands between words, before and after lower-casing.
GAPS, GAPS_LOW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), GAPS_LOW), "")


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, GAPS), ""))


def grams(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(gram, gram_words, items): each different window with the items that have it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.coalesce(F.col("text"), F.lit(""))).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    windows = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("gram_words"))
    return windows.groupBy("gram_words").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("gram", F.xxhash64("gram_words"))


def hits(rows: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """(row_key, hit_id, spans, items) of the documents with hits: spans of (first word, words), items that occur."""
    known = stored(grams(benchmark, n), "grams")
    sizes = sorted(r[0] for r in known.select(F.size("gram_words")).distinct().collect())  # at most n values
    blocks = max(1, -(-known.count() // GRAMS))
    if not sizes:
        sizes = [n]
    split = rows.select("row_key", F.col("doc_id").alias("hit_id"), words(F.col("text")).alias("w"))
    places = split.select("row_key", "hit_id", "w", F.posexplode_outer("w").alias("at", "word"))
    if sizes == [n]:
        places = places.withColumn("size", F.lit(n))
    else:
        places = places.select("row_key", "hit_id", "w", "at", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    window = F.slice("w", F.col("at") + 1, F.col("size"))
    probes = places.where(F.col("at") + F.col("size") <= F.size("w")).select("row_key", "hit_id", "w", "at", "size", F.xxhash64(window).alias("probe"))
    out = None
    for b in range(blocks):
        block = known if blocks == 1 else known.where(F.pmod("gram", F.lit(blocks)) == b)
        found = probes.join(F.broadcast(block), (F.col("probe") == F.col("gram")) & (window == F.col("gram_words"))).select("row_key", "hit_id", "at", "size", "items")
        out = found if out is None else out.unionByName(found)
    spans = F.collect_set(F.struct("at", "size")).alias("spans")
    return out.groupBy("row_key", "hit_id").agg(spans, F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per row: doc_id, text_key, n_words, n_hit, n_items, items, spans (first word, words), contaminated."""
    rows = texts(docs).withColumn("row_key", F.xxhash64("text"))
    found = hits(rows, benchmark, n).withColumnRenamed("row_key", "hit_key")
    every = rows.select("doc_id", "row_key", n_words(F.col("text")).cast("long").alias("n_words"))
    joined = every.join(found, (F.col("row_key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))))
    n_hit = F.when(F.col("spans").isNull(), 0).otherwise(covered).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", F.col("row_key").alias("text_key"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), "spans", F.col("spans").isNotNull().alias("contaminated"))


def op10(spark, sf_dir: str) -> DataFrame:
    with work(spark) as keep:
        out = decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
        return keep(out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"), "decontaminated")


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark window go."""
    from tessera.llm.exact_dedup import without

    rows = texts(docs).withColumn("row_key", F.xxhash64("text"))
    with work(spark) as keep:
        gone = keep(hits(rows, table(spark, sf_dir, "benchmark")).select(F.col("hit_id").alias("doc_id"), F.col("row_key").alias("text_key")), "contaminated")
    return without(docs, gone, gone.limit(0))
