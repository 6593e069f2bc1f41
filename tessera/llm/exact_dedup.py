"""Exact dedup over an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z. A text's hash is its
SHA-256; the leading bits address the index. The directory starts with as many
buckets as the different texts fill and doubles, one bit at a time, while
buckets hold more than their capacity; only those split (a bucket of one hash
can't and chains instead). All counting is done by the cluster; the driver
knows totals only, and what is joined to the rows are the few first buckets
that split. Buckets are contiguous key ranges, dealt to tasks in their order;
the task that owns a range gets, sorted by key, at
most one row for each text and COMBINED bytes of texts (copies are counted
before the shuffle), chains rows of equal key, compares their bytes, and writes
one index entry for each different text. A hot text so costs its owner few rows a task,
never one a copy, and one entry in memory.

Defined results: null text counts as empty; null doc_ids take part and lose to
any other; of rows that repeat both doc_id and text exactly one is kept; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from math import ceil, log2

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import batch, byte_list, hinted, stored, texts, tidied, work

#: Distinct texts, and bytes of them, in a bucket before it splits.
BUCKET_TEXTS, BUCKET_BYTES = 50_000, 64 << 20
#: Bytes of different texts whose copies a task counts before it sends them on, and what an entry takes beside its text.
COMBINED, ENTRY_BYTES = 8 << 20, 200
#: Bits of a key that address buckets, and how often a first bucket can split.
KEY, DEEPER = 60, 8

DIGESTS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("text_key", pa.int64()), ("sha", pa.binary()), ("n_bytes", pa.int64())])
ENTRIES = pa.schema([("sha", pa.binary()), ("n", pa.int64()), ("keep_id", pa.int64()), ("n_keep", pa.int64()), ("body", pa.binary())])
INDEX = pa.schema([("bucket", pa.int64()), ("chain", pa.int32()), ("sha", pa.binary()), ("n", pa.int64()), ("keep_id", pa.int64()), ("n_keep", pa.int64()), ("body", pa.binary())])
DDL = {"digests": "doc_id long, row long, text_key long, sha binary, n_bytes long", "entries": "sha binary, n long, keep_id long, n_keep long, body binary", "index": "bucket long, chain int, sha binary, n long, keep_id long, n_keep long, body binary"}


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text_key, sha, n_bytes) of every row; row numbers rows, text_key hashes the text as it is."""

    def run(batches):
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for b in batches:
            bodies = [x.lower() for x in byte_list(b.column(1))]
            yield batch(DIGESTS, b.column(0), range(at, at + len(bodies)), b.column(2), [hashlib.sha256(x).digest() for x in bodies], [len(x) for x in bodies])
            at += len(bodies)

    return texts(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(tidied(run), DDL["digests"])


def key_of(sha: str) -> Column:
    """The leading KEY bits of a SHA-256 (binary column) as a long."""
    return F.conv(F.substring(F.hex(sha), 1, KEY // 4), 16, 10).cast("long")


def first_depth(keys: DataFrame, capacity: tuple[int, int], owners: int) -> int:
    """Bits of the first directory: as many buckets as all texts would fill, and enough for the owners at hand."""
    n, size = keys.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    return min(KEY - DEEPER, ceil(log2(max(1, n / capacity[0], size / capacity[1], owners))))


def splits(keys: DataFrame, depth: int, capacity: tuple[int, int] = (BUCKET_TEXTS, BUCKET_BYTES)) -> DataFrame:
    """(first, leaves): the leaves, as first keys in order, of each bucket of the first directory that splits. keys: (sha, n_bytes) distinct."""
    fine = keys.groupBy(F.shiftrightunsigned(key_of("sha"), KEY - depth - DEEPER).alias("p")).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"))
    fine = stored(fine, "dedup-counts")
    over = (F.col("n") > 1) & ((F.col("n") > capacity[0]) | (F.col("size") > capacity[1]))
    done, open_ = None, fine
    for d in range(depth, depth + DEEPER + 1):  # the directory doubles with each bit
        at = F.shiftrightunsigned("p", depth + DEEPER - d)
        bucket = open_.groupBy(at.alias("b")).agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
        full = stored(bucket.where(over).select(F.col("b").alias("full")), "dedup-full")
        last = d == depth + DEEPER or full.isEmpty()
        if d > depth:
            leaf = (bucket if last else bucket.where(~over)).select(F.shiftrightunsigned("b", d - depth).alias("first"), F.shiftleft("b", KEY - d).alias("start"))
            done = leaf if done is None else done.unionByName(leaf)
        if last:
            break
        open_ = open_.join(hinted(full), at == F.col("full"), "left_semi")
    if done is None:
        return keys.sparkSession.createDataFrame([], "first long, leaves array<bigint>")
    return stored(done.groupBy("first").agg(F.array_sort(F.collect_list("start")).alias("leaves")), "dedup-splits")


def bucketed(entries: DataFrame, split: DataFrame, depth: int) -> DataFrame:
    """entries with bucket, the first key of the leaf they belong to, and owner."""
    first = F.shiftrightunsigned("key", KEY - depth)
    leaf = F.element_at(F.filter("leaves", lambda s: s <= F.col("key")), -1)
    # a leaf without keys of its own was never counted: what lies before the first counted one goes with the bucket's start
    found = entries.withColumn("key", key_of("sha")).join(hinted(split), first == F.col("first"), "left")
    return found.withColumn("bucket", F.coalesce(F.when(F.exists("leaves", lambda s: s <= F.col("key")), leaf), F.shiftleft(first, KEY - depth))).withColumn("owner", first.cast("int")).drop("key", "first", "leaves")


def index(docs: DataFrame, digest: DataFrame, capacity: tuple[int, int] = (BUCKET_TEXTS, BUCKET_BYTES)) -> DataFrame:
    """One entry for each different text, written to shared files by the owners of key ranges."""
    keys = digest.groupBy("sha").agg(F.max("n_bytes").alias("n_bytes"))
    depth = first_depth(keys, capacity, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    split = splits(keys, depth, capacity)

    def combine(batches):
        found: dict[bytes, list] = {}
        size = 0

        def flush():
            return batch(ENTRIES, [hashlib.sha256(x).digest() for x in found], *([e[k] for e in found.values()] for k in range(3)), list(found))

        for b in batches:
            for doc_id, body in zip(b.column(0).to_pylist(), byte_list(b.column(1)), strict=True):
                body = body.lower()
                e = found.get(body)
                if e is None:
                    e = found[body] = [0, None, 0]
                    size += len(body) + ENTRY_BYTES
                e[0] += 1
                if doc_id is not None and (e[1] is None or doc_id > e[1]):
                    e[1:] = [doc_id, 1]
                elif doc_id == e[1]:
                    e[2] += 1
            if size >= COMBINED:
                yield flush()
                found, size = {}, 0
        if found:
            yield flush()

    def own(batches):
        key, chain, out = None, [], []

        def close():
            out.extend((key[0], k, key[1], *e) for k, e in enumerate(chain))

        for b in batches:
            for bucket, sha, n, keep, n_keep, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (bucket, sha) != key:
                    close()
                    key, chain = (bucket, sha), []
                for e in chain:
                    if e[3] == body:
                        e[0] += n
                        if keep is not None and (e[1] is None or keep > e[1]):
                            e[1:3] = [keep, n_keep]
                        elif keep == e[1]:
                            e[2] += n_keep
                        break
                else:
                    chain.append([n, keep, n_keep, body])
            if out:
                yield batch(INDEX, *zip(*out, strict=True))
                out = []
        close()
        if out:
            yield batch(INDEX, *zip(*out, strict=True))

    entries = bucketed(texts(docs).mapInArrow(tidied(combine), DDL["entries"]), split, depth)
    owned = entries.repartitionById(1 << depth, "owner").sortWithinPartitions("bucket", "sha").select("bucket", *ENTRIES.names)
    return stored(owned.mapInArrow(tidied(own), DDL["index"]), "dedup-index")


def exact_groups(docs: DataFrame, capacity: tuple[int, int] = (BUCKET_TEXTS, BUCKET_BYTES)) -> DataFrame:
    """Per row: doc_id, text_key, keep_id, group_size, kept, text_sha256."""
    with work(docs.sparkSession) as keep:
        return keep(_groups(docs, capacity), "dedup-groups")


def _groups(docs: DataFrame, capacity: tuple[int, int]) -> DataFrame:
    digest = stored(digests(docs), "dedup-digests")
    entries = index(docs, digest, capacity).drop("body")
    if not entries.where("chain > 0").isEmpty():
        raise ValueError("different texts of one SHA-256: their rows cannot be told apart by hash")
    found = digest.join(entries, "sha")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if not entries.where("n_keep > 1 OR (keep_id IS NULL AND n > 1)").isEmpty():  # rows that repeat doc_id and text: the first stays
        first = digest.groupBy("sha", "doc_id").agg(F.min("row").alias("first_row"))
        found = found.join(first.withColumnsRenamed({"sha": "sha2", "doc_id": "doc_id2"}), F.col("sha").eqNullSafe(F.col("sha2")) & F.col("doc_id").eqNullSafe(F.col("doc_id2")))
        kept &= F.col("row") == F.col("first_row")
    return found.select("doc_id", "text_key", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that stay."""
    groups = exact_groups(docs).where("group_size > 1").select("doc_id", "text_key", "kept")
    return without(docs, groups.where("NOT kept"), groups.where("kept"))


def without(docs: DataFrame, dropped: DataFrame, kept: DataFrame) -> DataFrame:
    """docs without the rows of dropped (doc_id, text_key); a row equal to one of kept stays once. text_key is a text's xxhash64, or its
    SHA-256 where it is binary. Columns of docs may have any names."""
    taken = {c.lower() for c in docs.columns}
    fresh = lambda n: next(x for k in range(len(taken) + 1) if (x := f"{n}{k}") not in taken)
    id_, key, no = fresh("dropped_id"), fresh("dropped_key"), fresh("row_no")
    text = F.coalesce(docs["text"], F.lit(""))
    mine = F.unhex(F.sha2(text, 256)) if dict(dropped.dtypes)["text_key"] == "binary" else F.xxhash64(text)
    d = hinted(stored(dropped.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct(), "dropped"))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (mine == F.col(key))
    rest = docs.join(d, on, "left_anti")
    k = kept.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    twice = stored(k.join(d.withColumnsRenamed({id_: "d", key: "k"}), F.col(id_).eqNullSafe(F.col("d")) & (F.col(key) == F.col("k")), "left_semi"), "kept-once")
    if twice.isEmpty():
        return rest
    once = docs.join(hinted(twice), on, "left_semi")
    once = once.withColumn(no, F.row_number().over(Window.partitionBy("doc_id", F.coalesce(F.col("text"), F.lit(""))).orderBy(F.lit(1)))).where(f"{no} = 1").drop(no)
    return rest.unionByName(once)
