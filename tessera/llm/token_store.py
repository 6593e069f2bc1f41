"""Token ids as raw binary shards with a minimal perfect hash index.

Documents are encoded once, dealt out by ranges of their key, and each range's
owner writes one shard file in ascending key order, as its rows come:

    magic, version, id width | payload: raw ids | index | footer with counts

Ranges hold about SHARD_BYTES of text, found from keys and lengths that the
cluster sorts; there are at most about MOST_SHARDS, larger ones for larger
inputs, so the shards' first keys and places, all that the driver holds and
tasks are sent, have a fixed bound.

The index is a minimal perfect hash (levels of bit arrays, rank by popcount):
it maps a key to its slot, where a 32-bit fingerprint, the offset of its ids
and their number stand. A reader finds the shard by the key's range, the slot
in constant time, rejects strangers by fingerprint and reads just those bytes.
Files are written under a temporary name and renamed, so a task that is run
again leaves one whole file.

Defined results: null text is empty (only the end id is stored); rows that
repeat a key are stored one after another, in order of their ids, and found
together; a null key sorts first and can be looked up; an empty table writes
no shard; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, local_path, scratch, stored, table, texts, tidied, work
from tessera.llm.tokens import encoder

MAGIC, VERSION = b"TSRA", 2
HEAD = struct.Struct("<4sHH")  # magic, version, bytes an id
FOOT = struct.Struct("<QQQQ4s")  # records, ids, place and length of the index, magic
#: Bytes of text in a shard, about, and shards, about, at most.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 1 << 18
NULL_KEY, NULL_ID = b"null", -(1 << 63)
#: Keys whose ids a reader holds at a time.
LOOKED_UP = 500

DOCS = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())])
ASKED = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32())])
MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_ids", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


# ---- files: local paths, else any store that pyarrow opens by URI ----


def store(uri: str):
    import pyarrow.fs as fs

    path = local_path(uri)
    if path is not None:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, chunks) -> None:
    fs, path = store(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        for c in chunks:
            f.write(c)
    fs.move(tmp, path)


# ---- minimal perfect hash ----


def key_bytes(key: int | None) -> bytes:
    return NULL_KEY if key is None else struct.pack("<q", key)


def hashed(keys, seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, seed) for k in keys), np.uint64, len(keys))


class PerfectHash:
    """n distinct keys to 0..n-1: on each level the keys that are alone in their cell are placed; the others go on."""

    GAMMA, LEVELS = 2, 48

    def __init__(self, levels: list[np.ndarray], ranks: np.ndarray):
        self.levels, self.ranks = levels, ranks

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        levels, left = [], list(keys)
        while left and len(levels) < cls.LEVELS:
            m = max(64, -(-cls.GAMMA * len(left) // 64) * 64)
            cell = hashed(left, len(levels)) % np.uint64(m)
            alone = np.bincount(cell.astype(np.int64), minlength=m) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = [k for k, a in zip(left, alone[cell.astype(np.int64)], strict=True) if not a]
        if left:
            raise ValueError("keys are not distinct")
        return cls(levels, np.cumsum([0, *(int(np.unpackbits(x).sum()) for x in levels)]))

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; -1 for keys that meet no set bit."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=False)):
            if not len(open_):
                break
            cell = (hashed([keys[i] for i in open_], level) % np.uint64(len(bits) * 8)).astype(np.int64)
            hit = (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            before = self._before(level)
            out[open_[hit]] = rank + before[cell[hit]]
            open_ = open_[~hit]
        return out

    def _before(self, level: int) -> np.ndarray:
        cache = self.__dict__.setdefault("cache", {})
        if level not in cache:
            ones = np.unpackbits(self.levels[level], bitorder="little")
            cache[level] = np.cumsum(ones, dtype=np.int64) - ones
        return cache[level]

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<I", len(x)) + x.tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> tuple[PerfectHash, int]:
        (n,), at, levels = struct.unpack_from("<I", data), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<I", data, at)
            levels.append(np.frombuffer(data, np.uint8, size, at + 4))
            at += 4 + size
        return cls(levels, np.cumsum([0, *(int(np.unpackbits(x).sum()) for x in levels)])), at


# ---- shards ----

SLOT = np.dtype([("print", "<u4"), ("n_records", "<u4"), ("offset", "<u8"), ("n_ids", "<u8")])


def write_shard(uri: str, records, width: int) -> tuple[int, int]:
    """records: (key or None, payload bytes) in order; equal keys adjoin. Returns the numbers of records and ids."""
    keys, slots, n, at, lengths = [], [], 0, 0, []

    def chunks():
        nonlocal n, at
        yield HEAD.pack(MAGIC, VERSION, width)
        for key, payload in records:
            if not keys or keys[-1] != key:
                keys.append(key)
                slots.append([0, at, 0])
            slots[-1][0] += 1
            slots[-1][2] += len(payload) // width
            lengths.append(len(payload) // width)
            n, at = n + 1, at + len(payload) // width
            yield payload
        raw = [key_bytes(k) for k in keys]
        mph = PerfectHash.build(raw)
        out = np.zeros(len(raw), SLOT)
        out[mph.slots(raw)] = np.array([(p, r, o, c) for p, (r, o, c) in zip((hashed(raw, 1 << 20) & np.uint64(0xFFFFFFFF)).tolist(), slots, strict=True)], SLOT) if raw else out
        index = mph.dump() + out.tobytes() + np.array(lengths, "<u4").tobytes()
        yield index
        yield FOOT.pack(n, at, HEAD.size + at * width, len(index), MAGIC)

    write_whole(uri, chunks())
    return n, at


class Shard:
    """Keyed access to one shard file."""

    def __init__(self, uri: str):
        fs, path = store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, version, self.width = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        self.n_records, self.n_ids, place, length, end = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or end != MAGIC or version != VERSION:
            raise ValueError(f"not a shard: {uri}")
        index = self.file.read_at(length, place)
        self.mph, at = PerfectHash.load(index)
        n_keys = int(self.mph.ranks[-1])
        self.slots = np.frombuffer(index, SLOT, n_keys, at)
        self.lengths = np.frombuffer(index, "<u4", self.n_records, at + n_keys * SLOT.itemsize)
        self.ends = np.cumsum(self.lengths, dtype=np.int64)

    def find(self, keys: list[int | None]) -> list[tuple[int, list[bytes]] | None]:
        """For each key the place of its first id in the shard and the ids of each of its records, as stored; None for strangers."""
        raw, out = [key_bytes(k) for k in keys], []
        prints = (hashed(raw, 1 << 20) & np.uint64(0xFFFFFFFF)).tolist()
        for slot, p in zip(self.mph.slots(raw).tolist(), prints, strict=True):
            s = self.slots[slot] if slot >= 0 else None
            if s is None or int(s["print"]) != p:
                out.append(None)
                continue
            offset, n = int(s["offset"]), int(s["n_ids"])
            data = self.file.read_at(n * self.width, HEAD.size + offset * self.width)
            first = int(np.searchsorted(self.ends, offset, "right"))
            cuts = np.cumsum([0, *self.lengths[first : first + int(s["n_records"])].tolist()]) * self.width
            out.append((offset, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]))
        return out

    def u32(self, data: bytes) -> bytes:
        return np.frombuffer(data, f"<u{self.width}").astype("<u4").tobytes()


def bounds(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """First keys of the shards after the first: the cluster sorts keys and adds up lengths; rows of a key stay together."""
    spark = rows.sparkSession
    keys = stored(rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size")), "token-keys")  # texts are read for it once
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    limit = max(shard_bytes, -(-total // MOST_SHARDS))
    if total <= limit:
        return []
    schema = pa.schema([("first", pa.int64())])

    def cut(batches):
        size, before, began = 0, None, False
        for b in batches:
            out = []
            for key, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != before and key is not None and (size >= limit or not began):  # each task's keys begin a shard
                    out.append(key)
                    size = 0
                began, before, size = True, key, size + n
            if out:
                yield batch(schema, out)

    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, total // limit))
    firsts = keys.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first()).mapInArrow(tidied(cut), "first long")
    return sorted(r[0] for r in firsts.collect())[1:]  # at most MOST_SHARDS and one a task


def in_shard(cuts: np.ndarray, keys: pa.Array) -> np.ndarray:
    """The numbers of the shards that keys belong to; null keys go to the first."""
    k = keys.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    return np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, k, "right")).astype(np.int32)


def shard_path(directory: str, shard: int) -> str:
    return f"{directory}/shard-{shard:08d}.tok"


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, directory: str, width: int = 4, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, list[int]]:
    """Encode docs, write the shards below directory; the manifest (shard, path, n_records, n_ids, base) and the shards' first keys.

    width: bytes an id (2 where the vocabulary has at most 65,536 ids).
    """
    spark, rows = docs.sparkSession, texts(docs)
    cuts = bounds(rows, shard_bytes)
    sent = spark.sparkContext.broadcast(np.array(cuts, np.int64))
    end = np.array([end_id], f"<u{width}").tobytes()

    def encode(batches):
        for b in batches:
            ids = encoder(vocabulary).encode(b.column(1).to_pylist())
            yield batch(DOCS, b.column(0), in_shard(sent.value, b.column(0)), [(x if width == 4 else np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes()) + end for x in ids])

    def write(batches):
        def records():
            for b in batches:
                yield from zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)

        stream, ahead = records(), None
        ahead = next(stream, None)
        while ahead is not None:
            shard = ahead[0]

            def own(shard=shard):
                nonlocal ahead
                while ahead is not None and ahead[0] == shard:
                    yield ahead[1], ahead[2]
                    ahead = next(stream, None)

            path = shard_path(directory, shard)
            n, ids = write_shard(path, own(), width)
            yield batch(MANIFEST, [shard], [path], [n], [ids])

    coded = rows.mapInArrow(tidied(encode), "doc_id long, shard int, payload binary")
    dealt = coded.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "payload")
    manifest = stored(dealt.mapInArrow(tidied(write), "shard int, path string, n_records long, n_ids long"), "token-manifest")
    base, rows_ = 0, []
    for r in sorted(manifest.collect()):  # one row a shard
        rows_.append((*r, base))
        base += r["n_ids"]
    return spark.createDataFrame(rows_, "shard int, path string, n_records long, n_ids long, base long"), cuts


def read_tokens(keys: DataFrame, manifest: DataFrame, cuts: list[int]) -> DataFrame:
    """Look up every key (doc_id, distinct) in the files: doc_id, shard, start, n_tokens, ids_crc32, a row for each record."""
    context = keys.sparkSession.sparkContext
    bases, directory = np.full(len(cuts) + 1, -1, np.int64), ""
    for r in manifest.collect():  # one row a shard
        bases[r["shard"]], directory = r["base"], os.path.dirname(r["path"])
    sent = context.broadcast((np.array(cuts, np.int64), bases))

    def run(batches):
        shard, no, bases = None, None, sent.value[1]
        for b in batches:
            ids, shards, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            at = 0
            while at < len(ids):
                end = bisect_right(shards, shards[at], at)
                if shards[at] != no:
                    no = shards[at]
                    shard = Shard(shard_path(directory, no)) if bases[no] >= 0 else None
                for a in range(at, end, LOOKED_UP):
                    asked = ids[a : min(a + LOOKED_UP, end)]
                    for key, got in zip(asked, shard.find(asked) if shard else [None] * len(asked), strict=True):
                        if got is None:
                            raise ValueError(f"key {key} is not in shard {no}")
                        place = int(bases[no]) + got[0]
                        for data in got[1]:
                            out.append((key, no, place, len(data) // shard.width, zlib.crc32(shard.u32(data))))
                            place += len(data) // shard.width
                at = end
            if out:
                yield batch(FOUND, *zip(*out, strict=True))

    def assign(batches):
        for b in batches:
            yield batch(ASKED, b.column(0), in_shard(sent.value[0], b.column(0)))

    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(tidied(assign), "doc_id long, shard int")
    return asked.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "doc_id").mapInArrow(tidied(run), "doc_id long, shard long, start long, n_tokens long, ids_crc32 long")


def op9(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    with work(spark) as keep:
        manifest, cuts = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2, scratch(spark, "tokens"), width=2)
        return keep(read_tokens(docs.select("doc_id"), manifest, cuts).select("doc_id", "start", "n_tokens", "ids_crc32"), "tokens-read")
