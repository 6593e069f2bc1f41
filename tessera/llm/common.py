"""What the operators share: tables in the shared folder, Arrow helpers.

Work that must survive a lost executor is written as Parquet below the folder
in ``spark.checkpoint.dir``; nothing is kept on one machine's disk.
"""

from __future__ import annotations

import ctypes
import sys
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import delete, noted, scratch, stored, table

__all__ = ["BATCH_BYTES", "BROADCAST_ROWS", "WordHash", "ascii_lower", "batch", "byte_list", "give_back", "hinted", "local_path", "pack", "planes", "scratch", "stored", "table", "texts", "tidied", "unpack", "unplanes", "work"]

#: Rows of a broadcast side at most; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch that a Python worker gets; with the lists made of it, it sets what a worker needs.
BATCH_BYTES, BATCH_KEY, BATCH_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def hinted(df: DataFrame) -> DataFrame:
    """df, which must be stored, with a broadcast hint if it has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


@contextmanager
def work(spark: SparkSession):
    """Python workers get Arrow batches of about BATCH_BYTES inside, unless the session has a bound of its own, and what is stored inside
    goes at the end. Yields a function that stores a result so that it stays; what leaves the block must come from it, for plans are lazy."""
    before = spark.conf.get(BATCH_KEY, None)
    if before in (None, f"{BATCH_DEFAULT}b", str(BATCH_DEFAULT)):
        spark.conf.set(BATCH_KEY, f"{BATCH_BYTES}b")
    with noted() as paths:
        kept: list[DataFrame] = []

        def keep(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
            out = stored(df, name, codec)
            kept.append(paths.pop())
            return out

        try:
            yield keep
        finally:
            if before is None:
                spark.conf.unset(BATCH_KEY)
            else:
                spark.conf.set(BATCH_KEY, before)
            for p in paths:
                delete(spark, p)
            paths[:] = kept


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text): null texts become empty; other columns are left behind."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII text takes the fast native path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def byte_list(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column."""
    return (column if pa.types.is_binary(column.type) else column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())).to_pylist()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def planes(values: np.ndarray, n_bytes: int) -> bytes:
    """Little-endian integers as byte planes: sorted or small values then compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:n_bytes].tobytes()


def unplanes(data: bytes, n_bytes: int) -> np.ndarray:
    n = len(data) // n_bytes
    out = np.zeros((n, 8), np.uint8)
    out[:, :n_bytes] = np.frombuffer(data, np.uint8).reshape(n_bytes, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack(values: np.ndarray, n_bytes: int) -> bytes:
    """Byte planes, compressed, after their length."""
    raw = planes(values, n_bytes)
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(data: bytes, n_bytes: int) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return unplanes(pa.decompress(data[8:], n, "zstd", asbytes=True) if n else b"", n_bytes)


def give_back() -> None:
    """Hand memory that is free to the system, which a worker that waits for its next task would keep."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidied(f):
    """f, over batches, that gives free memory back when it is done."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


class WordHash(dict):
    """64-bit hashes of words, computed once per word; emptied when it has LIMIT words."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
