"""Pairs of rows with like sets, by tiles of stored sets and not by shuffled pairs.

Python on executors, as in llm: pairs that share words grow with the square of a word's frequency, and the built-in functions can count
them only by a shuffle of them all. Here sets are shuffled once and written once, in chunks of like sizes; a tile reads two chunks and
counts in memory, so what goes to disk follows the sets and the result.
"""

from __future__ import annotations

import pickle
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import delete, noted, scratch, stored

#: Of a chunk: tokens and rows at most, and its largest set over its smallest.
TOKENS, ROWS, WIDE = 2_000_000, 20_000, 1.6
#: Chunks' worth of tokens that one group of rows holds in order of size, about.
CHUNKS = 4
#: What a tile handles in one go: cells of a table of pairs, hits, marks.
CELLS, HITS, MARKS = 2_000_000, 2_000_000, 32_000_000

CHUNK = pa.schema([("chunk", pa.string()), ("g", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])
CHUNK_DDL = "chunk string, g string, lo int, hi int"
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PAIR_DDL = "a long, b long"


def _place(uri: str):
    """File system and path of a file: URI, a plain path or any store that pyarrow opens by URI."""
    import pyarrow.fs as fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1] and so on."""
    end = ends(counts)
    return np.repeat(starts - end[:-1], counts) + np.arange(end[-1])


def slices(counts: np.ndarray, most: int, least: int = 1):
    """(from, to) of consecutive places whose counts sum to at most that, or of the least number of places."""
    end, at = ends(counts), 0
    while at < len(counts):
        to = max(at + least, int(np.searchsorted(end, end[at] + most, "right")) - 1)
        yield at, min(to, len(counts))
        at = to


class Chunk:
    """Different sets, as places in a sorted vocabulary one after the other, and the rows of each: first[i] to first[i + 1]."""

    def __init__(self, vocabulary, tokens, sizes, first, ids, sides):
        self.vocabulary, self.tokens, self.sizes, self.first, self.ids, self.sides = vocabulary, tokens, sizes, first, ids, sides

    @classmethod
    def of(cls, ids: np.ndarray, sides: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, tokens: np.ndarray) -> Chunk:
        """Of rows sorted by size and hash of their sets."""
        end = ends(sizes)
        new = np.ones(len(ids), bool)
        for i in (np.flatnonzero((sizes[1:] == sizes[:-1]) & (hashes[1:] == hashes[:-1])) + 1).tolist():
            new[i] = not np.array_equal(tokens[end[i] : end[i + 1]], tokens[end[i - 1] : end[i]])
        first = np.flatnonzero(new)
        vocabulary, at = np.unique(tokens[runs(end[first], sizes[first])], return_inverse=True)
        return cls(vocabulary, at.astype(np.int32), sizes[first], np.append(first, len(ids)), ids, sides)

    def write(self, uri: str) -> None:
        steps = np.diff(self.tokens, prepend=np.int32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()  # byte planes: small steps compress well
        body = pickle.dumps((self.vocabulary, steps, self.sizes, self.first, self.ids, self.sides), 5)
        fs, path = _place(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path, compression=None) as f:
            f.write(len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True))

    @classmethod
    def read(cls, uri: str) -> Chunk:
        fs, path = _place(uri)
        with fs.open_input_file(path) as f:
            data = f.read()
        vocabulary, steps, *rest = pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))  # a file of our own
        steps = np.frombuffer(steps, np.uint8).reshape(4, -1).T.copy().view(np.int32).reshape(-1)
        return cls(vocabulary, np.cumsum(steps, dtype=np.int32), *rest)


def written(batches, root: str):
    """Of rows (g, part, id, side, n, hash, tokens), sorted by g, part, n and hash, the chunks, written below root."""
    held, now, lo, tokens, rows = [], None, 0, 0, 0

    def flush():
        ids, sides, sizes, hashes, values = (np.concatenate(c) for c in zip(*held, strict=True))
        uri = f"{root}/{uuid.uuid4().hex}"
        Chunk.of(ids, sides, sizes, hashes, values).write(uri)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((uri, now[0], lo, int(sizes[-1])), CHUNK.types, strict=True)], schema=CHUNK)

    for b in batches:
        b = b.filter(pc.greater(b.column(4), 0))  # not in the plan, which would make the sets twice
        sizes = b.column(4).to_numpy()
        columns = [b.column(2).to_numpy(), b.column(3).to_numpy(), sizes, b.column(5).to_numpy()]
        values, end, at = b.column(6).flatten().to_numpy(), ends(sizes), 0
        take = lambda i, j, columns=columns, values=values, end=end: held.append([*(c[i:j].copy() for c in columns), values[end[i] : end[j]].copy()])
        for i, (g, part, n) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), sizes.tolist(), strict=True)):
            if (g, part) != now or tokens + n > TOKENS or rows == ROWS or n > WIDE * lo + 4:
                if i > at:
                    take(at, i)
                if held:
                    yield flush()
                at, now, lo, tokens, rows = i, (g, part), n, 0, 0
            tokens, rows = tokens + n, rows + 1
        if b.num_rows > at:
            take(at, b.num_rows)
    if held:
        yield flush()


class Side:
    """One chunk's sets in a tile: of each the tokens that the other chunk has too, rarest of the tile first, and its prefix.

    For a share of p / q, a set and any of the other chunk must have `least` tokens in common; of these the prefix leaves all but one to the `rest`.
    """

    def __init__(self, c: Chunk, rank: np.ndarray, width: int, other: Chunk, p: int, q: int):
        self.sizes, n = c.sizes.astype(np.int64), len(c.sizes)
        smallest = np.maximum(other.sizes[0], -(-p * self.sizes // q))
        least = -(-p * (self.sizes + smallest) // (p + q))
        near = (smallest <= other.sizes[-1]) & (p * smallest <= q * self.sizes)
        rank = rank[c.tokens]
        owner = np.repeat(np.arange(n), c.sizes)
        shared = np.bincount(owner[rank >= 0], minlength=n)
        kept = (rank >= 0) & (near & (shared >= least))[owner]
        key = owner[kept] * width + rank[kept]
        key.sort()
        owner = owner[kept]
        self.tokens = key - owner * width
        self.shared = np.bincount(owner, minlength=n)
        self.start = ends(self.shared)
        self.rest = least - 1
        self.prefix = np.maximum(0, self.shared - self.rest)
        self.last = np.full(n, -1)
        some = np.flatnonzero(self.prefix)
        self.last[some] = self.tokens[self.start[some] + self.prefix[some] - 1]


def like_sets(a: Chunk, b: Chunk, same: bool, p: int, q: int):
    """Arrays (x, y) of places of sets of a and b whose Jaccard similarity is p / q or more; x < y where a is b."""
    at = np.minimum(np.searchsorted(a.vocabulary, b.vocabulary), len(a.vocabulary) - 1)
    in_b = np.flatnonzero(a.vocabulary[at] == b.vocabulary)
    in_a, width = at[in_b], max(1, len(in_b))
    often = np.bincount(a.tokens, minlength=len(a.vocabulary))[in_a] * np.bincount(b.tokens, minlength=len(b.vocabulary))[in_b]
    rank = np.empty(len(in_b), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(in_b))
    ranks_a, ranks_b = np.full(len(a.vocabulary), -1), np.full(len(b.vocabulary), -1)
    ranks_a[in_a], ranks_b[in_b] = rank, rank
    u = Side(a, ranks_a, width, b, p, q)
    v = u if same else Side(b, ranks_b, width, a, p, q)
    m = len(a.sizes)
    # lists of the sets of a by tokens of their prefixes
    posts = np.sort(u.tokens[runs(u.start[:-1], u.prefix)] * m + np.repeat(np.arange(m), u.prefix))
    token = posts // m
    posts = posts - token * m
    length = np.bincount(token, minlength=width)
    list_start = ends(length)[:-1]
    ask = v.tokens[runs(v.start[:-1], v.prefix)]
    ask_end, hits = ends(v.prefix), length[ask]
    marks = np.zeros(min(MARKS // width + 1, 1024) * width, bool)
    for y0, y1 in slices(np.full(len(b.sizes), m), CELLS):
        i, j = ask_end[y0], ask_end[y1]
        row = np.repeat(np.arange(y1 - y0) * m, v.prefix[y0:y1])
        count = None
        for s, e in slices(hits[i:j], HITS):
            n = hits[i + s : i + e]
            if n.any():
                found = np.bincount(posts[runs(list_start[ask[i + s : i + e]], n)] + np.repeat(row[s:e], n), minlength=(y1 - y0) * m)
                count = found if count is None else count + found
        if count is None:
            continue
        cell = np.flatnonzero(count)
        y, n = cell // m, count[cell]
        x = cell - y * m
        y += y0
        need = -(-p * (u.sizes[x] + v.sizes[y]) // (p + q))
        ok = (n >= need - np.where(u.last[x] <= v.last[y], u.rest[x], v.rest[y])) & (need <= np.minimum(u.shared[x], v.shared[y]))
        if same:
            ok &= x < y
        x, y, need = x[ok], y[ok], need[ok]
        if len(x):
            ok = overlaps(u, v, x, y, width, marks) >= need
            yield x[ok], y[ok]


def overlaps(u: Side, v: Side, x: np.ndarray, y: np.ndarray, width: int, marks: np.ndarray) -> np.ndarray:
    """How many tokens sets x of u and y of v, y sorted, have in common; marks: all False, left so."""
    out = np.zeros(len(x), np.int64)
    of, group = np.unique(y, return_inverse=True)
    some = len(marks) // width
    for a in range(0, len(of), some):
        ys = of[a : a + some]
        marked = v.tokens[runs(v.start[ys], v.shared[ys])] + np.repeat(np.arange(len(ys)) * width, v.shared[ys])
        marks[marked] = True
        i, j = np.searchsorted(group, [a, a + some])
        n = u.shared[x[i:j]]
        for s, e in slices(n, HITS):
            xs = x[i + s : i + e]
            seen = marks[u.tokens[runs(u.start[xs], n[s:e])] + np.repeat((group[i + s : i + e] - a) * width, n[s:e])]
            out[i + s : i + e] = np.add.reduceat(seen, ends(n[s:e])[:-1], dtype=np.int64)
        marks[marked] = False
    return out


def rows_of(a: Chunk, b: Chunk, x: np.ndarray, y: np.ndarray, own: bool):
    """Batches of the rows' pairs of sets x and y: different sides, the smaller id first; own: x are y, of one chunk."""
    n = a.first[x + 1] - a.first[x]
    one, y = runs(a.first[x], n), np.repeat(y, n)
    n = b.first[y + 1] - b.first[y]
    for s, e in slices(n, HITS):
        i, j = np.repeat(one[s:e], n[s:e]), runs(b.first[y[s:e]], n[s:e])
        ids_i, ids_j = a.ids[i], b.ids[j]
        ok = (a.sides[i] != b.sides[j]) & (ids_i < ids_j if own else ids_i != ids_j)
        ids_i, ids_j = ids_i[ok], ids_j[ok]
        if len(ids_i):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids_i, ids_j)), pa.array(np.maximum(ids_i, ids_j))], schema=PAIR)


def compared(batches, p: int, q: int):
    """Of rows (a, b), names of chunks, sorted by a, the pairs."""
    name = left = None
    for rows in batches:
        for x, y in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            if x != name:
                name, left = x, Chunk.read(x)
            right = left if x == y else Chunk.read(y)
            if x == y:
                copies = np.flatnonzero(np.diff(left.first) > 1)
                yield from rows_of(left, left, copies, copies, True)
            for i, j in like_sets(left, right, x == y, p, q):
                yield from rows_of(left, right, i, j, False)


def like_pairs(rows: DataFrame, load: DataFrame, share: tuple[int, int], keep) -> DataFrame:
    """(a, b), a < b, of rows (g, id, side, tokens): equal g, different sides, and sets whose Jaccard similarity is p / q or more, for a share of (p, q).

    tokens are different 64-bit integers, sorted; rows without any are left out; load (g, tokens) says about how many of them each g has; keep stores the result. A worker holds two chunks.
    """
    spark, (p, q) = rows.sparkSession, share
    root, shuffles = scratch(spark, "sets"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = {r["g"]: -(-r["tokens"] // (CHUNKS * TOKENS)) for r in load.where(F.col("tokens") > CHUNKS * TOKENS).collect()}  # few: large ones only
    many = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for g in parts.items() for x in g]), F.col("g")), F.lit(1)) if parts else F.lit(1)
    d = rows.where("g IS NOT NULL AND id IS NOT NULL AND side IS NOT NULL").withColumn("hash", F.xxhash64("tokens"))
    d = d.select("g", F.pmod("hash", many).alias("part"), "id", "side", F.size("tokens").alias("n"), "hash", "tokens")
    d = d.repartition(max(shuffles, 2 * sum(parts.values())), "g", "part").sortWithinPartitions("g", "part", "n", "hash")
    with noted() as paths:
        chunks = stored(d.mapInArrow(partial(written, root=root), CHUNK_DDL), "chunks")
        passing = [root, *paths]
        paths.clear()
    try:
        a, b = chunks.alias("a"), chunks.alias("b")
        before = (F.col("a.lo") < F.col("b.lo")) | ((F.col("a.lo") == F.col("b.lo")) & (F.col("a.chunk") <= F.col("b.chunk")))
        tiles = a.join(b, (F.col("a.g") == F.col("b.g")) & before & (q * F.col("a.hi") >= p * F.col("b.lo"))).select(F.col("a.chunk").alias("a"), F.col("b.chunk").alias("b"))
        dealt = tiles.repartition(max(shuffles, chunks.count()), "a", F.pmod(F.xxhash64("b"), F.lit(4))).sortWithinPartitions("a")
        return keep(dealt.mapInArrow(partial(compared, p=p, q=q), PAIR_DDL).distinct())
    finally:
        for path in passing:
            delete(spark, path)
