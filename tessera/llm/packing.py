"""Best-fit packing by a grouping genetic algorithm on islands.

A chromosome is a list of bins (groups of pieces). Crossover injects whole,
well-filled bins of one parent into the other, removes the bins that then hold
a piece twice, and puts the displaced pieces back by best fit; mutation empties
a few badly filled bins and refills them the same way. Pieces are dealt out
into cells of bounded size; each cell is solved by several islands in separate
tasks, whose best packing moves to the next island between epochs. What still
sits in badly filled bins is dealt out anew and packed again.

A task holds one cell, at most CELL pieces, whatever the input; only lengths
and keys move, not texts.

Defined results: null text is empty and takes its end id; repeated rows are
packed each on its own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, stored, texts, tidied, work
from tessera.llm.tokens import encoder

#: Pieces in a cell, islands of a cell, epochs between which the best migrate, packings an island keeps, generations an epoch.
CELL, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 8_000, 2, 2, 4, 6
#: Bins filled less than this share are packed again, at most so many rounds.
FULL, ROUNDS = 0.985, 2

PIECES = pa.schema([("piece_key", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "piece_key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """A row for each piece of each document's ids: only documents longer than size are cut, the first piece being the rest.

    piece_key numbers pieces; write the result before using the key twice.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for b in batches:
            out = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder(vocabulary).encode(b.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((at, doc_id, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z])))
                    at += 1
            if out:
                yield batch(PIECES, *zip(*out, strict=True))

    return texts(docs).mapInArrow(tidied(run), PIECES_DDL)


# ---- the genetic algorithm, on one cell ----


def best_fit(lengths: list[int], items: list[int], bins: list[list[int]], size: int) -> list[list[int]]:
    """Put items, longest first, each into the fullest bin that takes it; bins is changed and returned."""
    room = sorted((size - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -lengths[i]):
        at = bisect_left(room, (lengths[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (size - lengths[i], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            if left > lengths[i]:
                insort(room, (left - lengths[i], k))
    return bins


def fitness(lengths: list[int], bins: list[list[int]], size: int) -> tuple[int, float]:
    """Fewer bins first, then bins filled unevenly: nearly empty ones can go next."""
    return -len(bins), sum((sum(lengths[i] for i in b) / size) ** 2 for b in bins)


def cross(rng, lengths, a, b, size):
    """Inject a share of b's fullest bins into a; bins of a that hold one of their pieces go, the displaced rest is put back by best fit."""
    fill = sorted(range(len(b)), key=lambda k: -sum(lengths[i] for i in b[k]))
    top = fill[: max(1, len(fill) // 2)]
    injected = [b[k] for k in rng.choice(top, max(1, len(top) // 2), replace=False)]
    taken = {i for g in injected for i in g}
    kept, loose = [list(g) for g in injected], []
    for g in a:
        if taken.isdisjoint(g):
            kept.append(list(g))
        else:
            loose += [i for i in g if i not in taken]
    return best_fit(lengths, loose, kept, size)


def mutate(rng, lengths, a, size):
    """Empty the worst bins and a few others, and refill."""
    if len(a) < 3:
        return a
    fill = sorted(range(len(a)), key=lambda k: sum(lengths[i] for i in a[k]))
    n = max(2, len(a) // 25)
    gone = set(fill[:n]) | set(rng.choice(len(a), n, replace=False).tolist())
    loose = [i for k in gone for i in a[k]]
    return best_fit(lengths, loose, [list(g) for k, g in enumerate(a) if k not in gone], size)


def evolve(lengths: list[int], start: list[list[list[int]]], size: int, seed: int, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing after some generations from the given ones."""
    rng = np.random.default_rng(seed)
    floor = -(-sum(lengths) // size)
    best = lambda p: fitness(lengths, p, size)
    pop = [*start]
    if not pop:
        pop.append(best_fit(lengths, list(range(len(lengths))), [], size))
    while len(pop) < POPULATION and len(pop[0]) > floor:
        pop.append(mutate(rng, lengths, pop[0], size))
    for _ in range(generations):
        pop.sort(key=best, reverse=True)
        if len(pop[0]) <= floor:
            break
        a, b = pop[0], pop[int(rng.integers(1, len(pop)))] if len(pop) > 1 else pop[0]
        pop = [*pop[: POPULATION - 2], cross(rng, lengths, a, b, size), mutate(rng, lengths, a, size)]
    return max(pop, key=best)


PLACED = pa.schema([("cell", pa.int64()), ("island", pa.int32()), ("piece_key", pa.int64()), ("length", pa.int64()), ("bin", pa.int32()), ("n_bins", pa.int32()), ("filled", pa.int64()), ("migrant", pa.bool_())])
PLACED_DDL = "cell long, island int, piece_key long, length long, bin int, n_bins int, filled long, migrant boolean"


def epoch(islands: DataFrame, size: int, number: int) -> DataFrame:
    """One epoch of every island: its rows are its pieces with the bin in its own best packing and in a migrant's."""

    def run(key, t):
        d = t.to_pydict()
        own = [i for i, m in enumerate(d["migrant"]) if not m]
        keys = sorted({d["piece_key"][i] for i in own})
        place = {k: n for n, k in enumerate(keys)}
        lengths = [0] * len(keys)
        starts: list[list[list[int]]] = []
        for migrant in (False, True):
            bins: dict[int, list[int]] = {}
            for i, m in enumerate(d["migrant"]):
                if m == migrant:
                    lengths[place[d["piece_key"][i]]] = d["length"][i]
                    if d["bin"][i] is not None:
                        bins.setdefault(d["bin"][i], []).append(place[d["piece_key"][i]])
            if bins:
                starts.append(list(bins.values()))
        cell, island = int(key[0].as_py()), int(key[1].as_py())
        won = evolve(lengths, starts, size, seed=zlib.crc32(f"{cell}/{island}/{number}".encode()))
        rows = [(cell, island, keys[i], lengths[i], n, len(won), sum(lengths[j] for j in g), False) for n, g in enumerate(won) for i in g]
        return pa.Table.from_batches([batch(PLACED, *zip(*rows, strict=True))])

    return islands.groupBy("cell", "island").applyInArrow(run, PLACED_DDL)


def solve(items: DataFrame, size: int, round_no: int, cell: int = CELL) -> DataFrame:
    """items (piece_key, length): (cell, piece_key, length, bin, filled) of each cell's best packing."""
    n_cells = max(1, -(-items.count() // cell))
    mine = items.withColumn("cell", F.pmod(F.xxhash64("piece_key", F.lit(round_no)), F.lit(n_cells)))
    state = mine.select("cell", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "piece_key", "length", F.lit(None).cast("int").alias("bin"), F.lit(None).cast("int").alias("n_bins"), F.lit(None).cast("long").alias("filled"), F.lit(False).alias("migrant"))
    for k in range(EPOCHS):
        placed = stored(epoch(state, size, k), "packing-epoch")
        moved = placed.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")).withColumn("migrant", F.lit(True))
        state = placed.unionByName(moved)
    best = placed.groupBy("cell").agg(F.min(F.struct("n_bins", "island")).alias("b")).select(F.col("cell").alias("c"), F.col("b.island").alias("i"))
    return placed.join(best, (F.col("cell") == F.col("c")) & (F.col("island") == F.col("i"))).select("cell", "piece_key", "length", "bin", "filled")


def pack(items: DataFrame, size: int = 2048, cell: int = CELL) -> DataFrame:
    """items (piece_key, length), stored, no longer than size: (piece_key, sequence_id, offset), offsets without gaps from 0.

    Whole sequences need no search; the others evolve, and what lands in badly
    filled sequences is dealt out and packed anew for some rounds.
    """
    whole = items.where(F.col("length") == size).select(F.col("piece_key"), (F.col("piece_key") * 16).alias("sequence_id"), F.col("length"))
    rest, done = items.where(F.col("length") < size).select("piece_key", "length"), []
    for r in range(ROUNDS + 1):
        placed = stored(solve(rest, size, r, cell), "packing-round")
        name = placed.withColumn("sequence_id", F.min("piece_key").over(_bin()) * 16 + 1 + r)
        last = r == ROUNDS
        done.append((name if last else name.where(F.col("filled") >= FULL * size)).select("piece_key", "sequence_id", "length"))
        if last:
            break
        rest = placed.where(F.col("filled") < FULL * size).select("piece_key", "length")
        if rest.isEmpty():
            break
    out = whole
    for d in done:
        out = out.unionByName(d)
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy("piece_key").rowsBetween(Window.unboundedPreceding, -1)
    return out.select("piece_key", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def _bin():
    from pyspark.sql import Window

    return Window.partitionBy("cell", "bin")


def packed(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    with work(docs.sparkSession) as keep:
        cut = stored(pieces(docs, vocabulary, end_id, size), "packing-pieces")
        return keep(cut.join(pack(cut.select("piece_key", "length"), size), "piece_key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), "packed")


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    """(sequence_id, ids array<int>) with the ids themselves: each holds at most size of them. doc_id must be unique here."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            out = []
            for doc_id, data in zip(b.column(0).to_pylist(), encoder(vocabulary).encode(b.column(1).to_pylist()), strict=True):
                ids = [*np.frombuffer(data, "<u4").tolist(), end_id]
                first = len(ids) % size or size
                cuts = [0, *range(first, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
                out += [(doc_id, k, ids[a:z]) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
            if out:
                yield batch(schema, *zip(*out, strict=True))

    ids = texts(docs).mapInArrow(tidied(run), "doc_id long, piece int, ids array<int>")
    whole = placed.join(ids, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the packing of all documents that are left."""
    return packed(docs, vocabulary())
