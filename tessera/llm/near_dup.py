"""N-gram Jaccard join: size-aware heavy-light join over word shingles.

A document's set is its distinct 5-word shingles (64-bit hashes). Documents
link when 100 * overlap >= 75 * union. The result is each document's connected
component; no link between different texts is lost. Texts and sets are told
apart by SHA-256.

1. Prune. A document can link only if three quarters of its shingles occur in
   another text. Each chunk of documents asks the owners of hash ranges about
   its different shingles, once each (ranges.py); they answer how many of a
   document's shingles they saw from elsewhere. Shingles travel as 48 bits, so
   a clash can only keep a document too many.
2. Light. Sets of at most x shingles list all their subsets of the sizes that
   a link needs. Of the sets that list a subset the smallest is its holder,
   found by a combining aggregate; the others are compared with it. That
   loses nothing: who links meets in a subset whose holder links with both.
   x is where listing costs more than scanning.
3. Heavy. Other sets, and light ones large enough to link with them, go into
   tiles by the smallest hash of their more frequent half. Each tile scans its
   inverted lists, counts overlaps exactly and joins what links. Where more sets
   have one such hash than a tile takes, one set of each joined group goes on into
   new tiles, again and again, so a group of near copies comes together in
   rounds that shrink and not by visits of all to all tiles. Tiles are written with
   their sets; what becomes of chiefs is a narrow table, broadcast while it has few rows.
   Then sets visit tiles with which they share one of the rarest shingles that
   a link must touch (prefix by a fixed-size frequency sketch, an order only)
   and that hold sets of another group: under each shingle the sets of its
   commonest group stay at home. First only one set of each group goes, then
   what groups are left. Visitors of a tile are dealt out in bounded numbers.
4. Components by alternating stars on what was joined.

Defined results: null and empty texts, and texts without words, have the empty
set and link with nothing; a text of fewer than 5 words is one shingle; rows
that repeat each give a row; null doc_ids are never a component's name unless
alone; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, WordHash, batch, byte_list, hinted, pack, planes, stored, table, texts, tidied, unplanes, work
from tessera.llm.ranges import ASK, Kind, exchange
from tessera.operators.graph import components

#: Words in a shingle; a link needs SHARE percent of the union.
WORDS, SHARE = 5, 75
#: Shingles in a chunk and in an owner's hash range, about.
CHUNK, RANGE = 400_000, 1_000_000
#: Of a tile, and visitors that are compared with it in one go.
TILE_SETS, TILE_TOKENS, VISITORS = 256, 1_000_000, 2_048
#: A round of tiles is worth while if it leaves at most this share of the sets it began with.
SHRINKS = 0.7
#: Slots of the frequency sketch: a fixed size.
SLOT_BITS = 20
#: Largest size that is ever listed by subsets.
MOST_LIGHT = 16
# Odd factors that tell a shingle's places apart.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: In place of an owner: a shingle of several documents of the chunk.
NOBODY = (1 << 32) - 1


def shingles(body: bytes, word_hash: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; bytes.lower and bytes.split touch ASCII only."""
    h = word_hash.of(body.lower().split())
    if not len(h):
        return h
    if len(h) < WORDS:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), len(h))], np.uint64)
    out = np.zeros(len(h) - WORDS + 1, np.uint64)
    for i in range(WORDS):
        out += h[i : i + len(out)] * FACTORS[i]
    out ^= out >> np.uint64(29)
    out *= FACTORS[0]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def links(a: int, b: int, overlap: int) -> bool:
    return 100 * overlap >= SHARE * (a + b - overlap)


def needed(a: int, b: int) -> int:
    """The least overlap with which sets of a and b shingles link."""
    return -(-SHARE * (a + b) // (100 + SHARE))


def least(a: int) -> int:
    """The least overlap of a set of a shingles with any that it links with."""
    return -(-SHARE * a // 100)


# ---- 1. prune ----

ANSWER = pa.schema([("text_key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("shared", pa.int64())])
ANSWER_DDL = "text_key binary, doc_id long, n long, shared long"
NULL_ID = -(1 << 63)
KINDS = {1: Kind(48, 6, 4)}


def asked(batches, limit: int):
    """Of batches of (doc_id, text, text_key) each chunk's documents (kind 0: keys, ids, sizes, shingles that another document of the chunk has) and its different
    shingles (kind 1), beside each whose it is if only one document's."""

    def flush(ids, keys, sets, chunk):
        sizes = np.array([len(s) for s in sets], np.int64)
        ids = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        value = np.concatenate(sets) >> np.uint64(16)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        runs = np.diff(np.append(new, len(value)))
        local = np.bincount(owner[np.repeat(runs > 1, runs)], minlength=len(sets)).astype(np.int64)
        value, owner = value[new], np.where(runs > 1, NOBODY, owner[new]) if len(new) else owner[:0]
        held = b"".join(keys) + ids.tobytes() + sizes.tobytes() + local.tobytes()
        yield batch(ASK, [chunk], [0], [held], [b""])
        if len(value):
            yield batch(ASK, [chunk], [1], [pack(value, KINDS[1].width)], [pack(owner.astype(np.uint64), KINDS[1].payload)])

    chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    word_hash, ids, keys, sets, total = WordHash(), [], [], [], 0
    for b in batches:
        for doc_id, body, key in zip(b.column(0).to_pylist(), byte_list(b.column(1)), b.column(2).to_pylist(), strict=True):
            s = shingles(body, word_hash)
            ids.append(doc_id)
            keys.append(key)
            sets.append(s)
            total += len(s)
            if total >= limit or len(sets) >= limit:
                yield from flush(ids, keys, sets, chunk)
                chunk, ids, keys, sets, total = chunk + 1, [], [], [], 0
    if sets:
        yield from flush(ids, keys, sets, chunk)


def elsewhere(kind: int, values: np.ndarray, owners: np.ndarray, lens: np.ndarray):
    """An owner's answer: of each chunk the documents that have a shingle which another chunk has too, and how many such."""
    order = np.argsort(values, kind="stable")
    same = np.concatenate([[False], values[order][1:] == values[order][:-1]])
    twice = np.zeros(len(values), bool)
    twice[order] = same | np.concatenate([same[1:], [False]])
    blobs, ends = [], np.cumsum([0, *lens.tolist()])
    for a, z in zip(ends, ends[1:], strict=False):
        own = owners[a:z][twice[a:z] & (owners[a:z] != NOBODY)]
        places, n = np.unique(own, return_counts=True)
        blobs.append(planes(places, 4) + planes(n.astype(np.uint64), 4) if len(places) else None)
    return blobs, None, None


def answers(rows: DataFrame, parts: int, chunks: int) -> DataFrame:
    """Per document: text_key, doc_id, n shingles, and how many of them occur in another document."""

    def total(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        head = next(r for r in rows if r["kind"] == 0)["blobs"][0]
        m = len(head) // 56
        keys = [head[32 * i : 32 * i + 32] for i in range(m)]
        d, n, shared = np.frombuffer(head, np.int64, 3 * m, 32 * m).reshape(3, m)
        shared = shared.copy()
        for r in rows:
            for blob in r["blobs"] if r["kind"] else ():
                half = len(blob) // 2
                shared[unplanes(blob[:half], 4).astype(np.int64)] += unplanes(blob[half:], 4).astype(np.int64)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(d, mask=d == NULL_ID), pa.array(n), pa.array(shared)], schema=ANSWER)])

    return exchange(rows, partial(asked, limit=CHUNK), KINDS, parts, chunks, elsewhere).where("chunk IS NOT NULL").groupBy("chunk").applyInArrow(total, ANSWER_DDL)


# ---- 2. and 3.: sets that are left ----

SETS = pa.schema([("text_key", pa.binary()), ("set_key", pa.binary()), ("n", pa.int32()), ("body", pa.binary())])
SETS_DDL = "text_key binary, set_key binary, n int, body binary"
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
LINKS_DDL = "a long, b long"


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def sets_of(rows: DataFrame) -> DataFrame:
    def run(batches):
        word_hash = WordHash()
        for b in batches:
            got = [shingles(x, word_hash) for x in byte_list(b.column(1))]
            body = [s.tobytes() for s in got]
            yield batch(SETS, b.column(2), [hashlib.sha256(x).digest() for x in body], [len(s) for s in got], body)

    return rows.mapInArrow(tidied(run), SETS_DDL)


def sketch(sets: DataFrame) -> tuple[np.ndarray, float]:
    """How often shingles of each slot occur, about; and the mean length of a list. For order and cost only."""
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total, n = np.zeros(1 << SLOT_BITS, np.int64), 0
        for b in batches:
            all_ = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)
            total += np.bincount((all_ >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
            n += len(all_)
        often = np.flatnonzero(total >= 4)
        used = int((total > 0).sum())
        yield batch(schema, [*often.tolist(), -1, -2], [*total[often].tolist(), n, used])

    rows = sets.select("body").mapInArrow(tidied(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n >= 8 OR slot < 0").toPandas()  # at most a row a slot
    out = np.zeros(1 << SLOT_BITS, np.uint32)
    slots = rows[rows.slot >= 0]
    out[slots.slot.to_numpy()] = np.minimum(slots.n.to_numpy(), 0xFFFFFFFF).astype(np.uint32)
    head = dict(zip(rows.slot, rows.n, strict=True))
    return out, float(head.get(-1, 0)) / max(1.0, float(head.get(-2, 0)))


def light_bound(mean_list: float) -> int:
    """The largest size for which listing subsets costs no more than scanning lists."""
    x = 0
    for a in range(1, MOST_LIGHT + 1):
        if sum(comb(a, t) for t in range(least(a), a + 1)) > 40 + a * mean_list:
            break
        x = a
    return x


def light_links(sets: DataFrame, bound: int) -> DataFrame:
    """Links of sets of at most bound shingles: each compared with the smallest holder of a subset that they have in common."""
    schema = pa.schema([("subset", pa.int64()), ("t", pa.int32()), ("n", pa.int32()), ("set_id", pa.int64()), ("body", pa.binary())])

    def listed(batches):
        for b in batches:
            for set_id, n, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                s = [body[8 * i : 8 * i + 8] for i in range(n)]
                out = [(signed(xxhash.xxh64_intdigest(b"".join(c), t)), t, n, set_id, body) for t in range(least(n), n + 1) for c in combinations(s, t)]
                yield batch(schema, *zip(*out, strict=True))

    def compared(batches):
        for b in batches:
            out = []
            for a, x, c, y in zip(*(k.to_pylist() for k in b.columns), strict=True):
                common = len({x[i : i + 8] for i in range(0, len(x), 8)} & {y[i : i + 8] for i in range(0, len(y), 8)})
                if links(len(x) // 8, len(y) // 8, common):
                    out.append((a, c))
            if out:
                yield batch(LINKS, *zip(*out, strict=True))

    entries = stored(sets.where(F.col("n") <= bound).select("set_id", "n", "body").mapInArrow(tidied(listed), "subset long, t int, n int, set_id long, body binary"), "near-subsets", "lz4")
    holder = entries.groupBy("subset", "t").agg(F.min(F.struct("n", "set_id", "body")).alias("h"), F.count("*").alias("k")).where("k > 1")
    # what the smaller set of a link needs to have in common with the other: ceil(SHARE * (a + b) / (100 + SHARE))
    enough = F.col("t") * (100 + SHARE) >= SHARE * (F.col("n") + F.col("h.n"))
    met = entries.join(holder, ["subset", "t"]).where(enough & (F.col("set_id") != F.col("h.set_id")))
    return met.select(F.col("h.set_id").alias("a"), F.col("h.body").alias("x"), F.col("set_id").alias("c"), F.col("body").alias("y")).dropDuplicates(["a", "c"]).mapInArrow(tidied(compared), LINKS_DDL)


def unit(body: bytes, freq: np.ndarray) -> int:
    """The smallest hash among the more frequent half of a set: what most of a group of near copies have in common."""
    s = np.frombuffer(body, np.uint64)
    f = freq[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    return signed(int(s[np.argmax(f >= np.median(f))]))


class Tile:
    """Inverted lists over the sets at home in a tile."""

    def __init__(self, bodies: list[bytes]):
        self.sets = [np.frombuffer(x, np.uint64) for x in bodies]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        tokens = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(bodies)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owner = owner[order]
        tokens = tokens[order]
        new = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.tokens, self.starts = tokens[new], np.append(new, len(tokens))

    def partners(self, s: np.ndarray) -> np.ndarray:
        """Places of the sets that link with s."""
        at = np.searchsorted(self.tokens, s)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == s)]
        if not len(at):
            return at
        a, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        picks = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        overlap = np.bincount(self.owner[picks], minlength=len(self.sets))
        return np.flatnonzero(100 * overlap >= SHARE * (len(s) + self.sizes - overlap))


class Groups(dict):
    """Union-find."""

    def top(self, x: int) -> int:
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        x, y = self.top(a), self.top(b)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


HOMES = pa.schema([("set_id", pa.int64()), ("n", pa.int32()), ("unit", pa.int64()), ("tile", pa.int64()), ("chief", pa.int64()), ("body", pa.binary())])
HOMES_DDL = "set_id long, n int, unit long, tile long, chief long, body binary"


def settled(batches):
    """Rows (tile, set_id, unit, body), sorted by tile: each set with its chief, the set with most links of its group in the tile."""
    now, ids, units, bodies = None, [], [], []

    def settle():
        if not ids:
            return None
        groups, links_of = Groups(), [0] * len(ids)
        if len(ids) > 1:
            tile = Tile(bodies)
            for i, s in enumerate(tile.sets):
                found = tile.partners(s).tolist()
                links_of[i] = len(found)
                for j in found:
                    if j < i:
                        groups.join(j, i)
        chief: dict[int, int] = {}
        for i in sorted(range(len(ids)), key=lambda i: (-links_of[i], ids[i])):
            chief.setdefault(groups.top(i), i)
        return batch(HOMES, ids, [len(x) // 8 for x in bodies], units, [now] * len(ids), [ids[chief[groups.top(i)]] for i in range(len(ids))], bodies)

    for b in batches:
        for tile, set_id, unit_, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if tile != now:
                done = settle()
                if done is not None:
                    yield done
                now, ids, units, bodies = tile, [], [], []
            ids.append(set_id)
            units.append(unit_)
            bodies.append(body)
    done = settle()
    if done is not None:
        yield done


def homes(sets: DataFrame, keep=stored) -> DataFrame:
    """(set_id, n, unit, tile, chief, body) of sets (set_id, n, unit, body); written."""
    load = sets.groupBy("unit").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    many = F.greatest(F.ceil(F.col("k") / TILE_SETS), F.ceil(F.col("size") / TILE_TOKENS))
    crowded = stored(load.select(F.col("unit").alias("crowded"), many.alias("many")).where("many > 1"), "near-crowded")
    tile = F.when(F.col("many").isNull(), F.col("unit")).otherwise(F.xxhash64("unit", F.pmod(F.xxhash64("set_id"), F.col("many"))))
    tiled = sets.join(hinted(crowded), F.col("unit") == F.col("crowded"), "left").select(tile.alias("tile"), "set_id", "unit", "body")
    return keep(_dealt(tiled, "tile").sortWithinPartitions("tile", "set_id").mapInArrow(tidied(settled), HOMES_DDL), "near-homes", "lz4")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _written(df: DataFrame, by: DataFrame, name: str) -> DataFrame:
    """df, the join of sets with hinted(by): as it is if that is broadcast, else written, so that sets are shuffled for it once."""
    return df if by.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else stored(df, name, "lz4")


def renamed(housed: DataFrame, moved: DataFrame) -> DataFrame:
    """housed with other chiefs: those of moved (low, high), which must be stored."""
    out = housed.join(hinted(moved), F.col("chief") == F.col("low"), "left").select("set_id", "n", "unit", "tile", F.coalesce("high", "chief").alias("chief"), "body")
    return _written(out, moved, "near-housed")


def gathered(first: DataFrame) -> DataFrame:
    """The homes of all sets, each with the chief of its group after rounds of tiles over the chiefs."""
    moved, left = None, first
    before = None
    while True:
        # chiefs whose unit fills more than one tile meet again
        chiefs = left.where("set_id = chief")
        apart = stored(chiefs.groupBy("unit").agg(F.min("tile").alias("x"), F.max("tile").alias("y")).where("x <> y").select(F.col("unit").alias("apart")), "near-apart")
        if apart.isEmpty():
            break
        again = stored(chiefs.join(hinted(apart), F.col("unit") == F.col("apart"), "left_semi").select("set_id", "n", "unit", "body"), "near-chiefs", "lz4")
        n = again.count()
        if before is not None and n > SHRINKS * before:
            break
        before = n
        left = homes(again)
        higher = left.where("set_id <> chief").select(F.col("set_id").alias("low"), F.col("chief").alias("high"))
        if moved is not None:
            further = higher.select(F.col("low").alias("was"), F.col("high").alias("now"))
            higher = higher.unionByName(moved.join(further, F.col("high") == F.col("was"), "left").select("low", F.coalesce("now", "high").alias("high")))
        moved = stored(higher, "near-moved")
    return first if moved is None else renamed(first, moved)


PREFIXES = pa.schema([("token", pa.int64()), ("tile", pa.int64()), ("chief", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32())])
PREFIXES_DDL = "token long, tile long, chief long, set_id long, n int"


def visits(sets: DataFrame, sketched) -> DataFrame:
    """(set_id, tile): who must be compared with another tile's sets. sets: (set_id, n, tile, chief, body)."""

    def prefixes(batches):
        freq = sketched.value
        for b in batches:
            tokens, k = [], []
            for n, body in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
                s = np.frombuffer(body, np.uint64)
                tokens.append(s[np.lexsort((s, freq[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))[: n - least(n) + 1]].view(np.int64))
                k.append(len(tokens[-1]))
            if tokens:
                of = lambda i, k=k, b=b: pa.array(np.repeat(b.column(i).to_numpy(), k))
                yield batch(PREFIXES, pa.array(np.concatenate(tokens)), of(2), of(3), of(0), of(1))

    entries = stored(sets.select("set_id", "n", "tile", "chief", "body").mapInArrow(tidied(prefixes), PREFIXES_DDL), "near-prefixes", "lz4")
    mixed = entries.groupBy("token").agg(F.min("tile").alias("t0"), F.max("tile").alias("t1"), F.min("chief").alias("c0"), F.max("chief").alias("c1")).where("t0 <> t1 AND c0 <> c1").select("token")
    open_ = stored(entries.join(mixed, "token", "left_semi"), "near-open", "lz4")
    commonest = open_.groupBy("token", "chief").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("chief", F.struct("k", "chief")).alias("stays"))
    there = open_.groupBy(F.col("token").alias("at"), F.col("tile").alias("there")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("chief").alias("c0"), F.max("chief").alias("c1"))
    out = open_.join(commonest, "token").where("chief <> stays")
    fits = (F.col("high") * 100 >= SHARE * F.col("n")) & (F.col("n") * 100 >= SHARE * F.col("low"))
    other = (F.col("c0") != F.col("chief")) | (F.col("c1") != F.col("chief"))
    return out.join(there, F.col("token") == F.col("at")).where((F.col("tile") != F.col("there")) & fits & other).select("set_id", F.col("there").alias("tile")).distinct()


def received(batches):
    """Rows (tile, share, visitor, chief, body), sorted, homes before visitors: chiefs of different groups that a link joins."""
    now, chiefs, bodies, tile, groups, out = None, [], [], None, Groups(), []
    for b in batches:
        for key in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key[:2] != now:
                now, chiefs, bodies, tile, groups = key[:2], [], [], None, Groups()
            visitor, chief, body = key[2:]
            if not visitor:
                chiefs.append(chief)
                bodies.append(body)
                continue
            if tile is None:
                tile = Tile(bodies)
            for j in tile.partners(np.frombuffer(body, np.uint64)).tolist():
                if groups.join(chiefs[j], chief):
                    out.append((chiefs[j], chief))
        if out:
            yield batch(LINKS, *zip(*out, strict=True))
            out = []


def met(housed: DataFrame, sketched) -> DataFrame:
    """Links (a, b) between chiefs of different groups, found by visits. housed: (set_id, n, tile, chief, body)."""
    with work(housed.sparkSession) as keep:
        went = stored(visits(housed, sketched), "near-visits")
        shares = stored(went.groupBy(F.col("tile").alias("host")).agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("shares")), "near-shares")
        hosts = housed.join(hinted(shares), F.col("tile") == F.col("host")).select("tile", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("visitor"), "chief", "body")
        guests = went.withColumnRenamed("set_id", "guest").join(hinted(shares), F.col("tile") == F.col("host"))
        guests = stored(guests.select("guest", F.col("tile").alias("to"), F.pmod(F.xxhash64("guest"), F.col("shares")).cast("int").alias("share")), "near-guests")
        guests = housed.select("set_id", "chief", "body").join(hinted(guests), F.col("guest") == F.col("set_id")).select(F.col("to").alias("tile"), "share", F.lit(1).alias("visitor"), "chief", "body")
        return keep(_dealt(hosts.unionByName(guests), "tile", "share").sortWithinPartitions("tile", "share", "visitor").mapInArrow(tidied(received), LINKS_DDL), "near-met")


def heavy_links(sets: DataFrame, freq: np.ndarray, bound: int) -> DataFrame:
    """Links among sets of over bound shingles, and with the light ones that can reach them: enough of them to join every group."""
    sketched = sets.sparkSession.sparkContext.broadcast(freq)
    schema = pa.schema([("set_id", pa.int64()), ("n", pa.int32()), ("unit", pa.int64()), ("body", pa.binary())])

    def units(batches):
        for b in batches:
            yield batch(schema, b.column(0), b.column(1), [unit(x, sketched.value) for x in b.column(2).to_pylist()], b.column(2))

    with work(sets.sparkSession) as keep:
        big = stored(sets.where(F.col("n") >= least(bound + 1)).select("set_id", "n", "body").mapInArrow(tidied(units), "set_id long, n int, unit long, body binary"), "near-big", "lz4")
        first = homes(big, keep)
    housed = gathered(first)
    # the chiefs meet first, so that of groups which these join no other set needs to go anywhere
    joined = components(met(housed.where("set_id = chief"), sketched))
    joined = stored(joined.where("node <> root").select(F.col("node").alias("low"), F.col("root").alias("high")), "near-joined")
    housed = renamed(housed, joined)
    return housed.where("set_id <> chief").select(F.col("set_id").alias("a"), F.col("chief").alias("b")).unionByName(met(housed, sketched))


# ---- 4. components, and all together ----


def near_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key (the SHA-256 of the text), n_shingles, component_id (the smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    with work(spark) as keep:
        rows = texts(docs).withColumn("text_key", F.unhex(F.sha2("text", 256)))
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * RANGE)))
        answer = stored(answers(rows, parts, -(-size // (6 * CHUNK))), "near-answers")
        every = answer.select("doc_id", "text_key", F.col("n").alias("n_shingles"))
        left = answer.groupBy("text_key").agg(F.sum("shared").alias("shared"), F.max("n").alias("n"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
        left = stored(left.where((F.col("n") > 0) & ((100 * F.col("shared") >= SHARE * F.col("n")) | (F.col("copies") > 1))).select(F.col("text_key").alias("k"), F.col("first_id")), "near-left")
        # one text of each that is left
        picked = rows.join(hinted(left), (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
        sets = stored(sets_of(picked).withColumn("set_id", F.monotonically_increasing_id()), "near-sets", "lz4")
        # of equal sets the first, found by their keys
        first = sets.groupBy("set_key").agg(F.min("set_id").alias("first"))
        keys = stored(sets.select("text_key", "set_key", "set_id").join(first, "set_key").select("text_key", "set_id", "first"), "near-keys")
        names = keys.select("text_key", F.col("first").alias("set_id")).distinct()
        repeats = stored(keys.where("set_id <> first").select(F.col("set_id").alias("repeat")), "near-repeats")
        classes = _written(sets.join(hinted(repeats), F.col("set_id") == F.col("repeat"), "left_anti").select("set_id", "n", "body"), repeats, "near-classes")
        freq, mean_list = sketch(classes)
        bound = light_bound(mean_list)
        roots = components(light_links(classes, bound).unionByName(heavy_links(classes, freq, bound)))
        named = names.join(roots, F.col("set_id") == F.col("node"), "left").select("text_key", F.coalesce("root", "set_id").alias("root"))
        lowest = every.where("doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("low"))
        smallest = stored(named.join(lowest, "text_key", "left"), "near-roots")
        best = smallest.groupBy("root").agg(F.min("low").alias("component")).withColumnRenamed("root", "best_root")
        of_text = smallest.join(best, F.col("root") == F.col("best_root")).select(F.col("text_key").alias("named_key"), "component")
        joined = every.join(of_text, F.col("text_key") == F.col("named_key"), "left")
        return keep(joined.select("doc_id", "text_key", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "near-groups")


def op4(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def near_dup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest doc_id stays; of rows that repeat doc_id and text, one."""
    from tessera.llm.exact_dedup import without

    groups = near_groups(docs)
    stays = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    gone = groups.where(~stays).select("doc_id", "text_key")
    again = groups.where(stays & F.col("doc_id").isNotNull()).groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return without(docs, gone.unionByName(again), again)
