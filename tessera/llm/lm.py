"""Language-model scores by a weighted backoff automaton of order 3.

States are contexts: the root, which knows none, one for each word and one for
each bigram that training saw. A state's arcs are the smoothed n-grams seen in
training after its context, and its failure arc leads to the state of the
context without its first word, with the weight that smoothing leaves for
what is not seen. One left-to-right traversal of a text carries the state: it
takes the state's arc for the token if there is one, else failure arcs until a
state has one (the root has one for every token), and adds up log10
probabilities; the next state is the longest context that training saw.

    p(w)    = (c(w) + a) / (N + a (V + 1))          root arcs, a = 0.1
    p(w|v)  = (c(vw) + k p(w)) / (c(v) + k)         arcs of v, failure weight k / (c(v) + k)
    p(w|uv) = (c(uvw) + m p(w|v)) / (c(uv) + m)     arcs of uv, failure weight m / (c(uv) + m)

Tokens are words of the A-Z-lowered text and an end; a text starts in the
state of the end. What may follow a state, one unknown word included, sums to 1.

The automaton of a large corpus fits no machine, so each chunk of documents
gets the part of it that its own n-grams can touch, which scores exactly as
the whole would. A chunk asks the owners of hash ranges about its different
words, bigrams and trigrams, with their counts in its training documents;
these add up all chunks' counts and answer each chunk (ranges.py).

Words are known by 64-bit hashes, n-grams by 48-bit ones, 64-bit from 2^36 tokens
on. Counts are 64-bit.

Defined results: null and empty texts are one end token; a null doc_id trains;
rows that repeat count and score each; without training documents every count
is 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHash, batch, byte_list, pack, stored, table, texts, tidied, unpack, work
from tessera.llm.ranges import ASK, Kind, exchange

#: Tokens in a chunk, and entries in an owner's hash range, about.
CHUNK, RANGE = 500_000, 1_000_000
#: Smoothing: pseudo-counts of a word, and of the backoff distribution after a word and after a bigram.
ADD, K, M = 0.1, 30.0, 2.0
#: Tokens from which n-grams' hashes have 64 bits.
MANY = 1 << 36
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line end
# Odd factors that tell an n-gram's places apart.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

CHUNKS = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("tokens", pa.binary()), ("ids", pa.binary()), ("null_ids", pa.binary()), ("held", pa.binary()), ("sizes", pa.binary())])
CHUNKS_DDL = "chunk long, n long, words binary, tokens binary, ids binary, null_ids binary, held binary, sizes binary"
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def chunks(docs: DataFrame) -> DataFrame:
    """Documents in chunks: the sorted different words' hashes, each document's tokens as places among them, its end included."""
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 10 = 0"), F.lit(False))

    def flush(ids, held, seqs, no):
        sizes = np.array([len(s) for s in seqs], np.int64)
        words, tokens = np.unique(np.concatenate(seqs), return_inverse=True)
        id_ = np.array([0 if i is None else i for i in ids], np.int64)
        null = np.array([i is None for i in ids], np.uint8)
        return batch(CHUNKS, [no], [len(tokens)], [pack(words, 8)], [pack(tokens.astype(np.uint64), 8)], [id_.tobytes()], [null.tobytes()], [np.array(held, np.uint8).tobytes()], [sizes.tobytes()])

    def run(batches):
        word_hash, no = WordHash(), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        ids, flags, seqs, total = [], [], [], 0
        for b in batches:
            for doc_id, body, h in zip(b.column(0).to_pylist(), byte_list(b.column(1)), b.column(2).to_pylist(), strict=True):
                ids.append(doc_id)
                flags.append(h)
                seqs.append(np.append(word_hash.of(body.lower().split()), END))
                total += len(seqs[-1])
                if total >= CHUNK:
                    yield flush(ids, flags, seqs, no)
                    no, ids, flags, seqs, total = no + 1, [], [], [], 0
        if seqs:
            yield flush(ids, flags, seqs, no)

    return texts(docs).withColumn("held", held).mapInArrow(tidied(run), CHUNKS_DDL)


class Chunk:
    """A chunk's tokens and its different n-grams, which travel in the order of their hashes.

    at[k][i] is the place of the k-gram that ends in token i among the chunk's k-grams; a document's first token ends no
    trigram, its context being the start alone, and has -1.
    """

    def __init__(self, row: dict, bits: int):
        self.tokens = unpack(row["tokens"], 8).astype(np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.ids, self.null = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["null_ids"], np.uint8).astype(bool)
        words = unpack(row["words"], 8)
        first = np.cumsum(self.sizes) - self.sizes
        self.end = int(np.searchsorted(words, END))
        self.before = np.concatenate([[self.end], self.tokens[:-1]])
        self.before[first] = self.end
        self.trains = ~np.repeat(self.held, self.sizes)

        def mixed(h: np.ndarray) -> np.ndarray:
            h ^= h >> np.uint64(31)
            h *= FACTORS[0]
            return (h ^ (h >> np.uint64(29))) >> np.uint64(64 - bits)

        hashed = words[self.tokens]
        pair = words[self.before] * FACTORS[0] + hashed * FACTORS[1]
        bigrams, two = np.unique(mixed(pair), return_inverse=True)
        inner = np.ones(len(self.tokens), bool)
        inner[first] = False
        places = np.flatnonzero(inner)
        three = np.full(len(self.tokens), -1, np.int64)
        two_before = self.before[places - 1]
        trigrams, three[places] = np.unique(mixed(words[two_before] * FACTORS[1] + words[self.before[places]] * FACTORS[2] + hashed[places] * FACTORS[0]), return_inverse=True)
        self.values = {1: words, 2: bigrams, 3: trigrams}
        self.at = {1: self.tokens, 2: two, 3: three}

    def counts(self, order: int) -> np.ndarray:
        """How often each n-gram of an order occurs in training documents of the chunk."""
        at = self.at[order][self.trains]
        return np.bincount(at[at >= 0], minlength=len(self.values[order]))


def asking(kinds: dict[int, Kind]):
    """Chunks to their different n-grams and counts."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row, kinds[2].bits)
                for k, kind in kinds.items():
                    if len(c.values[k]):
                        yield batch(ASK, [row["chunk"]], [k], [pack(c.values[k], kind.width)], [pack(c.counts(k).astype(np.uint64), 8)])

    return run


def totals(kind: int, values: np.ndarray, counts: np.ndarray, lens: np.ndarray):
    """An owner's answer: each entry's count over all chunks; and the numbers of different and of all training n-grams."""
    _, at = np.unique(values, return_inverse=True)
    total = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
    np.add.at(total, at, counts.astype(np.int64))
    out, ends = total[at].astype(np.uint64), np.cumsum([0, *lens.tolist()])
    return [pack(out[a:z], 8) for a, z in zip(ends, ends[1:], strict=False)], int((total > 0).sum()), int(total.sum())


class Automaton:
    """The part of the backoff automaton that a chunk's n-grams can touch, weights as log10.

    Arcs of each order are by the n-gram's place in the chunk, None where the state has no such arc. A state is (order,
    place): order 0 is the root, order 1 a word's state, order 2 a bigram's.
    """

    def __init__(self, chunk: Chunk, counts: dict[int, np.ndarray], n: int, v: int):
        self.chunk = chunk
        one, two, three = (counts[k].astype(float) for k in (1, 2, 3))
        root = (one + ADD) / (n + ADD * (v + 1))
        ends = lambda k: self._of_each(k, chunk.tokens)  # noqa: E731  the last word of each k-gram
        context2 = self._of_each(2, chunk.before)
        p2 = (two + K * root[ends(2)]) / (one[context2] + K)
        context3, inner2 = self._of_each(3, np.concatenate([[0], chunk.at[2][:-1]])), self._of_each(3, chunk.at[2])
        p3 = (three + M * p2[inner2]) / (two[context3] + M)
        self.known = (one > 0).tolist()
        self.root = np.log10(root)
        self.arcs1 = self.root.tolist()
        self.arcs2, self.arcs3 = self._arcs(p2, two), self._arcs(p3, three)
        self.failure1, self.failure2 = np.log10(K / (one + K)).tolist(), np.log10(M / (two + M)).tolist()

    def _of_each(self, order: int, of_position: np.ndarray) -> np.ndarray:
        """For each n-gram of an order what of_position says where it ends."""
        at = self.chunk.at[order]
        out = np.zeros(len(self.chunk.values[order]), np.int64)
        out[at[at >= 0]] = of_position[at >= 0]
        return out

    @staticmethod
    def _arcs(p: np.ndarray, seen: np.ndarray) -> list[float | None]:
        return [x if s else None for x, s in zip(np.log10(p).tolist(), (seen > 0).tolist(), strict=True)]

    def traverse(self, a: int, z: int) -> float:
        """Log10 probability of the text of tokens a to z, from left to right."""
        known, arcs1, arcs2, arcs3, failure1, failure2 = self.known, self.arcs1, self.arcs2, self.arcs3, self.failure1, self.failure2
        at = self.chunk.at
        order, word, bigram, total = 1 if known[self.chunk.end] else 0, self.chunk.end, -1, 0.0
        for w, two, three in zip(at[1][a:z].tolist(), at[2][a:z].tolist(), at[3][a:z].tolist(), strict=True):
            arc = arcs3[three] if order == 2 else None
            if arc is None:
                if order == 2:
                    total += failure2[bigram]
                    order = 1
                arc = arcs2[two] if order == 1 else None
                if arc is None:
                    if order == 1:
                        total += failure1[word]
                    total += arcs1[w]
                    word, bigram, order = w, two, 1 if known[w] else 0
                    continue
            total += arc
            word, bigram, order = w, two, 2
        return total


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    with work(spark) as keep:
        chunked = stored(chunks(docs), "lm-chunks")
        tokens, n_chunks = chunked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        bits = 48 if tokens < MANY else 64
        kinds = {1: Kind(64, 8, 8), 2: Kind(bits, bits // 8, 8), 3: Kind(bits, bits // 8, 8)}
        answers = stored(exchange(chunked, asking(kinds), kinds, max(1, -(-tokens // RANGE)), n_chunks, totals), "lm-counts")
        head = answers.where("chunk IS NULL AND kind = 1").agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
        v, n = head["v"] or 0, head["n"] or 0
        blobs = ("words", "tokens", "ids", "null_ids", "held", "sizes")
        left = chunked.select("chunk", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("part"), *blobs, F.lit(None).cast("array<binary>").alias("blobs"))
        right = answers.where("chunk IS NOT NULL").select("chunk", "kind", "part", *[F.lit(None).cast("binary").alias(x) for x in blobs], "blobs")

        def run(batches):
            chunk, got = None, {}

            def close():
                counts = {k: np.concatenate([np.zeros(0, np.uint64), *(unpack(x, 8) for x in got[k])]).astype(np.int64) for k in got}
                automaton = Automaton(chunk, counts, n, v)
                at = np.cumsum(chunk.sizes) - chunk.sizes
                along = [automaton.traverse(a, a + size) for a, size in zip(at.tolist(), chunk.sizes.tolist(), strict=True)]
                known = np.add.reduceat((counts[1][chunk.tokens] > 0).astype(np.int64), at)
                base = np.add.reduceat(automaton.root[chunk.tokens], at)
                return pa.RecordBatch.from_arrays([pa.array(chunk.ids, mask=chunk.null), pa.array(chunk.held), pa.array(chunk.sizes), pa.array(known), pa.array(base), pa.array(along, pa.float64())], schema=SCORES)

            for b in batches:
                for row in b.to_pylist():
                    if row["kind"] == 0:
                        if chunk is not None:
                            yield close()
                            chunk = None  # before the next one is made
                        chunk, got = Chunk(row, bits), {1: [], 2: [], 3: []}
                    else:
                        got[row["kind"]] += row["blobs"]
            if chunk is not None:
                yield close()

        many = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = left.unionByName(right).repartition(max(many, min(n_chunks // 4, 200_000)), "chunk").sortWithinPartitions("chunk", "kind", "part")
        return keep(met.mapInArrow(tidied(run), SCORES_DDL).withColumn("train_tokens", F.lit(n).cast("long")), "lm-scores")


def op6(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
