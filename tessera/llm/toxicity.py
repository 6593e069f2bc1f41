"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its
features (words and word beginnings), those that lean toxic with weights of 0 or more, those that lean clean with 0
or less; a document's score is their noisy-or with a small leak, 1 - (1 - leak) prod(1 - p). Sentences without a
feature that leans toxic take no part, so length alone makes no document toxic. Only documents have labels: the weights
are fitted through the noisy-or, and so find the sentences that make a document toxic.

Defined results: null and empty texts score the leak; without labels of both
kinds every score is the share of toxic labels (0 without any); null or
repeated labels of a document count by their maximum, nulls not at all;
repeated rows each give a row; an empty table gives an empty result; extra
columns are ignored and never inputs.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, hinted, table, texts, tidied, work

#: Labelled documents of each class that the model is fitted on, and features for and against that it has, at most.
FIT_DOCS, FEATURES, AGAINST = 3_000, 4_096, 1_024
#: Strength of the prior on a weight, in documents: a feature seen in one toxic document pays this over their number, one with more evidence less.
PRIOR = 0.02
#: What a document scores whose sentences have no features.
LEAK = 0.02
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"\w+")
BEGINNINGS = (3, 4, 5, 6, 7)


def features(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences; the empty text is one."""
    return [m.span() for m in SENTENCE.finditer(text)] or [(0, len(text))]


def lowered(text: str) -> str:
    """The text in lower case, character by character, so that places stay: one that would become several stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


class Model:
    """Noisy-or over logistic sentence scores; names in front of the first n_for lean toxic."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float, leak: float = LEAK, n_for: int | None = None):
        self.index = {n: i for i, n in enumerate(names)}
        self.weights, self.bias, self.leak, self.n_for = weights, bias, leak, len(names) if n_for is None else n_for
        self.seen: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            got = self.seen[word] = tuple(self.index[f] for f in features(word) if f in self.index)
        return got

    def bag(self, text: str) -> list[tuple[int, int, list[int]]]:
        """Span and features of each sentence that has one that leans toxic."""
        low, of, n_for = lowered(text), self.of, self.n_for
        if not any(i < n_for for w in set(WORD.findall(low)) for i in of(w)):
            return []
        found = ((a, z, sorted({i for w in WORD.findall(low[a:z]) for i in of(w)})) for a, z in sentences(low))
        return [(a, z, f) for a, z, f in found if f and f[0] < n_for]

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and span and score of each sentence of 0.5 or more, in code points of the text."""
        found = self.bag(text)
        if not found:
            return self.leak, []
        z = np.array([self.bias + self.weights[f].sum() for _, _, f in found])
        total = np.logaddexp(0, z).sum() - np.log1p(-self.leak)
        p = 1 / (1 + np.exp(-z))
        return float(-np.expm1(-total)), [(a, e, float(x)) for (a, e, _), x in zip(found, p, strict=True) if x >= 0.5]


class Loss:
    """The mean noisy-or log loss of bags (label, features of each sentence), classes weighted alike, and its gradient."""

    def __init__(self, bags: list[tuple[int, list[list[int]]]], n: int, leak: float = LEAK):
        self.n, self.leak = n, leak
        self.y = np.array([b[0] for b in bags], float)
        self.sent_doc = np.array([d for d, b in enumerate(bags) for _ in b[1]], int)
        self.feat = np.array([f for b in bags for s in b[1] for f in s], int)
        self.feat_sent = np.repeat(np.arange(len(self.sent_doc)), [len(s) for b in bags for s in b[1]])
        self.weight = np.where(self.y > 0, 0.5 / max(self.y.sum(), 1), 0.5 / max((1 - self.y).sum(), 1))

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """w: a weight a feature, then the bias."""
        z = w[self.n] + np.bincount(self.feat_sent, w[self.feat], len(self.sent_doc))
        s = np.bincount(self.sent_doc, np.logaddexp(0, z), len(self.y)) - np.log1p(-self.leak)  # -log of the chance that no sentence is toxic
        loss = float((self.weight * np.where(self.y > 0, -np.log(-np.expm1(-s)), s)).sum())
        push = self.weight * np.where(self.y > 0, -1 / np.expm1(np.minimum(s, 50)), 1.0)  # d loss / d s
        gz = push[self.sent_doc] / (1 + np.exp(-z))
        return loss, np.append(np.bincount(self.feat, gz[self.feat_sent], self.n)[: self.n], gz.sum())


def train(bags: list[tuple[int, list[list[int]]]], evidence: np.ndarray, prior: float, leak: float = LEAK, steps: int = 400, rate: float = 0.1, n_for: int | None = None) -> tuple[np.ndarray, float]:
    """bags: (label, features of each sentence that has any). Adam on the loss. Weights of the first n_for features are
    0 or more, for they are marks of toxic documents, the others' 0 or less. The more evidence a feature has (above 0), the less its weight
    pays (L1, prior over evidence) and the larger its steps are, so that marks are found before words that happen to stand beside them."""
    n, evidence = len(evidence), np.maximum(evidence, 1e-6)
    n_for = n if n_for is None else n_for
    pay, step = prior / evidence, rate * np.append(evidence / max(evidence.max(initial=0), 1e-9), 1.0)
    loss = Loss(bags, n, leak)
    w = np.zeros(n + 1)
    w[n] = -2.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        g = loss(w)[1]
        g[:n] += pay * np.where(np.arange(n) < n_for, 1.0, -1.0) * (w[:n] != 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:n_for], w[n_for:n] = np.maximum(w[:n_for], 0), np.minimum(w[n_for:n], 0)
    return np.where(np.abs(w[:n]) < 0.05, 0.0, w[:n]), float(w[n])


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Fitted on a sample, by hash of doc_id, of at most fit_docs labelled documents of each class."""
    y = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    y = y.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0").withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    parts = [y.where(F.col("toxic") == k).orderBy("h").limit(fit_docs) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("label_id"), "toxic")
    sample = texts(docs).join(hinted(chosen), F.col("doc_id") == F.col("label_id")).select("toxic", "text")
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])

    def count(batches):
        for b in batches:
            total: Counter = Counter()
            for t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[("", t)] += 1
                for f in {f for w in set(WORD.findall(text.lower())) for f in features(w)}:
                    total[(f, t)] += 1
            yield batch(schema, [k for k, _ in total], [t for _, t in total], list(total.values()))

    counts = sample.mapInArrow(tidied(count), "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n"))
    counts = counts.persist()
    total = counts.where("feature = ''").first()
    n_pos, n_neg = (total["p"], total["n"]) if total else (0, 0)
    if not n_pos or not n_neg:
        counts.unpersist()
        return Model([], np.zeros(0), 0.0, n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.0)
    p, n, share = F.col("p"), F.col("n"), n_pos / (n_pos + n_neg)
    likelihood = 2 * (F.when(p > 0, p * F.log(p / ((p + n) * share))).otherwise(0.0) + F.when(n > 0, n * F.log(n / ((p + n) * (1 - share)))).otherwise(0.0))
    marks = counts.where(F.col("feature") != "").select("feature", (p / n_pos > n / n_neg).alias("toxic"), likelihood.alias("g"))
    rows = [r for lean, most in ((True, FEATURES), (False, AGAINST)) for r in marks.where(F.col("toxic") == lean).orderBy(F.desc("g"), "feature").limit(most).collect()]
    counts.unpersist()
    n_for = sum(r["toxic"] for r in rows)
    model = Model([r["feature"] for r in rows], np.zeros(len(rows)), 0.0, n_for=n_for)
    bag_schema = pa.schema([("toxic", pa.int32()), ("bags", pa.list_(pa.list_(pa.int32())))])

    def bags(batches):
        for b in batches:
            got = [sorted({tuple(f) for _, _, f in model.bag(t)}) for t in b.column(1).to_pylist()]  # a sentence that comes again says nothing new
            yield batch(bag_schema, b.column(0), [[list(f) for f in x] for x in got])

    found = sample.mapInArrow(tidied(bags), "toxic int, bags array<array<int>>").collect()  # bounded by fit_docs
    found = sorted((r["toxic"], r["bags"]) for r in found)
    once = -2 * np.log(share)  # the ratio of a feature seen in one toxic document and no clean one
    weights, bias = train(found, np.array([r["g"] for r in rows], float) / once, PRIOR / n_pos, n_for=n_for)
    kept = np.flatnonzero(weights)
    return Model([rows[i]["feature"] for i in kept], weights[kept], bias, n_for=int((kept < n_for).sum()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_key, held_out, score, predicted, spans (start, end, score of the offending sentences)."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(span))])

    def run(batches):
        for b in batches:
            got = [model.score(t) for t in b.column(1).to_pylist()]
            yield batch(schema, b.column(0), b.column(2), b.column(3), [s for s, _ in got], [int(s >= 0.5) for s, _ in got], [[dict(zip(("start", "end", "score"), x, strict=True)) for x in found] for _, found in got])

    held = F.coalesce(F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0"), F.lit(False))
    rows = texts(docs).withColumns({"text_key": F.xxhash64("text"), "held_out": held})
    return rows.mapInArrow(tidied(run), "doc_id long, text_key long, held_out boolean, score double, predicted int, spans array<struct<start: long, end: long, score: double>>")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with work(spark) as keep:
        found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
        return keep(found.select("doc_id", "held_out", "score", "predicted", F.to_json("spans").alias("spans")), "toxicity")


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go."""
    from tessera.llm.exact_dedup import without

    with work(spark) as keep:
        gone = keep(score(docs, fit(docs, table(spark, sf_dir, "labels"))).where("predicted = 1").select("doc_id", "text_key"), "toxic")
    return without(docs, gone, gone.limit(0))
