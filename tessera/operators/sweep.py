"""Mutual best among close rows, by a sweep over keys in bins of their values and not over pairs.

Python on executors, as in llm: the nearest value among greater keys only has no built-in expression that needs no pairs.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEST = pa.schema([("k", pa.int64()), ("s", pa.string()), ("of", pa.string()), ("gap", pa.float64()), ("other", pa.int64())])
BEST_DDL = "k long, s string, of string, gap double, other long"


class Nearest:
    """Different values of rows seen, each with its smallest key."""

    def __init__(self):
        self.values: list[float] = []
        self.keys: dict[float, int] = {}

    def add(self, v: float, k: int) -> None:
        if v not in self.keys:
            insort(self.values, v)
            self.keys[v] = k
        elif k < self.keys[v]:
            self.keys[v] = k

    def best(self, v: float, tol: float):
        """(gap in cents, key) of the nearest value within a share of the larger; of equal gaps the smallest key."""
        found, at = None, bisect_left(self.values, v)
        for places in (range(at - 1, -1, -1), range(at, len(self.values))):
            for i in places:
                x = self.values[i]
                gap = math.floor(abs(v - x) * 100 + 0.5) / 100
                if abs(v - x) > tol * max(v, x) or (found is not None and gap > found[0]):
                    break
                if found is None or (gap, self.keys[x]) < found:
                    found = (gap, self.keys[x])
        return found


def swept(tol: float):
    """Of rows (g, bin, k, s, v, home), sorted by g, bin and k either way, the best of each other s among the rows before, for each row at home."""

    def run(batches):
        now, seen, same, k0 = None, {}, [], None
        for b in batches:
            out = []
            for g, bin_, k, s, v, home in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (g, bin_) != now:
                    now, seen, same, k0 = (g, bin_), {}, [], k
                if k != k0:  # rows of one key don't meet
                    for one, x, key in same:
                        seen.setdefault(one, Nearest()).add(x, key)
                    same, k0 = [], k
                if home:
                    for of, nearest in seen.items():
                        found = nearest.best(v, tol) if of != s else None
                        if found is not None:
                            out.append((k, s, of, *found))
                same.append((s, v, k))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), BEST.types, strict=True)], schema=BEST)

    return run


def mutual_close(df: DataFrame, tol: float) -> DataFrame:
    """(a, b) of rows (g, k, s, v), v > 0: a < b, equal g, different s, values that differ by at most a share of the larger, and each the other's best
    (by gap in cents, then key) in its s among greater keys for a, smaller ones for b. Values that are no number are left out.

    A worker holds the different values of one bin, as wide as the tolerance, and of both beside it.
    """
    width = -math.log(1 - tol)
    rows = df.where("g IS NOT NULL AND k IS NOT NULL AND s IS NOT NULL AND v > 0 AND v < double('infinity')")
    rows = rows.select("g", F.floor(F.ln("v") / width).alias("at"), F.col("k").cast("long").alias("k"), "s", "v")
    there = rows.withColumn("bin", F.explode(F.array(*[F.col("at") + d for d in (-1, 0, 1)]))).select("g", "bin", "k", "s", "v", (F.col("bin") == F.col("at")).alias("home"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = there.repartition(max(parts, 32), "g", "bin")

    def best(order):
        got = dealt.sortWithinPartitions("g", "bin", order).mapInArrow(swept(tol), BEST_DDL)
        return got.groupBy("k", "of").agg(F.min(F.struct("gap", "other", "s")).alias("m")).select("k", "of", "m.gap", "m.other", "m.s")

    x, y = best(F.desc("k")).alias("x"), best(F.asc("k")).alias("y")
    on = (F.col("x.k") == F.col("y.other")) & (F.col("x.other") == F.col("y.k")) & (F.col("x.s") == F.col("y.of")) & (F.col("x.of") == F.col("y.s"))
    return x.join(y, on).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"))
