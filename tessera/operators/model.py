"""A ridge regression on 0/1 terms, by normal equations that the cluster sums up."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import quantiles


def terms(df: DataFrame, factors: list[str]) -> DataFrame:
    """df with terms: factor=value strings, the most frequent value of each factor (ties by name) left out as reference.

    References are found by one aggregation over factors, a row for each factor; numbers of values are bounded by the
    factors' design (bands, pooled levels), not by the rows.
    """
    long = df.select(F.explode(F.array(*[F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("?"))) for f in factors])).alias("t"))
    counted = long.groupBy("t").agg(F.count("*").alias("n")).withColumn("f", F.substring_index("t", "=", 1))
    refs = [r["t"] for r in counted.groupBy("f").agg(F.min(F.struct(-F.col("n"), F.col("t").alias("t"))).alias("m")).select("m.t").collect()]
    all_ = F.array(*[F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("?"))) for f in factors])
    return df.withColumn("terms", F.array_sort(F.filter(all_, lambda t: ~t.isin(*refs))))


def _sums(df: DataFrame, y: str, *by: str) -> list:
    """Counts and sums of y by pairs of terms, '' the intercept, and by; all that normal equations need. They aggregate before anything moves."""
    full = df.select(*by, F.col(y).cast("double").alias("y"), F.concat(F.array(F.lit("")), "terms").alias("t"))
    pairs = full.select(*by, "y", F.explode("t").alias("a"), "t").select(*by, "y", "a", F.explode("t").alias("b")).where("a <= b")
    return pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")).collect()  # terms squared at most


def _equations(sums, names: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    at = {n: i for i, n in enumerate(names)}
    xx, xy, yy = np.zeros((len(names),) * 2), np.zeros(len(names)), 0.0
    for a, b, n, sy, syy in sums:
        xx[at[a], at[b]] = xx[at[b], at[a]] = n
        if a == b:
            xy[at[a]] = sy
        if a == b == "":
            yy = syy
    return xx, xy, yy


def _solved(xx: np.ndarray, xy: np.ndarray, names: list[str], ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and the inverse; terms without rows get 0."""
    used = np.diag(xx) > 0
    penalty = np.where(np.array(names) == "", 0.0, ridge)
    inverse, beta = np.zeros_like(xx), np.zeros(len(names))
    if used.any():
        inverse[np.ix_(used, used)] = np.linalg.inv((xx + np.diag(penalty))[np.ix_(used, used)])
        beta = inverse @ xy
    return beta, inverse


def fit(df: DataFrame, y: str, ridge: float = 1.0) -> dict[str, tuple[float, float]]:
    """term to (coefficient, standard error); '' is the intercept, which the ridge spares. df has terms."""
    sums = [(r["a"], r["b"], r["n"], r["sy"], r["syy"]) for r in _sums(df, y)]
    names = sorted({r[0] for r in sums} | {r[1] for r in sums})
    if not names:
        return {}
    xx, xy, yy = _equations(sums, names)
    beta, inverse = _solved(xx, xy, names, ridge)
    n = xx[names.index(""), names.index("")]
    sse = max(0.0, yy - 2 * beta @ xy + beta @ xx @ beta)
    error = np.sqrt(np.maximum(0, np.diag(inverse)) * sse / max(n - len(names), 1))
    return {k: (float(b), float(e)) for k, b, e in zip(names, beta, error, strict=True)}


def fit_folds(df: DataFrame, y: str, ridges: tuple[float, ...]) -> dict[int, dict[str, list[float]]]:
    """Of each fold the coefficients, one for each ridge, fitted on all other folds: one pass, for sums over folds subtract. df has fold, terms."""
    sums = _sums(df, y, "fold")
    names = sorted({r["a"] for r in sums} | {r["b"] for r in sums})
    folds = sorted({r["fold"] for r in sums})
    own = {f: _equations([(r["a"], r["b"], r["n"], r["sy"], r["syy"]) for r in sums if r["fold"] == f], names) for f in folds}
    xx, xy = (sum(own[f][k] for f in folds) for k in (0, 1)) if folds else (None, None)
    out = {}
    for f in folds:
        each = [_solved(xx - own[f][0], xy - own[f][1], names, r)[0] for r in ridges]
        out[f] = {n: [float(b[i]) for b in each] for i, n in enumerate(names)}
    return out


def predict_folds(df: DataFrame, coefficients: dict[int, dict[str, list[float]]], n: int) -> DataFrame:
    """df with predictions, an array of n: each row by the coefficients that were fitted without its fold."""
    flat = {f"{f}|{t}": b for f, of in coefficients.items() for t, b in of.items()}
    of = F.from_json(F.lit(json.dumps(flat)), "map<string, array<double>>")
    none = F.array(*[F.lit(0.0)] * n)
    add = lambda s, t: F.zip_with(s, F.coalesce(of[F.concat(F.col("fold").cast("string"), F.lit("|"), t)], none), lambda a, b: a + b)
    return df.withColumn("predictions", F.aggregate(F.concat(F.array(F.lit("")), "terms"), none, add))


def blended(model: Column, baseline: Column, weight: float) -> Column:
    """A model's and a baseline's price averaged on the log scale."""
    return F.exp(weight * F.ln(model) + (1 - weight) * F.ln(baseline))


def chosen(errors: list[tuple], gain: float = 0.001) -> tuple:
    """The first of (setting, error), in order of preference, that no later one betters by more than a share of gain."""
    best = errors[0]
    for e in errors[1:]:
        if e[-1] < best[-1] * (1 - gain):
            best = e
    return best


def paired_bootstrap(sums: list[tuple[float, float, int]], rounds: int = 2_000, seed: int = 42) -> dict[str, float]:
    """The mean difference of two errors, its 95 % interval, and how often the first is not the larger: blocks of rows, as (sum of the first,
    sum of the second, rows), are drawn anew rounds times."""
    a, b, n = (np.array(x, float) for x in zip(*sums, strict=True))
    picks = np.random.default_rng(seed).integers(0, len(n), (rounds, len(n)))
    means = (a - b)[picks].sum(1) / n[picks].sum(1)
    low, high = np.quantile(means, (0.025, 0.975))
    return {"difference": float((a - b).sum() / n.sum()), "low": float(low), "high": float(high), "not_larger": float((means <= 0).mean())}


def predict(df: DataFrame, coefficients: dict[str, tuple[float, float]]) -> DataFrame:
    """df with predicted: the sum of the coefficients of a row's terms, from a literal map."""
    of = F.from_json(F.lit(json.dumps({k: b for k, (b, _) in coefficients.items()})), "map<string, double>")
    return df.withColumn("predicted", F.aggregate(F.concat(F.array(F.lit("")), "terms"), F.lit(0.0), lambda s, t: s + F.coalesce(of[t], F.lit(0.0))))


def metrics(df: DataFrame, actual: str, *predicted: str) -> DataFrame:
    """which, n, mae, mape, median_ape and r2_log of positive values, a row for each prediction; df should be stored. No task holds the errors."""
    a = F.col(actual)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("which"), F.col(p).cast("double").alias("p")) for p in predicted]))
    d = df.select(a.alias("a"), each.alias("s")).select("a", "s.which", "s.p")
    d = d.withColumn("ape", F.abs(F.col("p") - F.col("a")) / F.col("a"))
    la, lp = F.ln("a"), F.ln("p")
    r2 = 1 - F.sum(F.pow(la - lp, 2)) / F.nullif(F.var_pop(la) * F.count("*"), F.lit(0.0))
    sums = d.groupBy("which").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("p") - F.col("a"))).alias("mae"), F.avg("ape").alias("mape"), r2.alias("r2_log"))
    every = df.sparkSession.createDataFrame([(p,) for p in predicted], "which string")
    median = quantiles(d, ["which"], "ape", (0.5,)).select("which", F.col("q")[0].alias("median_ape"))
    return every.join(F.broadcast(sums), "which", "left").join(F.broadcast(median), "which", "left").select("which", F.coalesce("n", F.lit(0)).alias("n"), "mae", "mape", "median_ape", "r2_log")  # a row a prediction


# ---- tests on counts ----


def two_proportions(x1: int, n1: int, x2: int, n2: int) -> dict[str, float]:
    """Difference, z, two-sided p and relative risk."""
    p1, p2, p = x1 / n1, x2 / n2, (x1 + x2) / (n1 + n2)
    se = math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    z = (p1 - p2) / se if se else 0.0
    return {"difference": p1 - p2, "z": z, "p": math.erfc(abs(z) / math.sqrt(2)), "risk_ratio": p1 / p2 if p2 else math.inf}


def mann_whitney(counts: DataFrame) -> DataFrame:
    """u, z of the first group from (value, n1, n2), corrected for ties: mid-ranks are cumulative sums, not a sort of rows."""
    from pyspark.sql import Window

    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("n1") + F.col("n2")
    ranked = counts.withColumn("t", t).withColumn("rank", F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2)
    s = ranked.agg(F.sum("n1").alias("a"), F.sum("n2").alias("b"), F.sum(F.col("n1") * F.col("rank")).alias("r"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("a") + F.col("b")
    u = F.col("r") - F.col("a") * (F.col("a") + 1) / 2
    sd = F.sqrt(F.col("a") * F.col("b") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return s.select(u.alias("u"), ((u - F.col("a") * F.col("b") / 2) / sd).alias("z"))


def mantel_haenszel(tables: DataFrame) -> DataFrame:
    """Common odds ratio and chi-square over strata (a, b, c, d)."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    expected, variance = (a + b) * (a + c) / n, (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))
    return tables.where("a + b + c + d > 1").agg((F.sum(a * d / n) / F.sum(b * c / n)).alias("odds_ratio"), (F.pow(F.abs(F.sum(a - expected)), 2) / F.sum(variance)).alias("chi2"))
