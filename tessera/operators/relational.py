"""Small relational operators that the plans share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import stored

#: Bins of a range in which a quantile is sought, rows of a range that are ranked at once, rounds at most.
BINS, RANKED, ROUNDS = 1024, 1_000_000, 8


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Catalyst limits the window's groups before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def band(value: Column, edges: list[float | None]) -> Column:
    """1-based half-open bands [edge, next); -1 for null, NaN, 0 or less."""
    out = F.lit(-1)
    for k in range(len(edges) - 1, 0, -1):
        low, high = edges[k - 1], edges[k]
        out = F.when((value >= low) & (value < high) if high is not None else value >= low, k).otherwise(out)
    return F.when(value.isNull() | F.isnan(value) | (value <= 0), -1).otherwise(out)


def contiguous(edges: DataFrame) -> DataFrame:
    """Rows of (dimension, band_key, lower, upper) whose upper edge is not the next one's lower."""
    w = Window.partitionBy("dimension").orderBy("band_key")
    return edges.withColumn("next_lower", F.lead("lower").over(w)).where(~F.col("upper").eqNullSafe(F.col("next_lower")))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]), lambda x: x.isNotNull())


def quartiles(c: str, digits: int = 4) -> list[Column]:
    return [F.round(F.percentile(c, F.lit(p)), digits).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]


def with_unknown(df: DataFrame, **unknown) -> DataFrame:
    """df and one unknown member, other columns null."""
    row = df.sparkSession.range(1).select(*[F.lit(unknown.get(n)).cast(t).alias(n) for n, t in df.dtypes])
    return row.unionByName(df)


def position(value: Column, low: Column, high: Column) -> Column:
    """Below, inside or above a range; no data where one is missing."""
    return F.when(value.isNull() | low.isNull() | high.isNull(), "no_data").when(value < low, "below").when(value > high, "above").otherwise("inside")


def peers(df: DataFrame, value: str, levels: list[list[str]], least: int) -> DataFrame:
    """df with the quartiles of value in the finest level whose group holds at least least rows: level, p25, p50, p75, peers."""
    out = df
    for k, keys in enumerate(levels):
        g = df.groupBy(*keys).agg(F.count("*").alias(f"n{k}"), F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"q{k}")).where(f"n{k} >= {least}")
        out = out.join(g, keys, "left")
    first = lambda f: F.coalesce(*[f(k) for k in range(len(levels))])
    level = reduce(lambda acc, k: F.when(F.col(f"n{k}").isNotNull(), k).otherwise(acc), range(len(levels) - 1, -1, -1), F.lit(-1))
    got = [first(lambda k, i=i: F.col(f"q{k}")[i]).alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
    return out.select(*df.columns, level.alias("level"), first(lambda k: F.col(f"n{k}")).alias("peers"), *got)


def quantiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, q): exact quantiles, interpolated between neighbours, of each group's values that are neither null nor NaN; groups may be few and
    of any size.

    Counts in bins of a group's range say which bin holds a rank; that bin is the next range, until what is left can be ranked.
    No task holds a group: what moves are counts, and at last the different values of small ranges.
    """
    df = df.select(*by, F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    ends = df.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    rank = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("n") - 1)).alias("r")) for i, p in enumerate(shares)]))
    both = ends.select(*by, "lo", "hi", "n", rank.alias("s")).select(*by, F.col("s.i").alias("i"), F.col("s.r").alias("r"), "lo", "hi", "n", F.explode(F.array_distinct(F.array(F.floor("s.r"), F.ceil("s.r")))).alias("at"))
    # a target: the place at of a group's order lies in [lo, hi], below which before rows are
    targets = stored(both.withColumns({"before": F.lit(0).cast("long"), "inside": F.col("n")}), "quantile-targets")
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by], F.lit(True))
    for _ in range(ROUNDS):
        if targets.where(f"inside > {RANKED} AND lo < hi").isEmpty():
            break
        ranges = targets.select(*by, "lo", "hi").distinct()
        width = (F.col("t.hi") - F.col("t.lo")) / BINS
        bin_ = F.when(width > 0, F.least(F.floor((F.col("d.x") - F.col("t.lo")) / width), F.lit(BINS - 1))).otherwise(0)
        hit = df.alias("d").join(F.broadcast(ranges).alias("t"), same("d", "t") & F.col("d.x").between(F.col("t.lo"), F.col("t.hi")))  # two ranges a share and group
        counts = hit.groupBy(*[F.col(f"t.{c}").alias(c) for c in by], F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"), bin_.alias("bin")).agg(F.count("*").alias("k"), F.min("d.x").alias("a"), F.max("d.x").alias("z"))
        below = F.coalesce(F.sum("k").over(Window.partitionBy(*by, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        c, t = counts.withColumn("below", below).alias("c"), targets.alias("t")
        on = same("c", "t") & (F.col("c.lo") == F.col("t.lo")) & (F.col("c.hi") == F.col("t.hi")) & (F.col("t.at") >= F.col("t.before") + F.col("c.below")) & (F.col("t.at") < F.col("t.before") + F.col("c.below") + F.col("c.k"))
        narrowed = t.join(c, on).select(*[F.col(f"t.{x}") for x in by], "t.i", "t.r", F.col("c.a").alias("lo"), F.col("c.z").alias("hi"), "t.n", "t.at", (F.col("t.before") + F.col("c.below")).alias("before"), F.col("c.k").alias("inside"))
        targets = stored(narrowed, "quantile-targets")
    ranges = targets.select(*by, "lo", "hi").distinct()
    kept = df.alias("d").join(F.broadcast(ranges).alias("t"), same("d", "t") & F.col("d.x").between(F.col("t.lo"), F.col("t.hi")))
    values = kept.groupBy(*[F.col(f"t.{c}").alias(c) for c in by], F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"), F.col("d.x").alias("x")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*by, "lo", "hi").orderBy("x"))
    c, t = values.withColumn("upto", upto).alias("c"), targets.alias("t")
    on = same("c", "t") & (F.col("c.lo") == F.col("t.lo")) & (F.col("c.hi") == F.col("t.hi")) & (F.col("t.at") >= F.col("t.before") + F.col("c.upto") - F.col("c.k")) & (F.col("t.at") < F.col("t.before") + F.col("c.upto"))
    found = t.join(c, on).select(*[F.col(f"t.{x}") for x in by], "t.i", "t.r", "t.at", "c.x")
    low, high = F.min_by("x", "at"), F.max_by("x", "at")
    each = found.groupBy(*by, "i").agg((low + (high - low) * (F.first("r") - F.floor(F.first("r")))).alias("x"))
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("q"))  # one entry a share


def discrete_quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, int, int]]) -> DataFrame:
    """(by, names): of each name's (value, num, den) the least value with at least num / den of a group's values not above it, exactly;
    null where a group has none. NaN is the greatest. What moves are counts of different values, ordered within a group."""
    each = F.array(*[F.struct(F.lit(k).alias("i"), F.col(c).cast("double").alias("x")) for k, (c, _, _) in enumerate(wanted.values())])
    counts = df.select(*by, F.explode(each).alias("s")).groupBy(*by, F.col("s.i").alias("i"), F.col("s.x").alias("x")).agg(F.count("s.x").alias("k"))
    w = Window.partitionBy(*by, "i")
    upto = counts.withColumns({"upto": F.sum("k").over(w.orderBy("x")), "all": F.sum("k").over(w)}).where("k > 0 OR all = 0")
    least = lambda k, c, num, den: F.min(F.when((F.col("i") == k) & (F.col("upto") * den >= F.col("all") * num), F.col("x"))).cast(df.schema[c].dataType)
    return upto.groupBy(*by).agg(*[least(k, *q).alias(n) for k, (n, q) in enumerate(wanted.items())])


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with place, from 0, in the whole order: ranges are sorted apart, and a count for each says where it begins."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    starts, at = {}, 0
    for r in sorted(rows.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # a row a range
        starts[r["_part"]], at = at, at + r["n"]
    begins = F.broadcast(spark.createDataFrame(list(starts.items()), "_begins long, _start long")) if starts else None
    if begins is None:
        return df.withColumn("place", F.lit(0).cast("long"))
    w = Window.partitionBy("_part").orderBy(*order)
    return rows.join(begins, F.col("_part") == F.col("_begins")).withColumn("place", F.col("_start") + F.row_number().over(w) - 1).drop("_part", "_begins", "_start")


def pareto(df: DataFrame, key: str, group: list[str], low: list[str], high: list[str]) -> DataFrame:
    """Rows that no other row of their group beats: as good everywhere and better somewhere. Equal rows stay.

    Two measures need no pairs: of each value of the first only the best of the second can stay, and stays if it is better than all
    before. With more measures, rows of equal ones are first made one, and a group's different ones are compared.
    """
    measures = low + high
    if len(measures) == 2:
        first, second = ([(c, 1) for c in low] + [(c, -1) for c in high])[:2]
        a, b = F.col(first[0]) * first[1], F.col(second[0]) * second[1]
        best = df.where(a.isNotNull() & b.isNotNull()).groupBy(*group, a.alias("_a")).agg(F.min(b).alias("_b"))
        before = F.min("_b").over(Window.partitionBy(*group).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1))
        front = best.withColumn("_before", before).where("_before IS NULL OR _b < _before").select(*[F.col(c).alias(f"_{c}") for c in group], "_a", "_b")
        on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group], (a == F.col("_a")) & (b == F.col("_b")))
        return df.join(front, on, "left_semi")
    distinct = df.select(*group, *measures).distinct()
    a, b = distinct.alias("a"), distinct.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group])
    no_worse = reduce(lambda x, y: x & y, [F.col(f"b.{c}") <= F.col(f"a.{c}") for c in low] + [F.col(f"b.{c}") >= F.col(f"a.{c}") for c in high])
    better = reduce(lambda x, y: x | y, [F.col(f"b.{c}") < F.col(f"a.{c}") for c in low] + [F.col(f"b.{c}") > F.col(f"a.{c}") for c in high])
    front = a.join(b, same & no_worse & better, "left_anti")
    on = reduce(lambda x, y: x & y, [df[c].eqNullSafe(front[c]) for c in group + measures])
    return df.join(front, on, "left_semi")


def close_pairs(df: DataFrame, key: str, equal: list[str], bins: dict[str, float], residual: Column | None = None) -> DataFrame:
    """Pairs (a, b) of rows that agree on equal and whose measures differ by at most a share of the larger.

    Equi-join on log bins of width -ln(1 - tolerance), the left side in its bin and both next to it, so the
    plan is a hash join; the exact condition stands behind it. residual may use columns of l and r.
    """
    bin_of = lambda c, tol: F.floor(F.ln(F.col(c)) / -F.ln(F.lit(1 - tol)))
    left, right = df, df
    for c, tol in bins.items():
        left = left.withColumn(f"_b_{c}", F.explode(F.array(*[bin_of(c, tol) + d for d in (-1, 0, 1)])))
        right = right.withColumn(f"_b_{c}", bin_of(c, tol))
    left, right = left.alias("l"), right.alias("r")
    on = reduce(lambda x, y: x & y, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in equal + [f"_b_{c}" for c in bins]])
    for c, tol in bins.items():
        on &= F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) <= tol * F.greatest(f"l.{c}", f"r.{c}")
    on &= F.col(f"l.{key}") < F.col(f"r.{key}")
    return left.join(right, on & residual if residual is not None else on)


def mutual_best(pairs: DataFrame, a: str, b: str, source_a: str, source_b: str, order: list[Column]) -> DataFrame:
    """Pairs that are each side's best in the other's source."""
    one = Window.partitionBy(a, source_b).orderBy(*order, F.col(b))
    two = Window.partitionBy(b, source_a).orderBy(*order, F.col(a))
    return pairs.withColumns({"_x": F.row_number().over(one), "_y": F.row_number().over(two)}).where("_x = 1 AND _y = 1").drop("_x", "_y")


def nearest(left: DataFrame, right: DataFrame, n: int = 1, digits: int | None = None, other: bool = False) -> DataFrame:
    """(a, b, gap): for each row of left (g, v, k) candidates of right (g, v, k) in the same g, among them all of the n best by gap = |difference
    of v|, then by k; missing gaps last. digits rounds gaps before they are compared, other leaves out b = a. One row stands for equal v.

    No pairs within a group: different values in order show the next ones on both sides, values that are no number meet one
    row for each kind. Values that rounding makes as near as the nearest are found by cells of that width.
    """
    depth = n + other
    odd = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))
    left, right = (d.select("g", F.col("v").cast("double").alias("v"), "k").where("g IS NOT NULL" + (" AND k IS NOT NULL" if other else "")) for d in (left, right))
    copies = right.groupBy("g", "v", "k").agg(F.least(F.count("*"), F.lit(n)).cast("int").alias("c"))

    def smallest(d: DataFrame, v: Column, *by: str) -> DataFrame:
        """The depth smallest keys of each group, with how often each counts."""
        first = d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("k")))).where(f"_r <= {depth}")
        return first.groupBy(*by).agg(F.collect_list(F.struct("k", "c")).alias("ks"), v.alias("w"))

    targets = stored(smallest(copies, F.first("v"), "g", "v").select("g", F.col("w").alias("v"), "ks"), "nearest-targets")
    asked = left.select("g", "v").distinct()
    # other values in order
    up, down = Window.partitionBy("g").orderBy("v"), Window.partitionBy("g").orderBy(F.desc("v"))
    me = F.struct("v", "ks")
    beside = lambda w: F.filter(F.array(me, *[F.lag(me, i).over(w) for i in range(1, depth)]), lambda x: x.isNotNull())
    marks = targets.where(~odd(F.col("v"))).select("g", "v", beside(up).alias("low"), beside(down).alias("high"), F.lit(False).alias("ask"))
    none = F.lit(None).cast(marks.schema["low"].dataType)
    points = marks.unionByName(asked.where(~odd(F.col("v"))).select("g", "v", none.alias("low"), none.alias("high"), F.lit(True).alias("ask")))
    points = points.groupBy("g", "v").agg(F.first("low", True).alias("low"), F.first("high", True).alias("high"), F.max("ask").alias("ask"))
    points = points.withColumns({"low": F.last("low", True).over(up), "high": F.last("high", True).over(down)}).where("ask")
    found = points.select("g", "v", F.explode(F.array_distinct(F.concat(F.coalesce("low", F.array()), F.coalesce("high", F.array())))).alias("t")).select("g", "v", F.col("t.v").alias("w"), F.col("t.ks").alias("ks"))
    gap = F.abs(F.col("v") - F.col("w"))
    gap = gap if digits is None else F.round(gap, digits)
    if digits is not None:
        cell = lambda c: F.floor(c * 10.0**digits)
        best = found.groupBy("g", "v").agg(F.min(gap).alias("best"))
        cells = F.array_distinct(F.flatten(F.array(*[F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d, x=x: cell(x) + d) for x in (F.col("v") - F.col("best"), F.col("v") + F.col("best"))])))
        there = targets.where(~odd(F.col("v"))).select(F.col("g").alias("h"), F.col("v").alias("w"), "ks", cell(F.col("v")).alias("at"))
        also = best.withColumn("cell", F.explode(cells)).join(there, (F.col("g") == F.col("h")) & (F.col("cell") == F.col("at"))).where(gap == F.col("best")).select("g", "v", "w", "ks")
        found = found.unionByName(also)
    # kinds of values that are no number, and the numbers as one kind
    kinds = targets.where(odd(F.col("v"))).select("g", F.col("v").alias("w"), "ks").unionByName(smallest(copies.where(~odd(F.col("v"))), F.first("v"), "g").select("g", "w", "ks"))
    far = asked.join(kinds, "g").where(odd(F.col("v")) | odd(F.col("w"))).select("g", "v", "w", "ks")
    each = found.unionByName(far).select("g", "v", "w", gap.alias("gap"), F.explode("ks").alias("s")).distinct()
    each = each.select(F.col("g").alias("h"), F.col("v").alias("x"), "gap", F.col("s.k").alias("b"), F.explode(F.array_repeat(F.lit(0), F.col("s.c"))).alias("copy"))
    out = left.join(each, (F.col("g") == F.col("h")) & F.col("v").eqNullSafe(F.col("x"))).select(F.col("k").alias("a"), "b", "gap")
    return out.where("a <> b") if other else out


def fingerprint(df: DataFrame) -> DataFrame:
    """rows and two order-independent sums of row hashes: equal for equal multisets, whatever the order or partitioning."""
    h = F.conv(F.substring(F.md5(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})), 1, 12), 16, 10).cast("bigint")
    return df.select(h.alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def aggregate(df: DataFrame, spec: dict) -> DataFrame:
    """One chart's query: where, dimensions, metrics (name to SQL), having, order and limit."""
    if spec.get("where"):
        df = df.where(spec["where"])
    out = df.groupBy(*[F.expr(d) for d in spec.get("dimensions", [])]).agg(*[F.expr(m).alias(n) for n, m in spec["metrics"].items()])
    if spec.get("having"):
        out = out.where(spec["having"])
    if spec.get("order"):
        out = out.orderBy(*[F.expr(o[0]).desc() if o[1] == "desc" else F.expr(o[0]).asc() for o in spec["order"]])
    return out.limit(spec["limit"]) if spec.get("limit") else out


def failures(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """(name, failed, n): of each condition how many rows it does not hold for, null included; one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(k) for k, c in checks.items()])
    return one.unpivot(["n"], list(checks), "name", "failed").select("name", "failed", "n")
