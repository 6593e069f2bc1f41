"""Composite operators: history, benchmarks, frontiers, duplicates, substitution, models, statistics, checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import values as v
from tessera.operators import graph, history, model, similar, sweep
from tessera.operators import relational as rel
from tessera.plans.registry import query
from tessera.plans.relational import BAND_SQL
from tessera.sources.tables import Versions, scratch, stored


def observations(t):
    """Events as observations: a user is a listing, a day a batch, the last event of a day counts."""
    d = t("events").select(F.col("user_id").alias("key"), F.to_date("ts").alias("day"), F.col("ts").alias("seen_at"), F.col("event_type").alias("hash"), F.col("value").alias("price"), "event_id")
    return rel.latest(d, ["key", "day"], [F.desc("seen_at"), F.desc("event_id")])


OBS = "o AS (SELECT user_id AS key, CAST(ts AS DATE) AS day, ts AS seen_at, event_type AS hash, value AS price FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)"
HISTORY = f"""WITH {OBS}, c AS (SELECT *, lag(hash) OVER (PARTITION BY key ORDER BY seen_at) AS b FROM o)
SELECT key, row_number() OVER w AS version, hash, seen_at AS valid_from, lead(seen_at) OVER w AS valid_to FROM c WHERE b IS NULL OR b <> hash WINDOW w AS (PARTITION BY key ORDER BY seen_at)"""


def shown(h):
    return h.select("key", F.col("version").cast("bigint").alias("version"), "hash", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"), F.col("valid_to").cast("timestamp_ntz").alias("valid_to"))


def scd_input(t):
    return observations(t).select("key", "seen_at", F.col("day").alias("batch"), "hash")


@query("k01_scd2_history", HISTORY)
def k01(t, s):
    return shown(history.history(scd_input(t)))


@query("k02_scd2_sync", HISTORY)
def k02(t, s):
    """Half of the batches first, then all: the merged history equals a rebuild."""
    obs, root = scd_input(t), scratch(s, "history")
    target, state = Versions(s, f"{root}/history"), Versions(s, f"{root}/state")
    done = [history.sync(obs.where("day(batch) <= 15"), target, state), history.sync(obs, target, state), history.sync(obs, target, state)]
    if done != ["FULL_REBUILD", "MERGE_AFFECTED_KEYS", "NO_CHANGE"]:
        raise ValueError(done)
    return shown(target.read())


@query("s17_s18_time_travel", "SELECT count(*) AS first_rows, count(DISTINCT user_id) AS keys FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE day(ts) <= 10) WHERE r = 1) WHERE b IS NULL OR b <> event_type")
def s17(t, s):
    obs, root = scd_input(t), scratch(s, "travel")
    target = Versions(s, root)
    first = target.commit(history.history(obs.where("day(batch) <= 10")), note="first")
    target.commit(history.history(obs), note="second")
    return target.read(first).agg(F.count("*").alias("first_rows"), F.count_distinct("key").alias("keys"))


@query("k15_lifecycle", f"""WITH {OBS}, e AS (SELECT key % 3 AS source, key, day, price FROM o), p AS (SELECT *, lag(price) OVER (PARTITION BY key ORDER BY day) AS b FROM e),
d AS (SELECT source, list_sort(list(DISTINCT day)) AS days FROM e GROUP BY 1)
SELECT p.source, key, min(day) AS first_seen, max(day) AS last_seen, count(*) AS n_obs, date_diff('day', min(day), max(day))::INTEGER AS span_days, count(*) FILTER (WHERE b > 0 AND price > 0 AND price <> b) AS price_changes,
 len(list_filter(any_value(days), lambda x: x > max(day)))::INTEGER AS missed, CASE len(list_filter(any_value(days), lambda x: x > max(day))) WHEN 0 THEN 'active' WHEN 1 THEN 'missed_one' ELSE 'absent' END AS status
FROM p JOIN d ON d.source = p.source GROUP BY 1, 2""".replace("len(list_filter(any_value(days), lambda x: x > max(day)))", "(SELECT count(*) FROM (SELECT unnest(any_value(days)) AS x) WHERE x > max(day))"))
def k15(t, s):
    e = observations(t).select((F.col("key") % 3).alias("source"), "key", "day", "price")
    return history.lifecycle(e, e.select("source", "day"))


@query("k16_repricing", f"WITH {OBS}, p AS (SELECT key, day, price, lag(price) OVER (PARTITION BY key ORDER BY day) AS b FROM o) SELECT CASE WHEN price > b THEN 'up' ELSE 'down' END AS move, CASE WHEN abs(price - b) / greatest(price, b) < 0.1 THEN 'small' ELSE 'large' END AS size, count(*) AS n FROM p WHERE b > 0 AND price > 0 AND price <> b GROUP BY 1, 2")
def k16(t, s):
    d = observations(t).withColumn("b", F.lag("price").over(Window.partitionBy("key").orderBy("day"))).where("b > 0 AND price > 0 AND price <> b")
    return d.groupBy(F.when(F.col("price") > F.col("b"), "up").otherwise("down").alias("move"), F.when(v.relative_gap(F.col("price"), F.col("b")) < 0.1, "small").otherwise("large").alias("size")).agg(F.count("*").alias("n"))


def offers(t):
    u = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return u.select("l_orderkey", "l_linenumber", "p_brand", "p_type", F.floor(F.col("p_size") / 10).cast("int").alias("size_band"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


OFFERS = "o AS (SELECT l_orderkey, l_linenumber, p_brand, p_type, p_size // 10 AS size_band, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey)"
PEERS = f"""WITH {OFFERS}, a AS (SELECT p_brand, p_type, size_band, count(*) AS n, quantile_cont(price, [0.25, 0.5, 0.75]) AS q FROM o GROUP BY 1, 2, 3 HAVING count(*) >= {{least}}),
b AS (SELECT p_brand, p_type, count(*) AS n, quantile_cont(price, [0.25, 0.5, 0.75]) AS q FROM o GROUP BY 1, 2 HAVING count(*) >= {{least}}), c AS (SELECT p_brand, count(*) AS n, quantile_cont(price, [0.25, 0.5, 0.75]) AS q FROM o GROUP BY 1 HAVING count(*) >= {{least}}),
j AS (SELECT o.*, CASE WHEN a.n IS NOT NULL THEN 0 WHEN b.n IS NOT NULL THEN 1 WHEN c.n IS NOT NULL THEN 2 ELSE -1 END AS level, coalesce(a.n, b.n, c.n) AS peers, coalesce(a.q, b.q, c.q) AS q FROM o LEFT JOIN a USING (p_brand, p_type, size_band) LEFT JOIN b USING (p_brand, p_type) LEFT JOIN c USING (p_brand))"""


def positions(t, least):
    p = rel.peers(offers(t), "price", [["p_brand", "p_type", "size_band"], ["p_brand", "p_type"], ["p_brand"]], least)
    return p.withColumn("place", rel.position(F.round("price", 9), F.round("p25", 9), F.round("p75", 9)))


@query("k06_peer_benchmark", PEERS.format(least=40) + " SELECT l_orderkey, l_linenumber, level, peers, round(q[2], 9) AS p50, CASE WHEN round(price, 9) < round(q[1], 9) THEN 'below' WHEN round(price, 9) > round(q[3], 9) THEN 'above' ELSE 'inside' END AS place FROM j")
def k06(t, s):
    return positions(t, 40).select("l_orderkey", "l_linenumber", "level", "peers", F.round("p50", 9).alias("p50"), "place")


@query("k07_benchmark_sensitivity", "SELECT * FROM (" + PEERS.format(least=30) + " SELECT 30 AS least, level, count(*) AS n FROM j GROUP BY 2) UNION ALL SELECT * FROM (" + PEERS.format(least=90) + " SELECT 90 AS least, level, count(*) AS n FROM j GROUP BY 2)")
def k07(t, s):
    n = lambda k: positions(t, k).groupBy("level").agg(F.count("*").alias("n")).select(F.lit(k).alias("least"), "level", "n")
    return n(30).unionByName(n(90))


@query("k08_standardised_difference", """WITH g AS (SELECT o_orderpriority AS c, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) FILTER (WHERE o_totalprice < 100000) AS a, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) FILTER (WHERE o_totalprice >= 100000) AS b FROM orders GROUP BY 1)
SELECT round(sum((a - b) * n) / sum(n), 6)::DOUBLE AS difference FROM g""")
def k08(t, s):
    low, yes = F.col("o_totalprice") < 100000, F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    g = t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg(F.when(low, yes)).alias("a"), F.avg(F.when(~low, yes)).alias("b"))
    return g.agg(F.round(F.sum((F.col("a") - F.col("b")) * F.col("n")) / F.sum("n"), 6).alias("difference"))


@query("k03_pareto", "SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))")
def k03(t, s):
    return rel.pareto(t("part"), "p_partkey", ["p_brand"], ["p_retailprice"], ["p_size"]).select("p_partkey")


SIM = "abs(l.c_acctbal - r.c_acctbal) <= {tol} * greatest(l.c_acctbal, r.c_acctbal)"
DUP = """WITH RECURSIVE p AS (SELECT l.c_custkey AS a, r.c_custkey AS b, l.c_mktsegment AS sa, r.c_mktsegment AS sb, round(abs(l.c_acctbal - r.c_acctbal), 2) AS gap FROM customer l JOIN customer r ON l.c_nationkey = r.c_nationkey AND l.c_custkey < r.c_custkey AND l.c_mktsegment <> r.c_mktsegment AND abs(l.c_acctbal - r.c_acctbal) <= 0.02 * greatest(l.c_acctbal, r.c_acctbal) WHERE l.c_acctbal > 0 AND r.c_acctbal > 0),
m AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a, sb ORDER BY gap, b) AS x, row_number() OVER (PARTITION BY b, sa ORDER BY gap, a) AS y FROM p) WHERE x = 1 AND y = 1),
e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), c AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node), g AS (SELECT node, min(root) AS root FROM c GROUP BY 1)"""


def duplicate_groups(t):
    d = t("customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"), F.col("c_acctbal").alias("v"))
    return graph.components(sweep.mutual_close(d, 0.02))


@query("k04_duplicate_groups", DUP + " SELECT root, count(*) AS n, CASE WHEN count(DISTINCT c_mktsegment) = count(*) THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, max_by(c_custkey, (c_acctbal, -c_custkey)) AS representative FROM g JOIN customer ON c_custkey = node GROUP BY 1")
def k04(t, s):
    g = duplicate_groups(t).join(t("customer"), F.col("node") == F.col("c_custkey"))
    status = F.when(F.count_distinct("c_mktsegment") == F.count("*"), "RESOLVED").otherwise("AMBIGUOUS")
    return g.groupBy("root").agg(F.count("*").alias("n"), status.alias("status"), F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("representative"))


@query("k05_duplicate_sensitivity", " UNION ALL ".join(f"SELECT {i} AS setting, count(*) AS pairs FROM customer l JOIN customer r ON l.c_nationkey = r.c_nationkey AND l.c_custkey < r.c_custkey AND {SIM.format(tol=tol)} WHERE l.c_acctbal > 0 AND r.c_acctbal > 0" for i, tol in enumerate((0.01, 0.02, 0.03))))
def k05(t, s):
    p = rel.close_pairs(t("customer").where("c_acctbal > 0"), "c_custkey", ["c_nationkey"], {"c_acctbal": 0.03})
    gap = v.relative_gap(F.col("l.c_acctbal"), F.col("r.c_acctbal"))
    p = p.select(F.explode(F.array(*[F.when(F.abs(F.col("l.c_acctbal") - F.col("r.c_acctbal")) <= tol * F.greatest("l.c_acctbal", "r.c_acctbal"), i) for i, tol in enumerate((0.01, 0.02, 0.03))])).alias("setting"), gap.alias("gap"))
    return p.where("setting IS NOT NULL").groupBy("setting").agg(F.count("*").alias("pairs"))


@query("k09_budget_tradeoff", "SELECT CASE WHEN p_retailprice < 920 THEN 1 WHEN p_retailprice < 960 THEN 2 ELSE 3 END AS band, p_type, count(*) AS n, round(quantile_cont(p_size, 0.5), 4) AS p50, round(avg(p_size), 6) AS mean FROM part GROUP BY 1, 2")
def k09(t, s):
    return t("part").groupBy(rel.band(F.col("p_retailprice"), [0.0, 920.0, 960.0, None]).alias("band"), "p_type").agg(F.count("*").alias("n"), F.round(F.percentile("p_size", F.lit(0.5)), 4).alias("p50"), F.round(F.avg("p_size"), 6).alias("mean"))


@query("k10_substitution", """WITH g AS (SELECT n_regionkey AS r, n_nationkey AS k, quantile_cont(c_acctbal, 0.5) AS med, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0 END) AS f1, avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0 END) AS f2 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT o, a, gap, k FROM (SELECT x.k AS o, y.k AS a, round(x.med - y.med, 4) AS gap, row_number() OVER (PARTITION BY x.k ORDER BY round(x.med - y.med, 4) DESC, y.k) AS k FROM g x JOIN g y ON x.r = y.r AND x.k <> y.k WHERE y.med < x.med AND round(1 - (abs(x.f1 - y.f1) + abs(x.f2 - y.f2)) / 2, 6) >= 0.8 AND round(greatest(abs(x.f1 - y.f1), abs(x.f2 - y.f2)), 6) <= 0.3)""")
def k10(t, s):
    share = lambda m: F.avg(F.when(F.col("c_mktsegment") == m, 1.0).otherwise(0.0))
    g = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k")).agg(F.percentile("c_acctbal", F.lit(0.5)).alias("med"), share("BUILDING").alias("f1"), share("MACHINERY").alias("f2"))
    x, y = g.alias("x"), g.alias("y")
    d1, d2 = (F.abs(F.col(f"x.{f}") - F.col(f"y.{f}")) for f in ("f1", "f2"))
    ok = (F.col("y.med") < F.col("x.med")) & (F.round(1 - (d1 + d2) / 2, 6) >= 0.8) & (F.round(F.greatest(d1, d2), 6) <= 0.3)
    j = x.join(y, (F.col("x.r") == F.col("y.r")) & (F.col("x.k") != F.col("y.k")) & ok).select(F.col("x.k").alias("o"), F.col("y.k").alias("a"), F.round(F.col("x.med") - F.col("y.med"), 4).alias("gap"))
    return j.withColumn("k", F.row_number().over(Window.partitionBy("o").orderBy(F.desc("gap"), "a")).cast("bigint"))


@query("k11_commute_choice", """WITH g AS (SELECT c_nationkey AS k, n_regionkey AS r, c_nationkey * 0.7 AS lat, (c_nationkey * 37 % 25) * 0.9 AS lon, round(quantile_cont(c_acctbal, 0.5), 4) AS cost FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(*) >= 10),
d AS (SELECT r_regionkey AS r, r_regionkey * 3.0 AS dlat, r_regionkey * 4.0 AS dlon FROM region),
c AS (SELECT k, g.r, cost, round(2 * 6371.0088 * asin(sqrt(least(1.0, sin(radians(dlat - lat) / 2)^2 + cos(radians(lat)) * cos(radians(dlat)) * sin(radians(dlon - lon) / 2)^2))), 4) AS km FROM g JOIN d ON g.r = d.r)
SELECT k, r, km, cost FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.r = a.r AND b.km <= a.km AND b.cost <= a.cost AND (b.km < a.km OR b.cost < a.cost))""")
def k11(t, s):
    g = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_nationkey").alias("k"), F.col("n_regionkey").alias("r")).agg(F.round(F.percentile("c_acctbal", F.lit(0.5)), 4).alias("cost"), F.count("*").alias("n")).where("n >= 10")
    dest = t("region").select(F.col("r_regionkey").alias("dr"), (F.col("r_regionkey") * 3.0).alias("dlat"), (F.col("r_regionkey") * 4.0).alias("dlon"))
    km = v.haversine_km(F.col("k") * 0.7, (F.col("k") * 37 % 25) * 0.9, F.col("dlat"), F.col("dlon"))
    c = g.join(F.broadcast(dest), F.col("r") == F.col("dr")).select("k", "r", F.round(km, 4).alias("km"), "cost")
    return rel.pareto(c, "k", ["r"], ["km", "cost"], [])


def priced(t):
    d = offers(t).withColumn("y", F.ln("price")).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return d.withColumn("train", v.hash_split(F.col("id")) < 80)


def fitted(t):
    """Offers with terms, and coefficients from the training rows inside its 1st to 99th percentile."""
    d = model.terms(priced(t), ["p_brand", "p_type", "size_band"])
    low, high = rel.quantiles(d.where("train"), [], "y", (0.01, 0.99)).first()["q"]
    return d, model.fit(d.where(F.col("train") & F.col("y").between(low, high)), "y")


@query("k12_price_model_metrics")
def k12(t, s):
    d, beta = fitted(t)
    out = model.predict(d.where("NOT train"), beta).select("price", F.exp("predicted").alias("predicted"))
    return model.metrics(stored(out, "predicted"), "price", "predicted").select("n", *[F.round(c, 4).alias(c) for c in ("mae", "mape", "median_ape", "r2_log")])


@query("k12i_price_model_coefficients")
def k12i(t, s):
    _, beta = fitted(t)
    rows = [(k or "(intercept)", round(b, 6), round(e, 6), round(b - 1.96 * e, 6), round(b + 1.96 * e, 6)) for k, (b, e) in beta.items()]
    return s.createDataFrame(rows, "term string, beta double, se double, low double, high double").withColumn("premium", F.round(F.exp("beta") - 1, 6))


@query("k12c_rare_level_pooling", "SELECT level, count(*) AS n FROM (SELECT CASE WHEN count(*) OVER (PARTITION BY p_brand, p_type) >= 10 THEN 'd:' || p_brand || p_type WHEN count(*) OVER (PARTITION BY p_brand) >= 20 THEN 'p:' || p_brand ELSE 'other' END AS level FROM part) GROUP BY 1")
def k12c(t, s):
    a = t("part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n1"))
    b = t("part").groupBy("p_brand").agg(F.count("*").alias("n2"))
    level = F.when(F.col("n1") >= 10, F.concat(F.lit("d:"), "p_brand", "p_type")).when(F.col("n2") >= 20, F.concat(F.lit("p:"), "p_brand")).otherwise("other")
    return t("part").join(a, ["p_brand", "p_type"]).join(b, "p_brand").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("k12g_k12h_baseline_and_blend")
def k12g(t, s):
    """Test rows by the median of the finest group of training rows with 20 or more, by the model, and by both at weight 0.7."""
    d, beta = fitted(t)
    levels = [["p_brand", "p_type", "size_band"], ["p_brand", "p_type"], ["p_brand"], []]
    rows = stored(d.select("p_brand", "p_type", "size_band", "price", "train", "terms"), "offers")
    train, out = rows.where("train"), rows.where("NOT train")
    for k, keys in enumerate(levels):
        m = rel.quantiles(train, keys, "price", (0.5,)).select(*keys, F.col("q")[0].alias(f"m{k}"))
        n = train.groupBy(*keys).agg(F.count("*").alias(f"n{k}"))
        g = m.join(n, keys) if keys else m.crossJoin(n)  # one row each
        out = out.join(g, keys, "left") if keys else out.crossJoin(F.broadcast(g))
    base = F.coalesce(*[F.when(F.col(f"n{k}") >= 20, F.col(f"m{k}")) for k in range(len(levels))], F.col(f"m{len(levels) - 1}"))
    out = model.predict(out, beta).withColumns({"baseline": base, "model": F.exp("predicted")}).withColumn("blend", model.blended(F.col("model"), F.col("baseline"), 0.7))
    three = ("baseline", "model", "blend")
    return model.metrics(stored(out.select("price", *three), "predicted"), "price", *three).select("which", "n", *[F.round(c, 4).alias(c) for c in ("mae", "mape", "median_ape", "r2_log")])


RIDGES, WEIGHTS = (10.0, 1.0, 0.1), (0.0, 0.5, 1.0)


def cross_validated(t):
    """Offers with out-of-fold predictions for each ridge and their out-of-fold brand mean, terms stored once."""
    d = stored(model.terms(priced(t).withColumn("fold", v.hash_split(F.col("id"), 5)), ["p_brand", "p_type"]), "terms")
    sums = d.groupBy("p_brand", "fold").agg(F.sum("y").alias("s"), F.count("*").alias("c"))
    whole = sums.groupBy(F.col("p_brand").alias("brand")).agg(F.sum("s").alias("all_s"), F.sum("c").alias("all_c"))
    rest = sums.join(whole, F.col("p_brand") == F.col("brand")).select("p_brand", "fold", F.try_divide(F.col("all_s") - F.col("s"), F.col("all_c") - F.col("c")).alias("base"))
    return model.predict_folds(d, model.fit_folds(d, "y", RIDGES), len(RIDGES)).join(rest, ["p_brand", "fold"])


@query("k13_cross_validation")
def k13(t, s):
    """Mean absolute log error of each ridge and weight beside the brand's mean, over five folds, and which setting is chosen: a later one
    must be better by a thousandth."""
    d = cross_validated(t)
    error = lambda k, w: F.avg(F.abs(F.col("y") - (w * F.col("predictions")[k] + (1 - w) * F.coalesce("base", F.col("predictions")[k]))))
    grid = [(r, w, k) for w in WEIGHTS for k, r in enumerate(RIDGES)]
    got = d.agg(*[error(k, w).alias(f"e{i}") for i, (_, w, k) in enumerate(grid)]).first()
    rows = [(r, w, float(got[i])) for i, (r, w, _) in enumerate(grid)] if got[0] is not None else []
    best = model.chosen(rows) if rows else None
    return s.createDataFrame([(r, w, round(e, 9), (r, w, e) == best) for r, w, e in rows], "ridge double, weight double, error double, chosen boolean")


@query("m05_paired_bootstrap")
def m05(t, s):
    """Whether the model's errors are smaller than the brand mean's: a hundred blocks of rows by hash, drawn anew."""
    d = cross_validated(t).withColumn("block", v.hash_split(F.concat(F.col("id"), F.lit("/block"))))
    e = lambda p: F.sum(F.abs(F.col("y") - p))
    rows = d.groupBy("block").agg(e(F.col("predictions")[1]).alias("a"), e(F.coalesce("base", F.col("predictions")[1])).alias("b"), F.count("*").alias("n")).orderBy("block").collect()  # a row a block
    b = model.paired_bootstrap([(r["a"], r["b"], r["n"]) for r in rows])
    return s.createDataFrame([tuple(round(b[k], 6) for k in ("difference", "low", "high", "not_larger"))], "difference double, low double, high double, not_larger double")


@query("k14_repost_leakage", "SELECT count(DISTINCT te.c_custkey) AS leaked FROM customer te JOIN customer tr ON te.c_nationkey = tr.c_nationkey AND te.c_mktsegment = tr.c_mktsegment AND abs(te.c_acctbal - tr.c_acctbal) <= 0.03 * greatest(te.c_acctbal, tr.c_acctbal) WHERE te.c_acctbal > 0 AND tr.c_acctbal > 0 AND te.c_custkey % 5 = 0 AND tr.c_custkey % 5 <> 0")
def k14(t, s):
    d = t("customer").where("c_acctbal > 0")
    p = rel.close_pairs(d, "c_custkey", ["c_nationkey", "c_mktsegment"], {"c_acctbal": 0.03}, (F.col("l.c_custkey") % 5 == 0) != (F.col("r.c_custkey") % 5 == 0))
    return p.agg(F.count_distinct(F.when(F.col("l.c_custkey") % 5 == 0, F.col("l.c_custkey")).otherwise(F.col("r.c_custkey"))).alias("leaked"))


@query("k17_quality_funnel", "SELECT source, count(*) AS n, count(DISTINCT text) AS texts, count(*) FILTER (WHERE n_chars < 500) AS short, count(l.doc_id) AS labelled, coalesce(sum(toxic), 0)::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def k17(t, s):
    d = t("documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), F.count_if(F.col("n_chars") < 500).alias("short"))
    lab = t("documents").select("doc_id", "source").join(t("labels"), "doc_id").groupBy("source").agg(F.count("*").alias("labelled"), F.sum("toxic").cast("bigint").alias("toxic"))
    return d.join(lab, "source", "left").na.fill(0, ["labelled", "toxic"])


@query("k18_market_overview", "SELECT n_name, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def k18(t, s):
    d = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy("n_name").agg(F.count("*").alias("n"), *rel.quartiles("o_totalprice"))


@query("k19_evidence", "SELECT 'status ' || o_orderstatus AS what, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'priority ' || o_orderpriority, count(*), round(avg(o_totalprice), 2) FROM orders GROUP BY o_orderpriority")
def k19(t, s):
    t("orders").createOrReplaceTempView("tessera_orders")
    return s.sql("SELECT concat('status ', o_orderstatus) AS what, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM tessera_orders GROUP BY o_orderstatus UNION ALL SELECT concat('priority ', o_orderpriority), count(*), round(avg(o_totalprice), 2) FROM tessera_orders GROUP BY o_orderpriority")


@query("k20_snapshot_compare", "SELECT CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'not_observed' WHEN a.n IS DISTINCT FROM b.n THEN 'changed' ELSE 'same' END AS kind, count(*) AS n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1994 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1) b ON a.k = b.k GROUP BY 1")
def k20(t, s):
    snap = lambda y, n: t("orders").where(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n))
    kind = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "not_observed").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("same")
    return snap(1994, "a").join(snap(1995, "b"), "k", "full").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("k21_coverage_gaps", f"WITH {OBS}, d AS (SELECT key % 3 AS source, day, count(*) AS n FROM o GROUP BY 1, 2), x AS (SELECT source, day, n, lag(day) OVER (PARTITION BY source ORDER BY day) AS b FROM d) SELECT source, count(*) AS days, sum(n)::BIGINT AS rows_seen, coalesce(sum(date_diff('day', b, day) - 1), 0)::BIGINT AS missing FROM x GROUP BY 1")
def k21(t, s):
    d = observations(t).groupBy((F.col("key") % 3).alias("source"), "day").agg(F.count("*").alias("n"))
    g = d.groupBy("source").agg(F.count("*").alias("days"), F.sum("n").alias("rows_seen"), F.min("day").alias("a"), F.max("day").alias("z"))
    return g.select("source", "days", "rows_seen", (F.size(F.sequence("a", "z")) - F.col("days")).cast("bigint").alias("missing"))


@query("k22_backtest_quintiles", "SELECT q, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6)::DOUBLE AS share FROM (SELECT *, CASE WHEN o_totalprice < e[1] THEN 0 WHEN o_totalprice < e[2] THEN 1 WHEN o_totalprice < e[3] THEN 2 WHEN o_totalprice < e[4] THEN 3 ELSE 4 END AS q FROM orders, (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders)) GROUP BY 1")
def k22(t, s):
    e = rel.quantiles(t("orders"), [], "o_totalprice", (0.2, 0.4, 0.6, 0.8)).withColumnRenamed("q", "e")
    q = F.size(F.filter("e", lambda x: x <= F.col("o_totalprice")))
    d = t("orders").crossJoin(F.broadcast(e)).withColumn("q", q)  # one row of edges
    return d.groupBy("q").agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("share"))


@query("k23_label_evaluation", "SELECT lang, count(*) FILTER (WHERE p AND toxic = 1) AS tp, count(*) FILTER (WHERE p AND toxic = 0) AS fp, count(*) FILTER (WHERE NOT p AND toxic = 1) AS fn, round(avg(CASE WHEN p = (toxic = 1) THEN 1.0 ELSE 0 END), 6)::DOUBLE AS accuracy FROM (SELECT *, regexp_matches(lower(text), 'idiot|stupid|scum') AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def k23(t, s):
    d = t("documents").join(t("labels"), "doc_id").withColumn("p", F.lower("text").rlike("idiot|stupid|scum"))
    y = F.col("toxic") == 1
    return d.groupBy("lang").agg(F.count_if(F.col("p") & y).alias("tp"), F.count_if(F.col("p") & ~y).alias("fp"), F.count_if(~F.col("p") & y).alias("fn"), F.round(F.avg((F.col("p") == y).cast("double")), 6).alias("accuracy"))


def _hash_sql(table, cols):
    body = ", ".join(f"'{c}': {c}" for c in sorted(cols))
    return f"SELECT '{table}' AS tab, count(*) AS n_rows, CAST(sum(h) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM (SELECT CAST('0x' || substr(md5(to_json({{{body}}})), 1, 12) AS BIGINT) AS h FROM {table})"


PRINTED = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "labels": ["doc_id", "quality", "toxic"]}


@query("k24_fingerprint", " UNION ALL ".join(_hash_sql(k, c) for k, c in PRINTED.items()))
def k24(t, s):
    out = None
    for k, c in PRINTED.items():
        f = rel.fingerprint(t(k).select(*c)).select(F.lit(k).alias("tab"), "n_rows", "hash_sum", "hash_xor")
        out = f if out is None else out.unionByName(f)
    return out


@query("k25_dimension", "SELECT -1 AS key, CAST(NULL AS VARCHAR) AS name UNION ALL SELECT CAST(row_number() OVER (ORDER BY c_mktsegment) AS INTEGER), c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def k25(t, s):
    d = t("customer").select(F.col("c_mktsegment").alias("name")).distinct().withColumn("key", F.row_number().over(Window.orderBy("name")))
    return rel.with_unknown(d.select("key", "name"), key=-1)


@query("k26_fact", "SELECT o_orderkey, coalesce(s.k, -1)::INTEGER AS segment_key, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, " + BAND_SQL.format(c="o_totalprice") + " AS band_key FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT seg, row_number() OVER (ORDER BY seg) AS k FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer) WHERE seg <> 'BUILDING') s ON s.seg = c_mktsegment")
def k26(t, s):
    seg = t("customer").select(F.col("c_mktsegment").alias("seg")).distinct().where("seg <> 'BUILDING'").withColumn("k", F.row_number().over(Window.orderBy("seg")))
    d = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(seg, F.col("c_mktsegment") == F.col("seg"), "left")
    return d.select("o_orderkey", F.coalesce("k", F.lit(-1)).cast("int").alias("segment_key"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_key"), rel.band(F.col("o_totalprice"), [0.0, 50e3, 100e3, 150e3, 200e3, 300e3, None]).alias("band_key"))


CHECKS = {
    "lineitem_orders": ("lineitem", "l_orderkey", "orders", "o_orderkey"), "lineitem_part": ("lineitem", "l_partkey", "part", "p_partkey"), "orders_customer": ("orders", "o_custkey", "customer", "c_custkey"),
    "customer_nation": ("customer", "c_nationkey", "nation", "n_nationkey"), "nation_region": ("nation", "n_regionkey", "region", "r_regionkey"), "labels_documents": ("labels", "doc_id", "documents", "doc_id"),
}


@query("k27_orphan_checks", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS orphans FROM {a} WHERE {x} NOT IN (SELECT {y} FROM {b})" for n, (a, x, b, y) in CHECKS.items()))
def k27(t, s):
    out = None
    for n, (a, x, b, y) in CHECKS.items():
        d = t(a).join(t(b).select(F.col(y).alias("_k")), F.col(x) == F.col("_k"), "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(n).alias("name"), "orphans")
        out = d if out is None else out.unionByName(d)
    return out


@query("k27b_grain_checks", "SELECT 'lineitem' AS name, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated FROM lineitem UNION ALL SELECT 'documents', count(*) - count(DISTINCT doc_id) FROM documents")
def k27b(t, s):
    g = lambda n, *k: t(n).agg((F.count("*") - F.count_distinct(*k)).alias("repeated")).select(F.lit(n).alias("name"), "repeated")
    return g("lineitem", "l_orderkey", "l_linenumber").unionByName(g("documents", "doc_id"))


# what must hold of each row, by table: name, then the condition, in SQL that both engines read alike
ASSERTIONS = {
    "region": {"key": "r_regionkey IS NOT NULL", "name": "length(r_name) > 0"},
    "nation": {"key": "n_nationkey IS NOT NULL", "name": "length(n_name) > 0", "region": "n_regionkey BETWEEN 0 AND 4"},
    "customer": {"key": "c_custkey > 0", "name": "length(c_name) > 0", "nation": "c_nationkey BETWEEN 0 AND 24", "balance": "c_acctbal BETWEEN -1000 AND 10000", "segment": "c_mktsegment IS NOT NULL", "no_debt": "c_acctbal >= 0"},
    "supplier": {"key": "s_suppkey > 0", "name": "length(s_name) > 0", "nation": "s_nationkey BETWEEN 0 AND 24", "no_debt": "s_acctbal >= 0"},
    "part": {"key": "p_partkey > 0", "name": "length(p_name) > 0", "brand": "p_brand IS NOT NULL", "type": "p_type IS NOT NULL", "size": "p_size BETWEEN 1 AND 50", "price": "p_retailprice > 0"},
    "orders": {"key": "o_orderkey > 0", "customer": "o_custkey > 0", "status": "o_orderstatus IN ('F', 'O', 'P')", "price": "o_totalprice > 0", "date": "o_orderdate IS NOT NULL", "priority": "o_orderpriority IS NOT NULL", "cheap": "o_totalprice < 400000"},
    "lineitem": {"order": "l_orderkey > 0", "part": "l_partkey > 0", "supplier": "l_suppkey > 0", "number": "l_linenumber BETWEEN 1 AND 7", "quantity": "l_quantity BETWEEN 1 AND 50", "price": "l_extendedprice > 0", "discount": "l_discount BETWEEN 0 AND 0.1", "tax": "l_tax BETWEEN 0 AND 0.08", "flag": "l_returnflag IN ('A', 'N', 'R')", "status": "l_linestatus IN ('F', 'O')", "unit": "l_extendedprice / l_quantity < 100000", "kept": "l_returnflag <> 'R'"},
    "events": {"key": "event_id IS NOT NULL", "time": "ts IS NOT NULL", "user": "user_id IS NOT NULL", "type": "event_type IS NOT NULL", "value": "value IS NOT NULL", "props": "props LIKE '{%}'"},
    "documents": {"key": "doc_id IS NOT NULL", "lang": "length(lang) = 2", "source": "source IS NOT NULL", "chars": "n_chars >= 0", "text": "text IS NOT NULL", "length": "length(text) = n_chars", "long": "n_chars >= 100"},
    "labels": {"key": "doc_id IS NOT NULL", "quality": "quality IN (0, 1)", "toxic": "toxic IN (0, 1)", "good": "quality = 1 OR toxic = 0"},
    "pages": {"key": "page_id IS NOT NULL", "url": "url LIKE 'http%'", "html": "html IS NOT NULL", "article": "html LIKE '%<article%'"},
    "benchmark": {"key": "item_id IS NOT NULL", "text": "length(text) > 0"},
    "conversations": {"key": "conv_id IS NOT NULL", "turn": "turn >= 0", "role": "role IN ('system', 'user', 'assistant', 'tool')", "text": "text IS NOT NULL"},
    "embeddings": {"key": "vec_id IS NOT NULL", "vector": "embedding IS NOT NULL"},
}


@query("k27c_row_checks", " UNION ALL ".join(f"SELECT '{t} {n}' AS name, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS failed, count(*) AS n FROM {t}" for t, cs in ASSERTIONS.items() for n, c in cs.items()))
def k27c(t, s):
    """All conditions of a table in one pass over it."""
    out = None
    for table, checks in ASSERTIONS.items():
        d = rel.failures(t(table), checks).select(F.concat(F.lit(table + " "), "name").alias("name"), "failed", "n")
        out = d if out is None else out.unionByName(d)
    return out


@query("k28_g01_chart", "SELECT c_mktsegment AS seg, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer WHERE c_acctbal > 0 GROUP BY 1 HAVING count(*) > 10 ORDER BY n DESC, seg LIMIT 4")
def k28(t, s):
    spec = {"where": "c_acctbal > 0", "dimensions": ["c_mktsegment AS seg"], "metrics": {"n": "count(*)", "mean": "round(avg(c_acctbal), 4)"}, "having": "n > 10", "order": [("n", "desc"), ("seg", "asc")], "limit": 4}
    return rel.aggregate(t("customer"), spec)


CHARTS = {
    "orders_by_status": ("orders", {"dimensions": ["o_orderstatus AS label"], "metrics": {"amount": "count(*)"}}),
    "orders_by_priority": ("orders", {"dimensions": ["o_orderpriority AS label"], "metrics": {"amount": "count(*)"}}),
    "large_orders_by_year": ("orders", {"where": "o_totalprice > 200000", "dimensions": ["cast(year(o_orderdate) AS string) AS label"], "metrics": {"amount": "count(*)"}}),
    "customers_by_segment": ("customer", {"dimensions": ["c_mktsegment AS label"], "metrics": {"amount": "count(*)"}}),
    "customers_in_debt": ("customer", {"where": "c_acctbal < 0", "dimensions": ["c_mktsegment AS label"], "metrics": {"amount": "count(*)"}}),
    "parts_by_brand": ("part", {"dimensions": ["p_brand AS label"], "metrics": {"amount": "count(*)"}}),
    "sizes_by_type": ("part", {"dimensions": ["p_type AS label"], "metrics": {"amount": "sum(p_size)"}}),
    "items_by_flag": ("lineitem", {"dimensions": ["l_returnflag AS label"], "metrics": {"amount": "count(*)"}}),
    "items_by_line": ("lineitem", {"dimensions": ["cast(l_linenumber AS string) AS label"], "metrics": {"amount": "count(DISTINCT l_orderkey)"}}),
    "events_by_type": ("events", {"dimensions": ["event_type AS label"], "metrics": {"amount": "count(*)"}}),
    "users_by_type": ("events", {"dimensions": ["event_type AS label"], "metrics": {"amount": "count(DISTINCT user_id)"}}),
    "documents_by_language": ("documents", {"dimensions": ["lang AS label"], "metrics": {"amount": "count(*)"}}),
    "characters_by_source": ("documents", {"dimensions": ["source AS label"], "metrics": {"amount": "sum(n_chars)"}}),
    "pages_by_kind": ("pages", {"dimensions": ["cast(length(html) > 2000 AS string) AS label"], "metrics": {"amount": "count(*)"}}),
    "turns_by_role": ("conversations", {"dimensions": ["role AS label"], "metrics": {"amount": "count(*)"}}),
    "labels_by_class": ("labels", {"dimensions": ["concat(cast(quality AS string), '/', cast(toxic AS string)) AS label"], "metrics": {"amount": "count(*)"}}),
}


def _chart_sql(name, table, spec):
    label = spec["dimensions"][0].removesuffix(" AS label").replace(" AS string)", " AS VARCHAR)")
    return f"SELECT '{name}' AS chart, {label} AS label, CAST({spec['metrics']['amount']} AS BIGINT) AS amount FROM {table} WHERE {spec.get('where', 'true')} GROUP BY 1, 2"


@query("k28_k29_charts", " UNION ALL ".join(_chart_sql(n, *c) for n, c in CHARTS.items()))
def k29(t, s):
    """Every chart by its specification, each against SQL of its own."""
    out = None
    for n, (table, spec) in CHARTS.items():
        d = rel.aggregate(t(table), spec).select(F.lit(n).alias("chart"), "label", F.col("amount").cast("bigint").alias("amount"))
        out = d if out is None else out.unionByName(d)
    return out


@query("g02_g03_metric_check", "SELECT chart, sum(amount)::BIGINT AS shown, (SELECT count(*) FROM orders) AS counted, sum(amount) = (SELECT count(*) FROM orders) AS equal FROM (SELECT 'orders_by_status' AS chart, count(*) AS amount FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'orders_by_priority', count(*) FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'large_orders_by_year', count(*) FROM orders WHERE o_totalprice > 200000 GROUP BY year(o_orderdate)) GROUP BY 1")
def g02(t, s):
    """Charts of a table against the table's own count."""
    own = t("orders").agg(F.count("*").alias("counted"))
    out = None
    for n in ("orders_by_status", "orders_by_priority", "large_orders_by_year"):
        d = rel.aggregate(t("orders"), CHARTS[n][1]).agg(F.sum("amount").cast("bigint").alias("shown")).crossJoin(own).select(F.lit(n).alias("chart"), "shown", "counted", (F.col("shown") == F.col("counted")).alias("equal"))  # one row each
        out = d if out is None else out.unionByName(d)
    return out


@query("k30_k31_findings", "SELECT 'Largest segment: ' || max_by(c_mktsegment, (n, c_mktsegment)) || ' (' || max(n) || ')' AS finding FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def k30(t, s):
    g = t("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return g.agg(F.concat(F.lit("Largest segment: "), F.max_by("c_mktsegment", F.struct("n", "c_mktsegment")), F.lit(" ("), F.max("n").cast("string"), F.lit(")")).alias("finding"))


@query("m01_two_proportions", "WITH x AS (SELECT count(*) FILTER (WHERE toxic = 1 AND lang = 'en') AS x1, count(*) FILTER (WHERE lang = 'en') AS n1, count(*) FILTER (WHERE toxic = 1 AND lang <> 'en') AS x2, count(*) FILTER (WHERE lang <> 'en') AS n2 FROM documents JOIN labels USING (doc_id)) SELECT round((x1 / n1 - x2 / n2) / sqrt((x1 + x2) / (n1 + n2) * (1 - (x1 + x2) / (n1 + n2)) * (1 / n1 + 1 / n2)), 6) AS z FROM x")
def m01(t, s):
    en, y = F.col("lang") == "en", F.col("toxic") == 1
    r = t("documents").join(t("labels"), "doc_id").agg(F.count_if(y & en).alias("x1"), F.count_if(en).alias("n1"), F.count_if(y & ~en).alias("x2"), F.count_if(~en).alias("n2")).first()
    return s.createDataFrame([(round(model.two_proportions(*r)["z"], 6),)], "z double")


@query("m02_mann_whitney", "WITH r AS (SELECT lang = 'en' AS en, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM documents) SELECT round(sum(r) FILTER (WHERE en) - count(*) FILTER (WHERE en) * (count(*) FILTER (WHERE en) + 1) / 2, 2)::DOUBLE AS u FROM r")
def m02(t, s):
    c = t("documents").groupBy(F.col("n_chars").alias("value")).agg(F.count_if(F.col("lang") == "en").alias("n1"), F.count_if(F.col("lang") != "en").alias("n2"))
    return model.mann_whitney(c).select(F.round(F.col("u").cast("double"), 2).alias("u"))


@query("m03_mantel_haenszel", "WITH x AS (SELECT source, count(*) FILTER (WHERE lang = 'en' AND toxic = 1)::DOUBLE AS a, count(*) FILTER (WHERE lang = 'en' AND toxic = 0)::DOUBLE AS b, count(*) FILTER (WHERE lang <> 'en' AND toxic = 1)::DOUBLE AS c, count(*) FILTER (WHERE lang <> 'en' AND toxic = 0)::DOUBLE AS d FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT round(sum(a * d / (a + b + c + d)) / sum(b * c / (a + b + c + d)), 6) AS odds_ratio FROM x WHERE a + b + c + d > 1")
def m03(t, s):
    en, y = F.col("lang") == "en", F.col("toxic") == 1
    x = t("documents").join(t("labels"), "doc_id").groupBy("source").agg(F.count_if(en & y).alias("a"), F.count_if(en & ~y).alias("b"), F.count_if(~en & y).alias("c"), F.count_if(~en & ~y).alias("d"))
    return model.mantel_haenszel(x).select(F.round("odds_ratio", 6).alias("odds_ratio"))


@query("m04_median_from_counts", "SELECT quantile_disc(l_quantity, 0.5) AS median FROM lineitem")
def m04(t, s):
    g = t("lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    w = Window.orderBy("l_quantity")  # a row for each value
    return g.withColumn("c", F.sum("n").over(w)).crossJoin(F.broadcast(g.agg(F.sum("n").alias("all")))).where("c * 2 >= all").agg(F.min("l_quantity").alias("median"))


@query("m06_m07_error_quantiles", "SELECT round(quantile_cont(e, 0.9), 4) AS p90, round(avg(CASE WHEN e <= 0.5 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS within FROM (SELECT abs(o_totalprice - m) / o_totalprice AS e FROM orders, (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders) WHERE o_totalprice > 0)")
def m06(t, s):
    m = rel.quantiles(t("orders"), [], "o_totalprice", (0.5,)).select(F.col("q")[0].alias("m"))
    d = t("orders").where("o_totalprice > 0").crossJoin(F.broadcast(m)).select((F.abs(F.col("o_totalprice") - F.col("m")) / F.col("o_totalprice")).alias("e"))  # one row
    p90 = rel.quantiles(d, [], "e", (0.9,)).select(F.round(F.col("q")[0], 4).alias("p90"))
    return p90.crossJoin(d.agg(F.round(F.avg((F.col("e") <= 0.5).cast("double")), 6).alias("within")))  # one row each


@query("j09c_text_similarity")
def j09c(t, s):
    """Documents of a language and different sources whose sets of words of more than three characters, over whole texts, have a Jaccard
    similarity of 0.6 or more; a document without such words is like none. Exact, with words told apart by 64-bit hashes."""
    docs = t("documents").where("lang IS NOT NULL")
    k = F.array_distinct(F.filter(F.split(tx.fold(F.col("text")), " "), lambda x: F.length(x) > 3))
    rows = docs.where("source IS NOT NULL").select(F.col("lang").alias("g"), F.col("doc_id").alias("id"), F.xxhash64("source").alias("side"), F.sort_array(F.transform(k, lambda x: F.xxhash64(x))).alias("tokens"))
    load = docs.groupBy(F.col("lang").alias("g")).agg((F.sum(F.length("text")) / 12).cast("long").alias("tokens"))  # of a text's characters
    return similar.like_pairs(rows, load, (3, 5), lambda df: stored(df, "pairs"))
