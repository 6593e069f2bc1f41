"""Snapshots and their fields, labels and their review, crawl depth and schedule, column profiles, nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relational as rel
from tessera.plans.registry import query
from tessera.sources.tables import scratch


@query("p14_conflict_keys", "SELECT d.doc_id, CASE WHEN coalesce(l.toxic = 1 OR l.quality = 0, false) THEN NULL ELSE d.source END AS source_key FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def p14(t, s):
    """The key goes where its row is in conflict; a row without a verdict keeps it."""
    conflict = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left").select("doc_id", F.when(~F.coalesce(conflict, F.lit(False)), F.col("source")).alias("source_key"))


@query("a10_first_known", "SELECT u.user_id, f.event_type AS first_known FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type <> 'error') f ON u.user_id = f.user_id AND f.r = 1")
def a10(t, s):
    """The first known value by time: min_by passes over null orders, so it combines before the shuffle and does not depend on row order."""
    known = F.when(F.col("event_type") != "error", F.col("event_type"))
    return t("events").groupBy("user_id").agg(F.min_by(known, F.when(known.isNotNull(), F.struct("ts", "event_id"))).alias("first_known"))


@query("a24_counters", "SELECT source, 'all' AS counter, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT source, 'short', count(*) FROM documents WHERE n_chars < 500 GROUP BY 1 UNION ALL SELECT source, 'numbers', count(*) FROM documents WHERE regexp_matches(text, '[0-9]') GROUP BY 1 UNION ALL SELECT source, 'lines', count(*) FROM documents WHERE contains(text, chr(10)) GROUP BY 1")
def a24(t, s):
    """Counters of a pass over the rows, as an aggregate."""
    hit = rel.reasons((F.lit(True), "all"), (F.col("n_chars") < 500, "short"), (F.col("text").rlike("[0-9]"), "numbers"), (F.contains("text", F.lit("\n")), "lines"))
    return t("documents").select("source", F.explode(hit).alias("counter")).groupBy("source", "counter").agg(F.count("*").alias("n"))


@query("w03_page_order", "SELECT event_id, user_id, page FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY page NULLS LAST, event_id) AS r FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS page FROM events)) WHERE r = 1")
def w03(t, s):
    """Of a batch's sightings of a listing the one on the earliest page stays, sightings without a page last."""
    d = t("events").select("event_id", "user_id", F.to_date("ts").alias("day"), F.from_json("props", "k bigint")["k"].alias("page"))
    return rel.latest(d, ["user_id", "day"], [F.asc_nulls_last("page"), F.asc("event_id")]).select("event_id", "user_id", "page")


@query("w16_rank_in_segment", "SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal - 5000), c_custkey) AS rank FROM customer")
def w16(t, s):
    """Segments are few, so rows are numbered in one distributed order and each segment's first place is taken off."""
    d = t("customer").select("c_custkey", "c_mktsegment", F.abs(F.col("c_acctbal") - 5000).alias("distance"))
    d = rel.numbered(d, [F.col("c_mktsegment"), F.col("distance"), F.col("c_custkey")])
    first = d.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.min("place").alias("first"))
    return d.join(first, F.col("c_mktsegment").eqNullSafe(F.col("segment"))).select("c_custkey", "c_mktsegment", (F.col("place") - F.col("first") + 1).cast("bigint").alias("rank"))


@query("t02_sample_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
def t02(t, s):
    """A report's sample: the limit is the feature."""
    return t("orders").where("o_orderstatus = 'F'").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("t06_empty_table", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def t06(t, s):
    """A table made from a schema alone, then filled."""
    path, d = scratch(s, "empty-table"), t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    d.limit(0).write.parquet(path)
    d.where("o_orderstatus = 'P'").write.mode("append").parquet(path)
    return s.read.parquet(path)


@query("x10_nested_record", "SELECT event_id AS id, value AS price, user_id AS seller, CASE WHEN event_id % 3 > 0 THEN 'p' || event_id END AS image, CASE WHEN event_id % 3 > 0 THEN 3 ELSE 1 END AS n_images FROM events")
def x10(t, s):
    """A nested record as JSON, flattened: fields of inner objects, the first photo among the images, their number."""
    image = lambda kind, url: F.struct(F.lit(kind).alias("kind"), url.alias("url"))
    own = F.col("event_id").cast("string")
    plan, photos = F.array(image("plan", F.concat(F.lit("m"), own))), F.array(image("photo", F.concat(F.lit("p"), own)), image("photo", F.concat(F.lit("q"), own)))
    images = F.when(F.col("event_id") % 3 > 0, F.concat(plan, photos)).otherwise(plan)
    raw = F.to_json(F.struct(F.struct(F.col("event_id").alias("id"), F.struct(F.col("value").alias("amount")).alias("price")).alias("item"), F.struct(F.col("user_id").alias("id")).alias("seller"), images.alias("images")))
    r = F.from_json("raw", "item struct<id: bigint, price: struct<amount: double>>, seller struct<id: bigint>, images array<struct<kind: string, url: string>>")
    d = t("events").select(raw.alias("raw")).select(r.alias("r"))
    photo = F.get(F.filter("r.images", lambda x: x["kind"] == "photo"), F.lit(0))["url"]
    return d.select(F.col("r.item.id").alias("id"), F.col("r.item.price.amount").alias("price"), F.col("r.seller.id").alias("seller"), photo.alias("image"), F.size("r.images").alias("n_images"))


#: Days from which on a kind of event counts as crawled to a stable depth.
STABLE = {"click": "2024-01-10", "view": "2024-01-20"}


@query("g09_depth_cohorts", "SELECT event_type, CASE WHEN event_type NOT IN ('click', 'view') THEN 'unknown' WHEN CAST(ts AS DATE) >= CASE event_type WHEN 'click' THEN DATE '2024-01-10' ELSE DATE '2024-01-20' END THEN 'stable' ELSE 'before' END AS cohort, count(*) AS n FROM events GROUP BY 1, 2")
def g09(t, s):
    since = F.create_map(*[x for k, day in STABLE.items() for x in (F.lit(k), F.lit(day).cast("date"))])[F.col("event_type")]
    cohort = F.when(since.isNull(), "unknown").when(F.to_date("ts") >= since, "stable").otherwise("before")
    return t("events").groupBy("event_type", cohort.alias("cohort")).agg(F.count("*").alias("n"))


@query("g14_opposite_ties", "SELECT user_id, max(event_id) FILTER (WHERE a = 1) AS low, max(event_id) FILTER (WHERE b = 1) AS high FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, md5(CAST(event_id AS VARCHAR))) AS a, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, md5(CAST(event_id AS VARCHAR)) DESC) AS b FROM events) GROUP BY 1")
def g14(t, s):
    """The current row of a key under both tie-breaks by hash, in one aggregate."""
    day, h = F.to_date("ts"), F.md5(F.col("event_id").cast("string"))
    return t("events").groupBy("user_id").agg(F.min_by("event_id", F.struct((-F.unix_date(day)).alias("d"), h.alias("h"))).alias("low"), F.max_by("event_id", F.struct(day.alias("d"), h.alias("h"))).alias("high"))


@query("g20_label_review", "WITH r AS (SELECT d.doc_id, CASE WHEN n_chars >= 1000 THEN 1 WHEN n_chars >= 300 THEN 0 END AS pre, quality AS post FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT lang, count(*) AS n, count(*) - count(pre) AS unknown, count(*) FILTER (WHERE pre <> post) AS changed, count(*) FILTER (WHERE pre IS NOT DISTINCT FROM post) AS same, count(*) - count(DISTINCT r.doc_id) AS repeated FROM r JOIN documents d ON d.doc_id = r.doc_id GROUP BY 1")
def g20(t, s):
    """Labels before a review as text of three states, after it as given: read, held against each other, repeats counted."""
    written = F.when(F.col("n_chars") >= 1000, " Yes").when(F.col("n_chars") >= 300, "0").otherwise("?")
    state = F.lower(F.trim("written"))
    pre = F.when(state.isin("1", "yes", "true"), 1).when(state.isin("0", "no", "false"), 0)
    d = t("documents").select("doc_id", "lang", written.alias("written")).join(t("labels"), "doc_id").select("doc_id", "lang", pre.alias("pre"), F.col("quality").alias("post"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("pre").isNull()).alias("unknown"), F.count_if(F.col("pre") != F.col("post")).alias("changed"), F.count_if(F.col("pre").eqNullSafe(F.col("post"))).alias("same"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated"))


@query("g24_upstream_gate", "SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'upstream_failed' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'done' END AS state FROM lineitem")
def g24(t, s):
    """A task after a failed one of its run does not count as done, whatever it says; tasks of one number are side by side. One aggregate finds each run's first failure."""
    d = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    first = d.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first"))
    state = F.when(F.col("l_linenumber") > F.col("first"), "upstream_failed").when(F.col("l_returnflag") == "R", "failed").otherwise("done")
    return d.join(first, "l_orderkey", "left").select("l_orderkey", "l_linenumber", state.alias("state"))


@query("k20b_changes_by_field", "WITH e AS (SELECT user_id, CAST(ts AS DATE) <= DATE '2024-01-15' AS early, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS page, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) <= DATE '2024-01-15' ORDER BY ts DESC, event_id DESC) AS r FROM events), a AS (SELECT * FROM e WHERE r = 1 AND early), b AS (SELECT * FROM e WHERE r = 1 AND NOT early), j AS (SELECT a.user_id IS NOT NULL AND b.user_id IS NOT NULL AS kept, a.event_type IS DISTINCT FROM b.event_type AS t, a.value IS DISTINCT FROM b.value AS v, a.page IS DISTINCT FROM b.page AS p FROM a FULL JOIN b ON a.user_id = b.user_id) SELECT 'event_type' AS field, count(*) FILTER (WHERE kept AND t) AS changed, count(*) FILTER (WHERE kept) AS retained, round(count(*) FILTER (WHERE kept) * 100.0 / count(*), 4) AS overlap FROM j UNION ALL SELECT 'value', count(*) FILTER (WHERE kept AND v), count(*) FILTER (WHERE kept), round(count(*) FILTER (WHERE kept) * 100.0 / count(*), 4) FROM j UNION ALL SELECT 'page', count(*) FILTER (WHERE kept AND p), count(*) FILTER (WHERE kept), round(count(*) FILTER (WHERE kept) * 100.0 / count(*), 4) FROM j")
def k20b(t, s):
    """Two snapshots of a listing side by side: changes of each field and the share of listings in both, from one full outer join."""
    fields = ["event_type", "value", "page"]
    d = t("events").select("user_id", "event_id", "ts", "event_type", "value", F.from_json("props", "k bigint")["k"].alias("page"), (F.to_date("ts") <= F.lit("2024-01-15").cast("date")).alias("early"))
    d = rel.latest(d, ["user_id", "early"], [F.desc("ts"), F.desc("event_id")])
    side = lambda early, n: d.where(F.col("early") == early).select("user_id", F.struct(*fields).alias(n))
    j = side(True, "a").join(side(False, "b"), "user_id", "full")
    kept = F.col("a").isNotNull() & F.col("b").isNotNull()
    counts = [F.count_if(kept & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f) for f in fields]
    one = j.agg(*counts, F.count_if(kept).alias("retained"), F.round(F.count_if(kept) * 100.0 / F.count("*"), 4).alias("overlap"))
    return one.unpivot(["retained", "overlap"], fields, "field", "changed").select("field", "changed", "retained", "overlap")


@query("k21b_schedule", "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), c AS (SELECT count(*) FILTER (WHERE dayofweek(x) IN (2, 5)) AS expected FROM (SELECT unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY)) AS x)), l AS (SELECT max(day) AS prev FROM d WHERE day < (SELECT max(day) FROM d)) SELECT user_id, count(*) FILTER (WHERE dayofweek(day) IN (2, 5)) AS seen, any_value(expected) - count(*) FILTER (WHERE dayofweek(day) IN (2, 5)) AS missed, max(day) < any_value(prev) AS gone FROM d, c, l GROUP BY 1")
def k21b(t, s):
    """For each listing the scheduled days (Tuesday, Friday) it was seen on and missed, and whether both last batches lack it."""
    d = t("events").select("user_id", F.to_date("ts").alias("day")).distinct()
    days = d.select("day").distinct()
    span = F.sequence(F.min("day"), F.max("day"))
    calendar = days.agg(F.size(F.filter(span, lambda x: F.dayofweek(x).isin(3, 6))).cast("bigint").alias("expected"), F.try_element_at(F.array_sort(F.collect_set("day")), F.lit(-2)).alias("prev"))  # one row; days are few
    g = d.groupBy("user_id").agg(F.count_if(F.dayofweek("day").isin(3, 6)).alias("seen"), F.max("day").alias("last"))
    return g.crossJoin(F.broadcast(calendar)).select("user_id", "seen", (F.col("expected") - F.col("seen")).alias("missed"), (F.col("last") < F.col("prev")).alias("gone"))


@query("k23b_label_scores", "SELECT coalesce(source, 'all') AS source, tp + tn + fp + fn AS n, round(tp / nullif(tp + fp, 0), 6) AS prec, round(tp / nullif(tp + fn, 0), 6) AS rec, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM (SELECT source, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn, count(*) FILTER (WHERE NOT p AND NOT y) AS tn FROM (SELECT source, n_chars >= 300 AS p, quality = 1 AS y FROM documents JOIN labels USING (doc_id)) GROUP BY ROLLUP (source))")
def k23b(t, s):
    """Precision, recall, F1 and accuracy of a rule against labels, by source and over all."""
    d = t("documents").join(t("labels"), "doc_id").select("source", (F.col("n_chars") >= 300).alias("p"), (F.col("quality") == 1).alias("y"))
    p, y = F.col("p"), F.col("y")
    g = d.rollup("source").agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    share = lambda a, b: F.round(F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double")), 6)
    return g.select(F.coalesce("source", F.lit("all")).alias("source"), F.expr("tp + tn + fp + fn AS n"), share("tp", "tp + fp").alias("prec"), share("tp", "tp + fn").alias("rec"), share("2 * tp", "2 * tp + fp + fn").alias("f1"), share("tp + tn", "tp + tn + fp + fn").alias("accuracy"))


PROFILED = ["c_name", "c_mktsegment", "c_acctbal", "c_nationkey"]
ROW = "SELECT '{c}' AS col, count(*) AS n, count(*) - count({c}) AS nulls, count(*) FILTER (WHERE CAST({c} AS VARCHAR) = '') AS empty, count(DISTINCT {c}) AS kinds, count({c}) = count(DISTINCT {c}) AS is_key, min(length(CAST({c} AS VARCHAR))) AS shortest, max(length(CAST({c} AS VARCHAR))) AS longest FROM customer"


@query("s34b_column_profile", " UNION ALL ".join(ROW.format(c=c) for c in PROFILED))
def s34b(t, s):
    """Rows, nulls, empties, kinds, uniqueness and lengths of each column: two passes, not one a column."""
    d = t("customer")
    as_text = lambda c: F.col(c).cast("string")
    long = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), as_text(c).alias("v")) for c in PROFILED])).alias("x")).select("x.col", "x.v")
    kinds = long.groupBy("col", "v").agg(F.count("*").alias("k"))  # combines before the shuffle, so a frequent value is no burden
    known = F.col("v").isNotNull()
    g = kinds.groupBy("col").agg(F.sum("k").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("k"))).alias("nulls"), F.sum(F.when(F.col("v") == "", F.col("k")).otherwise(0)).alias("empty"), F.count_if(known).alias("kinds"), F.min(F.length("v")).alias("shortest"), F.max(F.length("v")).alias("longest"))
    return g.select("col", "n", "nulls", "empty", "kinds", (F.col("n") - F.col("nulls") == F.col("kinds")).alias("is_key"), F.col("shortest").cast("bigint").alias("shortest"), F.col("longest").cast("bigint").alias("longest"))
