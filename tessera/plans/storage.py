"""Sources, sinks, batches, audits and streams, each through a real round trip in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources import tables
from tessera.streaming import windows


@query("s01_s03_csv_round_trip", "SELECT n_nationkey::VARCHAR AS k, n_name || chr(10) || '\"x\",y' AS v FROM nation")
def s01(t, s):
    path = tables.scratch(s, "csv")
    d = t("nation").select(F.col("n_nationkey").cast("string").alias("k"), F.concat("n_name", F.lit('\n"x",y')).alias("v"))
    d.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return tables.read_csv(s, path, ["k", "v"])


@query("s05_s12_batches", "SELECT n_regionkey::VARCHAR || '0' AS region, count(*) AS n, max('snapshot') AS mode FROM nation GROUP BY 1")
def s05(t, s):
    """Batches as folders: written once, skipped when complete, read by partition with lineage."""
    root = tables.scratch(s, "bronze")
    for r in range(5):  # regions, a fixed few
        d = tables.with_lineage(t("nation").where(F.col("n_regionkey") == r), "nation", f"2026010{r + 1}")
        done = [tables.write_batch(d, root, f"{r}0"), tables.write_batch(d, root, f"{r}0")]
        if done != ["WRITTEN", "SKIPPED"]:
            raise ValueError(done)
    d = s.read.option("basePath", root).parquet(f"{root}/batch_id=*")
    return d.groupBy(F.lpad(F.col("batch_id").cast("string"), 2, "0").alias("region")).agg(F.count("*").alias("n"), F.max("_ingestion_mode").alias("mode"))


@query("s07_s28_manifest_gate", "SELECT CASE n_regionkey WHEN 1 THEN 'CHANGED' WHEN 2 THEN 'MISSING' WHEN 3 THEN 'UNKNOWN' ELSE 'SAME' END AS state, count(DISTINCT n_regionkey) AS files FROM nation GROUP BY 1")
def s07(t, s):
    """A file for each region; one is written anew after the manifest, one goes, one is not in it."""
    root = tables.scratch(s, "manifest")
    write = lambda d: d.select(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("value"), "n_regionkey").repartition(1).write.partitionBy("n_regionkey").mode("append").text(root)
    files = lambda: tables.inputs(s, root, "*.txt").select(F.regexp_extract("path", "n_regionkey=(\\d+)", 1).alias("name"), "digest")
    write(t("nation").where("n_regionkey <> 3"))
    manifest = tables.stored(files(), "manifest")
    tables.delete(s, f"{root}/n_regionkey=1")
    tables.delete(s, f"{root}/n_regionkey=2")
    write(t("nation").where("n_regionkey = 1").withColumn("n_name", F.concat("n_name", F.lit("!"))).unionByName(t("nation").where("n_regionkey = 3")))
    return tables.against_manifest(files(), manifest).groupBy("state").agg(F.count("*").alias("files"))


@query("s06_pointer_files", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'POINTER' ELSE 'READABLE' END AS status FROM nation) GROUP BY 1")
def s06(t, s):
    """A file for each nation, every fifth only pointing to content that was not fetched."""
    root = tables.scratch(s, "inputs")
    body = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit(tables.POINTER + "v1 oid "), "n_name")).otherwise(F.col("n_name"))
    t("nation").select(body.alias("value"), F.col("n_nationkey").alias("k")).repartition(1).write.partitionBy("k").text(root)
    return tables.inputs(s, root, "*.txt").groupBy("status").agg(F.count("*").alias("n"))


@query("s02_drifting_header", "SELECT n_nationkey::VARCHAR AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name, CASE WHEN n_nationkey % 2 = 1 THEN n_regionkey::VARCHAR END AS region FROM nation")
def s02(t, s):
    """Two files with different columns, and a broken row in each that is not counted."""
    root, d = tables.scratch(s, "drift"), t("nation")
    lines = lambda d, head, broken: s.createDataFrame([(head,), (broken,)], "value string").coalesce(1).unionByName(d).coalesce(1).write.mode("append").text(root)
    lines(d.where("n_nationkey % 2 = 0").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value")), "k,name", "1,2,3,4")
    lines(d.where("n_nationkey % 2 = 1").select(F.concat_ws(",", "n_regionkey", "n_nationkey").alias("value")), "region,k", "1,2,3")
    return tables.read_drifting_csv(s, root, ["k", "name", "region"]).where("_broken IS NULL").drop("_broken")


@query("s04_expected_rows", "SELECT n_regionkey::VARCHAR AS source, count(*) AS n FROM nation GROUP BY 1")
def s04(t, s):
    """The right numbers of rows pass; a wrong one, a source too many and one too few are each an error."""
    d = t("nation").withColumn("_source_name", F.col("n_regionkey").cast("string"))
    right = {r["_source_name"]: r["n"] for r in d.groupBy("_source_name").agg(F.count("*").alias("n")).collect()}  # a row a region
    one = next(iter(right))
    for wrong in (right | {one: right[one] + 1}, right | {"other": 1}, {k: n for k, n in right.items() if k != one}):
        try:
            tables.expect_rows(d, **wrong)
        except ValueError:
            continue
        raise ValueError("wrong numbers passed")
    return tables.expect_rows(d, **right).groupBy(F.col("_source_name").alias("source")).agg(F.count("*").alias("n"))


@query("s13_g17_state_audit", "SELECT coalesce(r_regionkey, k) AS source, CASE WHEN r_regionkey IS NULL THEN 'NOT_CONFIGURED' WHEN n IS NULL THEN 'MISSING' ELSE 'READABLE' END AS status FROM (SELECT * FROM region WHERE r_regionkey <> 3) FULL JOIN (SELECT n_regionkey AS k, count(*) AS n FROM nation WHERE n_regionkey <> 1 GROUP BY 1) ON k = r_regionkey")
def s13(t, s):
    """Regions as configured sources, nations as what was found: one is not configured, one has nothing."""
    have = t("nation").where("n_regionkey <> 1").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"))
    want = t("region").where("r_regionkey <> 3").select("r_regionkey")
    status = F.when(F.col("r_regionkey").isNull(), "NOT_CONFIGURED").when(F.col("n").isNull(), "MISSING").otherwise("READABLE")
    return want.join(have, F.col("k") == F.col("r_regionkey"), "full").select(F.coalesce("r_regionkey", "k").alias("source"), status.alias("status"))


@query("s14_s34_profile", "SELECT 'text' AS col, count(*) - count(text) AS nulls, count(DISTINCT text) AS kinds FROM documents UNION ALL SELECT 'lang', count(*) - count(lang), count(DISTINCT lang) FROM documents UNION ALL SELECT 'source', count(*) - count(source), count(DISTINCT source) FROM documents")
def s14(t, s):
    cols = ["text", "lang", "source"]
    one = t("documents").agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("kinds")).alias(c) for c in cols])
    return one.unpivot([], cols, "col", "x").select("col", "x.nulls", "x.kinds")


@query("s20_schema_evolution", "SELECT n_nationkey, CASE WHEN n_nationkey >= 10 THEN n_name END AS label FROM nation")
def s20(t, s):
    path = tables.scratch(s, "evolving")
    t("nation").where("n_nationkey < 10").select("n_nationkey").write.parquet(f"{path}/part=1")
    t("nation").where("n_nationkey >= 10").select("n_nationkey", F.col("n_name").alias("label")).write.parquet(f"{path}/part=2")
    return s.read.option("mergeSchema", True).parquet(path).select("n_nationkey", "label")


@query("s21_s19_table_metadata", "SELECT 1 AS version, 'x0' AS mark, (SELECT count(*) FROM region) AS n UNION ALL SELECT 2, 'x1', (SELECT count(*) FROM nation) UNION ALL SELECT 3, 'x0', (SELECT count(*) FROM region)")
def s21(t, s):
    """Two commits and a return to the first: versions, properties and rows from the table's own history."""
    v = tables.Versions(s, tables.scratch(s, "props"))
    v.commit(t("region"), mark="x0")
    v.commit(t("nation"), mark="x1")
    v.rollback(1)
    rows = None
    for k in (1, 2, 3):
        d = v.read(k).agg(F.count("*").alias("n")).withColumn("version", F.lit(k))
        rows = d if rows is None else rows.unionByName(d)
    return v.history().select("version", F.col("properties")["mark"].alias("mark")).join(rows, "version")


@query("k02c_one_writer", "SELECT count(*) AS n, 1 AS version FROM region")
def k02c(t, s):
    """Of two writers that began from the same version the later one fails and changes nothing."""
    root = tables.scratch(s, "writers")
    first, second = tables.Versions(s, root), tables.Versions(s, root)
    state = second.state
    second.state = lambda number=None: {"version": 0, "properties": {}} if number is None else state(number)  # what it saw when it began
    first.commit(t("region"))
    try:
        second.commit(t("nation"))
    except ValueError:
        return first.read().agg(F.count("*").alias("n")).withColumn("version", F.lit(first.version))
    raise ValueError("both were written")


@query("s22_metadata_count", "SELECT count(*) AS n FROM lineitem")
def s22(t, s):
    return t("lineitem").agg(F.count("*").alias("n"))  # needs no column: the footers' row counts


@query("s25_html_cards", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"[^\"]*\"'))::INTEGER AS n_links FROM pages")
def s25(t, s):
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit('<a href="[^"]*"')).alias("n_links"))


@query("s26_embedded_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s26(t, s):
    wrapped = F.concat(F.lit('self.push("result":{"item":'), "props", F.lit("}) tail"))
    return t("events").select("event_id", F.get_json_object(F.regexp_extract(wrapped, r'"result":(\{.*\})\)', 1), "$.item.k").cast("bigint").alias("k"))


@query("s32_json_export", "SELECT to_json({'r_regionkey': r_regionkey, 'r_name': r_name}) AS line FROM region")
def s32(t, s):
    return t("region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("line"))


@query("g22_resume", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def g22(t, s):
    done = tables.stored(t("customer").where("c_custkey % 3 = 0").select("c_custkey"), "done")
    return t("customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query("g23_contract", "SELECT max(l_linenumber) AS pages, max(l_linenumber) = count(DISTINCT l_linenumber) AS contiguous FROM lineitem")
def g23(t, s):
    return t("lineitem").agg(F.max("l_linenumber").alias("pages"), (F.max("l_linenumber") == F.count_distinct("l_linenumber")).alias("contiguous"))


@query("g21_rule_versions", "SELECT doc_id FROM documents WHERE (text LIKE '%the%') <> (text LIKE '%the %')")
def g21(t, s):
    a, b = t("documents").select("doc_id", F.col("text").contains("the").alias("x")), t("documents").select("doc_id", F.col("text").contains("the ").alias("y"))
    return a.join(b, "doc_id").where(~F.col("x").eqNullSafe(F.col("y"))).select("doc_id")


@query("z01_stream_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def z01(t, s):
    return windows.run_once(windows.daily, t("events").withColumn("ts", F.col("ts").cast("timestamp")), s)


@query("z02_stream_sessions", "SELECT user_id, min(ts) AS first, count(*) AS n FROM (SELECT *, sum(CASE WHEN b IS NULL OR ts > b + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sess FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)) GROUP BY user_id, sess")
def z02(t, s):
    g = t("events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").cast("timestamp_ntz").alias("first"), F.count("*").alias("n"))
    return g.select("user_id", "first", "n")
