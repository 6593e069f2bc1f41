"""Slowly changing history: versions from observations, and its incremental upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import Versions, stored


def history(obs: DataFrame) -> DataFrame:
    """Versions of each key from (key, seen_at, batch, hash, ...): the first observation and every change of hash.

    Half-open validity; a value that comes back is a new version.
    """
    w = Window.partitionBy("key").orderBy("seen_at", "batch", "hash")
    changed = obs.withColumn("_before", F.lag("hash").over(w)).where("_before IS NULL OR _before <> hash").drop("_before")
    return changed.withColumns({"version": F.row_number().over(w), "valid_to": F.lead("seen_at").over(w)}).withColumnRenamed("seen_at", "valid_from").withColumn("is_current", F.col("valid_to").isNull())


def signatures(obs: DataFrame) -> DataFrame:
    """(key, signature): the number of a key's observations and sums of their hashes, whatever their order; nothing is gathered."""
    h = F.sha2(F.to_json(F.struct(*sorted(obs.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.sum(part(k)).cast("string") for k in range(4)]
    return obs.groupBy("key").agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("signature"))


def validated(obs: DataFrame) -> DataFrame:
    """obs, or an error for null keys, missing times or repeated grains; one pass."""
    bad = obs.agg(F.count_if(F.col("key").isNull()).alias("k"), F.count_if(F.col("seen_at").isNull()).alias("t"), (F.count("*") - F.count_distinct("key", "batch")).alias("g")).first()
    if bad["k"] or bad["t"] or bad["g"]:
        raise ValueError(f"null keys {bad['k']}, missing times {bad['t']}, repeated grains {bad['g']}")
    return obs


#: Folders of a history, by a hash of the key: a sync writes only those that a changed key is in. Versions that a table is read from at most.
BUCKETS, PIECES = 64, 16


def bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))


def sync(obs: DataFrame, target: Versions, state: Versions) -> str:
    """Bring target to history(obs): only keys whose signature changed are computed again, and only the folders they are in are written;
    the same input writes nothing.

    The state is trusted only if its checkpoint names the target's version. History commits before state, so a
    crash between the two is repaired by the next run.
    """
    new = stored(signatures(validated(obs)), "signatures")
    trusted = target.version > 0 and state.properties().get("history_version") == str(target.version)
    keep = None
    if target.version == 0:
        done, out = "FULL_REBUILD", bucketed(history(obs))
    else:
        old = state.read() if trusted else state.spark.createDataFrame([], new.schema)
        known = target.read().select("key").distinct() if not trusted else None
        moved = new.join(old.withColumnRenamed("signature", "old"), "key", "full").where(~F.col("signature").eqNullSafe(F.col("old"))).select("key")
        if known is not None:
            moved = moved.union(known).distinct()
        moved = stored(bucketed(moved), "moved")
        touched = sorted(r[0] for r in moved.select("bucket").distinct().collect())  # at most BUCKETS
        if not touched:
            return "NO_CHANGE"
        done = "MERGE_AFFECTED_KEYS" if trusted else "MERGE_RECONCILE"
        current = target.read()
        if len(target.state()["parts"]) < PIECES:
            keep = f"bucket NOT IN ({', '.join(map(str, touched))})"
            current = current.where(F.col("bucket").isin(touched))
        kept = current.join(moved.select("key"), "key", "left_anti")
        out = kept.unionByName(bucketed(history(obs.join(moved.select("key"), "key", "left_semi"))).select(*kept.columns))
        out = out.select(*[c for c in out.columns if c != "bucket"], "bucket")
    version = target.commit(out, by=["bucket"], keep=keep)
    state.commit(new, history_version=str(version))
    return done


def lifecycle(obs: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per (source, key): first and last seen, observations, span, price changes, missed latest batches, status.

    obs: (source, key, day, price). calendar: (source, day), batches without rows included. Changes do not bridge a
    missing or zero price; a source with one batch has no absence.
    """
    w = Window.partitionBy("source", "key").orderBy("day")
    steps = obs.withColumn("before", F.lag("price").over(w))
    changed = (F.col("before") > 0) & (F.col("price") > 0) & (F.col("price") != F.col("before"))
    seen = steps.groupBy("source", "key").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.count("*").alias("n_obs"), F.coalesce(F.count_if(changed), F.lit(0)).alias("price_changes"))
    last = calendar.groupBy("source").agg(F.sort_array(F.collect_set("day"), False).alias("days"))
    out = seen.join(F.broadcast(last), "source")
    missed = F.size(F.filter("days", lambda d: d > F.col("last_seen")))
    status = F.when(F.size("days") < 2, "not_applicable").when(missed == 0, "active").when(missed == 1, "missed_one").otherwise("absent")
    return out.select("source", "key", "first_seen", "last_seen", "n_obs", F.datediff("last_seen", "first_seen").alias("span_days"), "price_changes", missed.alias("missed"), status.alias("status"))
