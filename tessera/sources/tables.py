"""Tables in files: the registry of a folder, the shared folder, versioned writes, lineage and read-back."""

from __future__ import annotations

import json
import tempfile
import uuid
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not path:
        path = getattr(spark, "_tessera_shared", None)
        if path is None:
            path = spark._tessera_shared = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


_NOTED: list[list[str]] = []


@contextmanager
def noted():
    """The paths that stored() writes inside; those left in the list at the end count as the enclosing block's."""
    paths: list[str] = []
    _NOTED.append(paths)
    try:
        yield paths
    finally:
        _NOTED.pop()
        if _NOTED:
            _NOTED[-1].extend(paths)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    if _NOTED:
        _NOTED[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """All columns as text, quoted fields over several lines, doubled quotes; header, if given, must match in order."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False).csv(path)
    if header is not None and df.columns != header:
        raise ValueError(f"columns {df.columns} instead of {header}")
    return df


def read_drifting_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Like read_csv for files whose header or rows drift: columns by name where the file has them, null where not; _broken holds a row
    that has more or fewer fields than its file's header, and is null for whole rows."""
    files = [r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("path").collect()]
    out = None
    for f in files:
        own = read_csv(spark, f).columns
        fields = ", ".join(f"`{c}` string" for c in [*own, "_broken"])
        d = spark.read.schema(fields).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").csv(f)
        d = d.select(*[F.col(f"`{c}`") if c in own else F.lit(None).cast("string").alias(c) for c in header], "_broken")
        out = d if out is None else out.unionByName(d)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*header, "_broken"]))


def expect_rows(df: DataFrame, **expected: int) -> DataFrame:
    """df, or an error that names every _source_name whose rows are not as many as expected, missing and unknown ones included."""
    found = {r["_source_name"]: r["n"] for r in df.groupBy("_source_name").agg(F.count("*").alias("n")).collect()}  # a row a source
    wrong = {k: (expected.get(k), found.get(k)) for k in expected.keys() | found.keys() if expected.get(k) != found.get(k)}
    if wrong:
        raise ValueError(f"rows expected and found: {dict(sorted(wrong.items()))}")
    return df


# How a file begins that only points to its content.
POINTER = "version https://git-lfs.github.com/spec/"


def inputs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, digest, status) of files: READABLE, EMPTY, or POINTER where the content was not fetched."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    status = F.when(F.col("length") == 0, "EMPTY").when(F.substring("content", 1, len(POINTER)) == F.lit(POINTER).cast("binary"), "POINTER").otherwise("READABLE")
    return files.select("path", "length", F.sha2("content", 256).alias("digest"), status.alias("status"))


def against_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, state): SAME, CHANGED, MISSING or UNKNOWN, by digest. found: (name, digest); manifest: (name, digest)."""
    m = manifest.select(F.col("name").alias("m"), F.col("digest").alias("d"))
    state = F.when(F.col("m").isNull(), "UNKNOWN").when(F.col("name").isNull(), "MISSING").when(F.col("d") == F.col("digest"), "SAME").otherwise("CHANGED")
    return found.join(m, F.col("name") == F.col("m"), "full").select(F.coalesce("name", "m").alias("name"), state.alias("state"))


def with_lineage(df: DataFrame, source: str, batch_id: str, mode: str = "snapshot") -> DataFrame:
    """Where a batch came from: source, file, batch, snapshot date, mode and time of arrival."""
    return df.withColumns({"_source_name": F.lit(source), "_source_file": F.input_file_name(), "_batch_id": F.lit(batch_id), "_snapshot_date": F.try_to_date(F.lit(batch_id), "yyyyMMdd"), "_ingestion_mode": F.lit(mode), "_ingested_at": F.current_timestamp()})


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_batch(df: DataFrame, root: str, batch_id: str) -> str:
    """Write one immutable batch; a finished one is left alone, an unfinished one is an error."""
    spark, path = df.sparkSession, f"{root}/batch_id={batch_id}"
    if exists(spark, f"{path}/_SUCCESS"):
        return "SKIPPED"
    if exists(spark, path):
        raise ValueError(f"unfinished batch: {path}")
    df.write.parquet(path)
    if spark.read.parquet(path).count() != df.count():
        raise ValueError(f"rows of {path} differ from what was written")
    return "WRITTEN"


class Versions:
    """A table as numbered folders and numbered pointers: snapshots, time travel, tags and properties without a table format.

    A commit writes its folder, then its pointer under a number that must be free; the highest pointer is the table. A crash in between
    leaves the table as it was, and of two writers the later one fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self) -> list[int]:
        fs, p = _fs(self.spark, f"{self.root}/pointers")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()) if fs.exists(p) else []

    def state(self, number: int | None = None) -> dict:
        """version, folder, properties and time of a pointer, by default the current one."""
        numbers = self._numbers()
        if not numbers:
            return {"version": 0, "properties": {}}
        return json.loads(self.spark.read.text(f"{self.root}/pointers/{numbers[-1] if number is None else number}", wholetext=True).first()[0])

    @property
    def version(self) -> int:
        return self.state()["version"]

    def properties(self) -> dict[str, str]:
        return self.state()["properties"]

    def commit(self, df: DataFrame, by: list[str] | None = None, keep: str | None = None, **properties: str) -> int:
        """Write the next version, in folders by the columns of by, then point to it. keep: SQL over by of folders of the current version
        that stay as they are; they are read where they lie."""
        state = self.state()
        nxt = state["version"] + 1
        folder = f"v{nxt}-{uuid.uuid4().hex[:8]}"
        w = df.write
        (w.partitionBy(*by) if by else w).parquet(f"{self.root}/{folder}")
        parts = [[f, c if keep is None else f"({c}) AND ({keep})"] for f, c in state.get("parts", [])] if keep is not None else []
        self._point(nxt, {"version": nxt, "parts": [*parts, [folder, "true"]], "schema": df.schema.jsonValue(), "properties": state["properties"] | properties, "at": datetime.now(UTC).isoformat()})
        return nxt

    def rollback(self, version: int) -> int:
        """Make an older version the current one again, as a new version."""
        old, nxt = self.state(version), self.version + 1
        self._point(nxt, old | {"version": nxt, "at": datetime.now(UTC).isoformat()})
        return nxt

    def history(self) -> DataFrame:
        """(version, at, properties) of every version: the table's own metadata."""
        rows = [(s["version"], s["at"], s["properties"]) for s in map(self.state, self._numbers())]
        return self.spark.createDataFrame(rows, "version int, at string, properties map<string,string>")

    def _point(self, number: int, state: dict) -> None:
        fs, p = _fs(self.spark, f"{self.root}/pointers/{number}")
        fs.mkdirs(p.getParent())
        _, tmp = _fs(self.spark, f"{self.root}/pointers/.{number}-{uuid.uuid4().hex}")
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(tmp, p):
            fs.delete(tmp, False)
            raise ValueError(f"version {number} of {self.root} was written by another")

    def read(self, version: int | None = None) -> DataFrame:
        """The current or an older version."""
        state = self.state(version)
        schema = StructType.fromJson(state["schema"])
        out = None
        for folder, condition in state["parts"]:
            part = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").where(condition)
            out = part if out is None else out.unionByName(part)
        return out
