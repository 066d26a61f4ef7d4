"""Strict tables: fixed headers and schemas, and checks that raise instead of dropping rows; JSON reports; run folders."""

from __future__ import annotations

import hashlib
import io
import json
import os
import subprocess
import tempfile
import time
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Headers of the tables that tools exchange.
SCHEMAS = {
    "split": "query_id bigint, split string",
    "policy": "query_id bigint, ef int",
    "order": "row bigint",
    "deleted": "label bigint",
    "subset": "row bigint, source_row bigint, population_position bigint",
    "curves": "query_id bigint, split string, ef int, recall double, recall_tie_aware double, distance_computations bigint",
    "strata": "query_id bigint, split string, reached int, oracle_ef int, tier_label string, exceeds_high_tier int, difficulty string, censored int",
    "policy_eval": "query_id bigint, ef int, recall double, recall_tie_aware double, distance_computations bigint",
}


class TableError(ValueError):
    """Input that is missing, incomplete or repeated."""


def require(df: DataFrame, what: str, **rules) -> DataFrame:
    """df, after counting the rows that break each rule (a boolean column) in one pass; any breach raises."""
    found = df.agg(*[F.count(F.when(~F.coalesce(rule, F.lit(False)), 1)).alias(name) for name, rule in rules.items()]).first().asDict()
    broken = {k: n for k, n in found.items() if n}
    if broken:
        raise TableError(f"{what}: {broken}")
    return df


def unique(df: DataFrame, what: str, *keys: str) -> DataFrame:
    again = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if again:
        raise TableError(f"{what}: repeated key {again[0]}")
    return df


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table with exactly the header and types of SCHEMAS; a value that does not parse fails the read."""
    schema = SCHEMAS[table]
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    header = spark.read.text(path).limit(1).collect()
    if not header or header[0][0].strip() != ",".join(names):
        raise TableError(f"{path}: the header is not {','.join(names)}")
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    df = unique(read_csv(spark, path, "split"), path, "query_id")
    require(df, path, side=F.col("split").isin("train", "test"), id=F.col("query_id") >= 0)
    n, last = df.agg(F.count("*"), F.max("query_id")).first()
    if not n or last != n - 1:
        raise TableError(f"{path}: ids are not 0..n-1")
    return df


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    return require(unique(read_csv(spark, path, "policy"), path, "query_id"), path, ef=F.col("ef") > 0)


def read_deleted(spark: SparkSession, path: str, rows: int) -> DataFrame:
    return require(unique(read_csv(spark, path, "deleted"), path, "label"), path, range=F.col("label").between(0, rows - 1))


def read_order(spark: SparkSession, path: str, rows: int) -> DataFrame:
    return require(unique(read_csv(spark, path, "order"), path, "row"), path, range=F.col("row").between(0, rows - 1))


def write_csv(df: DataFrame, path: str, compressed: bool = False) -> None:
    df.write.mode("errorifexists").option("header", True).option("compression", "gzip" if compressed else "none").csv(path)


def write_json(obj, path: str) -> None:
    """Sorted keys and full precision; never over a file that is there."""
    with open(path, "x") as f:
        json.dump(obj, f, indent=2, sort_keys=True, default=lambda o: o.item() if hasattr(o, "item") else str(o))


def read_json(path: str):
    return json.loads(Path(path).read_text())


def sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def write_manifest(folder: str, *names: str) -> str:
    out = os.path.join(folder, "manifest.json")
    write_json({n: sha256(os.path.join(folder, n)) for n in names}, out)
    return out


def verify_manifest(folder: str) -> dict[str, str]:
    """Frozen files must be what the manifest says."""
    told = read_json(os.path.join(folder, "manifest.json"))
    for name, digest in told.items():
        if not os.path.exists(os.path.join(folder, name)) or sha256(os.path.join(folder, name)) != digest:
            raise TableError(f"{name} is not the file that was frozen")
    return told


def experiment_id(config: str, at: float | None = None) -> str:
    """Twelve hex digits of the configuration's hash and the time in UTC."""
    return f"{hashlib.sha256(config.encode()).hexdigest()[:12]}_{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime(at))}"


def provenance(spark: SparkSession, folder: str = ".") -> dict:
    git = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()
    return {"spark": spark.version, "pyspark": pyspark.__version__, "commit": git, "master": spark.sparkContext.master}


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at `path`, written by `make()` where it is not there yet; the path holds the key of its content."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spooled(df: DataFrame, name: str) -> DataFrame:
    """df written once to the folder that the cluster shares (spark.checkpoint.dir; a temporary one where none is set), read back.

    For tables that a plan uses several times: they are neither planned nor computed again, and a lost executor rereads them.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="halyard-")
    path = f"{folder.rstrip('/')}/halyard/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets, without the columns that name the run."""
    keep = [c for c in a.columns if c in b.columns and c != "experiment_id"]
    a, b = a.select(keep), b.select(keep)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def established(spark: SparkSession, path: str, make) -> DataFrame:
    """A table that is made once; a later run must make the same rows, or it is an error."""
    again = make()
    first = cached(spark, path, lambda: again)
    if not same_rows(first, again):
        raise TableError(f"{path} holds other rows than this run makes")
    return first


def run_steps(spark: SparkSession, folder: str, steps: list[tuple[str, object]], log: list[str] | None = None) -> dict[str, DataFrame]:
    """Run (name, function of the tables so far) in order, each to a table of its own; steps that are done are skipped."""
    out: dict[str, DataFrame] = {}
    for name, make in steps:
        def step(make=make, name=name):
            if log is not None:
                log.append(name)
            return make(out)

        out[name] = cached(spark, f"{folder}/{name}", step)
    return out


def read_npz(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(row, values array<double>) of one array of an .npz file, in row order; a vector has one value a row.

    The file is one object, so one task opens it, through Spark's own reader; objects (pickles) are refused, a missing array raises.
    """
    def rows(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    if name not in arrays:
                        raise TableError(f"no array {name!r}: {sorted(arrays)}")
                    x = np.atleast_1d(arrays[name]).astype(np.float64)
                x = x.reshape(len(x), -1)
                for at in range(0, len(x), 65536):
                    part = x[at:at + 65536]
                    ends = np.arange(len(part) + 1, dtype=np.int32) * x.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))], names=["row", "values"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "row bigint, values array<double>")
