"""Scans of JSONL and Parquet records with the checks of their gates, snapshots with manifests, and the scorer seam."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.expr import canonical_json
from weftline.operators.select import small
from weftline.session import ship
from weftline.sources.shared import Store, scratch, write_json

HELD_OUT_NAMES = ("test", "calibration", "heldout")


class ScanError(ValueError):
    """A scan's gate doesn't hold."""


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """JSONL rows with a fixed schema (S1). Blank lines are skipped; a missing or repeated key is an error."""
    df = spark.read.schema(schema).json(path)
    require_unique(df, key)
    return df


def require_unique(df: DataFrame, key: str) -> None:
    """Raise on null or repeated keys."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 OR `{key}` IS NULL OR `{key}` = ''").limit(3).collect()
    if bad:
        raise ScanError(f"{key} isn't unique: {[r[key] for r in bad]}")


def require_training_path(path: str) -> None:
    """Refuse a path with a component that names held-out data."""
    bad = [p for p in re.split(r"[/\\]", path) if p.lower().startswith(HELD_OUT_NAMES)]
    if bad:
        raise ScanError(f"held-out data in the path: {bad[0]}")


def guarded(df: DataFrame, families: DataFrame, split: str, key: str = "id", family: str = "family_id", declared: str | None = None, binding: dict | None = None) -> DataFrame:
    """The rows of a split, after its gates (S2, S3, J13): families of the split only, declared splits and bindings equal, keys unique, not empty."""
    require_unique(df, key)
    owned = families.where(F.col("split") == split).select(F.col("family_id").alias(family))
    problems = [("family outside the split", df.join(small(owned), family, "left_anti"))]
    if declared:
        problems.append(("declared split", df.where(~F.col(declared).eqNullSafe(F.lit(split)))))
    problems += [(f"binding {k}", df.where(~F.col(k).eqNullSafe(F.lit(v)))) for k, v in (binding or {}).items()]
    for name, rows in problems:
        if not rows.isEmpty():
            raise ScanError(name)
    if df.isEmpty():
        raise ScanError("no rows")
    return df


def read_records(spark: SparkSession, folder: str, schema: str, items: str = "accepted", run_id: str | None = None) -> DataFrame:
    """Many JSON records, one to a file, with their accepted rows one by one (S4). Adds record_path."""
    r = spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("record_path", F.col("_metadata.file_path"))
    if run_id is not None:
        r = r.where(F.col("run_id") == run_id)
    return r.select(*[c for c in r.columns if c != items], F.inline(items))


def not_yet(pool: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What a resumed run has left."""
    return pool.join(done.select(key).distinct(), key, "left_anti")


def file_hashes(spark: SparkSession, folder: str, skip: str = r"(^|/)(__pycache__|\.git|\.DS_Store)(/|$)") -> DataFrame:
    """path (below the folder), sha256 and length of every file (S12, S13); an empty folder is an error."""
    base = Store(spark, folder).path(folder).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    out = files.select(F.regexp_replace("path", f"^.*?{re.escape(base)}/", "").alias("path"), F.sha2("content", 256).alias("sha256"), "length").where(~F.col("path").rlike(skip))
    if out.isEmpty():
        raise ScanError(f"no files in {folder}")
    return out


def file_sha256(path: str, block: int = 1 << 20) -> str:
    """Of a small file on the driver, in blocks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(block):
            h.update(chunk)
    return h.hexdigest()


def publish(df: DataFrame, path: str, key: str, counts: list[str], fields: list[str] | None = None) -> dict:
    """An immutable snapshot (S7, S14): rows sorted by key as Parquet, canonical JSON lines beside them, and a manifest with counts and a content hash.

    All is written aside; the folder's move to its place is what makes it readable. Returns the manifest.
    """
    spark, aside = df.sparkSession, scratch(df.sparkSession, "snapshot")
    store = Store(spark, path)
    if store.exists(path):
        raise FileExistsError(path)
    df.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{aside}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{aside}/rows")
    line = canonical_json(F.struct(*sorted(fields or df.columns)))
    rows.repartitionByRange(key).sortWithinPartitions(key).select(line.alias("value")).write.text(f"{aside}/lines")
    each = rows.select(F.concat(F.col(key).cast("string"), F.lit(":"), F.sha2(line, 256)).alias("x"), *counts)
    # an order-free digest of any number of rows: the sum of their hashes' parts
    parts = [F.sum(F.conv(F.substring(F.sha2("x", 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    got = each.agg(F.count(F.lit(1)).alias("rows"), *parts).first()
    manifest = {"rows": got["rows"], "content": hashlib.sha256(":".join(str(got[f"p{i}"] or 0) for i in range(4)).encode()).hexdigest()}
    manifest |= {c: {str(r[c]): r["n"] for r in rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(c).collect()} for c in counts}  # dimensions of bounded size
    write_json(spark, f"{aside}/manifest.json", manifest)
    store.rename(aside, path)
    return manifest


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], result: str, key: str = "id") -> DataFrame:
    """The scorer seam (S16): a batch function over rows; where it fails, each row is tried alone and its failure is a row with an error, not an exception.

    result: the schema of the scorer's columns, key first; an error column is added.
    """
    ship(df.sparkSession)
    names = [x.strip().split()[0] for x in result.split(",")]

    def run(batches):
        for b in batches:
            try:
                yield scorer(b).assign(error=None)[[*names, "error"]]
            except Exception:
                for i in range(len(b)):
                    one = b.iloc[i : i + 1]
                    try:
                        yield scorer(one).assign(error=None)[[*names, "error"]]
                    except Exception as e:  # a failed row is a result
                        yield pd.DataFrame({n: [one[key].iloc[0] if n == key else None] for n in names} | {"error": [f"{type(e).__name__}: {e}"[:200]]})

    return df.mapInPandas(run, f"{result}, error string")
