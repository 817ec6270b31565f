"""Artifacts: content-addressed tables, manifests with hashes, datasets by split, label files, checkpoints."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SAFE_ID = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")
SPLITS = ("train", "validation", "test")


def stable_json(value) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(namespace: str, value) -> str:
    return hashlib.sha256(f"{namespace}:{stable_json(value)}".encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, or one that a pattern names."""
    fs, p = _fs(spark, path)
    return bool(fs.globStatus(p)) if any(c in path for c in "*?[{") else fs.exists(p)


def read_json(spark: SparkSession, path: str):
    """A small JSON document of any file system that Spark reads."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below one."""
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory())


def rename_once(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a file or folder to a name that nothing has yet; False, and ``source`` stays, where something has it."""
    fs, p = _fs(spark, target)
    fs.mkdirs(p.getParent())
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(jvm.org.apache.hadoop.fs.Path(source)), fs.makeQualified(p), none)
    except Exception as error:
        if fs.exists(p):
            return False
        raise error
    return True


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small JSON document that appears whole under its name; another one that is there is an error."""
    fs, temp = _fs(spark, f"{path}.part-{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    out.write(bytearray(stable_json(value).encode()))
    out.close()
    if not rename_once(spark, str(temp.toString()), path):
        fs.delete(temp, False)
        if read_json(spark, path) != value:
            raise FileExistsError(f"{path} has other content")


def save_snapshot(tables: dict[str, DataFrame], root: str, descriptor: dict) -> str:
    """Tables under the hash of their descriptor. The same snapshot again is left as it is; a half-written one is written anew."""
    snapshot_id = hashlib.sha256(stable_json(descriptor).encode()).hexdigest()
    folder, spark = f"{root}/{snapshot_id}", next(iter(tables.values())).sparkSession
    if exists(spark, f"{folder}/manifest"):
        return snapshot_id
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    rows = [(snapshot_id, stable_json(descriptor), name) for name in sorted(tables)]
    spark.createDataFrame(rows, "snapshot_id string, descriptor string, entity string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return snapshot_id


def load_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> dict[str, DataFrame]:
    """The tables of a snapshot whose manifest is of that identity."""
    folder = f"{root}/{snapshot_id}"
    manifest = spark.read.json(f"{folder}/manifest").collect()
    if {r["snapshot_id"] for r in manifest} != {snapshot_id} or hashlib.sha256(manifest[0]["descriptor"].encode()).hexdigest() != snapshot_id:
        raise ValueError(f"{folder} is not snapshot {snapshot_id}")
    return {r["entity"]: spark.read.parquet(f"{folder}/{r['entity']}") for r in manifest}


def save_dataset(examples: DataFrame, path: str) -> None:
    """Examples partitioned by split; a system in two splits is refused, and so is a dataset without one of the three."""
    from linehaul.operators.catalog import split_integrity

    if split_integrity(examples).limit(1).count():
        raise ValueError("a system is in more than one split")
    if {r["split"] for r in examples.select("split").distinct().limit(len(SPLITS) + 1).collect()} != set(SPLITS):
        raise ValueError(f"a dataset needs the splits {', '.join(SPLITS)}")
    examples.write.mode("errorifexists").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split; files of the others are not opened."""
    if split not in SPLITS:
        raise ValueError(f"no split {split}")
    return spark.read.option("basePath", path).parquet(f"{path}/split={split}")


def load_labels(spark: SparkSession, path: str, schema: str | StructType, router_version: str) -> DataFrame:
    """Label rows from JSON lines; rows of another router version or without a policy are an error."""
    rows = spark.read.schema(schema).json(path)
    if rows.where((F.col("router_algorithm_version") != router_version) | F.col("router_algorithm_version").isNull() | F.col("policy_fingerprint").isNull()).limit(1).count():
        raise ValueError("labels of another router version or without a policy")
    return rows


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder, hashed where they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def differences(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, bytes, sha256, found) where a manifest (path, bytes, sha256) and the files found differ.

    ``found`` is the digest of the file, null where it is missing; bytes and sha256 are null where the manifest does not name it.
    """
    f = found.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("found"))
    same = (F.col("found") == F.col("sha256")) & (F.col("_bytes") == F.col("bytes"))
    return manifest.select("path", "bytes", "sha256").join(f, "path", "full").where(~F.coalesce(same, F.lit(False))).drop("_bytes")


def verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Files of a manifest (path, bytes, sha256) that are missing or differ, and files found that it does not name."""
    return differences(manifest, found).select("path")


def write_json_once(path: str, value) -> None:
    """A result file on the driver's disk: written whole or not at all; other content under the same name is refused."""
    text = json.dumps(value, indent=2, sort_keys=True)
    if os.path.exists(path):
        with open(path) as old:
            if old.read() != text:
                raise FileExistsError(f"{path} has other content")
        return
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    os.replace(temp, path)


def safe_relative(path: str) -> bool:
    return bool(path) and not path.startswith("/") and "\\" not in path and all(p not in ("", ".", "..") for p in path.split("/"))
