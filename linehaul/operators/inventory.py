"""The catalogue as tables: what a folder holds, what of it may be indexed, model versions, publications by version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linehaul.scratch import Scratch
from linehaul.sources import artifacts as A

#: Files by name, in the order in which their kinds depend on each other (fixed by the layout).
KINDS = {"source.json": "feed", "manifest.json": "snapshot", "labels.jsonl": "labels", "dataset-manifest.json": "dataset", "model.json": "model", "inference-result.json": "inference", "evaluation.json": "evaluation", "evaluation-result.json": "evaluation", "benchmark.json": "benchmark", "benchmark-result.json": "benchmark"}


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(artifacts, needs) of a folder tree: ``(id, kind, path, fingerprint)`` and ``(id, parent, fingerprint)``.

    An artifact is a file of a known name. Its id is the document's ``id`` or ``artifactId``, else its path; its
    fingerprint the document's, else the digest of the file. Needs are its ``inputArtifacts``. Files are read in tasks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    rows = files.select("path", F.try_element_at(kinds, name).alias("kind"), F.sha2("content", 256).alias("sha"), F.decode("content", "UTF-8").alias("text")).where("kind IS NOT NULL")
    key = lambda *names: F.coalesce(*[F.get_json_object("text", f"$.{n}") for n in names])
    parsed = rows.select(F.coalesce(key("id", "artifactId", "artifact_id"), "path").alias("id"), "kind", "path", F.coalesce(key("fingerprint"), "sha").alias("fingerprint"), F.from_json(key("inputArtifacts", "input_artifacts"), "array<struct<artifactId: string, fingerprint: string>>").alias("inputs"))
    needs = parsed.select("id", F.explode("inputs").alias("n")).select("id", F.col("n.artifactId").alias("parent"), F.col("n.fingerprint").alias("fingerprint")).distinct()
    return parsed.drop("inputs"), needs


def admit(artifacts: DataFrame, needs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(id, fingerprint, round)`` of the artifacts (id, fingerprint) that may be indexed: all they need is, with the fingerprint they name.

    A round admits what had its last need admitted in the round before, found by joining the new ones alone with the
    needs; so each need is met once, and a missing or changed parent keeps out all that hangs on it, as do cycles. An
    id with several fingerprints is ambiguous and stays out.
    """
    scratch = scratch or Scratch(artifacts.sparkSession, "admit")
    one = artifacts.groupBy("id").agg(F.min("fingerprint").alias("fingerprint"), F.max("fingerprint").alias("_other")).where("fingerprint = _other AND id IS NOT NULL").drop("_other")
    needs = scratch.table(needs.select("id", F.col("parent"), F.col("fingerprint").alias("want")).distinct(), "needs")
    open_ = scratch.table(one.join(needs.groupBy("id").agg(F.count(F.lit(1)).alias("left")), "id", "left").select("id", "fingerprint", F.coalesce("left", F.lit(0)).alias("left")), "open")
    done, k = None, 0
    while True:
        new = scratch.table(open_.where("left = 0").select("id", "fingerprint", F.lit(k).alias("round")), "new")
        if not new.limit(1).count():
            return done if done is not None else new
        done = new if done is None else done.unionByName(new)
        met = needs.join(new.select(F.col("id").alias("parent"), F.col("fingerprint").alias("want")), ["parent", "want"]).groupBy("id").agg(F.count(F.lit(1)).alias("met"))
        open_ = scratch.table(open_.where("left > 0").join(met, "id", "left").select("id", "fingerprint", (F.col("left") - F.coalesce("met", F.lit(0))).alias("left")), "open")
        k += 1


def generated_id(fingerprint):
    return F.concat(F.lit("model-"), F.left(fingerprint, F.lit(16)))


def register_models(existing: DataFrame, offered: DataFrame) -> DataFrame:
    """``(id, fingerprint, created, is_new)``: the versions there are and those that ``offered`` (requested, fingerprint, created) adds.

    Content wins over names: a fingerprint that is there keeps its id. A requested id that another fingerprint has, or
    that an earlier offer takes, gives way to one made from the fingerprint, so that no id ever changes its content.
    """
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy("created", F.col("requested").asc_nulls_last()))
    new = offered.where("fingerprint IS NOT NULL").withColumn("_k", first).where("_k = 1").drop("_k").join(existing.select("fingerprint"), "fingerprint", "left_anti")
    taken = existing.select(F.col("id").alias("requested"), F.lit(True).alias("_taken"))
    order = F.row_number().over(Window.partitionBy("requested").orderBy("created", "fingerprint"))
    new = new.join(taken, "requested", "left").withColumn("_k", order)
    own = F.col("requested").isNotNull() & F.col("_taken").isNull() & (F.col("_k") == 1)
    new = new.select(F.when(own, F.col("requested")).otherwise(generated_id(F.col("fingerprint"))).alias("id"), "fingerprint", "created", F.lit(True).alias("is_new"))
    return existing.select("id", "fingerprint", "created", F.lit(False).alias("is_new")).unionByName(new)


def alias(models: DataFrame) -> DataFrame:
    """One row: the id that ``candidate`` stands for, the model indexed last."""
    return models.agg(F.max_by("id", F.struct("created", "id")).alias("candidate"))


class Versions:
    """A table whose changes are whole versions ``v=0, v=1, ...``: one is added only after the one that its writer has seen."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def latest(self) -> int:
        """Number of the newest version, -1 before the first."""
        names = A.folders(self.spark, self.folder) if A.exists(self.spark, self.folder) else []
        return max([int(n[2:]) for n in names if n.startswith("v=")], default=-1)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        return self.spark.read.parquet(f"{self.folder}/v={version}")

    def commit(self, rows: DataFrame, seen: int) -> int:
        """Writes ``rows`` as the version after ``seen``; an error if another writer was first, whose version stays."""
        attempt = f"{self.folder}/_attempts/{uuid.uuid4().hex}"
        rows.write.parquet(attempt)
        if not A.rename_once(self.spark, attempt, f"{self.folder}/v={seen + 1}"):
            raise RuntimeError(f"{self.folder} has changed since version {seen}")
        return seen + 1


def publish(store: Versions, rows: DataFrame, catalogue: DataFrame, seen: int) -> int:
    """Commits a publication (rows with kind and id) if every row is ready in the ``catalogue`` (kind, id, status)."""
    ready = catalogue.where("status = 'ready'").select("kind", "id").distinct()
    missing = rows.join(ready, ["kind", "id"], "left_anti").limit(3).collect()
    if missing:
        raise ValueError(f"not ready: {', '.join(f'{r["kind"]} {r["id"]}' for r in missing)}")
    return store.commit(rows, seen)
