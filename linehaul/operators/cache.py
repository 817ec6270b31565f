"""Vectors kept by what they were computed from: snapshots whose digest changed are computed again, others are read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.sources import artifacts as A


def snapshot_digests(tables: dict[str, DataFrame], key: str = "snapshot") -> DataFrame:
    """``(key, digest)``: of each snapshot a digest of its rows in all tables, whatever their order or partitioning.

    Rows are hashed twice and summed, on the map side first, so that a snapshot with most of the rows costs a row for
    each task. Repeated rows count; a table without rows of a snapshot is told from one that it has rows in.
    """
    parts = None
    for name, df in sorted(tables.items()):
        columns = [c for c in sorted(df.columns) if c != key]
        hashes = [F.xxhash64(F.lit(f"{name}{k}"), *columns).cast("decimal(38,0)") for k in (0, 1)]
        rows = df.select(key, *[h.alias(f"h{k}") for k, h in enumerate(hashes)]).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("h0").alias("a"), F.sum("h1").alias("b"))
        rows = rows.select(key, F.concat_ws(":", F.lit(name), *[F.col(c).cast("string") for c in ("n", "a", "b")]).alias("part"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), "|"), 256).alias("digest"))


class VectorCache:
    """A folder with the vectors of each (model, snapshot, digest) it has computed; what is there never changes.

    Snapshots are few, the rows of one are any number: names and digests pass through the driver, rows never do.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str):
        self.spark, self.folder, self.model = spark, folder, model

    def _path(self, snapshot, digest: str) -> str:
        return f"{self.folder}/{A.fingerprint('vectors', [self.model, str(snapshot), digest])}"

    def refresh(self, digests: DataFrame, compute: Callable[[list], DataFrame], key: str = "snapshot") -> list:
        """Computes what is missing of ``digests`` (key, digest) by ``compute(snapshots)`` and returns those snapshots."""
        missing = [(r[key], r["digest"]) for r in digests.collect() if not A.exists(self.spark, self._path(r[key], r["digest"]))]
        if not missing:
            return []
        names = self.spark.createDataFrame([(s, A.fingerprint("vectors", [self.model, str(s), d])) for s, d in missing], f"{key} {digests.schema[key].dataType.simpleString()}, _part string")
        attempt = f"{self.folder}/_attempts/{uuid.uuid4().hex}"
        # a row per snapshot: bounded
        compute([s for s, _ in missing]).join(F.broadcast(names), key).write.partitionBy("_part").parquet(attempt)
        for name in A.folders(self.spark, attempt):
            A.rename_once(self.spark, f"{attempt}/{name}", f"{self.folder}/{name.removeprefix('_part=')}")
        return sorted(s for s, _ in missing)

    def load(self, digests: DataFrame, key: str = "snapshot") -> DataFrame:
        """Vectors of exactly these digests; a snapshot without them, or with those of other rows alone, is an error."""
        wanted = [(r[key], self._path(r[key], r["digest"])) for r in digests.collect()]
        stale = [s for s, path in wanted if not A.exists(self.spark, path)]
        if stale or not wanted:
            raise ValueError(f"no vectors of {', '.join(map(str, stale[:5])) or 'any snapshot'} as they are now")
        return self.spark.read.parquet(*[path for _, path in wanted])
