"""Label batches: impacts of line removals computed in steps that commit line by line and are taken up again."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.operators import labels as L
from linehaul.operators import router as R
from linehaul.scratch import Scratch
from linehaul.sources import artifacts as A

ROUTER_VERSION = "rounds-1"


def removal_labels(calls: DataFrame, transfers: DataFrame, queries: DataFrame, lines: DataFrame, stations: int, rides: int, cap: int, scratch: Scratch, intact: DataFrame | None = None, thresholds: Sequence[int] = L.THRESHOLDS) -> DataFrame:
    """Impacts of the removal of ``lines`` (line) alone: other lines' removals are not routed. ``intact``: the routes as they are."""
    removed = scratch.table(R.line_removals(queries, lines), "removed")
    if intact is None:
        intact = scratch.table(R.one_to_all(calls, transfers, queries, rides, cap, scratch), "intact")
    hurt = scratch.table(R.one_to_all(calls, transfers, removed.select(*queries.columns), rides, cap, scratch), "hurt")
    return L.impact(intact, hurt, removed.select("query_id", "base", "removed", "departure"), stations, thresholds)


def verify_top(ranked: DataFrame, k: int, calls: DataFrame, transfers: DataFrame, queries: DataFrame, stations: int, rides: int, cap: int, scratch: Scratch | None = None) -> DataFrame:
    """The first ``k`` of ``ranked`` (line, place, ...) with the exact impacts of their removal beside what they were ranked by."""
    scratch = scratch or Scratch(calls.sparkSession, "verify")
    top = scratch.table(ranked.where(F.col("place") < k), "top")
    exact = removal_labels(calls, transfers, queries, top.select("line"), stations, rides, cap, scratch)
    return top.join(exact.withColumnRenamed("removed", "line"), "line", "left")


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order: their number and two sums of row hashes."""
    rows = [F.xxhash64(*sorted(df.columns)), F.xxhash64(F.lit("again"), *sorted(df.columns))]
    got = df.select(*[h.cast("decimal(20,0)").alias(f"h{k}") for k, h in enumerate(rows)]).agg(F.count(F.lit(1)).alias("n"), F.sum("h0").alias("a"), F.sum("h1").alias("b")).collect()[0]
    return A.fingerprint("table", [int(got["n"]), str(got["a"] or 0), str(got["b"] or 0), sorted(df.columns)])


class LabelBatch:
    """A folder of labels: ``manifest.json`` says what they are of, ``baseline`` has the routes as they are, ``labels/line=..`` a committed line each.

    A line's rows are written to a folder of the attempt and renamed into place, so that a line is there whole or not at
    all, and the first of two writers wins; both have the same rows. A batch taken up again with other queries,
    limits or another snapshot is refused. Renames are atomic where the folder's file system has them.
    """

    def __init__(self, spark: SparkSession, folder: str, snapshot: str, calls: DataFrame, transfers: DataFrame, queries: DataFrame, stations: int, rides: int = 5, cap: int = 7200, thresholds: Sequence[int] = L.THRESHOLDS):
        if not snapshot.strip():
            raise ValueError("a batch needs a snapshot")
        self.spark, self.folder, self.calls, self.transfers, self.queries = spark, folder, calls, transfers, queries
        self.stations, self.rides, self.cap, self.thresholds = stations, rides, cap, tuple(thresholds)
        self.policy = A.fingerprint("label-policy", {"rides": rides, "cap": cap, "thresholds": list(self.thresholds), "stations": stations})
        self._scratch = Scratch(spark, "batch")
        asked = {"snapshot": snapshot, "router_algorithm_version": ROUTER_VERSION, "policy_fingerprint": self.policy, "queries": table_digest(queries)}
        if A.exists(spark, f"{folder}/manifest.json"):
            have = A.read_json(spark, f"{folder}/manifest.json")
            if {k: have.get(k) for k in asked} != asked:
                raise ValueError(f"{folder} holds another batch")
            if table_digest(self.baseline()) != have.get("baseline_fingerprint"):
                raise ValueError(f"the baseline of {folder} was changed")
        else:
            attempt = self._attempt()
            R.one_to_all(calls, transfers, queries, rides, cap, self._scratch).write.parquet(attempt)
            A.rename_once(spark, attempt, f"{folder}/baseline")
            A.write_json(spark, f"{folder}/manifest.json", asked | {"baseline_fingerprint": table_digest(self.baseline())})

    def _attempt(self) -> str:
        return f"{self.folder}/_attempts/{uuid.uuid4().hex}"

    def baseline(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/baseline")

    def labels(self) -> DataFrame | None:
        """Committed labels, None while there are none."""
        if not A.exists(self.spark, f"{self.folder}/labels"):
            return None
        return self.spark.read.option("basePath", f"{self.folder}/labels").parquet(f"{self.folder}/labels").drop("line")

    def open_lines(self, lines: DataFrame) -> DataFrame:
        """Lines asked for that have no committed label. Labels twice of one line are an error."""
        wanted, have = lines.select("line").distinct(), self.labels()
        if have is None:
            return wanted
        if have.groupBy("removed").count().where("count > 1").limit(1).count():
            raise ValueError(f"{self.folder} has two labels of one line")
        return wanted.join(have.select(F.col("removed").alias("line")), "line", "left_anti")

    def run(self, lines: DataFrame, step: int = 64, most_steps: int | None = None) -> int:
        """Labels of the open ones of ``lines``, ``step`` lines to a job; how many were computed. ``most_steps`` ends early."""
        done = 0
        intact = self.baseline()
        open_ = self._scratch.table(self.open_lines(lines), "open")
        while most_steps is None or most_steps > 0:
            # a step's lines are a bounded list; the rest stays a table
            now = [r["line"] for r in open_.orderBy("line").limit(step).collect()]
            if not now:
                break
            part = self.spark.createDataFrame([(x,) for x in now], open_.schema)
            rows = removal_labels(self.calls, self.transfers, self.queries, part, self.stations, self.rides, self.cap, self._scratch, intact, self.thresholds)
            rows = rows.withColumns({"router_algorithm_version": F.lit(ROUTER_VERSION), "policy_fingerprint": F.lit(self.policy), "line": F.lower(F.hex(F.xxhash64("removed")))})
            attempt = self._attempt()
            rows.repartition("line").write.partitionBy("line").parquet(attempt)
            for name in A.folders(self.spark, attempt):
                A.rename_once(self.spark, f"{attempt}/{name}", f"{self.folder}/labels/{name}")
            done += len(now)
            open_ = open_.where(F.col("line") > F.lit(now[-1]))
            most_steps = None if most_steps is None else most_steps - 1
        return done

    def status(self, lines: DataFrame) -> str:
        return "in-progress" if self.open_lines(lines).limit(1).count() else "committed"
