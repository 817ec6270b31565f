"""Typed little-endian arrays as a data source: a folder of raw part files, which put one after another are the array."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from linehaul.operators.numbering import numbered
from linehaul.scratch import Scratch

#: Kinds of arrays and their little-endian types (fixed by the format).
TYPES = {"u32": "<u4", "f32": "<f4", "f16": "<f2"}
#: Values of a part file.
PART = 1 << 20
SCHEMA = "place long, value double"
_COLUMNS = pa.schema([("place", pa.int64()), ("value", pa.float64())])


@dataclass
class _Part(InputPartition):
    path: str
    start: int
    count: int


@dataclass
class _Wrote(WriterCommitMessage):
    parts: list


class ArrayStore(DataSource):
    """``spark.read.format("arrays")``: (place, value) of the array in ``path``; the option ``kind`` names its type."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["kind"], int(self.options.get("part", PART)))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _manifest(self) -> dict:
        fs, path = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{path}/manifest.json") as f:
            return json.loads(f.read())

    def partitions(self) -> list[_Part]:
        return [_Part(f"{self.path}/{name}", start, count) for name, start, count in self._manifest()["parts"]] or [_Part("", 0, 0)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        kind = np.dtype(TYPES[self._manifest()["kind"]])
        fs, path = pafs.FileSystem.from_uri(part.path)
        with fs.open_input_stream(path) as f:
            at = part.start
            while raw := f.read(kind.itemsize << 16):
                values = np.frombuffer(raw, kind).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(values))), pa.array(values)], schema=_COLUMNS)
                at += len(values)
        if at != part.start + part.count:
            raise ValueError(f"{part.path} has {at - part.start} values, not {part.count}")


class _Writer(DataSourceArrowWriter):
    """Runs of places go to part files of an attempt; the commit checks that they make one array and moves it into place."""

    def __init__(self, path: str, kind: str, part: int):
        if kind not in TYPES:
            raise ValueError(f"no array type {kind}")
        self.path, self.kind, self.part, self.attempt = path.rstrip("/"), kind, part, f"{path.rstrip('/')}.attempt-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        fs, folder = pafs.FileSystem.from_uri(self.attempt)
        fs.create_dir(folder, recursive=True)
        parts, out = [], None
        for b in iterator:
            place, value = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            if self.kind == "u32" and len(value) and (np.any(value != np.floor(value)) or value.min() < 0 or value.max() >= 2**32):
                raise ValueError("a value is not a 32-bit index")
            data = value.astype(TYPES[self.kind])
            cuts = np.flatnonzero((np.diff(place) != 1) | (place[1:] % self.part == 0)) + 1
            for p, v in zip(np.split(place, cuts), np.split(data, cuts), strict=True):
                if not len(p):
                    continue
                if out is None or p[0] % self.part == 0 or parts[-1][1] + parts[-1][2] != p[0]:
                    if out is not None:
                        out.close()
                    name = f"{int(p[0]):020d}-{uuid.uuid4().hex[:8]}"
                    parts.append([name, int(p[0]), 0])
                    out = fs.open_output_stream(f"{folder}/{name}")
                out.write(v.tobytes())
                parts[-1][2] += len(p)
        if out is not None:
            out.close()
        return _Wrote(parts)

    def commit(self, messages: list) -> None:
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p[1])
        at = 0
        for _, start, count in parts:
            if start != at:
                raise ValueError(f"places from {at} to {start} are missing or come twice")
            at += count
        fs, folder = pafs.FileSystem.from_uri(self.attempt)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/manifest.json") as f:
            f.write(json.dumps({"kind": self.kind, "size": at, "parts": parts}).encode())
        _, path = pafs.FileSystem.from_uri(self.path)
        fs.move(folder, path)

    def abort(self, messages: list) -> None:
        fs, folder = pafs.FileSystem.from_uri(self.attempt)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


def write_array(df: DataFrame, path: str, kind: str, part: int = PART) -> None:
    """``df`` (place, value), places from 0 without gaps, in files of ``part`` values; no file passes through the driver."""
    df.sparkSession.dataSource.register(ArrayStore)
    which = F.floor(F.col("place") / part)
    rows = df.select(F.col("place").cast("long").alias("place"), F.col("value").cast("double").alias("value")).repartition(which).sortWithinPartitions("place")
    rows.write.format("arrays").option("kind", kind).option("part", part).mode("append").save(path)


def read_array(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrayStore)
    return spark.read.format("arrays").load(path)


def write_matrix(df: DataFrame, index: str, vector: str, width: int, path: str, kind: str = "f32") -> None:
    """Rows by their index from 0, each an array of ``width`` values, as one array."""
    cells = df.select(F.col(index).alias("r"), F.posexplode(vector).alias("c", "value"))
    write_array(cells.select((F.col("r") * width + F.col("c")).alias("place"), "value"), path, kind)


def read_matrix(spark: SparkSession, path: str, width: int, index: str = "row", vector: str = "features") -> DataFrame:
    rows = read_array(spark, path).select(F.floor(F.col("place") / width).alias(index), F.struct("place", "value").alias("c"))
    return rows.groupBy(index).agg(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["value"]).alias(vector))


#: Relations of a graph: the columns that are indices and the table that each points into.
RELATIONS = {"serves": (("station", "station"), ("line", "line")), "transit": (("from_station", "station"), ("to_station", "station"), ("line", "line")), "transfers": (("from_station", "station"), ("to_station", "station")), "interchanges": (("line", "line"), ("other", "line"))}
WIDTHS = {"station_features": 16, "line_features": 18, "transit_features": 7}


def save_graph(graph: dict[str, DataFrame], folder: str, scratch: Scratch | None = None) -> None:
    """A graph as arrays: feature matrices, and for each relation a file of indices per end.

    ``graph``: station_features, line_features, edge_features, serves, transfers, interchanges. Stations and lines are
    numbered in their own order; their names are kept in ``stations`` and ``lines``, as tables.
    """
    scratch = scratch or Scratch(graph["line_features"].sparkSession, "graph")
    names = {}
    for kind in ("station", "line"):
        rows = scratch.table(numbered(graph[f"{kind}_features"], [kind], "row", scratch), kind)
        names[kind] = rows.select(kind, "row")
        names[kind].write.parquet(f"{folder}/{kind}s")
        write_matrix(rows, "row", "features", WIDTHS[f"{kind}_features"], f"{folder}/{kind}_features.f32")
    tables = {"serves": graph["serves"], "transit": graph["edge_features"], "transfers": graph["transfers"], "interchanges": graph["interchanges"]}
    for name, ends in RELATIONS.items():
        rows = tables[name]
        for c, kind in ends:
            rows = rows.join(names[kind].select(F.col(kind).alias(c), F.col("row").alias(f"_{c}")), c)
        order = [f"_{c}" for c, _ in ends]
        rows = scratch.table(numbered(rows.select(*order, *(["features"] if name == "transit" else [])), order, "row", scratch), name)
        for c in order:
            write_array(rows.select(F.col("row").alias("place"), F.col(c).alias("value")), f"{folder}/{name}{c}.u32", "u32")
        if name == "transit":
            write_matrix(rows, "row", "features", WIDTHS["transit_features"], f"{folder}/transit_features.f32")


def load_relation(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(row, index per end) of a relation."""
    out = None
    for c, _ in RELATIONS[name]:
        part = read_array(spark, f"{folder}/{name}_{c}.u32").select(F.col("place").alias("row"), F.col("value").cast("long").alias(c))
        out = part if out is None else out.join(part, "row", "full")
    return out


def graph_issues(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, issue, n)`` of a stored graph: values out of range or not finite, ends of unequal length, matrices of the wrong size. None means valid."""
    sizes = {k: spark.read.parquet(f"{folder}/{k}s").count() for k in ("station", "line")}
    found = []
    for name, ends in RELATIONS.items():
        rows = load_relation(spark, folder, name)
        found += [rows.where(F.col(c).isNull()).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{name}_{c}").alias("file"), F.lit("shorter than its other ends").alias("issue"), "n") for c, _ in ends]
        found += [rows.where(F.col(c) >= sizes[kind]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{name}_{c}").alias("file"), F.lit("index out of range").alias("issue"), "n") for c, kind in ends]
        if name == "transit":
            edges = rows.count()
    for name, width in WIDTHS.items():
        cells, want = read_array(spark, f"{folder}/{name}.f32"), width * (edges if name == "transit_features" else sizes[name.split("_")[0]])
        odd = F.isnan("value") | (F.abs("value") == float("inf"))
        found.append(cells.where(odd).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("file"), F.lit("not finite").alias("issue"), "n"))
        found.append(cells.agg(F.abs(F.count(F.lit(1)) - want).alias("n")).select(F.lit(name).alias("file"), F.lit("values too many or too few").alias("issue"), "n"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("n > 0")
