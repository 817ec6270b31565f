"""Embedding near-dedup: int8 tile products with exact error bounds, full precision only for pairs in doubt.

A unit vector v is s*q + e with int8 q. For any two, |u.v - s_u*s_v*(q_u.q_v)| <= |e_u| + |e_v|*|s_u*q_u| (Cauchy-Schwarz).
Pairs whose product plus that bound stays below the threshold are out, those whose product less the bound reaches it
are in; of the vectors of all other pairs the full ones are fetched, and their cosines computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linehaul.operators.components import connected_components
from linehaul.scratch import Scratch

_KEY = 16
_TILE = "dim int, block int, keys binary, counts binary, q binary, s binary, e binary"
_FOUND = "key binary, gained long, reach binary, doubt boolean"
#: More than the rounding of the bounds themselves, which are sums and products of numbers of about 1.
_ROUNDING = 1e-9


def scaled(full: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest component near 1: exact, and no square overflows or vanishes."""
    return np.ldexp(full, -np.frexp(np.abs(full).max(1))[1][:, None])


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and the norm of what rounding lost, of each row."""
    s = np.maximum(np.abs(unit).max(1), 1e-300) / 127.0
    q = np.rint(unit / s[:, None]).astype(np.int8)
    e = np.linalg.norm(unit - q * s[:, None], axis=1)
    return q, s, e * (1 + 1e-9) + 1e-12


def codes(full: np.ndarray) -> dict[str, np.ndarray]:
    unit = scaled(full)
    q, s, e = quantise(unit / np.linalg.norm(unit, axis=1, keepdims=True))
    return {"q": q, "s": s, "e": e}


def products(a: np.ndarray, b: np.ndarray, width: int = 1024) -> np.ndarray:
    """Products of int8 codes: whole numbers that float32 holds exactly over up to 1040 components, float64 over the sum of such parts."""
    if a.shape[1] <= width:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((a[:, k : k + width].astype(np.float32) @ b[:, k : k + width].astype(np.float32).T).astype(np.float64) for k in range(0, a.shape[1], width))


def judged(a: dict, b: dict, threshold: float, same: bool, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) that may reach the threshold and whether they are in doubt; on the diagonal only i < j."""
    na = np.linalg.norm(a["q"].astype(np.float64), axis=1) * a["s"]
    for lo in range(0, len(a["q"]), rows):
        hi = min(lo + rows, len(a["q"]))
        dot = products(a["q"][lo:hi], b["q"])
        # a test on the product itself that keeps all that may count, then the bounds of each pair
        slack = a["e"][lo:hi, None] + na[lo:hi, None] * b["e"].max(initial=0.0)
        least = (threshold - slack) / a["s"][lo:hi, None] / b["s"].max(initial=1e-300) * (1 - 1e-6)
        i, j = np.nonzero(dot >= np.where(least > 0, least, -np.inf))
        if same:
            i, j = i[i + lo < j], j[i + lo < j]
        about, i = dot[i, j].astype(np.float64) * a["s"][i + lo] * b["s"][j], i + lo
        bound = a["e"][i] + na[i] * b["e"][j] + _ROUNDING
        may = about + bound >= threshold
        yield i[may], j[may], (about - bound < threshold)[may]


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of a[i] and b[j], in double precision, reaches the threshold."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        u, v = a[i[k : k + (1 << 16)]], b[j[k : k + (1 << 16)]]
        cosine = np.einsum("nd,nd->n", u, v) / (np.sqrt(np.einsum("nd,nd->n", u, u)) * np.sqrt(np.einsum("nd,nd->n", v, v)))
        out[k : k + (1 << 16)] = cosine >= threshold
    return out


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _pack(table: pa.Table) -> pa.Table:
    """The codes of one block's vectors as arrays in one row."""
    table = table.sort_by("key")
    c = codes(_stack(table["vector"]))
    keys = b"".join(table["key"].to_pylist())
    arrays = {"keys": keys, "counts": table["copies"].to_numpy().tobytes(), **{k: x.tobytes() for k, x in c.items()}}
    return pa.table({**{c: pa.array([table[c][0].as_py()], pa.int32()) for c in ("dim", "block")}, **{k: pa.array([x], pa.binary()) for k, x in arrays.items()}})


def _unpack(row: dict) -> dict:
    keys = [row["keys"][k : k + _KEY] for k in range(0, len(row["keys"]), _KEY)]
    n = len(keys)
    return {"keys": keys, "counts": np.frombuffer(row["counts"], np.int64), "q": np.frombuffer(row["q"], np.int8).reshape(n, -1), "s": np.frombuffer(row["s"], np.float64), "e": np.frombuffer(row["e"], np.float64)}


class _Links:
    """Links of a tile as sums per vector: how many vectors it gained, and the first one that it reaches inside the tile."""

    def __init__(self, a: dict, b: dict, same: bool):
        self.keys = a["keys"] if same else a["keys"] + b["keys"]
        self.counts = a["counts"] if same else np.concatenate([a["counts"], b["counts"]])
        self.shift = 0 if same else len(a["keys"])
        self.gain, self.reach = np.zeros(len(self.keys), np.int64), np.arange(len(self.keys))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        n, j = len(self.keys), j + self.shift
        self.gain += (np.bincount(i, self.counts[j], n) + np.bincount(j, self.counts[i], n)).astype(np.int64)
        # what was reached before stays linked
        self.reach = _smallest(n, np.concatenate([i, np.arange(n)]), np.concatenate([j, self.reach]))

    def table(self, doubt: np.ndarray) -> pa.Table:
        hit = np.flatnonzero((self.gain > 0) | doubt)
        columns = {"key": pa.array([self.keys[k] for k in hit], pa.binary()), "gained": pa.array(self.gain[hit]), "reach": pa.array([self.keys[k] for k in self.reach[hit]], pa.binary()), "doubt": pa.array(doubt[hit])}
        return pa.table(columns)


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Of one tile of codes the sure links, and which vectors are in pairs in doubt."""
        rows = sorted(table.select(["block", "keys", "counts", "q", "s", "e"]).to_pylist(), key=lambda r: r["block"])
        tile = {k: table[k][0].as_py() for k in ("dim", "_lo", "_hi")}
        same = tile["_lo"] == tile["_hi"]
        a, b = _unpack(rows[0]), _unpack(rows[-1])
        links = _Links(a, b, same)
        doubt = np.zeros(len(links.keys), bool)
        if same or len(rows) == 2:  # else no vector of this length is in the other block
            for i, j, unsure in judged(a, b, threshold, same):
                links.add(i[~unsure], j[~unsure])
                doubt[i[unsure]] = doubt[j[unsure] + links.shift] = True
        out = links.table(doubt)
        return out.append_column("dim", pa.array([tile["dim"]] * len(out), pa.int32())).append_column("lo", pa.array([tile["_lo"]] * len(out), pa.int32())).append_column("hi", pa.array([tile["_hi"]] * len(out), pa.int32()))

    return run


def _settle(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Of one tile the links among the pairs in doubt, from the full vectors of those in any such pair."""
        table = table.sort_by("key")
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        block = table["block"].to_numpy()

        def side(rows: np.ndarray) -> dict:
            some = table.take(pa.array(np.flatnonzero(rows)))
            full = _stack(some["vector"]) if len(some) else np.zeros((0, table["dim"][0].as_py()))
            return {"keys": some["key"].to_pylist(), "counts": some["copies"].to_numpy(), "full": scaled(full) if len(full) else full, **(codes(full) if len(full) else {"q": full.astype(np.int8), "s": full[:, 0], "e": full[:, 0]})}

        a = side(block == lo)
        b = a if lo == hi else side(block == hi)
        links = _Links(a, b, lo == hi)
        for i, j, unsure in judged(a, b, threshold, lo == hi):
            i, j = i[unsure], j[unsure]
            yes = exact(a["full"], b["full"], i, j, threshold)
            links.add(i[yes], j[yes])
        return links.table(np.zeros(len(links.keys), bool)).select(["key", "gained", "reach"])

    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.95, tile: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors``, all compared with all.

    Equal vectors are one in the comparison and count as often as they occur, so a group of copies costs nothing.
    Distinct vectors of one length go to blocks of about ``tile``; each pair of blocks is one task, which gets codes
    and returns sums per vector, never pairs. A tile with pairs in doubt gets the full vectors of those, and no others.
    Vectors that are null, empty, zero, or hold null or non-finite components, link with nothing, and so do vectors
    of different lengths. Rows repeated with the same id are vectors of their own, each with its links and component; a
    null id is its own component with no links. Ids are integers. An empty table gives an empty result.
    """
    spark: SparkSession = vectors.sparkSession
    scratch = Scratch(spark, "embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("id").isNotNull() & F.coalesce((F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are equal; the key of a group of equal vectors is the first half of their SHA-256
    digest = F.sha2(F.to_binary(F.array_join(F.transform("vector", lambda x: (x + 0.0).cast("string")), ","), F.lit("utf-8")), 256)
    keyed = rows.where(good).select("id", F.unhex(F.substring(digest, 1, 2 * _KEY)).alias("key"), F.transform("vector", lambda x: x + 0.0).alias("vector"))
    members = scratch.table(keyed.select("id", "key"), "members")
    reps = scratch.table(members.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps")
    one = keyed.withColumnRenamed("key", "_key").join(reps, (F.col("_key") == F.col("key")) & (F.col("id") == F.col("rep")))
    blocks = max(1, -(-reps.count() // tile))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    # one row of each key: the row of its smallest id, which may be there more than once
    distinct = scratch.table(one.select("key", "copies", "vector", F.size("vector").alias("dim"), block.alias("block")).dropDuplicates(["key"]), "distinct")
    packed = scratch.table(distinct.groupBy("dim", "block").applyInArrow(_pack, _TILE), "blocks")
    # block i meets every other: the tile's key is the pair of blocks, the smaller first
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiles = packed.withColumn("_o", other).withColumn("_lo", F.least("block", "_o").cast("int")).withColumn("_hi", F.greatest("block", "_o").cast("int")).drop("_o")
    sure = scratch.table(tiles.groupBy("dim", "_lo", "_hi").applyInArrow(_compare(threshold), f"{_FOUND}, dim int, lo int, hi int"), "sure")
    doubts = sure.where("doubt").select("key", "lo", "hi").join(distinct, "key")
    settled = scratch.table(doubts.groupBy("dim", "lo", "hi").applyInArrow(_settle(threshold), "key binary, gained long, reach binary"), "settled")
    found = sure.where("gained > 0").select("key", "gained", "reach").unionByName(settled)
    sums = found.groupBy("key").agg(F.sum("gained").alias("gained"))
    component = scratch.table(connected_components(spark, found.select("key", "reach"), "key", "reach", scratch).withColumnRenamed("node", "key"), "component")
    low = component.join(reps.select("key", "rep"), "key").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_key = reps.join(sums, "key", "left").join(component.join(low, "component").select("key", "component_id"), "key", "left")
    of_key = of_key.select("key", (F.coalesce("gained", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = members.join(scratch.table(of_key, "of_key"), "key").select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
