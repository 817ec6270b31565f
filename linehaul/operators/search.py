"""Vector operators: exact neighbours, facet profiles, comparisons, centroids, triplets, message passing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linehaul.functions import scalars as S
from linehaul.scratch import Scratch


#: Queries up to this many are sent to every task that has candidates; more of them are dealt out in blocks.
QUERIES_AT_ONCE, SPREAD = 10_000, 64


def top_similar(queries: DataFrame, candidates: DataFrame, k: int, similarity: Column, same: Column | None = None, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """The k most similar candidates of each query: similarity downwards, then name, then id.

    ``queries`` (q_id, q_...) are a set stated by the caller and meet all candidates (id, name, ...), as the metric asks:
    a few, which are counted, in every task; more of them in blocks, each of which meets all candidates. Of each query a
    task hands on its k best alone, so that what is shuffled grows with tasks and not with candidates. ``same`` marks
    pairs to leave out.
    """
    if queries.limit(at_once + 1).count() <= at_once:
        both = candidates.crossJoin(F.broadcast(queries))
    else:
        blocks = -(-queries.count() // at_once)
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
        # a candidate's rows of a block are spread too, so that a block is as many tasks as there are places
        dealt = queries.withColumn("_block", F.pmod(F.xxhash64("q_id"), F.lit(blocks)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_place"))
        both = candidates.select("*", every, F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int").alias("_place")).join(dealt, ["_block", "_place"])
    both = both.where(~same) if same is not None else both
    order = [F.desc("similarity"), F.col("name"), F.col("id")]
    scored = both.select("q_id", "id", "name", similarity.alias("similarity"))
    # Spark turns a limit on a row number into one in every task ahead of the shuffle
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Width of the band around a bound of a product of units in which exact values decide, many times their rounding errors.
BAND = 1e-9


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows filled up with zeros, and their lengths; null is empty."""
    flat, sizes = column.combine_chunks(), pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out, sizes


def _longest(*columns: pa.ChunkedArray) -> int:
    return max((pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns), default=0)


def _place_by_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed in the order of the places, as a fold over an array does."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out = out + a[:, k] * b[:, k]
    return out


def _tile_top(k: int, facets: list[float], grouped: bool):
    """Of each query of a tile its k best candidates of the tile: product of units first, exact values for those in reach."""
    schema = pa.schema([("q_id", pa.int64()), ("id", pa.int64()), ("name", pa.string()), ("similarity", pa.float64())])

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return schema.empty_table()
        candidates = candidates.sort_by([("name", "ascending"), ("id", "ascending")])
        q_id, ids, rows = queries["q_id"].to_numpy(), candidates["id"].to_numpy(), []
        sides, near = [], np.zeros((len(q_id), len(ids)))
        for f, weight in enumerate(facets):
            width = _longest(queries[f"_v{f}"], candidates[f"_v{f}"])
            (x, m), (y, n) = (_matrix(t[f"_v{f}"], width) for t in (queries, candidates))
            nx, ny = (np.sqrt(_place_by_place(v, v)) for v in (x, y))
            unit = lambda v, s: np.divide(v, s[:, None], out=np.zeros_like(v), where=s[:, None] != 0)
            part = unit(x, nx) @ unit(y, ny).T
            if (m != m[0]).any() or (n != m[0]).any():
                part[m[:, None] != n[None, :]] = 0.0
            near += weight * part
            sides.append((weight, x, y, nx, ny, m, n))
        out = q_id[:, None] == ids[None, :]
        if grouped:
            mine, theirs = queries["_group"].to_numpy(zero_copy_only=False), candidates["_group"].to_numpy(zero_copy_only=False)
            out |= mine[:, None] != theirs[None, :]
        near[np.isnan(near)] = np.inf  # what has no number in a product is decided by its exact value
        lacks = queries["_null"].to_numpy(zero_copy_only=False)[:, None] | candidates["_null"].to_numpy(zero_copy_only=False)[None, :]
        near[lacks], near[out] = -1e300, -np.inf  # without a value, but last
        most = min(k, len(ids))
        bound = np.partition(near, len(ids) - most, axis=1)[:, len(ids) - most] - BAND
        for i in range(len(q_id)):
            at = np.flatnonzero((near[i] >= bound[i]) & ~out[i])
            value = np.zeros(len(at))
            for weight, x, y, nx, ny, m, n in sides:
                length = nx[i] * ny[at]
                dot = _place_by_place(np.broadcast_to(x[i], (len(at), x.shape[1])), y[at])
                with np.errstate(all="ignore"):
                    value = value + weight * np.where((n[at] == 0) | (n[at] != m[i]) | (length == 0), 0.0, dot / length)
            # NaN is the largest, as in Spark's order; of equals the first by name, then id
            best = np.lexsort((at, np.where(np.isnan(value), -np.inf, -value), lacks[i, at]))[:k]
            rows.append((np.full(len(best), q_id[i]), at[best], value[best], lacks[i, at[best]]))
        at = np.concatenate([r[1] for r in rows])
        return pa.table([np.concatenate([r[0] for r in rows]), ids[at], candidates["name"].take(pa.array(at)), pa.array(np.concatenate([r[2] for r in rows]), mask=np.concatenate([r[3] for r in rows]))], schema=schema)

    return run


def top_cosine(queries: DataFrame, candidates: DataFrame, k: int, facets: dict[str, float], group: str | None = None, tile: int = 2000) -> DataFrame:
    """``top_similar`` for a weighted sum of cosines: exact, by products of tiles.

    ``queries`` (q_id, a column for each facet) and ``candidates`` (id, name, the same columns), both with ``group`` where
    only rows of one value of it are to meet; a row does not meet its own id. A task is a tile of queries and a tile of
    candidates. The product says which candidates may be among the k best, those alone get the value of
    ``facet_similarity``, and k rows of each query leave the task.
    """
    vector = lambda c: F.col(c).cast("array<double>")
    extra = [F.col(group).alias("_group")] if group else []
    lacks = [F.col(c).isNull() | F.exists(c, lambda x: x.isNull()) for c in facets]
    columns = [*extra, F.coalesce(reduce(lambda a, b: a | b, lacks), F.lit(True)).alias("_null"), *[vector(c).alias(f"_v{i}") for i, c in enumerate(facets)]]
    queries, candidates = (df.where(F.col(group).isNotNull()) if group else df for df in (queries, candidates))
    tiles = lambda df: max(1, -(-df.count() // tile))
    nq, nc = tiles(queries), tiles(candidates)
    dealt = lambda df, id_, n, name: df.withColumn(name, F.pmod(F.xxhash64(id_), F.lit(n)))
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    q = dealt(queries.select(F.col("q_id").cast("long").alias("q_id"), *columns), "q_id", nq, "_q").select("*", every(nc, "_c"))
    c = dealt(candidates.select(F.col("id").cast("long").alias("id"), "name", *columns), "id", nc, "_c").select("*", every(nq, "_q"))
    found = q.groupBy("_q", "_c").cogroup(c.groupBy("_q", "_c")).applyInArrow(_tile_top(k, list(facets.values()), group is not None), "q_id long, id long, name string, similarity double")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("similarity"), "name", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def facet_similarity(weights: dict[str, float], suffixes: tuple[str, str] = ("_q", "_c")) -> Column:
    """Weighted sum of the cosines of the facets."""
    return sum((F.lit(w) * S.cosine_similarity(F.col(f"{name}{suffixes[0]}"), F.col(f"{name}{suffixes[1]}")) for name, w in weights.items()), F.lit(0.0))


def centroid(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """Element-wise mean per group, in long form (group, pos, value)."""
    return df.select(*group, F.posexplode(vector).alias("pos", "v")).groupBy(*group, "pos").agg(F.avg(F.col("v").cast("double")).alias("value"))


def collect_vector(long: DataFrame, group: list[str], name: str = "vector") -> DataFrame:
    """Long form back to arrays; a vector's length bounds a group."""
    return long.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias(name))


def _codes(a: pa.Table, b: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the values are; null is a value of its own, -1."""
    both = pa.chunked_array([*a[name].chunks, *b[name].chunks], a[name].type).combine_chunks().dictionary_encode()
    codes = pc.fill_null(both.indices, -1).to_numpy().astype(np.int64)
    return codes[: len(a)], codes[len(a) :]


#: Rows whose products with a block are made at once, few enough to stay in a processor's cache.
STRIP = 500


def _blocks(block: int):
    """A task's rows as Arrow tables of about ``block`` of them, each in one binary value, with what any pair of blocks needs of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        rows = pa.Table.from_batches(rows)
        ends = np.linspace(0, len(rows), max(1, round(len(rows) / block)) + 1).astype(int)
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            t = rows.slice(lo, hi - lo).combine_chunks()
            ids, group, snapshot = t["id"].to_numpy(), _groups(t, t)[0], _codes(t, t, "snapshot")[0]
            kin = (group[:, None] == group[None, :]) & (snapshot[:, None] != snapshot[None, :]) & (ids[:, None] != ids[None, :])
            x, m = _matrix(t["unit"], _longest(t["unit"]))
            # of copies that are kin to the same items any anchor takes the smallest id, or if that is its own the next
            alike = np.unique(np.column_stack([group, snapshot, m, (x + 0.0).view(np.int64)]), axis=0, return_inverse=True)[1].ravel()
            order = np.lexsort((ids, alike))
            a, i = alike[order], ids[order]
            new = np.diff(a, prepend=-1) != 0
            step = np.cumsum(new | (np.diff(i, prepend=i[0]) != 0))
            few = np.zeros(len(t), bool)
            few[order] = step - np.repeat(step[new], np.diff(np.append(np.flatnonzero(new), len(a)))) < 2
            t = t.append_column("lone", pa.array(~kin.any(1))).append_column("few", pa.array(few))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t)
            yield pa.RecordBatch.from_pydict({"rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return run


class _Block:
    """The rows of a block, and of each of them the best found: nearest kin, nearest of all if it is lone, farthest, as (value, id)."""

    def __init__(self, data: pa.Buffer, best: dict | None):
        self.table = pa.ipc.open_stream(data).read_all()
        self.ids = self.table["id"].to_numpy()
        self.x, self.m = _matrix(self.table["unit"], _longest(self.table["unit"]))
        self.rough, self.flat = self.x.astype(np.float32), ~self.x.any(1)
        self.lone, self.few = (self.table[c].to_numpy(zero_copy_only=False) for c in ("lone", "few"))
        self.best = best or {k: (np.full(len(self.ids), np.inf), np.zeros(len(self.ids), np.int64)) for k in ("kin", "all", "far")} | {"ids": self.ids.copy()}


def _groups(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of (system, identity) that are equal where both are."""
    (p, q), (r, s) = _codes(a, b, "system"), _codes(a, b, "identity")
    width = max(r.max(), s.max()) + 2
    return (p + 1) * width + r + 1, (q + 1) * width + s + 1


def _improve(kind: str, dots: np.ndarray, a: _Block, rows: np.ndarray, b: _Block, cols: np.ndarray, axis: int = 1, pairs: int = 1 << 19) -> None:
    """The best of ``rows`` of ``a`` after ``cols`` of ``b``; ``dots`` are their products, with ``cols`` along ``axis``, infinite where a pair is left out.

    The value is the distance, for the farthest its negative. Products are of single precision: what may be as good
    as the best so far gets its exact value, summed place by place, so that equal vectors are equally far.
    """
    if not len(rows) or not len(cols):
        return
    sign, (value, found), width = -1 if kind == "far" else 1, a.best[kind], min(a.x.shape[1], b.x.shape[1])
    error = (width + 8) * 2.0**-23  # twice what rounding of values and sums of products of units can come to

    def keep(i: np.ndarray, exact: np.ndarray, ids: np.ndarray) -> None:
        better = (exact < value[i]) | ((exact == value[i]) & (ids < found[i]))
        value[i[better]], found[i[better]] = exact[better], ids[better]

    flat = a.flat[rows]
    if flat.any():  # at 1 from all: the smallest id
        part = dots[flat] if axis else dots[:, flat]
        has, ids = np.isfinite(part), b.ids[cols] if axis else b.ids[cols, None]
        ids, some = np.where(has, ids, np.iinfo(np.int64).max).min(axis), has.any(axis)
        keep(rows[flat][some], np.full(some.sum(), float(sign)), ids[some])
    top = sign * (1 - (dots.max(axis) if sign > 0 else dots.min(axis)).astype(np.float64))
    may = np.flatnonzero(np.isfinite(top) & (top - error <= value[rows]) & ~flat)
    for lo in range(0, len(may), step := max(1, pairs // len(cols))):
        some = may[lo : lo + step]
        edge = (1 - sign * np.minimum(top[some] + 2 * error, value[rows[some]] + error)).astype(np.float32)
        part, edge = (dots[some], edge[:, None]) if axis else (dots[:, some], edge)
        at = divmod(np.flatnonzero(part >= edge if sign > 0 else part <= edge), part.shape[1])
        i, j = rows[some][at[1 - axis]], cols[at[axis]]
        exact = np.clip(1 - _place_by_place(a.x[i, :width], b.x[j, :width]), 0, 2)
        exact[a.m[i] != b.m[j]] = 1.0
        exact, ids = sign * exact, b.ids[j]
        order = np.lexsort((ids, exact, i))
        order = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        keep(i[order], exact[order], ids[order])


def _meet(a: _Block, b: _Block, strip: int = STRIP) -> None:
    """All of two blocks, or of one, against each other, by one product for both."""
    width, both = min(a.x.shape[1], b.x.shape[1]), a is not b
    (ga, gb), (sa, sb) = _groups(a.table, b.table), _codes(a.table, b.table, "snapshot")
    shared, twice, mixed = np.intersect1d(ga, gb), not both or np.isin(a.ids, b.ids).any(), (a.m != a.m[0]).any() or (b.m != a.m[0]).any()
    every, right = np.arange(len(b.ids)), b.rough[:, :width].T
    for lo in range(0, len(a.ids), strip):
        rows = np.arange(lo, min(lo + strip, len(a.ids)))
        dots = a.rough[rows, :width] @ right
        if mixed:
            dots[a.m[rows, None] != b.m[None, :]] = 0.0
        for g in np.intersect1d(shared, ga[rows]) if len(shared) else ():
            i, j = np.flatnonzero(ga[rows] == g), np.flatnonzero(gb == g)
            some = dots[np.ix_(i, j)]
            i += lo
            some[(sa[i][:, None] == sb[j][None, :]) | (a.ids[i][:, None] == b.ids[j][None, :])] = -np.inf
            few = b.few[j]
            _improve("kin", some[:, few], a, i, b, j[few])
            if both:
                few = a.few[i]
                _improve("kin", some[few], b, j, a, i[few], 0)
        own = np.nonzero(a.ids[rows, None] == b.ids[None, :]) if twice else None
        few, few_b = np.flatnonzero(a.few[rows]), np.flatnonzero(b.few)
        for kind, out in (("far", np.inf), ("all", -np.inf)):
            if twice:
                dots[own] = out
            alone = lambda x, r: r if kind == "far" else r[x.lone[r] & np.isinf(x.best["kin"][0][r])]
            mine, theirs = alone(a, rows), alone(b, every)
            _improve(kind, _some(_some(dots, mine - lo, 0), few_b, 1), a, mine, b, few_b)
            if both:
                _improve(kind, _some(_some(dots, theirs, 1), few, 0), b, theirs, a, few + lo, 0)


def _some(dots: np.ndarray, at: np.ndarray, axis: int) -> np.ndarray:
    return dots if len(at) == dots.shape[axis] else dots.take(at, axis)


_BEST = "anchor long, other int, near double, positive long, far double, negative long"


def _best_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item of the blocks that a task pairs its nearest kin, or nearest other, and its farthest."""
    best, left, number = {}, None, None
    for batch in batches:
        for a, b, rows_a, rows_b in zip(*(batch[c] for c in ("_a", "_b", "rows_a", "rows_b")), strict=True):
            a, b = a.as_py(), b.as_py()
            if number != a:
                left, number = _Block(rows_a.as_buffer(), best.get(a)), a
                best[a] = left.best
            right = left if a == b else _Block(rows_b.as_buffer(), best.get(b))
            best[b] = right.best
            _meet(left, right)
    for found in best.values():
        some, has = np.isfinite(found["far"][0]), np.isfinite(found["kin"][0])
        near, positive = (np.where(has, found["kin"][k], found["all"][k]) for k in (0, 1))
        columns = [found["ids"], (~has).astype(np.int32), near, positive, -found["far"][0], found["far"][1]]
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], ["anchor", "other", "near", "positive", "far", "negative"])


#: Bytes of vectors that a task of ``triplets`` has of each side.
SIDE = 64 << 20


def triplets(items: DataFrame, margin: float = 0.001, block: int = 2000) -> DataFrame:
    """Per anchor the nearest of its identity elsewhere, else the nearest other, and the farthest that is at least ``margin`` farther.

    ``items``: id, system, identity, snapshot, vector. All are compared with all, as the metric asks, in blocks of about
    ``block`` items, ordered so that kin are in few pairs of blocks. Blocks are written once to the shared folder, where
    every task reads a range of them for each side: no vector is shuffled for the blocks that it meets. A task meets each
    pair of its blocks once, for the anchors of both, and returns a row for each anchor of its two sides.
    """
    spark = items.sparkSession
    items = items.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "system", "identity", "snapshot", "vector")
    rows, width = items.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks, width = max(1, -(-rows // block)), min(max(width or 0, 0), 512)  # picks are fewer than 512
    order = ["system", "identity", "id"]
    picked = F.col("picked")
    unit = F.transform(picked, lambda x: F.when(F.col("norm") == 0, 0.0).otherwise(x / F.col("norm")))
    # a block is a file, so that sides can be read in any number
    dealt = items.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("picked", S.bounded_picks(F.col("vector"))).withColumn("norm", S.norm(picked))
    packed = dealt.select("id", "system", "identity", "snapshot", unit.alias("unit")).mapInArrow(_blocks(block), "rows binary")
    packed = Scratch(spark, "triplets").table(packed.select("rows", F.monotonically_increasing_id().alias("_n")), "blocks")
    sides = max(1, min(blocks, max(-(-rows * width * 8 // SIDE), math.isqrt(4 * spark.sparkContext.defaultParallelism - 1) + 1)))
    a, b = (packed.select(F.col("_n").alias(f"_{x}"), F.col("rows").alias(f"rows_{x}")).coalesce(sides) for x in "ab")
    # one of the two orders of a pair, by a hash, so that every task has half of its pairs
    once = F.when(F.pmod(F.xxhash64(F.col("_a") + F.col("_b")), F.lit(2)) == 0, F.col("_a") <= F.col("_b")).otherwise(F.col("_a") >= F.col("_b"))
    found = a.join(b.hint("shuffle_replicate_nl"), once).mapInArrow(_best_of_pairs, _BEST)
    best = found.groupBy("anchor").agg(F.min_by(F.struct("positive", "near"), F.struct("other", "near", "positive")).alias("p"), F.max_by(F.struct("negative", "far"), F.struct("far", -F.col("negative"))).alias("n"))
    return best.where(F.col("n.far") >= F.col("p.near") + margin).select("anchor", "p.positive", "n.negative", (F.col("n.far") - F.col("p.near")).alias("gap"))


def message_mean(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean of the values that arrive at each node over its edges: nodes (node, pos, value), edges (src, dst)."""
    return edges.join(nodes.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "pos").agg(F.avg("value").alias("value"))


def weighted_mean(df: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*group).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def pooled(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """Per group and place of its vectors the mean and the largest value, 0 at least."""
    return df.select(*group, F.posexplode(vector).alias("pos", "v")).groupBy(*group, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.greatest(F.max(F.col("v").cast("double")), F.lit(0.0)).alias("most"))


def sequence_bins(df: DataFrame, group: list[str], place: str, size: str, values: list[str], bins: int = 16) -> DataFrame:
    """Per group and bin of its sequence (place * bins / size) the mean of each value."""
    at = F.least(F.floor(F.col(place) * bins / F.greatest(F.col(size), F.lit(1))), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(*group, at).agg(*[F.avg(v).alias(v) for v in values])
