"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources get targets (weights, with a repeat limit), targets become whole blocks by highest quotients, a source's
blocks are apportioned to its shards in the same way, and each shard picks its blocks by a seeded permutation.
Everything is DataFrame expressions, and no order is over all rows of a table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linehaul.llm.frames import bounded, word_count
from linehaul.operators.numbering import numbered
from linehaul.scratch import Scratch

#: Multipliers of the block permutation: primes above any shard's number of blocks.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563)
_NEW = ("size", "source_size", "target", "taken", "repeats", "picks")


def _with_totals(df: DataFrame, group: Sequence[str], **sums: Column) -> DataFrame:
    """``df`` with aggregates of each row's group; of all rows, which make one row, without a group."""
    totals = df.groupBy(*group).agg(*[c.alias(n) for n, c in sums.items()])
    return df.join(totals, [*group]) if group else df.crossJoin(F.broadcast(totals))


def sainte_lague(members: DataFrame, group: Sequence[str], key: Sequence[str], weight: str, seats: str, quota: str = "quota", scratch: Scratch | None = None) -> DataFrame:
    """``members`` with ``quota``: ``seats`` of each group dealt one by one to the highest quotient weight / (2 * held + 1).

    The dealing starts at the rounding with a divisor large enough never to give too many seats, so that fewer
    candidates than four times the members remain to be ranked. Ties go to the smaller ``key``. Weights of zero
    or null get none. Group and key are not null.
    """
    scratch = scratch or Scratch(members.sparkSession, "seats")
    n, w, zero = F.col(seats).cast("double"), F.col("_w"), F.lit(0)
    base = members.withColumn("_w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    base = _with_totals(base, group, _m=F.count(F.lit(1)), _t=F.sum("_w"))
    base = base.withColumn("_k", F.when((n > F.col("_m") / 2) & (F.col("_t") > 0), F.floor(w * (n - F.col("_m") / 2) / F.col("_t") + 0.5)).otherwise(zero).cast("long"))
    base = scratch.table(_with_totals(base, group, _dealt=F.sum("_k")).withColumn("_rest", F.col(seats) - F.col("_dealt")), "seats")
    more = F.least(F.col("_rest"), F.ceil(w * F.col("_m") / F.col("_t")) + 2)
    names = list(dict.fromkeys([*group, *key]))
    open_ = base.where("_w > 0 AND _rest > 0").select(*names, "_rest", "_w", "_k", F.explode(F.sequence(zero, (more - 1).cast("int"))).alias("_i"))
    open_ = open_.select(*names, "_rest", "_i", (w / (2 * (F.col("_k") + F.col("_i")) + 1)).alias("_q"))
    ranked = numbered(open_, [*group, F.desc("_q"), *[k for k in key if k not in group], "_i"], "_place", scratch)
    ranked = _with_totals(ranked, group, _first=F.min("_place")).where(F.col("_place") - F.col("_first") < F.col("_rest"))
    won = ranked.groupBy(*names).agg(F.count(F.lit(1)).alias("_won"))
    return base.join(won, names, "left").select(*members.columns, (F.col("_k") + F.coalesce("_won", zero)).cast("long").alias(quota))


def targets(sources: DataFrame, size: str, name: str, weights: Sequence[float], limit: float, scratch: Scratch | None = None) -> DataFrame:
    """``sources`` with ``weight`` and ``target``: shares of the total by weight, none above ``limit`` times its size, the excess reshared by weight.

    Weights repeat along the sources in code point order, null last.
    """
    scratch = scratch or Scratch(sources.sparkSession, "targets")
    by_name = F.col(name).asc_nulls_last()
    out = numbered(sources, [by_name], "_place", scratch)
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_place") % len(weights) + 1).cast("int")))
    out = out.withColumn("_cap", F.col(size) * F.lit(float(limit))).withColumn("_fill", F.col("_cap") / F.col("weight"))
    out = numbered(out, ["_fill", by_name], "_place2", scratch, {"_cap_before": "_cap", "_weight_before": "weight"})
    out = _with_totals(out, [], _all=F.sum(size), _weights=F.sum("weight"))
    out = out.withColumn("_capped", F.col("_fill") < (F.col("_all") - F.col("_cap_before")) / (F.col("_weights") - F.col("_weight_before")))
    zero = F.lit(0.0)
    out = _with_totals(out, [], _held=F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(zero)), _free=F.sum(F.when(F.col("_capped"), zero).otherwise(F.col("weight"))))
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("weight") * (F.col("_all") - F.col("_held")) / F.col("_free"))
    return out.select(*sources.columns, "weight", target.alias("target"))


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    max_repeats: int = 3,
    block_tokens: int = 32,
    shard_tokens: int = 1_000_000,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size_col: str | None = None,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """One row per row of ``docs``, its columns and: size, source_size, target, taken, repeats, picks.

    ``taken`` words of a document go into the mix: the whole text ``repeats`` times and once more the word
    ranges ``picks`` (array of from, to). A block has ``block_tokens`` tokens. Shards of a source have about
    ``shard_tokens`` words, so a hot source is many shards. The per-source and per-shard tables are broadcast up to
    ``broadcast_rows`` rows and shuffled beyond. Texts are read twice for their number of words; not at all if
    ``size_col`` has it, and ``text_col`` may then be a digest of the text.

    Null and empty texts have size 0 and take nothing; a null source is a source of its own, the last. Rows with the
    same id or none are mixed one by one, in an order that their texts decide. Very long texts are cut into blocks as
    all are. An empty table gives an empty result. Columns of ``docs`` named like the new ones are replaced; others
    may have any name.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "mix")
    # the columns of docs are c0, c1, ... in here, so that no name of theirs meets one of these
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*own.values())
    size = word_count(F.col(own[text_col])) if size_col is None else F.coalesce(F.col(own[size_col]), F.lit(0)).cast("long")
    order = F.xxhash64(F.lit(seed), own[id_col], own[text_col])
    keep = [c for c in docs.columns if c not in _NEW]
    rows = rows.select(*[own[c] for c in keep], size.alias("size"), _source_key(F.col(own[source_col])).alias("source"), F.col(own[source_col]).alias("name"), order.alias("order"))
    sizes = scratch.table(rows.select("source", "name", "size", "order"), "sizes") if size_col is None else rows

    per_source = sizes.groupBy("source").agg(F.first("name").alias("name"), F.sum("size").alias("source_size"))
    named = targets(scratch.table(per_source, "per-source"), "source_size", "name", weights, max_repeats, scratch)
    named = _with_totals(named, [], total=F.sum("source_size")).withColumn("blocks", F.when(F.col("total") > 0, F.greatest(F.lit(1), F.round(F.col("total") / block_tokens))).otherwise(0).cast("long"))
    named = sainte_lague(named, [], ["source"], "target", "blocks", "source_blocks", scratch).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)))
    sources = bounded(scratch.table(named.select("source", "source_size", "target", "source_blocks", "shards"), "sources"), broadcast_rows)

    shard = F.pmod(F.xxhash64(F.col("order"), F.lit(seed)), F.col("shards")).alias("shard")
    per_shard = sizes.join(sources, "source").groupBy("source", shard).agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    per_shard = sainte_lague(scratch.table(per_shard, "per-shard"), ["source"], ["shard"], "shard_size", "source_blocks", "shard_blocks", scratch)
    n = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_tokens)).alias("n")
    quotas = per_shard.where("shard_size > 0").select("source", "shard", "shard_size", n, "shard_blocks")
    chosen = F.least(max_repeats * F.col("n"), F.round(F.col("shard_blocks") * block_tokens * F.col("n") / F.col("shard_size")).cast("long"))
    salt = F.xxhash64(F.lit(seed), "source", "shard")
    quotas = quotas.select(
        "source", "shard", "shard_size", "n",
        F.floor(chosen / F.col("n")).alias("full"), F.pmod(chosen, F.col("n")).alias("part"),
        F.element_at(F.array(*[F.lit(p) for p in _PRIMES]), (F.pmod(salt, F.lit(len(_PRIMES))) + 1).cast("int")).cast("long").alias("mul"), F.pmod(F.shiftright(salt, 8), F.col("n")).alias("add"),
    )
    quotas = bounded(scratch.table(quotas, "shards"), broadcast_rows)

    placed = rows.join(sources, "source").withColumn("shard", shard)
    inside = Window.partitionBy("source", "shard").orderBy("order", own[id_col], "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum("size").over(inside)).join(quotas, ["source", "shard"], "left")
    begin = F.col("end") - F.col("size")
    block_of = lambda word: F.floor(((word + 1) * F.col("n") - 1) / F.col("shard_size"))
    edge = lambda k: F.floor(k * F.col("shard_size") / F.col("n"))
    some = F.col("size") > 0
    blocks = F.when(some, F.sequence(block_of(begin), block_of(F.col("end") - 1))).otherwise(F.array().cast("array<bigint>"))
    hit = F.filter(blocks, lambda k: F.pmod(k * F.col("mul") + F.col("add"), F.col("n")) < F.col("part"))
    picks = F.transform(hit, lambda k: F.struct((F.greatest(edge(k), begin) - begin).alias("from"), (F.least(edge(k + 1), F.col("end")) - begin).alias("to")))
    placed = placed.withColumn("picks", picks).withColumn("repeats", F.when(some, F.col("full")).otherwise(0).cast("long"))
    taken = F.col("repeats") * F.col("size") + F.aggregate("picks", F.lit(0).cast("long"), lambda s, p: s + p["to"] - p["from"])
    return placed.select(*[F.col(own[c]).alias(c) for c in keep], "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), "repeats", "picks")
