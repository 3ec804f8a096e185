"""Sharding by Hilbert-curve order: metadata dimensions are quantised to a grid, rows sorted by the index
of their cell along the curve, and the order cut into runs of equal counts, so each shard covers few
ranges of every dimension and files can be pruned by any of them. Cells are quantiles: of the rows in the order of
a dimension's values each cell has about the same number, so common values have cells of their own and none is hashed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, fresh_name, with_rank, written

BITS = 4


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve of the cell with these coordinates (0 to 2**bits - 1 each).

    The coordinates go through the inverse undo of excess rotations, one fold step for each bit
    and axis, then Gray coding, and their bits are interleaved.
    """
    n = len(axes)
    if n == 1:
        return axes[0].cast("long")
    steps = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))

    def turn(x: Column, step: Column) -> Column:
        first, own, low = x[0], x[step.i], step.q - 1
        flip = own.bitwiseAND(step.q) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when(j == 0, first.bitwiseXOR(F.when(flip, low).otherwise(swap))).when((j == step.i) & ~flip, v.bitwiseXOR(swap)).otherwise(v))

    def gray(x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), x, lambda a, i: F.transform(a, lambda v, j: F.when(j == i, v.bitwiseXOR(a[i - 1])).otherwise(v)))

    def straighten(x: Column) -> Column:
        qs = F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1)))
        t = F.aggregate(qs, F.lit(0), lambda t, q: F.when(x[n - 1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return let(t, lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))

    def interleave(x: Column) -> Column:
        planes = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)))
        return F.aggregate(planes, F.lit(0).cast("long"), lambda h, s: h * 2 + (x[s.i].bitwiseAND(s.q) != 0).cast("long"))

    start = F.array(*(a.cast("int") for a in axes))
    turned = F.aggregate(steps, start, turn) if bits > 1 else start
    return let(let(let(turned, gray), straighten), interleave)


def quantised(df: DataFrame, values: dict[str, Column], bits: int) -> DataFrame:
    """df with a column for each of `values`: its cell, 0 to 2**bits - 1. A cell holds a run of values, in their order, null first; a value's cell is
    where its rows begin among all rows. Values are counted first, so what is ranked is one row for each."""
    for name, value in values.items():
        df = df.withColumn(f"{name}_value", value)
        counts = df.groupBy(f"{name}_value").agg(F.count(F.lit(1)).alias("rows_of"))
        counts = counts.withColumn("some", F.col(f"{name}_value").isNotNull())
        ranked, _ = with_rank(counts, [F.col("some"), F.col(f"{name}_value")], "place", {"rows_of": "rows_ahead"})
        total = counts.agg(F.sum("rows_of")).first()[0] or 1
        cell = F.least(F.floor(F.col("rows_ahead") * (1 << bits) / total), F.lit((1 << bits) - 1)).cast("int").alias(name)
        ranked = ranked.select(F.col(f"{name}_value").alias("of_value"), cell)
        df = df.join(ranked, F.col(f"{name}_value").eqNullSafe(F.col("of_value"))).drop(f"{name}_value", "of_value")
    return df


def magnitude(value: Column) -> Column:
    """value, at least 1, to a sixteenth of its power of two: so many values for each doubling, however large."""
    power = F.floor(F.log2(F.greatest(value, F.lit(1))))
    return (power * 16 + F.floor(value * 16 / F.pow(F.lit(2.0), power)) - 16).cast("int")


def with_shards(df: DataFrame, axes: list[Column], ties: list[Column], shards: int, bits: int = BITS) -> DataFrame:
    """df (small rows) with hilbert, shard and slot (from 0 in each shard, no gaps). Counts of any two shards are at
    most one apart, whatever the skew: a cell that holds a third of all rows is cut by `ties`, which
    should end in a key. Rows equal in all of it may change places. Empty tables give empty results; with fewer rows
    than shards some shards are empty."""
    order = [F.col("hilbert"), *ties]
    ranked, total = with_rank(df.withColumn("hilbert", hilbert_index(axes, bits)), order, "rank_all")
    shard = F.expr(f"CAST((rank_all * {shards}L) DIV {max(1, total)}L AS INT)")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) DIV {shards}L")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank_all") - first).drop("rank_all")


def grouped_axes(slim: DataFrame) -> DataFrame:
    """slim with axis_lang and axis_source: its lang and source, but those of the least row for texts that occur with several, so that equal
    texts meet in one cell."""
    both = F.struct("lang", "source")
    several = slim.groupBy("text_hash", "text_crc32", "size").agg(F.min(both).alias("least"), F.max(both).alias("most")).where("least != most")
    several = several.select(F.col("text_hash").alias("g_hash"), F.col("text_crc32").alias("g_crc"), F.col("size").alias("g_size"), "least")
    out = slim.join(several, (F.col("text_hash") == F.col("g_hash")) & (F.col("text_crc32") == F.col("g_crc")) & (F.col("size") == F.col("g_size")), "left")
    own = lambda c: F.when(F.col("least").isNull(), F.col(c)).otherwise(F.col(f"least.{c}")).alias(f"axis_{c}")
    return out.select(*slim.columns, own("lang"), own("source"))


def op6(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert of every document.

    Null and empty texts have no bytes; null sources, languages and ids come first in their order. Equal texts lie side by side, whatever their
    languages and sources (they are sorted by the least of them), so one shard holds them unless a cut falls among them. Repeated rows are
    rows of their own with slots of their own. An empty table gives an empty result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = written(docs.select("doc_id", "source", "lang", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash")), "sizes")
    own = grouped_axes(slim)
    cells = written(quantised(own, {"x_lang": F.col("axis_lang"), "x_size": magnitude(F.col("size")), "x_source": F.col("axis_source")}, BITS), "cells")
    ties = [F.col(c) for c in ("size", "text_hash", "text_crc32", "source", "lang", "doc_id")]
    out = with_shards(cells, [F.col(c) for c in ("x_lang", "x_size", "x_source")], ties, shards)
    discard(slim), discard(cells)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(df: DataFrame, path: str, key: str, shard_of: DataFrame) -> None:
    """df as one folder of files for each shard, sorted by the curve. shard_of has the key (of each row one), hilbert and shard. Null keys take no part. Readers
    prune folders by shard and row groups by the least and the most of every dimension."""
    place, curve = fresh_name(df, "shard"), fresh_name(df, "hilbert")
    own = df.join(shard_of.select(key, F.col("hilbert").alias(curve), F.col("shard").alias(place)), key)
    own.repartitionByRange(place, curve, key).sortWithinPartitions(place, curve, key).write.partitionBy(place).parquet(path)
