"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded shuffle; a row's fractional rank is
its middle place in its source, between 0 and 1. In order of fractional rank
every stretch holds the sources in the proportions of the whole, so cutting
that order into equal stretches gives shards that all match the mixture.
Shard row counts differ by one at most.

How many rows of another source come before a row follows from its fractional
rank and the size of that source. So rows move once, to be ranked in hash
blocks of their source, and find their place in the whole order by themselves.
Beyond ``WIDE`` sources the order is sorted instead, in stretches of
fractional rank that hold as many rows as a block.

Rules for odd input: a null source is a source of its own; a null text has
size 1; repeated rows take places of their own; equal places in the shuffle go
by id and contents, equal fractional ranks by source; an empty table gives no
rows; very long texts move as they are; other columns pass through, but for ones named ``shard`` or ``slot``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spantab.llm.ordering import (
    TEXT_ROWS,
    block_count,
    block_offsets,
    group_key,
    hash_block,
    packed,
    quoted,
    running_in_block,
    shuffle_key,
    unpacked,
)

SHARDS = 8
SEED = 29
#: Most sources whose sizes are compared with row by row.
WIDE = 256
#: Up to so many rows products of ranks and sizes fit a long.
LONG_ROWS = 1 << 30


def _place(sizes: list[tuple[str, int]], exact: str) -> Column:
    """The place, from 0, of row ``_rank`` of ``_total`` in source ``_group`` in the order of fractional rank.

    Row q of n' comes before row r of n if ``(2q - 1) n < (2r - 1) n'``, or, in
    an earlier source or the same one, if both are equal.
    """
    rank, total = F.col("_rank").cast(exact), F.col("_total").cast(exact)
    own = F.struct((rank * 2 - 1).cast(exact).alias("odd"), total.alias("n"), F.col("_group").alias("g"))
    others = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(n).cast(exact).alias("n")) for g, n in sizes])
    others = others.cast(f"array<struct<g: string, n: {exact}>>")
    keyed = F.struct(own.alias("row"), others.alias("sources"))
    sums = F.transform(F.array(keyed), lambda k: F.aggregate(
        k["sources"], F.lit(-1).cast("long"),
        lambda done, s: done + F.call_function(
            "div", k["row"]["odd"] * s["n"] + k["row"]["n"] - F.when(s["g"] > k["row"]["g"], 1).otherwise(0),
            k["row"]["n"] + k["row"]["n"],
        ),
    ))
    return sums[0]


def _stretch_offsets(sources: DataFrame, blocks: int) -> DataFrame:
    """Per stretch of fractional rank the rows before it, from the source sizes alone.

    Row r of n lies in stretch ``(2r - 1) * blocks / 2 div n``; so
    ``ceil(2 j n / blocks) div 2`` rows of a source come before stretch j.
    """
    half = blocks // 2
    before = f"int((j * _total + {half - 1}) div {half}) div 2"
    counted = sources.select("_total", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    return counted.groupBy(F.col("j").alias("_stretch")).agg(
        F.sum(F.expr(before.replace("int(", "bigint("))).alias("_earlier"), F.sum("_total").alias("_rows")
    )


def shard_rows(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """``docs`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard)."""
    keyed = docs.select(
        packed(docs), group_key(quoted(source_col)).alias("_group"), shuffle_key(quoted(id_col), seed).alias("_key"),
        F.lit(1).alias("_one"),
    )
    sources = keyed.groupBy("_group").agg(F.count("*").alias("_total"))
    sizes = [(r["_group"], r["_total"]) for r in sources.limit(WIDE + 1).collect()]
    rows = sum(n for _, n in sizes) if len(sizes) <= WIDE else docs.count()
    blocks = block_count(rows, TEXT_ROWS)
    keyed = keyed.withColumn("_block", hash_block(F.col("_key"), blocks))
    offsets = block_offsets(keyed, "_group", "_block", "_one")
    inside = running_in_block(("_group", "_block"), ("_key", F.col("row")[id_col], F.xxhash64("row")), "_one")
    ranked = keyed.join(offsets, ["_group", "_block"]).withColumn("_rank", F.col("_before") + inside)
    if len(sizes) <= WIDE:
        exact = "bigint" if rows <= LONG_ROWS else "decimal(19,0)"
        numbered = ranked.withColumn("_place", _place(sorted(sizes), exact)).withColumn("_rows", F.lit(rows).cast("long"))
    else:
        numbered = _sorted_places(ranked, sources, blocks)
    shard = F.expr(f"int((_place * {shards}) div _rows)")
    first = F.expr(f"(shard * _rows + {shards - 1}) div {shards}")
    return numbered.withColumn("shard", shard).withColumn("slot", F.col("_place") - first).select(
        *unpacked(numbered, "shard", "slot"), "shard", "slot"
    )


def _sorted_places(ranked: DataFrame, sources: DataFrame, blocks: int) -> DataFrame:
    """``ranked`` with ``_place`` and ``_rows``, by sorting stretches of fractional rank."""
    placed = ranked.withColumns(
        {
            "_fraction": (F.col("_rank") - 0.5) / F.col("_total"),
            "_stretch": F.expr(f"int(((2 * _rank - 1) * {blocks // 2}) div _total)"),
        }
    )
    order = Window.partitionBy("_stretch").orderBy("_fraction", "_group", "_rank")
    joined = placed.drop("_total", "_before").join(_stretch_offsets(sources, blocks), "_stretch")
    return joined.withColumn("_place", F.col("_earlier") + F.row_number().over(order) - 1)
