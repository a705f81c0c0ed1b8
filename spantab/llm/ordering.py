"""Seeded shuffles and running totals that never gather one group in one task.

A running total over a group in shuffled order is taken in two steps: sums of
hash blocks (a map-side combined aggregate), then a window inside one block.
The number of blocks follows the number of rows, so a block has a bounded share
of them, however many rows its source has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fewest hash blocks of one group, and most rows of a block that are meant: narrow ones, and ones with texts.
BLOCKS = 64
NARROW_ROWS = 1 << 18
TEXT_ROWS = 1 << 13
KEY_BITS = 60


def block_count(rows: int, per_block: int) -> int:
    """The power of two of blocks that hold about ``per_block`` of so many rows each."""
    return max(BLOCKS, 1 << max(0, math.ceil(rows / per_block) - 1).bit_length())


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``row``, so that working columns cannot clash with them."""
    return F.struct(*[quoted(c) for c in df.columns]).alias("row")


def unpacked(df: DataFrame, *added: str) -> list[Column]:
    """The packed columns in their order, without those that the operator adds under the same name."""
    return [F.col("row")[c].alias(c) for c in df.schema["row"].dataType.names if c not in added]


def shuffle_key(id_col: Column, seed: int) -> Column:
    """60 bits of md5 over seed and id: the place of a row in the seeded shuffle. Null ids count as empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def hash_block(key: Column, blocks: int) -> Column:
    """Block 0..blocks-1 (a power of two) of a shuffle key; blocks are in key order."""
    return F.shiftright(key, KEY_BITS - blocks.bit_length() + 1).cast("int")


def group_key(col: Column) -> Column:
    """A never-null spelling of a grouping column: null stays apart from every text and sorts last."""
    text = col.cast("string")
    return F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), text))


def block_offsets(df: DataFrame, group: str, block: str, value: str) -> DataFrame:
    """Per (group, block): ``_before``, the sum of value in earlier blocks of the group, and ``_total`` of the group."""
    sums = df.groupBy(group, block).agg(F.sum(value).alias("_sum"))
    ordered = Window.partitionBy(group).orderBy(block)
    earlier = F.sum("_sum").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(
        group,
        block,
        F.coalesce(earlier, F.lit(0)).cast("long").alias("_before"),
        F.sum("_sum").over(Window.partitionBy(group)).cast("long").alias("_total"),
    )


def running_in_block(keys: Sequence[str], order: Sequence[str | Column], value: str) -> Column:
    """Sum of value over the rows of one block up to and including this one."""
    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(rows)
