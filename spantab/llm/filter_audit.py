"""Which filter of a cascade removes what, for every order of the filters.

Every document gets a mask of the filters it fails. Masks are counted per part,
32 cells for five filters, and a Gray-code walk visits all subsets of filters:
it toggles one filter at a time, keeps for every cell how many active filters
its documents fail, and moves a cell out of or back into the running survivors
when that counter leaves or reaches zero. The 32 stored states answer every
step of every order as a difference of two of them.

The copy filter E needs the smallest id of equal texts. Texts meet as SHA-256
digests: rows are counted per digest, part and id, then per digest and part, so
a text that a third of all rows share reaches a task as a few rows.

Rules for odd input: a null text is empty and equals an empty one; a null part
is the empty text; rows of one id and text count each and are no copies of each
other; a null id is neither smaller nor larger than any, so it fails E never,
and has no labels; several label rows of an id count once, as 1 if one of them
is; labels of unknown ids are left out; an empty table has no parts and no rows;
long texts are read whole, row by row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spantab.llm.ordering import quoted

FILTERS = "ABCDE"
COPIES = "E"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SYMBOLS = r"[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
CAPITAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MEASURES = ("docs", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Per filter that looks at one text: whether the text fails it."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    length = F.char_length(text)
    capitals = length - F.char_length(F.translate(text, CAPITAL, ""))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * distinct < MIN_DISTINCT_PERCENT * n,
        "C": 100 * capitals > MAX_CAPITAL_PERCENT * length,
        "D": text.rlike(SYMBOLS),
    }


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def _labelled(rows: DataFrame, labels: DataFrame, label_id: str) -> DataFrame:
    """``rows`` with flags ``good`` and ``toxic``; rows without an id are spread by their digest."""
    flags = labels.filter(quoted(label_id).isNotNull()).groupBy(quoted(label_id).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    ).withColumn("spread", F.lit(0).cast("long"))
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    joined = rows.withColumn("spread", spread).join(flags, ["id", "spread"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")}).drop("spread")


def mask_cells(
    docs: DataFrame, labels: DataFrame, part_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
    label_id: str = "doc_id",
) -> DataFrame:
    """(part, mask, docs, good, toxic): documents per set of failed filters, as a bit mask in filter order."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    mask = sum((F.when(fails, F.lit(_bit(name))).otherwise(F.lit(0)) for name, fails in text_failures(text).items()),
               F.lit(0))
    rows = docs.select(
        quoted(id_col).alias("id"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"),
    )
    kept = ["digest", "part", "mask", "good", "toxic"]
    per_id = _labelled(rows, labels, label_id).groupBy(*kept, "id").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("id").isNotNull()
    groups = per_id.groupBy(*kept).agg(
        F.sum("n").alias("n"), F.sum(F.when(known, F.col("n"))).alias("with_id"),
        F.min(F.when(known, F.struct("id", "n"))).alias("least"),
    )
    first = F.expr("min(least.id) OVER (PARTITION BY digest)")
    at_first = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    copies = F.coalesce(F.col("with_id") - at_first, F.lit(0))
    split = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct((F.col("mask") + _bit(COPIES)).alias("mask"), F.col("copies").alias("n")),
    ))
    cells = groups.withColumn("first", first).withColumn("copies", copies).select("part", "good", "toxic",
                                                                                 split.alias("cell"))
    n = F.col("cell.n")
    return cells.groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum(n).alias("docs"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def gray_states(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters, for ``cells`` of shape (parts, 2**k, measures), in the same shape."""
    n_masks = cells.shape[1]
    masks = np.arange(n_masks)
    failures = np.zeros(n_masks, np.int64)
    states = np.empty_like(cells)
    states[:, 0] = survivors = cells.sum(axis=1)
    subset = 0
    for step in range(1, n_masks):
        toggled = step & -step
        subset ^= toggled
        hit = masks[masks & toggled > 0]
        if subset & toggled:
            failures[hit] += 1
            survivors = survivors - cells[:, hit[failures[hit] == 1]].sum(axis=1)
        else:
            failures[hit] -= 1
            survivors = survivors + cells[:, hit[failures[hit] == 0]].sum(axis=1)
        states[:, subset] = survivors
    return states


def _steps() -> list[tuple[str, int, str, int, int]]:
    """(order, step, filter, subset before, subset after) of all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            out.append(("".join(order), step, name, before, before + _bit(name)))
            before += _bit(name)
    return out


REPORT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)
#: Parts walked at once: 600 report rows each.
PARTS_AT_ONCE = 64


def _report(parts: list[str], cells: np.ndarray) -> pa.RecordBatch:
    """The steps of all orders for some parts, as differences of stored states."""
    orders, places, names, before, after = zip(*_steps())
    before, after = np.array(before), np.array(after)
    own, full = after - before, cells.shape[1] - 1
    states = gray_states(cells)
    docs, lost = states[:, :, 0], states[:, before] - states[:, after]
    removed = lost[:, :, 0]
    shapley = np.zeros_like(removed)
    for name in FILTERS:
        steps = own == _bit(name)
        shapley[:, steps] = removed[:, steps].sum(axis=1, keepdims=True)
    measures = [
        docs[:, after], removed, docs[:, :1] - docs[:, own] - removed, docs[:, full - own] - docs[:, full:],
        lost[:, :, 1], lost[:, :, 2], shapley,
    ]
    columns = [
        pa.array([p for p in parts for _ in orders]), pa.array(orders * len(parts)),
        pa.array(places * len(parts), pa.int32()), *(pa.array(m.ravel()) for m in measures),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in REPORT.split(", ")])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PARTS_AT_ONCE):
            some = batch.slice(at, PARTS_AT_ONCE)
            cells = np.zeros((some.num_rows, 1 << len(FILTERS), len(MEASURES)), np.int64)
            for row, listed in zip(cells, some.column("cells").to_pylist()):
                for cell in listed:
                    row[cell["mask"]] = [cell[m] for m in MEASURES]
            yield _report(some.column("part").to_pylist(), cells)


def audit_filters(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the filters and step, with what that step keeps, removes and costs."""
    cells = mask_cells(docs, labels, **columns)
    listed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    return listed.mapInArrow(_walk, REPORT)
