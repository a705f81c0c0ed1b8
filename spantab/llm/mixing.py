"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a seeded shuffle, repeated up to
``epochs`` times. A copy's virtual finish time is the words its source has
served up to its end, over the source's target; all copies of all sources are
ordered by that time, and the mix ends where the total budget is used up.

Rules for odd input: a null text has no words; a document without words is
taken nowhere; a null source is a source of its own, last in order; repeated
rows queue one after the other; equal places in the shuffle go by id, size and
contents; an empty table gives an empty mix; very long texts are counted whole,
and a document longer than the rest of the budget stays whole or stays out;
other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spantab.llm.ordering import (
    NARROW_ROWS,
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
from spantab.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
EPOCHS = 2
SEED = 17


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = BUDGET_SHARE, epochs: int = EPOCHS
) -> DataFrame:
    """Per ``_group`` its ``_weight``, ``_source_size`` and ``_target``.

    Targets share ``share`` of all words by weight and stop at ``epochs`` times
    the source; what a full source leaves goes to the others. With sources in
    order of capacity per weight, the common level per weight is that of the
    first source which it does not fill.
    """
    sources = sizes.groupBy("_group").agg(F.sum("_size").cast("long").alias("_source_size"))
    rank = F.row_number().over(Window.orderBy("_group"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighed = sources.withColumn("_weight", F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("_cap", F.col("_source_size") * epochs)
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), "_group")
    before = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("_source_size").over(everything) * share
    levels = weighed.withColumn("_level", (budget - before) / rest)
    open_level = F.when(F.col("_level") <= F.col("_cap") / F.col("_weight"), F.col("_level"))
    # sources after the first open one have lower levels per their own count, so the first is the largest
    common = F.first(open_level, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.coalesce(F.least(F.col("_cap").cast("double"), common * F.col("_weight")), F.col("_cap").cast("double"))
    return levels.select("_group", "_weight", "_source_size", target.alias("_target"))


def queue_documents(
    docs: DataFrame, id_col: str, source_col: str, size: Column, seed: int = SEED,
    weights: Sequence[int] = WEIGHTS, share: float = BUDGET_SHARE, epochs: int = EPOCHS, contents: str | None = None,
    blocks: int = 1024,
) -> DataFrame:
    """Each document as ``row`` with ``_size, _group, _source_size, _target`` and ``_end``: words queued up to its end.

    The places do not depend on ``blocks``, which are in the order of the shuffle.
    """
    keyed = docs.select(
        packed(docs), size.alias("_size"), group_key(quoted(source_col)).alias("_group"),
        shuffle_key(quoted(id_col), seed).alias("_key"),
    ).withColumn("_block", hash_block(F.col("_key"), blocks))
    narrow = keyed.select("_group", "_block", "_size")
    offsets = block_offsets(narrow, "_group", "_block", "_size").join(
        source_targets(narrow, weights, share, epochs), "_group"
    )
    # equal keys go by id, size and contents; rows equal in all are interchangeable
    ties = ("_key", F.col("row")[id_col], "_size", F.col("row")[contents] if contents else F.xxhash64("row"))
    inside = running_in_block(("_group", "_block"), ties, "_size")
    return keyed.join(offsets, ["_group", "_block"]).withColumn("_end", F.col("_before") + inside)


def _pieces(epochs: int) -> Column:
    """The copies of one document: words taken, and the virtual finish time of what is taken."""

    def piece(epoch: int) -> Column:
        end = F.col("_end") + F.col("_source_size") * epoch
        left = F.floor(F.col("_target")) - (end - F.col("_size"))
        taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), left))
        served = F.least(end.cast("double"), F.floor(F.col("_target")).cast("double"))
        finish = F.coalesce(F.try_divide(served, F.col("_target")), F.lit(0.0))  # a source without words has no target
        return F.struct(F.lit(epoch).alias("epoch"), taken.alias("taken"), finish.alias("finish"))

    return F.array(*[piece(k) for k in range(epochs)])


def mix_words(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
    seed: int = SEED, weights: Sequence[int] = WEIGHTS, share: float = BUDGET_SHARE, epochs: int = EPOCHS,
) -> DataFrame:
    """One row per document: words taken over all its copies, and where its first copy begins in the mix.

    The document in service when its source's target is reached is cut there,
    so every source takes its target to the word. Only narrow columns move.
    """
    size = word_count("text") if size is None else size
    narrow = stage(
        docs.select(quoted(id_col).alias("id"), quoted(source_col).alias("source"), size.alias("words")), "mix-sizes"
    )
    blocks = block_count(narrow.count(), NARROW_ROWS)
    queued = queue_documents(narrow, "id", "source", F.col("words"), seed, weights, share, epochs, blocks=blocks)
    numbered = queued.withColumn(
        "_slot",
        F.row_number().over(Window.partitionBy("_group", "_block").orderBy("_end", "_key", "row.id")),
    )
    pieces = numbered.select(
        F.col("row.id").alias("id"), "_group", "_block", "_slot", "_size", "_source_size", "_target",
        F.explode(_pieces(epochs)).alias("p"),
    ).select("*", "p.*").drop("p")
    pieces = stage(pieces.withColumn("_time", _time_block(F.col("finish"), blocks)), "mix-queue")
    starts = _mix_starts(pieces.filter("taken > 0"))
    untaken = pieces.filter("not taken > 0").withColumn("mix_start", F.lit(None).cast("long"))
    return (
        starts.unionByName(untaken)
        .groupBy("_group", "_block", "_slot", "id", "_size", "_source_size", "_target")
        .agg(F.sum("taken").alias("taken"), F.min("mix_start").alias("mix_start"))
        .select(
            F.col("id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
            F.col("_target").alias("target"), "taken", "mix_start",
        )
    )


def _time_block(finish: Column, blocks: int) -> Column:
    """Sources serve evenly over virtual time, so equal slices of it hold about equal words."""
    return F.least(F.lit(blocks - 1), F.greatest(F.lit(0), F.floor(finish * blocks))).cast("int")


def _mix_starts(pieces: DataFrame) -> DataFrame:
    """Running total of words over all pieces in order of finish time.

    Targets add up to the budget, so what is taken before them is the mix truncated at the budget.
    """
    sums = pieces.groupBy("_time").agg(F.sum("taken").alias("_sum"))
    # one row per slice of virtual time
    slices = Window.orderBy("_time").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_time", F.coalesce(F.sum("_sum").over(slices), F.lit(0)).cast("long").alias("_earlier"))
    inside = running_in_block(("_time",), ("finish", "_group", "epoch", "_block", "_slot"), "taken")
    ends = pieces.join(offsets, "_time").withColumn("_stop", F.col("_earlier") + inside)
    return ends.withColumn("mix_start", F.col("_stop") - F.col("taken")).drop("_earlier", "_stop")


def _copies(epochs: int) -> Column:
    """The whole copies of one document with words: where they end in their source's queue, and when.

    Whole documents are in or out, so the time that counts is when half of the
    document is served: rounding then goes both ways, and the time at which the
    budget ends is that at which the sources reach their targets.
    """
    ends = [F.col("_end") + F.col("_source_size") * k for k in range(epochs)]
    half = [(e - F.col("_size") / 2) / F.col("_target") for e in ends]
    listed = F.array(*[F.struct(e.alias("end"), h.alias("finish")) for e, h in zip(ends, half)])
    return F.when(F.col("_size") > 0, listed)


def _first_left_out(narrow: DataFrame, options: dict) -> tuple[float, str, int] | None:
    """Finish time, source and end of the first copy beyond the budget; None if all copies are in.

    The copies are sorted by range; totals of earlier ranges carry into the one
    where the budget ends, and only that one is summed row by row.
    """
    blocks = block_count(narrow.count(), NARROW_ROWS)
    queued = queue_documents(narrow, "id", "source", F.col("row_words"), contents="contents", blocks=blocks, **options)
    copies = queued.select("_group", "_size", F.explode(_copies(options["epochs"])).alias("c")).select("_group", "_size", "c.*")
    sorted_copies = copies.repartitionByRange("finish", "_group", "end").withColumn("_range", F.spark_partition_id())
    sorted_copies = stage(sorted_copies, "mix-order")
    first = F.min(F.struct("finish", "_group", "end"))
    ranges = sorted_copies.groupBy("_range").agg(F.sum("_size").alias("words"), first.alias("first")).collect()
    sizes = narrow.select(F.col("row_words").alias("_size"), group_key(F.col("source")).alias("_group"))
    targets = source_targets(sizes, options["weights"], options["share"], options["epochs"])
    budget = targets.agg(F.sum("_target")).first()[0] or 0.0
    before = 0
    for row in sorted(ranges, key=lambda r: r["first"]):
        if before + row["words"] >= budget:
            order = Window.partitionBy("_range").orderBy("finish", "_group", "end")
            served = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.lit(before)
            inside = sorted_copies.filter(F.col("_range") == row["_range"]).withColumn("served", served)
            # a copy is in if at least half of its words come before the end of the budget
            beyond = inside.filter((F.lit(budget) - (F.col("served") - F.col("_size"))) * 2 < F.col("_size"))
            found = beyond.agg(first.alias("cut")).first()["cut"]
            if found is not None:
                return found["finish"], found["_group"], found["end"]
        before += row["words"]
    return None


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
    seed: int = SEED, weights: Sequence[int] = WEIGHTS, share: float = BUDGET_SHARE, epochs: int = EPOCHS,
) -> DataFrame:
    """The mix as whole documents, a row per copy, with the columns of ``docs``.

    All copies are ordered by virtual finish time and cut where the total
    budget ends, to the nearest whole document. The place of the cut is found
    on narrow columns; the documents then move once, to find their own places
    in their sources' queues, and are kept by comparison with it.
    """
    size = word_count("text") if size is None else size
    options = {"seed": seed, "weights": weights, "share": share, "epochs": epochs}
    narrow = stage(
        docs.select(
            quoted(id_col).alias("id"), quoted(source_col).alias("source"), size.alias("row_words"),
            F.xxhash64(packed(docs)).alias("contents"),
        ),
        "mix-sizes",
    )
    cut = _first_left_out(narrow, options)
    blocks = block_count(narrow.count(), TEXT_ROWS)
    queued = queue_documents(docs, id_col, source_col, size, blocks=blocks, **options)
    placed = queued.withColumn("_copy", F.explode(_copies(epochs)))
    if cut is not None:
        finish, group, end = F.col("_copy.finish"), F.col("_group"), F.col("_copy.end")
        later = (group < cut[1]) | ((group == cut[1]) & (end < cut[2]))
        placed = placed.filter((finish < cut[0]) | ((finish == cut[0]) & later))
    return placed.select(*unpacked(queued))
