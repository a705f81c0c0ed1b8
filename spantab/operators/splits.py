"""Deduplication and repeatable exact-size splits.

A split is a *cut* through the order of ``(hash, key)``. Fitting a cut costs a
few narrow aggregations; applying it is a row-local comparison with two
constants, so no membership table is ever joined back to the data and a
hot key can not skew anything.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spantab.functions.scalars import split_hash
from spantab.operators.cleaning import bounds_columns, concat_rows
from spantab.staging import stage

RANK_LIMIT = 100_000
_DIGIT_STEPS = (3, 6, 8)


def dedup_first(df: DataFrame, subset: Sequence[str], order_key: str | Sequence[str]) -> DataFrame:
    """First row, by ``order_key``, of every distinct ``subset``; null equals null.

    The minimum of a row struct is combined map-side, so a group holding most
    of the table sends one row per task. Ties in the key are settled by the
    remaining columns, which keeps the result independent of partitioning.
    """
    keys = [order_key] if isinstance(order_key, str) else list(order_key)
    front = [k for k in keys if k not in subset]
    rest = [c for c in df.columns if c not in subset and c not in front]
    if not front and not rest:
        return df.dropDuplicates(list(subset))
    first = df.groupBy(*subset).agg(F.min(F.struct(*front, *rest)).alias("_first"))
    return first.select(*(F.col(c) if c in subset else F.col(f"_first.`{c}`") for c in df.columns))


def dedup_first_number(df: DataFrame, subset: Sequence[str], order_key: str) -> DataFrame:
    """:func:`dedup_first` for an integer ``order_key``, by hash aggregation over fixed-width values.

    Keys of any types meet as a 128-bit hash, and a group's buffer holds numbers
    only, so Spark keeps groups in a hash map instead of sorting rows by text.
    A further hash tells whether different keys fell together. Such groups, and
    groups whose least order value several rows share, go through
    :func:`dedup_first` in a second pass. A missing order value comes first, as there.
    """
    marks = [m for c in subset for m in (F.col(c), F.col(c).isNull())]
    order = F.coalesce(F.col(order_key).cast("bigint"), F.lit(-(1 << 63)))
    hashes = {f"_h{k}": F.xxhash64(F.lit(k), *marks) for k in range(3)}
    keyed = df.withColumns({**hashes, "_order": order})
    group = ["_h0", "_h1"]
    firsts = stage(keyed.groupBy(*group).agg(
        F.min("_order").alias("_order"), (F.min("_h2") != F.max("_h2")).alias("_clash")
    ), "dedup-firsts")
    kept = stage(keyed.join(firsts.filter(~F.col("_clash")).drop("_clash"), [*group, "_order"]), "dedup-kept")
    parts = [kept]
    tied = kept.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    clashed = firsts.filter("_clash").select(*group)
    if not tied.isEmpty():
        parts = [kept.join(tied, group, "left_anti"), dedup_first(kept.join(tied, group, "left_semi").select(*df.columns), subset, order_key)]
    if not clashed.isEmpty():
        parts.append(dedup_first(keyed.join(clashed, group, "left_semi").select(*df.columns), subset, order_key))
    return concat_rows([p.select(*df.columns) for p in parts])


@dataclass(frozen=True)
class Cut:
    """Rows with ``(split_hash(key, seed), key) <= (threshold, last_key)`` are inside."""

    fold: int
    seed: int
    size: int
    total: int
    threshold: str | None
    last_key: Any

    def inside(self, key: Column | str) -> Column:
        if self.threshold is None:
            return F.lit(False)
        column = F.col(key) if isinstance(key, str) else key
        h = split_hash(column, self.seed)
        return (h < self.threshold) | ((h == self.threshold) & (column <= F.lit(self.last_key)))


def _distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """The distinct non-null keys, computed once and read by every later pass."""
    return stage(df.select(key).where(F.col(key).isNotNull()).distinct(), "keys")


def fit_cuts(
    df: DataFrame, key: str, seeds: Sequence[int], frac: float, assume_unique: bool = False
) -> list[Cut]:
    """One cut of exactly ``ceil(n * frac)`` keys for each seed.

    Radix selection for all seeds together: count keys by leading hash digits
    (4,096 buckets per seed), step into the bucket that holds the cut, and
    repeat until that bucket has at most ``RANK_LIMIT`` keys, or the digits
    are used up; only those keys are ranked. Two narrow jobs up to some 10^8
    keys, one more for every factor of 4,096. ``assume_unique`` skips the
    shuffle that makes keys distinct.
    """
    keys = df.select(key).where(F.col(key).isNotNull()) if assume_unique else _distinct_keys(df, key)
    hashed = F.array(
        *(F.struct(F.lit(i).alias("fold"), split_hash(key, s).alias("h")) for i, s in enumerate(seeds))
    )
    exploded = keys.select(F.col(key).alias("k"), F.explode(hashed).alias("e")).select("k", "e.fold", "e.h")
    by_fold = Window.partitionBy("fold")
    running = by_fold.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def inside(prefixes: dict[int, str]) -> Column:
        chosen = F.lit(False)
        for fold, prefix in prefixes.items():
            chosen = chosen | ((F.col("fold") == fold) & F.col("h").startswith(prefix))
        return chosen

    def by_fold_literal(values: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("fold"))

    totals: dict[int, int] = {}
    sizes: dict[int, int] = {}
    need: dict[int, int] = {}
    prefixes: dict[int, str] = {}
    for digits in _DIGIT_STEPS:
        rows = exploded.filter(inside(prefixes)) if prefixes else exploded
        wanted = (
            by_fold_literal(need) if prefixes else F.ceil(F.sum("c").over(by_fold).cast("double") * F.lit(float(frac)))
        )
        edges = (
            rows.groupBy("fold", F.substring("h", 1, digits).alias("b")).agg(F.count(F.lit(1)).alias("c"))
            .select(
                "fold", "b", "c", F.sum("c").over(running).alias("upto"),
                F.sum("c").over(by_fold).alias("total"), wanted.alias("size"),
            )
            .filter((F.col("upto") >= F.col("size")) & (F.col("upto") - F.col("c") < F.col("size")))
            .collect()
        )  # one row per seed
        if not prefixes:
            totals = {r["fold"]: r["total"] for r in edges}
            sizes = {r["fold"]: r["size"] for r in edges}
        prefixes = {r["fold"]: r["b"] for r in edges}
        need = {r["fold"]: r["size"] - r["upto"] + r["c"] for r in edges}
        if not edges or max(r["c"] for r in edges) <= RANK_LIMIT:
            break
    last: dict[int, Any] = {}
    if prefixes:
        ranked = exploded.filter(inside(prefixes)).withColumn("r", F.row_number().over(by_fold.orderBy("h", "k")))
        last = {r["fold"]: r for r in ranked.filter(F.col("r") == by_fold_literal(need)).collect()}
    return [
        Cut(i, s, sizes[i], totals[i], last[i]["h"], last[i]["k"]) if i in last else Cut(i, s, 0, 0, None, None)
        for i, s in enumerate(seeds)
    ]


def holdout(
    df: DataFrame, key: str, frac: float = 0.1, seed: int = 42, name: str = "is_test",
    assume_unique: bool = False,
) -> DataFrame:
    """Add a flag that is true on exactly ``ceil(n * frac)`` keys."""
    (cut,) = fit_cuts(df, key, [seed], frac, assume_unique)
    return df.withColumn(name, cut.inside(key))


@dataclass(frozen=True)
class SplitPlan:
    """Fitted test cut and one validation cut per fold."""

    key: str
    test: Cut
    folds: tuple[Cut, ...]

    def role(self, fold: int, key: Column | str | None = None) -> Column:
        """Role of a row in one fold; row-local. A row without a key belongs to no set: its role is null."""
        k = self.key if key is None else key
        known = (F.col(k) if isinstance(k, str) else k).isNotNull()
        return (
            F.when(known & self.test.inside(k), "test").when(known & self.folds[fold].inside(k), "valid")
            .when(known, "train")
        )

    def with_role(self, df: DataFrame, fold: int) -> DataFrame:
        return df.withColumn("role", self.role(fold))

    def placements(self, shared_fold: int | None = None) -> Column:
        """Array of (fold, role) of a row: its role in every fold.

        With ``shared_fold`` a test row is placed once, under that number.
        """
        folds = range(len(self.folds))
        tests = folds if shared_fold is None else [shared_fold]
        valid = [F.when(self.folds[i].inside(self.key), "valid").otherwise("train") for i in folds]
        return F.when(
            self.test.inside(self.key), F.array(*(_placement(i, F.lit("test")) for i in tests))
        ).otherwise(F.array(*(_placement(i, valid[i]) for i in folds)))

    def membership(self, df: DataFrame) -> DataFrame:
        """(key, fold, role) for every fold; test rows appear under each fold."""
        placed = df.select(self.key, F.explode(self.placements()).alias("m"))
        return placed.select(self.key, "m.fold", "m.role")


def _placement(fold: int, role: Column) -> Column:
    return F.struct(F.lit(fold).alias("fold"), role.alias("role"))


def fit_splits(
    df: DataFrame, key: str, n: int = 5, frac: float = 1 / 9, seed: int = 42, test_frac: float = 0.1,
    assume_unique: bool = False,
) -> SplitPlan:
    """Hold out a test set, then draw ``n`` fresh train/valid splits of the rest.

    Fold ``i`` uses seed ``seed + i``: validation sets of different folds
    overlap, this is repeated random sub-sampling rather than k-fold.
    """
    keys = df.select(key) if assume_unique else _distinct_keys(df, key)
    (test,) = fit_cuts(keys, key, [seed], test_frac, assume_unique=True)
    rest = keys.filter(~test.inside(key))
    folds = fit_cuts(rest, key, [seed + i for i in range(n)], frac, assume_unique=True)
    return SplitPlan(key, test, tuple(folds))


def repeated_splits(
    df: DataFrame, key: str, n: int = 5, frac: float = 1 / 9, seed: int = 42, test_frac: float = 0.1,
    assume_unique: bool = False,
) -> DataFrame:
    """Membership table (key, fold, role) of :func:`fit_splits`, one row per distinct key and fold."""
    keys = df.select(key) if assume_unique else _distinct_keys(df, key)
    return fit_splits(keys, key, n, frac, seed, test_frac, assume_unique=True).membership(keys)


def shift_split(
    df: DataFrame, key: str, column: str = "level", threshold: float = 30, frac: float = 1 / 9, seed: int = 42,
    assume_unique: bool = False,
) -> DataFrame:
    """Train and valid below the threshold, test from it on: a shifted test set."""
    small = F.coalesce(F.col(column) < threshold, F.lit(False))
    (cut,) = fit_cuts(df.filter(small), key, [seed], frac, assume_unique)
    return df.withColumn("role", F.when(~small, "test").when(cut.inside(key), "valid").otherwise("train"))


def split_summary(membership: DataFrame, by: Sequence[str] = ("fold", "role")) -> DataFrame:
    return membership.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def dedup_summary(df: DataFrame, subset: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows before and after deduplication on ``subset``, per group.

    The group columns are part of the key, as each side is deduplicated alone.
    """
    keys = [*by, *(c for c in subset if c not in by)]
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.groupBy(*by).agg(
        F.sum("_n").alias("rows_before"), F.count(F.lit(1)).alias("rows_after")
    )


def weak_sets(
    exact: DataFrame, bounded: DataFrame, exact_plan: SplitPlan, bounded_plan: SplitPlan, fold: int = 0,
    bounds: str = "q_gonality_bounds",
) -> DataFrame:
    """Exact and bounded rows as one weakly supervised set.

    Adds ``role``, ``source`` and the lower/upper targets; keeping one source
    gives the separate accuracy sets.
    """
    parts = [
        plan.with_role(rows, fold).withColumn("source", F.lit(source))
        for rows, plan, source in ((exact, exact_plan, "exact"), (bounded, bounded_plan, "bounded"))
    ]
    return bounds_columns(concat_rows(parts), bounds)
