"""Feature preparation: scaling, codes, list vectors, monomials."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spantab.operators.cleaning import _is_missing, _quoted
from spantab.staging import stage

# How missing and boolean cells read as category text.
NULL_CLASS = "nan"
BOOLEAN_CLASSES = {True: "True", False: "False"}

SMALL_CODE_TABLE = 100_000
#: Most classes of a column that are looked up in a literal map instead of a join.
LITERAL_CLASSES = 64


@dataclass(frozen=True)
class Scale:
    column: str
    mean: float
    std_pop: float
    divisor: float


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> list[Scale]:
    """Mean and population deviation per column, missing cells ignored, in one aggregation.

    A column that is constant up to rounding divides by 1.
    """
    known = {c: F.when(~_is_missing(df, c), _quoted(c).cast("double")) for c in columns}
    (row,) = df.agg(
        *(f(known[c]).alias(f"{n}{i}") for i, c in enumerate(columns)
          for n, f in (("m", F.avg), ("s", F.stddev_pop), ("n", F.count)))
    ).collect()
    out = []
    eps = sys.float_info.epsilon
    for i, c in enumerate(columns):
        mean, std, n = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0, row[f"n{i}"]
        constant = std**2 <= n * eps * std**2 + (n * mean * eps) ** 2 or std < 10 * eps
        out.append(Scale(c, mean, std, 1.0 if constant else std))
    return out


def apply_scaler(df: DataFrame, scaler: Sequence[Scale]) -> DataFrame:
    return df.withColumns(
        {s.column: (_quoted(s.column).cast("double") - F.lit(s.mean)) / F.lit(s.divisor) for s in scaler}
    )


def class_text(df: DataFrame, column: str) -> Column:
    c = _quoted(column)
    if isinstance(df.schema[column].dataType, T.BooleanType):
        text = F.when(c, BOOLEAN_CLASSES[True]).when(~c, BOOLEAN_CLASSES[False])
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(NULL_CLASS))


def fit_encoder(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Code table (column, class, code): classes sorted, codes (bigint) from 0 per column.

    The distinct classes are combined map-side. A table of at most
    ``SMALL_CODE_TABLE`` classes is ranked in one window per column; a larger
    one is range-sorted and numbered block by block, so no task holds more
    than its own range.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), class_text(df, c).alias("class")) for c in columns))
    classes = df.select(F.explode(pairs).alias("p")).select("p.column", "p.class").distinct()
    classes = stage(classes, "classes")
    by_column = Window.partitionBy("column").orderBy("class")
    if classes.count() <= SMALL_CODE_TABLE:
        return classes.withColumn("code", (F.row_number().over(by_column) - 1).cast("bigint"))
    return number_in_order(classes, "column", "class", "code")


def number_in_order(distinct: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """0-based position of each distinct ``value`` inside its group, for sets of any size."""
    blocks = stage(
        distinct.repartitionByRange(group, value).withColumn("_block", F.spark_partition_id()), "blocks"
    )
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_block").orderBy(value)
    return (
        blocks.join(offsets, [group, "_block"])
        .withColumn(name, (F.row_number().over(inside) - 1 + F.col("_offset")).cast("bigint"))
        .drop("_block", "_offset")
    )


def apply_encoder(df: DataFrame, encoder: DataFrame, columns: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Add ``<column>_code``; a class the encoder has not seen fails the job.

    Columns of at most ``LITERAL_CLASSES`` classes, whose rows all share few
    keys, are looked up in a literal map; only the others are joined.
    """
    sizes = encoder.groupBy("column").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= LITERAL_CLASSES)
    few = encoder.join(sizes, "column", "left_semi").filter(F.col("column").isin(list(columns)))
    known: dict[str, list[Row]] = {}
    for row in few.collect():  # LITERAL_CLASSES per column at most
        known.setdefault(row["column"], []).append(row)
    out = df
    for c in columns:
        unseen = F.raise_error(F.concat(F.lit(f"unseen class in {c}: "), F.col("_text"))).cast("bigint")
        out = out.withColumn("_text", class_text(out, c))
        if c in known:
            pairs = [F.lit(v) for r in known[c] for v in (r["class"], r["code"])]
            code = F.try_element_at(F.create_map(*pairs), F.col("_text"))
            out = out.withColumn(f"{c}{suffix}", F.coalesce(code.cast("bigint"), unseen)).drop("_text")
            continue
        codes = encoder.filter(F.col("column") == c).select(
            F.col("class").alias("_class"), F.col("code").alias("_code")
        )
        out = (
            out.join(codes, F.col("_text") == F.col("_class"), "left")
            .withColumn(f"{c}{suffix}", F.coalesce(F.col("_code"), unseen))
            .drop("_text", "_class", "_code")
        )
    return out


def cardinalities(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, cardinality) of each existing column, nulls ignored.

    The exact count makes (column, value) pairs distinct first, so hot values
    collapse map-side and one shuffle serves all columns.
    """
    present = [c for c in columns if c in df.columns]
    if approximate:
        row = df.agg(*(F.approx_count_distinct(_quoted(c)).alias(str(i)) for i, c in enumerate(present)))
        pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("cardinality"))
                          for i, c in enumerate(present)))
        return row.select(F.explode(pairs).alias("p")).select("p.*")
    pairs = F.array(
        *(F.struct(F.lit(c).alias("column"), F.when(~_is_missing(df, c), _quoted(c).cast("string")).alias("v"))
          for c in present)
    )
    values = df.select(F.explode(pairs).alias("p")).select("p.column", "p.v").distinct()
    return values.groupBy("column").agg(F.count("v").alias("cardinality"))


def list_length(columns: Sequence[Column]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.size(c), F.lit(0))
    return total


def _flat(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
    return F.flatten(_quoted(name)) if nested else _quoted(name)


def max_list_len(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Longest joined list (nested lists flattened), as a one-row frame."""
    return df.agg(F.max(list_length([_flat(df, c) for c in columns])).alias("max_list_len"))


def list_vector(df: DataFrame, columns: Sequence[str], length: int, name: str = "list_vector") -> DataFrame:
    """The lists joined, nested ones flattened, cut or padded with 0 to ``length``."""
    empty = F.array().cast("array<int>")
    parts = [F.coalesce(_flat(df, c), empty) for c in columns]
    return df.withColumn(name, F.slice(F.concat(*parts, F.array_repeat(F.lit(0), length)), 1, length))


def exponents(n: int, degree: int) -> list[tuple[int, ...]]:
    """Exponent tuples of all monomials of total degree 1…degree, by degree, then by input order."""
    return [
        tuple(chosen.count(i) for i in range(n))
        for d in range(1, degree + 1)
        for chosen in combinations_with_replacement(range(n), d)
    ]


def monomial_names(columns: Sequence[str], degree: int) -> list[str]:
    return [
        " ".join(c if e == 1 else f"{c}^{e}" for c, e in zip(columns, powers) if e)
        for powers in exponents(len(columns), degree)
    ]


def monomials(columns: Sequence[str], degree: int) -> list[Column]:
    out = []
    for powers in exponents(len(columns), degree):
        product = None
        for c, e in zip(columns, powers):
            for _ in range(e):
                x = _quoted(c).cast("double")
                product = x if product is None else product * x
        out.append(product)
    return out


def poly_expand(df: DataFrame, columns: Sequence[str], degree: int = 3, name: str = "poly") -> DataFrame:
    """Array of all monomials, in the order of :func:`monomial_names`."""
    return df.withColumn(name, F.array(*monomials(columns, degree)))


def nan_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing, any_missing) with nulls, NaN and missing list elements counted."""
    names = list(columns or df.columns)

    def gap(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, T.ArrayType):
            floating = isinstance(kind.elementType, (T.DoubleType, T.FloatType))
            inner = F.exists(_quoted(c), lambda x: (x.isNull() | F.isnan(x)) if floating else x.isNull())
            return _quoted(c).isNull() | F.coalesce(inner, F.lit(False))
        return _is_missing(df, c)

    row = df.agg(*(F.count_if(gap(c)).alias(str(i)) for i, c in enumerate(names)))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("missing")) for i, c in enumerate(names)))
    return (
        row.select(F.explode(pairs).alias("p")).select("p.*").withColumn("any_missing", F.col("missing") > 0)
    )


def assemble(
    df: DataFrame, numerical: Sequence[str], categorical: Sequence[str] = (), lists: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One sample per row: ``num array<double>``, ``cat struct``, ``lst array<double>``."""
    columns = [*map(_quoted, keep), F.array(*(_quoted(c).cast("double") for c in numerical)).alias("num")]
    if categorical:
        columns.append(F.struct(*(_quoted(c).cast("int").alias(c) for c in categorical)).alias("cat"))
    if lists:
        columns.append(_quoted(lists).cast("array<double>").alias("lst"))
    return df.select(*columns)
