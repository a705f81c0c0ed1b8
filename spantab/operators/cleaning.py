"""Projection, null handling and typing of raw rows. Row-local, no shuffle."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spantab.functions.scalars import parse_list, strip_text, to_double

# Text that stands for a missing cell.
NA_TOKENS = ("None", "null", "N/A", "NaN", "")
# Further tokens a reader with default settings takes for missing.
READER_NA_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "NA", "NULL", "n/a", "nan",
)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def as_names(names: str | Iterable[str] | None) -> list[str]:
    if names is None:
        return []
    return [names] if isinstance(names, str) else [n for n in names if n is not None]


def normalised_names(names: Sequence[str]) -> list[str]:
    """Names without outer whitespace, inner whitespace collapsed to one blank."""
    return [re.sub(r"\s+", " ", c.strip()) for c in names]


def normalise_headers(df: DataFrame) -> DataFrame:
    """Strip column names and collapse inner whitespace to one blank."""
    return df.toDF(*normalised_names(df.columns))


def trim_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = string_columns(df) if columns is None else list(columns)
    return df.withColumns({c: strip_text(_quoted(c)) for c in names})


def nullify_tokens(
    df: DataFrame, tokens: Sequence[str] = NA_TOKENS, columns: Sequence[str] | None = None
) -> DataFrame:
    """Cells equal to one of the tokens become null."""
    names = string_columns(df) if columns is None else list(columns)
    return df.withColumns(
        {c: F.when(~_quoted(c).isin(list(tokens)), _quoted(c)) for c in names}
    )


def project(
    df: DataFrame,
    feature: str | Sequence[str] | None,
    target: str | Sequence[str] | None,
    strict: bool = False,
) -> DataFrame:
    """Feature and target columns.

    Tolerant: absent columns are left out with a warning, and no column at all
    gives an empty frame. Strict: absent columns raise and rows with nulls go.
    """
    wanted = as_names(feature) + as_names(target)
    present = [c for c in wanted if c in df.columns]
    missing = [c for c in wanted if c not in df.columns]
    if strict:
        if missing:
            raise KeyError(f"missing columns: {missing}")
        return df.select(*map(_quoted, present)).dropna("any")
    if missing:
        warnings.warn(f"columns not found: {missing}", stacklevel=2)
    if not present:
        return df.sparkSession.createDataFrame([], T.StructType([]))
    return df.select(*map(_quoted, present))


def drop_null_rows(df: DataFrame, *groups: str | Sequence[str] | None) -> DataFrame:
    """Drop rows with a null in any of the named columns that exist."""
    wanted = dict.fromkeys(c for g in groups for c in as_names(g))
    subset = [c for c in wanted if c in df.columns]
    return df.dropna("any", subset=["`" + c.replace("`", "``") + "`" for c in subset]) if subset else df


def coerce_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, fill: float | None = None
) -> DataFrame:
    """Text columns to double, bad text to null; with ``fill`` no null or NaN is left."""
    names = string_columns(df) if columns is None else list(columns)
    types = dict(df.dtypes)
    out = df.withColumns({c: to_double(_quoted(c), types[c]) for c in names})
    return out if fill is None else out.fillna(fill)


def derive_rank(df: DataFrame, genus: str = "genus", minus_rank: str = "genus_minus_rank") -> DataFrame:
    return df.withColumn("rank", F.col(genus) - F.col(minus_rank))


def parse_lists(df: DataFrame, depths: dict[str, int], on_error: str = "raise") -> DataFrame:
    """List text to arrays; columns that are arrays already pass through."""
    types = {f.name: f.dataType for f in df.schema.fields}
    text = {c: d for c, d in depths.items() if isinstance(types[c], T.StringType)}
    return df.withColumns({c: parse_list(_quoted(c), d, on_error) for c, d in text.items()})


def expanded_names(columns: Sequence[str], name: str, n: int = 4) -> list[str]:
    """A feature list with ``name`` replaced by its ``n`` element columns, put last."""
    if name not in columns:
        return list(columns)
    return [c for c in columns if c != name] + [f"{name}_{i}" for i in range(n)]


def expand_list(df: DataFrame, name: str, n: int = 4) -> DataFrame:
    """Columns ``name_0 … name_{n-1}``; null where the list is shorter."""
    return df.withColumns({f"{name}_{i}": F.get(F.col(name), i) for i in range(n)})


def is_exact(bounds: Column | str = "q_gonality_bounds") -> Column:
    """lower = upper, reading the pair once; null when a bound is missing."""
    pair = F.slice(F.col(bounds) if isinstance(bounds, str) else bounds, 1, 2)
    return F.size(F.array_distinct(pair)) == F.lit(1)


def mark_exact(df: DataFrame, bounds: str = "q_gonality_bounds") -> DataFrame:
    return df.withColumn("is_exact", is_exact(bounds))


def split_exact_bounded(df: DataFrame, bounds: str = "q_gonality_bounds") -> tuple[DataFrame, DataFrame]:
    """(rows with lower = upper, rows with lower != upper); both are plain filters."""
    return df.filter(is_exact(bounds)), df.filter(~is_exact(bounds))


def exact_target(df: DataFrame, bounds: str = "q_gonality_bounds", name: str = "q_gonality") -> DataFrame:
    """Scalar target: first bound of a list or of list text; a number passes."""
    kind = df.schema[bounds].dataType
    if isinstance(kind, T.ArrayType):
        return df.withColumn(name, F.get(F.col(bounds), 0))
    if isinstance(kind, T.StringType):
        return df.withColumn(name, F.get(parse_list(bounds), 0))
    return df.withColumn(name, F.col(bounds))


def bounds_columns(
    df: DataFrame, bounds: str = "q_gonality_bounds", prefix: str = "q_gonality"
) -> DataFrame:
    pair = F.col(bounds) if isinstance(df.schema[bounds].dataType, T.ArrayType) else parse_list(bounds)
    return df.withColumns({f"{prefix}_lower": F.get(pair, 0), f"{prefix}_upper": F.get(pair, 1)})


def bounds_targets(
    targets: Sequence[str], bounds: str = "q_gonality_bounds", prefix: str = "q_gonality"
) -> list[str]:
    """A target list with the bounds column replaced by the lower and upper columns."""
    if bounds not in targets:
        return list(targets)
    return [t for t in targets if t != bounds] + [f"{prefix}_lower", f"{prefix}_upper"]


def to_float32(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: _quoted(c).cast("float") for c in columns})


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _is_missing(df: DataFrame, name: str) -> Column:
    c = _quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def any_null(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return reduce(lambda a, b: a | b, (_is_missing(df, c) for c in (columns or df.columns)))


def head_nulls(df: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows with any null, in key order; a distributed top-n."""
    rows = df.filter(any_null(df))
    return (rows.orderBy(*order) if order else rows).limit(n)
