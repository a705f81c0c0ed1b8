"""Scalar expressions shared by the operators. All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip removes, written as a Java regex class.
STRIP_CLASS = r"[\s\x1c-\x1f]"
STRIP_PATTERN = rf"(?U)^{STRIP_CLASS}+|{STRIP_CLASS}+\z"


def _as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_up(col: Column | str) -> Column:
    """floor(p + 0.5) as bigint; NaN and null give null, so they never match."""
    p = _as_column(col).cast("double")
    return F.when(~F.isnan(p), F.floor(p + F.lit(0.5)))


def clean_double(col: Column | str, default: float = 0.0) -> Column:
    """Null, NaN and the infinities become ``default``."""
    x = _as_column(col).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x).otherwise(F.lit(default))


def strip_text(col: Column | str) -> Column:
    return F.regexp_replace(_as_column(col), STRIP_PATTERN, "")


def to_double(col: Column | str, dtype: str = "string") -> Column:
    """Numeric value of a cell, null where the text is not a number.

    The JVM parser also takes a trailing type letter (``1d``) and hexadecimal
    floats; neither is a number in a data file, so both give null.
    """
    c = _as_column(col)
    if dtype != "string":
        return c.cast("double")
    jvm_only = c.rlike(r"^\s*[+-]?(0[xX].*|[0-9.].*[dDfF])\s*$")
    return F.when(~jvm_only, c.try_cast("double"))


def parse_list(
    col: Column | str, depth: int = 1, on_error: str = "raise", element: str = "int"
) -> Column:
    """Typed array from list text such as ``[1, 2]`` or ``[[2, 3], [5, 1]]``.

    Round brackets and a trailing comma are accepted. ``on_error="raise"``
    fails the job on text that is no list or holds a number beyond the element type, ``"empty"`` returns an empty array
    for it (and for null), ``"null"`` returns null.
    """
    if on_error not in ("raise", "empty", "null"):
        raise ValueError(f"unknown on_error: {on_error}")
    schema = element
    for _ in range(depth):
        schema = f"array<{schema}>"
    c = _as_column(col)
    # The whole text must be a list: the parsers alone would take a broken tail
    # as a partial result. Possessive quantifiers keep the matcher iterative on
    # lists of any length.
    item = r"-?\d++" if element in ("int", "bigint") else r"-?\d++(?:\.\d*+)?+(?:[eE][+-]?\d++)?+"
    for _ in range(depth):
        inner = rf"\s*+(?:{item}\s*+(?:,\s*+{item}\s*+)*+(?:,\s*+)?+)?+"
        item = rf"(?:\[{inner}\]|\({inner}\))"
    whole = rf"^\s*+{item}\s*+\z"
    if depth == 1:
        # Flat lists stay inside generated code.
        cells = F.array_remove(F.split(F.translate(c, "[]() \t\r\n\f", ""), ","), "")
        parsed = cells.try_cast(schema)
        digits = {"int": 10, "bigint": 19}.get(element)
        if digits:
            # Only numbers of so many digits can be out of range; then the text is no list of the element type.
            in_range = F.transform(F.array(parsed), lambda a: F.when(~F.exists(a, lambda x: x.isNull()), a))[0]
            parsed = F.when(c.rlike(rf"\d{{{digits}}}"), in_range).otherwise(parsed)
        parsed = F.when(c.rlike(whole), parsed)
    else:
        # No match extracts the empty string, which is null as JSON.
        text = F.regexp_replace(F.translate(F.regexp_extract(c, whole, 0), "()", "[]"), r",\s*\]", "]")
        parsed = F.from_json(text, schema)
    if on_error == "empty":
        return F.coalesce(parsed, F.from_json(F.lit("[]"), schema))
    if on_error == "null":
        return parsed
    message = F.concat(F.lit("not a list of numbers: "), c)
    return F.coalesce(parsed, F.when(c.isNotNull(), F.raise_error(message).cast(schema)))


def split_hash(key: Column | str, seed: int) -> Column:
    """The first eight hex digits of md5 of ``seed:key``; text order is number order."""
    text = F.concat(F.lit(f"{seed}:"), _as_column(key).cast("string"))
    return F.substring(F.md5(text), 1, 8)
