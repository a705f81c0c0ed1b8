"""Column-level building blocks: everything here maps Columns to Columns."""

from spantab.functions.formula import FormulaError, formula_column, formula_columns
from spantab.functions.scalars import (
    clean_double,
    parse_list,
    round_half_up,
    split_hash,
    strip_text,
    to_double,
)
from spantab.functions.text import readable_name

__all__ = [
    "FormulaError",
    "clean_double",
    "formula_column",
    "formula_columns",
    "parse_list",
    "readable_name",
    "round_half_up",
    "split_hash",
    "strip_text",
    "to_double",
]
