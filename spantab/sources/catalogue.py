"""Explicit schemas from a column catalogue; types are never inferred from data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import types as T

# The columns of the source table, in file order.
SOURCE_COLUMNS = """
id long, label string, coarse_level int, coarse_index int, genus int, coarse_label string,
coarse_class string, coarse_class_num int, coarse_num int, level int, index int, fine_num int,
contains_negative_one boolean, determinant_label string, scalar_label string, generators array<int>,
canonical_generators array<int>, parents array<string>, parents_conj array<int>, reductions array<string>,
factorization array<string>, orbits array<int>, kummer_orbits array<int>, isogeny_orbits array<int>,
psl2index int, nu2 int, nu3 int, cusps int, psl2level int, sl2level int,
rational_cusps int, cusp_orbits array<int>, cusp_widths array<int>, psl2label string, sl2label string,
CPlabel string, Slabel string, SZlabel string, RZBlabel string, RSZBlabel string, Glabel string, name string,
rank int, genus_minus_rank int, newforms array<string>, dims array<int>, mults array<int>, traces array<int>,
trace_hash long, simple boolean, squarefree boolean, power boolean, conductor array<array<int>>,
log_conductor double, q_gonality int, q_gonality_bounds array<int>, qbar_gonality int,
qbar_gonality_bounds array<int>, bad_primes array<int>, num_bad_primes int,
level_radical int, level_is_squarefree boolean, cm_discriminants array<int>, obstructions array<int>,
pointless boolean, num_known_degree1_points int, lattice_labels array<string>, lattice_x array<int>,
curve_label string, canonical_conjugator array<int>, has_obstruction short,
num_known_degree1_noncusp_points int, num_known_degree1_noncm_points int, models short,
all_degree1_points_known boolean
"""
# SQL type names of an information schema, and element types of its arrays.
SQL_TYPES = {
    "bigint": T.LongType(), "integer": T.IntegerType(), "smallint": T.ShortType(), "numeric": T.DoubleType(),
    "boolean": T.BooleanType(), "text": T.StringType(),
}
ELEMENT_TYPES = {"_int4": T.IntegerType(), "_int8": T.LongType(), "_text": T.StringType()}
# Positions of name, type and element type in a catalogue row.
NAME_AT, TYPE_AT, ELEMENT_AT = 3, 7, 27


def column_type(sql_type: str, element: str | None = None) -> T.DataType:
    if sql_type.upper() == "ARRAY":
        return T.ArrayType(ELEMENT_TYPES[element])
    return SQL_TYPES[sql_type]


def schema_from_catalogue(
    rows: Iterable[Sequence], nested: Sequence[str] = ("conductor",)
) -> T.StructType:
    """Schema of a table from its information-schema rows; ``nested`` columns hold lists of lists."""
    fields = []
    for row in rows:
        kind = column_type(row[TYPE_AT], row[ELEMENT_AT])
        fields.append(T.StructField(row[NAME_AT], T.ArrayType(kind) if row[NAME_AT] in nested else kind))
    return T.StructType(fields)


def source_schema() -> T.StructType:
    return T.StructType.fromDDL(" ".join(SOURCE_COLUMNS.split()))


def text_schema(schema: T.StructType) -> T.StructType:
    """The same columns as they stand in a text file: lists and everything else as text."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def file_schema(schema: T.StructType) -> T.StructType:
    """Scalars typed, list columns as text: what a delimited reader can parse directly."""
    return T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema]
    )
