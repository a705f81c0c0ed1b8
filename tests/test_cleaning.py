from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spantab.functions.scalars import parse_list, round_half_up, to_double
from spantab.operators import cleaning as C
from spantab.operators.profiles import null_profile


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        ("a", 2, 0, 0, "0", "[1, 0, 0, 1]", "[]", "[1, 1]"),
        ("b", 6, 3, 1, " 4.5 ", "[1, 2]", "[[2, 3], [3, 1]]", "[2, 2]"),
        ("c", 6, 3, 1, " 4.5 ", "[1, 2]", "[[2, 3], [3, 1]]", "[2, 2]"),
        ("d", 30, 9, 0, "None", "[3, 1, 0, 2]", "[[2, 4]]", "[3, 6]"),
        ("e", 49, 12, 5, "x", "oops", "[[7, 2]]", "[4, 4]"),
    ]
    schema = (
        "id string, level int, genus int, genus_minus_rank int, log_conductor string, canonical_conjugator string,"
        " conductor string, q_gonality_bounds string"
    )
    return spark.createDataFrame(data, schema)


def column(df, name, key="id"):
    return {r[key]: r[name] for r in df.select(key, name).collect()}


def test_round_half_up(spark):
    df = spark.createDataFrame([(-2.5,), (0.49,), (0.5,), (2.5,), (6.0,), (float("nan"),), (None,)], "p double")
    got = [r[0] for r in df.select(round_half_up("p")).collect()]
    assert got == [-2, 0, 1, 3, 6, None, None]


def test_numbers(rows, spark):
    assert column(C.coerce_numeric(rows, ["log_conductor"]), "log_conductor") == {
        "a": 0.0, "b": 4.5, "c": 4.5, "d": None, "e": None,
    }
    assert column(C.coerce_numeric(rows, ["log_conductor"], fill=0.0), "log_conductor")["e"] == 0.0
    texts = spark.createDataFrame([("1d",), ("0x1p3",), ("1e3",), ("-inf",), (" 7 ",), ("",)], "t string")
    assert [r[0] for r in texts.select(to_double("t")).collect()] == [None, None, 1000.0, float("-inf"), 7.0, None]


def test_rank_overwrites(rows):
    df = C.derive_rank(rows.withColumn("rank", F.lit(99)))
    assert column(df, "rank") == {"a": 0, "b": 2, "c": 2, "d": 9, "e": 7}


def test_parse_list(spark):
    texts = ["[1, 2]", "(1, 2)", "[1,]", "[]", "[1, 2", "[1, x]", "7", "[1] tail", " [ -3 ] ", "[1.5]", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tolerant = [r[0] for r in df.select(parse_list("t", 1, "empty")).collect()]
    assert tolerant == [[1, 2], [1, 2], [1], [], [], [], [], [], [-3], [], []]
    nulls = [r[0] for r in df.select(parse_list("t", 1, "null")).collect()]
    assert nulls[4:8] == [None] * 4 and nulls[3] == []
    with pytest.raises(Exception, match="not a list of numbers"):
        df.select(parse_list("t")).collect()


def test_parse_nested(spark):
    texts = ["[[2, 3], [5, 1]]", "[]", "((1, 2), (3, 4))", "[[1], 2]", "[[1]", "[(7, 8),]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_list("t", 2, "null")).collect()]
    assert got == [[[2, 3], [5, 1]], [], [[1, 2], [3, 4]], None, None, [[7, 8]]]


def test_long_list_text(spark):
    text = "[" + ", ".join(str(i) for i in range(200_000)) + "]"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.size(parse_list("t"))).first()[0] == 200_000
    nested = "[" + ", ".join(f"[{i}, {i}]" for i in range(50_000)) + "]"
    df = spark.createDataFrame([(nested,)], "t string")
    assert df.select(F.size(parse_list("t", 2))).first()[0] == 50_000


def test_exact_and_bounded(rows):
    df = C.parse_lists(rows, {"q_gonality_bounds": 1})
    exact, bounded = C.split_exact_bounded(df)
    assert column(C.exact_target(exact), "q_gonality") == {"a": 1, "b": 2, "c": 2, "e": 4}
    assert column(C.bounds_columns(bounded), "q_gonality_upper") == {"d": 6}
    assert column(C.bounds_columns(rows), "q_gonality_lower")["d"] == 3
    assert C.bounds_targets(["q_gonality_bounds", "x"]) == ["x", "q_gonality_lower", "q_gonality_upper"]
    number = C.exact_target(rows, bounds="level", name="y")
    assert column(number, "y")["e"] == 49


def test_expand_list(rows):
    df = C.expand_list(C.parse_lists(rows, {"canonical_conjugator": 1}, on_error="empty"), "canonical_conjugator")
    assert column(df, "canonical_conjugator_3") == {"a": 1, "b": None, "c": None, "d": 2, "e": None}
    assert C.expanded_names(["x", "l", "y"], "l", 2) == ["x", "y", "l_0", "l_1"]


def test_trim_takes_every_blank(spark):
    df = spark.createDataFrame([(" \t a b \n\x1f",)], "t string")
    assert C.trim_strings(df).first()[0] == "a b"


def test_headers_and_tokens(spark):
    df = spark.createDataFrame([("None", " None ")], ["  a \t b ", "c"])
    tidy = C.normalise_headers(df)
    assert tidy.columns == ["a b", "c"]
    assert tuple(C.nullify_tokens(tidy).first()) == (None, " None ")
    assert tuple(C.nullify_tokens(C.trim_strings(tidy), ("None",)).first()) == (None, None)


def test_project(rows):
    with pytest.warns(UserWarning, match="absent"):
        assert C.project(rows, ["id", "absent"], "level").columns == ["id", "level"]
    with pytest.warns(UserWarning):
        assert C.project(rows, "absent", None).columns == []
    with pytest.raises(KeyError):
        C.project(rows, ["absent"], "level", strict=True)


def test_drop_and_head_nulls(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "x", float("nan")), (3, "y", 2.0)], "id int, t string, v double")
    assert [r[0] for r in C.drop_null_rows(df, ["t", "absent"], "v").collect()] == [3]
    assert [r[0] for r in C.head_nulls(df, 1, ["id"]).collect()] == [1]
    profile = {r["column"]: (r["nulls"], r["any_null"]) for r in null_profile(df).collect()}
    assert profile == {"id": (0, False), "t": (1, True), "v": (1, True)}


def test_concat_rows_aligns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    b = spark.createDataFrame([(2.0, 2)], "v double, id int")
    got = sorted(tuple(r) for r in C.concat_rows([a, b]).select("id", "t", "v").collect())
    assert got == [(1, "x", None), (2, None, 2.0)]


def test_numbers_beyond_the_element_type_are_no_list(spark):
    df = spark.createDataFrame([("[99999999999]",), ("[2147483647, -2147483648]",), ("[0000000000001]",)], "t string")
    assert [r[0] for r in df.select(parse_list("t", 1, "null")).collect()] == [None, [2147483647, -2147483648], [1]]
    assert df.select(parse_list("t", 1, "empty")).first()[0] == []
    with pytest.raises(Exception, match="not a list"):
        df.select(parse_list("t")).collect()
    assert df.select(parse_list("t", 1, element="bigint")).first()[0] == [99999999999]
