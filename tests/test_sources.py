from __future__ import annotations

import os

import pytest
from pyspark.sql import types as T

from spantab.operators import boosting as B
from spantab.operators.splits import fit_splits
from spantab.sources import catalogue as K
from spantab.sources import chunks as A
from spantab.sources import jdbc
from spantab.sources import tables as W
from spantab.staging import spread, stage


def test_id_range_predicates():
    assert jdbc.id_range_predicates("id", 10, 2) == [
        "id BETWEEN 0 AND 9", "id BETWEEN 10 AND 19", "id BETWEEN 20 AND 29",
    ]


def test_read_id_ranges_asks_one_partition_per_range():
    class Reader:
        def jdbc(self, url, table, predicates, properties):
            return url, table, predicates, properties

    class Session:
        read = Reader()

    url, table, predicates, properties = jdbc.read_id_ranges(Session(), "jdbc:x", "t", "id", 5, 3)
    assert (url, table, len(predicates), properties) == ("jdbc:x", "t", 4, {})


def catalogue_row(name, kind, element=None):
    row = [None] * 30
    row[3], row[7], row[27] = name, kind, element
    return row


def test_schemas(spark):
    schema = K.source_schema()
    assert len(schema.fields) == 75 and len(set(schema.names)) == 75
    assert schema["conductor"].dataType == T.ArrayType(T.ArrayType(T.IntegerType()))
    made = K.schema_from_catalogue([
        catalogue_row("id", "bigint"), catalogue_row("log_conductor", "numeric"), catalogue_row("conductor", "ARRAY", "_int4"),
        catalogue_row("parents", "ARRAY", "_text"), catalogue_row("models", "smallint"), catalogue_row("pointless", "boolean"),
    ])
    for f in made:
        assert f.dataType == schema[f.name].dataType
    assert K.file_schema(schema)["conductor"].dataType == T.StringType()
    assert K.file_schema(schema)["id"].dataType == T.LongType()


def test_delimited_round_trip(spark, tmp_path):
    rows = [(1, 'a;b "q"', " pad "), (2, "", None), (3, "line\nbreak", "\\n")]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    A.write_delimited(df, str(tmp_path / "d"))
    back = A.read_headerless(spark, str(tmp_path / "d"), df.schema, multiline=True)
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_headerless_skips_missing(spark, tmp_path, caplog):
    schema = T.StructType.fromDDL("id int")
    assert A.read_headerless(spark, [str(tmp_path / "no")], schema).count() == 0
    assert "file not found" in caplog.text


def test_chunk_files_by_number(spark, tmp_path):
    for i in (0, 1, 2, 10):
        (tmp_path / f"ranks{i}.csv").write_text(f"{i};x\n")
    (tmp_path / "other.csv").write_text("9;y\n")
    schema = T.StructType.fromDDL("id int, t string")
    got = A.read_chunks(spark, str(tmp_path), 1, 11, schema, "ranks{i}.csv").collect()
    assert sorted((r["id"], r["chunk"]) for r in got) == [(1, 1), (2, 2), (10, 10)]
    assert A.read_chunks(spark, str(tmp_path), 50, 60, schema, "ranks{i}.csv").count() == 0


def test_combine_chunks(spark, tmp_path, caplog):
    files = {
        0: "  id ;level;log  conductor;note\n1; 2 ; 4.5 ;x\n2;3; None ;y\n3;N/A;1;z\n4;5;;w\n5;NA;2;v\n6;7;8 ;None\n",
        1: "id;level;note\n7;8;no column\n",
        2: "id;level;log conductor;note\n8;9;10;u\n9;9;9;u;too;long\n",
        3: "note;log conductor;level;id\nt;0.5;3;10\n\"q;q\";null ;4;11\n",
    }
    for i, text in files.items():
        (tmp_path / f"Ranks{i}.csv").write_text(text)
    paths = [str(tmp_path / f"Ranks{i}.csv") for i in (*files, 99)]
    out = A.combine_chunks(spark, paths, ["id", "level"], ["log conductor"])
    assert out.columns == ["id", "level", "log conductor"]
    # "null " keeps its text: only the exact token counts before trimming, and only None after.
    assert sorted(tuple(r) for r in out.collect()) == [
        ("1", "2", "4.5"), ("10", "3", "0.5"), ("11", "4", "null"), ("6", "7", "8"),
    ]
    assert "Ranks2.csv left out" in caplog.text and "file not found" in caplog.text
    schema = T.StructType.fromDDL("id bigint, level int")
    typed = A.combine_chunks(spark, paths, ["id", "level"], "log conductor", schema=schema)
    assert typed.dtypes[:2] == [("id", "bigint"), ("level", "int")]


def test_equal_header_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;v;v;v.1\n1;2;3;4\n")
    out = A.combine_chunks(spark, [str(tmp_path / "a.csv")], "id", ["v", "v.1", "v.2"])
    assert out.first().asDict() == {"id": "1", "v": "2", "v.1": "4", "v.2": "3"}


def test_compressed_chunk_files(spark, tmp_path, caplog):
    import gzip

    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"id;v\n1;2\n"))
    (tmp_path / "b.csv").write_text("id;v\n3;4\n")
    (tmp_path / "empty.csv").write_text("")
    paths = [str(tmp_path / n) for n in ("a.csv.gz", "b.csv", "empty.csv")]
    assert sorted(tuple(r) for r in A.combine_chunks(spark, paths, "id", "v").collect()) == [("1", "2"), ("3", "4")]
    assert "empty.csv left out" in caplog.text


def test_broken_files_are_left_out_whole(spark, tmp_path):
    import gzip
    import random

    rng = random.Random(3)
    good = "id;v\n" + "".join(f"{i};{rng.random()}\n" for i in range(30_000))
    packed = gzip.compress(good.encode())
    files = {
        "whole.csv.gz": packed, "cut.csv.gz": packed[: len(packed) // 2], "flipped.csv.gz": packed[:-6] + b"\x00" + packed[-5:],
        "plain.csv": good[:2000].rsplit("\n", 1)[0].encode(), "long.csv": good.encode() + b"1;2;3\n", "none.csv": b"a;b\n1;2\n",
        "open.csv": b'id;v\n1;"2\n3;4\n', "packed.csv.snappy": b"id;v\n", "quoted.csv": b'id;v\n7; "x;y" \n8;\n\n',
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    scan = A.scan_chunks(spark, [str(tmp_path)], "id", "v")
    reasons = {r["file"].rsplit("/", 1)[1]: r["reason"] for r in scan.quarantine.collect()}
    assert reasons == {
        "cut.csv.gz": "broken file", "flipped.csv.gz": "broken file", "long.csv": "a line is longer than the header",
        "none.csv": "no wanted column", "open.csv": "a quoted cell goes on in the next line",
        "packed.csv.snappy": "compression snappy is not read",
    }
    rows = [tuple(r) for r in scan.rows.collect()]
    assert len(rows) == 30_000 + files["plain.csv"].count(b"\n") + 1 and ("7", "x;y") in rows
    both = A.scan_chunks(spark, [str(tmp_path / "open.csv")], "id", "v", multiline=True)
    assert [tuple(r) for r in both.rows.collect()] == [("1", "2\n3;4")] and both.quarantine.count() == 0
    assert A.scan_chunks(spark, [str(tmp_path / "none.csv")], "id", "v").rows.columns == []


def test_files_beyond_the_limit_are_named(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("id\n1\n")
    (tmp_path / "b.csv").write_text("id\n" + "2\n" * 50)
    monkeypatch.setattr(A, "MAX_FILE_BYTES", 20)
    scan = A.scan_chunks(spark, [str(tmp_path)], "id", [])
    assert [tuple(r) for r in scan.rows.collect()] == [("1",)]
    assert [r["reason"] for r in scan.quarantine.collect()] == ["longer than 20 bytes"]


def test_sample_is_distinct_and_repeatable(spark):
    df = A.id_range_chunk(spark.range(1000), "id", 100)
    once = {r["chunk"] for r in A.sample_chunks(df, 3, 0, 10).select("chunk").distinct().collect()}
    again = {r["chunk"] for r in A.sample_chunks(df.repartition(7), 3, 0, 10).select("chunk").distinct().collect()}
    assert once == again and len(once) == 3
    assert A.sample_chunks(df, 3, 0, 10).count() == 300


def test_splits_are_pruned(spark, tmp_path):
    exact, bounded = spark.range(500), spark.range(500, 600)
    path = str(tmp_path / "splits")
    W.write_splits(exact, bounded, fit_splits(exact, "id", n=2), path)
    counts = {(r["fold"], r["role"]): r["count"] for r in W.read_splits(spark, path).groupBy("fold", "role").count().collect()}
    assert counts == {(-1, "test"): 50, (-1, "bounded"): 100, (0, "train"): 400, (0, "valid"): 50, (1, "train"): 400, (1, "valid"): 50}
    one = W.read_splits(spark, path, fold=1, role="valid")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and one.count() == 50
    W.write_splits(exact, bounded, fit_splits(exact, "id", n=1), str(tmp_path / "csv"), "csv")
    assert os.path.isdir(tmp_path / "csv" / "fold=0" / "role=train")


def test_results(spark, tmp_path):
    stage_one = B.Stage("logs", "log(row['a'])", 0.5, 0.0, (1.0,), 0.25)
    model = B.BoostModel(("a",), 1, (2.0,), 1.0, (stage_one,), 60.0)
    run = B.BoostRun(model, model, [50.0, 60.0], {"c": dict(seq=1, code_str="c", name="n", body="b", reason="r")}, [])
    evaluation = spark.createDataFrame([("train", 0.5, None)], "dataset string, r2 double, rmse double")
    W.save_results(run, spark, str(tmp_path / "out"), evaluation)
    (text,) = [p.read_text() for p in (tmp_path / "out" / "boosting_coefficients").glob("part-*")]
    assert text.splitlines()[0] == "poly_a\t2.000000000000000000e+00"
    assert W.read_table(spark, str(tmp_path / "out" / "model_progress")).count() == 2
    for fmt in ("json", "csv"):
        W.write_metrics(evaluation, str(tmp_path / fmt), fmt)
        assert W.read_metrics(spark, str(tmp_path / fmt), evaluation.schema, fmt).collect() == evaluation.collect()


def test_staging_keeps_schema(spark):
    df = spark.range(10).selectExpr("id", "array(id) l")
    staged = stage(df)
    assert staged.dtypes == df.dtypes and staged.count() == 10


def test_spread_leaves_large_scans_alone(spark):
    assert spread(spark.range(0, 100, 1, 64)).rdd.getNumPartitions() == 64
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() >= 2


def test_staging_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from spantab import staging

    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.staging_root(Session())


def test_split_blocks_equal_lines_read_one_by_one(spark, tmp_path, monkeypatch):
    """Cells are the same whether lines go through the CSV reader or are split by blocks, in blocks of any size."""
    text = 'k; a;b\n1;  x y ;\n2;"q;""r";é\n\n3;s\n  \n4;t;u;;\n5;\t;v\r\n6; w;"z"\n﻿7;l;m'
    wanted = ["a", "absent", "k", "b"]

    def cells(whole, size):
        monkeypatch.setattr(A, "BLOCK_BYTES", size)
        present, *blocks = A._lines("f.csv", text.encode() + b"\n8;\xff;n", wanted, ";", False, whole=whole)
        plain = [[c.to_pylist() if hasattr(c, "to_pylist") else list(c) for c in b] for b in blocks]
        return present, [row for b in plain for row in zip(*b)]

    expected = cells(True, 1 << 20)
    assert expected[1][1] == ('q;"r', None, "2", "é")
    for size in (1, 5, 12, 1 << 20):
        assert cells(False, size) == expected


@pytest.mark.parametrize("body, reason", [
    ("1;2\n3;4;5\n", "a line is longer than the header"),
    ('1;2\n3;"4\n5;6\n', "a quoted cell goes on in the next line"),
])
@pytest.mark.parametrize("size", [1, 8, 1 << 20])
def test_reasons_do_not_follow_from_blocks(monkeypatch, body, reason, size):
    monkeypatch.setattr(A, "BLOCK_BYTES", size)
    assert A._reason("f.csv", b"a;b\n" + body.encode(), ["a"], ";", False) == reason
    with pytest.raises(A._BadFile, match=reason):
        list(A._lines("f.csv", b"a;b\n" + body.encode(), ["a"], ";", False))


def test_plain_lines_are_split_by_blocks(monkeypatch):
    monkeypatch.setattr(A, "_read_cells", lambda *a: pytest.fail("lines were read one by one"))
    _, cells = A._lines("f.csv", b"a;b\n1;x\n2;\n", ["b", "a"], ";", False)
    assert [c.to_pylist() for c in cells] == [["x", None], ["1", "2"]]


def test_cells_are_cleaned_once(spark, tmp_path):
    """The filter on missing cells reads cleaned cells instead of cleaning them again."""
    (tmp_path / "chunk=0").mkdir()
    (tmp_path / "chunk=0" / "f.csv").write_text("a;b\n1 ; None\n2;x \n")
    rows = A.combine_chunks(spark, [str(tmp_path / "chunk=0")], ["a", "b"], [])
    assert [tuple(r) for r in rows.collect()] == [("2", "x")]
    assert "regexp_replace" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_splits_are_written_without_sorting(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    seen = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (
        seen.append(int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))), write(self, path, *a, **b))[1])
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    exact = spark.range(200).selectExpr("cast(id AS string) AS id", "id AS level")
    plan = fit_splits(exact, "id")
    W.write_splits(exact, exact.limit(5), plan, str(tmp_path / "s"))
    assert seen[-1] >= 12
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert W.read_splits(spark, str(tmp_path / "s")).count() == 5 * 180 + 20 + 5
