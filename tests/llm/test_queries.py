"""Registered queries next to their SQL twins, and the entry without this folder."""

from __future__ import annotations

import subprocess
import sys

import pytest

from spantab.llm.queries import ORACLES, QUERIES
from tests.oracle_check import connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = connect(sf_dir).execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_names_and_types(spark, sf_dir):
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    kinds = dict(QUERIES["op2_toxicity"](spark, sf_dir).dtypes)
    assert kinds["held_out"] == "boolean" and kinds["score"] == "double" and kinds["predicted"] == "int"


def test_entry_works_without_this_folder(tmp_path):
    code = (
        "import sys; sys.modules['spantab.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline'] and e.queries()"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
