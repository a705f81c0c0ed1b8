"""Fingerprint components and vector search against brute force."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from spantab.llm import simhash, vector_search
from spantab.llm.queries import QUERIES


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(codes, max_bits):
    """Smallest index reachable over links, by repeated minimum over all pairs."""
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= max_bits
    label = np.arange(len(codes))
    while True:
        least = np.where(near, label[None, :], len(codes)).min(axis=1)
        if (least == label).all():
            return label
        label = least


def test_fingerprints_and_components_equal_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    codes = [_fingerprint(texts[i]) for i in ids]
    label = _components(np.array(codes, np.uint64), 4)
    got = {r.doc_id: r for r in QUERIES["op9_simhash"](spark, sf_dir).collect()}
    for i, code, least in zip(ids, codes, label):
        assert got[i].fingerprint == f"{code:016x}" and got[i].component_id == ids[least]


def _clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64) * np.uint64(2)
    codes = centres[rng.integers(0, 12, n)]
    for _ in range(5):
        codes = codes ^ np.where(rng.random(n) < 0.7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(codes)


def test_large_nodes_are_split_without_losing_links(spark, monkeypatch):
    codes = _clustered(2500, 3)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code bigint").repartition(6)
    label = _components(codes, 4)
    want = {frozenset(codes[label == k].view(np.int64).tolist()) for k in set(label.tolist())}
    for node_members in (16_384, 30):
        stars = simhash.components(simhash.link_codes(df, 4, node_members)).collect()
        groups = {int(c): {int(c)} for c in codes.view(np.int64)}
        for r in stars:
            groups[r.root].add(r.node)
            groups.pop(r.node)
        assert {frozenset(g) for g in groups.values()} == want


def test_leaf_pruning_keeps_all_near_pairs():
    codes = _clustered(700, 8)
    near = simhash._near(codes[:500], codes[300:], 4)
    assert (near == (np.bitwise_count(codes[:500, None] ^ codes[None, 300:]) <= 4)).all()


def test_gray_rank_is_the_gray_sequence(spark):
    codes = [i ^ i >> 1 for i in range(64)]
    df = spark.createDataFrame([(c,) for c in codes], "code bigint").withColumn("rank", simhash.gray_rank(F.col("code")))
    assert [r.code for r in df.orderBy("rank").collect()] == codes


def test_near_duplicates_odd_input(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3} and {
        r.fingerprint for r in rows if r.doc_id in (3, 4, 5)} == {"0" * 16}
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    kept = simhash.drop_near_duplicates(odd)
    assert kept.schema == odd.schema
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 7, 8]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_search_equals_brute_force_when_all_leaves_are_visited(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(600, 8)).astype(np.float32)
    data[100:300] = data[100]  # a third of all rows alike
    df = _vectors(spark, [(i, v.tolist()) for i, v in enumerate(data)])
    got = vector_search.nearest(df, df.filter("vec_id % 20 = 0"), recall=1.0, leaf_rows=40).collect()
    wide = data.astype(float)
    norms = np.sqrt((wide * wide).sum(axis=1))
    hits = total = 0
    for q in range(0, 600, 20):
        score = (wide * wide[q]).sum(axis=1) / (norms * norms[q])
        score[q] = -9
        want = np.lexsort((np.arange(600), -score))[:5].tolist()
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(r.score == score[r.vec_id] for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & set(want)), total + 5
        if 100 <= q < 300:
            assert [r.vec_id for r in mine] == want
    assert hits / total >= 0.98


def test_search_recall_on_the_given_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    wide, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = QUERIES["op7_vector_search"](spark, sf_dir).collect()
    norms, hits = np.sqrt((wide * wide).sum(axis=1)), 0
    queries = np.flatnonzero(ids % 50 == 0)
    for q in queries:
        score = (wide * wide[q]).sum(axis=1) / (norms * norms[q])
        score[q] = -9
        hits += len(set(ids[np.lexsort((ids, -score))[:5]].tolist()) & {r.vec_id for r in got if r.query_id == ids[q]})
    assert hits >= 0.9 * 5 * len(queries) and len(got) == 5 * len(queries)


def test_search_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
            (6, [None, 1.0]), (7, [0.0, 2.0]), (8, [1.0]), (None, [1.0, 1.0])]
    df = _vectors(spark, rows)
    got = vector_search.nearest(df, df).collect()
    assert {r.query_id for r in got} == {0, 1, 7}
    assert [(r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0] == [(1, 1, 1.0), (2, 7, 0.0)]
    assert vector_search.nearest(df.limit(0), df).count() == 0
    assert vector_search.nearest(df, df.limit(0)).count() == 0
    alone = _vectors(spark, [(1, [1.0, 2.0])])
    assert vector_search.nearest(alone, alone).count() == 0
