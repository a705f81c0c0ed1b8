"""Mixing and sharding: targets, totals, proportions and odd input."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from spantab.llm import mixing, ordering, sharding


def _water_level(sizes: dict, weights: dict, budget: float) -> dict:
    """Targets by sharing the excess again and again until no source is above its cap."""
    full, left = {}, budget
    while True:
        open_ones = [s for s in sizes if s not in full]
        share = {s: left * weights[s] / sum(weights[x] for x in open_ones) for s in open_ones}
        over = [s for s in open_ones if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def test_targets_and_totals(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix_words(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = _water_level(sizes, weights, 1.5 * sum(sizes.values()))
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert all(r.target == pytest.approx(want[s]) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    # the mix is one stream: starts are distinct places in it
    starts = sorted(r.mix_start for r in rows if r.taken)
    assert starts[0] == 0 and len(set(starts)) == len(starts)


def test_uneven_weights_fill_small_sources(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1), ("a", 2), ("b", 90), ("b", 7), ("c", 400), ("d", 3)])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = {r.source: (r.target, r.n) for r in mixing.mix_words(docs).join(docs, "doc_id").groupBy("source").agg(
        F.first("target").alias("target"), F.sum("taken").alias("n")).collect()}
    want = _water_level({"a": 3, "b": 97, "c": 400, "d": 3}, {"a": 3, "b": 1, "c": 2, "d": 3}, 1.5 * 503)
    assert {s: t for s, (t, _) in got.items()} == pytest.approx(want)
    assert all(abs(n - t) <= 1 for t, n in got.values())


def test_mixed_documents_come_near_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mix = mixing.mix_documents(docs)
    assert mix.columns == docs.columns
    size = mixing.word_count("text")
    taken = {r.source: r.n for r in mix.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    plan = mixing.mix_words(docs).join(docs.select("doc_id", "source"), "doc_id")
    for r in plan.groupBy("source").agg(F.first("target").alias("t"), F.max("size").alias("largest")).collect():
        assert abs(taken.get(r.source, 0) - r.t) <= r.largest / 2 + 1


def test_mixed_documents_fill_the_budget(spark):
    """One document holds half of all words; the queue is the one of a plain sort."""
    rows = [(i, "w " * (5 + i % 9), f"s{i % 3}") for i in range(300)] + [(999, "w " * 3000, "s1"), (998, None, "s1"), (7, "w w", "s2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    size = mixing.word_count("text")
    mix = mixing.mix_documents(docs)
    total = docs.agg(F.sum(size)).first()[0]
    taken = mix.agg(F.sum(size)).first()[0]
    assert abs(taken - 1.5 * total) <= 3000 / 2 + 1
    queued = mixing.queue_documents(docs, "doc_id", "source", size).collect()
    copies = sorted(
        ((r._end + k * r._source_size - r._size / 2) / r._target, r._group, r._end + k * r._source_size, r._size, r.row.doc_id)
        for r in queued for k in range(2) if r._size
    )
    kept, before = [], 0
    for *_, words, doc in copies:
        if (1.5 * total - before) * 2 < words:
            break
        kept.append(doc)
        before += words
    assert sorted(r.doc_id for r in mix.collect()) == sorted(kept)


def test_mixing_odd_input(odd, nothing):
    got = mixing.mix_words(odd).collect()
    assert len(got) == odd.count() and mixing.mix_words(odd).columns[0] == "doc_id"
    assert [(r.size, r.taken) for r in got if r.doc_id in (3, 4, 5)] == [(0, 0)] * 3
    assert sorted(map(repr, mixing.mix_words(odd.repartition(5)).collect())) == sorted(map(repr, got))
    mix = mixing.mix_documents(odd)
    assert mix.columns == odd.columns and mix.schema == odd.schema
    assert mixing.mix_words(nothing).count() == 0 and mixing.mix_documents(nothing).count() == 0


def test_shards_match_the_mixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    rows = sharding.shard_rows(docs).collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    total = Counter(r.source for r in rows)
    for (shard, source), n in Counter((r.shard, r.source) for r in rows).items():
        assert abs(n - total[source] / 8) <= 2


def test_sharding_odd_input(odd, nothing):
    got = sharding.shard_rows(odd)
    assert got.columns == ["doc_id", "text", "source", "_group", "row", "shard", "slot"]
    rows = got.collect()
    assert len(rows) == odd.count() and Counter(r.shard for r in rows).most_common(1)[0][1] <= 2
    assert sharding.shard_rows(nothing).count() == 0
    assert sharding.shard_rows(odd.limit(1)).select("shard", "slot").first() == (0, 0)


@pytest.mark.parametrize(("wide", "long_rows"), [(256, 1 << 30), (256, 10), (2, 1 << 30)])
def test_shards_equal_a_plain_sort(spark, monkeypatch, wide, long_rows):
    """Whether places are computed, in longs or decimals, or sorted, they are those of one sorted list."""
    monkeypatch.setattr(sharding, "WIDE", wide)
    monkeypatch.setattr(sharding, "LONG_ROWS", long_rows)
    monkeypatch.setattr(sharding, "TEXT_ROWS", 2)
    sizes = {None: 6, "a": 1, "b": 300, "c": 6, "d": 90, "e": 2, "f": 300, "": 3}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id int, source string").repartition(5)
    keyed = docs.withColumn("k", sharding.shuffle_key(F.col("doc_id"), sharding.SEED)).collect()
    places = []
    for source, n in sizes.items():
        mine = sorted((r.k, r.doc_id) for r in keyed if r.source == source)
        places += [((2 * r - 1) / (2 * n), source is None, source or "", doc) for r, (_, doc) in enumerate(mine, 1)]
    want = {doc: (i * 8 // len(rows)) for i, (*_, doc) in enumerate(sorted(places))}
    got = sharding.shard_rows(docs).collect()
    assert {r.doc_id: r.shard for r in got} == want
    starts = {s: min(i for i, (*_, doc) in enumerate(sorted(places)) if want[doc] == s) for s in range(8)}
    assert {r.doc_id: r.slot + starts[r.shard] for r in got} == {doc: i for i, (*_, doc) in enumerate(sorted(places))}


def test_texts_move_once_in_blocks_that_follow_the_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for result in (sharding.shard_rows(docs), mixing.mix_documents(docs)):
        lines = result._jdf.queryExecution().sparkPlan().toString().split("\n")
        assert sum("Window " in line and "_key#" in line for line in lines) == 1
    assert ordering.block_count(10**10, ordering.TEXT_ROWS) * ordering.TEXT_ROWS >= 10**10
    assert ordering.block_count(0, 10) == ordering.block_count(5, 10) == ordering.BLOCKS


def test_places_do_not_depend_on_blocks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = mixing.word_count("text")
    ends = [
        sorted((r["row"].doc_id, r["_end"]) for r in mixing.queue_documents(docs, "doc_id", "source", size, blocks=b).collect())
        for b in (64, 1 << 16)
    ]
    assert ends[0] == ends[1]
