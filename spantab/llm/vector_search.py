"""Approximate nearest neighbours by cosine in a hierarchical k-means tree.

The tree is fitted on a bounded sample of unit vectors: each node's rows are
split among ``BRANCHES`` centres until ``leaf_rows`` sample rows or fewer are
left. Every vector is then sent to the leaf that it reaches by nearest
centres. A query walks the tree best bin first: a priority queue holds
branches not yet taken, nearest centre first, and leaves are visited in that
order. How many leaves is calibrated: the true neighbours of some queries,
found by comparison with all vectors, tell for every number of visits which
share of them would be found, and visits widen until the wanted recall is
reached. A query goes on past that until its leaves hold enough candidates.

Leaves are searched as an equi-join on leaf; leaves with many members or many
visiting queries are cut into blocks on either side, so no leaf, however hot,
is one task's.

Rules for odd input: vectors that are null, zero, hold null or non-finite
components, or have another length than most of the sample take no part; of
rows that repeat an id the best score counts, and no row with the query's own
id is its neighbour; ties go to the smaller id; fewer candidates than wanted
give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spantab.llm.ordering import quoted
from spantab.staging import stage

K = 5
RECALL = 0.96
#: Most rows that the tree is fitted on, held on the driver.
SAMPLE_ROWS = 40_000
#: Most queries that calibrate the number of visits.
CALIBRATION_QUERIES = 100
BRANCHES = 12
LEAF_ROWS = 512
ROUNDS = 8
SEED = 5
#: Members, and visiting queries, of one block of a leaf.
BLOCK_ROWS = 4096
#: Scores within this of a place in the ranking are recomputed exactly before ranking.
SLACK = 1e-9
#: Queries compared at once, and pairs scored exactly at once.
QUERY_ROWS = 256
PAIRS = 50_000


@dataclass
class Tree:
    """Children and leaf numbers by node; centres of all children in one matrix."""

    centres: np.ndarray
    #: Per node the range of its children, which are node numbers less one; an empty range at leaves.
    first: np.ndarray
    stop: np.ndarray
    #: Per node its leaf number, or -1.
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def locate(self, units: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches by nearest centres."""
        at = np.zeros(len(units), np.int64)
        while True:
            inner = np.flatnonzero(self.stop[at] > self.first[at])
            if not len(inner):
                return self.leaf[at].astype(np.int32)
            for node in np.unique(at[inner]):
                rows = inner[at[inner] == node]
                a, z = self.first[node], self.stop[node]
                at[rows] = a + np.argmax(units[rows] @ self.centres[a:z].T, axis=1) + 1

    def best_first(self, unit: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first walk."""
        near = -(self.centres @ unit) if len(self.centres) else np.zeros(0)
        queue = [(-2.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.stop[node] > self.first[node]:
                a, z = int(self.first[node]), int(self.stop[node])
                best = a + int(np.argmin(near[a:z]))
                for child in range(a, z):
                    if child != best:
                        heapq.heappush(queue, (float(near[child]), child + 1))
                node = best + 1
            yield int(self.leaf[node])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _means(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Centres of ``rows`` by spherical k-means, at most ``BRANCHES``; each has a row."""
    centres = rows[rng.choice(len(rows), min(BRANCHES, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        kept = np.linalg.norm(sums, axis=1) > 1e-12
        centres = _unit(sums[kept])
    return centres


def fit_tree(rows: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = SEED) -> Tree:
    units, rng = _unit(rows), np.random.default_rng(seed)
    centres: list[np.ndarray] = []
    first, stop, leaf, members, done, leaves = [0], [0], [-1], [np.arange(len(units))], 0, 0
    while done < len(members):
        mine = units[members[done]]
        split = _means(mine, rng) if len(mine) > leaf_rows else mine[:0]
        nearest = np.argmax(mine @ split.T, axis=1) if len(split) > 1 else None
        if nearest is None or len(np.unique(nearest)) < 2:  # few rows, or all alike
            leaf[done] = leaves
            leaves += 1
        else:
            used = np.unique(nearest)
            first[done], stop[done] = len(centres), len(centres) + len(used)
            for c in used:
                centres.append(split[c])
                members.append(members[done][nearest == c])
                first.append(0), stop.append(0), leaf.append(-1)
        done += 1
    return Tree(np.array(centres).reshape(len(centres), units.shape[1]), *map(np.array, (first, stop, leaf)))


def _usable(vector: Column) -> Column:
    def odd(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    clean = vector.isNotNull() & ~F.exists(vector, odd)
    return clean & F.exists(vector, lambda x: x.cast("double") != 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def _locator(tree, schema: T.StructType):
    """Add the leaf to rows of id and vector."""

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Tree(*tree.value)
        for rows in batches:
            if len(rows):
                yield rows.assign(leaf=read.locate(_unit(_matrix(rows["vector"]))))

    return locate, T.StructType([*schema.fields, T.StructField("leaf", T.IntegerType())])


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision, the same for equal pairs wherever they stand."""
    norms = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((queries * queries).sum(axis=1))
    return (rows * queries).sum(axis=1) / norms


def _best(query_ids, queries: np.ndarray, ids, rows: np.ndarray, k: int) -> pd.DataFrame:
    """Per query its k best rows but those of its own id, by exact score, then id."""
    query_ids, (names, code, times) = np.asarray(query_ids), np.unique(
        np.asarray(ids), return_inverse=True, return_counts=True
    )
    units, out = _unit(rows), []
    # rows of one id may repeat, so the k best ids are among so many rows; ties with the last of these all go on
    depth = min(len(rows), k * int(times.max()))
    for at in range(0, len(queries), QUERY_ROWS):
        some, some_ids = queries[at : at + QUERY_ROWS], query_ids[at : at + QUERY_ROWS]
        near = _unit(some) @ units.T
        near[some_ids[:, None] == names[code][None, :]] = -2
        floor = np.maximum(np.partition(near, len(rows) - depth, axis=1)[:, len(rows) - depth] - SLACK, -1.5)
        query, row = np.nonzero(near >= floor[:, None])
        score = np.concatenate(
            [_exact(some[query[i : i + PAIRS]], rows[row[i : i + PAIRS]]) for i in range(0, len(query), PAIRS)]
            or [np.zeros(0)]
        )
        order = np.lexsort((-score, code[row], query))
        order = order[_starts(query[order], code[row[order]])]  # the best row of every id
        order = order[np.lexsort((code[row[order]], -score[order], query[order]))]
        first = np.flatnonzero(_starts(query[order]))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        order = order[place < k]
        out.append(
            pd.DataFrame({"query_id": some_ids[query[order]], "vec_id": names[code[row[order]]], "score": score[order]})
        )
    return pd.concat(out)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    changed = np.zeros(max(0, len(sorted_keys[0]) - 1), bool)
    for key in sorted_keys:
        changed |= key[1:] != key[:-1]
    return np.r_[np.ones(min(1, len(sorted_keys[0])), bool), changed]


def _result_type(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("query_id", id_type), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())]
    )


def _rank(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _true_neighbours(vectors: DataFrame, queries: pd.DataFrame, k: int, id_type: T.DataType) -> DataFrame:
    """Exact neighbours of a few queries, with the leaves that they stand in."""
    sent = vectors.sparkSession.sparkContext.broadcast((queries["id"].tolist(), _matrix(queries["vector"])))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                found = _best(*sent.value, rows["id"].to_numpy(), _matrix(rows["vector"]), k)
                leaves = dict(zip(rows["id"].tolist(), rows["leaf"].tolist()))
                yield found.assign(leaf=[leaves[v] for v in found["vec_id"]])

    kind = T.StructType([*_result_type(id_type).fields, T.StructField("leaf", T.IntegerType())])
    found = vectors.mapInPandas(compare, kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def calibrated_visits(tree: Tree, queries: pd.DataFrame, truth: pd.DataFrame, recall: float) -> int:
    """The fewest leaf visits that find the wanted share of true neighbours."""
    place = {
        i: {leaf: n for n, leaf in enumerate(tree.best_first(u), 1)}
        for i, u in zip(queries["id"], _unit(_matrix(queries["vector"])))
    }
    needed = sorted(place[q][leaf] for q, leaf in zip(truth["query_id"], truth["leaf"]))
    return needed[max(0, math.ceil(recall * len(needed)) - 1)]


def _visitor(tree, visits: int, sizes: np.ndarray, k: int, schema: T.StructType):
    """One row per query and visited leaf."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Tree(*tree.value)
        for rows in batches:
            if not len(rows):
                continue
            taken = []
            for unit in _unit(_matrix(rows["vector"])):
                leaves, held = [], 0
                for leaf in read.best_first(unit):
                    if len(leaves) >= visits and held > k:
                        break
                    leaves.append(leaf)
                    held += int(sizes[leaf])
                taken.append([x for x in leaves if sizes[x]])
            visited = rows.loc[np.repeat(rows.index, list(map(len, taken)))]
            yield visited.assign(leaf=np.concatenate(taken).astype(np.int32))

    return walk, T.StructType([*schema.fields, T.StructField("leaf", T.IntegerType())])


def _by_leaf(df: DataFrame, leaves: int) -> np.ndarray:
    """Rows per leaf; the tree bounds their number."""
    counts = np.zeros(leaves, np.int64)
    for r in df.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        counts[r.leaf] = r.n
    return counts


def nearest(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
    recall: float = RECALL, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, seed: int = SEED,
) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the k nearest vectors found for every query."""
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    empty = spark.createDataFrame([], _result_type(id_type)).withColumn("rank", F.lit(1))

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(quoted(id_col).alias("id"), quoted(vector_col).alias("vector"))
        return rows.filter(F.col("id").isNotNull() & _usable(F.col("vector")))

    def columns(df: DataFrame) -> DataFrame:
        return df.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    rows = usable(vectors)
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample_rows).toPandas()
    if sample.empty:
        return columns(empty)
    size = int(sample["vector"].map(len).mode().iloc[0])
    sample = sample[sample["vector"].map(len) == size]
    fitted = fit_tree(_matrix(sample["vector"]), leaf_rows, seed)
    tree = spark.sparkContext.broadcast((fitted.centres, fitted.first, fitted.stop, fitted.leaf))
    rows = rows.filter(F.size("vector") == size)
    located = stage(rows.mapInPandas(*_locator(tree, rows.schema)), "leaves")
    asked = usable(queries).filter(F.size("vector") == size)
    trial = asked.orderBy(F.xxhash64("id", F.lit(seed + 1))).limit(CALIBRATION_QUERIES).toPandas()
    if trial.empty:
        return columns(empty)
    trial = trial.drop_duplicates("id")
    truth = _true_neighbours(located, trial, k, id_type).select("query_id", "leaf").toPandas()
    visits = calibrated_visits(fitted, trial, truth, recall) if len(truth) else fitted.leaves
    held = _by_leaf(located, fitted.leaves)
    visiting = stage(asked.mapInPandas(*_visitor(tree, visits, held, k, asked.schema)), "visits")
    calls = _by_leaf(visiting, fitted.leaves)

    def blocks(counts: np.ndarray) -> Column:
        per_leaf = np.maximum(1, -(-counts // BLOCK_ROWS)).tolist()
        return F.element_at(F.array(*[F.lit(n) for n in per_leaf]), F.col("leaf") + 1)

    def blocked(df: DataFrame, own: str, own_blocks: Column, other: str, other_blocks: Column) -> DataFrame:
        """Each row in one block of its own side, beside every block of the other."""
        mine = F.pmod(F.xxhash64("id", "vector"), own_blocks).cast("int")
        others = F.explode(F.sequence(F.lit(0), (other_blocks - 1).cast("int")))
        return df.withColumn(own, mine).withColumn(other, others)

    members = blocked(located, "member_block", blocks(held), "query_block", blocks(calls))
    callers = blocked(visiting, "query_block", blocks(calls), "member_block", blocks(held))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _best(right["id"].to_numpy(), _matrix(right["vector"]), left["id"].to_numpy(), _matrix(left["vector"]), k)

    keys = ("leaf", "member_block", "query_block")
    found = members.groupBy(*keys).cogroup(callers.groupBy(*keys)).applyInPandas(search, _result_type(id_type))
    return columns(_rank(found, k))
