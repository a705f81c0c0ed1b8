"""Ranked lexical search through bit-sliced Bloom signatures.

**Index.** Every document gets a Bloom signature of its terms. A term that occurs
``tf`` times enters once for each level up to ``tf`` (1, 2, 3, 4, 6, 8, 12, ...), so
that a signature also tells about how often. Documents with signatures of like
width form blocks, and a block is stored by slices: for every signature bit the
bitmap of the documents that have it.

**Search.** The slices of a term's bits, intersected, overestimate the documents
that hold it, and its levels how often they do. Weighted sums over the terms of
a query give every document an upper bound of its score. The 20 documents of the
best bounds are scored exactly; every document whose bound does not fall behind
the 20th of those scores (equal ones by id) is then read and scored exactly. No
other document can be among the 20 best, so the result is exact.

Queries are searched in parts of about ``PART_BYTES`` of text; the terms of one
part and their weights are what the driver and each task hold. Tasks pass on the
20 best documents of a query. Documents are read for the index, for document
counts, and for the two exact scorings; bounds read the index only.

Rules for odd input: null, empty and wordless texts have no terms, count neither
as documents nor as results, and as queries give no rows; every row is a document
or a query of its own, repeated ids and texts too; equal scores go by ascending
id, null ids last, equal ids in no set order; an empty table of documents or
queries gives no rows; very long texts are read in segments, and a signature
wider than ``MAX_WIDTH`` is folded, which loosens its bounds alone; other columns
are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spantab.llm.ordering import quoted
from spantab.llm.words import ALPHANUMERIC, fold, segments
from spantab.staging import stage

TOP = 20
BITS_PER_KEY = 12
HASHES = 5
MIN_WIDTH, MAX_WIDTH = 64, 1 << 17
#: Documents of a block, and bits of its slices.
BLOCK_DOCS, BLOCK_BITS = 1024, 1 << 24
#: Query text searched at once.
PART_BYTES = 1 << 18
#: Documents whose bounds are taken at once.
BOUND_DOCS = 128
LEVELS = np.array(sorted({1, *(f << e for f in (2, 3) for e in range(40))}), np.int64)
_NO_ID = np.iinfo(np.int64).max

INDEX = "width int, slices binary, ids array<bigint>, sizes array<bigint>"


def _mixed(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Hashes of (term, level) keys."""
    x = hashes ^ (levels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _positions(keys: np.ndarray, width: int) -> np.ndarray:
    """Signature bits of keys, one row per key."""
    low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64)
    return ((low[:, None] + steps * high[:, None]) & np.uint64(width - 1)).astype(np.int64)


def _term_hashes(terms: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def term_counts(text: str | None) -> Counter:
    counts: Counter = Counter()
    for words in segments(fold(text, ALPHANUMERIC)):
        counts.update(words)
    return counts


class _Block:
    """The slices of up to ``BLOCK_DOCS`` documents of one signature width."""

    def __init__(self, width: int):
        self.width = width
        self.room = min(BLOCK_DOCS, BLOCK_BITS // width)
        self.slices = np.zeros((width, self.room // 8), np.uint8)
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc: int | None, size: int, keys: np.ndarray) -> None:
        at = len(self.ids)
        self.slices[_positions(keys, self.width), at >> 3] |= np.uint8(128 >> (at & 7))
        self.ids.append(doc)
        self.sizes.append(size)

    def row(self) -> pa.RecordBatch:
        used = self.slices[:, : (len(self.ids) + 7) // 8].tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([self.width], pa.int32()), pa.array([used], pa.binary()),
             pa.array([self.ids], pa.list_(pa.int64())), pa.array([self.sizes], pa.list_(pa.int64()))],
            [c.split()[0] for c in INDEX.split(", ")],
        )


def _index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_blocks: dict[int, _Block] = {}
    for batch in batches:
        for doc, text in zip(batch.column("id"), batch.column("text")):
            counts = term_counts(text.as_py())
            if not counts:
                continue
            found = np.fromiter(counts.values(), np.int64, len(counts))
            reached = np.searchsorted(LEVELS, found, side="right")
            first = np.cumsum(reached) - reached
            levels = np.arange(int(reached.sum())) - np.repeat(first, reached)
            keys = _mixed(np.repeat(_term_hashes(list(counts)), reached), levels)
            wanted = max(MIN_WIDTH, len(keys) * BITS_PER_KEY)
            width = min(MAX_WIDTH, 1 << (wanted - 1).bit_length())
            block = open_blocks.setdefault(width, _Block(width))
            block.add(doc.as_py(), int(found.sum()), keys)
            if len(block.ids) == block.room:
                yield open_blocks.pop(width).row()
    for block in open_blocks.values():
        yield block.row()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all documents with a term, one row per block, written to the shared folder."""
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    return stage(rows.mapInArrow(_index_blocks, INDEX), "lexical-index")


@dataclass(frozen=True)
class _Part:
    """Some queries, and what scoring them needs: weights by term, document and term totals."""

    queries: list[list[tuple[int, int]]]  # (term, times) per query
    vocabulary: dict[bytes, int]
    weights: list[int]
    n_docs: int
    n_terms: int

    def length_norm(self, size: int) -> int:
        return 100 - 25 + (25 * size * self.n_docs) // self.n_terms


class _Bounds:
    """Upper bounds of the scores of all queries of a part."""

    def __init__(self, part: _Part):
        self.part = part
        self.hashes = _term_hashes(list(part.vocabulary))
        self.weights = np.array(part.weights, np.int64)
        self.filled = [k for k, q in enumerate(part.queries) if q]
        flat = [pair for q in part.queries for pair in q]
        self.terms = np.array([t for t, _ in flat], np.int64)
        self.times = np.array([c for _, c in flat], np.int64)[:, None]
        sizes = [len(part.queries[k]) for k in self.filled]
        self.starts = np.cumsum([0, *sizes[:-1]])

    def _reached(self, slices: np.ndarray, width: int) -> np.ndarray:
        """Per term and document the number of levels that the signature shows."""
        out = np.zeros((len(self.hashes), 8 * slices.shape[1]), np.int8)
        rows = np.arange(len(self.hashes))
        held = np.full((len(rows), slices.shape[1]), 255, np.uint8)
        for level in range(len(LEVELS)):
            bits = _positions(_mixed(self.hashes[rows], np.full(len(rows), level)), width)
            held &= np.bitwise_and.reduce(slices[bits], axis=1)
            some = held.any(axis=1)
            rows, held = rows[some], held[some]
            if not len(rows):
                break
            out[rows] += np.unpackbits(held, axis=1).view(np.int8)
        return out

    def of_block(self, width: int, slices: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bounds of every query with terms (rows) and document (columns)."""
        norms = np.array([self.part.length_norm(int(n)) for n in sizes], np.int64)
        levels = self._reached(slices, width)[:, : len(sizes)]
        term, doc = np.nonzero(levels)
        level = levels[term, doc]
        most = np.where(level < len(LEVELS), LEVELS[np.minimum(level, len(LEVELS) - 1)] - 1, _NO_ID)
        tf = np.minimum(most, sizes[doc])
        gains = np.zeros(levels.shape, np.int64)
        gains[term, doc] = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norms[doc]))
        return np.add.reduceat(gains[self.terms] * self.times, self.starts, axis=0)

    def scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bounds, ids, whether the id is known) of a few documents of the index at a time."""
        for batch in batches:
            for row in range(batch.num_rows):
                width = batch.column("width")[row].as_py()
                packed = np.frombuffer(batch.column("slices")[row].as_buffer(), np.uint8).reshape(width, -1)
                ids = batch.column("ids")[row].values
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(_NO_ID).to_numpy()
                sizes = batch.column("sizes")[row].values.to_numpy()
                for at in range(0, len(ids), BOUND_DOCS):
                    few = slice(at, at + BOUND_DOCS)
                    slices = np.ascontiguousarray(packed[:, at >> 3 : (at + BOUND_DOCS) >> 3])
                    yield self.of_block(width, slices, sizes[few]), ids[few], known[few]


CANDIDATES = "query int, id bigint, bound bigint"


def _candidates(query: np.ndarray, ids: np.ndarray, known: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query.astype(np.int32)), pa.array(ids, pa.int64(), mask=~known), pa.array(bounds, pa.int64())],
        [c.split()[0] for c in CANDIDATES.split(", ")],
    )


def _best_bounds(shared, top: int):
    """Per task and query the ``top`` documents of the best bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _Bounds(shared.value)
        n = len(bounds.filled)
        if not n:
            return
        best = np.zeros((n, top), np.int64)
        best_ids = np.full((n, top), _NO_ID)
        best_known = np.zeros((n, top), bool)
        for found, ids, known in bounds.scan(batches):
            better = np.flatnonzero(found.max(axis=1) >= np.maximum(best[:, -1], 1))
            if not len(better):
                continue
            wide = (len(better), len(ids))
            scores = np.hstack([best[better], found[better]])
            all_ids = np.hstack([best_ids[better], np.broadcast_to(ids, wide)])
            all_known = np.hstack([best_known[better], np.broadcast_to(known, wide)])
            order = np.lexsort((all_ids, -scores), axis=-1)[:, :top]
            best[better] = np.take_along_axis(scores, order, 1)
            best_ids[better] = np.take_along_axis(all_ids, order, 1)
            best_known[better] = np.take_along_axis(all_known, order, 1)
        row, place = np.nonzero(best)
        yield _candidates(np.array(bounds.filled)[row], best_ids[row, place], best_known[row, place], best[row, place])

    return run


def _not_excluded(shared, thresholds):
    """All documents whose bound does not fall behind the threshold (score, id) of the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _Bounds(shared.value)
        if not bounds.filled:
            return
        least = [thresholds.value.get(k, (1, _NO_ID)) for k in bounds.filled]
        score = np.array([s for s, _ in least], np.int64)[:, None]
        last = np.array([i for _, i in least], np.int64)[:, None]
        for found, ids, known in bounds.scan(batches):
            row, place = np.nonzero((found > score) | ((found == score) & (ids <= last)))
            yield _candidates(np.array(bounds.filled)[row], ids[place], known[place], found[row, place])

    return run


SCORES = "query int, id bigint, score bigint"


def _exact_scores(shared, top: int):
    """Per task and query the ``top`` best of the documents that are candidates for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = shared.value
        best: dict[int, list[tuple[int, float, int | None]]] = {}
        for batch in batches:
            for doc, text, queries in zip(*(batch.column(c) for c in ("id", "text", "queries"))):
                doc = doc.as_py()
                counts = term_counts(text.as_py())
                size = sum(counts.values())
                gains = {}
                if size:
                    norm = part.length_norm(size)
                    for term, tf in counts.items():
                        at = part.vocabulary.get(term)
                        if at is not None:
                            gains[at] = part.weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm))
                for query in queries.as_py():
                    score = sum(times * gains.get(term, 0) for term, times in part.queries[query])
                    if score > 0:
                        kept = best.setdefault(query, [])
                        place = (score, -math.inf if doc is None else -doc, doc)
                        if len(kept) < top:
                            heappush(kept, place)
                        elif place[:2] > kept[0][:2]:
                            heappushpop(kept, place)
        rows = [(query, doc, score) for query, kept in best.items() for score, _, doc in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int32(), pa.int64(), pa.int64()))],
            [c.split()[0] for c in SCORES.split(", ")],
        )

    return run


def _term_documents(vocabulary):
    """Documents per term of the vocabulary, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            for text in batch.column("text"):
                seen: set[bytes] = set()
                for words in segments(fold(text.as_py(), ALPHANUMERIC)):
                    seen |= known.keys() & set(words)
                counts[[known[term] for term in seen]] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["term", "n"])

    return run


def _ranked(scores: DataFrame, by: str, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col(by).desc(), F.col("id").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _query_parts(
    queries: DataFrame, id_col: str, text_col: str, part_bytes: int
) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Ids and terms of the queries, about ``part_bytes`` of text at a time."""
    rows = queries.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = math.ceil(total / part_bytes)
    for k in range(parts):
        some = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        yield [(r["id"], fold(r["text"], ALPHANUMERIC).split()) for r in some.toLocalIterator()]


def search(
    docs: DataFrame, queries: DataFrame, index: DataFrame | None = None, id_col: str = "doc_id",
    text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text", top: int = TOP,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(query id, rank, document id, score) of the ``top`` documents of every query.

    ``index`` is what ``build_index`` made of the same documents; it serves any number of query tables.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col) if index is None else index
    sizes = index.select(F.explode("sizes").alias("n")).agg(F.count("n"), F.sum("n")).first()
    texts = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    kind = queries.schema[query_col].dataType.simpleString()
    out = spark.createDataFrame([], f"`{query_col}` {kind}, rank int, `{id_col}` bigint, score bigint")
    for listed in _query_parts(queries, query_col, query_text_col, part_bytes):
        names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(listed)], f"query int, name {kind}")
        found = _search_part(texts, index, [terms for _, terms in listed], sizes[0], sizes[1], top)
        out = out.unionByName(found.join(names, "query").select(
            F.col("name").alias(query_col), "rank", F.col("id").alias(id_col), "score"
        ))
    return out


def _search_part(
    texts: DataFrame, index: DataFrame, queries: list[list[bytes]], n_docs: int, n_terms: int | None, top: int
) -> DataFrame:
    context = texts.sparkSession.sparkContext
    vocabulary = {term: k for k, term in enumerate(sorted(set().union(*queries)))}
    counted = texts.mapInArrow(_term_documents(context.broadcast(vocabulary)), "term bigint, n bigint")
    held_by = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    weights = [
        math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held_by.get(k, 0) + 1))) for k in range(len(vocabulary))
    ]
    # Terms without documents or weight add nothing to any score.
    useful = {term for term, k in vocabulary.items() if held_by.get(k) and weights[k] > 0}
    known = {term: k for k, term in enumerate(sorted(useful))}
    counts = [Counter(known[t] for t in terms if t in known) for terms in queries]
    part = _Part([sorted(c.items()) for c in counts], known, [weights[vocabulary[t]] for t in known], n_docs, n_terms or 1)
    shared = context.broadcast(part)

    def scored(candidates: DataFrame) -> DataFrame:
        wanted = stage(candidates.select("query", "id").distinct(), "lexical-candidates").groupBy("id").agg(
            F.collect_list("query").alias("queries")
        )
        joined = texts.join(wanted.withColumnRenamed("id", "wanted"), F.col("id").eqNullSafe(F.col("wanted")))
        return joined.select("id", "text", "queries").mapInArrow(_exact_scores(shared, top), SCORES)

    seeds = _ranked(index.mapInArrow(_best_bounds(shared, top), CANDIDATES), "bound", top)
    last = _ranked(scored(seeds), "score", top).filter(F.col("rank") == top).collect()
    thresholds = {r["query"]: (r["score"], _NO_ID if r["id"] is None else r["id"]) for r in last}
    left = index.mapInArrow(_not_excluded(shared, context.broadcast(thresholds)), CANDIDATES)
    return _ranked(scored(left), "score", top)
