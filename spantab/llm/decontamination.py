"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Every window of ``n`` consecutive item words goes into a hash set; an item of
fewer words is one window. Documents are scanned with a rolling hash over their
words; each hit is verified word by word. Hit words are marked, and documents
or the hit spans can be removed.

The benchmark is cut into parts of about ``part_bytes`` of text, and a task
holds one part: the hits of every part but the first are written, by digest of
the text, before the next part is broadcast, and meet the documents where the
first one is looked for. A worker makes the hash set of a part once. The
documents are scanned once per part; a usual benchmark is one part.

Rules for odd input: null and empty texts have no words and are clean; a null
item text has no window; an item without an id marks words, but no list of
items names it; repeated items and rows each count as they stand; an empty
benchmark leaves every document clean; very long texts are scanned in segments
that overlap by a window; an item longer than a part is a part of its own.
Added columns replace ones of the same name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spantab.llm.ordering import packed, quoted, unpacked
from spantab.llm.words import ALPHANUMERIC, fold, segments
from spantab.staging import stage

N = 10
#: Benchmark text broadcast at once.
PART_BYTES = 16 << 20
#: Cells of the bit table per window, as a power of two.
CELL_BITS = 6
#: Copies of a text meet its hits under so many keys.
SALTS = 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def _rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    total = hashes[: len(hashes) - length + 1].copy()
    for j in range(1, length):
        total *= MULTIPLIER
        total += hashes[j : len(hashes) - length + 1 + j]
    total *= MULTIPLIER
    return total


class _Windows:
    """Windows of one length: sorted hashes, where each window stands in the words, its items, and a bit table."""

    def __init__(self, words: list[bytes], hashes: np.ndarray, starts: np.ndarray, items: np.ndarray, length: int):
        self.words, self.length = words, length
        rolled = _rolling(hashes, length)[starts]
        order = np.argsort(rolled, kind="stable")
        rolled, starts, self.owners = rolled[order], starts[order], items[order]
        new = np.r_[True, rolled[1:] != rolled[:-1]]
        for i in np.flatnonzero(~new).tolist():
            a, b = int(starts[i]), int(starts[i - 1])
            new[i] = words[a : a + length] != words[b : b + length]
        self.bounds = np.r_[np.flatnonzero(new), len(rolled)].astype(np.int32)
        self.hashes, self.starts = rolled[new], starts[new]
        bits = max(16, math.ceil(math.log2(len(self.hashes))) + CELL_BITS)
        self.shift = np.uint64(64 - bits)
        cells = self.hashes >> self.shift
        self.table = np.zeros(1 << (bits - 3), np.uint8)
        np.bitwise_or.at(self.table, cells >> np.uint64(3), _bit(cells))

    def hits(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Verified hits: the place in ``words`` and the number of the window."""
        rolled = _rolling(hashes, self.length)
        cells = rolled >> self.shift
        places = np.flatnonzero(self.table[cells >> np.uint64(3)] & _bit(cells))
        found = np.searchsorted(self.hashes, rolled[places])
        for place, window in zip(places.tolist(), found.tolist()):
            while window < len(self.hashes) and self.hashes[window] == rolled[place]:
                start = int(self.starts[window])
                if words[place : place + self.length] == self.words[start : start + self.length]:
                    yield place, window
                window += 1

    def items(self, window: int) -> list[int]:
        return self.owners[self.bounds[window] : self.bounds[window + 1]].tolist()


def _bit(cells: np.ndarray) -> np.ndarray:
    return np.uint8(1) << (cells & np.uint64(7)).astype(np.uint8)


class WindowSet:
    """The windows of one benchmark part, by length; about 40 bytes a window beside the words."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.names = [item for item, _ in items]
        words: list[bytes] = []
        known: dict[bytes, bytes] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, text) in enumerate(items):
            at = len(words)
            words.extend(known.setdefault(w, w) for w in fold(text, ALPHANUMERIC).split())
            length = min(n, len(words) - at)
            if length:
                found.setdefault(length, []).append((at, len(words) - length + 1, k))
        hashes = _word_hashes(words)
        self.lengths = {}
        for length, ranges in found.items():
            starts = np.concatenate([np.arange(a, b, dtype=np.int32) for a, b, _ in ranges])
            owners = np.concatenate([np.full(b - a, k, np.int32) for a, b, k in ranges])
            self.lengths[length] = _Windows(words, hashes, starts, owners, length)
        self.longest = max(self.lengths, default=0)

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, merged spans of hit words as rows (start, end), items with an occurring window."""
        seen, spans, hits, kept = 0, [], set(), []
        for new in segments(fold(text, ALPHANUMERIC)):
            base, words = seen - len(kept), kept + new
            hashes = _word_hashes(words)
            for length, windows in self.lengths.items():
                if len(words) >= length:
                    for i, window in windows.hits(words, hashes):
                        hits.add((length, window))
                        spans.append((base + i, base + i + length))
            seen += len(new)
            kept = words[len(words) - self.longest + 1 :] if self.longest > 1 else []
        items = {self.names[k] for length, window in hits for k in self.lengths[length].items(window)} - {None}
        return seen, merged(np.array(sorted(spans), np.int64).reshape(-1, 2)), items


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted spans with overlapping and touching ones made one."""
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.c_[spans[first, 0], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(spans) - 1]]]


SPANS_TYPE = "array<struct<start: bigint, stop: bigint>>"
SCAN_TYPE = f"struct<n_words: bigint, spans: {SPANS_TYPE}, items: array<string>>"
_ARROW_SCAN = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def _scanner(broadcast, n: int):
    """A column function from text to its scan against one broadcast part."""

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        part = broadcast.value
        if n not in part:  # the value stays with the worker, and with it the set that its first task makes
            part[n] = WindowSet(part["items"], n)
        windows = part[n]
        for texts in batches:
            rows = []
            for text in texts:
                words, spans, items = windows.scan(text.as_py())
                rows.append({"n_words": words, "spans": [{"start": a, "stop": b} for a, b in spans.tolist()],
                             "items": sorted(items)})
            yield pa.array(rows, _ARROW_SCAN)

    return arrow_udf(scan, SCAN_TYPE)


def _parts(benchmark: DataFrame, item_col: str, text_col: str, part_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in parts of about ``part_bytes`` of text; only one part is on the driver at a time."""
    items = benchmark.select(
        quoted(item_col).cast("string").alias("item"), quoted(text_col).alias("text")
    ).filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    for k in range(parts):
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        yield [(r.item, r.text) for r in part.toLocalIterator()]


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", n: int = N, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Each document as ``row`` with ``n_words``, merged ``spans`` of hit words (stop exclusive) and sorted ``items``."""
    spark = docs.sparkSession
    found = docs.select(packed(docs))
    text = F.col("row")[text_col]
    first, hits = None, []
    for items in _parts(benchmark, item_col, item_text_col, part_bytes):
        part = spark.sparkContext.broadcast({"items": items})
        scan = _scanner(part, n)
        if first is None:
            first = scan
            continue
        scanned = found.select(_digest(text).alias("digest"), scan(text).alias("scan")).filter(F.size("scan.spans") > 0)
        hits.append(stage(scanned.select("digest", "scan.spans", "scan.items"), "decontamination-hits"))
        part.destroy()
    if not hits:
        return found.select("row", first(text).alias("scan")).select("row", "scan.*")
    # equal texts have equal hits: one row per text and part, then per text
    by_part = [h.groupBy("digest").agg(F.first(F.struct("spans", "items")).alias("hit")) for h in hits]
    others = reduce(DataFrame.unionAll, by_part).groupBy("digest").agg(F.collect_list("hit").alias("hits"))
    salted = others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = found.select(
        "row", _digest(text).alias("digest"), (F.spark_partition_id() % SALTS).alias("salt"), first(text).alias("scan")
    )
    joined = keyed.join(salted, ["digest", "salt"], "left")
    here = F.struct(F.col("scan.spans").alias("spans"), F.col("scan.items").alias("items"))
    every = F.concat(F.array(here), F.coalesce("hits", F.array().cast(joined.schema["hits"].dataType)))
    spans = arrow_udf(_merge_spans, SPANS_TYPE)(F.flatten(F.transform(every, lambda h: h["spans"])))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(every, lambda h: h["items"]))))
    return joined.select("row", F.col("scan.n_words").alias("n_words"), spans.alias("spans"), items.alias("items"))


def _digest(text: Column) -> Column:
    """Never null, so that texts without any words keep out of no join."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _merge_spans(found: pa.Array) -> pa.Array:
    """Spans of several parts as the arrays of one: sorted, overlapping and touching ones made one."""
    rows = []
    for spans in found.to_pylist():
        pairs = np.array(sorted((s["start"], s["stop"]) for s in spans), np.int64).reshape(-1, 2)
        rows.append([{"start": a, "stop": b} for a, b in merged(pairs).tolist()])
    return pa.array(rows, _ARROW_SCAN.field("spans").type)


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", what: str = "documents", **options
) -> DataFrame:
    """``docs`` without contaminated rows, or (``what="spans"``) with the hit words cut out of their texts."""
    found = scan_documents(docs, benchmark, text_col, **options)
    if what == "documents":
        return found.filter(F.size("spans") == 0).select(*unpacked(found))
    if what != "spans":
        raise ValueError(f"what is documents or spans, not {what!r}")
    clean = F.when(F.size("spans") == 0, F.col("row")[text_col]).otherwise(
        arrow_udf(_cut_words, "string")(F.col("row")[text_col], F.col("spans"))
    )
    return found.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def _cut_words(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the words of the spans and what stands between those."""
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text is None or not cuts:
            out.append(text)
            continue
        data, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
        places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(ALPHANUMERIC))]
        for cut in cuts:
            kept.append(data[at : places[cut["start"]][0]])
            at = places[cut["stop"] - 1][1]
        out.append(b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass"))
    return pa.array(out, pa.string())
