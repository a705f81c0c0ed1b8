"""SimHash near-duplicates through a Gray-order hierarchical index.

A text's fingerprint has a bit set where over half of its shingle hashes have
it set. Two fingerprints link at ``max_bits`` or fewer differing bits; linked
texts form components.

The index is a forest of masked bit patterns. The 64 bits are cut into
``max_bits + 1`` bands; fingerprints within the limit agree on one band at
least, so the upper nodes are the patterns under each band's mask, and only
fingerprints under one node are compared. A node with too many members gets
child nodes in the same way from the bits it leaves open. Members of a node
stand in Gray order, in blocks that share further bits: the fixed bits of a
block are its mask and pattern, and two blocks (or two leaves of one block)
whose patterns differ in more than ``max_bits`` commonly fixed bits are pruned
whole. Blocks spread over all tasks, so no node, however large, is one task's.

Within blocks only a spanning forest of the links is passed on, which keeps
every connection and grows with the members, not their pairs. Components come
from alternating large-star and small-star steps, each written to the shared
folder.

Rules for odd input: null and empty texts have fingerprint zero, linked like
any other; repeated rows share a component; null ids count in no minimum; an
empty table gives no rows; other columns pass through (``fingerprint`` and
``component_id`` replace ones of these names).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spantab.llm.ordering import packed, quoted, unpacked
from spantab.llm.words import UNSPACED, fold, segments
from spantab.staging import stage

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
#: Members above which a node gets children, and how deep that goes; beyond, blocks alone prune.
NODE_MEMBERS = 16_384
LEVELS = 3
#: Fingerprints of one block, and of one leaf in it.
BLOCK = 1024
LEAF = 16
_ALL_BITS = (1 << 64) - 1


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text as a signed 64-bit number."""
    counts, total, kept = np.zeros(64, np.int64), 0, []
    for new in segments(fold(text, UNSPACED)):
        words = kept + new
        if len(words) >= shingle_words:
            sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
            ends = np.cumsum(sizes)
            starts = (ends - sizes)[: len(words) - shingle_words + 1].tolist()
            joined, hashed = b" ".join(words), xxhash.xxh64_digest
            digests = b"".join(
                [hashed(joined[a:b], HASH_SEED) for a, b in zip(starts, (ends[shingle_words - 1 :] - 1).tolist())]
            )
            rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
            counts += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
            total += len(rows)
        kept = words[-(shingle_words - 1) :] if shingle_words > 1 else []
    if not total and kept:
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(kept), HASH_SEED), "big", signed=True)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def fingerprints(shingle_words: int = SHINGLE_WORDS):
    """A column function from text to its fingerprint."""

    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py(), shingle_words) for t in texts], pa.int64())

    return arrow_udf(hashed, "bigint")


def gray_rank(code: Column) -> Column:
    """The place of a code in the binary-reflected Gray sequence, as a signed number in that order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def child_masks(mask: int, parts: int) -> list[int]:
    """``mask`` widened by each of ``parts`` near-equal runs of the bits it leaves open."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _members(codes: DataFrame, max_bits: int, node_members: int) -> DataFrame:
    """Rows (node, pattern, code): every code under each node that it belongs to."""
    parts = max_bits + 1
    masks = child_masks(0, parts)
    done, open_rows = [], codes.select("code", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("node"))
    first_node = 0
    for level in range(LEVELS):
        mask = F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("node") - first_node + 1)
        open_rows = open_rows.withColumn("pattern", F.col("code").bitwiseAND(mask))
        if level == LEVELS - 1:
            done.append(open_rows)
            break
        sizes = open_rows.groupBy("node", "pattern").agg(F.count("*").alias("n"))
        large = stage(sizes.filter(F.col("n") > node_members).select("node", "pattern"), "large-nodes")
        if large.isEmpty():
            done.append(open_rows)
            break
        done.append(open_rows.join(large, ["node", "pattern"], "left_anti"))
        split = open_rows.join(large, ["node", "pattern"], "left_semi")
        next_first = first_node + len(masks)
        child = (F.col("node") - first_node) * parts + next_first
        open_rows = split.select(
            "code", F.explode(F.sequence(child, child + parts - 1).cast("array<int>")).alias("node")
        )
        masks, first_node = [c for m in masks for c in child_masks(m, parts)], next_first
    return reduce(DataFrame.unionByName, [d.select("node", "pattern", "code") for d in done])


def _fixed(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per run of codes the bits they all share, as masks and patterns."""
    ones, any_one = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    return ~(ones ^ any_one), ones


def _near(left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of left's codes are within the limit of which of right's, leaves pruned by their fixed bits first."""
    if len(left) * len(right) <= 4 * LEAF * LEAF:
        return np.bitwise_count(left[:, None] ^ right[None, :]) <= max_bits
    near = np.zeros((len(left), len(right)), bool)
    a, b = np.arange(0, len(left), LEAF), np.arange(0, len(right), LEAF)
    (mask_a, fixed_a), (mask_b, fixed_b) = _fixed(left, a), _fixed(right, b)
    apart = (fixed_a[:, None] ^ fixed_b[None, :]) & mask_a[:, None] & mask_b[None, :]
    for i, j in np.argwhere(np.bitwise_count(apart) <= max_bits).tolist():
        x, y = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
        near[x, y] = np.bitwise_count(left[x, None] ^ right[None, y]) <= max_bits
    return near


def _forest(near: np.ndarray, left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning star of every component of the links: (member, its root)."""
    if right is None:
        if not (near.sum(axis=1) > 1).any():
            return []
        codes, linked = left, near
    else:
        rows, cols = near.any(axis=1), near.any(axis=0)
        if not rows.any():
            return []
        codes = np.r_[left[rows], right[cols]]
        n = int(rows.sum())
        linked = np.eye(len(codes), dtype=bool)
        linked[:n, n:] = near[np.ix_(rows, cols)]
        linked[n:, :n] = linked[:n, n:].T
    label = np.arange(len(codes))
    while True:
        least = np.where(linked, label[None, :], len(codes)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    return [(int(codes[i]), int(codes[r])) for i, r in enumerate(label.tolist()) if i != r]


_BLOCK_TYPE = "node int, pattern bigint, low bigint, mask bigint, fixed bigint, codes array<bigint>, a bigint, b bigint"
_ARROW_BLOCK = pa.schema(
    [("node", pa.int32()), *[(c, pa.int64()) for c in ("pattern", "low", "mask", "fixed")],
     ("codes", pa.list_(pa.int64())), ("a", pa.int64()), ("b", pa.int64())]
)


def _block_maker(max_bits: int):
    """Cut sorted members into blocks; link inside each, and pass on blocks of nodes that go on elsewhere."""

    def rows_of(node, pattern, codes, whole):
        out = []
        for at in range(0, len(codes), BLOCK):
            part = codes[at : at + BLOCK]
            bits = part.view(np.uint64)
            if len(part) > 1:
                links = _forest(_near(bits, bits, max_bits), part)
                out += [{"a": a, "b": b} for a, b in links]
            if not (whole and len(codes) <= BLOCK):
                mask, fixed = (x.view(np.int64).item() for x in _fixed(bits, np.array([0])))
                out.append({"node": node, "pattern": pattern, "low": part[0].item(), "mask": mask, "fixed": fixed,
                            "codes": part.tolist()})
        return out

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # runs of one node; the first and the last of a partition may go on in another
        held, first, out = None, True, []
        for batch in batches:
            node, pattern, code = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "pattern", "code"))
            if not len(code):
                continue
            cuts = np.flatnonzero((node[1:] != node[:-1]) | (pattern[1:] != pattern[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)]):
                key = (node[a].item(), pattern[a].item())
                if held and held[0] == key:
                    held[1].append(code[a:z])
                    if sum(map(len, held[1])) > 64 * BLOCK:  # a node of any size passes in bounded memory
                        out += rows_of(*key, np.concatenate(held[1]), False)
                        held, first = (key, []), True
                    continue
                if held:
                    if held[1]:
                        out += rows_of(*held[0], np.concatenate(held[1]), not first)
                    first = False
                held = (key, [code[a:z]])
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, _ARROW_BLOCK)
                out = []
        if held and held[1]:
            out += rows_of(*held[0], np.concatenate(held[1]), False)
        yield pa.RecordBatch.from_pylist(out, _ARROW_BLOCK)

    return blocks


def _pair_linker(max_bits: int):
    """Links between the two blocks of each row."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column("codes"), batch.column("others")):
                left, right = (np.array(v.as_py(), np.int64) for v in (x, y))
                near = _near(left.view(np.uint64), right.view(np.uint64), max_bits)
                out += [{"a": a, "b": b} for a, b in _forest(near, left, right)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return link


def link_codes(codes: DataFrame, max_bits: int = MAX_BITS, node_members: int = NODE_MEMBERS) -> DataFrame:
    """Links (a, b) that connect all distinct ``code`` values within ``max_bits`` of each other."""
    members = _members(codes.select("code"), max_bits, node_members)
    ordered = members.withColumn("rank", gray_rank(F.col("code")))
    ordered = ordered.repartitionByRange("node", "pattern", "rank").sortWithinPartitions("node", "pattern", "rank")
    made = stage(
        ordered.select("node", "pattern", "code").mapInArrow(_block_maker(max_bits), _BLOCK_TYPE), "gray-blocks"
    )
    blocks = made.filter("codes is not null").drop("a", "b")
    other = blocks.select(
        "node", "pattern", F.col("low").alias("low2"), F.col("mask").alias("mask2"), F.col("fixed").alias("fixed2"),
        F.col("codes").alias("others"),
    )
    differing = F.bit_count(F.expr("(fixed ^ fixed2) & mask & mask2"))
    pairs = blocks.join(other, ["node", "pattern"]).filter((F.col("low") < F.col("low2")) & (differing <= max_bits))
    across = pairs.select("codes", "others").mapInArrow(_pair_linker(max_bits), "a bigint, b bigint")
    return made.filter("a is not null").select("a", "b").unionByName(across)


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every linked node but the roots; the root is the smallest node of its component."""
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo")
    edges, before = stage(edges.distinct(), "links"), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now
        # large star: the larger neighbours of a node move to its smallest neighbour
        least = edges.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("least"))
        large = edges.join(least, "lo", "left").select("hi", F.coalesce("least", "lo").alias("lo")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of these
        smallest = large.groupBy("hi").agg(F.min("lo").alias("least"))
        moved = large.join(smallest, "hi").filter("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        small = moved.unionByName(smallest.select("hi", F.col("least").alias("lo"))).distinct()
        edges = stage(small, "links")


def fingerprint_hex(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def link_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS, node_members: int = NODE_MEMBERS,
) -> DataFrame:
    """Narrow rows ``id, text_hash, code, root, component_id``, one per document."""
    text = quoted(text_col)
    narrow = docs.select(
        quoted(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), fingerprints(shingle_words)(text).alias("code")
    )
    narrow = stage(narrow, "fingerprints")
    codes = stage(narrow.groupBy("code").agg(F.min("id").alias("least_id")), "codes")
    stars = components(link_codes(codes, max_bits, node_members))
    rooted = codes.join(stars.withColumnRenamed("node", "code"), "code", "left").withColumn(
        "root", F.coalesce("root", "code")
    )
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("code", "root", "component_id")
    return narrow.join(named, "code")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document its id, ``fingerprint`` and ``component_id``."""
    linked = link_documents(docs, id_col, text_col, **options)
    return linked.select(F.col("id").alias(id_col), fingerprint_hex(F.col("code")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every component: the smallest id, then the smallest text hash."""
    linked = stage(link_documents(docs, id_col, text_col, **options), "components")
    # the root, a fingerprint, names the component; ids may be null or stand for several texts
    kept = linked.groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "text_hash")).alias("first")
    )
    first = F.col("first")
    kept = kept.select(*_identity(first["id"], first["text_hash"])).distinct()
    keyed = docs.select(packed(docs), *_identity(quoted(id_col), F.xxhash64(quoted(text_col))))
    # join and window deal out by the same columns, so texts move once
    matched = keyed.join(kept, list(_IDENTITY), "left_semi")
    once = Window.partitionBy(*_IDENTITY).orderBy(F.xxhash64("row"))
    single = matched.withColumn("copy", F.row_number().over(once)).filter("copy = 1")
    return single.select(*unpacked(single))


_IDENTITY = ("null_id", "kept_id", "kept_hash")


def _identity(id_col: Column, text_hash: Column) -> list[Column]:
    """Never-null columns that tell a document by its id and text."""
    spelled = F.coalesce(id_col.cast("string"), F.lit(""))
    return [c.alias(n) for c, n in zip((id_col.isNull(), spelled, text_hash), _IDENTITY, strict=True)]
