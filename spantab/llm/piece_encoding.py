"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text begins as its characters. All adjacent pairs whose concatenation is a
piece wait on an agenda, best score first and leftmost among equals; the first
is merged, and the pairs that the new symbol makes with its neighbours join the
agenda. What remains is looked up; characters without a piece become bytes.

No merge crosses two characters that stand side by side in no piece. Texts are
therefore cut before white space that follows something else (where the
vocabulary allows it), and each distinct chunk of a task goes through the agenda
once. The short chunks of an Arrow batch work off their agendas side by side, one
merge of every chunk at a time; a long chunk is cut further at such character
pairs and has a heap for its agenda. What a task holds is bounded by its Arrow
batch and ``CACHE`` chunks.

Every new chunk of an Arrow batch is also encoded by the sentencepiece library,
and every text decoded by it; the column ``agrees`` says whether all ids and the
decoded text of a row are the same.

Rules for odd input: null and empty texts have no ids and decode to the empty
text; the white space sign U+2581 in a text counts as a space; rows are encoded
one by one, so ties, repeated rows and empty tables need no rule; very long
texts are cut into segments between chunks; added columns replace ones of the
same name. Vocabularies of another type, without byte pieces, with user-defined
or unused pieces, or with text normalisation are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from sentencepiece import sentencepiece_model_pb2

from spantab.llm.ordering import packed, unpacked

SPACE = "▁"
#: Distinct chunks remembered by a task, and the longest chunk that is remembered.
CACHE = 1 << 19
SHORT = 64
#: Chunks that are looked up together, and new ones that go through their agendas side by side.
TOGETHER, SIDE_BY_SIDE = 1 << 17, 1 << 16
#: Characters of a text that are split into chunks at once.
SEGMENT = 1 << 20
NO_PAIR = 1 << 30
BPE, NORMAL, UNKNOWN, CONTROL, BYTE = 2, 1, 2, 3, 6  # fixed values of the model format


class PieceCoder:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("a merge-type vocabulary with byte pieces is needed")
        if {p.type for p in proto.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (
            rules.add_dummy_prefix and rules.escape_whitespaces
        ) or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only an added space before the text and escaped spaces are supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.cost = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.byte_ids = [0] * 256
        self.surfaces: list[bytes] = []
        self.byte_of: dict[int, int] = {}
        for i, piece in enumerate(proto.pieces):
            surface = b""
            if piece.type == BYTE:
                self.byte_of[i] = int(piece.piece[3:5], 16)
                self.byte_ids[self.byte_of[i]] = i
                surface = bytes([self.byte_of[i]])
            elif piece.type == NORMAL:
                surface = piece.piece.replace(SPACE, " ").encode()
            elif piece.type == UNKNOWN:
                surface = proto.trainer_spec.unk_surface.encode()
            self.surfaces.append(surface)
        self.beside = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self.spaces_open = SPACE in self.ids and not any(pair[1] == SPACE != pair[0] for pair in self.beside)
        self.controls = {i for i, p in enumerate(proto.pieces) if p.type == CONTROL}
        self.openers = {i for p, i in self.ids.items() if p[0] == SPACE}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cache: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.doubted: set[str] = set()
        self._pair_tables()

    def _pair_tables(self) -> None:
        """Symbols of characters, and for pairs of pieces that make a piece their place in score order and that piece."""
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        places = {c: i for i, c in enumerate(sorted(set(self.cost.values())))}
        pairs = sorted(
            (self.ids[piece[:i]] << 32 | self.ids[piece[i:]], places[self.cost[piece]], whole)
            for piece, whole in self.ids.items() for i in range(1, len(piece))
            if piece[:i] in self.ids and piece[i:] in self.ids
        )
        found = np.array(pairs or [(-1, 0, 0)], np.int64)
        self.pair_keys, self.pair_places, self.pair_wholes = found[:, 0].copy(), found[:, 1].copy(), found[:, 2].copy()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in score order (``NO_PAIR`` if none) and piece of pairs of symbols."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_places[at], NO_PAIR), self.pair_wholes[at]

    def merge_side_by_side(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many non-empty chunks, and their numbers: every chunk merges the first pair of its agenda per round."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        symbols = self.symbol_of[points]
        symbols = np.where(symbols < 0, -1 - points.astype(np.int64), symbols)  # no piece: below zero
        owner = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        places, wholes = self._pairs(symbols, np.r_[symbols[1:], -1])
        places[np.r_[owner[1:] != owner[:-1], True]] = NO_PAIR
        while len(owner):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            agenda = places << 32 | np.arange(len(places))  # by score, then from the left
            best = np.minimum.reduceat(agenda, first)
            open_ = best < NO_PAIR << 32
            if not open_.all():
                ended = np.repeat(~open_, np.diff(np.r_[first, len(owner)]))
                done.append((owner[ended], symbols[ended]))
                live = ~ended
                moved = np.cumsum(live) - 1
                owner, symbols, places, wholes = owner[live], symbols[live], places[live], wholes[live]
                best = best[open_]
                at = moved[best & (NO_PAIR - 1)]
            else:
                at = best & (NO_PAIR - 1)
            if not len(at):
                break
            symbols[at] = wholes[at]
            stays = np.ones(len(owner), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))  # one symbol fewer before it per earlier chunk
            owner, symbols, places, wholes = owner[stays], symbols[stays], places[stays], wholes[stays]
            ends = np.r_[owner[1:] != owner[:-1], True]
            touched = np.r_[at, np.maximum(at - 1, 0)]
            left, right = symbols[touched], symbols[np.minimum(touched + 1, len(symbols) - 1)]
            places[touched], wholes[touched] = self._pairs(left, right)
            places[ends] = NO_PAIR
        owners = np.concatenate([o for o, _ in done])
        final = np.concatenate([s for _, s in done])
        order = np.argsort(owners, kind="stable")
        final, owners = final[order], owners[order]
        if final.min() >= 0:
            return final.astype(np.int32), np.bincount(owners, minlength=len(chunks))
        pieces = [[i] if i >= 0 else self._bytes_of(chr(-1 - i)) for i in final.tolist()]
        sizes = np.array([len(p) for p in pieces])
        counts = np.bincount(owners, weights=sizes, minlength=len(chunks)).astype(np.int64)
        return np.fromiter(chain.from_iterable(pieces), np.int32, int(sizes.sum())), counts

    def _bytes_of(self, symbol: str) -> list[int]:
        return [self.byte_ids[b] for b in symbol.encode("utf-8", "replace")]

    def merge(self, symbols: list[str]) -> list[str]:
        """The symbols left after the agenda of adjacent pairs is worked off."""
        cost = self.cost
        agenda = []
        for i in range(len(symbols) - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in cost:
                agenda.append((cost[pair], i, pair))
        if not agenda:
            return symbols
        heapify(agenda)
        last = len(symbols)
        after = list(range(1, last + 1))
        before = list(range(-1, last - 1))
        while agenda:
            _, i, pair = heappop(agenda)
            j = after[i]
            # An empty symbol was taken in by its left neighbour; another length is a pair of the past.
            if not symbols[i] or j >= last or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < last:
                before[k] = i
                right = pair + symbols[k]
                if right in cost:
                    heappush(agenda, (cost[right], i, right))
            h = before[i]
            if h >= 0:
                left = symbols[h] + pair
                if left in cost:
                    heappush(agenda, (cost[left], h, left))
        return [s for s in symbols if s]

    def long_chunk_ids(self, chunk: str) -> list[int]:
        """Ids of one chunk of any length."""
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.beside]
        out = []
        for start, stop in zip([0, *cuts], [*cuts, len(chunk)]):
            for symbol in self.merge(list(chunk[start:stop])):
                known = self.ids.get(symbol)
                out += [known] if known is not None else self._bytes_of(symbol)
        return out

    def chunks(self, text: str) -> Iterator[list[str]]:
        """Escaped chunks of a text, a segment at a time."""
        if not text:
            return
        text = " " + text.replace(SPACE, " ")
        if not self.spaces_open:
            yield [text.replace(" ", SPACE)]
            return
        at = 0
        while at < len(text):
            cut = re.compile(r"(?<=[^ ]) ").search(text, at + SEGMENT)
            stop = cut.start() if cut else len(text)
            part = text[at:stop]
            if "  " in part or part.endswith(" "):
                yield [c.replace(" ", SPACE) for c in re.findall(r" +[^ ]+| +", part)]
            else:
                yield [SPACE + c for c in part[1:].split(" ")]
            at = stop

    def learn(self, chunks: list[str]) -> None:
        """Put new chunks through the agenda, and beside the library; a chunk begins with the added space."""
        for at in range(0, len(chunks), SIDE_BY_SIDE):
            some = chunks[at : at + SIDE_BY_SIDE]
            short, long = [c for c in some if len(c) <= SHORT], [c for c in some if len(c) > SHORT]
            if short:
                self._remember(short, *self.merge_side_by_side(short))
            if long:
                found = [self.long_chunk_ids(c) for c in long]
                counts = np.array([len(f) for f in found])
                self._remember(long, np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts)

    def _remember(self, chunks: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        stops = np.cumsum(counts)
        data, places = flat.tobytes(), [0, *(4 * stops).tolist()]
        self.cache.update((c, data[a:b]) for c, a, b in zip(chunks, places, places[1:]))
        theirs = self.library.encode([c[1:].replace(SPACE, " ") for c in chunks], num_threads=1)
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        if (sizes == counts).all():
            other = np.fromiter(chain.from_iterable(theirs), np.int32, len(flat))
            wrong = np.unique(np.searchsorted(stops, np.flatnonzero(other != flat), side="right")).tolist()
        else:
            wrong = [k for k, t in enumerate(theirs) if np.array(t, np.int32).tobytes() != self.cache[chunks[k]]]
        self.doubted.update(chunks[k] for k in wrong)
        self.doubted.discard(SPACE)  # the library gives an empty text no ids, not even the added space

    def encode(self, texts: Sequence[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids per text, and whether the library agrees on all its chunks."""
        found: list[list[bytes]] = [[] for _ in texts]
        agrees = [True] * len(texts)
        waiting: list[tuple[int, list[str]]] = []

        def flush() -> None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            self.learn(list(set().union(*(listed for _, listed in waiting)).difference(self.cache)))
            for k, listed in waiting:
                found[k].append(b"".join(map(self.cache.__getitem__, listed)))
                agrees[k] &= not self.doubted or self.doubted.isdisjoint(listed)
            for _, listed in waiting:
                for chunk in listed:
                    if len(chunk) > SHORT:
                        self.cache.pop(chunk, None)
            waiting.clear()

        size = 0
        for k, text in enumerate(texts):
            for listed in self.chunks(text):
                waiting.append((k, listed))
                size += len(listed)
                if size > TOGETHER:
                    flush()
                    size = 0
        flush()
        return [np.frombuffer(b"".join(f), np.int32) for f in found], agrees

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; the space before the first word goes, and broken byte runs give U+FFFD per byte."""
        surfaces = list(map(self.surfaces.__getitem__, ids))
        first = next((k for k, surface in enumerate(surfaces) if surface), None)
        if first is not None and ids[first] in self.openers:
            surfaces[first] = surfaces[first][1:]
        if self.controls.isdisjoint(ids):  # a control piece ends a run of bytes
            try:
                return b"".join(surfaces).decode()
            except UnicodeDecodeError:
                pass
        return self._decode_runs(ids, surfaces)

    def _decode_runs(self, ids: Sequence[int], surfaces: list[bytes]) -> str:
        out, at = [], 0
        while at < len(ids):
            stop = at
            while stop < len(ids) and ids[stop] in self.byte_of:
                stop += 1
            if stop == at:
                out.append(surfaces[at].decode())
                at += 1
                continue
            run = b"".join(surfaces[at:stop])
            while run:
                for length in range(1, 5):
                    try:
                        out.append(run[:length].decode())
                        run = run[length:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            at = stop
        return "".join(out)


def read_model(path: str) -> bytes:
    """The vocabulary file, which every task gets with its code."""
    with open(path, "rb") as file:
        return file.read()


def _encoder(model: bytes):
    """A column function from text to its code."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = PieceCoder(model)
        for batch in batches:
            ids, agrees = coder.encode([t or "" for t in batch.to_pylist()])
            decoded = []
            for k, own in enumerate(ids):
                listed = own.tolist()
                decoded.append(coder.decode(listed))
                agrees[k] = agrees[k] and decoded[k] == coder.library.decode(listed)
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.StructArray.from_arrays(
                [listed, pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], ["ids", "decoded", "agrees"]
            )

    return arrow_udf(run, "struct<ids: array<int>, decoded: string, agrees: boolean>")


def encode_documents(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the text ``decoded`` from them, and ``agrees``, whether the library gives the same."""
    found = docs.select(packed(docs)).withColumn("code", _encoder(model)(F.col("row")[text_col]))
    return found.select(*unpacked(found, "ids", "decoded", "agrees"), "code.*")
