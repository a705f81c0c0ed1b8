"""Lexical search, piece encoding and the filter audit beside brute force and their library."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from spantab.llm import filter_audit, lexical_search, piece_encoding
from spantab.llm.words import ALPHANUMERIC, fold
from tests.llm.conftest import LONG

MODEL = piece_encoding.read_model(public_tokenizers.path("piece_bpe_32k.model"))


# Lexical search


def ranked_by_hand(docs, items, top):
    counts = [(doc, Counter(fold(text, ALPHANUMERIC).split())) for doc, text in docs]
    counts = [(doc, c) for doc, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(term for _, c in counts for term in c)
    out = []
    for item, text in items:
        wanted = Counter(fold(text, ALPHANUMERIC).split())
        found = []
        for doc, c in counts:
            norm = 75 + (25 * sum(c.values()) * n_docs) // total
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 12 * norm))
                for t, times in wanted.items() if t in c
            )
            if score:
                found.append((-score, math.inf if doc is None else doc, doc))
        out += [(item, k, doc, -s) for k, (s, _, doc) in enumerate(sorted(found, key=lambda f: f[:2])[:top], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, query int, rank int").repartition(3)
    items = spark.createDataFrame(items, "item_id string, text string, id int")
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **options).collect()), key=repr)


def zipf_text(rng, n):
    return " ".join(f"w{min(int(rng.paretovariate(0.6)), 900)}" for _ in range(n))


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    docs = [(i, zipf_text(rng, rng.choice([1, 5, 40, 300, 2500]))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(60)] + [(None, docs[9][1]), (9, docs[9][1]), (9, docs[8][1])]
    items = [(f"q{i}", zipf_text(rng, rng.choice([1, 3, 12, 60]))) for i in range(25)]
    items += [("copy", docs[7][1]), ("twice", "w3 w3 W3 w77"), ("none", "nowhere"), ("empty", ""), ("null", None)]
    want = ranked_by_hand(docs, [i for i in items if i[1]], 20)
    rows, queries = [(*d, 1, 1) for d in docs], [(*i, 1) for i in items]
    assert searched(spark, rows, queries) == want
    assert searched(spark, rows, queries, part_bytes=400) == want  # several parts
    assert searched(spark, rows, queries, top=3) == ranked_by_hand(docs, [i for i in items if i[1]], 3)


def test_folded_signatures_stay_exact(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, zipf_text(rng, 200)) for i in range(120)]
    items = [(f"q{i}", zipf_text(rng, 20)) for i in range(5)]
    monkeypatch.setattr(lexical_search, "MAX_WIDTH", 128)
    assert searched(spark, [(*d, 1, 1) for d in docs], [(*i, 1) for i in items]) == ranked_by_hand(docs, items, 20)


def test_bounds_are_bounds_and_exclude():
    rng = random.Random(7)
    texts = [zipf_text(rng, rng.choice([30, 300])) for _ in range(200)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": list(range(200)), "text": texts})
    counts = [lexical_search.term_counts(t) for t in texts]
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*counts)))}
    queries = [sorted((vocabulary[t], n) for t, n in lexical_search.term_counts(zipf_text(rng, 9)).items() if t in vocabulary)
               for _ in range(10)]
    part = lexical_search._Part(queries, vocabulary, [1000] * len(vocabulary), 200, sum(map(len, counts)) * 2)
    exact = np.zeros((10, 200), np.int64)
    for d, c in enumerate(counts):
        size = sum(c.values())
        for q, terms in enumerate(queries):
            for term, n in terms:
                tf = next((v for k, v in c.items() if vocabulary[k] == term), 0)
                exact[q, d] += n * 1000 * ((10**9 * tf) // (1000 * tf + 12 * part.length_norm(size)))
    close = 0
    for found, ids, _ in lexical_search._Bounds(part).scan(lexical_search._index_blocks(iter([batch]))):
        assert (found >= exact[:, ids]).all()
        close += int((found <= 2 * exact[:, ids]).sum())
    assert close > 0.9 * exact.size


def test_search_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "WöRDS"), (1, "WöRDS"), (None, "word5")], "item_id int, text string")
    found = lexical_search.search(odd, items).collect()
    assert [(r.rank, r.doc_id) for r in found if r.item_id == 1 and r.rank == 1] == [(1, 8), (1, 8)]
    assert [(r.rank, r.doc_id) for r in found if r.item_id is None] == [(1, 7)]
    assert lexical_search.search(nothing, items).count() == 0
    assert lexical_search.search(odd, items.limit(0)).count() == 0


# Piece encoding


@pytest.fixture(scope="module")
def coder():
    return piece_encoding.PieceCoder(MODEL)


def test_random_texts_equal_the_library(coder):
    rng = random.Random(8)
    letters = " \n\t▁abethinTh1 .éß漢😀\x00  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in range(3000)]
    texts += ["", " ", "  ", "▁", "a ", " a", "a" * 300, "x" * 200 + " " * 70 + "hello" * 50, "漢" * 500]
    ids, agrees = coder.encode(texts)
    ids = [i.tolist() for i in ids]
    assert ids == coder.library.encode(texts) and all(agrees)
    assert [coder.decode(i) for i in ids] == [coder.library.decode(i) for i in ids]


def test_agendas_side_by_side_equal_the_heap(coder):
    rng = random.Random(9)
    chunks = ["▁" + "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    ids, counts = coder.merge_side_by_side(chunks)
    assert [i.tolist() for i in np.split(ids, np.cumsum(counts)[:-1])] == [coder.long_chunk_ids(c) for c in chunks]


def test_decoding_any_ids_equals_the_library(coder):
    rng = random.Random(10)
    for _ in range(5000):
        kinds = [rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 29871]
        ids = [rng.choice(kinds) for _ in range(rng.randrange(8))]
        assert coder.decode(ids) == coder.library.decode(ids), ids


def test_segments_do_not_change_ids(coder, monkeypatch):
    text = "some words  and\nmore   of them " * 50
    monkeypatch.setattr(piece_encoding, "SEGMENT", 37)
    monkeypatch.setattr(piece_encoding, "CACHE", 11)
    monkeypatch.setattr(piece_encoding, "TOGETHER", 5)
    own = piece_encoding.PieceCoder(MODEL)
    assert [i.tolist() for i in own.encode([text, text[:100]])[0]] == own.library.encode([text, text[:100]])


def test_wrong_chunks_are_doubted():
    own = piece_encoding.PieceCoder(MODEL)
    own.byte_ids[10] += 1
    assert own.encode(["a b", "a\n", "c " * 9 + "a\n d"])[1] == [True, False, False]


def test_unsuited_vocabularies_are_refused():
    with pytest.raises(ValueError):
        piece_encoding.PieceCoder(b"")


def test_encoding_odd_rows(spark, odd, nothing):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    rows = piece_encoding.encode_documents(odd, MODEL).collect()
    assert len(rows) == odd.count() and all(r.agrees for r in rows)
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "")
    assert any(r.text == LONG for r in rows)
    assert piece_encoding.encode_documents(nothing, MODEL).columns == [*odd.columns, "ids", "decoded", "agrees"]
    assert piece_encoding.encode_documents(nothing, MODEL).count() == 0


# Filter audit


def audited_by_hand(docs, labels):
    def fails(doc, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        capitals = len(re.findall("[A-Z]", text))
        return {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * capitals > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs),
        }

    rows = {}
    for part in {p or "" for _, _, p in docs}:
        own = [(d, fails(d, t or "")) for d, t, p in docs if (p or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if x[1][name]]
                left = [x for x in left if not x[1][name]]
                shapley[name] += len(gone)
                lost = [sum(any(i == d and d is not None and row[k] == 1 for i, *row in labels) for d, _ in gone) for k in (0, 1)]
                rows[part, order, step] = [
                    len(left), len(gone), sum(x[1][name] for x in own) - len(gone),
                    sum(x[1][name] and sum(x[1].values()) == 1 for x in own), *lost, name,
                ]
        for key in rows:
            if key[0] == part:
                rows[key][-1] = shapley[rows[key][-1]]
    return rows


AUDITED = "doc_id bigint, text string, lang string, mask int, digest string"


def test_audit_equals_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(rng.choice(["Aa", "b", "C#", "dD", f"w{rng.randrange(300)}"]) for _ in range(rng.choice([20, 99, 100, 150])))
            for _ in range(25)] + ["", None, "ABC", "$", " ".join(f"u{i}" for i in range(120))]
    docs = [(rng.choice([None, rng.randrange(60)]), rng.choice(pool), rng.choice(["de", "en", "", None])) for _ in range(150)]
    docs += [(5, pool[0], "de"), (5, pool[0], "de"), (4, pool[0], "en")]
    labels = [(rng.choice([None, rng.randrange(80)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], AUDITED)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in filter_audit.audit_filters(frame, marks).collect()}
    assert got == audited_by_hand(docs, labels)


def test_gray_states_equal_direct_counts():
    cells = np.random.default_rng(12).integers(0, 9, (3, 32, 2))
    states = filter_audit.gray_states(cells)
    for subset in range(32):
        alive = [m for m in range(32) if not m & subset]
        assert (states[:, subset] == cells[:, alive].sum(axis=1)).all()


def test_audit_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = filter_audit.audit_filters(odd, labels, part_col="source").collect()
    assert len(rows) == 600 * 4 and {r.part for r in rows} == {"", "a", "b", "c"}
    first = {r.part: r for r in rows if r.filter_order == "EABCD" and r.step == 1}
    assert first["a"].removed == 2 and first["a"].kept == 1  # both rows of id 2 copy id 1
    assert first["b"].removed == 1  # the empty text of id 4 equals the null text of id 3
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_filters(nothing, empty, part_col="source").count() == 0
