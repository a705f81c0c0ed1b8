"""Toxicity by compression distance.

Two zstandard dictionaries share a base of common words. One goes on with
markers of toxic training texts, the other with markers of ordinary ones:
words and word beginnings that are far more frequent in one class, however rare. Every
window of a text is compressed with both. A window that is shorter under the
toxic dictionary holds something toxic; the bytes saved over all windows of a
text, through a logistic calibration with a fitted threshold, give a score
from 0 to 1 that is 0.5 at the threshold.

Only texts and, for training rows, their toxic labels are used. Both the word
statistics and the calibration come from at most ``FIT_ROWS`` labelled rows,
chosen by a hash; every text is scored whole.

Rules for odd input: null and empty texts have no window and are scored as
such; rows without an id are never training rows; of several labels of one id
any toxic one counts, of several texts the least one; without both classes in training every score is 0 (1 if
only toxic rows are known); repeated rows get equal scores; other columns pass
through (``score`` and ``predicted`` replace ones of these names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spantab.llm.ordering import packed, quoted, unpacked
from spantab.llm.words import LETTERS, segments
from spantab.staging import stage

WINDOW_WORDS = 4
#: Most labelled rows that the model is fitted on.
FIT_ROWS = 40_000
#: Words common to both dictionaries, and most markers of a class.
BASE_WORDS = 2000
MARKERS = 300
#: Lengths of word beginnings that may be markers, beside whole words.
STEMS = (4, 5, 6)
#: Letters of the shortest whole word that may be a marker; with its spaces a shorter one is no match.
WORD_LETTERS = 3
#: A marker is this many times as frequent in its class, by so many standard deviations, in so many texts.
MARKER_LIFT = 3.0
MARKER_DEVIATIONS = 6.0
MARKER_TEXTS = 3
#: Training texts of one label with the same smallest hashes of so many consecutive words, in each of the orders
#: that these masks give, count as copies, of which one is learned from.
COPY_WORDS = 4
COPY_MASKS = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D)
#: The weight of recall against precision where the threshold is fitted.
RECALL_WEIGHT = 1.0
LEVELS = (2, 3, 4, 5, 6)
#: Opens every window and both dictionaries: with one sure match each window is compressed, never stored.
OPENING = b"#0123456789" * 8 + b"@"


def _compressor(common: Sequence[str], markers: Sequence[str]) -> zstandard.ZstdCompressor:
    """A compressor whose dictionary ends with the markers, the first ones nearest to the text."""
    content = OPENING + " ".join(["", *reversed(common), *reversed(markers), ""]).encode()
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
        window_log=17, hash_log=16, chain_log=16, search_log=5, min_match=5, target_length=32,
        strategy=zstandard.STRATEGY_GREEDY,
    )
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


def windows(text: str | None) -> Iterator[bytes]:
    folded = (text or "").lower().encode("utf-8", "surrogatepass").translate(LETTERS)
    for words in segments(folded):
        for i in range(0, len(words), WINDOW_WORDS):
            yield OPENING + b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" "


def features(saved: np.ndarray) -> list[float]:
    """What the bytes saved per window say of a text."""
    if not len(saved):
        return [0.0] * (3 + 2 * len(LEVELS) + 1)
    top = np.sort(saved)[::-1]
    above = [(saved >= k).sum() for k in LEVELS]
    return [
        float(saved.mean()), float(top[0]), float(top[:3].mean()), *[float(n / len(saved)) for n in above],
        *[math.log1p(n) for n in above], math.log(len(saved)),
    ]


@dataclass(frozen=True)
class ToxicityModel:
    common: tuple[str, ...]
    ordinary: tuple[str, ...]
    toxic: tuple[str, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float


def _feature_column(common: Sequence[str], ordinary: Sequence[str], toxic: Sequence[str]):
    """A column function from text to its features."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        plain, marked = _compressor(common, ordinary), _compressor(common, toxic)
        for texts in batches:
            rows = []
            for text in texts:
                saved = [len(plain.compress(w)) - len(marked.compress(w)) for w in windows(text.as_py())]
                rows.append(features(np.array(saved, np.int64)))
            yield pa.array(rows, pa.list_(pa.float64()))

    return arrow_udf(run, "array<double>")


def _copy_key(text: Column) -> Column:
    """The smallest hashes of a text's word runs in several orders: copies mostly share all, other texts hardly ever."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))

    def hashes(ws: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - COPY_WORDS + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, COPY_WORDS)))

    def least(found: Column) -> Column:
        return F.array(*[F.array_min(F.transform(found, lambda h, m=m: h.bitwiseXOR(F.lit(m)))) for m in COPY_MASKS])

    # the words and hashes as bound variables: an expression would be evaluated again for every run
    return F.transform(F.transform(F.array(words), hashes), least)[0]


def _units(text: Column) -> Column:
    """Distinct words (with a space at the end) and word beginnings of a text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{" + str(WORD_LETTERS) + r",}"), F.lit(0))
    spelled = F.transform(
        F.array_distinct(words),
        lambda w: F.array(F.concat(w, F.lit(" ")), *[F.when(F.char_length(w) > k, F.substring(w, 1, k)) for k in STEMS]),
    )
    return F.array_distinct(F.array_compact(F.flatten(spelled)))


def _alike(a: str, b: str) -> bool:
    """Whether one unit begins like the other; a word too short to be a beginning is like no other."""
    a, b = sorted((a.strip(), b.strip()), key=len)
    return a == b or (len(a) >= STEMS[0] and b.startswith(a))


def _markers(counts: DataFrame, own: str, other: str, n_own: int, n_other: int, most: int) -> list[str]:
    """Units far more frequent in texts of one class, the strongest first; none begins like a stronger one."""
    share = (F.col(own) + F.col(other)) / (n_own + n_other)
    deviation = F.sqrt(share * (1 - share) * n_own * n_other / (n_own + n_other))
    score = F.try_divide(F.col(own) - share * n_own, deviation)
    lift = F.col(own) / n_own >= MARKER_LIFT * F.col(other) / n_other
    strong = counts.filter(lift & (F.col(own) >= MARKER_TEXTS)).withColumn("score", score)
    strong = strong.filter(F.col("score") >= MARKER_DEVIATIONS)
    # a whole word and its beginnings may all be strong: equal scores go to the longest
    ranked = strong.orderBy(F.desc("score"), F.desc(F.char_length("unit")), "unit")
    chosen: list[str] = []
    for unit in (r.unit for r in ranked.select("unit").toLocalIterator()):
        if len(chosen) == most:
            break
        if not any(_alike(unit, c) for c in chosen):
            chosen.append(unit)
    return [c.strip() + " " * c.endswith(" ") for c in chosen]


def _holds(word: str, marker: str) -> bool:
    """Whether a common word would take the place of a marker; a short marker is matched with its spaces only."""
    return marker in word if len(marker) >= STEMS[0] else marker == word.strip()


def _dictionaries(
    counts: DataFrame, n_plain: int, n_toxic: int, base_words: int, markers: int
) -> tuple[list[str], list[str], list[str]]:
    """Common words, markers of ordinary and of toxic texts, from the texts of each class that hold a unit."""
    marked = _markers(counts, "toxic", "plain", n_toxic, n_plain, markers)
    ordinary = _markers(counts, "plain", "toxic", n_plain, n_toxic, markers)
    words = counts.filter(F.endswith("unit", F.lit(" ")))
    by_use = words.orderBy(F.desc(F.col("plain") + F.col("toxic")), "unit").limit(2 * base_words + 2 * markers)
    marking = [m.strip() for m in (*marked, *ordinary)]
    common = [r.unit.strip() for r in by_use.collect() if not any(_holds(r.unit, m) for m in marking)][:base_words]
    return common, ordinary, marked


def fit(
    training: DataFrame, text_col: str = "text", label_col: str = "toxic", base_words: int = BASE_WORDS,
    markers: int = MARKERS,
) -> ToxicityModel:
    """Learn both dictionaries and the calibration from rows of text and label (1 toxic, 0 not)."""
    rows = training.select(quoted(text_col).alias("text"), quoted(label_col).cast("int").alias("y"))
    rows = rows.filter("text is not null and y is not null").withColumn("copy", _copy_key(F.col("text")))
    rows = rows.groupBy("y", "copy").agg(F.min("text").alias("text")).select("text", "y")
    rows = stage(rows, "toxicity-training")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_plain, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not (n_plain and n_toxic):
        return ToxicityModel((), (), (), (), (), (), 1.0 if n_toxic else 0.0)
    counts = rows.select("y", F.explode(_units(F.col("text"))).alias("unit")).groupBy("unit").agg(
        F.sum(1 - F.col("y")).alias("plain"), F.sum("y").alias("toxic")
    )
    counts = stage(counts.filter(F.col("plain") + F.col("toxic") >= MARKER_TEXTS), "toxicity-units")
    common, ordinary, toxic = _dictionaries(counts, n_plain, n_toxic, base_words, markers)
    scored = rows.select("y", _feature_column(common, ordinary, toxic)(F.col("text")).alias("x")).collect()
    x, y = np.array([r.x for r in scored]), np.array([r.y for r in scored], float)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = _logistic((x - centre) / scale, y)
    logits = np.c_[(x - centre) / scale, np.ones(len(x))] @ weights
    return ToxicityModel(
        tuple(common), tuple(ordinary), tuple(toxic), tuple(centre.tolist()), tuple(scale.tolist()),
        tuple(weights[:-1].tolist()), float(weights[-1] - _threshold(logits, y)),
    )


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last weight is the intercept."""
    design, weights = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        curve = (design * (p * (1 - p))[:, None]).T @ design + penalty * np.eye(len(weights))
        weights -= np.linalg.solve(curve, design.T @ (p - y) + penalty * weights)
    return weights


def _threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit from which on calling a text toxic gives the best F measure over the training rows."""
    order = np.argsort(-logits, kind="stable")
    hits, weight = np.cumsum(y[order]), RECALL_WEIGHT**2
    measure = (1 + weight) * hits / (np.arange(1, len(y) + 1) + weight * y.sum())
    last = np.r_[np.diff(logits[order]) != 0, True]
    best = int(np.argmax(np.where(last, measure, -1)))
    # half way to the next lower score
    return float((logits[order][best] + logits[order][min(best + 1, len(y) - 1)]) / 2)


def score_column(model: ToxicityModel):
    """A column function from text to its score."""
    if not model.weights:
        return lambda text: F.lit(model.intercept)
    values = _feature_column(model.common, model.ordinary, model.toxic)
    offset = model.intercept - sum(w * c / s for w, c, s in zip(model.weights, model.centre, model.scale))
    factors = [w / s for w, s in zip(model.weights, model.scale)]

    def score(text: Column) -> Column:
        terms = F.zip_with(values(text), F.array(*map(F.lit, factors)), lambda v, w: v * w)
        return 1 / (1 + F.exp(-F.aggregate(terms, F.lit(offset), lambda a, b: a + b)))

    return score


def held_out(id_col: Column) -> Column:
    """Rows never learned from: a fifth of all ids by crc32."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """Texts with labels of at most ``fit_rows`` ids that may be learned from."""
    known = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("toxic"))
    known = known.filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    # fit_rows narrow rows at most
    return texts.join(F.broadcast(known), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def score_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, which replace columns of these names."""
    scored = docs.select(packed(docs), score_column(model)(quoted(text_col)).alias("score"))
    return scored.select(
        *unpacked(scored, "score", "predicted"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows scored toxic."""
    scored = docs.select(packed(docs), score_column(model)(quoted(text_col)).alias("score")).filter("score < 0.5")
    return scored.select(*unpacked(scored))
