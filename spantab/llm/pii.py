"""Personal data, and the terms that would give it away.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers.
Every distinct value is a protected entity. How strongly a term reveals an
entity is measured over the corpus: with ``n`` documents, ``n_t`` with the
term, ``n_e`` with the entity and ``n_te`` with both, the pointwise mutual
information ``log2(n (n_te - DISCOUNT) / (n_t n_e))`` is compared with the
entity's own information ``log2(n / n_e)``. The discount takes half a document
off what was seen together: two documents are evidence in any corpus of about a
thousand, a single one only beyond 2**20 documents, where meeting by chance is
out of the question. No count is cut off. A term whose share reaches
``DISCLOSURE`` is a span too, in every document: it gives the entity away where
the entity itself is not spelled out as well. Sanitising replaces base spans by
their kind, removes terms that reveal everything and generalises the others.

Terms are letter runs of ``TERM_LETTERS`` or more, lower-cased. Terms and
entities are counted over all documents. Entities and terms that no possible
``n_te`` could bring to the threshold are left out before pairs are counted.

Rules for odd input: a null text is empty; repeated rows count as documents of
their own; an empty table gives no rows; spans of one start are ordered by the
kinds' places; very long texts are read whole, their matches placed in blocks;
other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spantab.llm.ordering import quoted
from spantab.llm.spans import matches, no_spans
from spantab.staging import stage

DISCOUNT = 0.5
DISCLOSURE = 0.95
TERM_LETTERS = 4
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# A match can only begin at the start of a run of its first characters, or where the last match ended;
# saying so keeps long runs linear. Quantifiers are possessive where nothing that follows could take a character back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
#: A whole chain of 14 to 19 digits; shorter and longer chains are no cards, whatever they contain.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _is_ip(match: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.ltrim(part, F.lit("0"))
        return (F.char_length(plain) < 3) | ((F.char_length(plain) == 3) & (plain <= "255"))

    return F.forall(F.split(match, r"\.", -1), small)


def _luhn(match: Column) -> Column:
    """Every second digit from the right doubled, digits of the products added: a multiple of ten."""
    digits = _digits(match)
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)),
    )
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _is_phone(match: Column) -> Column:
    return F.char_length(_digits(match)).between(10, 15)


def base_spans(text: Column) -> Column:
    """All base spans of a text, sorted by start, then kind."""
    found = [
        F.when(F.contains(text, F.lit("@")), matches(text, F.lit(EMAIL), "email", 0, lambda m: F.lit(True))),
        matches(text, F.lit(IP), "ip", 1, _is_ip),
        matches(text, F.lit(CARD), "card", 2, _luhn),
        F.when(F.contains(text, F.lit("+")), matches(text, F.lit(PHONE), "phone", 3, _is_phone)),
    ]
    return F.array_sort(F.concat(*[F.coalesce(f, no_spans()) for f in found]))


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def _terms(text: Column) -> Column:
    letters = r"\p{L}{" + str(TERM_LETTERS) + ",}"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(letters), F.lit(0)))


def find_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE
) -> DataFrame:
    """Per document ``id, base, terms``: its base spans, and the spans of terms that reveal an entity.

    ``terms`` spans have kind ``term``; their value is the text. A term span
    that a base span covers in part is left to the base span. ``full`` names
    the terms that reveal an entity wholly.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    read = docs.select(quoted(id_col).alias("id"), text.alias("text"))
    based = read.select(F.monotonically_increasing_id().alias("row_id"), "id", "text", base_spans(F.col("text")).alias("base"))
    based = stage(based, "pii-base")
    revealing = stage(_revealing_terms(based, disclosure), "pii-revealing")
    any_case = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))
    clear = lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"]))
    terms = F.filter(matches(F.col("text"), any_case, TERM, 4, lambda m: F.lit(True)), clear)
    return based.join(revealing, "row_id", "left").select(
        "id", "base", F.when(F.col("words").isNotNull(), terms).otherwise(no_spans()).alias("terms"),
        F.coalesce("full", F.array().cast("array<string>")).alias("full"),
    )


def reveals(n: Column, n_e: Column, n_t: Column, n_te: Column, disclosure: float) -> Column:
    """Whether a term reveals an entity, from the numbers of documents with either and both."""
    information = F.log2(n / n_e)
    return (information > 0) & (F.log2(n * (n_te - DISCOUNT) / (n_t * n_e)) >= disclosure * information)


def _revealing_terms(based: DataFrame, disclosure: float) -> DataFrame:
    """Per row with any the ``words`` that reveal an entity, and those that do so wholly."""
    documents, n_e, n_t = F.lit(based.count()), F.col("n_e"), F.col("n_t")
    entities = F.array_distinct(F.transform("base", _entity))
    holders = based.filter(F.size("base") > 0)
    holding = holders.select("row_id", F.explode(entities).alias("entity"))
    known = holding.groupBy("entity").agg(F.count("*").alias("n_e"))
    # at best a term stands in the entity's documents and nowhere else
    known = stage(known.filter(reveals(documents, n_e, n_e, n_e, disclosure)), "pii-entities")
    # document frequencies of all terms by hash; a clash of two hashes can only make a term look more common
    everywhere = based.select("row_id", F.explode(_terms(F.col("text"))).alias("word"))
    counts = everywhere.groupBy(F.xxhash64("word").alias("hashed")).agg(F.count("*").alias("n_t"))
    most = known.agg(F.max("n_e")).first()[0] or 1
    # from n_te <= n_e follows log2(n_t) <= log2(n_e) + (1 - disclosure) log2(n / n_e), which grows with n_e
    rare = counts.filter(F.log2(n_t) <= F.log2(F.lit(most)) + (1 - disclosure) * F.log2(documents / most) + 1e-9)
    with_entity = holding.join(known, "entity").join(
        holders.select("row_id", _terms(F.col("text")).alias("words")), "row_id"
    )
    with_terms = with_entity.select("entity", "n_e", F.explode("words").alias("word")).withColumn("hashed", F.xxhash64("word"))
    possible = with_terms.join(rare, "hashed").filter(
        reveals(documents, n_e, n_t, F.least(n_t, n_e), disclosure)
    )
    together = possible.groupBy("entity", "word", "n_e", "n_t").agg(F.count("*").alias("n_te"))
    measured = stage(together.filter(reveals(documents, n_e, n_t, F.col("n_te"), disclosure)), "pii-pairs")
    words = measured.groupBy("word").agg(F.max(F.col("n_te") == F.col("n_t")).alias("wholly"))
    # written first, so that the join below knows how few they are
    found = everywhere.join(stage(words, "pii-words"), "word")
    # at most the distinct words of one document
    return found.groupBy("row_id").agg(
        F.array_sort(F.collect_list("word")).alias("words"),
        F.array_sort(F.collect_list(F.when(F.col("wholly"), F.col("word")))).alias("full"),
    )


def sanitised(text: Column, base: Column, terms: Column, full: Column) -> Column:
    """The text with base spans as ``[kind]``, wholly revealing terms removed and the other terms as ``[term]``."""

    def step(done: Column, span: Column) -> Column:
        gone = (span["kind"] == TERM) & F.array_contains(full, F.lower(span["value"]))
        shown = F.when(gone, F.lit("")).otherwise(F.concat(F.lit("["), span["kind"], F.lit("]")))
        before = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        later = span["start"] >= done["at"]
        return F.struct(
            F.when(later, span["stop"]).otherwise(F.greatest(done["at"], span["stop"])).alias("at"),
            F.when(later, F.concat(done["text"], before, shown)).otherwise(done["text"]).alias("text"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    done = F.aggregate(F.array_sort(F.concat(base, terms)), start, step)
    return F.concat(done["text"], F.substring(text, done["at"] + 1, F.char_length(text)))
