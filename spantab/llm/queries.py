"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantab.llm import (
    decontamination,
    filter_audit,
    html_text,
    lexical_search,
    licenses,
    mixing,
    piece_encoding,
    pii,
    secrets,
    sharding,
    simhash,
    toxicity,
    twins,
    vector_search,
)
from spantab.llm.spans import of_kind, spelled

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


def _sql_key(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT"


@_query(
    "op1_mixing",
    rf"""
    WITH d AS (SELECT doc_id, source, {_sql_key(mixing.SEED)} AS k,
                      coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
    l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
                     - coalesce(sum(2 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM w WINDOW f AS (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST)),
    c AS (SELECT first(level ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST) AS common
          FROM l WHERE level <= 2 * source_size / weight::DOUBLE),
    t AS (SELECT source, source_size,
                 coalesce(least(2.0::DOUBLE * source_size, common * weight), 2.0::DOUBLE * source_size) AS target
          FROM w CROSS JOIN (SELECT max(common) AS common FROM c)),
    q AS (SELECT doc_id, d.size, d.source, source_size, target, k,
                 sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS ends
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    p AS (SELECT *, epoch, ends + epoch * source_size AS stop,
                 greatest(0, least(size, floor(target)::BIGINT - (ends + epoch * source_size - size))) AS words
          FROM q CROSS JOIN (SELECT unnest([0, 1]) AS epoch)),
    m AS (SELECT *, sum(words) OVER (ORDER BY least(stop::DOUBLE, floor(target)) / target, source NULLS LAST, epoch, k,
                                              doc_id ROWS UNBOUNDED PRECEDING) - words AS start
          FROM p WHERE words > 0)
    SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, coalesce(sum(words), 0)::BIGINT AS taken,
           min(start)::BIGINT AS mix_start
    FROM q LEFT JOIN m ON q.doc_id = m.doc_id GROUP BY ALL
    """,
)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_words(_table(spark, sf_dir, "documents"))


@_query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.training_rows(docs, _table(spark, sf_dir, "labels")))
    return toxicity.score_documents(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@_query("op3_pii", twins.pii_sql())
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the terms that give it away."""
    found = pii.find_spans(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        *[of_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.size("terms").cast("long").alias("n_term"),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.concat("base", "terms")).alias("spans"),
    )


@_query(
    "op4_sharding",
    f"""
    WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                          lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
    d AS (SELECT doc_id, source, {_sql_key(sharding.SEED)} AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size,
                 list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) AS place_in,
                 count(*) OVER (PARTITION BY source) AS n FROM d),
    p AS (SELECT *, row_number() OVER (ORDER BY (place_in - 0.5::DOUBLE) / n, source NULLS LAST, place_in) - 1 AS place,
                 count(*) OVER () AS total FROM r)
    SELECT doc_id, size::BIGINT AS size,
           xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
                           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
           'rows' AS law, (place * {sharding.SHARDS} // total)::INTEGER AS shard,
           (place - (place * {sharding.SHARDS} // total * total + {sharding.SHARDS - 1}) // {sharding.SHARDS})::BIGINT
               AS slot,
           NULL::INTEGER AS grown_shard
    FROM p, t
    """,
)
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharding.shard_rows(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query("op5_secrets", twins.secrets_sql())
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, and linked parts of credentials."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        F.col("id").alias("doc_id"),
        *[of_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in secrets.BASE],
        (F.size("spans") - F.size(base)).cast("long").alias("n_linked"),
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )


@_query("op6_html_text")
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


@_query("op7_vector_search")
def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


@_query(
    "op8_decontamination",
    r"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS row_id,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                   'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS gram
          FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
    l AS (SELECT DISTINCT n FROM g),
    p AS (SELECT row_id, i, n, list_slice(w, i, i + n - 1) AS gram
          FROM d, l, unnest(range(1, greatest(0, len(w) - n + 1) + 1)) AS u(i)),
    h AS (SELECT row_id, i, p.n, item_id FROM p JOIN g USING (n, gram)),
    c AS (SELECT row_id, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(n)) AS u(k) GROUP BY 1),
    m AS (SELECT row_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (row_id) LEFT JOIN m USING (row_id)
    """,
)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan_documents(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", decontamination.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@_query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("op10_licenses", twins.licenses_sql())
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document is, or that its lines name."""
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"), licenses.known_texts(spark))
    return found.select(
        F.col("id").alias("doc_id"), "text_digest", F.array_join("whole", ",").alias("license_text"),
        F.array_join("notices", ",").alias("license_lines"), F.size("notices").cast("long").alias("n_notices"),
    )


@_query(
    "op11_lexical_search",
    r"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS row_id,
                      regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
    g AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
    i AS (SELECT item_id, row_number() OVER () AS item_row,
                 regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
    q AS (SELECT item_row, item_id, term, count(*) AS times FROM i, unnest(t) AS u(term) GROUP BY ALL),
    f AS (SELECT row_id, doc_id, len(t) AS n, term, count(*) AS tf FROM d, unnest(t) AS u(term)
          WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
          FROM f, g GROUP BY term, n_docs),
    s AS (SELECT item_row, item_id, row_id, doc_id,
                 sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT
                     AS score
          FROM f JOIN w USING (term) JOIN q USING (term), g GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST) AS rank
          FROM s WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
    """,
)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


VOCABULARY = "piece_bpe_32k.model"


@_query("op12_piece_encoding")
def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the text decoded from them."""
    import public_tokenizers  # only this query reads its files

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = piece_encoding.read_model(public_tokenizers.path(VOCABULARY))
    found = piece_encoding.encode_documents(docs, model)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees",
    )


@_query(
    "op13_filter_audit",
    r"""
    WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic
          FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
    m AS (SELECT doc_id, part, MAP {'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
                 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
                 'D': regexp_matches(text, '[#$%&*|]'),
                 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS fails FROM t),
    c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
          FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS f FROM f a, f b, f c, f d, f e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    p AS (SELECT part, f, fails, n, good, toxic,
                 coalesce(list_position(list_transform(f, lambda x: fails[x]), true), 6) AS first,
                 len(list_filter(f, lambda x: fails[x])) AS n_fails FROM c, o),
    s AS (SELECT part, array_to_string(f, '') AS filter_order, step, f[step] AS x,
                 coalesce(sum(n) FILTER (first > step), 0) AS kept, coalesce(sum(n) FILTER (first = step), 0) AS removed,
                 coalesce(sum(n) FILTER (fails[f[step]] AND first < step), 0) AS redundant,
                 coalesce(sum(n) FILTER (fails[f[step]] AND n_fails = 1), 0) AS unique_fails,
                 coalesce(sum(good) FILTER (first = step), 0) AS good_lost,
                 coalesce(sum(toxic) FILTER (first = step), 0) AS toxic_lost
          FROM p, (SELECT unnest(range(1, 6))::INT AS step) GROUP BY part, f, step)
    SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
           unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
           (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
    FROM s
    """,
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every filter removes in every order of the five filters, per language."""
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
