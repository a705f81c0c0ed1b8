"""SQL twins of the span and licence queries, spelled for DuckDB."""

from __future__ import annotations

from spantab.llm import licenses, pii, secrets

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
_CARD = r"[0-9](?:[\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_ASSIGN = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_IDENTIFIER = (
    r"""(?i:(?:client|account|access|app|user|tenant)[_-]?(?:key[_-]?)?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{6,}"""
)
_ENDPOINT = r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]+(?::[0-9]+)?"


_LETTERS = r"\p{L}+"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lists(text: str, patterns: dict[str, str]) -> str:
    """Columns of the matches and the gaps of every pattern."""
    return ", ".join(
        f"regexp_extract_all({text}, {_quote(p)}) AS {kind}_found, string_split_regex({text}, {_quote(p)}) AS {kind}_gaps"
        for kind, p in patterns.items()
    )


def _spans(kind: str, place: int, keep: str) -> str:
    """A list of spans of the matches that ``keep``, a test of @, accepts."""
    return (
        f"list_filter(list_transform(range(1, len({kind}_found) + 1), lambda i: {{'start':"
        f" (list_sum(list_transform(list_slice({kind}_gaps, 1, i), lambda g: length(g)))"
        f" + coalesce(list_sum(list_transform(list_slice({kind}_found, 1, i - 1), lambda g: length(g))), 0))::BIGINT,"
        f" 'place': {place}, 'kind': '{kind}', 'value': {kind}_found[i]}}), lambda s: {keep.replace('@', 's.value')})"
    )


def _spelled(spans: str) -> str:
    """Spans sorted and spelled; their sort keys come first in the structs."""
    return (
        f"coalesce(array_to_string(list_transform(list_sort({spans}), lambda s: s.kind || ':' || s.start || ':'"
        " || (s.start + length(s.value))), ','), '')"
    )


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '', 'g')"


_LUHN = (
    "(list_sum(list_transform(range(1, length(" + _digits("@") + ") + 1), lambda i: CASE WHEN i % 2 = 1"
    " THEN substr(reverse(" + _digits("@") + "), i, 1)::INT"
    " ELSE 2 * substr(reverse(" + _digits("@") + "), i, 1)::INT"
    " - CASE WHEN substr(reverse(" + _digits("@") + "), i, 1) >= '5' THEN 9 ELSE 0 END END)) % 10 = 0)"
)
_PII = (
    ("email", _EMAIL, "true"),
    ("ip", _IP, "len(list_filter(string_split(@, '.'), lambda p: length(ltrim(p, '0')) > 3"
                " OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0"),
    ("card", _CARD, f"length({_digits('@')}) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", _PHONE, f"length({_digits('@')}) BETWEEN 10 AND 15"),
)


def pii_sql() -> str:
    base = " || ".join(_spans(kind, i, keep) for i, (kind, _, keep) in enumerate(_PII))
    words = f"list_distinct(regexp_extract_all(lower(text), '\\p{{L}}{{{pii.TERM_LETTERS},}}'))"
    tokens = _spans(pii.TERM, len(_PII), "list_contains(flagged, lower(@))")
    counts = ", ".join(f"len(list_filter(base, lambda s: s.kind = '{k}'))::BIGINT AS n_{k}" for k, _, _ in _PII)
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents),
    x AS (SELECT *, {_lists('text', {kind: p for kind, p, _ in _PII})} FROM d),
    b AS (SELECT doc_id, row_id, text, list_sort({base}) AS base FROM x),
    h AS (SELECT DISTINCT row_id, CASE WHEN s.kind IN ('card', 'phone') THEN s.kind || ':' || {_digits('s.value')}
                                       ELSE s.kind || ':' || lower(s.value) END AS entity
          FROM b, unnest(base) AS u(s)),
    k AS (SELECT entity, count(*) AS n_e FROM h GROUP BY 1),
    t AS (SELECT row_id, unnest({words}) AS word FROM d),
    p AS (SELECT entity, word, n_e, count(*) AS n_te FROM h JOIN k USING (entity) JOIN t USING (row_id) GROUP BY 1, 2, 3),
    f AS (SELECT word, count(*) AS n_t FROM t GROUP BY 1),
    n AS (SELECT count(*) AS n FROM d),
    m AS (SELECT DISTINCT word FROM p JOIN f USING (word), n WHERE log2(n / n_e) > 0
          AND log2(n * (n_te - {pii.DISCOUNT}::DOUBLE) / (n_t * n_e)) >= {pii.DISCLOSURE}::DOUBLE * log2(n / n_e)),
    r AS (SELECT row_id, list(DISTINCT word) AS flagged FROM t JOIN m USING (word) GROUP BY 1),
    y AS (SELECT row_id, base, flagged, {_lists('text', {pii.TERM: _LETTERS})}
          FROM b JOIN r USING (row_id)),
    s AS (SELECT row_id, list_filter({tokens}, lambda t: len(list_filter(base, lambda x:
              x.start < t.start + length(t.value) AND t.start < x.start + length(x.value))) = 0) AS terms FROM y)
    SELECT doc_id, {counts}, coalesce(len(terms), 0)::BIGINT AS n_term, sha256({_spelled('base')}) AS base_sha256,
           {_spelled('base || coalesce(terms, [])')} AS spans
    FROM b LEFT JOIN s USING (row_id)
    """


_MIXED = "regexp_matches(@, '[a-z]') AND regexp_matches(@, '[A-Z]') AND regexp_matches(@, '[0-9]')"
_PARTS = (
    ("assign", _ASSIGN, f"length(regexp_extract(@, {_quote(_ASSIGN)}, 1)) >= 12"),
    ("access", "AKIA[A-Z0-9]+", "length(@) >= 18"),
    ("hex", "[0-9a-f]{16,}", "true"),  # a leftmost longest run of 16 or more begins where the whole run does
    ("identifier", _IDENTIFIER, "true"),
    ("token", "[A-Za-z0-9+/_=-]{20,}", _MIXED),
    ("endpoint", _ENDPOINT, "true"),
)


def secrets_sql() -> str:
    parts = {kind: _spans(kind, i, keep) for i, (kind, _, keep) in enumerate(_PARTS)}
    base = " || ".join(parts[k] for k in secrets.BASE)
    weak = " || ".join(parts[k] for k in secrets.KINDS if k not in secrets.BASE)

    def listed(kinds: tuple[str, ...]) -> str:
        return ", ".join(_quote(k) for k in kinds)

    near = f"(PARTITION BY row_id ORDER BY s.start RANGE BETWEEN {secrets.SCOPE} PRECEDING AND {secrets.SCOPE} FOLLOWING)"
    counts = ", ".join(f"count(*) FILTER (s.kind = '{k}')::BIGINT AS n_{k}" for k in secrets.BASE)
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents),
    x AS (SELECT *, {_lists('text', {kind: p for kind, p, _ in _PARTS})} FROM d),
    b AS (SELECT doc_id, row_id, {base} AS base, {weak} AS weak FROM x),
    p AS (SELECT row_id, unnest(base || list_filter(weak, lambda t: len(list_filter(base, lambda x:
              x.start < t.start + length(t.value) AND t.start < x.start + length(x.value))) = 0)) AS s FROM b),
    l AS (SELECT row_id, s, bool_or(s.kind IN ({listed(secrets.SECRETS)})) OVER {near} AS secret,
                 bool_or(s.kind IN ({listed(secrets.ADDRESSES)})) OVER {near} AS address FROM p),
    r AS (SELECT row_id, s FROM l WHERE s.kind IN ({listed(secrets.BASE)})
              OR (s.kind IN ('identifier', 'endpoint') AND secret) OR (s.kind = 'token' AND address)),
    g AS (SELECT row_id, {counts}, count(*) FILTER (s.kind NOT IN ({listed(secrets.BASE)}))::BIGINT AS n_linked,
                 list(s) FILTER (s.kind IN ({listed(secrets.BASE)})) AS base, list(s) AS every FROM r GROUP BY 1)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, coalesce(n_linked, 0) AS n_linked,
           sha256({_spelled('g.base')}) AS base_sha256, {_spelled('every')} AS spans
    FROM b LEFT JOIN g USING (row_id)
    """


def _canonical(text: str) -> str:
    plain = f"lower(coalesce({text}, ''))"
    plain = f"regexp_replace({plain}, {_quote(licenses.COPYRIGHT_LINE)}, ' ', 'g')"
    for old, new in licenses.EQUIVALENT:
        plain = f"replace({plain}, {_quote(old)}, {_quote(new)})"
    return f"trim(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def licenses_sql() -> str:
    names = ", ".join(f"({_quote(i)}, {_quote(n)})" for i, found in licenses.LICENSE_NAMES.items() for n in found)
    notices = ", ".join(f"({_quote(n)})" for n in licenses.NOTICES)
    return f"""
    WITH names(license_id, name) AS (VALUES {names}), notices(notice) AS (VALUES {notices}),
    k AS (SELECT DISTINCT license_id, sha256({_canonical("replace(notice, '{}', name)")}) AS digest FROM names, notices),
    d AS (SELECT doc_id, row_number() OVER () AS row_id, text, sha256({_canonical('text')}) AS text_digest FROM documents),
    l AS (SELECT DISTINCT row_id, sha256({_canonical('line')}) AS digest
          FROM (SELECT row_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d)),
    n AS (SELECT row_id, list_sort(list(DISTINCT license_id)) AS ids FROM l JOIN k USING (digest) GROUP BY 1),
    w AS (SELECT row_id, list_sort(list(DISTINCT license_id)) AS ids FROM d JOIN k ON text_digest = digest GROUP BY 1)
    SELECT doc_id, text_digest, coalesce(array_to_string(w.ids, ','), '') AS license_text,
           coalesce(array_to_string(n.ids, ','), '') AS license_lines, coalesce(len(n.ids), 0)::BIGINT AS n_notices
    FROM d LEFT JOIN n USING (row_id) LEFT JOIN w USING (row_id)
    """
