"""Secrets, and weak parts of credentials that are linked by what stands near them.

Base spans are always reported: ``assign`` (a key word, then a value of 12 or
more characters), ``access`` (access key ids) and ``hex`` (runs of 16 or more
hexadecimal digits). Weak candidates, kinds ``identifier`` (account and client
ids), ``token`` (long mixed values without a key word) and ``endpoint``
(addresses with a scheme), mean nothing alone. An interval join over each
document looks ``SCOPE`` code points to both sides of a candidate, from its
start and its stop, whatever the lengths of the parts: identifiers
and endpoints are reported when a secret is in scope, a token when an
identifier or an endpoint is.

Rules for odd input: a null or empty text has no parts; repeated rows are
documents of their own; an empty table gives no rows; other columns play no
part. Texts are read whole, one at a time.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spantab.llm.ordering import quoted

SCOPE = 400
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "token", "endpoint")
SECRETS = ("assign", "hex", "token")
ADDRESSES = ("access", "identifier", "endpoint")

_ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_IDENTIFIER = re.compile(
    r"""(?i:(?:client|account|access|app|user|tenant)[_-]?(?:key[_-]?)?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{6,}""",
    re.ASCII,
)
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9.-]+(?::[0-9]+)?")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEX_DIGITS = bytes(48 if b in b"0123456789abcdef" else 32 for b in range(256))
_VALUE_CHARS = bytes(
    48 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_=-") else 32 for b in range(256)
)

_PART = "struct<start: int, place: int, stop: int, kind: string>"
_ARROW_PARTS = pa.list_(
    pa.struct([("start", pa.int32()), ("place", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])
)


def _is_mixed(value: str) -> bool:
    return bool(re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value))


def parts_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of all base spans and weak candidates of one text.

    The tests before each pattern are cheap and exact: without what they look
    for, the pattern cannot match.
    """
    if not text:
        return []
    found, lower, raw = [], text.lower(), text.encode("utf-8", "surrogatepass")
    if any(k in lower for k in _KEYWORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"0" * 16 in raw.translate(_HEX_DIGITS):
        found += [("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    taken = sorted((a, z) for _, a, z in found)
    weak = []
    if "id" in lower:
        weak += [("identifier", *m.span()) for m in _IDENTIFIER.finditer(text)]
    if "://" in text:
        weak += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    if b"0" * 20 in raw.translate(_VALUE_CHARS):
        weak += [("token", *m.span()) for m in _TOKEN.finditer(text) if _is_mixed(m[0])]
    # a weak part inside a base span says nothing new
    at = 0
    for part in sorted(weak, key=lambda p: p[1]):
        while at < len(taken) and taken[at][1] <= part[1]:
            at += 1
        if at == len(taken) or taken[at][0] >= part[2]:
            found.append(part)
    return found


def _parts(texts: pa.Array) -> pa.Array:
    return pa.array(
        [
            [{"start": a, "place": KINDS.index(kind), "stop": z, "kind": kind} for kind, a, z in parts_of(t.as_py())]
            for t in texts
        ],
        _ARROW_PARTS,
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per document ``id`` and its reported ``spans``, sorted by start, then kind."""
    parts = arrow_udf(_parts, f"array<{_PART}>")(quoted(text_col))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), quoted(id_col).alias("id"), parts.alias("parts"))
    rows = rows.select("row_id", "id", F.explode_outer("parts").alias("part"))
    by_row, start, stop = Window.partitionBy("row_id", "id"), F.col("part.start"), F.col("part.stop")
    upwards = by_row.orderBy(start).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # a frame that only grows is read once; one up to the last row would be read again for every row
    downwards = by_row.orderBy(start.desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def any_of(kinds: tuple[str, ...]):
        wanted = F.col("part.kind").isin(*kinds)
        gap_before = start - F.max(F.when(wanted, stop)).over(upwards)
        gap_after = F.min(F.when(wanted, start)).over(downwards) - stop
        return F.coalesce(gap_before <= scope, F.lit(False)) | F.coalesce(gap_after <= scope, F.lit(False))

    linked = rows.select("row_id", "id", "part", any_of(SECRETS).alias("secret"), any_of(ADDRESSES).alias("address"))
    reported = (
        F.col("part.kind").isin(*BASE)
        | (F.col("part.kind").isin("identifier", "endpoint") & F.col("secret"))
        | ((F.col("part.kind") == "token") & F.col("address"))
    )
    return linked.groupBy("row_id", "id").agg(
        F.array_sort(F.collect_list(F.when(reported, F.col("part")))).alias("spans")
    ).drop("row_id")
