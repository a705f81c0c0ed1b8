"""Spans of pattern matches in code points, as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: start and stop in code points (stop exclusive), the kind's place in its list, the kind, the matched text.
SPAN = "struct<start: int, place: int, stop: int, kind: string, value: string>"


#: Matches that are placed together; lists are appended to within a block only, so many matches cost linear time.
BLOCK = 256


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, pattern: Column, kind: str, place: int, keep: Callable[[Column], Column]) -> Column:
    """Leftmost non-overlapping matches that ``keep`` accepts, with their places.

    What stands between the matches comes from splitting at them; lengths of
    both add up to positions. Texts without a match are never split.
    """
    nothing = F.array().cast(f"array<array<{SPAN}>>")

    def step(done: Column, piece: Column) -> Column:
        begin = done["at"] + piece["gap"]
        stop = begin + F.coalesce(F.char_length(piece["m"]), F.lit(0))
        span = F.struct(
            begin.alias("start"), F.lit(place).alias("place"), stop.alias("stop"), F.lit(kind).alias("kind"),
            piece["m"].alias("value"),
        )
        kept = piece["m"].isNotNull() & keep(piece["m"])
        return F.struct(
            stop.alias("at"), F.when(kept, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans")
        )

    def block(done: Column, pieces: Column) -> Column:
        start = F.struct(done["at"].alias("at"), no_spans().alias("spans"))
        ended = F.transform(F.array(F.aggregate(pieces, start, step)), lambda e: F.struct(
            e["at"].alias("at"), F.concat(done["blocks"], F.array(e["spans"])).alias("blocks")
        ))
        return ended[0]

    def in_blocks(pieces: Column) -> Column:
        cuts = F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK))
        start = F.struct(F.lit(0).alias("at"), nothing.alias("blocks"))
        return F.flatten(F.aggregate(F.transform(cuts, lambda i: F.slice(pieces, i, BLOCK)), start, block)["blocks"])

    def placed(found: Column) -> Column:
        pieces = F.zip_with(
            F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m.alias("m"))
        )
        return F.when(F.size(found) > 0, F.transform(F.array(pieces), in_blocks)[0]).otherwise(no_spans())

    # the matches as a bound variable, so that they are looked for once
    return F.transform(F.array(F.regexp_extract_all(text, pattern, F.lit(0))), placed)[0]


def spelled(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    parts = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")),
    )
    return F.array_join(parts, ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
