"""Words of folded texts, in segments of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

#: A long text is split into words this many bytes at a time.
SEGMENT_BYTES = 1 << 20


def folding(keep) -> bytes:
    """A byte table that lower-cases A-Z and makes every byte a space for which ``keep`` is false."""
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if keep(b) else 32 for b in lower)


#: Digits, letters and everything beyond ASCII make words.
ALPHANUMERIC = folding(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: ASCII letters and everything beyond ASCII make words.
LETTERS = folding(lambda b: 97 <= b <= 122 or b >= 128)
#: Everything but white space makes words.
UNSPACED = folding(lambda b: b != 32 and not 9 <= b <= 13)


def fold(text: str | None, table: bytes) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(table)


def segments(folded: bytes) -> Iterator[list[bytes]]:
    """The words of a folded text, about ``SEGMENT_BYTES`` at a time."""
    at = 0
    while at < len(folded):
        end = at + SEGMENT_BYTES
        if end < len(folded):
            end = folded.find(b" ", end)
            end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end
