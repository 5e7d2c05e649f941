"""Word rules shared by the operators, on UTF-8 bytes.

``plain_words`` lower-cases A-Z and splits at every ASCII character that is no digit
or letter; ``bytes.split()`` splits at exactly the space and the characters 9 to 13.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

_PLAIN = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def folded(text: bytes | None) -> bytes:
    """``text`` in lower case with a space for every separator, each byte in its place."""
    return text.translate(_PLAIN) if text else b""


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of digits, letters and non-ASCII characters; none for a null."""
    return folded(text).split()


def rows_of(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with its texts as UTF-8 bytes, a null as None."""
    for batch in batches:
        yield batch, batch.column(text).cast(pa.binary()).to_pylist()
