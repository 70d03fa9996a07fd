"""Words of whole texts: maximal runs of other characters than space and those from tab to carriage return."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a text whose words are in memory at once.
CHUNK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """The words of UTF-8 text in order, in lists of about CHUNK bytes; a word over that comes whole."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + CHUNK)
        to = cut.start() if cut else len(data)
        yield data[at:to].split()  # of bytes, split() takes just these six characters as white space
        at = to
