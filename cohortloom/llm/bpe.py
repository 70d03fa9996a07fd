"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are split beforehand where no match of the pattern can reach across: before a space that follows a character
other than white space and comes before one other than white space. Parts are encoded one by one, so memory and time
stay in proportion to the text. A long run of white space is one match but for its last character, if something follows;
the library's pattern matcher overflows on such runs, so they are cut out and given to the merges directly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import map_text

LONG_TEXT, PART = 1 << 15, 1 << 16
#: A space between two characters other than white space: every match that includes it begins with it.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White space as the pattern's \s has it.
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def encoding(rank_file: str, pattern: str):
    """A tiktoken encoding of a rank file, without special tokens."""
    import base64

    import tiktoken

    with open(rank_file, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str) -> Iterator[str]:
    """A long text in parts cut at safe boundaries; a text without any comes whole."""
    at = 0
    while len(text) - at > PART:
        m = SAFE.search(text, at + PART)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(enc, text: str) -> list[int]:
    if len(text) <= LONG_TEXT:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for run in RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += [i for p in parts(text[at : run.start()]) for i in enc.encode_ordinary(p)]
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    return out + [i for p in parts(text[at:]) for i in enc.encode_ordinary(p)]


def decode(enc, ids: list[int]) -> bytes:
    """The raw bytes of the ids; pieces need not be whole characters."""
    return enc.decode_bytes(ids)


def token_ids(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each whole text and the bytes they decode to.

    Null text counts as empty and gives no ids. Repeated rows, ties and null ids pass through; other columns are ignored.
    """

    def make():
        enc = encoding(rank_file, pattern)

        def work(texts: list[str]) -> dict:
            ids = [encode(enc, t) for t in texts]
            return {"ids": ids, "decoded": [decode(enc, x) for x in ids]}

        return work

    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), make, "ids array<int>, decoded binary", drop_text=True)


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what token_ids() gives, computed where the ids are.

    Null text counts as empty, of which there are no ids; texts of any length are encoded whole, in pieces cut at safe boundaries; repeated rows, ties and null ids
    pass through, other columns are ignored, an empty table gives none.
    """

    def make():
        import numpy as np

        enc = encoding(rank_file, pattern)

        def work(texts: list[str]) -> dict:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts:
                ids = encode(enc, text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decode(enc, ids)).hexdigest())
            return out

        return work

    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), make, "n_tokens long, ids_sha256 string, decoded_sha256 string", drop_text=True)
