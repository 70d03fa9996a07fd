"""Vector bin packing of documents into training sequences.

Every task packs the rows it reads, window by window. A document over the sequence length gives full sequences and a
rest. Rests are items with three demands: tokens, segments and loss-bearing tokens. An open sequence takes, of the items
that fit all three of its limits, the one whose demands have the largest dot product with what is left of the limits
(each relative to its limit); a gap that no item fits is closed by cutting one. What the last window leaves over is cut to
powers of two, which need no padding. No row is shuffled, and a task holds one window of rests.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.bpe import encode, encoding
from cohortloom.llm.common import whole_text

LENGTH, SEGMENTS, WINDOW = 1024, 64, 2048
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


class Packer:
    """Places pieces of documents; rows of placed pieces gather in .rows."""

    def __init__(self, first_id: int, length: int, segments: int, loss: int):
        self.next, self.length, self.segments, self.loss = first_id, length, segments, loss
        self.rows: list[tuple] = []
        self.items: list[list] = []  # doc_id, ids, start, tokens, loss per token, doc_tokens

    def put(self, sequence: int, offset: int, item: list, tokens: int) -> None:
        doc, ids, start, _, loss, total = item
        self.rows.append((doc, start, tokens, zlib.crc32(ids[start : start + tokens].tobytes()), total, sequence, offset, round(tokens * loss)))
        item[2], item[3] = start + tokens, item[3] - tokens

    def add(self, doc, ids: np.ndarray, loss: float) -> None:
        item = [doc, ids, 0, len(ids), loss, len(ids)]
        while item[3] >= self.length and self.length * loss <= self.loss:
            self.put(self.next, 0, item, self.length)
            self.next += 1
        if item[3]:
            self.items.append(item)

    def fill(self, keep: int) -> None:
        """Close sequences until at most `keep` items are left; 0 empties the window."""
        limits = np.array([self.length, self.segments, self.loss], float)
        demands = np.array([(i[3], 1, i[3] * i[4]) for i in self.items], float).reshape(-1, 3)
        alive = np.ones(len(self.items), bool)
        waiting = int(demands[:, 0].sum())
        while alive.sum() > keep:
            room, at = limits.copy(), 0
            if not keep and waiting < self.length:  # the rest: the largest power of two
                room[0] = 1 << (waiting.bit_length() - 1)
            while room[0] > 0 and room[1] > 0 and alive.any():
                fits = alive & (demands <= room).all(axis=1)
                if fits.any():
                    k = int(np.argmax(np.where(fits, (demands / limits) @ (room / limits), -1.0)))
                    take = int(demands[k, 0])
                else:  # cut the largest to the gap
                    k = int(np.argmax(np.where(alive, demands[:, 0], -1.0)))
                    rate = self.items[k][4]
                    take = int(min(demands[k, 0], room[0], room[2] / rate if rate else room[0]))
                    if take < 1:
                        break
                item = self.items[k]
                self.put(self.next, at, item, take)
                at += take
                room -= (take, 1, take * item[4])
                demands[k] = (item[3], 1, item[3] * item[4])
                alive[k] = item[3] > 0
                waiting -= take
            self.next += 1
        self.items = [i for i, a in zip(self.items, alive, strict=True) if a]


def pack(docs: DataFrame, rank_file: str, pattern: str, json_file: str, length: int = LENGTH, segments: int = SEGMENTS, loss_tokens: int = LENGTH, loss_share: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of packed sequences: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens).

    docs: doc_id, text (null: empty), and in instruction data a column named by loss_share, the share of a row's tokens
    that bear loss (by default all; null and NaN count as all, others are brought to 0 to 1). Without it, and with loss_tokens
    not under length, tokens and segments are the limits that bind. A document is its ids and id 0. The two vocabulary files hold the same merges;
    texts that contain the spelling of a special token go through json_file's tokenizer, as only that knows it.
    Repeated rows are packed as often as they come, null ids too; ties go to the item that came first. Very long texts are cut over full sequences.
    Other columns are ignored. An empty table gives none. sequence_id has the partition in its upper bits.
    """
    share = F.col(loss_share).cast("double") if loss_share else F.lit(1.0)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, special = encoding(rank_file, pattern), None
        packer = Packer(TaskContext.get().partitionId() << 33, length, segments, loss_tokens)

        def rows():
            out, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * len(NAMES), NAMES)

        for batch in batches:
            for doc, text, loss in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "loss")), strict=True):
                if "<|endoftext|>" in text:
                    if special is None:
                        from tokenizers import Tokenizer

                        special = Tokenizer.from_file(json_file)
                    ids = special.encode(text, add_special_tokens=False).ids
                else:
                    ids = encode(enc, text)
                packer.add(doc, np.array([*ids, 0], dtype="<u4"), loss)
                if len(packer.items) >= window:
                    packer.fill(window // 8)
                    yield rows()
        packer.fill(0)
        yield rows()

    columns = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(share, F.lit(1.0)), F.lit(1.0)))).alias("loss"))
    return columns.mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))
