"""Sum-of-squares online packing of documents into fixed windows of tokens.

Each open window has a fill level; N[l] counts the open windows at level l. A document's piece
goes to the level that makes the sum of N[l]^2 over partially filled windows smallest, opening
a new window if that is the best move. Only the level array and the open windows are kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.textkit import batches_of
from rampart.llm.tokens import encoder, with_end

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_tokens long")


class Packer:
    """Windows of one stream. ``put`` takes a document's ids, ``close`` ends the stream; both
    return finished pieces as tuples in the column order of PIECES."""

    def __init__(self, window: int, first_sequence: int = 0):
        self.c = window
        self.count = np.zeros(window + 1, np.int64)  # N[l]; 0 and the full level stay 0
        self.open: dict[int, list[list]] = {}  # level -> windows, each a list of pieces
        self.sequence = first_sequence
        # cost of leaving level l, and of arriving there, in squared counts
        self._inf = np.iinfo(np.int64).max // 4

    def level_for(self, size: int) -> int:
        """The level (0: a new window) whose choice minimises the sum of squares; the fullest
        of equal ones."""
        n, c = self.count, self.c
        leave = np.where(n[:c - size + 1] > 0, 1 - 2 * n[:c - size + 1], self._inf)
        leave[0] = 0
        arrive = 2 * n[size:] + 1
        arrive[-1] = 0  # a full window is not partial
        cost = leave + arrive
        return int(len(cost) - 1 - np.argmin(cost[::-1]))

    def put(self, doc, ids: np.ndarray) -> list[tuple]:
        """Whole windows are cut from long documents; the rest is placed in one piece."""
        out, n = [], len(ids)
        for start in range(0, n - n % self.c, self.c):
            out += self._emit([(doc, start, n, ids[start:start + self.c])])
        size = n % self.c
        if size:
            level = self.level_for(size)
            window = self.open[level].pop() if level else []
            if level:
                self.count[level] -= 1
            window.append((doc, n - size, n, ids[n - size:].copy()))
            if level + size == self.c:
                out += self._emit(window)
            else:
                self.open.setdefault(level + size, []).append(window)
                self.count[level + size] += 1
        return out

    def close(self) -> list[tuple]:
        """Fill the windows still open, fullest first, with ids cut from the emptiest; what is
        left at the end is cut at powers of two, which need no padding."""
        rest = [(level, w) for level in sorted(self.open, reverse=True) for w in self.open[level]]
        out: list[tuple] = []
        donors: list[tuple] = []  # pieces of emptied windows
        self.open, i, j = {}, 0, len(rest)
        self.count[:] = 0
        while i < j:
            level, window = rest[i]
            i += 1
            while level < self.c and (donors or i < j):
                if not donors:
                    j -= 1
                    donors = rest[j][1]
                doc, start, n, ids = donors.pop()
                take = min(len(ids), self.c - level)
                window.append((doc, start, n, ids[:take]))
                if take < len(ids):
                    donors.append((doc, start + take, n, ids[take:]))
                level += take
            if level == self.c:
                out += self._emit(window)
            else:
                donors = window
        left = sum(len(p[3]) for p in donors)
        for bit in range(self.c.bit_length() - 1, -1, -1):
            while left >= 1 << bit:
                window, need = [], 1 << bit
                left -= need
                while need:
                    doc, start, n, ids = donors.pop(0)
                    take = min(len(ids), need)
                    window.append((doc, start, n, ids[:take]))
                    if take < len(ids):
                        donors.insert(0, (doc, start + take, n, ids[take:]))
                    need -= take
                out += self._emit(window)
        return out

    def _emit(self, window: list[tuple]) -> list[tuple]:
        total, at, rows = sum(len(p[3]) for p in window), 0, []
        for doc, start, n, ids in window:
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, self.sequence, at, total))
            at += len(ids)
        self.sequence += 1
        return rows


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every document's ids (with ``end_id`` after them) into windows of ``window`` tokens.

    One row per piece: doc_id, start (ids of the document before it), length, ids_crc32 (of the
    little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset and sequence_tokens.
    Each id lies in exactly one piece; every sequence is full or has a power of two of tokens.
    A null or empty text is the end id alone; repeated rows are separate documents; a null
    doc_id is returned as null; other columns are ignored; an empty table gives no rows.

    Each task packs the rows it scans: nothing is shuffled, and a task holds one batch of texts
    and its open windows. Sequence ids carry the partition in their upper bits.
    """

    def run(batches):
        enc = encoder(tokenizer_path)
        packer = Packer(window, TaskContext.get().partitionId() << 36)
        for t in batches_of(batches, 1 << 20, "text"):
            ids, offs = with_end(*enc.encode(t.column("text")), end_id)
            rows: list[tuple] = []
            for doc, a, b in zip(t.column("doc_id").to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                rows += packer.put(doc, ids[a:b])
            yield _table(rows)
        yield _table(packer.close())

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, PIECES)


_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_NAMES)


def op1_sum_of_squares_packing(spark, sf_dir: str) -> DataFrame:
    """Thin query: byte-level BPE ids and end id 1, windows of 2048, the whole documents table."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
