"""Token-id files: documents' ids in doc_id order, compressed by the context-mixing coder.

A file is a header, independent blocks and an index. Every block resets the model and carries
checksums of its payload and of its ids; the index lists the documents and their id counts.
Files of one run are numbered in doc_id order, so a document's place in the whole id stream is
the ids of earlier files plus those before it in its own.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampart.llm.context_coder import decode_block, encode_block, lanes_for
from rampart.llm.shared_files import Publish, new_folder, open_file
from rampart.llm.textkit import batches_of
from rampart.llm.tokens import encoder, with_end
from rampart.session import materialize

MAGIC = b"RMPTOK1\n"
_HEAD = struct.Struct("<II")  # vocabulary, ids per full block
_BLOCK = struct.Struct("<cIIIII")  # b"B", ids, lanes, payload bytes, crc32 of payload, crc32 of ids
_INDEX = struct.Struct("<cQIII")  # b"I", documents, bytes, crc32 of the index, blocks
BLOCK_IDS = 1 << 20


class TokenWriter:
    """Writes one file from documents in order."""

    def __init__(self, out, vocab: int, block_ids: int = BLOCK_IDS):
        if not 0 < vocab < 1 << 20:
            raise ValueError(f"vocabulary of {vocab} ids: 1 to {(1 << 20) - 1} are supported")
        self.out, self.vocab, self.block_ids = out, vocab, block_ids
        self.docs, self.nulls, self.sizes = [], [], []
        self.held, self.n_held, self.blocks, self.ids = [], 0, 0, 0
        out.write(MAGIC + _HEAD.pack(vocab, block_ids))

    def add(self, doc_id, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit."""
        self.docs.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self.held.append(ids)
        self.n_held += len(ids) // 4
        while self.n_held >= self.block_ids:
            raw = b"".join(self.held)
            self._block(raw[:4 * self.block_ids])
            self.held, self.n_held = [raw[4 * self.block_ids:]], self.n_held - self.block_ids

    def _block(self, raw: bytes) -> None:
        ids = np.frombuffer(raw, "<u4")
        lanes = lanes_for(len(ids))
        words, per_lane = encode_block(ids, self.vocab, lanes)
        payload = per_lane.astype("<u4").tobytes() + words.astype("<u4").tobytes()
        self.out.write(_BLOCK.pack(b"B", len(ids), lanes, len(payload), zlib.crc32(payload), zlib.crc32(raw)) + payload)
        self.blocks += 1

    def close(self) -> None:
        if self.n_held:
            self._block(b"".join(self.held))
        body = zlib.compress(np.array(self.docs, "<i8").tobytes() + np.array(self.sizes, "<i8").tobytes() + np.packbits(np.array(self.nulls, bool)).tobytes())
        index = _INDEX.pack(b"I", len(self.docs), len(body), zlib.crc32(body), self.blocks) + body
        self.out.write(index + struct.pack("<Q", len(index)))


class TokenReader:
    """Reads a file: ``docs`` and ``sizes`` from the index, ids block by block."""

    def __init__(self, f):
        self.f = f
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        self.vocab, _ = _HEAD.unpack(f.read(_HEAD.size))
        first = f.tell()
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 8)
        f.seek(end - 8 - struct.unpack("<Q", f.read(8))[0])
        kind, n, size, crc, self.blocks = _INDEX.unpack(f.read(_INDEX.size))
        body = f.read(size)
        if kind != b"I" or zlib.crc32(body) != crc:
            raise ValueError("token file: index checksum")
        raw = zlib.decompress(body)
        docs = np.frombuffer(raw, "<i8", n)
        null = np.unpackbits(np.frombuffer(raw, np.uint8, offset=16 * n), count=n).astype(bool)
        self.docs = [None if x else d for d, x in zip(docs.tolist(), null.tolist())]
        self.sizes = np.frombuffer(raw, "<i8", n, 8 * n)
        f.seek(first)

    def id_blocks(self):
        """The ids of each block as little-endian bytes, checked against both checksums."""
        for _ in range(self.blocks):
            kind, n, lanes, size, crc, crc_ids = _BLOCK.unpack(self.f.read(_BLOCK.size))
            payload = self.f.read(size)
            if kind != b"B" or zlib.crc32(payload) != crc:
                raise ValueError("token file: block checksum")
            per_lane = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
            ids = decode_block(np.frombuffer(payload, "<u4", offset=4 * lanes), per_lane, n, self.vocab).astype("<u4").tobytes()
            if zlib.crc32(ids) != crc_ids:
                raise ValueError("token file: id checksum")
            yield ids

    def documents(self):
        """(doc_id, ids before it in the file, ids, crc32 of its ids); one block is held."""
        blocks, raw, pos, start = self.id_blocks(), b"", 0, 0
        for doc, n in zip(self.docs, self.sizes.tolist()):
            crc, left = 0, 4 * n
            while left:
                if pos == len(raw):
                    raw, pos = next(blocks), 0
                some = raw[pos:pos + left]
                crc = zlib.crc32(some, crc)
                pos, left = pos + len(some), left - len(some)
            yield doc, start, n, crc
            start += n


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents in doc_id order (nulls first, ties by text) as numbered files; returns
    the written manifest: part, uri, docs, ids."""

    def run(batches):
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer_path)
        to = Publish(folder, f"part-{part:06d}.rtok")
        with to as out:
            w = TokenWriter(out, enc.vocab_size)
            for t in batches_of(batches, 1 << 20, "text"):
                ids, offs = with_end(*enc.encode(t.column("text")), end_id)
                for doc, a, b in zip(t.column("doc_id").to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                    w.add(doc, ids[a:b].tobytes())
            w.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "uri": [to.uri], "docs": [len(w.docs)], "ids": [w.ids]})

    tie = F.xxhash64("text")
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = src.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return materialize(ordered.mapInArrow(run, "part long, uri string, docs long, ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (unsigned, of its little-endian ids). The manifest (a row per file) is gathered
    on the driver to number the files' first ids."""
    files = manifest.where("docs > 0").orderBy("part").collect()
    starts = np.append(0, np.cumsum([f.ids for f in files])).tolist()
    uris = [f.uri for f in files]

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                with open_file(uris[i]) as f:
                    rows = [(d, s + starts[i], n, c) for d, s, n, c in TokenReader(f).documents()]
                for k in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[k:k + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    return spark.range(0, len(uris), 1, max(1, len(uris))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write every text's ids to files in the shared folder and read them back.

    A null or empty text is the end id alone; repeated rows are kept, next to each other; a
    null doc_id sorts first; other columns are ignored; an empty table gives no rows.
    """
    folder = new_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer_path, end_id, doc_id, text))


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    """Thin query: word-level BPE ids and end id 2 of the whole documents table."""
    import public_tokenizers

    return token_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
