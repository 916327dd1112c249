"""Token-id shards: independent Zstandard frames with a trailing seek table.

A shard is a run of Zstandard frames, each holding the little-endian 32-bit ids of some whole
documents, then a skippable frame with the document index, then the public Zstandard seekable
format's seek table (another skippable frame) with the sizes and a checksum of every frame. Any
Zstandard decoder can read a shard from end to end; a reader that wants some documents reads the
two tables and decompresses only the frames of those documents.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import files
from tidemark.llm.common import materialize, shared_path

# Fixed values of the public Zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Ids in a frame, unless one document has more.
FRAME_IDS = 1 << 18
#: Chunks of text whose ids a worker keeps; beyond that it starts again.
CACHE_CHUNKS = 1_100_000
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("start", "<u8"), ("n", "<u8"), ("frame", "<u4"), ("at", "<u8")])


#: Marks that byte-level pre-tokenisation keeps apart from a word that they follow.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"



def _byte_characters() -> dict[int, str]:
    """Byte-level BPE's printable character for each byte: itself if printable, else the next one above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(other)}


BYTE_CHARACTERS = _byte_characters()


class Encoder:
    """Ids of texts, with those of pieces between spaces kept.

    Byte-level pre-tokenisation never joins a space to what stands before it, so a text may be
    encoded piece by piece, cut before every space, as long as white space does not come in runs
    that touch a cut. Texts with such runs are encoded whole. Marks after a word are cut off too,
    as the pre-tokenisation does, so a word is encoded once whatever follows it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._clear()

    def _clear(self) -> None:
        self.spaced: dict[str, int] = {}  # pieces that follow a space, without it
        self.bare: dict[str, int] = {}  # a text's first piece, and marks
        self.flat = np.zeros(0, dtype=np.uint32)
        self.used = self.count = 0
        # a piece's ids are two stretches of flat: of its word, and of the marks after it
        self.start, self.size = np.zeros((2, 0, 2), dtype=np.int32)
        self.whole = np.zeros(0, dtype=bool)

    @staticmethod
    def _room(old: np.ndarray, n: int) -> np.ndarray:
        """``old``, enlarged to at least n rows."""
        if n <= len(old):
            return old
        out = np.zeros((max(n, 2 * len(old)), *old.shape[1:]), dtype=old.dtype)
        out[: len(old)] = old
        return out

    def _store(self, known: dict[str, int], pieces: list[str], start: np.ndarray, size: np.ndarray) -> None:
        n = self.count + len(pieces)
        self.start, self.size, self.whole = self._room(self.start, n), self._room(self.size, n), self._room(self.whole, n)
        self.start[self.count : n], self.size[self.count : n] = start, size
        self.whole[self.count : n] = [not p or p.strip() is not p for p in pieces]
        known.update(zip(pieces, range(self.count, n)))
        self.count = n

    def _encode(self, known: dict[str, int], lead: str, pieces: list[str]) -> None:
        """Ids of pieces: a word alone is one pre-token, so the model takes it directly, in its byte characters."""
        if not pieces:
            return
        other = [p for p in pieces if not p.isalpha()]
        found = iter(self.tokenizer.encode_batch_fast([lead + p for p in other], add_special_tokens=False))
        split = self.model.tokenize
        ids = [
            [x.id for x in split((lead + p).encode().decode("latin-1").translate(BYTE_CHARACTERS))] if p.isalpha() else next(found).ids for p in pieces
        ]
        size = np.zeros((len(pieces), 2), dtype=np.int64)
        size[:, 0] = list(map(len, ids))
        end = self.used + np.cumsum(size[:, 0])
        self.flat = self._room(self.flat, int(end[-1]))
        self.flat[self.used : end[-1]] = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(end[-1]) - self.used)
        self.used = int(end[-1])
        self._store(known, pieces, np.stack([end - size[:, 0], end], axis=1), size)

    def _learn(self, known: dict[str, int], lead: str, pieces: set[str]) -> None:
        cut, words, marks, plain = [], [], [], set()
        for piece in pieces:
            word = piece.rstrip(MARKS)
            if word is not piece and word.isalpha():
                cut.append(piece)
                words.append(word)
                marks.append(piece[len(word) :])
            else:
                plain.add(piece)
        plain.update(words)
        self._encode(known, lead, [p for p in plain if p not in known])
        self._encode(self.bare, "", [p for p in set(marks) if p not in self.bare])
        if cut:
            first = np.array([known[w] for w in words])
            second = np.array([self.bare[m] for m in marks])
            start = np.stack([self.start[first, 0], self.start[second, 0]], axis=1)
            self._store(known, cut, start, np.stack([self.size[first, 0], self.size[second, 0]], axis=1))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.count > CACHE_CHUNKS:
            self._clear()
        split = [t.split(" ") for t in texts]
        self._learn(self.bare, "", {pieces[0] for pieces in split if pieces[0] not in self.bare})
        get, coded, missing = self.spaced.get, [], set()
        for pieces in split:
            first = self.bare[pieces[0]]
            codes = list(map(get, pieces))
            codes[0] = first
            if None in codes:
                missing.update(p for p, c in zip(pieces, codes) if c is None)
            coded.append(codes)
        if missing:
            self._learn(self.spaced, " ", missing)
        out = []
        for text, pieces, codes in zip(texts, split, coded):
            if None in codes:
                codes = [c if c is not None else get(p) for p, c in zip(pieces, codes)]
            codes = np.array(codes, dtype=np.int64)
            if not text:
                out.append(np.zeros(0, dtype=np.uint32))
            elif len(pieces) > 1 and self.whole[codes].any():
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32))
            else:
                size = self.size[codes].ravel()
                end = np.cumsum(size, dtype=np.int64)
                at = np.repeat(self.start[codes].ravel() - (end - size), size) + np.arange(end[-1])
                out.append(self.flat[at])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class ShardWriter:
    """Appends documents to a shard; ``close`` writes the document index and the seek table."""

    def __init__(self, uri: str):
        self.out = files.create(uri)
        self.packer = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        self.docs: list[tuple] = []
        self.frames: list[tuple[int, int, int]] = []
        self.open: list[np.ndarray] = []
        self.open_ids = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.total, len(ids), len(self.frames), self.open_ids))
        self.open.append(ids)
        self.open_ids += len(ids)
        self.total += len(ids)
        if self.open_ids >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        raw = np.concatenate(self.open).astype("<u4").tobytes()
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.open, self.open_ids = [], 0

    def close(self) -> None:
        if self.open:
            self._flush()
        index = self.packer.compress(np.array(self.docs, dtype=DOC).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + len(foot)) + table + foot)
        self.out.close()


class ShardReader:
    """Random access to a shard: ``docs`` is its index, ``ids(i)`` the ids of the i-th document."""

    def __init__(self, uri: str):
        self.file = files.open_file(uri)
        size = self.file.size()
        n_frames, flag, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError(f"{uri}: no seek table with checksums")
        table = self._read(size - 9 - 12 * n_frames, 12 * n_frames)
        self.frames = np.frombuffer(table, dtype="<u4").reshape(-1, 3)
        self.offset = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        at = int(self.offset[-1])  # the document index follows the last frame of ids
        index = self._read(at + 8, struct.unpack("<II", self._read(at, 8))[1])
        self.unpacker = zstandard.ZstdDecompressor()
        self.docs = np.frombuffer(self.unpacker.decompress(index), dtype=DOC)
        self.now, self.ids_now = -1, np.zeros(0, dtype="<u4")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> np.ndarray:
        if k != self.now:
            raw = self.unpacker.decompress(self._read(int(self.offset[k]), int(self.frames[k, 0])))
            if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.now, self.ids_now = k, np.frombuffer(raw, dtype="<u4")
        return self.ids_now

    def ids(self, i: int) -> np.ndarray:
        doc = self.docs[i]
        return self.frame(int(doc["frame"]))[int(doc["at"]) : int(doc["at"]) + int(doc["n"])]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards in ascending doc_id order; returns ``(shard, path, ids, base)`` per shard.

    ids is the shard's number of ids, base that of all shards before it. Null texts are empty: such
    a document is the end id alone. Null doc_ids come first and repeated rows all count. An empty
    table gives no shard; other columns are ignored.
    """
    folder = shared_path(docs.sparkSession, "tokens")
    files.make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        writer = None
        for batch in batches:
            if writer is None and batch.num_rows:
                path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.zst"
                writer = ShardWriter(path)
            for a in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(a, 256).to_pylist()]
                found = encoder(tokenizer_path).encode(texts)
                for doc_id, ids in zip(batch.column(0).slice(a, 256).to_pylist(), found):
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([path]), pa.array([writer.total], pa.int64())], names=["shard", "path", "ids"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = materialize(rows.mapInArrow(run, "shard long, path string, ids long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_tokens(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, decoded from the shards' files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(path)
                docs = reader.docs
                crcs = [zlib.crc32(reader.ids(i).tobytes()) for i in range(len(docs))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs["doc_id"].astype(np.int64), mask=docs["null"].astype(bool)),
                        pa.array(docs["start"].astype(np.int64) + base),
                        pa.array(docs["n"].astype(np.int64)),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(1, shards.count())
    rows = shards.select("path", "base").repartition(n)
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
