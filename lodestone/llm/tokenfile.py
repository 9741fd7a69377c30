"""Token-id files: independent zstandard frames with a trailing seek table.

A file is, in order:

* data frames, each a zstandard frame (with its own content checksum) of
  little-endian unsigned 32-bit ids. Documents follow one another; a frame ends after at
  most ``FRAME_IDS`` ids, so a reader of one document decompresses its frames only;
* an index in a skippable frame: doc ids, whether each is null, and id counts;
* a seek table in a skippable frame, in the public seekable format of zstandard: for each
  frame its compressed size, decompressed size and checksum (the low half of XXH64 of
  the decompressed bytes), then the number of frames, a flag byte and a magic number.

Any zstandard decoder reads such a file as one stream of ids.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import tokens
from lodestone.session import fresh_path

FRAME_IDS = 1 << 16
#: Fixed values of the zstandard formats.
SEEK_FRAME, INDEX_FRAME, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80


class Writer:
    """Writes documents in turn to an open binary stream."""

    def __init__(self, stream, frame_ids: int = FRAME_IDS, level: int = 3):
        self.stream, self.most = stream, frame_ids * 4
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.nulls: list[bool] = []
        self.lens: list[int] = []

    def add(self, doc_id: int | None, coded: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lens.append(len(coded) // 4)
        if self.size and self.size + len(coded) > self.most:
            self._frame()
        for at in range(0, len(coded), self.most):
            part = coded[at : at + self.most]
            self.held.append(part)
            self.size += len(part)
            if self.size >= self.most:
                self._frame()

    def _frame(self) -> None:
        raw = b"".join(self.held)
        packed = self.zstd.compress(raw)
        self.stream.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._frame()
        index = self.zstd.compress(
            struct.pack("<Q", len(self.ids)) + np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.lens, "<u8").tobytes()
        )
        self.stream.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        self.frames.append((len(index) + 8, 0, 0))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), HAS_CHECKSUMS, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)


class Reader:
    """Random access to an open seekable binary file."""

    def __init__(self, file, size: int):
        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.raw, self.sums = table.T
        self.where = np.cumsum(self.packed) - self.packed
        self.upto = np.cumsum(self.raw)
        index = self.zstd.decompress(self._at(int(self.where[-1]) + 8, int(self.packed[-1]) - 8))
        (docs,) = struct.unpack("<Q", index[:8])
        ids = np.frombuffer(index, "<i8", docs, 8)
        nulls = np.frombuffer(index, "u1", docs, 8 + 8 * docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, nulls, strict=True)]
        self.lens = np.frombuffer(index, "<u8", docs, 8 + 9 * docs).astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.last = (-1, b"")

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            raw = self.zstd.decompress(self._at(int(self.where[k]), int(self.packed[k])), int(self.raw[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self.last = (k, raw)
        return self.last[1]

    def document(self, k: int) -> bytes:
        """The ids of the k-th document; only frames that hold some of them are read."""
        at, end = int(self.starts[k]) * 4, int(self.starts[k] + self.lens[k]) * 4
        out, f = [], int(np.searchsorted(self.upto, at, "right"))
        while at < end:
            base = int(self.upto[f] - self.raw[f])
            out.append(self.frame(f)[at - base : end - base])
            at, f = int(self.upto[f]), f + 1
        return b"".join(out)


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """A path's store and its name there; Hadoop's names of S3 stand for the store's own."""
    for name in ("s3a://", "s3n://"):
        path = f"s3://{path.removeprefix(name)}" if path.startswith(name) else path
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def _put(store: fs.FileSystem, draft: str, name: str) -> None:
    """Move a file to its place. Where a store refuses to replace one, it is another attempt's at the same rows and stays."""
    try:
        store.move(draft, name)
    except OSError:
        if store.get_file_info(name).type != fs.FileType.File:
            raise
        store.delete_file(draft)


def _sweep(path: str) -> None:
    """Delete drafts that lost executors left."""
    store, root = _file_system(path)
    for found in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if found.base_name.startswith("."):
            store.delete_file(found.path)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> list[tuple[str, int, int]]:
    """Write the ids of all texts in ascending doc_id order; (file, documents, ids) of each file in that order.

    Null ids come first; equal ids stand in the order of a hash of their texts. A file
    is written beside its place and moved there whole, so a task that runs twice
    leaves one file. The driver gets a row for each file, none for documents.
    """
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(path)
        part = TaskContext.get().partitionId()
        out, count, t = None, 0, tokens.tokenizer(vocabulary)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    draft = f"{root}/.{uuid.uuid4().hex}"
                    stream = store.open_output_stream(draft)
                    out = Writer(stream)
                coded = t.encode(text.as_py() or "") + end
                out.add(doc_id, coded)
                count += len(coded) // 4
        if out is not None:
            out.close()
            stream.close()
            _put(store, draft, f"{root}/part-{part:06d}.tok")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([len(out.ids)], pa.int64()), "n": pa.array([count], pa.int64())})

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
        .mapInArrow(write, "part int, docs long, n long")
        .collect()
    )
    _sweep(path)
    return [(f"{path}/part-{r['part']:06d}.tok", r["docs"], r["n"]) for r in sorted(rows, key=lambda r: r["part"])]


def read_token_files(spark, files: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """A row for each document of token files: doc_id, start, n_tokens, ids_crc32 (and the ids)."""
    base, rows = 0, []
    for path, _, n in files:
        rows.append((path, base))
        base += n
    todo = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, name = _file_system(path)
                with store.open_input_file(name) as file:
                    r = Reader(file, file.size())
                    step = 1000 if not with_ids else 50
                    for at in range(0, len(r.doc_ids), step):
                        ks = range(at, min(at + step, len(r.doc_ids)))
                        parts, sums = [], []
                        for k in ks:
                            coded = r.document(k)
                            sums.append(zlib.crc32(coded))
                            parts.append(np.frombuffer(coded, "<u4").astype(np.int32) if with_ids else None)
                        cols = [pa.array(r.doc_ids[at : ks.stop], pa.int64()), pa.array(r.starts[at : ks.stop] + first), pa.array(r.lens[at : ks.stop]), pa.array(sums, pa.int64())]
                        if with_ids:
                            cols.append(pa.array(parts, pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write token files (to the shared folder unless a path is given) and read them back."""
    spark = docs.sparkSession
    files = write_token_files(docs, path or fresh_path(spark, "tokens"), vocabulary, end_id)
    return read_token_files(spark, files)
