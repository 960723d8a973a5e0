"""Token-id files of independent zstandard frames with a seek table.

One file per range of doc_id, in ascending order.  A frame holds the ids
(little-endian unsigned 32-bit) of some whole documents; a document longer
than a frame fills one alone.  Behind the frames stand two skippable frames
that any zstandard reader passes over:

* the document index: for each document its doc_id, frame, first byte within
  the frame's content and byte count, itself a zstandard frame;
* the seek table, last in the file: for each frame its compressed size,
  content size and content checksum (low 32 bits of XXH64), then the frame
  count, a descriptor byte and the magic number.

A reader takes the tail, then the index, then only the frames it needs.

Files are written beside their place under the task's attempt and renamed, so
a repeated or speculative task leaves one whole file.  The folder is one that
driver and executors share (``spark.checkpoint.dir`` by default).

Defined results: null or empty text is the end id alone; rows of one doc_id
are written one after the other, in the order of a hash of their text; null
doc_ids come first; no documents, no files; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir, ship_package, shuffle_partitions
from .best_fit import text_batches, tokenizer_file
from .memory import give_back
from .tokens import encoder

SEEK_MAGIC, SKIP_MAGIC = 0x8F92EAB1, 0x184D2A5E
#: Content bytes at which a frame closes.
FRAME_BYTES = 1 << 18
LEVEL = 3
_NO_ID = -(1 << 63)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _skippable(content: bytes) -> bytes:
    return struct.pack("<II", SKIP_MAGIC, len(content)) + content


class FrameWriter:
    """Writes documents' ids to an open file as they come; ``close`` adds the index and the seek table."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held: list[bytes] = []
        self.size = self.n_ids = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._flush()
        self.index.append((_NO_ID if doc_id is None else doc_id, len(self.frames), self.size, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        self.n_ids += len(ids) // 4

    def _flush(self) -> None:
        import xxhash

        content = b"".join(self.held)
        data = self.press.compress(content)
        self.out.write(data)
        self.frames.append((len(data), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        self.out.write(index := _skippable(self.press.compress(np.array(self.index, dtype="<i8").tobytes())))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        # The index's own size stands first, so the tail alone leads to it.
        self.out.write(_skippable(table + struct.pack("<III", len(index), 0, 0) + struct.pack("<IBI", len(self.frames) + 1, 0x80, SEEK_MAGIC)))


class FrameReader:
    """Reads documents of one file, decompressing only their frames."""

    def __init__(self, file):
        import zstandard

        self.file, self.un = file, zstandard.ZstdDecompressor()
        end = file.size()
        n, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the file")
        rows = [struct.unpack("<III", x) for x in struct.iter_unpack("12s", self._at(end - 9 - 12 * n, 12 * n)) for x in x]
        self.frames, index_size = rows[:-1], rows[-1][0]
        self.starts = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)]).tolist()
        index = self._at(end - 9 - 12 * n - 8 - index_size, index_size)
        self.index = np.frombuffer(self.un.decompress(index[8:]), dtype="<i8").reshape(-1, 4)
        self.open = (-1, b"")

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        import xxhash

        if self.open[0] != k:
            packed, size, checksum = self.frames[k]
            content = self.un.decompress(self._at(self.starts[k], packed), max_output_size=max(size, 1))
            if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {k} fails its checksum")
            self.open = (k, content)
        return self.open[1]

    def documents(self, doc_ids=None):
        """(doc_id, ids as bytes) of the wanted documents, or of all, in file order."""
        rows = self.index if doc_ids is None else self.index[np.isin(self.index[:, 0], list(doc_ids))]
        for doc_id, k, start, size in rows.tolist():
            yield (None if doc_id == _NO_ID else doc_id), self.frame(k)[start : start + size]


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, files: int | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write ``docs`` under ``folder``; one row per file: file, path, n_docs, n_ids."""
    import pyarrow as pa

    ship_package(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc, writer = encoder(tokenizer_file(vocabulary), keeps_spaces=False), None
        task = TaskContext.get()
        store, root = _store(folder)
        part = task.partitionId()
        name, temp = f"{root}/tokens-{part:06d}.zst", f"{root}/_attempt-{part:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        out = None
        for doc_ids, texts in text_batches(batches):
            if writer is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(temp)
                writer = FrameWriter(out, frame_bytes)
            for doc_id, ids in zip(doc_ids, enc.ids(texts)):
                writer.add(doc_id, ids + end)
        give_back()
        if writer is None:
            return
        writer.close()
        out.close()
        store.move(temp, name)
        yield pa.RecordBatch.from_pydict({"file": [part], "path": [f"{folder}/tokens-{part:06d}.zst"], "n_docs": [len(writer.index)], "n_ids": [writer.n_ids]})

    n = files or shuffle_partitions(docs.sparkSession)
    # The text's hash splits an id that very many rows share (or lack) over files, in the same order as the sort.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("__h"))
    rows = rows.repartitionByRange(n, "doc_id", "__h").sortWithinPartitions("doc_id", "__h").drop("__h")
    ensure_checkpoint_dir(docs.sparkSession)
    return rows.mapInArrow(run, "file long, path string, n_docs long, n_ids long").checkpoint()


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files of ``manifest``."""
    ship_package(spark)

    def run(batches):
        for pdf in batches:
            for path, before in zip(pdf["path"], pdf["before"]):
                store, name = _store(path)
                with store.open_input_file(name) as f:
                    out, start = [], int(before)
                    for doc_id, ids in FrameReader(f).documents():
                        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"], dtype=object).astype("Int64")

    # One row per file: the running sum sees the manifest alone, never documents.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", "path", before.cast("long").alias("before"))
    return files.repartition(shuffle_partitions(spark), "file").select("path", "before").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-frames-{uuid.uuid4().hex}"
    return read(spark, write(docs, folder, vocabulary, end_id))
