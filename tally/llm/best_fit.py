"""Best-fit packing of token runs into sequences of a fixed length.

Every document becomes token ids plus an end id; one longer than a sequence
is cut into whole sequences behind a first piece that may be shorter.  Pieces
(a few numbers each, no ids) are dealt over packers by a hash of their place,
and each packer runs bounded-space online best fit: at most ``open_bins``
sequences are open; a bitset whose bit ``f`` says that one with ``f`` free
places is open finds the fullest that fits; when a new one is needed and all
are taken, the fullest closes first.  Packers are few (one for so many
pieces), since each leaves its last open sequences partly filled.

Defined results: null or empty text is the end id alone; equal documents are
packed one by one; an empty table gives no pieces; other columns are not read.
Any text length works: a document's ids are cut, never dropped.
"""

from __future__ import annotations

import os
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from .memory import give_back
from .tokens import encoder

SEQUENCE = 1024
OPEN_BINS = 8192
#: Pieces for one packer.
PIECES_PER_PACKER = 250_000
#: Texts, and characters of them, encoded at a time.
BATCH_TEXTS, BATCH_CHARS = 4096, 4_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_file(name: str) -> str:
    """A vocabulary of the public tokenizers' folder (``TOKENIZERS_DIR`` names another)."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(n: int, size: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: the first may be short."""
    first = (n - 1) % size + 1
    return [first] + [size] * ((n - first) // size)


def text_batches(batches):
    """(doc_ids, texts) of so many characters, or one longer text, out of Arrow batches of both; ids stay whole numbers beside nulls."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).tolist()):
            text = text or ""
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= BATCH_CHARS or len(texts) >= BATCH_TEXTS:
                yield ids, texts
                ids, texts, size = [], [], 0
        if texts:
            yield ids, texts


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int = SEQUENCE) -> DataFrame:
    """One row for each piece of every document."""
    import pyarrow as pa

    ship_package(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = encoder(tokenizer_file(vocabulary), keeps_spaces=True)
        for doc_ids, texts in text_batches(batches):
            out = []
            for doc_id, ids in zip(doc_ids, enc.ids(texts)):
                ids += end
                start = 0
                for k, n in enumerate(cut(len(ids) // 4, size)):
                    out.append((doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64() if k != 1 else pa.int32()) for k, c in enumerate(zip(*out))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths, size: int = SEQUENCE, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in arrival order."""
    bins: list[list[int]] = [[] for _ in range(size + 1)]  # open bins by free places
    mask, n_open, serial = 0, 0, 0
    where, offset = [], []
    for n in lengths:
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = bins[free].pop()
            if not bins[free]:
                mask &= ~(1 << free)
            n_open -= 1
        else:
            if n_open == open_bins and n < size:
                fullest = (mask & -mask).bit_length() - 1
                bins[fullest].pop()
                if not bins[fullest]:
                    mask &= ~(1 << fullest)
                n_open -= 1
            b, free, serial = serial, size, serial + 1
        where.append(b)
        offset.append(size - free)
        free -= n
        if free:
            bins[free].append(b)
            mask |= 1 << free
            n_open += 1
    return where, offset


def pack(docs: DataFrame, vocabulary: str, end_id: int, size: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = pieces(docs, vocabulary, end_id, size).checkpoint()
    packers = rows.count() // PIECES_PER_PACKER + 1
    # Copies of a document share a doc_id only in broken tables; their crc keeps the order defined.
    rows = rows.withColumn("__h", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("__g", F.pmod("__h", F.lit(packers)))
    # Nullable ids stay whole numbers on their way through pandas.
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))

    def run(key, pdf):
        pdf = pdf.sort_values(["__h", "doc_id", "piece"], kind="stable", ignore_index=True)
        where, offset = best_fit(pdf["length"].tolist(), size, open_bins)
        pdf["sequence_id"] = [(int(key[0]) << 40) + b for b in where]
        pdf["offset"] = offset
        return pdf.drop(columns=["__h", "__g"])

    return rows.groupBy("__g").applyInPandas(run, PIECES.replace("doc_id long", "doc_id string") + ", sequence_id long, offset long").withColumn("doc_id", F.col("doc_id").cast("long"))
