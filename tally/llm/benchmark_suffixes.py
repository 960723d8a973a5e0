"""Benchmark decontamination by suffix arrays over shards of the documents.

Each shard (one batch of a task's documents) gets a suffix array of its words,
and every benchmark suffix is binary-searched in it.  The benchmark is the
stated query set, taken in blocks of bounded size; a block's words become
numbers, a document word outside the block's vocabulary is a break that no
match crosses.  Suffixes are compared as fixed-width big-endian keys of
``window`` words, so a window's occurrences are one range of the array, and a
suffix whose match reaches the window is followed further on to its longest
verbatim match.  A suffix too near a break for the shortest window can't match
and stays out of the array.

Nothing is shuffled: blocks go to the shards, each by a broadcast of at most
``BLOCK_CHARS`` characters of benchmark text, and every block is one more pass.

Defined results: null or wordless items have no window; null text has no words
and no hit; repeated rows are judged one by one; repeated items all count; an
empty benchmark leaves every document clean; columns named like a result give
way to it, others pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .memory import give_back
from .tokens import forget

WINDOW = 10
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 8_000_000
#: Bytes of text that make one shard's suffix array.
SHARD_BYTES = 4_000_000

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of letters, digits and anything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Block:
    """Part of the benchmark: vocabulary, items as word numbers (from 1; 0 is the break)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str] = []
        numbers, item_of, place_ends = [], [], []
        for item_id, text in items:
            w = words(text)
            if not w:
                continue
            numbers += [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w] + [0]
            item_of += [len(self.ids)] * (len(w) + 1)
            place_ends += [len(w)] * (len(w) + 1)
            self.ids.append(item_id)
        self.text = np.array(numbers + [0] * window, dtype=np.uint32)
        self.item = np.array(item_of, dtype=np.int64)
        size = np.array(place_ends, dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, self.item[1:] != self.item[:-1]]) if len(self.item) else np.zeros(0, np.int64)
        at = np.arange(len(self.item)) - np.repeat(starts, np.diff(np.r_[starts, len(self.item)])) if len(self.item) else np.zeros(0, np.int64)
        self.need = np.minimum(size, window)  # words of the item's windows
        self.queries = np.flatnonzero(at + self.need <= size) if len(size) else np.zeros(0, np.int64)
        self.shortest = int(self.need.min()) if len(self.need) else window

    def keys(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Fixed-width keys of the ``window`` words from each place; words behind a break count as breaks."""
        k = text[at[:, None] + np.arange(self.window)]
        k = np.where(np.minimum.accumulate(k != 0, axis=1), k, 0)
        return np.ascontiguousarray(k.astype(">u4")).view(f"S{4 * self.window}").ravel()


def search(block: Block, docs: list[list[bytes]]) -> list[tuple[list[int], list[int], list[str], int]]:
    """For each document: hit runs (starts, ends), items with occurring windows, longest match in words."""
    out: list[tuple[list[int], list[int], list[str], int]] = [([], [], [], 0) for _ in docs]
    if not len(block.queries) or not docs:
        return out
    get, window = block.vocabulary.get, block.window
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    first = np.r_[0, np.cumsum(lengths + 1)]
    text = np.zeros(first[-1] + window, dtype=np.uint32)
    for d, at in zip(docs, first.tolist()):
        text[at : at + len(d)] = [get(w, 0) for w in d]
    # Words up to the next break; a suffix shorter than the shortest window is left out.
    stops = np.flatnonzero(text == 0)
    run = stops[np.searchsorted(stops, np.arange(first[-1]))] - np.arange(first[-1])
    suffixes = np.flatnonzero(run >= block.shortest)
    if not len(suffixes):
        return out
    keys = block.keys(text, suffixes)
    order = np.argsort(keys, kind="stable")
    suffixes, keys = suffixes[order], keys[order]
    q = block.keys(block.text, block.queries)
    need = block.need[block.queries]
    low = q.copy().view(np.uint8).reshape(len(q), -1)
    inside = np.arange(4 * window) < 4 * need[:, None]
    high = np.where(inside, low, 255).astype(np.uint8)
    low = np.where(inside, low, 0).astype(np.uint8)
    lo = np.searchsorted(keys, np.ascontiguousarray(low).view(q.dtype).ravel(), "left")
    hi = np.searchsorted(keys, np.ascontiguousarray(high).view(q.dtype).ravel(), "right")
    n = hi - lo
    if not n.sum():
        return out
    # Every occurrence: place in the shard, query, words.
    which = np.repeat(np.arange(len(q)), n)
    place = suffixes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    doc = np.searchsorted(first, place, "right") - 1
    size = need[which]
    # Cover by the words hit.
    mark = np.zeros(first[-1] + 1, dtype=np.int64)
    np.add.at(mark, place, 1)
    np.add.at(mark, place + size, -1)
    hit = (np.cumsum(mark)[:-1] > 0).astype(np.int8)
    edge = np.diff(np.r_[0, hit, 0])
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for d, a, b in zip((np.searchsorted(first, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist()):
        out[d][0].append(a - int(first[d]))
        out[d][1].append(b - int(first[d]))
    pairs = np.unique(np.stack([doc, block.item[block.queries[which]]]), axis=1)
    for d, i in pairs.T.tolist():
        out[d][2].append(block.ids[i])
    # Longest match: windows of one item that follow each other at the same distance.
    shift = place - block.queries[which]
    by = np.lexsort((place, shift, doc))
    p, s, d = place[by], shift[by], doc[by]
    new = np.r_[True, (p[1:] != p[:-1] + 1) | (s[1:] != s[:-1]) | (d[1:] != d[:-1])]
    heads = np.flatnonzero(new)
    longest = np.diff(np.r_[heads, len(p)]) - 1 + size[by][heads]
    for k, m in zip(d[heads].tolist(), longest.tolist()):
        if m > out[k][3]:
            out[k] = (*out[k][:3], m)
    return out


def _blocks(benchmark: DataFrame, window: int, block_chars: int):
    """The benchmark in order, block after block; the driver holds one at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").orderBy("item_id", "text").toLocalIterator():
        held.append((r[0] or "", r[1]))
        size += len(r[1] or "")
        if size >= block_chars:
            yield Block(held, window)
            held, size = [], 0
    if held:
        yield Block(held, window)


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()),
])


def _finder(spark, block: Block | None):
    shared = spark.sparkContext.broadcast(block)

    @F.pandas_udf(_FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        forget()
        block, rows, held, size = shared.value, [], [], 0

        def flush():
            found = search(block, held) if block else [([], [], [], 0)] * len(held)
            rows.extend((len(w), *f) for w, f in zip(held, found))

        for t in texts.tolist():
            held.append(words(t))
            size += len(t or "")
            if size >= SHARD_BYTES:
                flush()
                held, size = [], 0
        flush()
        held = []
        give_back()
        return pd.DataFrame(rows, columns=_FOUND.names)

    return find


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``matches``: n_words, hit runs ``starts``/``ends`` (words), ``items``, ``longest``."""
    spark = docs.sparkSession
    ship_package(spark)
    rows, passes = docs.drop("matches"), []
    for block in _blocks(benchmark, window, block_chars):
        passes.append(f"__found_{len(passes)}")
        rows = rows.withColumn(passes[-1], _finder(spark, block)(F.col("text").cast("string")))
    if not passes:
        passes = ["__found_0"]
        rows = rows.withColumn("__found_0", _finder(spark, None)(F.col("text").cast("string")))
    cols = [F.col(p) for p in passes]
    joined = lambda name: F.concat(*[c[name] for c in cols])
    longest = F.greatest(*[c["longest"] for c in cols]) if len(cols) > 1 else cols[0]["longest"]
    found = F.struct(
        cols[0]["n_words"].alias("n_words"), joined("starts").alias("starts"), joined("ends").alias("ends"),
        F.array_distinct(joined("items")).alias("items"), longest.alias("longest"))
    return rows.withColumn("matches", found).drop(*passes)


def n_hit(m: Column) -> Column:
    """Words in any hit run; runs of different blocks may overlap."""
    runs = F.sort_array(F.arrays_zip(m["starts"].alias("s"), m["ends"].alias("e")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(runs, zero, lambda a, r: F.struct(
        (a["n"] + F.greatest(r["e"] - F.greatest(r["s"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], r["e"]).alias("to")))["n"]


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with their own columns."""
    rows = scan(docs.withColumnRenamed("matches", "__own_matches"), benchmark, window).where(F.size(F.col("matches")["starts"]) == 0)
    return rows.drop("matches").withColumnRenamed("__own_matches", "matches").select(*[F.col(f"`{c}`") for c in docs.columns])

