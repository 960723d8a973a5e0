"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half the 64-bit hashes of a
text's word shingles.  Two fingerprints link when at most ``radius`` bits
differ.  Candidates come from 2**(radius + 1) - 1 masks: bit ``i`` carries a
vector of radius + 1 bits, and mask ``v`` keeps the bits whose vector has odd
overlap with ``v``.  The vectors of any ``radius`` differing bits leave some
``v`` with even overlap with all of them, so every pair within the radius has
equal masked fingerprints in some table: nothing is lost.

Only distinct fingerprints are hashed, so copies cost one row.  A bucket gives
the links of a spanning forest, never all its pairs.  A bucket above
``MAX_BUCKET`` is split by blocks of the bits (of radius + 1 blocks one is
equal in every linked pair) and what is still too large is compared tile by
tile.  Components come from alternating star contractions, on disk each round.
Joins are merges: the planner takes a row's masked copies together for one row,
and rows for as small as the table's files, so it would broadcast millions of
them through the driver.

Defined results: a null or blank text has fingerprint zero and links like any
other; fewer words than a shingle are one shingle; null doc_ids never become a
component's id unless it has no other; extra columns are not read; no rows, no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from .memory import give_back
from .tokens import forget

SEED = 42
MAX_BUCKET = 4096
_CHUNK = 1 << 14


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of a whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(join(words[k : k + shingle]), SEED) for k in range(at, min(n, at + _CHUNK))], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int, *more: Column) -> DataFrame:
    """doc_id, ``more`` and ``fp`` of every row."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        forget()
        out = pd.Series([fingerprint(t, shingle) for t in texts.tolist()], dtype="int64")
        give_back()
        return out

    return docs.select("doc_id", *more, fp(F.col("text").cast("string")).alias("fp"))


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering masks, as signed 64-bit numbers; bit ``i`` carries the vector 1 + i mod (2**(radius+1) - 1)."""
    size = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, size + 1):
        m = sum(1 << i for i in range(bits) if ((1 + i % size) & v).bit_count() & 1)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (member, root) of a spanning forest of the fingerprints within the radius."""
    if len(fps) == 2:
        return [(int(fps[1]), int(fps[0]))] if (int(fps[0] ^ fps[1]) & (2**64 - 1)).bit_count() <= radius else []
    left, links = np.sort(fps), []
    while len(left) > 1:
        root, front, left = int(left[0]), [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count((left ^ front.pop()).view(np.uint64)) <= radius
            if near.any():
                front.extend(left[near])
                links += [(int(x), root) for x in left[near]]
                left = left[~near]
    return links


def _forests(groups: DataFrame, radius: int) -> DataFrame:
    """``groups`` has one array column of fingerprints."""

    def run(batches):
        for pdf in batches:
            links = [x for fps in pdf["fps"] for x in _forest(np.asarray(fps, dtype=np.int64), radius)]
            yield pd.DataFrame(list(dict.fromkeys(links)), columns=["u", "v"], dtype="int64")

    return groups.select("fps").mapInPandas(run, "u long, v long")


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)


def _merged(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join that is never broadcast, however small the planner takes either side for."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def links(distinct: DataFrame, radius: int, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within the radius; ``distinct``: one column ``fp``."""
    ship_package(distinct.sparkSession)
    table = F.array(*[F.lit(m).cast("long") for m in masks(radius)])
    keyed = distinct.select("fp", F.explode(F.transform(table, lambda m, t: F.struct(t.alias("t"), F.col("fp").bitwiseAND(m).alias("k")))).alias("b")).select("b.t", "b.k", "fp")
    # Most buckets hold one fingerprint: counts, combined before the shuffle, leave the others.
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = _merged(keyed, sizes, ["t", "k"]).checkpoint()
    small = _forests(_grouped(rows.where(F.col("n") <= max_bucket), ["t", "k"]), radius)
    large = rows.where(F.col("n") > max_bucket)
    if large.isEmpty():
        return small.distinct()
    blocks = np.array_split(np.arange(64), radius + 1)
    cut = F.array(*[F.lit(int(np.array([sum(1 << int(i) for i in b)], dtype=np.uint64).view(np.int64)[0])) for b in blocks])
    # The blocks alone cover the radius, so the table no longer matters.
    parts = large.select("fp").distinct().select("fp", F.explode(F.transform(cut, lambda m, j: F.struct(j.alias("j"), F.col("fp").bitwiseAND(m).alias("x")))).alias("b")).select("b.j", "b.x", "fp")
    parts = _merged(parts, parts.groupBy("j", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["j", "x"])
    middle = _forests(_grouped(parts.where(F.col("n") <= max_bucket), ["j", "x"]), radius)
    # Tiles of what is left: tile r meets every tile s >= r.
    tiles = F.ceil(F.col("n") / (max_bucket // 2)).cast("int")
    rest = parts.where(F.col("n") > max_bucket).withColumn("tiles", tiles).withColumn("r", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    rest = rest.select("j", "x", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda s: F.struct(F.least(s, F.col("r")).alias("lo"), F.greatest(s, F.col("r")).alias("hi")))).alias("p")).select("j", "x", "p.lo", "p.hi", "fp")
    tiled = _forests(_grouped(rest, ["j", "x", "lo", "hi"]), radius)
    return small.unionByName(middle).unionByName(tiled).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots; a root is its component's least node."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.where("u <> v").checkpoint()
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _merged(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _merged(down, least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct().checkpoint()
        # A forest of stars: every node has one link and no root is a member.
        n, members = small.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
        edges = small
        if n == members and _merged(small.select(F.col("v").alias("u")).distinct(), small.select("u"), "u", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """doc_id, ``fp`` and ``component_id`` (least doc_id reachable) of every row."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, shingle).checkpoint()
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = _rooted(nodes, radius)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return _merged(rows, _merged(rooted, ids, "root").select("fp", "component_id"), "fp")


def _rooted(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes``, one row for each ``fp``, with their component's ``root``."""
    named = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    return _merged(nodes, named, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """Of each component one row: the least doc_id (null last), then the least text digest; of rows equal in both, any."""
    ensure_checkpoint_dir(docs.sparkSession)
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = fingerprints(docs, shingle, digest.alias("digest")).checkpoint()
    nodes = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("first"))
    # Rows of one text are of one component, so doc_id and digest name no row of another.
    keep = _rooted(nodes, radius).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest"))
    keyed = docs.withColumn("__text_digest", digest)
    kept = _merged(keyed, keep, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__text_digest") == F.col("__digest")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text_digest"]).drop("__text_digest")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
