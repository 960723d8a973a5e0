"""Hard negatives of labelled vectors, found through rotated one-bit codes.

Index: every vector v is turned by a fixed random rotation; its code keeps the
sign of each turned component, one bit each.  With x the unit vector that the
signs stand for, the index stores v's length and its alignment <x, v/|v|> with
its own code.  A query's turned components are rounded to ``PLANES`` bits, so
that <x, q> comes from population counts of the code and the query's bit planes.

Interval: v/|v| is alignment * x and a rest at right angles to x, and so is
the query, so by Cauchy and Schwarz their inner product is alignment * s give
or take sqrt(1 - alignment**2) * sqrt(1 - s**2), with s = <x, q>/|q|; s itself
is known up to the length of the query's rounding error.  No vector outside an
interval's reach is lost; those whose interval may hold are scored in integers.

Searches run in a grid: rows dealt over cells by a hash of their number,
queries in blocks of at most ``BLOCK``; a cell meets one slice of the rows with one block and keeps
the best of each query.  What cells kept is ranked by a window that drops
all but the best before its shuffle.  Nothing goes through the driver and no
group holds more than a slice and a block.

Defined results: rows with a null label, a null vector, any null or non-finite
component or one of ``LIMIT`` or more (its products would pass 64 bits) take no
part; of vectors of different lengths the shorter is filled up with zeros; a
zero vector scores 0; repeated rows are different rows; a null vec_id is no
anchor and the last among ties; other columns are not read; no rows, no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir, shuffle_partitions, ship_package
from .memory import give_back

SCALE = 256
LIMIT = 2.0**17
PLANES = 6
#: Queries of a block, and rows of a slice.
BLOCK = 1024
SLICE = 16_384
#: Scores computed at a time.
_CELLS = 1 << 20
#: Estimates are floats: intervals are this much wider, in parts of the product of the lengths.
_SLACK = 1e-9
_NO_ID = np.iinfo(np.int64).max

INDEX = "row long, vec_id long, label long, vector binary, code binary, length double, alignment double"


def rotation(dims: int, seed: int = 12) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows of 64-bit words), lengths and alignments."""
    dims = vectors.shape[1]
    turned = vectors.astype(np.float64) @ turn.T
    length = np.sqrt((turned * turned).sum(axis=1))
    bits = np.zeros((len(vectors), -(-dims // 64) * 64), dtype=np.uint8)
    bits[:, :dims] = turned > 0
    code = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    alignment = np.abs(turned).sum(axis=1) / (math.sqrt(dims) * np.maximum(length, 1e-300))
    return code, length, np.minimum(alignment, 1.0)


class Query:
    """A vector's bit planes and what their rounding may be off by."""

    def __init__(self, vector: np.ndarray, turn: np.ndarray):
        self.vector, self.dims = vector, len(vector)
        turned = turn @ vector.astype(np.float64)
        self.length = float(np.sqrt(turned @ turned))
        self.low = float(turned.min())
        self.step = max(float(turned.max()) - self.low, 1e-300) / ((1 << PLANES) - 1)
        steps = np.rint((turned - self.low) / self.step).astype(np.int64)
        self.off = float(np.linalg.norm(turned - (self.low + self.step * steps)))
        bits = np.zeros((PLANES, -(-self.dims // 64) * 64), dtype=np.uint8)
        for j in range(PLANES):
            bits[j, : self.dims] = steps >> j & 1
        self.planes = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        self.total = int(steps.sum())

    def interval(self, code: np.ndarray, ones: np.ndarray, length: np.ndarray, alignment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product with each coded vector."""
        if not self.length:
            return np.zeros(len(length)), np.zeros(len(length))
        met = np.zeros(len(length), dtype=np.int64)
        for j in range(PLANES):
            both = np.bitwise_count(code[:, 0] & self.planes[j, 0]).astype(np.int64)
            for k in range(1, code.shape[1]):
                both += np.bitwise_count(code[:, k] & self.planes[j, k])
            met += both << j
        # <x, q> for signs: twice the sum over set bits less the sum over all.
        dot = (2 * (self.low * ones + self.step * met) - (self.low * self.dims + self.step * self.total)) / math.sqrt(self.dims)
        s, off = dot / self.length, self.off / self.length + _SLACK
        least, most = np.maximum(s - off, -1.0), np.minimum(s + off, 1.0)
        # The bounds are reached at the ends of s or where their slope is zero: at s = alignment above, at -alignment below.
        rest = np.sqrt(np.maximum(0.0, 1 - alignment * alignment))
        side = lambda t: rest * np.sqrt(np.maximum(0.0, 1 - t * t))
        top = np.clip(alignment, least, most)
        bottom = np.clip(-alignment, least, most)
        scale, slack = length * self.length, _SLACK * length * self.length
        return scale * (alignment * bottom - side(bottom)) - slack, scale * (alignment * top + side(top)) + slack


class Slice:
    """Rows of the index in one cell."""

    def __init__(self, pdf: pd.DataFrame):
        self.row = pdf["row"].to_numpy(dtype=np.int64)
        self.ids = np.array([_NO_ID if x is None else int(x) for x in pdf["vec_id"].tolist()], dtype=np.int64)
        self.label = pdf["label"].to_numpy(dtype=np.int64)
        self.vectors = stacked(pdf["vector"].tolist())
        self.code = np.frombuffer(b"".join(pdf["code"]), dtype="<u8").reshape(len(pdf), -1)
        self.ones = np.bitwise_count(self.code).sum(axis=1, dtype=np.int64)
        self.length, self.alignment = pdf["length"].to_numpy(dtype=np.float64), pdf["alignment"].to_numpy(dtype=np.float64)

    def bounds(self, query: Query):
        return query.interval(self.code, self.ones, self.length, self.alignment)

    def scores(self, query: Query, at: np.ndarray) -> np.ndarray:
        return self.vectors[at] @ query.vector

    def best(self, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Places in ``at`` of the ``k`` first by score, then by id."""
        return np.lexsort((self.row[at], self.ids[at], -score))[:k]


def stacked(blobs: list[bytes]) -> np.ndarray:
    dims = len(blobs[0]) // 8 if blobs else 0
    return np.frombuffer(b"".join(blobs), dtype="<i8").reshape(len(blobs), dims)


def index(vectors: DataFrame) -> DataFrame:
    """Coded rows of ``vec_id``, ``label`` and ``embedding``; every row that takes part."""
    spark = vectors.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("label").isNotNull() & F.col("e").isNotNull()).where(F.forall("e", finite))
    rows = rows.select("vec_id", "label", F.transform("e", lambda x: F.floor(SCALE * x)).alias("v"))
    dims = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    turn = rotation(dims)

    def run(batches):
        for pdf in batches:
            found = np.zeros((len(pdf), dims), dtype="<i8")
            for k, v in enumerate(pdf["v"]):
                found[k, : len(v)] = v
            code, length, alignment = encode(found, turn)
            yield pd.DataFrame({
                "row": pdf["row"], "vec_id": pd.array([None if x is None else int(x) for x in pdf["vec_id"]], dtype="Int64"), "label": pdf["label"],
                "vector": [x.tobytes() for x in found], "code": [x.tobytes() for x in code], "length": length, "alignment": alignment})

    numbered = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("vec_id", F.col("vec_id").cast("string"))
    return numbered.mapInPandas(run, INDEX).checkpoint()


def _grid(rows: DataFrame, queries: DataFrame, slices: int, blocks: int, search, schema: str) -> DataFrame:
    """``search(slice, query rows)`` for every slice of the rows and every block of the queries."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Nullable ids stay whole numbers on their way through pandas.
    left = rows.withColumn("vec_id", F.col("vec_id").cast("string")).withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")).withColumn("block", spread(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")).withColumn("cell", spread(slices))

    def run(key, pdf, asked):
        out = []
        if len(pdf) and len(asked):
            found = Slice(pdf)
            turn = rotation(found.vectors.shape[1])
            for q in asked.sort_values("anchor").itertuples(index=False):
                out += search(found, Query(np.frombuffer(q.asked_vector, dtype="<i8").astype(np.int64), turn), q)
        give_back()
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")], dtype=object).astype("Int64")

    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(run, schema)


def _same_label(k: int):
    """Of each slice the first ``k`` other rows with the anchor's label."""

    def search(rows: Slice, query: Query, q):
        at = np.flatnonzero((rows.label == q.asked_label) & (rows.row != q.anchor))
        if len(at) > k:
            low, high = (b[at] for b in rows.bounds(query))
            # No row that stays below k others can be among the first k.
            at = at[high >= np.partition(low, -k)[-k]]
        score = rows.scores(query, at)
        kept = rows.best(at, score, k)
        return [(q.anchor, _id(rows.ids[i]), int(s)) for i, s in zip(at[kept].tolist(), score[kept].tolist())]

    return search


def _id(x: int):
    return None if x == _NO_ID else int(x)


def _in_range(k: int, low_share: int, high_share: int):
    """Of each slice, for each positive score p of an anchor, the first ``k`` rows of other labels whose
    score s has low_share * p <= 100 * s <= high_share * p."""

    def search(rows: Slice, query: Query, q):
        other = np.flatnonzero(rows.label != q.asked_label)
        low, high = (b[other] for b in rows.bounds(query))
        out, known = [], {}
        for p in sorted(set(map(int, q.scores))):
            least, most = -(-low_share * p // 100), high_share * p // 100
            if least > most:
                continue
            may = (high >= least) & (low <= most)
            sure = (low >= least) & (high <= most)
            if sure.sum() > k:
                may &= high >= np.partition(low[sure], -k)[-k]
            at = other[may]
            new = [i for i in at.tolist() if i not in known]
            known.update(zip(new, rows.scores(query, np.array(new, dtype=np.int64)).tolist()))
            score = np.array([known[i] for i in at.tolist()], dtype=np.int64)
            fits = (score >= least) & (score <= most)
            at, score = at[fits], score[fits]
            kept = rows.best(at, score, k)
            out += [(q.anchor, p, _id(rows.ids[i]), int(s)) for i, s in zip(at[kept].tolist(), score[kept].tolist())]
        return out

    return search


def mine(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, low_share: int = 30, high_share: int = 90) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label the first ``negatives`` of other
    labels with a score of ``low_share`` to ``high_share`` per cent of the positive's."""
    rows = index(vectors)
    asked = rows.where(anchors).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("asked_label"), F.col("vector").alias("asked_vector")).checkpoint()
    n_rows, n_asked = rows.count(), asked.count()
    slices = max(1, -(-n_rows // SLICE), min(shuffle_partitions(rows.sparkSession), -(-n_rows // 256)))
    blocks = max(1, -(-n_asked // BLOCK))
    order = lambda key, score, vec: Window.partitionBy(*key).orderBy(F.desc(score), F.asc_nulls_last(vec))
    near = _grid(rows, asked.drop("anchor_id"), slices, blocks, _same_label(positives), "anchor long, positive_id long, positive_score long")
    near = near.withColumn("__k", F.row_number().over(order(["anchor"], "positive_score", "positive_id"))).where(F.col("__k") <= positives).checkpoint()
    scores = near.groupBy("anchor").agg(F.collect_set("positive_score").alias("scores"))
    hard = _grid(rows, asked.drop("anchor_id").join(scores, "anchor"), slices, blocks, _in_range(negatives, low_share, high_share),
                 "anchor long, positive_score long, negative_id long, negative_score long")
    hard = hard.withColumn("rank", F.row_number().over(order(["anchor", "positive_score"], "negative_score", "negative_id"))).where(F.col("rank") <= negatives)
    return near.join(hard, ["anchor", "positive_score"]).join(asked.select("anchor", "anchor_id"), "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
