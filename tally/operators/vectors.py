"""Vectors and exact cosine retrieval.

D4 replaces the remote embedding call with a Spark-native vectorizer
(``RegexTokenizer`` + ``HashingTF`` + ``IDF`` + ``Normalizer``): hashing is
per row with no shuffle, and IDF fitting is one tree aggregate of a
``num_features`` vector.  A ``pandas_udf`` can be passed instead to bring a
model.

D5/D6 score every stored vector against a small, size-checked set of query
vectors.  The query matrix is shipped to the tasks once; stored vectors are
scored a sub-block at a time with one matrix product, and a row leaves the
task only if it can still be in a query's top-k: its score is not below the
k-th best already seen in that task (a threshold that only rises, ties
kept).  A final ``row_number() <= k`` (``WindowGroupLimit``) merges the
candidates, which is exact because no dropped row had k rows strictly
above it.  More queries than the limit stay a table and meet the vectors in a
grid of blocks, the same way within each cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ship_package, shuffle_partitions

# Retrieval sizes and the default vector width.
DEFAULT_TOP_K = 8
CALLER_TOP_K = 4
CALLER_KEEP = 3
VECTOR_WIDTH = 1536
QUERY_DECIMALS = 8
MAX_QUERIES_PER_BLOCK = 4096


def fit_text_vectorizer(df: DataFrame, text_col: str = "content", num_features: int = VECTOR_WIDTH,
                        min_doc_freq: int = 0):
    """D4 fit: tokenizer + hashing TF + IDF + L2 normalizer (IDF is one tree aggregate)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    tok = RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern=r"[^\p{L}\p{N}]+", toLowercase=True)
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features)
    idf = IDF(inputCol="__tf", outputCol="__idf", minDocFreq=min_doc_freq)
    norm = Normalizer(inputCol="__idf", outputCol="__vec", p=2.0)
    return Pipeline(stages=[tok, tf, idf, norm]).fit(df)


def apply_text_vectorizer(model, df: DataFrame, text_col: str = "content", out_col: str = "embedding") -> DataFrame:
    """D4 transform with a fitted vectorizer (per row, no shuffle): ``ARRAY<FLOAT>`` of unit length."""
    from pyspark.ml.functions import vector_to_array

    if text_col != model.stages[0].getInputCol():
        df = df.withColumnRenamed(text_col, model.stages[0].getInputCol())
    out = model.transform(df)
    return out.withColumn(out_col, vector_to_array("__vec", "float32")).drop("__tok", "__tf", "__idf", "__vec")


def text_vectors(
    df: DataFrame,
    text_col: str = "content",
    num_features: int = VECTOR_WIDTH,
    out_col: str = "embedding",
    min_doc_freq: int = 0,
) -> DataFrame:
    """Unit-length TF-IDF vectors of hashed word tokens, as ``ARRAY<FLOAT>``."""
    model = fit_text_vectorizer(df, text_col, num_features, min_doc_freq)
    return apply_text_vectorizer(model, df, text_col, out_col)


def embed_with(df: DataFrame, text_col: str, model_udf, out_col: str = "embedding") -> DataFrame:
    """D4 model slot: vectors from a user's pandas UDF (``Series[str] -> Series[list[float]]``),
    Arrow-batched; the rest of retrieval takes any ``ARRAY<FLOAT>`` column."""
    return df.withColumn(out_col, model_udf(F.col(text_col)).cast("array<float>"))


def round_vector(c, decimals: int = QUERY_DECIMALS) -> Column:
    """Query vector rounded to 8 decimals, as it is written into the query."""
    x = F.col(c) if isinstance(c, str) else c
    return F.transform(x.cast("array<double>"), lambda v: F.round(v, decimals))


def cosine(a, b) -> Column:
    """Cosine similarity of two array columns in double; NULL for a zero vector."""
    a = (F.col(a) if isinstance(a, str) else a).cast("array<double>")
    b = (F.col(b) if isinstance(b, str) else b).cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.try_divide(dot, na * nb)


def centroids(df: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group (element-wise), e.g. one query per label."""
    exploded = df.select(group_col, F.posexplode(F.col(vec_col).cast("array<double>")).alias("__i", "__x"))
    means = exploded.groupBy(group_col, "__i").agg(F.avg("__x").alias("__m"))
    return means.groupBy(group_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("centroid")
    )


def _ship(spark, value):
    """Send a bounded value to the tasks once: a broadcast variable, or (without
    an RDD context, e.g. Spark Connect) the function closure, which Spark
    also broadcasts when it is large."""
    try:
        bc = spark.sparkContext.broadcast(value)
        return lambda: bc.value
    except Exception:
        return lambda: value


# Score-matrix cells per sub-block (rows x queries), about 32 MB of doubles.
SCORE_CELLS = 4_000_000


def _candidates(scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) pairs that can still be in a query's top-k.

    Tie-inclusive: a row is dropped only when at least k rows already score
    strictly higher (its score is below the k-th largest of this block, or
    below ``floor``, the best k-th largest seen in earlier blocks).  NaN
    (zero vector) counts as lowest.  ``floor`` is raised in place.
    """
    filled = np.where(np.isnan(scores), -np.inf, scores)
    m = filled.shape[0]
    if m >= k:
        kth = np.partition(filled, m - k, axis=0)[m - k]
        np.maximum(floor, kth, out=floor)
    rows, cols = np.nonzero(filled >= floor[None, :])
    return rows, cols


#: Candidates a task keeps before it emits them.
HELD_ROWS = 500_000


def _best(frames: list[pd.DataFrame], by: list[str], id_col: str, k: int) -> pd.DataFrame:
    """The k best of each query and group; of equal scores the least ids, so copies don't leave the task."""
    rows = pd.concat(frames, ignore_index=True)
    order = rows.sort_values(["score", id_col], ascending=[False, True], na_position="last", kind="stable")
    return order.groupby(by, dropna=False, sort=False).head(k)


def _nullable(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.assign(score=frame["score"].astype(object).where(frame["score"].notna(), None))


def _matrix(pdf: pd.DataFrame, vec_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their lengths."""
    mat = np.stack(pdf[vec_col].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
    return mat, np.linalg.norm(mat, axis=1)


def _score_rows(mat, norms, ids, parts, block, floors, k, id_col, partition_col) -> list[pd.DataFrame]:
    """Candidates of some vectors for the query block; ``floors`` are raised in place."""
    q_ids, q_unit = block
    q = q_unit.shape[0]
    step = max(1, SCORE_CELLS // max(q, 1))
    found: list[pd.DataFrame] = []
    for lo in range(0, len(ids), step):
        hi = min(lo + step, len(ids))
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (mat[lo:hi] @ q_unit.T) / norms[lo:hi, None]
        groups = [(None, np.arange(hi - lo))] if parts is None else [
            (g, np.flatnonzero(parts[lo:hi] == g)) for g in pd.unique(parts[lo:hi])
        ]
        for g, sel in groups:
            floor = floors.setdefault(g, np.full(q, -np.inf))
            r, c = _candidates(s[sel], k, floor)
            rows = sel[r] + lo
            out = {"query_id": [q_ids[j] for j in c]}
            if partition_col:
                out[partition_col] = parts[rows]
            out[id_col] = ids[rows]
            found.append(pd.DataFrame(out).assign(score=s[sel[r], c]))
    return found


def _score_task(it, get_block, k, id_col, vec_col, partition_col):
    """Score one task's vectors against the query block; emit candidates only."""
    block = get_block()
    floors: dict = {}
    by = ["query_id"] + ([partition_col] if partition_col else [])
    held: list[pd.DataFrame] = []
    for pdf in it:
        if pdf.empty:
            continue
        parts = pdf[partition_col].to_numpy() if partition_col else None
        held += _score_rows(*_matrix(pdf, vec_col), pdf[id_col].to_numpy(), parts, block, floors, k, id_col, partition_col)
        held = [_best(held, by, id_col, k)]
        if len(held[0]) > HELD_ROWS:  # many groups: what is known so far goes out
            yield _nullable(held.pop())
    if held:
        yield _nullable(held.pop())


def _unit_block(rows) -> tuple[list, np.ndarray]:
    """Ids of (id, vector) rows and their vectors at unit length."""
    rows = list(rows)
    matrix = np.array([np.asarray(r[1], dtype=np.float64) for r in rows]).reshape(len(rows), -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return [r[0] for r in rows], matrix / np.linalg.norm(matrix, axis=1)[:, None]


#: Bytes of one side of a grid's cell, its vectors as doubles (65,536 vectors of 64).
SIDE_BYTES = 32 << 20
#: Pairs that are worth a cell of their own.
CELL_PAIRS = 1 << 20


def grid_sides(n_rows: int, n_queries: int, dims: int, tasks: int) -> tuple[int, int]:
    """Slices of the vectors and blocks of the queries.

    A vector is shuffled once for each block and a query once for each slice, so
    there are as few of both as memory and ``tasks`` cells allow, parted so that
    the copies are fewest.
    """
    most = max(1, SIDE_BYTES // (8 * max(dims, 1)))
    cells = max(1, min(tasks, -(-n_rows * n_queries // CELL_PAIRS)))
    blocks = max(1, -(-n_queries // most), min(cells, round((cells * n_queries / max(n_rows, 1)) ** 0.5)))
    return max(1, -(-n_rows // most), -(-cells // blocks)), blocks


def rows_and_width(vectors: DataFrame, vec_col: str) -> tuple[int, int]:
    n, dims = vectors.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    return n, max(dims or 0, 1)


def _grid(base, asked, n_queries, max_queries, schema, k, id_col, vec_col, partition_col) -> DataFrame:
    """Candidates of many queries: slices of the vectors meet blocks of the queries, each pair of them once.

    Both are dealt by a hash, so a cell holds a slice and a block and no more; ``max_queries`` of the block are scored at a time, and no query passes the driver.
    """
    n_rows, dims = rows_and_width(base, vec_col)
    slices, blocks = grid_sides(n_rows, n_queries, dims, shuffle_partitions(base.sparkSession))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.withColumn("__cell", F.pmod(F.xxhash64(id_col), F.lit(slices)).cast("int")).withColumn("__block", each(blocks))
    right = asked.withColumn("__block", F.pmod(F.xxhash64("__qid"), F.lit(blocks)).cast("int")).withColumn("__cell", each(slices))
    names = schema.fieldNames()
    by = ["query_id"] + ([partition_col] if partition_col else [])

    def run(key, pdf, queries):
        if pdf.empty or queries.empty:
            return pd.DataFrame({n: [] for n in names})
        mat, norms = _matrix(pdf, vec_col)
        ids, parts = pdf[id_col].to_numpy(), pdf[partition_col].to_numpy() if partition_col else None
        out = []
        for lo in range(0, len(queries), max_queries):
            part = queries.iloc[lo : lo + max_queries]
            block = _unit_block(zip(part["__qid"].tolist(), part["__qvec"].tolist()))
            out.append(_nullable(_best(_score_rows(mat, norms, ids, parts, block, {}, k, id_col, partition_col), by, id_col, k)))
        return pd.concat(out, ignore_index=True)[names]

    return left.groupBy("__cell", "__block").cogroup(right.groupBy("__cell", "__block")).applyInPandas(run, schema)


def cosine_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_TOP_K,
    id_col: str = "id",
    vec_col: str = "embedding",
    query_id_col: str = "query_id",
    query_vec_col: str = "query_vec",
    partition_col: str | None = None,
    max_queries_per_block: int = MAX_QUERIES_PER_BLOCK,
) -> DataFrame:
    """Exact top-k stored vectors per query (per ``partition_col`` too).

    Output: ``query_id, [partition], id, score, rank``.  Score is
    ``1 - cosine distance`` in double; a zero vector scores NULL and ranks
    last.  The queries are counted first: up to ``max_queries_per_block`` of
    them go to every task, so that vectors stay where they are; more of them
    stay a table and meet the vectors in a grid of blocks.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    n_queries = queries.count()
    id_type = vectors.schema[id_col].dataType
    qid_type = queries.schema[query_id_col].dataType
    fields = [T.StructField("query_id", qid_type)]
    if partition_col:
        fields.append(T.StructField(partition_col, vectors.schema[partition_col].dataType))
    fields += [T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())]
    cand_schema = T.StructType(fields)
    sel = [id_col, vec_col] + ([partition_col] if partition_col else [])
    base = vectors.select(*sel)

    asked = queries.select(F.col(query_id_col).alias("__qid"), F.col(query_vec_col).alias("__qvec"))
    if not n_queries:  # no query: no hit
        cands = spark.createDataFrame([], cand_schema)
    elif n_queries > max_queries_per_block:
        cands = _grid(base, asked, n_queries, max_queries_per_block, cand_schema, k, id_col, vec_col, partition_col)
    else:
        block_data = _ship(spark, _unit_block(asked.orderBy("__qid").collect()))  # at most max_queries_per_block rows
        cands = base.mapInPandas(lambda it: _score_task(it, block_data, k, id_col, vec_col, partition_col), cand_schema)
    keys = ["query_id"] + ([partition_col] if partition_col else [])
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), F.col(id_col).asc())
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def label_centroid_queries(embeddings: DataFrame, group_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Query vectors derived from the table: one rounded centroid per group."""
    c = centroids(embeddings, group_col, vec_col)
    return c.select(F.col(group_col).alias("query_id"), round_vector("centroid").alias("query_vec"))


__all__ = [
    "text_vectors", "round_vector", "cosine", "centroids", "cosine_top_k", "label_centroid_queries",
    "CALLER_TOP_K", "CALLER_KEEP",
]

