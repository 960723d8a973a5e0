"""Approximate cosine top-k (D8): an index of random hyperplanes, exact re-ranking.

Each of ``tables`` tables cuts space with ``bits`` random planes; a vector's
code in a table is the signs of its products with them.  The index holds one
row for each vector and table.  A query looks up its own code and, in order of
how near it lies to the planes, the codes with the least sure signs turned
over, ``probes`` codes in each table.  Vectors met in any table are candidates
and their cosine is computed exactly, so only the candidate set is approximate.

Index, vectors and queries are tables: slices of the first two, dealt by a hash
of the id, meet blocks of the queries.  In such a cell a query's codes lead to
the ids under them, and the best of those leave the cell with their number, so
pairs of queries and vectors never become rows.  Nothing is collected, and a
crowded code is dealt over all slices.

Defined results: vectors or queries that are null, empty or zero have no code
and no hits; ties by id; repeated rows are hits each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ship_package, shuffle_partitions
from .vectors import grid_sides, rows_and_width

TABLES, BITS, PROBES = 20, 10, 24


def planes(dims: int, tables: int, bits: int, seed: int = 8) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dims))


def _flips(bits: int, probes: int) -> list[tuple[int, ...]]:
    """Places of the surest-last signs to turn over, fewest and least sure first."""
    return sorted((c for n in range(bits + 1) for c in combinations(range(bits), n)), key=lambda c: (sum(k + 1 for k in c), c))[:probes]


def _keys(matrix: np.ndarray, tables: int, bits: int, probes: int) -> np.ndarray:
    """Keys (table and code in one number) under which each row stands, and its ``probes - 1`` nearest in each table."""
    side = np.einsum("tbd,nd->ntb", planes(matrix.shape[1], tables, bits), matrix)
    code = ((side > 0).astype(np.int64) << np.arange(bits)).sum(axis=2)
    sure = np.argsort(np.abs(side), axis=2)
    found = [code]
    for flip in _flips(bits, probes)[1:]:
        turned = code.copy()
        for k in flip:
            turned ^= 1 << sure[:, :, k]
        found.append(turned)
    return (np.stack(found, axis=1) + (np.arange(tables) << bits)).reshape(len(matrix), -1)


def _usable(c: str):
    return F.coalesce((F.size(c) > 0) & F.exists(c, lambda x: x != 0), F.lit(False))


def _whole(c: str):
    return ~F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False))


def _indexed(vectors: DataFrame, id_col: str, vec_col: str, tables: int, bits: int) -> DataFrame:
    """``id, __v, __keys``: the keys of each usable vector."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(id_col, F.col(vec_col).cast("array<double>").alias("__v")).where(_usable("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, matrix in _by_width(batch.column(1)):
                keys = _keys(matrix, tables, bits, 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables), pa.array(keys.reshape(-1)))
                took = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), lists], names=[id_col, "__v", "__keys"])

    schema = T.StructType([vectors.schema[id_col], T.StructField("__v", T.ArrayType(T.DoubleType())), T.StructField("__keys", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema)


def _by_width(lists) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each width; null elements are NaN, null and empty lists left out."""
    import pyarrow.compute as pc

    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    width = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = []
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        out.append((at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)))
    return out


def lsh_index(vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding", tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """(id, lsh_table, lsh_code) of every vector; store it and pass it to ``approximate_top_k``."""
    key = _indexed(vectors, id_col, vec_col, tables, bits).select(id_col, F.explode("__keys").alias("__key"))
    return key.select(id_col, F.shiftright("__key", bits).alias("lsh_table"), F.col("__key").bitwiseAND(F.lit((1 << bits) - 1)).alias("lsh_code"))


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.add.accumulate(matrix * matrix, axis=1)[:, -1])


def _places(ids) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's id in ascending order (nulls alike, first), and a row of each number."""
    import pyarrow.compute as pc

    order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_start").to_numpy().astype(np.int64)
    code = ids.take(pa.array(order)).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    at = np.empty(len(order), dtype=np.int64)
    at[order] = code
    return at, order[np.unique(code, return_index=True)[1]]


#: Queries of a cell scored at a time, in (vector, query) pairs.
PAIRS = 4_000_000
#: By how much a product of matrices may miss a score of summing in order.
SLACK = 1e-9


def _search(stored, asked, k: int, tables: int, bits: int, probes: int):
    """Hits of one cell: rows of queries and vectors, scores; and per query the number of ids met.

    ``stored``: id, vector, keys; ``asked``: query id, vector, usable, whole.  Ids met
    under any key of a query are its candidates, and all rows of them are scored.
    """
    at, id_rows = _places(stored.column(0))
    n_ids = len(id_rows)
    no_id = ~np.asarray(stored.column(0).is_valid())
    lists = stored.column(2).combine_chunks()
    counts = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, dtype=np.int64)
    keys = lists.flatten().to_numpy(zero_copy_only=False)
    holder = np.repeat(at, counts)
    order = np.argsort(keys, kind="stable")
    keys, holder = keys[order], holder[order]
    q_at, q_rows = _places(asked.column(0))
    n_q = len(q_rows)
    usable, whole = np.asarray(asked.column(2)), np.asarray(asked.column(3))
    probe = [[] for _ in range(n_q)]
    q_groups = _by_width(asked.column(1))
    for rows, matrix in q_groups:
        for r, ks in zip(rows[usable[rows]], _keys(matrix[usable[rows]], tables, bits, probes)):
            probe[q_at[r]].append(ks)
    sides = {m.shape[1]: (rows, m) for rows, m in _by_width(stored.column(1))}
    scorable = {}
    for w, (rows, m) in sides.items():
        keep = ~no_id[rows]
        rows, m = rows[keep], m[keep]
        n = _norms(m)
        with np.errstate(divide="ignore", invalid="ignore"):
            scorable[w] = (rows, m, n, m / n[:, None], at[rows])
    met = np.zeros(n_q, dtype=np.int64)
    found = []  # query row, stored row, score
    for rows, matrix in q_groups:
        w = matrix.shape[1]
        v_rows, m, norms, unit, ids = scorable.get(w, (np.zeros(0, dtype=np.int64), np.zeros((0, w)), np.zeros(0), np.zeros((0, w)), np.zeros(0, dtype=np.int64)))
        step = max(1, PAIRS // max(len(v_rows), 1))
        q_norms = _norms(matrix)
        for lo in range(0, len(rows), step):
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                near = (matrix[lo : lo + step] / q_norms[lo : lo + step, None]) @ unit.T
            for j, r in enumerate(rows[lo : lo + step].tolist()):
                if not probe[q_at[r]]:
                    continue
                wanted = np.unique(np.concatenate(probe[q_at[r]])) if len(probe[q_at[r]]) > 1 else probe[q_at[r]][0]
                begin, end = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
                seen = np.zeros(n_ids, dtype=bool)
                seen[np.concatenate([holder[i:e] for i, e in zip(begin.tolist(), end.tolist())])] = True
                met[q_at[r]] = seen.sum()
                cand = np.flatnonzero(seen[ids]) if whole[r] else np.zeros(0, dtype=np.int64)
                score = near[j, cand]
                if len(cand) > k:
                    kth = np.partition(score, len(cand) - k)[len(cand) - k]
                    cand = cand[~(score < kth - SLACK) if not np.isnan(kth) else np.isnan(score)]
                # As Spark's arithmetic sums, element by element.
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    both = norms[cand] * q_norms[lo + j]
                    exact = np.add.accumulate(m[cand] * matrix[lo + j], axis=1)[:, -1] / both if len(cand) else np.zeros(0)
                scored = both != 0
                cand, exact = cand[scored], exact[scored]
                best = np.lexsort((ids[cand], -np.where(np.isnan(exact), np.inf, exact)))[:k]
                found.append((np.full(len(best), r), v_rows[cand[best]], exact[best]))
    return found, q_rows, met


def approximate_top_k(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", query_id_col: str = "query_id",
    query_vec_col: str = "query_vec", index: DataFrame | None = None, tables: int = TABLES, bits: int = BITS, probes: int = PROBES,
) -> DataFrame:
    """``query_id, id, score, rank`` and ``candidates`` (vectors scored for the query), as exact search returns them but from candidates only."""
    spark = vectors.sparkSession
    ship_package(spark)
    doubles = "array<double>"
    no_keys, no_vector = F.array().cast("array<long>").alias("__keys"), F.lit(None).cast(doubles).alias("__v")
    # A score needs every element, so vectors with a null one only count.
    whole = F.when(_whole("__v"), F.col("__v")).alias("__v")
    if index is None:
        stored = _indexed(vectors, id_col, vec_col, tables, bits).select(id_col, whole, "__keys")
    else:
        key = F.shiftleft(F.col("lsh_table").cast("long"), bits).bitwiseOR(F.col("lsh_code").cast("long"))
        stored = vectors.select(id_col, F.col(vec_col).cast(doubles).alias("__v")).select(id_col, whole, no_keys).unionByName(
            index.select(id_col, key.alias("__key")).groupBy(id_col).agg(F.collect_set("__key").alias("__keys")).select(id_col, no_vector, "__keys"))
    asked = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vec_col).cast(doubles).alias("__q")).where(F.col("query_id").isNotNull())
    asked = asked.select("query_id", "__q", _usable("__q").alias("__usable"), _whole("__q").alias("__whole"))
    n_rows, dims = rows_and_width(vectors, vec_col)
    slices, blocks = grid_sides(n_rows, asked.count(), dims, shuffle_partitions(spark))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = stored.withColumn("__cell", F.pmod(F.xxhash64(id_col), F.lit(slices)).cast("int")).withColumn("__block", each(blocks))
    right = asked.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("__cell", each(slices))
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField(id_col, vectors.schema[id_col].dataType),
                           T.StructField("score", T.DoubleType()), T.StructField("__met", T.LongType())])

    def run(stored: pa.Table, asked: pa.Table) -> pa.Table:
        found, q_rows, met = _search(stored, asked, k, tables, bits, probes) if len(stored) and len(asked) else ([], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        q, v, score = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, dtype=t) for c, t in enumerate((np.int64, np.int64, np.float64)))
        # A row of no vector bears the number of a query's candidates in this cell.
        n = len(q_rows)
        ids = pa.concat_arrays([stored.column(0).take(pa.array(v)).combine_chunks(), pa.nulls(n, stored.schema.field(0).type)])
        return pa.table({
            "query_id": asked.column(0).take(pa.array(np.concatenate([q, q_rows]))), id_col: ids,
            "score": pa.array(np.concatenate([score, np.zeros(n)]), mask=np.arange(len(score) + n) >= len(score), from_pandas=False),
            "__met": pa.array(np.concatenate([np.zeros(len(q), dtype=np.int64), met])),
        })

    hits = left.select("__cell", "__block", id_col, "__v", "__keys").groupBy("__cell", "__block").cogroup(
        right.select("__cell", "__block", "query_id", "__q", "__usable", "__whole").groupBy("__cell", "__block")).applyInArrow(
        lambda stored, asked: run(stored.select([id_col, "__v", "__keys"]), asked.select(["query_id", "__q", "__usable", "__whole"])), schema)
    every = Window.partitionBy("query_id")
    ranked = hits.withColumn("candidates", F.sum("__met").over(every)).withColumn("rank", F.row_number().over(every.orderBy(F.col("score").desc_nulls_last(), F.asc(id_col))))
    return ranked.where(F.col("score").isNotNull() & (F.col("rank") <= k)).select("query_id", id_col, "score", "rank", "candidates")


def recall(found: DataFrame, exact: DataFrame, id_col: str = "id") -> DataFrame:
    """``query_id, wanted, hits, recall`` of approximate against exact hits."""
    hit = found.select("query_id", id_col, F.lit(1).alias("__hit")).distinct()
    return exact.join(hit, ["query_id", id_col], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("wanted"), F.count("__hit").alias("hits"), (F.count("__hit") / F.count(F.lit(1))).alias("recall"))
