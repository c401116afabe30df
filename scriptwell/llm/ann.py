"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are rotated at random and assigned to the lists of centroids fitted on one half of a bounded
sample; the other half tells how many lists a query must probe for the recall wanted. There are about
as many lists as the square root of the rows, and every row is indexed. Within each probed list the
rotated vectors lie in blocks of columns. After each block a hypothesis test on the partial distance,
scaled to all dimensions, abandons candidates that are unlikely to beat the query's tenth best;
survivors get their exact distance on the original vectors. A list is scanned in parts of its rows by
blocks of its queries, both of bounded size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptwell.sources.workspace import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vec of the rows that take part: vectors without null or non-finite components and
    not all zero."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec")) \
        .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & nonzero)


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the sample by Lloyd's rounds, begun at distinct sample rows."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centroids = distinct[rng.choice(len(distinct), min(lists, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest_lists(distinct, centroids, 1)[:, 0]
        for i in range(len(centroids)):
            if (own := near == i).any():
                centroids[i] = distinct[own].mean(axis=0)
    return centroids


def nearest_lists(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first; rows are taken some thousand at a time."""
    n, found = min(n, len(centroids)), []
    for at in range(0, len(rows), 4_096):
        some = rows[at:at + 4_096]
        d = (centroids ** 2).sum(axis=1) - 2 * some @ centroids.T
        part = np.argpartition(d, n - 1, axis=1)[:, :n]
        order = np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable")
        found.append(np.take_along_axis(part, order, axis=1))
    return np.concatenate(found) if found else np.empty((0, n), np.int64)


def probes_needed(rows: np.ndarray, centroids: np.ndarray, k: int, recall: float,
                  queries: int = 256) -> int:
    """Nearest lists a query must probe to reach that share of its k nearest among rows.

    rows took no part in fitting the centroids. They lie less dense than the table they stand for,
    so their neighbours lie farther apart, in lists farther off, and the share is on the safe side.
    """
    if len(rows) <= 2 * k:
        return len(centroids)
    asked = np.linspace(0, len(rows) - 1, min(queries, len(rows))).astype(int)
    own = nearest_lists(rows, centroids, 1)[:, 0]
    order = nearest_lists(rows[asked], centroids, len(centroids))
    steps = []
    for q, lists in zip(asked, order, strict=True):
        far = ((rows - rows[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        position = np.empty(len(centroids), np.int64)
        position[lists] = np.arange(len(lists))
        steps.append(position[own[np.argpartition(far, k - 1)[:k]]])
    steps = np.sort(np.concatenate(steps))
    return int(steps[min(len(steps) - 1, int(np.ceil(recall * len(steps))) - 1)]) + 1


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _assign(shared, dim: int, n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            if batch.num_rows:
                lists = nearest_lists(matrix(batch.column("vec"), dim), centroids, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("vec"),
                     pa.array(lists.tolist(), pa.list_(pa.int32()))],
                    names=["vec_id", "vec", "lists"])
    return run


def scan(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int,
         turn: np.ndarray, block: int, slack: float, first: int = 256):
    """Each query's k nearest of one list part: (query position, candidate position, distance).

    Columns of the rotated vectors are read block by block for the candidates still standing.
    The bound is the query's k-th exact distance so far; the first rows set it. At the last block
    only what lies above the bound is abandoned, so equal distances stay.
    """
    dim = vectors.shape[1]
    columns = np.ascontiguousarray((vectors @ turn).T)
    asked = queries @ turn
    order = np.argsort(ids, kind="stable")
    out = []
    for q in range(len(queries)):
        best_d, best_i = np.empty(0), np.empty(0, np.int64)
        at = 0
        while at < len(order):
            size = first if at == 0 else len(order) - at
            alive = order[at:at + size]
            alive = alive[ids[alive] != query_ids[q]]
            at += size
            if len(best_d) >= k:
                bound = best_d[k - 1] ** 2 * (1 + 1e-9) + 1e-18
                partial = np.zeros(len(alive))
                for start in range(0, dim, block):
                    stop = min(start + block, dim)
                    partial += ((columns[start:stop, alive] - asked[q, start:stop, None]) ** 2) \
                        .sum(axis=0)
                    limit = bound if stop == dim else \
                        bound * stop / dim * (1 + slack / np.sqrt(stop)) ** 2
                    stands = partial <= limit
                    alive, partial = alive[stands], partial[stands]
                    if not len(alive):
                        break
            exact = np.sqrt(((vectors[alive] - queries[q]) ** 2).sum(axis=1))
            best_d, best_i = np.concatenate([best_d, exact]), np.concatenate([best_i, alive])
            keep = np.lexsort((ids[best_i], best_d))[:k]
            best_d, best_i = best_d[keep], best_i[keep]
        out.append((np.full(len(best_i), q), best_i, best_d))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0)] * 3


def _scan_part(dim: int, k: int, seed: int, block: int, slack: float):
    def run(key, rows, queries):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                          "score": pa.array([], pa.float64())})
        if not rows.num_rows or not queries.num_rows:
            return empty
        ids = rows["vec_id"].to_numpy()
        query_ids = queries["query_id"].to_numpy()
        q, i, d = scan(ids, matrix(rows["vec"].combine_chunks(), dim), query_ids,
                       matrix(queries["query"].combine_chunks(), dim), k,
                       rotation(dim, seed), block, slack)
        return pa.table({"query_id": query_ids[q.astype(int)], "vec_id": ids[i.astype(int)],
                         "score": d.astype(float)})
    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
           vector_col: str = "embedding", recall: float = 0.95, sample_rows: int = 16_384,
           part_rows: int = 4_096, query_rows: int = 1_024, block: int = 16, slack: float = 2.1,
           seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by Euclidean distance.

    queries has the same columns as vectors; a query is never its own candidate, so its id is
    compared with the candidates'. Ties go to the smaller id. Null ids and vectors that are null,
    zero or hold null or non-finite components take no part. The commonest vector length of the
    sample is the index's; vectors of other lengths cannot be compared with it and take no part
    either. Repeated ids are candidates each; repeated queries count once. Empty tables give an
    empty result; other columns are not read. Centroids and the number of probed lists come from at
    most sample_rows rows, those with the least hash of their id, one row for each id; every row is
    indexed. recall is the share of near rows whose lists are probed; the tests on partial distances
    lose a little of it. Lists number the square root of the rows, but one to eight rows of the
    fitted half of the sample at most. Euclidean distances are taken in double precision.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    # Only ids are sorted; a broadcast of the chosen ones finds their vectors.
    chosen = rows.select(F.col("vec_id").alias("_id")).distinct() \
        .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    sample = [r["vec"] for r in rows.join(F.broadcast(chosen), F.col("vec_id") == F.col("_id"))
              .groupBy("vec_id").agg(F.min("vec").alias("vec")).orderBy("vec_id").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = np.bincount([len(v) for v in sample])
    dim = int(sizes.argmax())
    known = np.array([v for v in sample if len(v) == dim])
    total = rows.where(F.size("vec") == dim).count()
    lists = max(1, min(round(total ** 0.5), len(known) // 16))
    centroids = fit_centroids(known[::2], lists, seed)
    probes = probes_needed(known[1::2], centroids, k, recall)
    shared = spark.sparkContext.broadcast(centroids)
    schema = "vec_id long, vec array<double>, lists array<int>"

    indexed = write_once(
        rows.where(F.size("vec") == dim).mapInArrow(_assign(shared, dim, 1), schema)
        .select("vec_id", "vec", F.col("lists")[0].alias("list")), "ann-index")
    asked = write_once(
        usable(queries, id_col, vector_col).where(F.size("vec") == dim)
        .dropDuplicates(["vec_id"]).mapInArrow(_assign(shared, dim, probes), schema)
        .select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"),
                F.explode("lists").alias("list")), "ann-queries")
    # One row for each list that is asked: no more than there are centroids.
    shape = indexed.groupBy("list").agg(F.ceil(F.count("*") / part_rows).alias("parts")) \
        .join(asked.groupBy("list").agg(F.ceil(F.count("*") / query_rows).alias("blocks")), "list")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    placed = indexed.join(F.broadcast(shape), "list").select(
        "list", dealt("vec_id", "parts").alias("part"), up_to("blocks").alias("block"),
        "vec_id", "vec")
    asking = asked.join(F.broadcast(shape), "list").select(
        "list", up_to("parts").alias("part"), dealt("query_id", "blocks").alias("block"),
        "query_id", "query")
    cell = ["list", "part", "block"]
    found = placed.groupBy(*cell).cogroup(asking.groupBy(*cell)) \
        .applyInArrow(_scan_part(dim, k, seed, block, slack), FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
