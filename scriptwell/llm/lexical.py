"""Ranked lexical search: exact inner products by sparse ball trees.

A document's vector holds, for each term of the queries, an integer that depends on its occurrences
and on the document's length; a query's vector holds the terms' weights times their repeats. The
score is the inner product, in 64-bit integers. Stored vectors stream through the tasks in parts of
bounded size. Each part becomes a ball tree: a node's documents lie within a radius of their
centroid, so no score in it exceeds the query's product with the centroid plus its length times the
radius; a radius for each term by itself gives a second such bound, and the lesser holds. Nodes are
visited best first until the bound, rounded up safely, falls below the query's
k-th score so far, which a task carries from part to part. Leaves are scored exactly.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptwell.llm.common import LAST_ID
from scriptwell.sources.workspace import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Letters and digits of ASCII and whatever lies beyond, in UTF-8 with A-Z lower-cased.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


def _vectors(vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = vocabulary.value
        for batch in batches:
            size, held, times, ends = [], [], [], [0]
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                counted = Counter(places[w] for w in words if w in places)
                size.append(len(words))
                held += counted.keys()
                times += counted.values()
                ends.append(len(held))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(held, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))],
                names=["doc_id", "n", "terms", "times"])
    return run


class BallTree:
    """Rows of sparse integer vectors, reordered so that each node's rows lie together.

    ends[i] is where row i's entries end. Nodes are numbered from the root, 0; children[i] is the
    first of two neighbouring children or 0.
    """

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int,
                 leaf: int):
        self.width = width
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.values = terms, values.astype(float)
        self.squares = np.add.reduceat(self.values ** 2, self.starts[:-1])
        self.rows: list[tuple[int, int]] = [(0, len(sizes))]
        self.children = [0]
        centroids, radii, term_radii = [], [], []
        self.order = np.arange(len(sizes))
        at = 0
        while at < len(self.rows):
            first, last = self.rows[at]
            own = self.order[first:last]
            entries, starts = self._entries(own)
            terms_here, values_here = self.terms[entries], self.values[entries]
            centroid = np.bincount(terms_here, values_here, width) / len(own)
            away = self._away(own, terms_here, values_here, starts, centroid)
            centroids.append(centroid)
            # Distances are differences of sums; the margin covers what rounding may take.
            margin = 1e-9 * (self.squares[own].max() + centroid @ centroid)
            radii.append(math.sqrt(max(away.max(), 0) + margin))
            highest, lowest = np.zeros(width), np.full(width, np.inf)
            np.maximum.at(highest, terms_here, values_here)
            np.minimum.at(lowest, terms_here, values_here)
            lowest[np.bincount(terms_here, minlength=width) < len(own)] = 0
            term_radii.append(np.maximum(highest - centroid, centroid - lowest))
            if last - first > leaf and away.max() > margin:
                # Two far rows, then two rounds of centroids of those nearer to either.
                pole = self._dense(own[away.argmax()])
                from_pole = self._away(own, terms_here, values_here, starts, pole)
                other = self._dense(own[from_pole.argmax()])
                side = self._away(own, terms_here, values_here, starts, other) < from_pole
                for _ in range(2):
                    if not side.any() or side.all():
                        break
                    on = np.repeat(side, np.diff(starts))
                    one = np.bincount(terms_here[on], values_here[on], width) / side.sum()
                    two = (centroid * len(own) - one * side.sum()) / (~side).sum()
                    side = (self._away(own, terms_here, values_here, starts, one)
                            < self._away(own, terms_here, values_here, starts, two))
                if side.any() and not side.all():
                    self.order[first:last] = np.concatenate([own[~side], own[side]])
                    self.children[at] = len(self.rows)
                    middle = first + int((~side).sum())
                    self.rows += [(first, middle), (middle, last)]
                    self.children += [0, 0]
            at += 1
        self.centroids, self.radii = np.array(centroids), np.array(radii)
        self.term_radii = np.array(term_radii)
        entries, self.starts = self._entries(self.order)
        self.terms, self.values = self.terms[entries], values[entries]

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.starts[rows + 1] - self.starts[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        return np.repeat(self.starts[rows] - starts[:-1], sizes) + np.arange(starts[-1]), starts

    def _dense(self, row: int) -> np.ndarray:
        vector = np.zeros(self.width)
        own = slice(self.starts[row], self.starts[row + 1])
        vector[self.terms[own]] = self.values[own]
        return vector

    def _away(self, rows, terms, values, starts, point: np.ndarray) -> np.ndarray:
        products = np.add.reduceat(values * point[terms], starts[:-1])
        return self.squares[rows] - 2 * products + point @ point

    def best(self, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int,
             scores: np.ndarray, found: np.ndarray, spread: np.ndarray) -> tuple:
        """The k best of those given (scores, found: highest first) and the tree's rows, and how
        many rows were scored. spread is an array of zeros, and is given back so."""
        asked = weights.astype(float)
        bounds = self.centroids[:, terms] @ asked + np.minimum(
            math.sqrt(asked @ asked) * self.radii, self.term_radii[:, terms] @ asked)
        bounds = bounds * (1 + 1e-9) + 1e-6
        spread[terms] = weights
        scored, heap = 0, [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < (scores[k - 1] if len(scores) >= k else 1):
                break
            child = self.children[node]
            if child:
                heapq.heappush(heap, (-bounds[child], child))
                heapq.heappush(heap, (-bounds[child + 1], child + 1))
                continue
            first, last = self.rows[node]
            own = slice(self.starts[first], self.starts[last])
            exact = np.add.reduceat(self.values[own] * spread[self.terms[own]],
                                    self.starts[first:last] - self.starts[first])
            scored += last - first
            good = np.flatnonzero(exact >= (scores[k - 1] if len(scores) >= k else 1))
            if len(good):
                scores = np.concatenate([scores, exact[good]])
                found = np.concatenate([found, ids[self.order[first + good]]])
                keep = np.lexsort((found, -scores))[:k]
                scores, found = scores[keep], found[keep]
        spread[terms] = 0
        return scores, found, scored


def _search(shared, width: int, mean: tuple[int, int], k: int, part_rows: int, leaf: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        documents, total = mean
        spread = np.zeros(width, np.int64)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
        for batch in batches:
            for at in range(0, batch.num_rows, part_rows):
                part = batch.slice(at, part_rows)
                ids = part.column("doc_id").fill_null(LAST_ID).to_numpy()
                held, times = part.column("terms"), part.column("times")
                sizes = np.diff(held.offsets.to_numpy())
                tf = times.flatten().to_numpy().astype(np.int64)
                m = 75 + 25 * part.column("n").to_numpy() * documents // total
                values = 1_000_000_000 * tf // (1_000 * tf + 12 * np.repeat(m, sizes))
                tree = BallTree(sizes, held.flatten().to_numpy(), values, width, leaf)
                for q, (terms, weights) in enumerate(queries):
                    if len(terms):
                        best[q] = tree.best(terms, weights, ids, k, *best[q], spread)[:2]
        for q, (scores, found) in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), q), pa.int32()),
                 pa.array(found, pa.int64(), mask=found == LAST_ID), pa.array(scores, pa.int64())],
                names=["query", "doc_id", "score"])
    return run


def _answers(docs: DataFrame, items: list[tuple], k: int, part_rows: int, leaf: int) -> DataFrame:
    """Results for the items given, rows of id and text."""
    spark = docs.sparkSession
    wanted = [Counter(terms_of(text)) for _, text in items]
    places = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
    vectors = write_once(docs.mapInArrow(
        _vectors(spark.sparkContext.broadcast(places)),
        "doc_id long, n long, terms array<int>, times array<int>").where("n > 0"), "term-vectors")
    mean = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weight = [math.floor(1000 * math.log((2 * mean[0] + 2) / (2 * held.get(i, 0) + 1)))
              for i in range(len(places))]
    queries = []
    for counted in wanted:
        terms = np.array([places[t] for t in counted], np.int64)
        weights = np.array([n * weight[places[t]] for t, n in counted.items()], np.int64)
        queries.append((terms[weights > 0], weights[weights > 0]))
    found = vectors.where(F.size("terms") > 0).mapInArrow(
        _search(spark.sparkContext.broadcast(queries), len(places), tuple(mean), k, part_rows, leaf),
        "query int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ids = F.broadcast(spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)],
                                            "query int, item_id long"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .join(ids, "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id",
           item_col: str = "item_id", text_col: str = "text", items_together: int = 256,
           part_rows: int = 2_048, leaf: int = 8) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of the highest scores above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased;
    null has none. Equal scores go by document id, null last. Repeated rows of docs are documents
    of their own; rows of items that repeat id and text are one item, others with one id are ranked
    apart. Items are taken in blocks of about items_together; each block reads docs once and holds its
    items' terms in every task. A very long text is held by one task and leaves a vector no longer
    than the block's vocabulary. Empty tables give an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"),
                         F.col(text_col).alias("text")).distinct()
    blocks = max(1, math.ceil(asked.count() / items_together))
    if blocks > 1:
        asked = write_once(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), blocks)),
                           "items", ["block"])
    found = []
    for block in range(blocks):
        own = asked.where(F.col("block") == block) if blocks > 1 else asked
        held = [(r["item_id"], r["text"]) for r in own.collect()]
        found.append(_answers(rows, held, k, part_rows, leaf))
    return reduce(DataFrame.unionByName, found)
