"""Similarity of stored vectors to question vectors, on Arrow batches inside tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks carry this module's code with them, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANK_DIGITS = 9
_TINY = 1e-30


def normalised(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; an all-zero row stays zero."""
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + _TINY)


def _matrix(batch: pa.RecordBatch, column: str, dim: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows whose vector has dim values, none of them null or non-finite, and their vectors.

    `retrieval.rejected_vectors` lists the others with the reason."""
    vectors = batch.column(column)
    sized = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    batch = batch.filter(sized)
    flat = batch.column(column).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    whole = np.isfinite(values).all(axis=1)
    if not whole.all():
        batch, values = batch.filter(pa.array(whole)), values[whole]
    return batch, values


class _Best:
    """The k best rows of each question among those seen so far.

    A batch adds the rows that reach a question's k-th best so far; the pool is cut back to k rows
    a question once it has grown to several times that.
    """

    def __init__(self, questions: int, k: int):
        self.k, self.most = k, 4 * k * questions
        self.reach = np.full(questions, -np.inf)
        self.pool: list[pa.Table] = []
        self.held = 0

    def add(self, ids: pa.Array, similarity: np.ndarray) -> None:
        if len(ids) >= self.k:
            at = len(ids) - self.k
            self.reach = np.maximum(self.reach, np.partition(similarity, at, axis=0)[at])
        row, question = np.nonzero(similarity >= self.reach)
        self.pool.append(pa.table({"id": ids.take(pa.array(row)), "question": question,
                                   "similarity": similarity[row, question]}))
        self.held += len(row)
        if self.held > self.most:
            self.pool = [self.best()]
            self.held = len(self.pool[0])

    def best(self) -> pa.Table:
        """Equal similarities are ordered by id, so copies of one vector never pile up."""
        ordered = pa.concat_tables(self.pool).sort_by(
            [("question", "ascending"), ("similarity", "descending"), ("id", "ascending")])
        question = ordered["question"].to_numpy()
        first = np.searchsorted(question, question, "left")
        ordered = ordered.filter(pa.array(np.arange(len(question)) - first < self.k))
        question, similarity = ordered["question"].to_numpy(), ordered["similarity"].to_numpy()
        full = np.flatnonzero(np.bincount(question, minlength=len(self.reach)) >= self.k)
        last = np.searchsorted(question, full, "right") - 1
        self.reach[full] = np.maximum(self.reach[full], similarity[last])
        return ordered


def best_rows(question_ids: list[str], questions: np.ndarray, id_column: str,
              vector_column: str, k: int, group_column: str | None = None):
    """A batch function giving, per question, the ids of the k best rows of a task.

    With a group column the best rows of each of its values are found, and the column is given.
    """
    units = normalised(np.asarray(questions, dtype=np.float64))
    names = [id_column, "question_id", "similarity"] + ([group_column] if group_column else [])

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str | None, _Best] = {}
        for raw in batches:
            batch, values = _matrix(raw, vector_column, units.shape[1])
            if not batch.num_rows:
                continue
            similarity = np.round(normalised(values) @ units.T, RANK_DIGITS)
            groups = batch.column(group_column) if group_column else None
            for group in pc.unique(groups).to_pylist() if group_column else [None]:
                ids, own = batch.column(id_column), similarity
                if group_column:
                    mask = pc.equal(groups, group)
                    ids, own = ids.filter(mask), similarity[mask.to_numpy(zero_copy_only=False)]
                found.setdefault(group, _Best(len(question_ids), k)).add(ids, own)
        asked = pa.array(question_ids, pa.string())
        for group, pool in found.items():
            best = pool.best()
            columns = [best["id"].combine_chunks(), asked.take(best["question"].combine_chunks()),
                       best["similarity"].combine_chunks()]
            if group_column:
                columns.append(pa.array([group] * len(best), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return keep
