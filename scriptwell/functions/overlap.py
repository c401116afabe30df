"""Words that documents share with questions, counted on Arrow batches inside tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Tasks carry this module's code with them, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words of documents met in questions that are counted at once; one document is always counted whole.
MATCHES_TOGETHER = 1_000_000


def _words(joined: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts that are words joined by blanks, and how many each text has."""
    lists = pc.split_pattern(joined, " ")
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    return lists.flatten(), lengths.to_numpy(zero_copy_only=False).astype(np.int64)


class _Index:
    """For each word of a block of questions the questions that hold it."""

    def __init__(self, asked: list[pa.RecordBatch]):
        block = pa.Table.from_batches(asked).combine_chunks()
        self.ids = block["question_id"].combine_chunks()
        listed, lengths = zip(*(_words(x) for x in block["words"].chunks), strict=True)
        coded = pa.chunked_array(listed).combine_chunks().dictionary_encode()
        self.words = coded.dictionary
        codes = coded.indices.to_numpy()
        owners = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.concatenate(lengths))
        self.holders = owners[np.argsort(codes, kind="stable")]
        self.ends = np.cumsum(np.bincount(codes, minlength=len(self.words)))
        self.sizes = np.diff(self.ends, prepend=0)

    def shared(self, docs: pa.RecordBatch, together: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(document, question, shared words) by their places, for all pairs that share any."""
        listed, lengths = _words(docs.column("words"))
        codes = pc.fill_null(pc.index_in(listed, self.words), -1).to_numpy()
        rows = np.repeat(np.arange(len(lengths)), lengths)
        rows, codes = rows[codes >= 0], codes[codes >= 0]
        upto = np.cumsum(self.sizes[codes])
        first = 0
        while first < len(rows):
            done = upto[first - 1] if first else 0
            last = np.searchsorted(upto, done + together, "right")
            # Back to where a document begins, or on to the end of the only one.
            last = len(rows) if last == len(rows) else np.searchsorted(rows, rows[last])
            if last <= first:
                last = np.searchsorted(rows, rows[first], "right")
            yield self._counted(rows[first:last], codes[first:last])
            first = last

    def _counted(self, rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        sizes, low, asked = self.sizes[codes], rows[0], len(self.ids)
        before = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) + np.repeat(self.ends[codes] - sizes - before, sizes)
        pairs = self.holders[place] + np.repeat((rows - low) * asked, sizes)
        cells = int(rows[-1] - low + 1) * asked
        if cells <= 4 * len(pairs):
            counts = np.bincount(pairs, minlength=cells)
            pairs = np.flatnonzero(counts)
            counts = counts[pairs]
        else:
            pairs, counts = np.unique(pairs, return_counts=True)
        return pairs // asked + low, pairs % asked, counts


def shared_words(together: int = MATCHES_TOGETHER):
    """A batch function giving (doc_id, question_id, shared) for all pairs that share words.

    Its rows come by cell, the questions of a cell before its documents: `is_doc` tells them apart
    and `words` are the distinct words joined by blanks. A task holds the questions of one cell
    and one batch of documents.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked, index = None, [], None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            is_doc = batch.column("is_doc").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(is_doc.astype(np.int8)) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if start == end:
                    continue
                if cells[start] != cell:
                    cell, asked, index = cells[start], [], None
                rows = batch.slice(start, end - start)
                if not is_doc[start]:
                    asked.append(rows)
                elif asked:
                    if index is None:
                        index = _Index(asked)
                    ids = rows.column("doc_id")
                    for doc, question, shared in index.shared(rows, together):
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(doc)), index.ids.take(pa.array(question)),
                             pa.array(shared, pa.int64())], names=["doc_id", "question_id", "shared"])

    return count
