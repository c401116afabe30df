"""Suffix-array dedup with bucket-pointer refinement.

Winnowed segments of bytes decide which parts of the corpus can hold repeated strings; a class of
several equal segments is repeated as a whole. Where an anchor has other classes too, one segment of
each goes to the anchor's shard. A shard sorts the suffixes of its segments: buckets of equal
q-grams are refined by sorting their members on the bucket pointers at later offsets, the pointers
so updated serve the next refinement, and refinement ends at the length of the searched strings.
Anchors with too many classes for a shard are taken by a finer winnowing and
settled window by window, by hash.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptwell.llm import winnow
from scriptwell.llm.common import identified, with_ranges
from scriptwell.sources.workspace import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPANS = "doc_id long, text_hash long, a int, b int"
Q = 8


def bytes_cut(text: bytes):
    return lambda a, b: text[a:b]


def _buckets(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, and in that order the start and the size of each member's bucket."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.append(edge, len(ranked)))
    return order, np.repeat(edge, size), np.repeat(size, size)


def repeated(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Positions whose next length bytes, inside their segment, also start at another position.

    data holds the segments one after another, ends each position's end of segment. A bucket
    pointer is the rank of its bucket in the suffix array sorted to the depth reached so far.
    """
    n = len(data)
    pointer = np.full(n, -1, np.int64)
    at = np.arange(n)
    active = at[at + Q <= ends]
    if not len(active):
        return active
    padded = np.concatenate([data, np.zeros(Q, np.uint8)])
    grams = np.lib.stride_tricks.sliding_window_view(padded, Q)[active]
    order, start, size = _buckets(np.ascontiguousarray(grams).view(">u8").ravel().astype(np.uint64))
    active = active[order]
    pointer[active] = start
    active = active[size > 1]
    depth = Q
    while depth < length and len(active):
        step = min(depth, length - depth)
        active = active[active + depth + step <= ends[active]]
        if not len(active):
            break
        own = pointer[active]
        order, start, size = _buckets(own * n + pointer[active + step])
        active, own = active[order], own[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        within = start - np.repeat(first, np.diff(np.append(first, len(own))))
        pointer[active] = own + within
        active = active[size > 1]
        depth += step
    return np.sort(active)


def _shard(length: int):
    def run(key, rows):
        bodies = rows["body"].to_pylist()
        sizes = np.array([len(x) for x in bodies])
        last = np.cumsum(sizes)
        data = np.frombuffer(b"".join(bodies), np.uint8)
        hits = repeated(data, np.repeat(last, sizes), length)
        source = np.searchsorted(last, hits, "right")
        start = (rows["a"].to_numpy()[source] + hits - (last - sizes)[source]).astype(np.int32)
        run_on = np.ones(len(hits) + 1, bool)
        run_on[1:-1] = (np.diff(hits) != 1) | (np.diff(source) != 0)
        first, end = np.flatnonzero(run_on[:-1]), np.flatnonzero(run_on[1:])
        source = pa.array(source[first])
        return pa.table({"doc_id": rows["doc_id"].take(source),
                         "text_hash": rows["text_hash"].take(source),
                         "a": start[first], "b": start[end] + np.int32(length)})
    return run


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, runs, kept = [], [], [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
            raw = winnow.unzip(text.as_py())
            spans = winnow.merged(ranges.as_py() or [])
            total.append(len(raw))
            gone.append(sum(b - a for a, b in spans))
            runs.append(len(spans))
            edges = [0, *(x for span in spans for x in span), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(total, pa.int64()),
             pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
            names=["doc_id", "text_hash", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 length: int = 400, gram: int = 160, shard_rows: int = 1_000,
                 crowd: int = 1_000) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_bytes, n_removed, n_spans, kept (the remaining
    bytes).

    A byte goes if a string of that length covers it that also starts anywhere else, in any row
    (the same one included); overlaps count, every occurrence goes, and strings are judged on the
    input. Null counts as empty; shorter texts never change. Repeated rows are occurrences of each
    other. Null ids are ordinary rows. What is kept may not be valid UTF-8. An empty table gives an
    empty result; other columns are not read.
    """
    named = identified(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col)
    found = write_once(winnow.segments(named, winnow.byte_units, length, gram, fold=True),
                       "byte-segments")
    again = winnow.recurring(found, "byte-recurring")
    kinds = write_once(winnow.classes(again), "byte-classes")

    # The starts of a folded run follow one another, so that one span covers them.
    span = ["doc_id", "text_hash", "a",
            F.expr(f"a + times * (b - a + 1) - 1 + {length}").alias("b")]
    alike = again.where("alike").select(*span)
    copied = kinds.where("n > 1").select("anchor", "content")
    copies = again.where("NOT alike").join(copied, ["anchor", "content"]).select(*span)

    single = kinds.where("n = 1").select("anchor").distinct()
    pieces = write_once(winnow.slices(named, kinds.join(single, "anchor", "left_semi"), bytes_cut,
                                      winnow.byte_units, length, crowd, "byte-kinds"), "byte-slices")
    shards = winnow.in_shards(pieces.where("NOT crowded"), shard_rows)
    located = shards.groupBy("shard").applyInArrow(_shard(length), SPANS)

    crowded = winnow.crowded_windows(pieces, "byte-crowds")
    twice = crowded.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    crowded = crowded.join(twice, "h") \
        .select("doc_id", "text_hash", "a", (F.col("a") + length).alias("b"))

    ranges = winnow.spans_by_document(alike, copies, located, crowded)
    return with_ranges(winnow.zipped(named), ranges).mapInArrow(
        _without, "doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, "
                  "kept binary")
