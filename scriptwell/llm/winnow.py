"""Winnowed segments: the common first steps of the two operators on repeated passages.

A sequence of units (words or bytes) has a window at every start. Each window selects its least
gram, the anchor; equal windows select equal anchors at equal places. Neighbouring windows with the
same anchor form a segment, so all windows that can be equal lie in segments with equal anchors.
Segments of one anchor fall into classes of equal content. What copies share is settled by counting
classes; only one segment of each class, and only of anchors with several classes, needs its text.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptwell.llm.common import LAST_ID, with_ranges
from scriptwell.sources.workspace import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEGMENTS = "doc_id long, text_hash long, a int, b int, anchor long, content long, times int"
SLICES = "place long, doc_id long, text_hash long, a int, anchor long, crowded boolean, body binary"
#: Windows worked on at once; longer documents are taken in such stretches.
STRETCH = 1 << 17
_PLACE_BITS = np.uint64(20)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the power 0..n-1, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        row = np.full(max(n, 1 << 12), base, np.uint64)
        row[0] = 1
        known = _powers[base] = np.multiply.accumulate(row)
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima to both ends of blocks of w."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


class Hashes:
    """Hashes of any part of a sequence of 64-bit units."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.back = powers(pow(_BASE, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * powers(_BASE, n), out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def segments_of(units: np.ndarray, window: int, gram: int):
    """(a, b, anchor, content) of each segment: first and last start of its windows, and hashes."""
    found = []
    for base in range(0, len(units) - window + 1, STRETCH):
        part = units[base:base + STRETCH + window - 1]
        h = Hashes(part)
        n = len(part) - gram + 1
        place = np.arange(n, dtype=np.uint64)
        grams = h.of(np.arange(n), np.arange(gram, n + gram))
        keys = (grams >> _PLACE_BITS << _PLACE_BITS) | place
        least = sliding_min(keys, window - gram + 1)
        at = (least & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
        edge = np.flatnonzero(np.diff(at)) + 1
        a = np.concatenate([[0], edge])
        b = np.concatenate([edge, [len(at)]]) - 1
        shape = ((at[a] - a) * (2 * window) + (b - a)).astype(np.uint64)
        content = mixed(h.of(a, b + window) + shape)
        found.append((a + base, b + base, grams[at[a]], content))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


def word_units(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_BYTE_UNITS = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)


def byte_units(text: bytes) -> np.ndarray:
    return _BYTE_UNITS[np.frombuffer(text, np.uint8)]


def folded(source: np.ndarray, a: np.ndarray, b: np.ndarray, anchor: np.ndarray,
           content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal segments begin that follow one another in a document, and their lengths.

    A text that repeats itself at a short distance has as many equal segments as repeats."""
    first = np.ones(len(a), bool)
    first[1:] = ((source[1:] != source[:-1]) | (a[1:] != b[:-1] + 1) | (anchor[1:] != anchor[:-1])
                 | (content[1:] != content[:-1]))
    at = np.flatnonzero(first)
    return at, np.diff(np.append(at, len(a)))


def _segments(units_of: Callable, window: int, gram: int, fold: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, text in enumerate(batch.column("text")):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                found = segments_of(units_of(raw), window, gram)
                if found:
                    rows.append(np.full(len(found[0]), i))
                    parts.append(found)
            if not rows:
                continue
            found = [np.concatenate(rows), *(np.concatenate(x) for x in zip(*parts, strict=True))]
            times = np.ones(len(found[0]), np.int32)
            if fold:
                at, times = folded(*found)
                found = [x[at] for x in found]
            source, (a, b, anchor, content) = pa.array(found[0]), found[1:]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(source), batch.column("text_hash").take(source),
                 pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                 pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                 pa.array(times.astype(np.int32))],
                names=["doc_id", "text_hash", "a", "b", "anchor", "content", "times"])
    return run


def segments(named: DataFrame, units_of: Callable, window: int, gram: int,
             fold: bool = False) -> DataFrame:
    """Segments of all documents. With fold, equal ones that follow one another are one row, the
    first with their number as times: that many neighbouring ranges of b - a + 1 starts from a on."""
    return named.mapInArrow(_segments(units_of, window, gram, fold), SEGMENTS)


def recurring(found: DataFrame, label: str) -> DataFrame:
    """Segments whose anchor has others, with first_place (least document of the anchor) and alike
    (whether all segments of the anchor are equal); found and the result are stored tables.

    The anchors are stored before the join, so that Spark can split a task with a hot anchor."""
    place = F.coalesce("doc_id", F.lit(LAST_ID))
    anchors = found.groupBy("anchor").agg(
        F.sum("times").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"),
        F.min(place).alias("first_place")).where("n > 1") \
        .select("anchor", "first_place", (F.col("low") == F.col("high")).alias("alike"))
    return write_once(found.join(write_once(anchors, f"{label}-anchors"), "anchor"), label)


def classes(again: DataFrame) -> DataFrame:
    """anchor, content, n, first of the classes of anchors with several: a class's size and its
    first segment by document."""
    return again.where("NOT alike").groupBy("anchor", "content").agg(
        F.sum("times").alias("n"),
        F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("place"), "doc_id", "text_hash",
                       "a", "b")).alias("first"))


def _zip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = (t.as_py() for t in batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(
                [None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in texts],
                pa.binary())], names=["doc_id", "text_hash", "text"])


def zipped(named: DataFrame) -> DataFrame:
    """Documents with their texts compressed, for a shuffle of less."""
    return named.mapInArrow(_zip, "doc_id long, text_hash long, text binary")


def unzip(text: bytes | None) -> bytes:
    return b"" if text is None else zstandard.ZstdDecompressor().decompress(text)


def _finer(text: bytes, cut: Callable, units_of: Callable, window: int) -> Iterator[tuple]:
    """Segments of a crowded anchor's segment by a gram nearly as long as a window: first start,
    anchor, and a 128-bit hash of each of its windows."""
    part = cut(text)
    for a, b, anchor, _ in zip(*segments_of(units_of(text), window, window - max(1, window // 25)),
                               strict=True):
        yield int(a), int(anchor.view(np.int64)), b"".join(
            xxhash.xxh3_128_digest(part(s, s + window)) for s in range(a, b + 1))


def _slices(cut: Callable, units_of: Callable, window: int, crowd: int, carried: tuple):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(c.split()[0] for c in SLICES.split(", ")), *carried]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(),
                 pa.binary(), *[pa.int64()] * len(carried)]
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("text")):
                doc, hashed = batch.column("doc_id")[i].as_py(), batch.column("text_hash")[i].as_py()
                part = cut(unzip(text.as_py()))
                for x in batch.column("ranges")[i].as_py():
                    body = part(x["a"], x["b"] + window)
                    more = [x[c] for c in carried]
                    if x["kinds"] > crowd:
                        rows += [(x["place"], doc, hashed, x["a"] + a, anchor, True, hashes, *more)
                                 for a, anchor, hashes in _finer(body, cut, units_of, window)]
                    else:
                        rows.append((x["place"], doc, hashed, x["a"], x["anchor"], False, body,
                                     *more))
                if len(rows) > 20_000:
                    yield _batch(rows, kinds, names)
                    rows = []
            if rows:
                yield _batch(rows, kinds, names)
    return run


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def slices(named: DataFrame, chosen: DataFrame, cut: Callable, units_of: Callable, window: int,
           crowd: int, label: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """Text of the chosen segments (anchor, content, n, first), with the long columns carried. A
    segment whose anchor has more than crowd classes gives its finer segments instead, with hashes
    of their windows."""
    kinds = write_once(chosen.groupBy("anchor").agg(F.count("*").alias("kinds")), label)
    wanted = chosen.join(kinds, "anchor").select("anchor", "kinds", "first.*", *carried) \
        .groupBy("doc_id", "text_hash").agg(F.collect_list(
            F.struct("place", "a", "b", "anchor", "kinds", *carried)).alias("ranges"))
    return with_ranges(zipped(named), wanted, "inner").mapInArrow(
        _slices(cut, units_of, window, crowd, carried),
        ", ".join([SLICES, *(f"{c} long" for c in carried)]))


def crowded_windows(pieces: DataFrame, label: str,
                    owner: tuple[str, ...] = ("doc_id", "text_hash")) -> DataFrame:
    """place, owner columns, a, h of the windows of crowded anchors that may recur: those of
    finer segments whose anchor recurs."""
    finer = pieces.where("crowded")
    again = write_once(finer.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
                       .select("anchor"), label)
    windows = F.transform(
        F.sequence(F.lit(0), (F.length("body") / 16).cast("int") - 1),
        lambda i: F.struct((F.col("a") + i).alias("a"),
                           F.substring(F.col("body"), i * 16 + 1, F.lit(16)).alias("h")))
    return finer.join(again, "anchor").select("place", *owner, F.inline(windows))


def in_shards(whole: DataFrame, rows_each: int) -> DataFrame:
    """Slices with a shard by anchor, of about rows_each rows; whole is a stored table."""
    shards = max(1, -(-whole.count() // rows_each))
    return whole.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Sorted, disjoint spans of ranges that may overlap."""
    out: list[list[int]] = []
    for x in sorted((r["a"], r["b"]) for r in ranges):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


def spans_by_document(*spans: DataFrame) -> DataFrame:
    """Rows doc_id, text_hash, a, b of several tables as one list of ranges per document."""
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    return every.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("a", "b")).alias("ranges"))


