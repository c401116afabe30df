"""SimHash near-dedup.

Fingerprints of word shingles are computed on Arrow batches. Distinct fingerprints are split by
the pigeonhole principle: of four blocks, two fingerprints that differ in at most three bits share
one. Fingerprints that agree on a block are compared bit by bit. A block value with more than
``most_together`` fingerprints is split again by four blocks of the bits not yet agreed on, and so
on, which loses no pair and bounds what one task holds at once. What leaves a group is a spanning
forest of its links, never all pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptwell.llm.common import unused
from scriptwell.llm.components import components
from scriptwell.sources.workspace import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
SHINGLES_AT_ONCE = 1 << 18
LINKS_AT_ONCE = 200_000
#: A block value with at most this many bits left to differ holds 2**FEW_BITS fingerprints at
#: most, which is compared at once.
FEW_BITS = 16
#: Rows of a task's sorted input compared at once; a whole group always stays together.
ROWS_AT_ONCE = 50_000


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Unsigned SimHash of a text; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        pieces, n = iter([b" ".join(words)]), 1
    else:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = hashes[at:at + SHINGLES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")),
                                 np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "row_id", "text_hash")),
                 pa.array(prints.view(np.int64))], names=["doc_id", "row_id", "text_hash", "fp"])
    return run


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining positions a and b; a label is the least position of its component."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]


def forest(mask: np.ndarray, value: np.ndarray, fp: np.ndarray, distance: int):
    """Links (child, parent) that connect the close fingerprints of each (mask, value).

    Rows are sorted by group, so members of a group are compared at growing offsets.
    """
    n = len(fp)
    label, at, offset = np.arange(n), np.arange(n), 0
    a, b, held = [], [], 0
    while True:
        offset += 1
        at = at[at + offset < n]
        at = at[(mask[at] == mask[at + offset]) & (value[at] == value[at + offset])]
        if not len(at):
            break
        far = np.bitwise_count(fp[at] ^ fp[at + offset]) > distance
        hit = at[~far]
        hit = hit[label[hit] != label[hit + offset]]
        if len(hit):
            a.append(hit)
            b.append(hit + offset)
            held += len(hit)
            if held > LINKS_AT_ONCE:
                label = merge(label, np.concatenate(a), np.concatenate(b))
                a, b, held = [], [], 0
    if a:
        label = merge(label, np.concatenate(a), np.concatenate(b))
    child = np.flatnonzero(label != np.arange(n))
    return fp[child], fp[label[child]]


def _link_groups(distance: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            u, v = forest(rows[0], rows[1], rows[2].view(np.uint64), distance)
            if len(u):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False)
                                  for c in ("mask", "value", "fp")]))
            count += batch.num_rows
            if count < ROWS_AT_ONCE:
                continue
            rows = np.concatenate(held, axis=1)
            last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from links(rows[:, :cut])
            held, count = [rows[:, cut:]], rows.shape[1] - cut
        if held:
            yield from links(np.concatenate(held, axis=1))
    return run


def _split(mask: int, parts: int) -> list[int]:
    """mask plus one of parts blocks of the other bits, for each block."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    edges = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_links(prints: DataFrame, distance: int = 3, most_together: int = 4096) -> DataFrame:
    """Links u, v whose components are those of all pairs of the distinct values fp that differ in
    at most distance bits."""
    spark = prints.sparkSession
    parts, masks = distance + 1, _split(0, distance + 1)
    rows = prints.select("fp", F.lit(0).cast("long").alias("mask"))
    steps, found = [(0, m) for m in masks], None
    while True:
        step = F.broadcast(spark.createDataFrame([(_signed(a), _signed(b)) for a, b in steps],
                                                 "mask long, next long"))
        rows = rows.join(step, "mask").select(
            "fp", F.col("next").alias("mask"), F.col("fp").bitwiseAND(F.col("next")).alias("value"))
        free = BITS - min(m.bit_count() for m in masks)
        settled, crowded = rows, None
        if free > FEW_BITS:
            counts = rows.groupBy("mask", "value").count().where(F.col("count") > most_together)
            crowded = write_once(counts.drop("count"), "crowded-blocks")
            if crowded.isEmpty():
                crowded = None
            else:
                settled = rows.join(crowded, ["mask", "value"], "left_anti")
        links = settled.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp") \
            .mapInArrow(_link_groups(distance), "u long, v long")
        links = write_once(links, "block-links")
        found = links if found is None else found.union(links)
        if crowded is None:
            return found
        rows = write_once(rows.join(crowded, ["mask", "value"], "left_semi"), "crowded-rows") \
            .select("fp", "mask")
        steps = [(m, n) for m in masks for n in _split(m, parts)]
        masks = sorted({n for _, n in steps})


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 3, distance: int = 3, most_together: int = 4096) -> DataFrame:
    """One row per input row: doc_id, text_hash, fingerprint (16 hex digits),
    component_id, is_representative.

    Texts are lower-cased in A-Z only; a null or blank text has fingerprint zero, a text shorter
    than a shingle is one shingle. component_id is the least id of all documents reachable over
    links of at most distance bits; null ids never are, unless a group has no other (then null).
    Of each group the first row by id and row number is the representative, also among repeated
    rows. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.monotonically_increasing_id().alias("row_id"),
                       F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = write_once(rows.mapInArrow(
        _fingerprints(shingle), "doc_id long, row_id long, text_hash long, fp long"),
        "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_id")
    firsts = write_once(rows.groupBy("fp").agg(F.min(order).alias("first")), "distinct-prints")
    roots = components(close_links(firsts.select("fp"), distance, most_together))
    rooted = write_once(
        firsts.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
        .withColumn("root", F.coalesce("root", "fp")), "rooted-prints")
    heads = write_once(rooted.groupBy("root").agg(F.min("first").alias("head")), "heads")
    named = rooted.join(heads, "root").select("fp", "head")
    return rows.join(named, "fp").select(
        "doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"),
        (F.col("head.row_id") == F.col("row_id")).alias("is_representative"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = 3, distance: int = 3) -> DataFrame:
    """The documents that represent their group, all columns kept. Rows equal in id and text to
    the representative are merged into one."""
    groups = write_once(simhash_groups(docs, id_col, text_col, shingle, distance), "groups")
    own_id, own_hash, copies = unused(docs.columns, "_id", "_hash", "_rows")
    kept = groups.groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)) \
        .agg(F.count("*").alias(copies), F.max("is_representative").alias("kept")) \
        .where("kept").drop("kept")
    found = docs.join(kept, docs[id_col].eqNullSafe(F.col(own_id))
                      & (F.xxhash64(docs[text_col]) == F.col(own_hash)))
    repeated = found.where(F.col(copies) > 1).dropDuplicates([own_id, own_hash])
    return found.where(F.col(copies) == 1).unionByName(repeated).select(*docs.columns)
