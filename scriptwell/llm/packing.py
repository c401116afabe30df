"""Packing token sequences with minimum bin slack.

A document's tokens fill whole sequences; what remains is shorter than one. Only the number of
remainders of each length matters for packing them, a histogram of at most capacity - 1 rows. For
one sequence at a time, a bitset over reachable sums picks the multiset of remaining lengths that
fills it closest to capacity; the pattern is repeated as often as the counts allow. The list of
patterns doesn't grow with the corpus. Remainders are then ranked within their length, in buckets,
and each rank finds its pattern, sequence and offset by a join.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptwell.sources.workspace import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the pattern by which the byte-level tokenizer cuts a text before its merges.
PRE_TOKENS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Fixed value: what \s means in that pattern.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Longer runs of blanks aren't matched by the pattern, which fails on runs of about a million.
LONG_RUN = 100_000


def byte_of_symbol() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable characters
    of Latin-1 for themselves, those from 256 on for the other bytes in order."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The vocabulary is read from the tokenizer's file. Its ids number the merges in their order, so
    they serve as the ranks of a faster implementation of the same byte-level BPE. A long run of
    blanks is cut out as the pattern would: one piece but for its last blank, which goes with the
    text after it. With plain, strings of special tokens are text like any other.
    """

    def __init__(self, path: str, plain: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        read = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in read.get_added_tokens_decoder().items()}
        symbols = byte_of_symbol()
        ranks = {bytes(map(symbols.__getitem__, token)): i
                 for token, i in read.get_vocab(with_added_tokens=False).items()
                 if token not in self.special}
        self.codec = tiktoken.Encoding(path, pat_str=PRE_TOKENS, mergeable_ranks=ranks,
                                       special_tokens=self.special)
        self.ranks = ranks
        if plain:
            self.special = {}

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id, none for a special token."""
        out = [b""] * self.codec.n_vocab
        for token, i in self.ranks.items():
            out[i] = token
        return out

    def ids(self, text: str) -> list[int]:
        return self._ids(text) if len(text) <= LONG_RUN else \
            np.frombuffer(self.encode(text), "<u4").tolist()

    def encode(self, text: str) -> bytes:
        if len(text) <= LONG_RUN:
            return self._encode(text)
        parts, done = [], 0
        for run in BLANKS.finditer(text):
            start, end = run.span()
            if end - start > LONG_RUN:
                alone = end == len(text) or text.startswith(tuple(self.special), end)
                end -= not alone
                parts.append(self._encode(text[done:start]))
                parts.append(_packed(self.codec._encode_single_piece(text[start:end])))
                done = end
        parts.append(self._encode(text[done:]))
        return b"".join(parts)

    def _encode(self, text: str) -> bytes:
        return _packed(self._ids(text))

    def _ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.codec.encode(text, allowed_special="all")
        return self.codec.encode_ordinary(text)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, capacity: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path)
        for batch in batches:
            source, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = codec.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for first in range(0, n, capacity):
                    piece = ids[4 * first:4 * (first + capacity)]
                    source.append(i)
                    start.append(first)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(source, pa.int64())),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def fill_closest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset of lengths, the longest one among them, whose sum comes closest to capacity.

    Bit s of a row's bitset says that sum s is reachable; counts are split in powers of two, and
    the choice is read back from the last row to the first.
    """
    longest = max(counts)
    room = capacity - longest
    reach, steps = 1, []
    limit = (1 << room + 1) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        times = 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & limit
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {longest: 1}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            total -= length * times
            chosen[length] = chosen.get(length, 0) + times
    return sorted(chosen.items(), reverse=True)


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(lengths with how many of each, number of sequences) until no length is left."""
    left, found = {k: v for k, v in counts.items() if v}, []
    while left:
        chosen = fill_closest(left, capacity)
        times = min(left[length] // k for length, k in chosen)
        found.append((chosen, times))
        for length, k in chosen:
            left[length] -= k * times
            if not left[length]:
                del left[length]
    return found


def _slots(spark: SparkSession, counts: dict[int, int], capacity: int) -> DataFrame:
    """For each length, ranges of ranks with the sequences and offsets they go to."""
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for chosen, times in patterns(counts, capacity):
        offset = 0
        for length, k in chosen:
            rows.append((length, used[length], used[length] + k * times, sequence, k, offset))
            used[length] += k * times
            offset += k * length
        sequence += times
    return spark.createDataFrame(rows, "length long, rank_from long, rank_to long, "
                                       "first_sequence long, each long, first_offset long")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 1024, end_id: int = 0, ranks_together: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty: its document is the end id alone. Repeated rows and rows with null
    ids are documents of their own. Even sequence ids hold remainders, odd ones one whole piece.
    An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(
        _pieces(tokenizer_path, capacity, end_id),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = write_once(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("number") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    short = pieces.where(F.col("length") < capacity)
    counted = short.groupBy("length").count()  # capacity - 1 rows at most
    counts = {r["length"]: r["count"] for r in counted.collect()}
    buckets = F.broadcast(counted).select(
        F.col("length").alias("l"), F.ceil(F.col("count") / ranks_together).alias("buckets"))
    dealt = short.join(buckets, F.col("length") == F.col("l")).drop("l") \
        .withColumn("bucket", F.pmod(F.xxhash64("number"), F.col("buckets")))
    earlier = Window.partitionBy("b_length").orderBy("b_bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(F.col("length").alias("b_length"), F.col("bucket").alias("b_bucket")) \
        .agg(F.count("*").alias("n")) \
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = dealt.withColumn("inner", F.row_number().over(
        Window.partitionBy("length", "bucket").orderBy("number")) - 1) \
        .join(offsets, (F.col("length") == F.col("b_length"))
              & (F.col("bucket") == F.col("b_bucket"))) \
        .withColumn("rank", F.col("inner") + F.col("before"))
    slots = F.broadcast(_slots(spark, counts, capacity).withColumnRenamed("length", "l"))
    nth = F.col("rank") - F.col("rank_from")
    packed = ranked.join(slots, (F.col("length") == F.col("l"))
                         & (F.col("rank") >= F.col("rank_from"))
                         & (F.col("rank") < F.col("rank_to"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("s"),
        (F.col("first_offset") + nth % F.col("each") * F.col("length")).alias("offset")) \
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                (F.col("s") * 2).alias("sequence_id"), "offset")
    return whole.unionByName(packed)
