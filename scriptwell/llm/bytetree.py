"""Byte-level BPE as a reduction over a tree of text halves.

A text is halved until its parts are short; those are encoded directly. Two neighbours are joined by
encoding a window around their border anew. The window grows until the tokens outside it provably
stay as they are. Each end of it is settled in one of two ways:

* It is a place where a match of the splitting pattern begins whatever lies further away: between
  a character that is no white space and white space, or between a letter or digit and ASCII
  punctuation. Matches depend on what follows their start only, so the neighbour has a match that
  begins there, and so has the whole.
* It lies between two of the neighbour's tokens inside one run of letters, white space, digits or
  punctuation, hence in one match, and the window's outermost token there comes out unchanged. A
  sequence of tokens is the encoding of its bytes if each pair of neighbours is the encoding of
  theirs: the first merge across a border would be the first across it in the pair alone, too. All
  pairs are then either old or inside the window.

The second needs a vocabulary in which every token is the encoding of its own bytes. Decoding
concatenates the tokens' bytes up a tree of the same kind.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptwell.llm.common import by_size

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: what \s means in the splitting pattern.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PUNCTUATION = r"!-/:-@\[-`{-~"
#: Places where a match begins, whatever lies further away.
EDGE = re.compile(rf"(?<=[^{BLANK}])(?=[{BLANK}])|(?<=[^\W_])(?=[{PUNCTUATION}])")
#: Runs that are, but for MARGIN characters at their ends, in one match, as letters are; a
#: contraction is shorter.
RUN = re.compile(rf"[{BLANK}]+|[0-9]+|[{PUNCTUATION}]+")
MARGIN = 3
#: Longer runs of blanks are encoded as pieces; the library's pattern fails on about a million.
LONG_BLANKS = re.compile(rf"[{BLANK}]{{100000,}}")


class TreeEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = 1_024, reach: int = 32):
        import tiktoken

        self.codec = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks,
                                       special_tokens={})
        self.leaf, self.reach = leaf, reach
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.size_of = np.array([len(x) for x in self.bytes_of], np.int64)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text, as the library gives them for the whole."""
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self._direct(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid),
                          self._encode(text, mid, hi))

    def _direct(self, text: str) -> np.ndarray:
        if len(text) <= 100_000:
            return np.array(self.codec.encode_ordinary(text), np.uint32)
        parts, done = [], 0
        for run in LONG_BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            parts += self.codec.encode_ordinary(text[done:run.start()])
            parts += self.codec._encode_single_piece(text[run.start():end])
            done = end
        return np.array(parts + self.codec.encode_ordinary(text[done:]), np.uint32)

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray,
              right: np.ndarray) -> np.ndarray:
        reach = self.reach
        while True:
            low, high = max(lo, mid - reach), min(hi, mid + reach)
            edges = [m.start() for m in EDGE.finditer(text, low, min(hi, high + 1))]
            start = self._end(text, lo, mid, hi, low, [e for e in edges if e <= mid][-1:],
                              left[::-1])
            stop = self._end(text, lo, mid, hi, high, [e for e in edges if e >= mid][:1], right)
            if start and stop:
                (a, drop, first), (b, rest, last) = start, stop
                new = self._direct(text[a:b])
                if (first is None or new[0] == first) and (last is None or new[-1] == last):
                    return np.concatenate([left[:len(left) - drop], new, right[rest:]])
            reach *= 2

    def _end(self, text: str, lo: int, mid: int, hi: int, far: int, edge: list[int],
             ids: np.ndarray) -> tuple[int, int, int | None] | None:
        """One end of the window: its place, how many of the ids, counted from mid, lie inside,
        and the id that must come out at this end again, if any. None: look further."""
        if edge or far in (lo, hi):
            at = edge[0] if edge else far
            size = len(text[min(at, mid):max(at, mid)].encode())
            ends = np.cumsum(self.size_of[ids[:size]])
            return at, int(np.searchsorted(ends, size)) + 1 if size else 0, None
        step = -1 if far < mid else 1
        inside = text[far:mid][::-1] if step < 0 else text[mid:far]
        widths = np.cumsum([len(c.encode()) for c in inside])
        ends = np.cumsum(self.size_of[ids[:int(widths[-1])]])
        for n in np.flatnonzero(np.isin(ends, widths))[::-1]:
            at = mid + step * (int(np.searchsorted(widths, ends[n])) + 1)
            around = text[at - MARGIN:at + MARGIN]
            if (lo <= at - MARGIN and at + MARGIN <= hi
                    and (around.isalpha() or RUN.fullmatch(around))):
                return at, int(n) + 1, int(ids[n])
        return None

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_encoders: dict[tuple, TreeEncoder] = {}


def tree_encoder(path: str, pattern: str, leaf: int) -> TreeEncoder:
    key = path, pattern, leaf
    if key not in _encoders:
        _encoders[key] = TreeEncoder(read_ranks(path), pattern, leaf)
    return _encoders[key]


def _encoded(path: str, pattern: str, leaf: int, at_once: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_encoder(path, pattern, leaf)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for part in by_size(list(map(len, texts)), at_once):
                ids = [tree.encode(texts[i]) for i in part]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.start, len(part)),
                     pa.array(map(len, ids), pa.int64()),
                     pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "n_tokens", "ids"])
    return run


def _decoded(path: str, pattern: str, leaf: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_encoder(path, pattern, leaf)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                raw = tree.decode(np.frombuffer(row.column("ids")[0].as_py() or b"", "<u4"))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([raw], pa.binary())],
                                                 names=["doc_id", "n_tokens", "ids", "decoded"])
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", leaf: int = 1_024, at_once: int = 4_000_000) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit, as a
    file of tokens holds them).

    Each match of the pattern is encoded separately by the ranks in the file, without special
    tokens. Null text counts as empty and has no token. Rows with null or repeated ids are documents
    of their own. A very long text is held by one task together with its ids, and takes time in
    proportion to its length times its logarithm at most. An empty table gives an empty result;
    other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoded(ranks_path, pattern, leaf, at_once),
                           "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, leaf: int = 1_024) -> DataFrame:
    """What encode() returns, with a column decoded: the bytes its ids stand for."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        _decoded(ranks_path, pattern, leaf),
        "doc_id long, n_tokens long, ids binary, decoded binary")
