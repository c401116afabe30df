"""Alignment of the tokens of two tokenizers.

Texts are cut where both tokenizers must cut: before spaces that follow a character which is no
white space. Each different cut is encoded once for all texts held together. The bytes that tokens
decode to tell where they end, also those that share a character or are fallback bytes of one.
Places where tokens of both end divide a cut into groups; overlapping tokens are links.

Counts of linked id pairs need the whole corpus. Texts are held in blocks of bounded size. A block
asks once for each pair it holds, the pairs are counted and joined back to the blocks that asked,
and each block's answers meet its texts again.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptwell.llm.common import by_size
from scriptwell.llm.packing import Encoder
from scriptwell.sources.workspace import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
CUT = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*(?:\s+\Z)?|\s+")
#: A link is one number: the byte-level id times this, plus the piece id.
PAIR = 1 << 15
#: Different cuts remembered between blocks of one task, and their characters.
REMEMBERED, REMEMBERED_CHARS = 200_000, 4_000_000


class Aligner:
    """Tokens, groups and links of cuts. What is known of a cut lies at its place in the tables."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor

        self.a_path = a_path
        self.codec = Encoder(a_path, plain=True)
        self.a_bytes = self.codec.token_bytes()
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) > PAIR:
            raise ValueError(f"the piece model has {len(pieces)} ids, at most {PAIR} fit")
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after another character")
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i)
                        else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes,
                                                                           self.b_bytes))
        # What an id is written as: A inside and at the end of a group, B likewise.
        self.written = [f"{i}{mark}" for n, marks in ((len(self.a_bytes), ",|"), (len(pieces), ",;"))
                        for i in range(n) for mark in marks]
        self.written_size = np.array([len(x) for x in self.written])
        self.forget()

    @cached_property
    def a(self):
        """The library's tokenizer of the same file, whose ids the codec's are."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.a_path)
        library.encode_special_tokens = True
        return library

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_chars = 0
        self.groups: list[str] = []
        self.counts = np.empty((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.bad = np.empty(0, bool)
        self.links = np.empty(0, np.int32)

    def learn(self, cuts: Iterable[str]) -> None:
        """Encode the cuts not known yet, many neighbours as one text: where they meet is a cut."""
        new = [c for c in dict.fromkeys(cuts) if c not in self.known]
        self.known_chars += sum(map(len, new))
        found: list[tuple] = []
        for at in range(0, len(new), 8_192):
            texts: list[list[str]] = [[]]
            for cut in new[at:at + 8_192]:
                if len(texts[-1]) == 64 or texts[-1] and texts[-1][-1][-1].isspace():
                    texts.append([])
                texts[-1].append(cut)
            self._learn(texts, found)
        if found:
            counts, bad, links = zip(*found, strict=True)
            self.counts = np.concatenate([self.counts, *counts])
            self.bad = np.concatenate([self.bad, *bad])
            self.links = np.concatenate([self.links, *links])

    def _learn(self, texts: list[list[str]], found: list[tuple]) -> None:
        whole = ["".join(cuts) for cuts in texts]
        # The model puts a space before what it gets.
        pieces = self.b.encode([t[1:] for t in whole], out_type=int, num_threads=1)
        good, again, a, b = [], [], [], []
        for cuts, text, b_ids in zip(texts, whole, pieces, strict=True):
            raw, a_ids = text.encode(), self.codec.ids(text)
            if (b"".join(map(self.a_bytes.__getitem__, a_ids)) == raw
                    and b"".join(map(self.b_bytes.__getitem__, b_ids)) == raw):
                good += cuts
                a += a_ids
                b += b_ids
            else:
                again.append(cuts)
        if good:
            found.append(self._add(good, np.array(a), np.array(b)))
        for cuts in again:
            if len(cuts) > 1:
                self._learn([[c] for c in cuts], found)
            else:
                self.known[cuts[0]] = len(self.known)
                self.groups.append("")
                found.append((np.zeros((1, 4), np.int64), np.ones(1, bool), np.empty(0, np.int32)))

    def _add(self, cuts: list[str], a_ids: np.ndarray, b_ids: np.ndarray) -> tuple:
        """Groups of cuts that lie one after another; their counts, marks and links.

        How many tokens of either have ended up to a byte tells all places by a look."""
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        in_a, in_b = np.zeros((2, a_ends[-1] + 1), bool)
        in_a[a_ends] = in_b[b_ends] = True
        ends, group_ends = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
        a_done, b_done = np.cumsum(in_a), np.cumsum(in_b)
        # The tokens that end at a byte or hold it: those after all that ended before it.
        links = (a_ids[a_done[ends] - in_a[ends]] * PAIR
                 + b_ids[b_done[ends] - in_b[ends]]).astype(np.int32)
        cut_ends = np.cumsum([len(c.encode()) for c in cuts])
        counts = np.stack([np.diff(np.cumsum(x)[cut_ends], prepend=0)
                           for x in (in_a, in_b, in_a & in_b, in_a | in_b)], axis=1)
        # Group by group, A's tokens before B's: each comes after the other's tokens up to there.
        a_closes, b_closes = in_b[a_ends], in_a[b_ends]
        a_group, b_group = (np.cumsum(x) - x for x in (a_closes, b_closes))
        written = np.empty(len(a_ids) + len(b_ids), np.int64)
        written[np.arange(len(a_ids)) + np.append(0, b_done[group_ends])[a_group]] = \
            2 * a_ids + a_closes
        written[np.arange(len(b_ids)) + a_done[group_ends][b_group]] = \
            2 * (len(self.a_bytes) + b_ids) + b_closes
        text = "".join(map(self.written.__getitem__, written.tolist()))
        stops = np.cumsum(self.written_size[written])[np.cumsum(counts[:, :2].sum(axis=1)) - 1]
        self.groups += [text[a:b - 1] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(),
                                                      strict=True)]
        self.known |= {c: i for i, c in enumerate(cuts, len(self.known))}
        return counts, np.zeros(len(cuts), bool), links

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Counts (A tokens, B tokens, groups, links) and groups of each text, and all links, text
        after text; zeros and an empty string for a text without tokens."""
        if len(self.known) > REMEMBERED or self.known_chars > REMEMBERED_CHARS:
            self.forget()
        cuts = [CUT.findall(" " + t) if t and SPACE not in t else [] for t in texts]
        self.learn(chain.from_iterable(cuts))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cuts)), np.int64)
        ends = np.cumsum([0, *map(len, cuts)])
        wrong = np.diff(np.concatenate([[0], np.cumsum(self.bad[at])])[ends]) > 0
        at = at[~np.repeat(wrong, np.diff(ends))]
        ends = np.cumsum(np.concatenate([[0], np.where(wrong, 0, np.diff(ends))]))
        counts = np.diff(np.concatenate([np.zeros((1, 4), np.int64),
                                         np.cumsum(self.counts[at], axis=0)])[ends], axis=0)
        places = at.tolist()
        groups = [";".join(map(self.groups.__getitem__, places[a:b]))
                  for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        starts = np.concatenate([[0], np.cumsum(self.counts[:, 3])])[at]
        sizes = self.counts[at, 3]
        before = np.cumsum(sizes) - sizes
        links = self.links[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]
        return counts, groups, links


ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, groups string, links array<int>, "
           "block long")
_NAMES = [c.split()[0] for c in ALIGNED.split(", ")]


def _aligned(a_path: str, b_path: str, digest: bool, at_once: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            for part in by_size(sizes, at_once):
                held = texts.slice(part.start, len(part)).to_pylist()
                counts, groups, links = aligner.documents([x or "" for x in held])
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                ends = np.cumsum(np.concatenate([[0], counts[:, 3]])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.start, len(part)),
                     *(pa.array(counts[:, i]) for i in range(3)), pa.array(groups, pa.string()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(links)),
                     pa.array([block] * len(part), pa.int64())], names=_NAMES)
                block += 1
                pa.default_memory_pool().release_unused()  # else what batches took is kept
    return run


def _answered(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over a block's texts of what is known of their links."""
    links = docs["links"].combine_chunks()
    codes = links.flatten().to_numpy()
    sizes = np.diff(links.offsets.to_numpy())
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(answers["code"].to_numpy())
    place = order[np.searchsorted(answers["code"].to_numpy()[order], codes)] if len(codes) else \
        np.empty(0, np.int64)

    def sums(column: str) -> pa.Array:
        ends = np.cumsum(np.concatenate([[0], answers[column].to_numpy()[place]]).astype(np.int64))
        return pa.array(ends[bounds[1:]] - ends[bounds[:-1]], pa.int64())

    return pa.table({**{c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "groups")},
                     "n_links": pa.array(sizes, pa.int64()),
                     "n_best": sums("best"), "count_sum": sums("total")})


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id",
          text_col: str = "text", digest: bool = False, at_once: int = 2_000_000) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, groups, n_links, n_best, count_sum.

    Tokenizer A (a byte-level file) encodes a space and the text, B (a piece model that puts a
    space before) the text; strings of special tokens are plain text. groups is written
    "a1,a2|b1;a3|b2,b3"; with digest it is that text's SHA-256 in lowercase hex. A link is
    an A and a B token occurrence whose byte ranges overlap; a pair of ids counts as often as links
    hold it in the whole table. n_best counts links whose pair is counted highest among those of
    its B id, ties included; count_sum adds up the counts of all links.

    Null and empty texts, texts that hold the piece model's space mark and other texts that either
    tokenizer doesn't give back have no tokens: zeros and an empty string. Rows with null or repeated
    ids are documents of their own. A block holds about at_once characters; a longer text is a block
    of its own, held by one task with its links. An empty table gives an empty result; other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = write_once(rows.mapInArrow(_aligned(a_path, b_path, digest, at_once), ALIGNED),
                       "alignment-texts")
    asked = write_once(texts.select("block", F.explode("links").alias("code"))
                       .groupBy("block", "code").count(), "alignment-pairs")
    totals = write_once(asked.groupBy("code").agg(F.sum("count").alias("total")),
                        "alignment-totals")
    highest = totals.groupBy((F.col("code") % PAIR).alias("b")).agg(F.max("total").alias("most"))
    known = totals.join(highest, F.col("code") % PAIR == F.col("b")).select(
        "code", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    answers = asked.select("block", "code").join(known, "code").select(
        "block", "code", "total", "best")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _answered, "doc_id long, n_a long, n_b long, n_groups long, groups string, n_links long, "
                   "n_best long, count_sum long")
