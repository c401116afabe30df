"""Substring dedup with repeated-phrase automata.

Winnowed segments give the anchors that recur. Copies of a whole segment are settled by class: all
but those of the first document go. Where an anchor has different classes, one segment of each is
routed to the anchor's shard; windows equal to one of another document can be nowhere else. A shard
confirms the windows that recur between documents, compiles them to an Aho-Corasick automaton over
words and streams its segments past it to locate every occurrence. Anchors with too many classes
for a shard are taken window by window, in one more round of classes. What is found in the routed
segment holds for all segments of its class in the same first document.
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
from scriptwell.llm.common import LAST_ID, identified, with_ranges
from scriptwell.sources.workspace import write_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLASS = ("root", "content")
HITS = "root long, content long, low int, high int"


def words_cut(text: bytes):
    words = text.split()
    return lambda a, b: b" ".join(words[a:b])


def _symbol(i: int) -> str:
    """The i-th character that isn't a surrogate."""
    return chr(i + 1 if i < 0xD7FF else i + 0x801)


def locate(segments: list[tuple[int, bytes]], window: int) -> list[list[int]]:
    """For each segment (place, words) the starts of its windows that a smaller place also has."""
    import ahocorasick

    symbols: dict[bytes, str] = {}
    lines = []
    for _, body in segments:
        lines.append("".join([symbols.setdefault(w, _symbol(len(symbols)))
                              for w in body.split(b" ")]))
    places: dict[str, list[int]] = {}
    for (place, _), line in zip(segments, lines, strict=True):
        for s in range(len(line) - window + 1):
            ends = places.setdefault(line[s:s + window], [place, place])
            ends[0], ends[1] = min(ends[0], place), max(ends[1], place)
    phrases = ahocorasick.Automaton()
    for phrase, (first, last) in places.items():
        if first < last:
            phrases.add_word(phrase, first)
    if not len(phrases):
        return [[] for _ in segments]
    phrases.make_automaton()
    return [[end - window + 1 for end, first in phrases.iter(line) if first < place]
            for (place, _), line in zip(segments, lines, strict=True)]


def _shard(window: int):
    def run(key, rows):
        places, bodies = rows["place"].to_pylist(), rows["body"].to_pylist()
        hits = locate(list(zip(places, bodies, strict=True)), window)
        source = np.array([i for i, x in enumerate(hits) if x], np.int64)
        base = rows["a"].to_numpy()[source]
        ends = np.array([(min(x), max(x)) for x in hits if x], base.dtype).reshape(-1, 2)
        return pa.table({"root": rows["root"].take(pa.array(source)),
                         "content": rows["content"].take(pa.array(source)),
                         "low": base + ends[:, 0], "high": base + ends[:, 1]})
    return run


def _without(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, texts = [], [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges"), strict=True):
            words = winnow.unzip(text.as_py()).split()
            spans = winnow.merged(ranges.as_py() or [])
            total.append(len(words))
            gone.append(sum(b - a for a, b in spans))
            for a, b in reversed(spans):
                del words[a:b]
            texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(total, pa.int64()),
             pa.array(gone, pa.int64()), pa.array(texts, pa.string())],
            names=["doc_id", "text_hash", "n_words", "n_removed", "text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    window: int = 50, gram: int = 12, shard_rows: int = 2_000,
                    crowd: int = 2_000) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_words, n_removed, text (kept words, joined by
    one space).

    A word goes if it lies in a window of that many words of its document that also starts in a
    document with a smaller id; windows are judged on the input. Null and blank texts have no
    words. Null ids are larger than all others and equal to each other; rows that share an id are
    not smaller than one another, so repeated rows keep the same words. Texts shorter than a
    window never change. An empty table gives an empty result; other columns are not read.
    """
    named = identified(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col)
    found = write_once(winnow.segments(named, winnow.word_units, window, gram), "phrase-segments")
    again = winnow.recurring(found, "phrase-recurring")
    kinds = write_once(winnow.classes(again), "phrase-classes")
    place = F.coalesce("doc_id", F.lit(LAST_ID))

    pieces = write_once(winnow.slices(
        named, kinds.withColumn("root", F.col("anchor")), words_cut, winnow.word_units, window,
        crowd, "phrase-kinds", CLASS), "phrase-slices")
    shards = winnow.in_shards(pieces.where("NOT crowded"), shard_rows)
    located = shards.groupBy("shard").applyInArrow(_shard(window), HITS)

    crowded = winnow.crowded_windows(pieces, "phrase-crowds", CLASS)
    firsts = crowded.groupBy("h").agg(F.min("place").alias("least"))
    crowded = crowded.join(firsts, "h").where("place > least") \
        .select(*CLASS, F.col("a").alias("low"), F.col("a").alias("high"))

    # A segment's windows all overlap, so the outermost two that are found cover the others.
    hits = located.unionByName(crowded).groupBy(F.col("root").alias("anchor"), "content") \
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # Stored before the join, so that Spark can split a task with a hot class.
    settled = write_once(
        kinds.join(hits, ["anchor", "content"], "left").where("n > 1 OR low IS NOT NULL").select(
            "anchor", "content", F.col("first.place").alias("least"),
            (F.col("low") - F.col("first.a")).alias("low"),
            (F.col("high") - F.col("first.a") + window).alias("high")), "phrase-settled")

    alike = again.where("alike").where(place > F.col("first_place")).select(
        "doc_id", "text_hash", "a", (F.col("b") + window).alias("b"))
    later = place > F.col("least")
    other = again.where("NOT alike").join(settled, ["anchor", "content"]) \
        .where(later | F.col("low").isNotNull()).select(
            "doc_id", "text_hash",
            F.when(later, F.col("a")).otherwise(F.col("a") + F.col("low")).alias("a"),
            F.when(later, F.col("b") + window).otherwise(F.col("a") + F.col("high")).alias("b"))

    ranges = winnow.spans_by_document(alike, other)
    return with_ranges(winnow.zipped(named), ranges).mapInArrow(
        _without, "doc_id long, text_hash long, n_words long, n_removed long, text string")
