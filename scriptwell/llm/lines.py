"""Line dedup by winnowing over line hashes.

Of every min_lines consecutive lines the one of least hash is selected, so two equal runs of that
length select the same line: a guaranteed fingerprint. Long lines are fingerprints by themselves.
Positions whose fingerprint recurs are joined and extended both ways over the hashes of the lines
around them; of equal extensions the earliest place stays and the later ones are deleted. Longer
runs are the overlap of their extensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptwell.llm.common import identified, unused
from scriptwell.sources.workspace import write_once


def fingerprints(docs: DataFrame, min_lines: int, long_chars: int) -> DataFrame:
    """doc_id, text_hash, h, low, around: every selected line, with the up to min_lines - 1 lines
    before and after it; low is its index among them. Of equal least hashes the first is selected."""
    lines = F.split("text", "\n", -1)
    seen = F.transform(lines, lambda x, i: F.struct(
        (F.length(F.trim(x)) == 0).alias("blank"), F.xxhash64(x).alias("h"), i.alias("at"),
        (F.length(F.trim(x)) >= long_chars).alias("long")))
    hashed = docs.where(F.col("text").isNotNull()).select("doc_id", "text_hash", seen.alias("seen"))
    least = F.transform(
        F.sequence(F.lit(0), F.size("seen") - min_lines),
        lambda s: F.array_min(F.slice("seen", s + 1, min_lines)))
    minima = F.when(F.size("seen") >= min_lines, F.filter(least, lambda x: ~x["blank"])) \
        .otherwise(F.slice("seen", 1, 0))
    marked = hashed.withColumn("marks", F.array_distinct(F.concat(
        minima, F.filter("seen", lambda x: x["long"]))))
    first = lambda m: F.greatest(m["at"] - (min_lines - 1), F.lit(0))
    return marked.select("doc_id", "text_hash", F.inline(F.transform("marks", lambda m: F.struct(
        m["h"].alias("h"), (m["at"] - first(m)).alias("low"),
        F.slice("seen", first(m) + 1, m["at"] - first(m) + min_lines).alias("around")))))


def selects(run: list[Column], o: int, counts) -> Column:
    """Whether the line at index o is the first of least hash among the lines that count."""
    own = run[o]
    found = counts(own)
    for j, other in enumerate(run):
        if j != o:
            above = other["h"] > own["h"] if j < o else other["h"] >= own["h"]
            found = found & (~counts(other) | above)
    return found


def extended(positions: DataFrame, min_lines: int) -> DataFrame:
    """doc_id, text_hash, h, start, n, run: the runs around each position that it is the
    fingerprint of. Runs of min_lines lines, not all blank; shorter ones with a long line."""
    runs = []
    for n in range(1, min_lines + 1):
        for o in range(n):
            run = [F.get("around", F.col("low") - o + j) for j in range(n)]
            inside = (F.col("low") >= o) & (F.col("low") - o + n <= F.size("around"))
            counts = (lambda x: ~x["blank"]) if n == min_lines else (lambda x: x["long"])
            runs.append(F.when(inside & selects(run, o, counts), F.struct(
                run[0]["at"].alias("start"), F.lit(n).alias("n"),
                F.xxhash64(F.lit(n), *[x["h"] for x in run]).alias("run"))))
    return positions.select("doc_id", "text_hash", "h", F.inline(F.array_compact(F.array(*runs))))


def later_runs(named: DataFrame, min_lines: int, long_chars: int) -> DataFrame:
    """doc_id, text_hash, ranges: start and length of the runs that an earlier place holds."""
    positions = write_once(fingerprints(named, min_lines, long_chars), "line-fingerprints")
    # Both tables of each join are stored and no aggregate by the same key follows, so that Spark
    # can split the tasks of a frequent line.
    again = write_once(positions.groupBy("h").agg(F.count("*").alias("times"))
                       .where("times > 1").select("h"), "line-recurring")
    runs = write_once(extended(positions.join(again, "h"), min_lines), "line-runs")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "start")
    earliest = write_once(runs.groupBy("h", "run").agg(
        F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1").drop("times"),
        "line-firsts")
    later = runs.join(earliest, ["h", "run"]).where(place > F.col("first"))
    return later.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "n")).alias("ranges"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_lines: int = 3, long_chars: int = 40) -> DataFrame:
    """The input with the kept lines as its text, and columns n_lines and n_removed, which replace
    input columns of these names; all other columns stay as they are.

    A line goes if it lies in a run of consecutive lines that also starts earlier: in a document
    with a smaller id, or higher up in the same one. A run has min_lines lines, not all blank, or
    fewer of which one has long_chars characters, blanks at its ends not counted; a long line alone
    is a run. Runs are judged on the input. Lines end at newlines; an empty text is one empty line,
    a null text has none and stays null. Null ids come after all others. Rows that repeat id and
    text are one document and keep the same lines. A very long text is one row of one task together
    with its lines. An empty table gives an empty result.
    """
    named = identified(docs, id_col, text_col)
    ranges = later_runs(named, min_lines, long_chars)
    own_id, own_hash, found, all_lines, left = unused(
        docs.columns, "_range_id", "_range_hash", "_ranges", "_lines", "_kept")
    right = ranges.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash),
                          F.col("ranges").alias(found))
    joined = docs.join(right, docs[id_col].eqNullSafe(F.col(own_id))
                       & (F.xxhash64(docs[text_col]) == F.col(own_hash)), "left")

    lines = F.split(F.col(text_col), "\n", -1)
    covered = F.flatten(F.transform(
        found, lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), covered)
    return joined.withColumn(all_lines, lines) \
        .withColumn(left, F.when(F.col(found).isNotNull(), kept)) \
        .withColumns({
            text_col: F.when(F.col(left).isNull(), F.col(text_col)).otherwise(F.array_join(
                F.transform(left, lambda i: F.get(all_lines, i)), "\n")),
            "n_lines": F.greatest(F.size(all_lines), F.lit(0)).cast("long"),
            "n_removed": F.when(F.col(left).isNull(), 0)
            .otherwise(F.size(all_lines) - F.size(left)).cast("long")}) \
        .drop(own_id, own_hash, found, all_lines, left)
