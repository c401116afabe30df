"""The pipeline's stages against plain code, each on what the stage before it kept."""

import zlib
from collections import Counter, defaultdict

import pytest
from plain_lines import gone_lines
from tokenizers import Tokenizer

import corpus_pipeline
from scriptwell.llm import quality, simhash
from scriptwell.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """A small table with awkward rows and columns named like helpers, and its labels."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame(
        [(9_001, None, "en", None, 0), (9_002, "", "en", "web", 0), (None, "one\ntwo\nthree", None, "web", 3),
         (9_003, "a\nb\nc\nd", "en", "web", 7), (9_004, "a\nb\nc", "en", "web", 5)], docs.schema)
    rows = docs.unionByName(more).unionByName(docs.limit(2)).selectExpr(
        "*", "'keep' AS _id", "'keep' AS _hash", "'keep' AS _lines", "'keep' AS n_lines",
        "'keep' AS n_removed", "'keep' AS _copy")
    rows.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def key(row):
    return repr(sorted(row.items(), key=str))


def place(doc_id):
    return 2**63 if doc_id is None else doc_id


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{sf_dir}/stage-{n}"
        stage(spark, kept[-1], sf_dir).write.parquet(path)
        kept.append(spark.read.parquet(path))
    assert all(df.columns == columns for df in kept[:5])
    before, good, lined, single, mixed, packed = map(rows_of, kept)
    assert all(r[c] == "keep" for rows in (good, lined, single, mixed) for r in rows for c in
               ("_id", "_hash", "_lines", "n_lines", "n_removed", "_copy"))

    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = {r.text_hash: r.predicted for r in quality.score_quality(docs, model).collect()}
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    assert sorted(map(key, good)) == sorted(
        key(r) for r in before if verdict[hashes[r["text"]]] == 1)

    want = []
    places = [(place(r["doc_id"]), r["text"]) for r in good]
    for r, gone in zip(good, gone_lines(places), strict=True):
        ls = [] if r["text"] is None else r["text"].split("\n")
        text = None if r["text"] is None else "\n".join(x for i, x in enumerate(ls) if i not in gone)
        if not gone or text.strip(" "):
            want.append(key(r | {"text": text, "n_chars": None if text is None else len(text)}))
    assert sorted(map(key, lined)) == sorted(want)

    groups = defaultdict(list)
    for r in simhash.simhash_groups(kept[2]).collect():
        groups[r.component_id].append(r.doc_id)
    assert len(single) == len(groups)
    assert Counter(place(r["doc_id"]) for r in single) == Counter(
        min(map(place, ids)) for ids in groups.values())
    assert {key(r) for r in single} <= {key(r) for r in lined}

    words = lambda t: len((t or "").split())
    sizes, taken = Counter(), Counter()
    for rows, total in ((single, sizes), (mixed, taken)):
        for r in rows:
            total[r["source"]] += words(r["text"])
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    open_, target, rest = {s for s in sizes if sizes[s]}, {}, sum(sizes.values())
    while open_:
        level = rest / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not full:
            target |= {s: level * weights[s] for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in full}
        rest -= sum(3 * sizes[s] for s in full)
        open_ -= full
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)

    codec = Tokenizer.from_file(tokenizer_path())
    ids = Counter()
    for r in mixed:
        ids[r["doc_id"], tuple(codec.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)] += 1
    pieces = Counter((d, s, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x[s:s + 1024])),
                      len(x[s:s + 1024]))
                     for (d, x), n in ids.items() for _ in range(n) for s in range(0, len(x), 1024))
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"], r["length"]) for r in packed) == pieces
    ends = defaultdict(list)
    for r in packed:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in ends.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r["length"] for r in packed) > 0.97 * 1024 * (len(ends) - 1)


def test_tables_without_a_length(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").drop("n_chars")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
