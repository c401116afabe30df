import re

import random
import re

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from scriptwell.fixed_values import PHI_COUNT_ONLY, PHI_PATTERNS
from scriptwell.functions import text as tx
from scriptwell.functions.overlap import shared_words
from scriptwell.operators import corpus


def expected(text):
    """Straight reading of the rules in plain Python."""
    found = {}
    for label, pattern in PHI_PATTERNS.items():
        n = len(list(re.finditer(pattern, text)))
        if n:
            found[label] = n
        if label not in PHI_COUNT_ONLY:
            text = re.sub(pattern, lambda m, x=label: f"[REDACTED:{x.upper()}]", text)
    return text, found


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = corpus.redacted(df, "text").orderBy("id").collect()
    return [(r.redacted, r.findings) for r in rows]


CASES = [
    "SSN 123-45-6789 here", "call (555) 123-4567 or +1-555-123-4567", "555.123.4567x",
    "mail a.b+c@d-e.com now", "ip 10.0.0.255 and http://10.0.0.1/x?y=1 end",
    "https://example.org/path born 1/2/1980 or 03-04-99", "MRN: 12345 mrn#9999 Mrn 1234",
    "NPI 1234567890 stays", "é123-45-6789 and 123-45-6789é", "no digits at all", " ",
    "1234567890 1234567890 5551234567", "٣٣٣-٤٤-٥٥٥٥", "x@y", "id 12345678901",
]


def test_each_pattern(spark):
    assert run(spark, CASES) == [expected(t) for t in CASES]


def test_plain_column_form_agrees(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "text string")
    assert [r[0] for r in df.select(tx.redact_phi("text")).collect()] == [
        expected(t)[0] for t in CASES]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="0123456789-. ()+@/:#MRNmrnaé", max_size=40), min_size=40,
                max_size=60))
def test_random_texts(spark, texts):
    assert run(spark, texts) == [expected(t) for t in texts]


def test_empty_and_missing_text(spark):
    assert run(spark, ["", None]) == [("", {}), (None, {})]


def test_blank_texts_are_quarantined(spark):
    df = spark.createDataFrame([("a",), ("  \n",), ("",), (None,), ("1.2.3.4",)], "text string")
    safe, held = corpus.safe_text(df, "text")
    assert sorted(r.text for r in safe.collect()) == ["1.2.3.4", "a"]
    assert held.count() == 3


def test_findings_by_category(spark):
    df = spark.createDataFrame([("1.2.3.4 5.6.7.8",), ("1.2.3.4 a@b.cc",)], "text string")
    rows = {r.category: (r.found, r.texts) for r in corpus.findings_by_category(df, "text").collect()}
    assert rows == {"ip_address": (3, 2), "email": (1, 1)}


def python_chunks(text, size=200, overlap=30):
    listed = text.split()
    if len(listed) <= size:
        return [text]
    out, start = [], 0
    while True:
        out.append(" ".join(listed[start:start + size]))
        if start + size >= len(listed):
            return out
        start += size - overlap


@pytest.mark.parametrize("n", [0, 1, 200, 201, 370, 371, 540, 541, 5000])
def test_chunk_sizes(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(tx.chunks("text")).first()[0] == python_chunks(text)


def test_chunk_whitespace_and_small_windows(spark):
    text = "  a  b\n\nc\td e   f g  "
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(tx.chunks("text", 3, 1)).first()[0] == python_chunks(text, 3, 1)
    assert df.select(tx.chunks("text", 9, 1)).first()[0] == [text]
    with pytest.raises(ValueError):
        tx.chunks("text", 3, 3)


def test_every_kind_of_whitespace_splits(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    text = "".join(f"w{i}{s}" for i, s in enumerate(spaces)) + "a\u200bb\ufeffc"
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(tx.words("text")).first()[0] == text.split()


def test_chunk_rows(spark):
    df = spark.createDataFrame([("kb", "x", "a b c d e")], "id string, category string, text string")
    rows = corpus.chunk_rows(df, "id", "text", ["category"], 3, 1).orderBy("chunk_no").collect()
    assert [(r.chunk_id, r.category, r.chunk) for r in rows] == [
        ("kb_chunk0", "x", "a b c"), ("kb_chunk1", "x", "c d e")]


@pytest.mark.parametrize("question,intent,year", [
    ("Which STATE had the highest spend in 2022?", "top_state", 2022),
    ("top drugs", "top_drugs", 2024),
    ("most expensive drug by state", "top_state", 2024),
    ("generic vs. brand 2021 or 2023", "generic_vs_brand", 2021),
    ("highest prescriber", "top_prescribers", 2024),
    ("opioid claims 12023", "opioid_by_state", 2024),
    ("average cost per claim", "avg_cost", 2024),
    ("most cost", "top_state", 2024),
    ("drugs2023state top", "top_state", 2024),
    ("hello", None, 2024),
    ("", None, 2024),
])
def test_question_routing(spark, question, intent, year):
    df = spark.createDataFrame([(question,)], "q string")
    row = corpus.route_questions(df, "q").first()
    assert (row.intent, row.year) == (intent, year)


def test_word_overlap(spark):
    docs = spark.createDataFrame([(1, "Généric drugs."), (2, "the END"), (3, "")], "id int, t string")
    rows = corpus.token_overlap(docs, "t", ["an end", "généric the", "gén"]).collect()
    assert sorted((r.id, r.question_no) for r in rows) == [(1, 1), (2, 0), (2, 1)]


@pytest.mark.parametrize("together", [1, 2, 100])
def test_shared_tokens_of_two_tables(spark, together):
    texts = ["the end of the road", "The road", None, "", "end!", "the the the", "Généric"]
    asked = ["the end, the END", "road works", None, "", "généric the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    questions = spark.createDataFrame(list(enumerate(asked)), "q int, text string")
    got = corpus.shared_tokens(docs, questions, "d", "q", rows_together=together).collect()
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    want = {(d, q): len(words(t) & words(a)) for d, t in enumerate(texts)
            for q, a in enumerate(asked) if words(t) & words(a)}
    assert {(r.doc_id, r.question_id): r.shared for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("limit", [60, 1000])
def test_shared_tokens_counts_pairs_where_they_arise(spark, monkeypatch, limit):
    """Every pair comes from one task: one shuffle, of words, and no aggregate after it."""
    for name in ("WORDS_TOGETHER", "PAIRS_TOGETHER", "DOCS_TOGETHER"):
        monkeypatch.setattr(corpus, name, limit, raising=False)
    words, rng = ["Été", "a", "b_1", "ß", "ÀB", "नमस्ते", "7", *"cdefgh"], random.Random(3)
    texts, asked = ([" - ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(n)]
                    for n in (60, 25))
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "d string, text string")
    questions = spark.createDataFrame(list(enumerate(asked)), "q int, text string")
    got = corpus.shared_tokens(docs, questions, "d", "q", rows_together=7)
    held = [{w.lower() for w in t.split(" - ") if w} for t in texts]
    want = {(f"d{i}", j): len(d & q) for i, d in enumerate(held)
            for j, q in enumerate({w.lower() for w in t.split(" - ") if w} for t in asked) if d & q}
    rows = got.collect()
    assert {(r.doc_id, r.question_id): r.shared for r in rows} == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan


@pytest.mark.parametrize("together", [1, 3, 10_000])
def test_shared_words_of_batches(together):
    """Questions and documents of a cell may be dealt over batches, and a batch hold many cells."""
    cells = [(0, False, None, "q0", "a b"), (0, False, None, "q1", "b c"),
             (0, True, 1, None, "b c x"), (0, True, 2, None, ""), (0, True, 3, None, "a"),
             (1, True, 9, None, "a"), (2, False, None, "q2", "x"), (2, True, 1, None, "x"),
             (2, True, 4, None, "y"), (3, False, None, "q3", "a")]
    names = ["cell", "is_doc", "doc_id", "question_id", "words"]
    kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
    for size in (1, 2, 3, len(cells)):
        batches = [pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*cells[i:i + size]), kinds, strict=True)], names=names)
            for i in range(0, len(cells), size)]
        got = [tuple(r.values()) for b in shared_words(together)(batches) for r in b.to_pylist()]
        assert sorted(got) == [(1, "q0", 1), (1, "q1", 2), (1, "q2", 1), (3, "q0", 1)]


def test_patterns_run_once_per_row(spark):
    df = spark.createDataFrame([("x",)], "text string")
    plan = corpus.findings_by_category(df, "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == len(PHI_PATTERNS) - len(PHI_COUNT_ONLY)
