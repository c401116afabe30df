"""Tree encoding, lexical search and token alignment against the libraries and brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptwell.llm import alignment, bytetree, lexical
from scriptwell.llm.queries import PIECES, RANKS, splitting_pattern, tokenizer_path

SCHEMA = "doc_id long, text string, n int, ids string, query string, block string"
ATOMS = ["a", "ll", "'s", "'ll", "'", "re", "é", "漢字", "  ", " ", "\n", "\t", " \n ", "12", "3", "!!",
         "(", "...", "_", "word", " Der", "\xa0", "🙂", "́", "x'", "aaaa", "¾", "一", "\x1c",
         "<|endoftext|>", "<0x41>", "</s>", "\x00"]
mixed = st.lists(st.tuples(st.sampled_from(ATOMS), st.sampled_from([1, 1, 2, 5, 30])), max_size=40) \
    .map(lambda parts: "".join(a * n for a, n in parts))

TEXTS = ["", None, " ", "one two one", "One, TWO! three's", "ñandú Ñandú 漢字 漢字x", "a▁b c", "\n\n x  y ",
         "don't we'll I've", "word " * 4_000, "x" * 5_000, "\t" * 3_000 + "z", "🙂🙂 <0x41> <|endoftext|>",
         "one two one", "7 7 7 seven", "𝄞", "tab\tand space", "one " * 3 + "two"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 7 else None, t, 1, "clash", "clash", "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- tree encoding ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ranks():
    return bytetree.read_ranks(tokenizer_path(RANKS))


@pytest.fixture(scope="module")
def tree(ranks):
    return bytetree.TreeEncoder(ranks, splitting_pattern())


def test_every_token_encodes_itself(ranks):
    """What joining inside a match rests on, by a plain merge loop."""
    def merged(token):
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], len(ranks)), i)
                          for i in range(len(parts) - 1))
            if rank == len(ranks):
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts
    assert all(merged(token) == [token] for token in ranks)


@settings(max_examples=300, deadline=None)
@given(text=mixed, leaf=st.integers(1, 40), reach=st.integers(1, 16))
def test_tree_equals_library(tree, text, leaf, reach):
    tree.leaf, tree.reach = leaf, reach
    ids = tree.encode(text)
    assert ids.tolist() == tree.codec.encode_ordinary(text)
    assert tree.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 40_001, "漢" * 30_000, "=" * 50_000, "ab'll" * 9_000, "7" * 9_999,
                                  "n" * 20_000 + "\n" * 30_000 + "x"])
def test_tree_of_long_runs(tree, text):
    tree.leaf, tree.reach = 64, 8
    assert tree.encode(text).tolist() == tree.codec.encode_ordinary(text)


def test_tree_of_more_blanks_than_the_pattern_takes(tree):
    tree.leaf, tree.reach = 1_024, 32
    text = " " * 1_500_000 + "x"
    ids = tree.encode(text)
    assert tree.decode(ids) == text.encode()
    single = tree.codec._encode_single_piece(" " * 1_499_999)
    assert ids.tolist() == single + tree.codec.encode_ordinary(" x")


def test_joins_look_at_windows_only(tree):
    """A join re-encodes a few characters, not its halves."""
    tree.leaf, tree.reach = 64, 32
    seen, direct = [], tree._direct
    tree._direct = lambda text: seen.append(len(text)) or direct(text)
    try:
        tree.encode("plain words follow each other here " * 500)
        tree.encode("漢字仮名交" * 4_000)
    finally:
        del tree._direct
    assert max(seen) <= 4 * 64


def test_encode_rows(docs, empty, tree):
    args = tokenizer_path(RANKS), splitting_pattern()
    encoded = bytetree.encode(docs, *args, leaf=16, at_once=50)
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"]))
                  for r in bytetree.decode(encoded, *args, leaf=3).collect())
    want = Counter()
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = tree.codec.encode_ordinary(text or "")
        want[doc_id, len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode()] += 1
    assert got == want
    assert bytetree.decode(bytetree.encode(empty, *args), *args).count() == 0


# -- lexical search --------------------------------------------------------------------------------

def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranked(docs, items, k):
    """The contract, word by word."""
    held = [(d, Counter(t), len(t)) for d, t in ((d, terms(t)) for d, t in docs) if t]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, counted, _ in held for t in counted)
    out = []
    for item, text in items:
        scores = []
        for doc, counted, size in held:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * counted[t]) // (1000 * counted[t] + 12 * m))
                        for t in terms(text) if t in counted)
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, doc) in enumerate(sorted(
            scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


ITEMS = [(1, "one TWO"), (2, "word word three"), (3, None), (4, "!!"), (5, "漢字 Ñandú ñandú"), (6, "absent"),
         (None, "seven 7"), (1, "one TWO"), (1, "other text, same id: word"), (7, "s don t we ll")]


@pytest.mark.parametrize("options", [{}, {"part_rows": 3, "leaf": 1}, {"items_together": 2}])
def test_search(spark, docs, options):
    items = spark.createDataFrame([(*x, "clash") for x in ITEMS], "item_id long, text string, n string")
    got = Counter(map(tuple, lexical.search(docs, items, k=3, **options).collect()))
    assert got == ranked(docs.select("doc_id", "text").collect(), list(dict.fromkeys(ITEMS)), 3)


def test_search_empty(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "..")], "doc_id long, text string")
    assert lexical.search(blank, items).count() == 0


def test_ball_tree_is_exact_and_prunes():
    """Clustered rows: exact scores and ties, while most rows are never scored."""
    r = np.random.default_rng(2)
    rows = []
    for cluster in range(40):
        base = r.choice(400, 12, replace=False)
        for _ in range(50):
            own = np.unique(np.concatenate([r.choice(base, 9, replace=False), r.choice(400, 1)]))
            rows.append((own, r.integers(800_000, 1_000_000, len(own))))
    rows += rows[:60]
    sizes = np.array([len(t) for t, _ in rows])
    tree = lexical.BallTree(sizes, np.concatenate([t for t, _ in rows]),
                            np.concatenate([v for _, v in rows]), 400, 16)
    dense = np.zeros((len(rows), 400), np.int64)
    for i, (t, v) in enumerate(rows):
        dense[i, t] = v
    ids, spread, scored = r.permutation(len(rows)), np.zeros(400, np.int64), 0
    nothing = np.empty(0, np.int64)
    for q in range(30):
        places, weights = rows[q * 60][0], r.integers(1, 9_000, len(rows[q * 60][0]))
        scores, found, n = tree.best(places, weights, ids, 20, nothing, nothing, spread)
        exact = dense[:, places] @ weights
        best = np.lexsort((ids, -exact))[:20]
        best = best[exact[best] > 0]
        assert scores.tolist() == exact[best].tolist() and found.tolist() == ids[best].tolist()
        scored += n
    assert scored < 0.5 * 30 * len(rows)
    assert not spread.any()


# -- token alignment -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(tokenizer_path(), tokenizer_path(PIECES))


def plain(aligner, text):
    """Ids, groups and links from whole texts and decoded bytes alone; None without tokens."""
    if not text:
        return None
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text)
    ends = []
    for ids, table in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
        ends.append(np.cumsum([len(table[i]) for i in ids]).tolist())
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, links, at = [], [], 0
    for cut in cuts:
        inside = [[i for i, e in zip(ids, own, strict=True) if at < e <= cut]
                  for ids, own in zip((a, b), ends, strict=True)]
        groups.append("|".join(",".join(map(str, x)) for x in inside))
        at = cut
    starts = [[0, *x[:-1]] for x in ends]
    for i, x in enumerate(a):
        low = np.searchsorted(ends[1], starts[0][i], "right")
        high = np.searchsorted(starts[1], ends[0][i], "left")
        links += [(x, b[j]) for j in range(low, high)]
    return len(a), len(b), len(groups), ";".join(groups), links


@settings(max_examples=200, deadline=None)
@given(text=mixed)
def test_alignment_of_one_text(aligner, text):
    counts, groups, links = aligner.documents([text, "other words", text])
    want = plain(aligner, text) or (0, 0, 0, "", [])
    assert counts[0].tolist() == counts[2].tolist() == [*want[:3], len(want[4])]
    assert groups[0] == groups[2] == want[3]
    assert sorted(links[:counts[0, 3]]) == sorted(x * alignment.PAIR + y for x, y in want[4])


@pytest.mark.parametrize("at_once", [40, 1_000_000])
def test_align_rows(docs, aligner, at_once):
    rows = [(d, plain(aligner, t)) for d, t in docs.select("doc_id", "text").collect()]
    total = Counter(link for _, found in rows if found for link in found[4])
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    want = Counter()
    for d, found in rows:
        a, b, n, groups, links = found or (0, 0, 0, "", [])
        want[d, a, b, n, groups, len(links), sum(total[x] == most[x[1]] for x in links),
             sum(total[x] for x in links)] += 1
    got = alignment.align(docs, tokenizer_path(), tokenizer_path(PIECES), at_once=at_once)
    assert Counter(map(tuple, got.collect())) == want
    digests = alignment.align(docs, tokenizer_path(), tokenizer_path(PIECES), digest=True)
    assert Counter(r["groups"] for r in digests.collect()) == Counter(
        {(hashlib.sha256(g.encode()).hexdigest() if g else ""): n
         for g, n in Counter(x[4] for x in want.elements()).items()})


def test_align_empty(empty):
    assert alignment.align(empty, tokenizer_path(), tokenizer_path(PIECES)).count() == 0


def test_what_an_aligner_remembers_is_bounded():
    """Texts without spaces are one cut each: few cuts, but of many characters."""
    own = alignment.Aligner(tokenizer_path(), tokenizer_path(PIECES))
    for n in range(8):
        own.documents(["-".join(map(str, range(n * 200_000, n * 200_000 + 120_000)))])
        assert sum(map(len, own.known)) <= 5_000_000
    assert len(own.groups) == len(own.known) == len(own.counts)


@pytest.mark.parametrize("text", ["<|endoftext|>", " " * 100_001 + "<|endoftext|> x", "\t" * 100_001])
def test_codec_of_plain_text(aligner, text):
    """Strings of special tokens are text, and long runs of blanks are cut as the library cuts."""
    assert aligner.codec.ids(text) == aligner.a.encode(text, add_special_tokens=False).ids
