"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from plain_lines import gone_lines

from scriptwell.llm import (
    ann,
    chat,
    components,
    exact,
    lines,
    mixing,
    packing,
    phrases,
    quality,
    simhash,
    suffixes,
)
from scriptwell.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, source string, size string, fp string, row_id int"


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def corpus(seed=1):
    """Copies, near copies, shared passages, repeated rows, nulls, blanks and a very long text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() + r.choice(["", ",", ".\n"]) for _ in range(n))
    shared = [prose(60), prose(55), prose(130)]
    texts = [prose(r.randint(1, 150)) for _ in range(20)]
    texts += [prose(20) + " " + r.choice(shared) + " " + prose(30) for _ in range(12)]
    texts += [texts[3], texts[3] + "  ", texts[25], texts[25].replace(" ", "\t"), shared[0]]
    near = texts[30].split(" ")
    for i in range(6):
        near[5 * i] = word()
        texts.append(" ".join(near))
    texts += ["", " \n\t", None, "x", "x y", "Der " * 300, "Der " * 300, prose(4_000), "a\x1cb\xa0c",
              "one\ntwo\nthree\nfour", "zero\none\ntwo\nthree", "\n\n\n\n", "q\n\n\n\n"]
    rows = [(i, t, f"s{i % 4}" if i % 9 else None) for i, t in enumerate(texts)]
    rows += [rows[3], (5, "another text under a known id", "s1"), (None, texts[4], "s1"),
             (None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*row, "clash", "clash", 1) for row in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def place(doc_id):
    return doc_id if doc_id is not None else 2**63 - 1


def collected(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def fingerprint(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(
        rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    pieces = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(items, close):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(items)):
        for j in range(i):
            if close(items[i], items[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(items))]


def test_simhash_components(docs, rows):
    prints = [fingerprint(t) for _, t, _ in rows]
    roots = grouped(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(list)
    for (d, _, _), root in zip(rows, roots, strict=True):
        least[root].append(place(d))
    want = sorted([(d, f"{p:016x}", m if (m := min(least[g])) < 2**63 - 1 else None)
                   for (d, _, _), p, g in zip(rows, prints, roots, strict=True)], key=repr)
    found = simhash.simhash_groups(docs)
    assert collected(found, "doc_id", "fingerprint", "component_id") == want
    assert found.where("is_representative").count() == len(set(roots))
    assert simhash.simhash_dedup(docs).count() == len(set(roots))


@pytest.mark.parametrize("together", [6, 4096])
def test_close_links_lose_no_pair(spark, together):
    r = random.Random(2)
    centres = [r.getrandbits(64) for _ in range(12)]
    values = {c ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & (1 << 64) - 1
              for c in centres for _ in range(12)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    roots = grouped(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.close_links(frame, 3, together)
    found = dict(map(tuple, components.components(links).distinct().collect()))
    parts = defaultdict(set)
    for v, g in zip(values, roots, strict=True):
        parts[g].add(found.get(v, v))
    assert all(len(p) == 1 for p in parts.values())
    assert len(set().union(*parts.values())) == len(parts)


def test_exact_dedup(docs, rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    ids = defaultdict(list)
    for (d, _, _), t in zip(rows, norm, strict=True):
        ids[t].append(place(d))
    want = sorted([(d, k if (k := min(ids[t])) < 2**63 - 1 else None, len(ids[t]), sha(t.encode()))
                   for (d, _, _), t in zip(rows, norm, strict=True)], key=repr)
    for counters in (16, 4096):
        found = exact.exact_dedup(docs, counters=counters, max_winners=8)
        assert collected(found, "doc_id", "keep_id", "group_size", "text_sha256") == want
        assert found.where("kept").count() == len(ids)


@pytest.mark.parametrize("crowd", [1, 2_000])
def test_substring_dedup(docs, rows, crowd):
    words = [(place(d), (t or "").encode().split()) for d, t, _ in rows]
    first = {}
    for d, w in words:
        for s in range(len(w) - 49):
            key = tuple(w[s:s + 50])
            first[key] = min(first.get(key, d), d)
    want = []
    for d, w in words:
        gone = {i for s in range(len(w) - 49) if first[tuple(w[s:s + 50])] < d
                for i in range(s, s + 50)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        want.append((d if d < 2**63 - 1 else None, len(w), len(gone), kept))
    found = phrases.substring_dedup(docs, crowd=crowd, shard_rows=20)
    assert collected(found, "doc_id", "n_words", "n_removed", "text") == sorted(want, key=repr)


@pytest.mark.parametrize("crowd", [1, 2_000])
def test_passages_repeated_inside_the_later_document(spark, crowd):
    r = random.Random(5)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    p, x, y = fresh(60), fresh(100), fresh(100)
    texts = [(1, fresh(80) + p + fresh(80)), (2, (x + p + y) * 3), (2, fresh(7) + x + p + y),
             (3, fresh(90) + p[:55] + fresh(90))]
    q, u, v = fresh(70), fresh(100), fresh(100)
    texts += [(4, q + fresh(60)), (None, u + q + v), (None, fresh(3) + u + q + v + u + q + v)]
    first, want = {}, []
    for d, w in texts:
        for s in range(len(w) - 49):
            key = tuple(w[s:s + 50])
            first[key] = min(first.get(key, place(d)), place(d))
    for d, w in texts:
        gone = {i for s in range(len(w) - 49) if first[tuple(w[s:s + 50])] < place(d)
                for i in range(s, s + 50)}
        want.append((d, len(w), len(gone), " ".join(t for i, t in enumerate(w) if i not in gone)))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in texts], "doc_id long, text string")
    found = phrases.substring_dedup(frame, crowd=crowd)
    assert collected(found, "doc_id", "n_words", "n_removed", "text") == sorted(want, key=repr)
    assert sorted(n for d, _, n, _ in want if d == 2) == [60, 180]


@pytest.mark.parametrize("crowd", [1, 1_000])
def test_suffix_dedup(docs, rows, crowd):
    raw = [(d, (t or "").encode()) for d, t, _ in rows]
    count = defaultdict(int)
    for _, b in raw:
        for s in range(len(b) - 399):
            count[b[s:s + 400]] += 1
    want = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if count[b[s:s + 400]] > 1:
                gone[s:s + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((d, len(b), int(gone.sum()), runs, sha(kept)))
    found = suffixes.suffix_dedup(docs, crowd=crowd, shard_rows=20)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"])))
           for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("crowd", [1, 1_000])
def test_suffix_dedup_of_texts_that_repeat_themselves(spark, crowd):
    r = random.Random(8)
    fresh = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    unit, line = fresh(9), fresh(300)
    texts = [fresh(500) + unit * 200 + fresh(450), unit * 60, unit * 45, unit * 44 + unit[:3],
             fresh(60) + unit * 44 + fresh(60), "z" * 401, "y" * 399, "x" * 400, "w" * 140_000,
             fresh(90) + line * 5 + fresh(90), line + fresh(90) + line * 2, "é" * 201 + unit * 50]
    raw = [(i, t.encode()) for i, t in enumerate(texts)]
    count = defaultdict(int)
    for _, b in raw:
        for s in range(len(b) - 399):
            count[hash(b[s:s + 400])] += 1
    want = []
    for d, b in raw:
        gone = np.zeros(len(b) + 2, np.int64)
        for s in range(len(b) - 399):
            if count[hash(b[s:s + 400])] > 1:
                gone[s] += 1
                gone[s + 400] -= 1
        gone = np.cumsum(gone) > 0
        kept = np.frombuffer(b, np.uint8)[~gone[:len(b)]].tobytes()
        want.append((d, len(b), int(gone.sum()),
                     int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha(kept)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = suffixes.suffix_dedup(docs, crowd=crowd, shard_rows=20)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"])))
           for r in found.collect()]
    assert sorted(got) == want
    assert [n for d, _, n, _, _ in want if d in (5, 6, 7, 8)] == [401, 0, 0, 140_000]


def test_equal_segments_that_follow_one_another_are_one_row(spark, monkeypatch):
    """A string that a document repeats is one row of its class, however often it does."""
    stored = {}
    keep = suffixes.write_once
    monkeypatch.setattr(suffixes, "write_once",
                        lambda df, label: stored.setdefault(label, keep(df, label)))
    docs = spark.createDataFrame([(1, "ab" * 30_000), (2, "x" + "ab" * 20_000 + "y" * 500)],
                                 "doc_id long, text string")
    assert suffixes.suffix_dedup(docs).agg({"n_removed": "sum"}).first()[0] == 100_500
    assert stored["byte-segments"].count() < 100


def test_repeated_windows_of_a_suffix_array():
    r = random.Random(3)
    for _ in range(30):
        parts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 60))) for _ in range(6)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = [len(p) for p in parts]
        ends = np.repeat(np.cumsum(sizes), sizes)
        windows = defaultdict(list)
        for p, last in zip(parts, np.cumsum(sizes), strict=True):
            for s in range(len(p) - 12):
                windows[p[s:s + 13]].append(last - len(p) + s)
        want = sorted(x for v in windows.values() if len(v) > 1 for x in v)
        assert suffixes.repeated(data, ends, 13).tolist() == want


@pytest.mark.parametrize("limits", [{}, {"long_chars": 6}, {"min_lines": 2, "long_chars": 1_000},
                                    {"min_lines": 4, "long_chars": 15}])
def test_line_dedup(docs, rows, limits):
    texts = [(place(d), t) for d, t, _ in rows]
    want = []
    for (d, t), gone in zip(texts, gone_lines(texts, **limits), strict=True):
        ls = [] if t is None else t.split("\n")
        kept = None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in gone)
        want.append((d if d < 2**63 - 1 else None, kept, len(ls), len(gone), "clash"))
    found = lines.line_dedup(docs, **limits)
    assert collected(found, "doc_id", "text", "n_lines", "n_removed", "size") == \
        sorted(want, key=repr)


def test_line_dedup_of_frequent_and_tied_lines(spark):
    """One line in every document, between lines that differ, blank or repeat; runs at both ends."""
    r = random.Random(3)
    common, tail = "a line that very many of these documents hold", "Yes."
    pool = [common, tail, "", "  ", "no", "another line of more than forty characters, rarer"]
    texts = [(i, "\n".join(r.choices(pool, (6, 3, 2, 1, 2, 1), k=r.randint(1, 9))))
             for i in range(300)]
    texts += [(400, common), (401, f"{common}\n{tail}"), (402, f"{tail}\n{common}"), (403, tail)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x for x in lines.line_dedup(frame).collect()}
    for (d, t), gone in zip(texts, gone_lines(texts), strict=True):
        assert got[d].text == "\n".join(
            x for i, x in enumerate(t.split("\n")) if i not in gone), (d, t)
        assert got[d].n_removed == len(gone)


def test_mixing(docs, rows):
    found = mixing.mix_sources(docs, rows_per_range=5)
    again = mixing.mix_sources(docs.repartition(2), rows_per_range=5)
    columns = ("doc_id", "source", "size", "source_size", "target", "taken")
    assert collected(found, *columns) == collected(again, *columns)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found.collect():
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, free, total = {s: i % 3 + 1 for i, s in enumerate(order)}, set(order), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in order if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        free -= over
    for s in order:
        want = share[s] if s in free else 3 * sizes[s]
        assert abs(target[s] - want) < 1e-6 and abs(taken[s] - want) <= 1
    words = mixing.mixture(docs, found).selectExpr(
        r"sum(regexp_count(text, '[^\\x20\\x09-\\x0D]+')) AS n").first()["n"]
    assert words == sum(r["taken"] for r in found.collect())


def test_long_runs_of_blanks_are_encoded(spark):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(tokenizer_path())
    wide, odd = "\u3000" * 150_000, " \n\t \r\n\x85" * 20_000
    special = next(iter(packing.encoder(tokenizer_path()).special))
    texts = [" " * 2_000_000, "x" + "\n" * 2_000_000 + " y", f"a b{odd}c  d{odd}\x1c{odd}",
             f"{wide}1{wide}'s{odd} !", f"{odd}{special}{odd}{special} z{odd}\n",
             "a " * 60_000 + odd + "b" * 120_000]
    for text in texts:
        want = np.array(codec.encode(text, add_special_tokens=False).ids, "<u4")
        assert np.array_equal(np.frombuffer(packing.encoder(tokenizer_path()).encode(text), "<u4"),
                              want)
    frame = spark.createDataFrame([(1, texts[0]), (2, "a b")], "doc_id long, text string")
    found = packing.pack(frame, tokenizer_path())
    assert {r["doc_id"] for r in found.collect()} == {1, 2}


def test_packing_is_a_partition(docs, rows):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(tokenizer_path())
    found = packing.pack(docs, tokenizer_path()).collect()
    want = []
    for d, t, _ in rows:
        ids = np.array([*codec.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d, s, len(p := ids[s:s + 1024]), zlib.crc32(p.tobytes()), len(ids))
                 for s in range(0, len(ids), 1024)]
    got = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_fill_closest_is_closest():
    r = random.Random(4)
    for _ in range(60):
        counts = {length: r.randint(1, 3) for length in r.sample(range(1, 25), 5)}
        chosen = dict(packing.fill_closest(counts, 30))
        assert all(k <= counts[length] for length, k in chosen.items()) and max(counts) in chosen
        sums = {0}
        for length, n in counts.items():
            sums |= {s + length * k for s in sums for k in range(n - (length == max(counts)) + 1)}
        best = max(s for s in sums if s + max(counts) <= 30) + max(counts)
        assert sum(length * k for length, k in chosen.items()) == best


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    codec, own = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    r = random.Random(5)
    for _ in range(500):
        text = "".join(r.choice("ab Z\n\t\x85\xa0'9é中😀.,<|endoftext|>") for _ in range(30)) \
            + r.choice(["", "<|endoftext|>", " <|endoftext|> x"])
        assert np.frombuffer(own.encode(text), "<u4").tolist() == \
            codec.encode(text, add_special_tokens=False).ids


def test_chat_round_trip(spark):
    r = random.Random(6)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", " a", "é", "\n",
            "<\\s>", "[\\\\INST]", "<|endoftext|>", "😀", "  "]
    turns = [(c, t, r.choice(["user", "assistant", "system", "tool", "[INST]", None]),
              r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(0, 12)))]), "x")
             for c in [None, *range(60)] for t in [*range(r.randint(1, 6)), None]]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, "
                                         "formatted string")
    got = {r["conv_id"]: r for r in chat.chat_digests(
        chat.format_chats(frame, tokenizer_path())).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in turns:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert got[c]["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for _, a, b in own).encode())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss.encode()))
    assert chat.chat_digests(chat.format_chats(frame.limit(0), tokenizer_path())).count() == 0


@pytest.mark.parametrize("sizes", [{"part_rows": 100}, {"part_rows": 40, "query_rows": 2}])
def test_search_recall_and_ties(spark, sizes):
    rng = np.random.default_rng(7)
    data = rng.standard_normal((1_500, 24))
    data[100:160] = data[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(data)]
    rows += [(2_000, None, 1), (2_100, [0.0] * 24, 1), (2_200, [float("nan")] * 24, 1),
             (2_300, [1.0, None] * 12, 1), (2_400, [float("inf")] * 24, 1), (2_500, [1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int")
    got = defaultdict(list)
    for r in ann.search(frame, frame.where("vec_id % 100 = 0"), **sizes).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1_500, 100))
    hits = 0
    for q, found in got.items():
        far = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(len(data)), far)) if i != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(far[v] - s) < 1e-12 for _, v, s in found)
        hits += len({f[1] for f in found} & set(want))
    assert [f[1] for f in got[0]] == list(range(100, 110))
    assert hits >= 0.9 * 10 * len(got)
    assert ann.search(frame.limit(0), frame.limit(0)).count() == 0


def test_probes_follow_the_data():
    """Few lists for vectors in clumps, many for those without structure, never fewer than needed."""
    rng = np.random.default_rng(4)
    middles = 20 * rng.standard_normal((30, 16))
    clumps = middles[rng.integers(0, 30, 3_000)] + rng.standard_normal((3_000, 16))
    even = rng.standard_normal((3_000, 16))
    needed = []
    for data in (clumps, even):
        centroids = ann.fit_centroids(data[::2], 40, 5)
        probes = ann.probes_needed(data[1::2], centroids, 10, 0.95)
        own, hits = ann.nearest_lists(data, centroids, 1)[:, 0], 0
        for q in range(0, 3_000, 100):
            far = ((data - data[q]) ** 2).sum(axis=1)
            far[q] = np.inf
            near = np.argsort(far)[:10]
            hits += np.isin(own[near], ann.nearest_lists(data[q:q + 1], centroids, probes)).sum()
        assert hits >= 0.93 * 300
        needed.append(probes)
    assert needed[0] <= 8 < needed[1] <= 40
    assert ann.probes_needed(even[:15], even[:7], 10, 0.95) == 7


def test_quality(spark, docs, rows):
    r = random.Random(8)
    good = [(i, " ".join(r.choice(["the", "of", "and", "house"]) for _ in range(30)), 1)
            for i in range(300)]
    bad = [(i, " | ".join(r.choice(["zq", "xx", "qj"]) for _ in range(30)), 0)
           for i in range(300, 400)]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.fit(frame.drop("quality"), frame.select("doc_id", "quality"))
    scored = quality.score_quality(frame, model).join(frame, "doc_id").collect()
    assert all(s["predicted"] == s["quality"] for s in scored)
    assert all(s["held_out"] == (zlib.crc32(str(s["doc_id"]).encode()) % 5 == 0) for s in scored)
    awkward = quality.score_quality(docs, model).collect()
    assert len(awkward) == len(rows) and all(0 <= s["score"] <= 1 for s in awkward)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(s["predicted"] for s in awkward)


def test_empty_tables(empty):
    assert simhash.simhash_groups(empty).count() == 0
    assert exact.exact_dedup(empty).count() == 0
    assert phrases.substring_dedup(empty).count() == 0
    assert suffixes.suffix_dedup(empty).count() == 0
    assert lines.line_dedup(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert packing.pack(empty, tokenizer_path()).count() == 0
    model = quality.fit(empty, empty.selectExpr("doc_id", "row_id AS quality"))
    assert quality.score_quality(empty, model).count() == 0
